"""Fan-out: each row goes to a target that its own values name, and a count of rows is kept for each target."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from enum import Enum
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.files import Files

STATS = "path string, count long"


class Strategy(Enum):
    """How a task writes its rows: sorted by target, one file open at a time; with the files of many targets open, in
    the order of rows; or a file for each run of rows with one target, in folders ``run=N`` of the target."""

    SORTED = "sorted"
    OPEN = "open"
    RUNS = "runs"


def numbered_runs(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``run``: the task's number and that of the run of equal values of ``column`` within it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, last, number = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            runs = []
            for value in batch.column(column).to_pylist():
                number += value != last
                last = value
                runs.append(f"{task}-{number}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs, pa.string())], names=[*batch.schema.names, "run"])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", run string")


def fan_out(df: DataFrame, target: Column, base: str, fmt: str = "parquet", stats: str | None = None, rows_per_file: int = 0, replace: bool = False, strategy: Strategy = Strategy.SORTED, open_files: int = 64, **options: str) -> DataFrame:
    """Write rows below ``base`` by target, and return ``path, count``, written as CSV to ``stats``, or ``base/_stats``.

    Everything is written beside its place first and moved there once all of it is.  Targets that are there already
    raise ``FileExistsError``, or are replaced whole with ``replace``.  If moving fails midway, what was moved is taken
    back and what was replaced is put back; a driver that dies midway leaves no new ``base/_targets``, the list of what
    was published that is written last.

    Rows are computed once, and counts are of the rows written.  Tasks write their own rows, with no shuffle by target,
    so a target with most of the rows is written by many.  Targets may hold any characters, and slashes make folders;
    rows with a null target go to ``__null__``.
    """
    spark = df.sparkSession
    files = Files(spark)
    base = base.rstrip("/")
    staging = f"{base}.staging-{uuid.uuid4().hex}"
    routed = df.withColumn("_target", F.coalesce(target.cast("string"), F.lit("__null__")))
    concurrent = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(concurrent)
    moved: list[tuple[str, str | None]] = []
    try:
        # Other formats can't be counted from their files, so their rows are kept for that.
        rows = routed
        if fmt != "parquet":
            routed.write.parquet(f"{staging}/rows")
            rows = spark.read.schema(routed.schema).parquet(f"{staging}/rows")
        if strategy is Strategy.RUNS:
            rows = numbered_runs(rows, "_target")
        writer = rows.write.format(fmt).options(**options)
        if rows_per_file:
            writer = writer.option("maxRecordsPerFile", rows_per_file)
        spark.conf.set(concurrent, str(open_files if strategy is Strategy.OPEN else 0))
        writer.partitionBy("_target", *["run"] * (strategy is Strategy.RUNS)).save(f"{staging}/data")
        spark.conf.set(concurrent, before)
        written = rows if fmt != "parquet" else spark.read.option("basePath", f"{staging}/data").schema("_target string").parquet(f"{staging}/data")
        counts = written.groupBy(F.col("_target").alias("path")).agg(F.count(F.lit(1)).alias("count"))
        counts.write.csv(f"{staging}/stats")
        # One folder for each target; their number is that of the outputs the caller asked for.
        fs, root = files._open(f"{staging}/data")
        unescape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        folders = {s.getPath().toString(): s.getPath().getName().removeprefix("_target=") for s in fs.listStatus(root) if s.isDirectory()}
        places = {path: f"{base}/{quote(unescape(name), safe='/=-_.~ ')}" for path, name in folders.items()}
        if not replace:
            there = [p for p in places.values() if files.exists(p)]
            if there:
                raise FileExistsError(f"targets are there already: {there[:3]}")
        for number, (path, place) in enumerate(places.items()):
            old = f"{staging}/old/{number}" if files.exists(place) else None
            if old:
                move(files, place, old)
            moved.append((place, old))
            move(files, path, place)
        where = stats or f"{base}/_stats"
        if replace or not stats:
            files.delete(where)
        move(files, f"{staging}/stats", where)
        spark.createDataFrame([(p.removeprefix(f"{base}/"),) for p in places.values()], "target string").write.mode("overwrite").text(f"{base}/_targets")
        return spark.read.schema(STATS).csv(where)
    except BaseException:
        for place, old in reversed(moved):
            files.delete(place)
            if old:
                files.rename(old, place)
        raise
    finally:
        spark.conf.set(concurrent, before)
        files.delete(staging)


def move(files: Files, source: str, target: str) -> None:
    if files.exists(target) or not files.rename(source, target):
        raise OSError(f"can't move {source} to {target}")
