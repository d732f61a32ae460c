"""Helpers the training-data operators share: tables, shared storage, Arrow plumbing."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ArrowStep = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: What a null key sorts and joins as, inside operators only; keys are whole numbers above it.
NULL_KEY = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_value(module: str) -> None:
    """Send a module's functions to executors by value, so that they need not have this package on their path."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).  Where none is set, a session of one process gets a
    temporary one, as in tests; on a cluster that is an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="millrace-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def durable(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    Every call writes to a path of its own, so a failed job leaves nothing that a later one could take for its result.
    The files go when ``discard`` is called or the application ends.
    """
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._millrace_path = path
    return back


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet; what is written there goes when the application ends."""
    root = f"{shared_dir(spark)}/millrace/{spark.sparkContext.applicationId}"
    fs, folder = _folder(spark, root)
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def discard(df: DataFrame) -> None:
    """Remove the files of a ``durable`` table that nothing reads any more."""
    fs, folder = _folder(df.sparkSession, df._millrace_path)
    fs.delete(folder, True)


def _folder(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to 8 MB in a session that leaves their size at Spark's own 64 MB.

    For programs that own their session, as the registered queries and the pipeline do; operators leave it as it is.
    """
    if spark.conf.get(BATCH_BYTES, "8m") in ("64MB", "64m", "67108864", "67108864b"):
        spark.conf.set(BATCH_BYTES, "8m")


def frugal(run: ArrowStep) -> ArrowStep:
    """A function for ``mapInArrow`` whose task gives its free memory back at the end.

    A Python worker else keeps the most it ever used, beside the JVM's heap.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return task


#: Keys are counted in this many slots, whatever their number, so the list of hot ones is bounded.
SLOTS = 1 << 16


def hot_slots(rows: DataFrame, on: Sequence[str], least: int) -> list[int]:
    """Slots of keys that hold ``least`` rows and eight times the mean: at most an eighth of all slots."""
    counts = rows.groupBy(slot_of(on).alias("slot")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).collect()
    if not counts:
        return []
    mean = rows.count() / SLOTS
    return [r["slot"] for r in counts if r["n"] > 8 * mean]


def slot_of(on: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*on), F.lit(SLOTS)).cast("int")


def spread_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", ways: int = 64, least: int = 1000, hot: list[int] | None = None) -> DataFrame:
    """Join by ``on``, where any key of ``left`` may hold a large share of its rows, and ``right`` has few rows a key.

    Rows of hot keys are dealt to ``ways`` tasks whatever they hold, and their partners in ``right`` are copied to
    each; all other keys are joined as usual.  ``left`` is read twice and must come in one order each time: a written
    table, or rows made from one without a shuffle.  ``hot`` are its ``hot_slots`` where the caller knows them.
    """
    hot = hot_slots(left, on, least) if hot is None else hot
    if not hot:
        return left.join(right, list(on), how)
    is_hot = slot_of(on).isin(hot)
    dealt = left.withColumn("_salt", F.when(is_hot, F.floor(F.rand(17) * ways).cast("int")).otherwise(0))
    copied = right.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(ways - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copied, [*on, "_salt"], how).drop("_salt")


BLANK = re.compile(r"\s")


def chunks(text: str, most: int = 1 << 20) -> Iterator[str]:
    """A text in parts of about ``most`` characters that begin at white space, so that no word is cut."""
    at = 0
    while at < len(text):
        found = BLANK.search(text, at + most) if at + most < len(text) else None
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def key_of(name: str):
    """An integer key column without nulls."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_KEY))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, nulls as empty, and the offsets of its rows (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pa.compute.fill_null(column, b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of whole rows holding about ``most`` bytes each (a longer row is a run of its own)."""
    out, n, lo = [], len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        out.append((lo, min(hi, n)))
        lo = out[-1][1]
    return out
