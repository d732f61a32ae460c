"""Taps: datasets by location and codec, sources and sinks alike."""

from __future__ import annotations

import gzip
import sys
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from millrace.functions.codecs import Codec
from millrace.sources.files import Files

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Tap:
    """Locations that one codec reads: files, directories or globs.  Written, a tap is its first location.

    Equality is by location alone.
    """

    paths: tuple[str, ...]
    codec: Codec

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Tap) and self.paths == other.paths

    def __hash__(self) -> int:
        return hash(self.paths)

    def read(self, spark: SparkSession) -> DataFrame:
        return self.codec.read(spark, *self.paths)

    def write(self, df: DataFrame, mode: str = "errorifexists", **options: str) -> None:
        """A path with an extension, such as ``out.csv``, becomes one file; others a directory of as many parts as there
        are.  One file is written by one task."""
        target = self.paths[0].rstrip("/")
        if "." not in target.rsplit("/", 1)[-1]:
            self.codec.write(df, target, mode, **options)
            return
        files = Files(df.sparkSession)
        if mode == "errorifexists" and files.exists(target):
            raise FileExistsError(target)
        folder, name = target.rsplit("/", 1) if "/" in target else (".", target)
        made = f"{folder}/_{name}-{uuid.uuid4().hex}"
        try:
            self.codec.write(df, made, "errorifexists", single_file=True, **options)
            fs, where = files._open(made)
            parts = [s.getPath().toString() for s in fs.listStatus(where) if s.getPath().getName().startswith("part-")]
            files.delete(target)
            if not files.rename(parts[0], target):
                raise OSError(f"can't move the written file to {target}")
        finally:
            files.delete(made)


def tap(path: str, codec: Codec) -> Tap:
    return Tap((path,), codec)


def taps(paths: Sequence[str], codec: Codec) -> Tap:
    return Tap(tuple(paths), codec)


@dataclass(frozen=True)
class Union:
    """Taps read as one, each by its own codec; columns that some don't have are null.  Written by the first."""

    parts: tuple[Tap, ...]

    @property
    def paths(self) -> tuple[str, ...]:
        return tuple(p for t in self.parts for p in t.paths)

    def read(self, spark: SparkSession) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.read(spark) for t in self.parts])

    def write(self, df: DataFrame, mode: str = "errorifexists", **options: str) -> None:
        self.parts[0].write(df, mode, **options)


def concat(*parts: Tap) -> Union:
    return Union(parts)


def tagged(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both datasets in one, ``tag`` left or right and the rows as structs; the two may be the same."""
    a = left.select(F.lit("left").alias("tag"), F.struct(*left.columns).alias("left"))
    b = right.select(F.lit("right").alias("tag"), F.struct(*right.columns).alias("right"))
    return a.unionByName(b, allowMissingColumns=True)


def untagged(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    return both.filter("tag = 'left'").select("left.*"), both.filter("tag = 'right'").select("right.*")


def file_name() -> Column:
    """The file that a row was read from; for rows straight from a scan of files."""
    return F.col("_metadata.file_path")


def read_small(tap: Tap | Union, spark: SparkSession, most: int = 100_000) -> list[Row]:
    """All rows of a small dataset on the driver; fails if there are more than ``most``."""
    rows = tap.read(spark).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return rows


def gunzip(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``path, content`` with the contents of files whose names end in gz unpacked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if name.endswith("gz"):
                    data = gzip.decompress(data)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary())], names=["path", "content"])

    return files.select(path, content).mapInArrow(run, "path string, content binary")


def binary_dir(spark: SparkSession, folder: str, keep: Callable[[Column], Column] | None = None, pattern: str | None = None) -> DataFrame:
    """``path, content`` of the files below a folder, gunzipped; ``keep`` is a condition on the path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(folder)
    return gunzip(files.filter(keep(F.col("path"))) if keep else files)


def file_list(spark: SparkSession, listing: str) -> DataFrame:
    """``path, content`` of the files that a text file names, one a line, gunzipped.  The list is read on the driver."""
    paths = [r["value"] for r in spark.read.text(listing).filter("trim(value) != ''").collect()]
    if not paths:
        return spark.createDataFrame([], "path string, content binary")
    return gunzip(spark.read.format("binaryFile").load(paths))
