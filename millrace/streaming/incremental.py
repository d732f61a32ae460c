"""Stages over unbounded input: the same columns, with watermarks; and scans that keep a state for each key."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_batch: int | None = None, **options: str) -> DataFrame:
    """A folder of files as an unbounded table; new files are read as they come."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    return reader.load(path)


def windowed(df: DataFrame, time: str, width: str, late: str, keys: Sequence[str], aggregates: Mapping[str, Column], slide: str | None = None) -> DataFrame:
    """Aggregates by key and event-time window: ``window_start, window_end``, the keys and the aggregates.

    Rows later than ``late`` behind the latest time seen are dropped by a stream, and kept by a batch.
    """
    window = F.window(F.col(time), width, slide) if slide else F.window(F.col(time), width)
    cells = [c.alias(n) for n, c in aggregates.items()]
    grouped = df.withWatermark(time, late).groupBy(window.alias("_window"), *keys).agg(*cells)
    return grouped.select(F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), *keys, *aggregates)


def sessions(df: DataFrame, time: str, gap: str, late: str, keys: Sequence[str], aggregates: Mapping[str, Column]) -> DataFrame:
    """Aggregates by key and session: rows of a key less than ``gap`` apart."""
    cells = [c.alias(n) for n, c in aggregates.items()]
    grouped = df.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("_window"), *keys).agg(*cells)
    return grouped.select(F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), *keys, *aggregates)


Fold = Callable[[tuple, tuple, pd.DataFrame], tuple[tuple, pd.DataFrame]]


def stateful_scan(df: DataFrame, keys: Sequence[str], step: Fold, start: tuple, out_schema: str, state_schema: str) -> DataFrame:
    """For each key, a state carried over all micro-batches.  ``step`` takes the key, the state and new rows, and gives
    the next state and rows to append."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else start
        for frame in frames:
            held, out = step(key, held, frame)
            yield out
        state.update(held)

    return df.groupBy(*keys).applyInPandasWithState(run, out_schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def each_batch(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Start a query that hands each micro-batch and its number to ``write``, which must be idempotent by that number."""
    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
