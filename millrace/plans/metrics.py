"""Counters and status of running stages."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Mapping

from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("millrace")


class Counters:
    """Named counts by group.  Columns are counted by ``observe``, exactly once for a plan that runs once; Python code
    adds to accumulators, which may count a retried task's rows again."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._accumulators: dict[tuple[str, str], Accumulator[int]] = {}
        self._observed: dict[tuple[str, str], tuple[Observation, str]] = {}

    def counter(self, group: str, name: str) -> Accumulator[int]:
        return self._accumulators.setdefault((group, name), self.spark.sparkContext.accumulator(0))

    def observe(self, df: DataFrame, group: str, counts: Mapping[str, Column] | None = None) -> DataFrame:
        """The same rows; when an action runs over them, ``counts`` (all rows, by default) are taken on the way."""
        counts = counts or {"rows": F.count(F.lit(1))}
        seen = Observation()
        for name in counts:
            self._observed[group, name] = seen, name
        return df.observe(seen, *[c.cast("long").alias(n) for n, c in counts.items()])

    def value(self, group: str, name: str) -> int:
        """A count; of observed columns only after an action has run."""
        if (group, name) in self._observed:
            seen, column = self._observed[group, name]
            return seen.get[column]
        return self.counter(group, name).value


def status(spark: SparkSession, message: str) -> None:
    """What the following jobs are shown as, and a line in the log."""
    log.info("%s", message)
    spark.sparkContext.setJobDescription(message)


def every(n: int, effect: Callable[[int], None]) -> Callable[[Iterator], Iterator]:
    """A pass-through of batches within a task that calls ``effect`` with the number of rows so far at each ``n``."""

    def run(batches: Iterator) -> Iterator:
        done = 0
        for batch in batches:
            before, done = done // n, done + batch.num_rows
            for k in range(before + 1, done // n + 1):
                effect(k * n)
            yield batch

    return run
