"""Stages: map rows, group them by a key, reduce each group; or map only.

A stage is declared in one of three ways.  With columns, Catalyst plans it whole: projection, partial aggregation and
column pruning need no further hint, so there is no combiner to declare.  With a monoid, it compiles to the monoid's
aggregate.  With a Python reducer, groups are streamed in order (see ``grouped``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from millrace.operators.grouped import OnError, Reducer, reduce_sorted
from millrace.operators.keys import Key, key, names_of
from millrace.operators.monoids import Monoid

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Options:
    """``map_tasks`` and ``reduce_tasks`` set partition counts, which adaptive execution else chooses; ``timeout_s``
    ends the job that writes the stage; ``compression`` and ``separator`` go to the writer."""

    map_tasks: int | None = None
    reduce_tasks: int | None = None
    timeout_s: float | None = None
    compression: str | None = None
    separator: str | None = None
    on_error: OnError = OnError.RETHROW

    def writer_options(self) -> dict[str, str]:
        found = {"compression": self.compression, "sep": self.separator}
        return {k: v for k, v in found.items() if v is not None}


@dataclass(frozen=True)
class Stage:
    """A named step from rows to rows.  ``before >> stage`` and ``stage >> after`` compose with plain functions.

    ``step`` takes the rows, and the options in force when it is called if it ``takes_options``.
    """

    name: str
    step: Callable[..., DataFrame]
    options: Options = field(default_factory=Options)
    takes_options: bool = False

    def __call__(self, df: DataFrame) -> DataFrame:
        if self.options.map_tasks:
            # Fewer tasks read more each; more need the rows to be dealt out anew.
            fewer = self.options.map_tasks < df.rdd.getNumPartitions()
            df = df.coalesce(self.options.map_tasks) if fewer else df.repartition(self.options.map_tasks)
        return self._apply(df, self.options)

    def _apply(self, df: DataFrame, options: Options) -> DataFrame:
        return self.step(df, options) if self.takes_options else self.step(df)

    def __rshift__(self, after: Step | Stage) -> Stage:
        return replace(self, step=lambda df, options: after(self._apply(df, options)), takes_options=True)

    def __rrshift__(self, before: Step) -> Stage:
        return replace(self, step=lambda df, options: self._apply(before(df), options), takes_options=True)

    def having(self, **options: object) -> Stage:
        return replace(self, options=replace(self.options, **options))


def map_only(name: str, step: Step) -> Stage:
    """No shuffle: each partition's rows go through ``step``."""
    return Stage(name, step)


def aggregate(name: str, keys: Sequence[str] | Key, aggregates: Mapping[str, Column], mapper: Step | None = None) -> Stage:
    """Group by key columns and aggregate.  Without key columns all rows are one group, and no rows give no row."""
    names = keys.grouping if isinstance(keys, Key) else names_of(keys)
    cells = [c.alias(n) for n, c in aggregates.items()]

    def step(df: DataFrame, options: Options) -> DataFrame:
        rows = mapper(df) if mapper else df
        if not names:
            return rows.groupBy(F.lit("").alias("_all")).agg(*cells).drop("_all")
        out = rows.dropna(subset=names).groupBy(*names).agg(*cells)
        # Rows are few by now, so that dealing them to as many tasks as asked for keeps the partial aggregation.
        return out.repartition(options.reduce_tasks, *names) if options.reduce_tasks else out

    return Stage(name, step, takes_options=True)


def reduce_by(name: str, keys: Sequence[str], monoid: Monoid, value: Column, order: Column | None = None, out: str = "value", mapper: Step | None = None) -> Stage:
    """Sum up a group's values by a monoid."""
    return aggregate(name, keys, {out: monoid.over(value, order)}, mapper)


def reduce_with(name: str, by: Key, reducer: Reducer, schema: str, mapper: Step | None = None, options: Options | None = None) -> Stage:
    """A Python reducer over groups sorted by the whole key."""

    def step(df: DataFrame, options: Options) -> DataFrame:
        rows = mapper(df) if mapper else df
        return reduce_sorted(rows, by, reducer, schema, options.on_error, options.reduce_tasks, name)

    return Stage(name, step, options or Options(), takes_options=True)


def over_groups(name: str, by: Key, columns: Mapping[str, Callable[[WindowSpec], Column]], running: bool = True) -> Stage:
    """Columns over each group's rows in the order of the whole key, by window functions: a secondary sort whose
    reducer Spark knows.  With ``running`` a row sees its group up to itself, else all of it."""

    def step(df: DataFrame) -> DataFrame:
        window = by.window()
        if running:
            window = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return by.keyed(df).withColumns({n: make(window) for n, make in columns.items()})

    return map_only(name, step)


def fold(name: str, keys: Sequence[str], value: Column, order: Column, start: Column, step: Callable[[Column, Column], Column], out: str = "value") -> Stage:
    """Left fold of a group's values in order.  A group's values are collected: use a monoid where one will do."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"])
    return aggregate(name, keys, {out: F.aggregate(ordered, start, step)})


def first_by(name: str, keys: Sequence[str], order: Sequence[str]) -> Stage:
    """The row of each key that comes first by ``order``, in whole."""

    def step(df: DataFrame) -> DataFrame:
        whole = F.struct(*df.columns)
        least = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.min_by(whole, F.struct(*order)).alias("_first"))
        return least.select("_first.*")

    return Stage(name, step)


def flat_map(name: str, array: Column, out: str = "value", keep: Sequence[str] = ()) -> Stage:
    """One row for each element of an array column."""
    return map_only(name, lambda df: df.select(*keep, F.explode(array).alias(out)))


def spread(df: DataFrame, partitions: int) -> DataFrame:
    """Deal rows out evenly, with no key."""
    return df.repartition(partitions)


def tee_first(df: DataFrame, path: str, fmt: str = "json") -> DataFrame:
    """Write one row, such as a header or a snapshot, to ``path``, and go on with all rows."""
    df.limit(1).write.mode("overwrite").format(fmt).save(path)
    return df


def sort_all(df: DataFrame, by: Key) -> DataFrame:
    """A total order, by range partitioning rather than one task."""
    return df.orderBy(*by.sort_expressions())


def top(df: DataFrame, by: Key, n: int) -> DataFrame:
    return df.orderBy(*by.sort_expressions()).limit(n)


def combiner_agrees(df: DataFrame, keys: Sequence[str], monoid: Monoid, value: str, parts: int = 4) -> bool:
    """Whether aggregating in parts and then the parts gives what aggregating at once does."""
    whole = df.groupBy(*keys).agg(monoid.over(F.col(value)).alias("v"))
    part = df.withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.lit(parts))).groupBy(*keys, "_part").agg(monoid.over(F.col(value)).alias("v"))
    again = part.groupBy(*keys).agg(monoid.over(F.col("v")).alias("v"))
    return not whole.exceptAll(again).limit(1).count() and not again.exceptAll(whole).limit(1).count()


__all__ = ["Options", "Stage", "aggregate", "combiner_agrees", "first_by", "flat_map", "fold", "key", "map_only", "over_groups", "reduce_by", "reduce_with", "sort_all", "spread", "tee_first", "top"]
