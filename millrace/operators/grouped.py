"""Python reducers over groups whose rows come in order.

Rows are dealt out by the grouping columns and sorted by the whole key within partitions; a reducer then reads one
group at a time from Arrow batches.  A group may span any number of batches.  The reducer sees an iterator, so a group
needn't fit in memory, is called once for each group, and may stop early.
"""

from __future__ import annotations

import logging
import sys
from collections.abc import Callable, Iterable, Iterator
from enum import Enum

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from millrace.operators.keys import Key

cloudpickle.register_pickle_by_value(sys.modules[__name__])

Row = dict
Reducer = Callable[[tuple, Iterator[Row]], Iterable[Row]]


class OnError(Enum):
    """What becomes of a group whose reducer fails."""

    RETHROW = "rethrow"
    SKIP_KEY = "skip_key"
    #: Once more over the group's rows, which are held in memory for that; then rethrow.
    RETRY = "retry"


class GroupError(RuntimeError):
    """A reducer failed; says in which stage and for which key."""


def read_groups(batches: Iterable[pa.RecordBatch], grouping: list[str]) -> Iterator[tuple[tuple, Iterator[Row]]]:
    """Groups of rows sorted by ``grouping``.  What a reader leaves of a group is passed over."""
    rows = (row for batch in batches for row in batch.to_pylist())
    waiting: list[Row] = []

    def key_of(row: Row) -> tuple:
        return tuple(row[g] for g in grouping)

    def members(key: tuple, first: Row) -> Iterator[Row]:
        yield first
        for row in rows:
            if key_of(row) != key:
                waiting.append(row)
                return
            yield row

    for start in rows:
        here: Row | None = start
        while here is not None:
            key = key_of(here)
            group = members(key, here)
            yield key, group
            for _ in group:
                pass
            here = waiting.pop() if waiting else None


def _batches(rows: Iterable[Row], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    held: list[Row] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def map_rows(df: DataFrame, mapper: Callable[[Iterator[Row]], Iterable[Row]], schema: str, out_batch: int = 10_000) -> DataFrame:
    """Rows of ``schema`` from a Python mapper, which reads a task's rows as an iterator and may keep a state.

    What a mapper gives must not depend on how rows are dealt out to tasks.
    """
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(mapper(row for batch in batches for row in batch.to_pylist()), arrow, out_batch)

    return df.mapInArrow(run, schema)


def combine(df: DataFrame, key: Key, merge: Callable[[Row, Row], Row], most_groups: int = 100_000) -> DataFrame:
    """Rows of ``df``'s own columns, merged by key within tasks to shuffle fewer of them.

    ``merge`` must be associative and commutative over rows of a key, so that a reducer gives the same with it as
    without.  A task holds at most ``most_groups`` merged rows and passes them on when it has more.
    """
    grouping = key.grouping

    def merged(rows: Iterator[Row]) -> Iterator[Row]:
        held: dict[tuple, Row] = {}
        for row in rows:
            own = tuple(row[g] for g in grouping)
            held[own] = merge(held[own], row) if own in held else row
            if len(held) > most_groups:
                yield from held.values()
                held.clear()
        yield from held.values()

    return map_rows(key.keyed(df), merged, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))


def reduce_sorted(df: DataFrame, key: Key, reducer: Reducer, schema: str, on_error: OnError = OnError.RETHROW, partitions: int | None = None, stage: str = "reduce", out_batch: int = 10_000) -> DataFrame:
    """Rows of ``schema`` that the reducer gives for each group.  No rows in, no rows out, also for an empty key."""
    grouping = key.grouping
    rows = key.keyed(df)
    if not grouping:
        rows = rows.repartition(1)  # one group, that of the empty key
    elif partitions:
        rows = rows.repartition(partitions, *grouping)
    else:
        rows = rows.repartition(*grouping)
    if key.segments:
        rows = rows.sortWithinPartitions(*key.sort_expressions())

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
        for group_key, members in read_groups(batches, grouping):
            held = list(members) if on_error is OnError.RETRY else None
            try:
                found = list(reducer(group_key, iter(held) if held is not None else members)) if on_error is not OnError.RETHROW else reducer(group_key, members)
                yield from found
            except Exception as e:
                if on_error is OnError.SKIP_KEY:
                    logging.getLogger(__name__).warning("%s: skipped key %r: %s", stage, group_key, e)
                elif on_error is OnError.RETRY:
                    yield from reducer(group_key, iter(held))
                else:
                    raise GroupError(f"{stage}: key {group_key!r}: {e}") from e

    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(results(batches), arrow, out_batch)

    return rows.mapInArrow(run, schema)


def _arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def scan(step: Callable[[object, Row], tuple[object, Iterable[Row]]], start: Callable[[], object]) -> Reducer:
    """A reducer that carries a state from row to row: ``step`` gives the next state and the rows to emit."""

    def reducer(key: tuple, rows: Iterator[Row]) -> Iterator[Row]:
        state = start()
        for row in rows:
            state, out = step(state, row)
            yield from out

    return reducer
