"""Composite keys: an ordered list of columns, of which a prefix groups and all of them sort."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


class Order(Enum):
    """How a key segment sorts within its group: as text, byte by byte, or as a number."""

    REGULAR = "regular"
    NUMERIC = "numeric"


@dataclass(frozen=True)
class Segment:
    """One column of a key.  ``reverse`` turns its order round."""

    name: str
    order: Order = Order.REGULAR
    reverse: bool = False

    def sort_expressions(self) -> list[Column]:
        """Numbers are compared as doubles, which any number fits, and then exactly, as those above 2^53 may need."""
        value = F.col(self.name)
        values = [value.try_cast("double"), value.try_cast("decimal(38,10)")] if self.order is Order.NUMERIC else [value.cast("string")]
        return [v.desc() if self.reverse else v.asc() for v in values]


@dataclass(frozen=True)
class Key:
    """Key columns; the first ``group`` of them (all, if None) make a group, the others order the rows in it.

    Rows with a null in a grouping column have no key: ``keyed`` drops them, as equality never matches them in joins.
    """

    segments: tuple[Segment, ...]
    group: int | None = None

    def __post_init__(self) -> None:
        if self.group is not None and not 0 <= self.group <= len(self.segments):
            raise ValueError(f"a key of {len(self.segments)} segments can't group by {self.group}")

    @property
    def names(self) -> list[str]:
        return [s.name for s in self.segments]

    @property
    def grouping(self) -> list[str]:
        return self.names[: len(self.segments) if self.group is None else self.group]

    def keyed(self, df: DataFrame) -> DataFrame:
        return df.dropna(subset=self.grouping) if self.grouping else df

    def sort_expressions(self) -> list[Column]:
        grouping = set(self.grouping)
        return [e for s in self.segments for e in ([F.col(s.name)] if s.name in grouping else s.sort_expressions())]

    def window(self) -> WindowSpec:
        """Rows of each group in the order of the rest of the key."""
        rest = [e for s in self.segments if s.name not in set(self.grouping) for e in s.sort_expressions()]
        window = Window.partitionBy(*self.grouping)
        return window.orderBy(*rest) if rest else window


def key(*names: str | Segment, group: int | None = None) -> Key:
    return Key(tuple(Segment(n) if isinstance(n, str) else n for n in names), group)


def numeric(name: str, reverse: bool = False) -> Segment:
    return Segment(name, Order.NUMERIC, reverse)


def flat_key(*parts: Column | str) -> Column:
    """Segments as one string, joined by ``|``; a null segment is empty and keeps its place."""
    texts = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.concat(*[x for t in texts for x in (F.lit("|"), t)][1:])


def int_key(value: Column) -> Column:
    """An integer as decimal text: groups alike, sorts as text."""
    return value.cast("string")


def utc_key(value: Column) -> Column:
    """A time as text in UTC whose order is the order of time; Spark's times hold microseconds.

    An instant is told in UTC whatever the session's zone; a time without a zone is taken to be UTC.
    """
    seconds = (F.unix_micros(value.cast("timestamp")).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    none = F.lit(0)
    instant = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(none, none, none, seconds)
    told = F.when(F.typeof(value) == "timestamp", instant).otherwise(value.cast("timestamp_ntz")).cast("string")
    return F.rpad(F.when(F.length(told) == 19, F.concat(told, F.lit("."))).otherwise(told), 26, "0")


def time_of_key(text: Column) -> Column:
    return F.to_timestamp_ntz(text, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS"))


def packed_key(*columns: str) -> Column:
    """A structured key as base64 text of its JSON; its order says nothing."""
    return F.base64(F.encode(F.to_json(F.struct(*columns)), "utf-8"))


def segments_of(line: Column, count: int) -> tuple[list[Column], Column]:
    """The first ``count`` tab-separated segments of a line, and the rest of it, tabs included."""
    parts = F.split(line, "\t")
    rest = F.array_join(F.slice(parts, count + 1, F.greatest(F.size(parts) - count, F.lit(0))), "\t")
    return [F.get(parts, i) for i in range(count)], rest


def names_of(columns: Sequence[str] | str | Key) -> list[str]:
    if isinstance(columns, Key):
        return columns.names
    return [columns] if isinstance(columns, str) else list(columns)
