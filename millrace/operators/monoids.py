"""Monoids as columns: what nothing is, how two values merge, and how a group's values add up.

Every monoid has an identity, a merge of two columns and an aggregate.  Monoids whose result depends on the order of
values ask for a column to order by.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Monoid:
    name: str
    identity: Callable[[], Column]
    merge: Callable[[Column, Column], Column]
    #: Takes the values, and the order where it matters.
    aggregate: Callable[[Column, Column | None], Column]
    ordered: bool = False

    def over(self, value: Column, order: Column | None = None) -> Column:
        """The aggregate of a group's values."""
        if self.ordered and order is None:
            raise ValueError(f"{self.name} depends on the order of values: give a column to order by")
        return F.coalesce(self.aggregate(value, order), self.identity())


def _null(kind: str) -> Callable[[], Column]:
    return lambda: F.lit(None).cast(kind)


def sum_(kind: str = "long") -> Monoid:
    return Monoid("sum", lambda: F.lit(0).cast(kind), lambda a, b: a + b, lambda v, _: F.sum(v).cast(kind))


def product(kind: str = "double") -> Monoid:
    return Monoid("product", lambda: F.lit(1).cast(kind), lambda a, b: a * b, lambda v, _: F.product(v).cast(kind))


def least(kind: str) -> Monoid:
    return Monoid("min", _null(kind), lambda a, b: F.least(a, b), lambda v, _: F.min(v))


def greatest(kind: str) -> Monoid:
    return Monoid("max", _null(kind), lambda a, b: F.greatest(a, b), lambda v, _: F.max(v))


def any_() -> Monoid:
    return Monoid("any", lambda: F.lit(False), lambda a, b: a | b, lambda v, _: F.bool_or(v))


def all_() -> Monoid:
    return Monoid("all", lambda: F.lit(True), lambda a, b: a & b, lambda v, _: F.bool_and(v))


def first(kind: str) -> Monoid:
    """The first value that isn't null."""
    return Monoid("first", _null(kind), lambda a, b: F.coalesce(a, b), lambda v, o: F.min_by(v, F.when(v.isNotNull(), o)), ordered=True)


def last(kind: str) -> Monoid:
    """The last value that isn't null."""
    return Monoid("last", _null(kind), lambda a, b: F.coalesce(b, a), lambda v, o: F.max_by(v, F.when(v.isNotNull(), o)), ordered=True)


def _in_order(value: Column, order: Column | None) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"])


def concat_list(element: str) -> Monoid:
    """Lists end to end; values are arrays."""
    return Monoid("concat_list", lambda: F.array().cast(f"array<{element}>"), lambda a, b: F.concat(a, b), lambda v, o: F.flatten(F.filter(_in_order(v, o), lambda x: x.isNotNull())), ordered=True)


def concat_text() -> Monoid:
    return Monoid("concat_text", lambda: F.lit(""), lambda a, b: F.concat(a, b), lambda v, o: F.array_join(_in_order(v, o), ""), ordered=True)


def set_of(element: str) -> Monoid:
    """Union of arrays without repeats, sorted, so that its value doesn't depend on the order of rows."""
    return Monoid("set", lambda: F.array().cast(f"array<{element}>"), lambda a, b: F.array_sort(F.array_union(a, b)), lambda v, _: F.array_sort(F.array_distinct(F.flatten(F.collect_set(v)))))


def map_of(key: str, value: str) -> Monoid:
    """Maps; of a key in both, the left value stays."""

    def merge(a: Column, b: Column) -> Column:
        return F.map_concat(a, F.map_filter(b, lambda k, _: ~F.array_contains(F.map_keys(a), k)))

    def aggregate(v: Column, order: Column | None) -> Column:
        # All entries by key and then by place; of each key the first stays.  Keys must have an order, as those of a
        # group do.
        entries = F.flatten(F.filter(_in_order(F.map_entries(v), order), lambda x: x.isNotNull()))
        placed = F.array_sort(F.transform(entries, lambda x, i: F.struct(x["key"].alias("k"), i.alias("i"), x["value"].alias("v"))))

        def firsts(p: Column) -> Column:
            return F.filter(p, lambda x, i: (i == 0) | ~x["k"].eqNullSafe(F.get(p, i - 1)["k"]))

        # A variable of a lambda, so that the sorted entries are computed once and not for each of them.
        kept = F.transform(F.array(placed), firsts)[0]
        return F.map_from_entries(F.transform(kept, lambda x: F.struct(x["k"], x["v"])))

    return Monoid("map", lambda: F.create_map().cast(f"map<{key},{value}>"), merge, aggregate, ordered=True)


def fields(parts: Mapping[str, Monoid]) -> Monoid:
    """A struct that merges field by field."""
    names = list(parts)
    return Monoid(
        "fields",
        lambda: F.struct(*[parts[n].identity().alias(n) for n in names]),
        lambda a, b: F.struct(*[parts[n].merge(a[n], b[n]).alias(n) for n in names]),
        lambda v, o: F.struct(*[F.coalesce(parts[n].aggregate(v[n], o), parts[n].identity()).alias(n) for n in names]),
        ordered=any(p.ordered for p in parts.values()),
    )
