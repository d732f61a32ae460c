"""Joins of any number of inputs on shared keys, each required or optional, whose values merge by a monoid.

Keys of all required inputs must match; without any required input, every key of any input stays.  A missing optional
input counts as the monoid's identity.  Each combination of matching rows gives one row, its values merged with the
last input's leftmost and the others in the order they are listed.  ("Last" is by the inputs' numbers read as text, so
input 9 is the last of eleven: the merge order is part of the result for monoids that don't commute.)
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.monoids import Monoid


@dataclass(frozen=True)
class Input:
    """A side of a join: rows with the key columns and a column ``value``.  Rows with a null in a key match nothing;
    they are left out of required and optional inputs alike."""

    rows: DataFrame
    required: bool = True
    value: str = "value"


def required(rows: DataFrame, value: str = "value") -> Input:
    return Input(rows, True, value)


def optional(rows: DataFrame, value: str = "value") -> Input:
    return Input(rows, False, value)


def last_of(count: int) -> int:
    """The input merged leftmost: the greatest number, as text."""
    return max(range(count), key=str)


def monoid_join(inputs: Sequence[Input], keys: Sequence[str] | str, monoid: Monoid, value: str = "value", keep_keys: bool = True) -> DataFrame:
    """Key columns (unless ``keep_keys`` is off) and the merged ``value``.

    A null value that is present is merged as it is; only a missing row becomes the identity.  The same table may be
    given more than once.  Skewed keys are left to adaptive execution, which splits the sides of these joins.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if not inputs:
        raise ValueError("a join needs an input")
    sides = []
    for i, one in enumerate(inputs):
        picked = [F.col(k) for k in keys] + [F.struct(F.col(one.value).alias("v")).alias(f"side_{i}")]
        sides.append(one.rows.dropna(subset=keys).select(*picked))
    needed = [s for s, one in zip(sides, inputs, strict=True) if one.required]
    extra = [s for s, one in zip(sides, inputs, strict=True) if not one.required]
    if needed:
        joined = reduce(lambda a, b: a.join(b, keys, "inner"), needed)
        joined = reduce(lambda a, b: a.join(b, keys, "left"), extra, joined)
    else:
        joined = reduce(lambda a, b: a.join(b, keys, "full_outer"), extra)

    def merged(i: int):
        side = F.col(f"side_{i}")
        return F.when(side.isNull(), monoid.identity()).otherwise(side["v"])

    last = last_of(len(inputs))
    order = [last, *(i for i in range(len(inputs)) if i != last)]
    out = reduce(monoid.merge, [merged(i) for i in order])
    return joined.select(*(keys if keep_keys else []), out.alias(value))


def inner_merge(left: DataFrame, right: DataFrame, keys: Sequence[str] | str, monoid: Monoid, value: str = "value") -> DataFrame:
    """Two-way inner join whose rows are ``left`` merged with ``right``."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    a = left.dropna(subset=keys).select(*keys, F.col(value).alias("left_value"))
    b = right.dropna(subset=keys).select(*keys, F.col(value).alias("right_value"))
    return a.join(b, keys).select(*keys, monoid.merge(F.col("left_value"), F.col("right_value")).alias(value))
