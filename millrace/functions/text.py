"""Text functions of stages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = "[ \t\n\r\f]+"


def words(text: Column) -> Column:
    """Words of a text, cut at runs of blanks and line ends."""
    return F.array_remove(F.split(text, BLANKS), "")


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def prefix(value: Column, n: int, unit: str = "chars") -> Column:
    """The first ``n`` characters; with ``unit`` bytes, the first ``n`` bytes of its UTF-8, as binary."""
    if unit == "bytes":
        return F.substring(F.encode(value, "utf-8"), 1, n)
    return F.substring(value, 1, n)
