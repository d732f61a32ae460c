"""Variable-capacity best-fit packing of texts into training sequences.

Several sequence lengths are permitted, each with a cost.  Pieces are taken longest first.  To open a bin, every
permitted length that holds the longest piece left is tried: it is filled by best fit, always with the longest piece
left that still fits, and the length of least cost per token so held is opened.  At the end each bin is cut down to
the cheapest permitted length that holds its contents.

Texts longer than the longest permitted length are cut into pieces first.  Pieces are dealt to shards at random, whose
number grows with the pieces, and every shard is packed by itself: a shard leaves at most its last bins poorly filled.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import by_value, durable

by_value(__name__)


@dataclass(frozen=True)
class Capacities:
    """Permitted sequence lengths; one of length L costs ``base + L + L * L / square`` (attention is quadratic)."""

    lengths: tuple[int, ...] = (1024, 2048, 4096, 8192)
    base: float = 16.0
    square: float = 262_144.0
    #: Pieces in a shard, about.
    shard_pieces: int = 20_000
    #: Tasks that pack, at most; each packs one shard after another.
    most_tasks: int = 20_000

    def __post_init__(self) -> None:
        if not self.lengths or min(self.lengths) < 1:
            raise ValueError("lengths must be positive, and there must be one")

    def cost(self, length: int) -> float:
        return self.base + length + length * length / self.square

    def downsized(self, held: int) -> int:
        return min((n for n in self.lengths if n >= held), key=self.cost)


class Left:
    """Pieces not yet packed, by length."""

    def __init__(self, lengths: list[int]) -> None:
        self.pieces: dict[int, list[int]] = {}
        for piece in sorted(range(len(lengths)), key=lambda p: (-lengths[p], -p)):
            self.pieces.setdefault(lengths[piece], []).append(piece)
        self.sizes = sorted(self.pieces)

    def filling(self, room: int) -> list[tuple[int, int]]:
        """Best fit of one bin: lengths and how many pieces of each, longest first."""
        out = []
        at = bisect_right(self.sizes, room)
        while at and room:
            size = self.sizes[at - 1]
            n = min(len(self.pieces[size]), room // size)
            out.append((size, n))
            room -= size * n
            at = bisect_right(self.sizes, room, 0, at - 1)
        return out

    def take(self, size: int, n: int) -> list[int]:
        have = self.pieces[size]
        out = [have.pop() for _ in range(n)]
        if not have:
            del self.pieces[size]
            self.sizes.pop(bisect_right(self.sizes, size) - 1)
        return out


def pack(lengths: list[int], how: Capacities) -> list[tuple[int, list[int]]]:
    """Bins, each its permitted length and its pieces; every length is from 1 to the longest permitted one."""
    left, out = Left(lengths), []
    while left.sizes:
        best = None
        for capacity in how.lengths:
            if capacity < left.sizes[-1]:
                continue
            plan = left.filling(capacity)
            held = sum(size * n for size, n in plan)
            rate = how.cost(how.downsized(held)) / held
            if best is None or rate < best[0]:
                best = rate, held, plan
        _, held, plan = best
        out.append((how.downsized(held), [p for size, n in plan for p in left.take(size, n)]))
    return out


def words_and_end(text: Column) -> Column:
    """Tokens of a text under white-space tokens: its words and one end mark, so empty and null texts have one."""
    return (F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")) + 1).cast("int")


def bytes_and_end(text: Column) -> Column:
    """Tokens of a text under byte tokens: its UTF-8 bytes and one end mark, so empty and null texts have one."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("int")


def pieces(docs: DataFrame, length: Column, how: Capacities, key: str = "doc_id") -> DataFrame:
    """``key, piece, start, tokens``: texts cut into pieces of at most the longest permitted length."""
    longest = max(how.lengths)
    sized = docs.select(F.col(key), length.cast("long").alias("all_tokens")).filter("all_tokens > 0")
    cut = sized.select(key, "all_tokens", F.explode(F.sequence(F.lit(0), ((F.col("all_tokens") - 1) / longest).cast("int"))).alias("piece"))
    start = F.col("piece").cast("long") * longest
    return cut.select(key, "piece", start.alias("start"), F.least(F.lit(longest), F.col("all_tokens") - start).cast("int").alias("tokens"))


def assign(docs: DataFrame, length: Column, how: Capacities | None = None, key: str = "doc_id") -> DataFrame:
    """Where each piece goes: ``key, piece, start, tokens, bin, capacity, offset`` (from the bin's beginning).

    Every text is in whole: its pieces cover it without overlap.  ``length`` is a text's number of tokens; rows with
    null or none have no piece.  Rows that share a key, and null keys, are packed like all others.  Bins are named by
    shard and number, and their names are unique.

    Pieces are written with a number of their own, by which they are dealt: no key, however many rows it has, puts
    more in one shard than in others.
    """
    how = how or Capacities()
    cut = durable(pieces(docs, length, how, key).withColumn("row", F.monotonically_increasing_id()), "packing-pieces")
    kind = docs.schema[key].dataType.simpleString()
    total = cut.count()
    shards = max(1, -(-total // how.shard_pieces))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")).repartition(min(shards, how.most_tasks), "shard")

    def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, "piece", "tokens"], kind="stable", ignore_index=True)
        bins = pack(pdf["tokens"].tolist(), how)
        where = [(p, f"{keys[0]}-{number}", capacity) for number, (capacity, held) in enumerate(bins) for p in held]
        order, names, capacities = (list(x) for x in zip(*where, strict=True))
        out = pdf.iloc[order].reset_index(drop=True)
        out["bin"], out["capacity"] = names, capacities
        out["offset"] = out.groupby("bin", sort=False)["tokens"].cumsum() - out["tokens"]
        return out[[key, "piece", "start", "tokens", "bin", "capacity", "offset"]]

    return dealt.groupBy("shard").applyInPandas(run, f"`{key}` {kind}, piece int, start long, tokens int, bin string, capacity int, offset long")


def bins(assigned: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per bin: ``bin, capacity, tokens, segments``, the pieces in their order with key, piece, start, tokens."""
    segment = F.struct("offset", key, "piece", "start", "tokens")
    return assigned.groupBy("bin", "capacity").agg(F.sum("tokens").alias("tokens"), F.sort_array(F.collect_list(segment)).alias("segments"))
