"""Removal of repeated byte strings by prefix-free parsing and suffix arrays.

Triggers and phrases.  A rolling hash is taken of every ``gram`` bytes.  A string of ``length`` bytes is owned by its
gram of smallest hash, the last one among equals; a gram that owns any string is a trigger.  Which trigger owns a
string, and where in the string it stands, depends on the string's bytes alone.  Strings owned by one trigger start at
neighbouring bytes; together they are a phrase, which overlaps the next phrase by ``length - 1`` bytes.  So phrases
cover all strings once, and any string of ``length`` bytes has a trigger, however repetitive or long the text.

Dictionary and parse.  Phrases are brought together by trigger.  Among equal phrases, the first in corpus order (key,
then start) stays and the others repeat it whole: that is the parse, and it settles all but the edges of repeats.
What remains is a dictionary: distinct phrases that share a trigger with other distinct phrases.  A suffix array of
the dictionary is made by prefix doubling up to ``length`` bytes; suffixes that agree on ``length`` bytes stand next
to each other, and where their phrases first stand in the parse puts them in corpus order.

Within a Python task equal phrases are merged before they are shuffled, so a passage that any share of all texts
holds reaches its trigger's task once for each task.  Triggers with very many distinct phrases are spread out by
their strings.  The most frequent are known beforehand, from a sample of texts, and dealt by phrase at once, so that a
line that any share of all texts holds in different surroundings doesn't bring them together in one task; the sample
decides where phrases are compared, not what comes of it.  Phrases are equal if two hashes, 128 bits together, are;
strings are compared by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import NULL_KEY, by_value, durable, frugal, hot_slots, key_of, slices, spread_join, utf8

by_value(__name__)

U = np.uint64
ROOT = U(0x9E3779B97F4A7C15)
PLACE_BITS = U(24)
SHIFT = 12


@dataclass(frozen=True)
class Parsing:
    """``length``: of the strings that may not repeat.  ``gram``: bytes of a trigger.  ``piece``: bytes parsed at once."""

    length: int = 100
    gram: int = 24
    piece: int = 1 << 19
    #: Phrases a task holds before it merges equal ones and passes them on.
    held: int = 250_000
    #: Distinct phrases of one trigger beyond which its strings are spread out.
    spread: int = 2048
    #: Texts in the sample that tells hot triggers, about; and those that are dealt by phrase, at most.
    sample: int = 10_000
    most_hot: int = 65_536

    def __post_init__(self) -> None:
        if not 1 < self.gram < self.length or self.length - self.gram >= 1 << SHIFT:
            raise ValueError("a trigger must be shorter than a string, by less than 4096 bytes")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that leaves no pattern."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every ``gram`` consecutive bytes, built up from those of powers of two."""
    power, n, at = data.astype(U) + U(1), 1, 0
    made = len(data) - gram + 1
    out = np.zeros(made, U)
    while True:
        root = U(pow(int(ROOT), n, 1 << 64))
        if gram & n:
            out = out * root + power[at : at + made]
            at += n
        if n * 2 > gram:
            return mixed(out)
        power = power[:-n] * root + power[n:]
        n *= 2


def window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` consecutive values."""
    n, out = 1, x
    while n * 2 <= width:
        out = np.minimum(out[:-n], out[n:])
        n *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - n :][: len(x) - width + 1])


def phrases(data: np.ndarray, offsets: np.ndarray, how: Parsing) -> tuple[np.ndarray, ...]:
    """Phrases of texts laid end to end: text's number, first start, number of starts, and two 64-bit hashes: of the
    trigger and of the phrase."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U, U))
    if len(data) < how.length:
        return none
    hashes = gram_hashes(data, how.gram)
    width = how.length - how.gram + 1
    places = np.arange(len(hashes), dtype=U)
    high = (hashes >> PLACE_BITS) << PLACE_BITS
    owner = window_min(high | (U((1 << 24) - 1) - (places & U((1 << 24) - 1))), width)
    owner = (U((1 << 24) - 1) - (owner & U((1 << 24) - 1))).astype(np.int64)
    starts = np.arange(len(owner))
    text = np.searchsorted(offsets, starts, "right") - 1
    good = starts + how.length <= offsets[text + 1]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (text[1:] != text[:-1]) | (good[1:] != good[:-1])
    begin = np.flatnonzero(first)
    count = np.diff(np.append(begin, len(owner)))
    begin, count = begin[good[begin]], count[good[begin]]
    if not len(begin):
        return none
    # A phrase's hash: its grams' hashes, summed with rising powers of an odd root that are divided out again.
    powers = np.empty(len(hashes) + 1, U)
    powers[0], powers[1:] = U(1), ROOT
    np.multiply.accumulate(powers, out=powers)
    inverse = np.empty(len(hashes) + 1, U)
    inverse[0], inverse[1:] = U(1), U(pow(int(ROOT), -1, 1 << 64))
    np.multiply.accumulate(inverse, out=inverse)
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mixed(hashes + ROOT) * powers[:-1], dtype=U)])
    whole = (sums[begin + count + width - 1] - sums[begin]) * inverse[begin]
    trigger = owner[begin]
    return text[begin], begin - offsets[text[begin]], count, hashes[trigger], mixed(whole + count.astype(U))


def own_order(k: np.ndarray, h: np.ndarray) -> np.ndarray:
    """What orders rows of equal key: rows without a key come by their texts' hashes, others are one place."""
    return np.where(k == NULL_KEY, h, 0)


def hot_triggers(texts: DataFrame, how: Parsing) -> np.ndarray:
    """Triggers that have more than ``how.spread`` distinct phrases in all texts, as far as a sample can tell."""
    share = min(1.0, how.sample / max(1, texts.count()))
    some = texts.filter(F.pmod(F.xxhash64("k", "h", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    counts = parse(some, how).filter(F.size("later") == 0).select("trigger", "phrase").distinct().groupBy("trigger").count()
    found = counts.filter(F.col("count") >= max(16, int(how.spread * share))).orderBy(F.col("count").desc(), "trigger").limit(how.most_hot)
    return np.array(sorted(r["trigger"] for r in found.collect()), np.int64)


def parse(docs: DataFrame, how: Parsing, hot: np.ndarray | None = None) -> DataFrame:
    """Phrases of rows of ``k, h, text`` (key, what tells apart rows of equal key, text), equal ones of a task merged.

    ``trigger, phrase``: their hashes; ``k, h, spot``: the first of them.  Rows with a list ``later`` instead carry those
    that repeat another of their task; their trigger is no phrase's.  A ``trigger`` is even; for those in ``hot`` an odd
    number of each phrase's own stands instead.  A ``spot`` is the
    phrase's start, shifted by ``SHIFT`` bits, and its number of starts: rows of few columns shuffle in fewer bytes.
    """
    schema = "trigger long, phrase long, k long, h long, spot long, later array<struct<k:long,h:long,spot:long>>"

    def merged(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        k, h, spot, trigger, phrase = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((spot, own_order(k, h), k, phrase, trigger))
        k, h, spot, trigger, phrase = (x[order] for x in (k, h, spot, trigger, phrase))
        first = np.ones(len(k), bool)
        first[1:] = (trigger[1:] != trigger[:-1]) | (phrase[1:] != phrase[:-1])
        head = np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))
        own = own_order(k, h)
        first |= (k == k[head]) & (own == own[head]) & (spot == spot[head])  # rows that share a key don't come after each other
        heads, rest = np.flatnonzero(first), np.flatnonzero(~first)
        # What repeats within the task is settled: it goes along in rows of up to 64, with a trigger of their own, so
        # that all the copies of a passage don't meet in one task.
        cuts = np.arange(0, len(rest), 64)
        carried = rest[cuts]
        carrier = mixed(mixed(k[carried].view(U)) + spot[carried].view(U))
        ends = np.concatenate([np.zeros(len(heads), np.int32), cuts, [len(rest)]]).astype(np.int32)
        later = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(x[rest]) for x in (k, h, spot)], ["k", "h", "spot"]))
        rows = np.concatenate([heads, carried])
        trigger, phrase = np.concatenate([trigger[heads], carrier]), np.concatenate([phrase[heads], np.zeros(len(cuts), U)])
        trigger &= ~U(1)
        if hot is not None and len(hot):
            own_route = np.isin(trigger.view(np.int64), hot) & (np.arange(len(trigger)) < len(heads))
            trigger[own_route] = mixed(trigger[own_route] ^ mixed(phrase[own_route])) | U(1)
        columns = [pa.array(trigger.view(np.int64)), pa.array(phrase.view(np.int64)), *(pa.array(x[rows]) for x in (k, h, spot))]
        return pa.RecordBatch.from_arrays([*columns, later], names=["trigger", "phrase", "k", "h", "spot", "later"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        held = 0
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            k, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, hi in slices(offsets, how.piece):
                # A text of more than a piece is parsed in parts that overlap by one byte less than a string.
                for at in range(int(offsets[lo]), int(offsets[hi]), how.piece) if hi == lo + 1 else [int(offsets[lo])]:
                    end = min(int(offsets[hi]), at + how.piece + how.length - 1) if hi == lo + 1 else int(offsets[hi])
                    inner = np.clip(offsets[lo : hi + 1] - at, 0, end - at)
                    text, start, count, trigger, phrase = phrases(data[at:end], inner, how)
                    shift = at - int(offsets[lo]) if hi == lo + 1 else 0
                    found.append((k[lo + text], h[lo + text], (start + shift) << SHIFT | count, trigger, phrase))
                    held += len(text)
                    if held > how.held:
                        yield merged(found)
                        found, held = [], 0
        if held:
            yield merged(found)

    return docs.select("k", "h", "text").mapInArrow(frugal(run), schema)


def settle(parsed: DataFrame, how: Parsing) -> DataFrame:
    """The parse: of each phrase, whether it repeats an earlier one whole (``open`` 0) or is a dictionary phrase whose
    strings must be compared (1; 2 where its trigger has very many phrases).  All others can't repeat and are gone."""
    same = Window.partitionBy("trigger", "phrase")
    own = F.when(F.col("k") == NULL_KEY, F.col("h")).otherwise(F.lit(0).cast("long")).alias("own")  # as own_order
    place = F.struct("k", own, "spot")
    one = parsed.repartition("trigger").withColumn("first", F.min(place).over(same)).withColumn("head", F.row_number().over(same.orderBy("k", own, "spot", "h")) == 1)
    one = one.withColumn("distinct", F.sum(F.col("head").cast("int")).over(Window.partitionBy("trigger")))
    hot = F.col("trigger").bitwiseAND(F.lit(1).cast("long")) == 1
    state = F.when(place > F.col("first"), 0).when(hot | (F.col("distinct") > how.spread), 2).when(F.col("distinct") > 1, 1)
    return one.select("trigger", "k", "h", "spot", "later", state.alias("open")).filter(F.col("open").isNotNull() | (F.size("later") > 0))


def start_of(spot: Column) -> Column:
    return F.shiftright(spot, SHIFT).alias("start")


def count_of(spot: Column) -> Column:
    return spot.bitwiseAND((1 << SHIFT) - 1).cast("int").alias("count")


def packed(texts: DataFrame) -> DataFrame:
    """Rows of ``k, h, text`` and any other columns, with ``data`` for the text: compressed, to shuffle fewer bytes."""
    others = [f for f in texts.schema if f.name != "text"]
    names = [f.name for f in others]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in others) + ", data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            view = memoryview(data)
            for lo, hi in slices(offsets, 2 << 20):
                small = [coder.compress(view[offsets[i] : offsets[i + 1]]) for i in range(lo, hi)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in names), pa.array(small, pa.binary())], names=[*names, "data"])

    return texts.mapInArrow(frugal(run), schema)


STRINGS = "route long, k long, h long, start long, count int, bytes binary, single boolean"


def cut_out(texts: DataFrame, how: Parsing) -> DataFrame:
    """Bytes of dictionary phrases, from rows of ``k, h, data, open`` (a text, compressed, and the list of its phrases).

    Phrases of very wide triggers are cut into their strings, merged within the task; ``bytes`` is null for what is
    known to repeat already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[int, int, int]] = {}

        coder = zstandard.ZstdDecompressor()
        for batch in batches:
            k, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            order = own_order(k, h)
            phrase = batch.column(3).flatten()
            ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False))])
            spot, trigger, wide = (phrase.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            start, count = spot >> SHIFT, spot & ((1 << SHIFT) - 1)
            rows: list[tuple[int, int, int, int, int, bytes | None, bool]] = []
            for i in range(batch.num_rows):
                own = coder.decompress(batch.column(2)[i].as_py())
                for j in range(ends[i], ends[i + 1]):
                    at = int(start[j])
                    if wide[j] != 2:
                        rows.append((int(trigger[j]), int(k[i]), int(h[i]), at, int(count[j]), own[at : at + count[j] + how.length - 1], False))
                        continue
                    for a in range(at, at + int(count[j])):
                        string = own[a : a + how.length]
                        before, here = seen.get(string), (int(k[i]), int(order[i]), a)
                        if before is None or before >= here:
                            if len(seen) < 200_000:
                                seen[string] = here
                            rows.append((int.from_bytes(hashlib.blake2b(string, digest_size=8).digest(), "big", signed=True), int(k[i]), int(h[i]), a, 1, string, True))
                        else:
                            rows.append((int(k[i]), int(k[i]), int(h[i]), a, 1, None, True))
                if len(rows) > 20_000 or rows and i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()), strict=True)], names=["route", "k", "h", "start", "count", "bytes", "single"])
                    rows = []

    return texts.select("k", "h", "data", "open").mapInArrow(frugal(run), STRINGS)


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Ranks of all suffixes by their first ``length`` bytes, equal for equal ones, by prefix doubling.

    A suffix that is shorter is compared as if zero bytes followed.
    """
    padded = np.concatenate([data, np.zeros(length, np.uint8)])
    first = min(8, length)
    value = np.zeros(len(padded), U)
    for i in range(first):
        value[: len(padded) - i] |= padded[i:].astype(U) << U(8 * (7 - i))
    rank, done = np.unique(value, return_inverse=True)[1], first
    while done < length:
        # The next bytes overlap those known where fewer than as many again are wanted.
        step = min(done, length - done)
        after = np.zeros(len(rank), np.int64)
        after[: len(rank) - step] = rank[step:]
        rank = np.unique(rank * np.int64(len(rank)) + after, return_inverse=True)[1]
        done += step
    return rank[: len(data)]


def compare(k: np.ndarray, start: np.ndarray, count: np.ndarray, data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of dictionary phrases laid end to end: the phrase and start within it of each string that an earlier one equals.

    ``k`` and ``start`` tell where each phrase first stands in the parse.
    """
    order = np.lexsort((start, k))
    owner = np.repeat(order, count[order])
    ends = np.cumsum(count[order])
    inner = np.arange(len(owner)) - np.repeat(ends - count[order], count[order])
    return repeated(suffix_ranks(data, length)[offsets[owner] + inner], owner, inner, k, start)


def repeated(rank: np.ndarray, owner: np.ndarray, inner: np.ndarray, k: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of strings in corpus order, by their ``rank``: owner and start of those that an earlier one equals."""
    array = np.argsort(rank, kind="stable")
    rank, owner, inner = rank[array], owner[array], inner[array]
    new = np.ones(len(owner), bool)
    new[1:] = rank[1:] != rank[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(owner)), 0))
    at = start[owner] + inner
    later = (k[owner] != k[owner[head]]) | (at != at[head])
    return owner[later], inner[later]


def compare_single(k: np.ndarray, start: np.ndarray, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``compare`` for phrases of one string each, which are just held against each other."""
    order = np.lexsort((start, k))
    rank = strings.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return repeated(rank[order], order, np.zeros(len(order), np.int64), k, start)


def dictionary(strings: DataFrame, how: Parsing) -> DataFrame:
    """Spans ``k, h, start, count`` of strings that repeat earlier ones of the dictionary; rows are brought together
    by route and sorted by it, and each route's rows are read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(x: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            known = x.filter(pa.compute.is_null(x.column("bytes")))
            if known.num_rows:
                yield known.select(["k", "h", "start", "count"])
            x = x.filter(pa.compute.is_valid(x.column("bytes")))
            for single in (False, True):
                part = x.filter(pa.compute.equal(x.column("single"), single))
                if part.num_rows > 1:
                    yield from spans(part, single)

        def spans(x: pa.RecordBatch, single: bool) -> Iterator[pa.RecordBatch]:
            route, k, h, start, count = (x.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            data, offsets = utf8(x.column("bytes"))
            # Corpus order of the rows.
            own = own_order(k, h)
            order = np.lexsort((own, k))
            rank = np.zeros(len(k), np.int64)
            rank[order[1:]] = np.cumsum((k[order[1:]] != k[order[:-1]]) | (own[order[1:]] != own[order[:-1]]))
            # About 300,000 bytes at once, in whole routes; single strings are few bytes each to compare.
            turn = np.flatnonzero(np.concatenate([[True], route[1:] != route[:-1]]))
            sums = np.concatenate([[0], np.cumsum(count if single else count + how.length - 1)])
            part = sums[turn] // 300_000
            cuts = [*turn[np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))], len(route)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi - lo < 2:
                    continue
                if single:
                    owner, inner = compare_single(rank[lo:hi], start[lo:hi], x.column("bytes").slice(lo, hi - lo))
                else:
                    owner, inner = compare(rank[lo:hi], start[lo:hi], count[lo:hi], data[offsets[lo] : offsets[hi]], offsets[lo:hi] - offsets[lo], how.length)
                if not len(owner):
                    continue
                owner, at = owner + lo, start[owner + lo] + inner
                order = np.lexsort((at, owner))
                owner, at = owner[order], at[order]
                begin = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)]))
                runs = np.diff(np.append(begin, len(at)))
                yield pa.RecordBatch.from_arrays([pa.array(k[owner[begin]]), pa.array(h[owner[begin]]), pa.array(at[begin]), pa.array(runs.astype(np.int32))], names=["k", "h", "start", "count"])

        rest: list[pa.RecordBatch] = []
        for batch in batches:
            route = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(route):
                continue
            rest_route = rest[-1].column(0)[0].as_py() if rest else None
            cut = int(np.searchsorted(route, route[-1], "left"))
            if cut or rest_route is not None and rest_route != route[-1]:
                done = [*rest, batch.slice(0, cut)]
                yield from found(pa.Table.from_batches(done).combine_chunks().to_batches()[0])
                rest = []
            rest.append(batch.slice(cut))
        if rest:
            yield from found(pa.Table.from_batches(rest).combine_chunks().to_batches()[0])

    return strings.repartition("route").sortWithinPartitions("route").mapInArrow(frugal(run), "k long, h long, start long, count int")


def repeats(texts: DataFrame, small: DataFrame, how: Parsing) -> DataFrame:
    """For rows of distinct ``k, h`` and ``text`` (``small``: the same, ``packed``): ``k, h, runs``, the starts of
    repeated strings as runs, each its start and count."""
    settled = durable(settle(parse(texts, how, hot_triggers(texts, how)), how), "phrases")
    whole = settled.filter(F.col("open") == 0).select("k", "h", start_of(F.col("spot")), count_of(F.col("spot")))
    merged = settled.filter(F.size("later") > 0).select(F.explode("later").alias("x")).select("x.k", "x.h", start_of(F.col("x.spot")), count_of(F.col("x.spot")))
    wanted = settled.filter(F.col("open") > 0).groupBy("k", "h").agg(F.collect_list(F.struct("spot", "trigger", "open")).alias("open"))
    strings = cut_out(small.join(wanted, ["k", "h"]), how)
    spans = whole.unionByName(merged).unionByName(dictionary(strings, how))
    return spans.groupBy("k", "h").agg(F.collect_list(F.struct("start", "count")).alias("runs"))


def remove_repeats(docs: DataFrame, how: Parsing | None = None, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``docs`` with ``n_bytes``, ``kept binary`` and ``removed``, a list of ``start, length`` in bytes.

    A byte goes if a string of ``how.length`` bytes over it also starts earlier: under a smaller key, or earlier under
    the same key.  A null key is smaller than all others, and rows without a key come in the order of a hash of their
    texts; rows that share a key, or have no key and equal texts, are one place, and don't repeat each other where they
    start alike.  Null texts count as empty.  ``keep`` names columns to carry along.
    """
    how = how or Parsing()
    # Only where rows share a key need a hash of the text tell them apart; elsewhere it would be shuffled for nothing.
    shared = docs.groupBy(key_of(key)).count().filter("count > 1").limit(1).count()
    apart = F.xxhash64(F.coalesce(F.col(text), F.lit(""))) if shared else F.lit(0).cast("long")
    rows = docs.select(key_of(key).alias("k"), apart.alias("h"), F.col(text).alias("text"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)])
    texts, hot = rows.select("k", "h", "text"), []
    if shared:
        # Rows that share key and text are one place, however many; they are parsed once, and get its runs back.
        hot = hot_slots(texts, ["k", "h"], 1000)
        texts = durable(texts.groupBy("k", "h").agg(F.min("text").alias("text")), "distinct-texts")
    found = spread_join(packed(rows), repeats(texts, packed(texts), how), ["k", "h"], "left", hot=hot)
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]
    names = [f"keep_{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdDecompressor()
        for batch in batches:
            runs = batch.column("runs")
            flat = runs.flatten()
            start, count = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            ends = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(runs), 0).to_numpy(zero_copy_only=False))])
            for a in range(0, batch.num_rows, 256):
                b = min(a + 256, batch.num_rows)
                kept, removed, sizes = [], [], []
                for i in range(a, b):
                    own = np.frombuffer(coder.decompress(batch.column("data")[i].as_py()), np.uint8)
                    sizes.append(len(own))
                    lo, hi = ends[i], ends[i + 1]
                    if lo == hi:
                        kept.append(own.tobytes())
                        removed.append([])
                        continue
                    edge = np.zeros(len(own) + 1, np.int32)
                    np.add.at(edge, start[lo:hi], 1)
                    np.add.at(edge, start[lo:hi] + count[lo:hi] + (how.length - 1), -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    kept.append(own[~gone].tobytes())
                    turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    removed.append([{"start": int(x), "length": int(y - x)} for x, y in zip(turns[::2], turns[1::2], strict=True)])
                part = batch.slice(a, b - a)
                spans = pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))
                yield pa.RecordBatch.from_arrays([part.column("k"), *(part.column(c) for c in names), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), spans], names=["k", *names, "n_bytes", "kept", "removed"])

    schema = ", ".join(["k long", *(f"{n} {t}" for n, t in zip(names, kinds, strict=True)), "n_bytes long", "kept binary", "removed array<struct<start:long,length:long>>"])
    out = found.select("k", *names, "data", "runs").mapInArrow(frugal(run), schema)
    own = F.when(F.col("k") != NULL_KEY, F.col("k")).alias(key)
    return out.select(own, *[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "n_bytes", "kept", "removed")


def readable(df: DataFrame, data: str, text: str) -> DataFrame:
    """``df`` with ``text`` read from the UTF-8 in ``data``, without the remains of characters cut in two."""
    keep = [f for f in df.schema if f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), f"`{text}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [None if b is None else b.decode("utf-8", "ignore") for b in batch.column(data).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(read, pa.string())], names=[*(f.name for f in keep), text])

    return df.mapInArrow(frugal(run), schema)


def digests(docs: DataFrame, how: Parsing | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs``; see ``remove_repeats``."""
    done = remove_repeats(docs, how, key, text)
    lost = F.aggregate("removed", F.lit(0).cast("long"), lambda total, s: total + s["length"])
    return done.select(key, "n_bytes", lost.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
