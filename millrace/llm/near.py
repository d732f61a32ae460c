"""Jaccard self-join on word shingles, with Bayesian pruning of candidates.

Texts with equal shingle sets form a class and go on as one.  Classes that agree on a band of MinHash values are
candidates.  A pair's MinHash values are compared a few at a time; with a uniform prior, the posterior of the
similarity after m of n values agree is a beta distribution, and the pair is dropped once the probability that the
similarity reaches the threshold falls below ``tolerance``.  What is left is verified on the whole shingle sets.

Pairs never become rows.  Candidates are compared inside tasks in blocks of bounded size, a large bucket or cluster
being spread over pairs of its blocks.  Tasks give back, for each class, how many links they found, and star edges
that connect what is linked.  A pair is counted once because blocks of one cluster meet once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import NULL_KEY, by_value, chunks, durable, frugal, key_of, spread_join
from millrace.llm.components import components

by_value(__name__)

U = np.uint64


@dataclass(frozen=True)
class Near:
    """``bands`` of ``rows`` MinHash values each: a pair of similarity 0.8 is missed with probability 3e-6."""

    words: int = 5
    threshold: float = 0.8
    bands: int = 24
    rows: int = 4
    step: int = 16
    tolerance: float = 1e-6
    #: Classes in a block of a bucket and of a cluster.
    bucket_block: int = 512
    cluster_block: int = 512
    #: Shingles in a block of a cluster, about; clusters of long texts have blocks of fewer classes.
    block_shingles: int = 1 << 19
    seed: int = 20260101

    @property
    def values(self) -> int:
        return self.bands * self.rows


def scramble(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


BYTE = scramble(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
ROOT, TURN = 0x9E3779B97F4A7C15, U(0xC2B2AE3D27D4EB4F)


class Powers:
    """Rising powers of an odd root modulo 2^64, and of its inverse."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, root in (("up", ROOT), ("down", pow(ROOT, -1, 1 << 64))):
                x = np.full(2 * n, root, U)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


def word_hashes(parts: list[str], powers: Powers) -> np.ndarray:
    data = np.frombuffer(" ".join(parts).encode("utf-8", "surrogatepass"), np.uint8)
    up, down = powers.upto(len(data) + 1)
    sums = np.concatenate([np.zeros(1, U), np.cumsum(BYTE[data] * up[:-1], dtype=U)])
    blank = np.flatnonzero(data == 32)
    starts, ends = np.concatenate([[0], blank + 1]), np.concatenate([blank, [len(data)]])
    return scramble((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def shingles(text: str | None, how: Near, powers: Powers) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles: runs of ``how.words`` words, or all words if fewer.

    Words are cut at white space and compared in lower case.  Long texts are read in parts.
    """
    found = [word_hashes(parts, powers) for part in chunks(text or "") if (parts := part.lower().split())]
    if not found:
        return np.zeros(0, U)
    word = np.concatenate(found) if len(found) > 1 else found[0]
    n = min(how.words, len(word))
    out = []
    for lo in range(0, len(word) - n + 1, 1 << 20):
        total = np.zeros(min(1 << 20, len(word) - n + 1 - lo), U)
        for j in range(n):
            total = total * TURN + word[lo + j : lo + j + len(total)]
        out.append(np.unique(scramble(total + U(n))))
    return np.unique(np.concatenate(out)) if len(out) > 1 else out[0]


def minhash(found: np.ndarray, how: Near) -> np.ndarray:
    """MinHash values of a shingle set, as unsigned 32-bit integers."""
    factors = scramble(np.arange(1, 2 * how.values + 1, dtype=U) * U(ROOT) + U(how.seed))
    a, b = factors[: how.values, None] | U(1), factors[how.values :, None]
    out = np.full(how.values, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(found), 2048):
        out = np.minimum(out, ((found[None, lo : lo + 2048] * a + b) >> U(32)).astype(np.uint32).min(axis=1))
    return out


def fewest(how: Near) -> np.ndarray:
    """For each number of values compared, the fewest that must agree for a pair to go on.

    The posterior that the similarity is t or more, after m of n agree, is the chance that at most m of n + 1 throws
    succeed with probability t.
    """
    out = np.zeros(how.values + 1, np.int64)
    for n in range(1, how.values + 1):
        m, chance = 0, 0.0
        while True:
            chance += math.comb(n + 1, m) * how.threshold**m * (1 - how.threshold) ** (n + 1 - m)
            if chance >= how.tolerance:
                break
            m += 1
        out[n] = m
    return out


def alive(x: np.ndarray, y: np.ndarray, how: Near, least: np.ndarray) -> np.ndarray:
    """Which pairs of MinHash rows survive the pruning, ``step`` values at a time."""
    left = np.arange(len(x))
    agree = np.zeros(len(x), np.int64)
    for at in range(0, how.values, how.step):
        agree = agree + (x[left, at : at + how.step] == y[left, at : at + how.step]).sum(axis=1)
        good = agree >= least[min(at + how.step, how.values)]
        left, agree = left[good], agree[good]
        if not len(left):
            break
    return left


def surviving(sig: np.ndarray, first: int, how: Near, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one block (``first`` equals their number), or of its first rows with the others."""
    n = len(sig)
    one = first == n
    rows, cols = [], []
    for i in range(n if one else first):
        others = np.arange(i + 1 if one else first, n)
        if len(others):
            got = others[alive(np.broadcast_to(sig[i], (len(others), sig.shape[1])), sig[others], how, least)]
            rows.append(np.full(len(got), i))
            cols.append(got)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(cols)


def stars(n: int, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each row."""
    label = np.arange(n)
    while len(rows):
        low = np.minimum(label[rows], label[cols])
        before = label.copy()
        np.minimum.at(label, rows, low)
        np.minimum.at(label, cols, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def shared_counts(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets."""
    if len(rows) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(rows, cols, strict=True)], np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count[code] > 1
    owner, code = owner[often], code[often]
    _, code = np.unique(code, return_inverse=True)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, b = np.searchsorted(code, [lo, lo + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], code[a:b] - lo] = 1
        total += part @ part.T
    return total[rows, cols].astype(np.int64)


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups, in batches sorted by ``keys``; one table may hold many groups."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows, bool)
        for key in keys:
            x = batch.column(key).to_numpy(zero_copy_only=False)
            same &= x == x[-1]
        cut = int(batch.num_rows - np.argmin(same[::-1])) if not same.all() else 0
        if rest and not cut:
            ahead = any(rest[-1].column(k)[0].as_py() != batch.column(k)[0].as_py() for k in keys)
            if ahead:
                yield pa.Table.from_batches(rest)
                rest = []
        elif cut:
            yield pa.Table.from_batches([*rest, batch.slice(0, cut)])
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest)


def signed(docs: DataFrame, how: Near) -> DataFrame:
    """Rows of ``k, h, text`` as ``k, h, a, b, n, sig``: two hashes of the shingle set, its size, MinHash values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        one, two = U(0x165667B19E3779F9), U(0x27D4EB2F165667C5)
        for batch in batches:
            a, b, n, sig = [], [], [], []
            for lo in range(0, batch.num_rows, 512):
                for text in batch.column(2).slice(lo, 512).to_pylist():
                    found = shingles(text, how, powers)
                    a.append(int(np.sum(scramble(found ^ one), dtype=U)))
                    b.append(int(np.sum(scramble(found ^ two), dtype=U)))
                    n.append(len(found))
                    sig.append(minhash(found, how).tobytes() if len(found) else None)
            hashes = [pa.array(np.array(x, U).view(np.int64)) for x in (a, b)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *hashes, pa.array(n, pa.int64()), pa.array(sig, pa.binary())], names=["k", "h", "a", "b", "n", "sig"])

    return docs.select("k", "h", "text").mapInArrow(frugal(run), "k long, h long, a long, b long, n long, sig binary")


def classes(rows: DataFrame) -> DataFrame:
    """Classes of equal shingle sets: ``a, b, node, k, h, copies, sig``, by their smallest member ``k, h``.

    ``node`` is ``k``, or a negative number made of the set's hash if ``k`` is null or also stands for another class,
    which can only be where rows share a key.
    """
    one = rows.filter("n > 0").groupBy("a", "b").agg(F.min(F.struct("k", "h")).alias("least"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"), F.first("n").alias("n"))
    unknown = F.col("least.k") == NULL_KEY
    turn = F.row_number().over(Window.partitionBy("least.k", F.when(unknown, F.col("a"))).orderBy("a", "b"))
    node = F.when((turn == 1) & ~unknown, F.col("least.k")).otherwise(F.lit(-2) - F.shiftrightunsigned("a", 1))
    return one.select("a", "b", node.alias("node"), "least.k", "least.h", "copies", "sig", "n")


def paired(members: DataFrame, group: str, what: str) -> DataFrame:
    """Members of every pair of a group's ``blocks``: ``group, i, j, second`` and the columns in front."""
    dealt = members.withColumn("own", F.pmod(F.xxhash64(what), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    out = dealt.withColumn("other", other)
    return out.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).withColumn("second", F.col("own") > F.col("other")).drop("own", "other", "blocks").repartition(group, "i", "j").sortWithinPartitions(group, "i", "j", "second", what)


def groups_of(table: pa.Table, keys: list[str]) -> np.ndarray:
    """First rows of the groups of a table sorted by keys, and its number of rows."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for key in keys:
        x = table.column(key).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, width)


def candidate_edges(found: DataFrame, how: Near) -> DataFrame:
    """Star edges ``u, v`` that connect the candidates of each bucket that survive the pruning."""
    width = 4 * how.rows
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("sig", 1 + b * width, width)) for b in range(how.bands)])
    banded = found.select("node", F.explode(keys).alias("bucket"))
    blocks = F.ceil(F.count(F.lit(1)) / how.bucket_block).cast("int").alias("blocks")
    sizes = banded.groupBy("bucket").agg(blocks, F.count(F.lit(1)).alias("members")).filter("members > 1").drop("members")
    members = spread_join(banded, sizes, ["bucket"]).join(found.select("node", "sig"), "node")
    least = fewest(how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, ["bucket", "i", "j"]):
            node, sig = table.column("node").to_numpy(), matrix(table.column("sig"), how.values)
            second = table.column("second").to_numpy()
            at = groups_of(table, ["bucket", "i", "j"])
            counts = np.diff(at)
            us, vs = [], []
            two = at[:-1][counts == 2]
            got = two[alive(sig[two], sig[two + 1], how, least)]
            us.append(np.maximum(node[got], node[got + 1]))
            vs.append(np.minimum(node[got], node[got + 1]))
            for lo, n in zip(at[:-1][counts > 2], counts[counts > 2], strict=True):
                own = node[lo : lo + n]
                first = n - int(second[lo : lo + n].sum())
                label = stars(n, *surviving(sig[lo : lo + n], first, how, least))
                moved = np.flatnonzero(label != np.arange(n))
                us.append(own[moved])
                vs.append(own[label[moved]])
            edges = np.unique(np.column_stack([np.concatenate(us), np.concatenate(vs)]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["u", "v"])

    return paired(members, "bucket", "node").mapInArrow(frugal(run), "u long, v long")


def with_sets(texts: DataFrame, members: DataFrame, how: Near) -> DataFrame:
    """Members of clusters with their shingle sets, of rows ``k, h, text``."""
    joined = texts.join(members, ["k", "h"])
    # Rows that share key and text are one.
    joined = joined.select("node", "cluster", "blocks", "sig", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sets = [shingles(t, how, powers).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "cluster", "blocks", "sig")), pa.array(sets, pa.binary())], names=["node", "cluster", "blocks", "sig", "shingles"])

    return joined.mapInArrow(frugal(run), "node long, cluster long, blocks int, sig binary, shingles binary")


def verified(members: DataFrame, how: Near) -> DataFrame:
    """``u, v, links``: links of ``u`` found by a task and, where ``v`` isn't null, an edge between linked classes."""
    least = fewest(how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, ["cluster", "i", "j"]):
            at = groups_of(table, ["cluster", "i", "j"])
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                if hi - lo < 2:
                    continue
                part = table.slice(lo, hi - lo)
                node, second = part.column("node").to_numpy(), part.column("second").to_numpy()
                new = np.concatenate([[True], node[1:] != node[:-1]])  # rows that share key and text are one
                node, second = node[new], second[new]
                sig = matrix(part.column("sig").filter(pa.array(new)), how.values)
                rows, cols = surviving(sig, len(node) - int(second.sum()), how, least)
                if not len(rows):
                    continue
                sets = [np.frombuffer(x, U) for x in part.column("shingles").filter(pa.array(new)).to_pylist()]
                sizes = np.array([len(x) for x in sets])
                both = shared_counts(sets, rows, cols)
                # |A and B| / |A or B| >= t, in integers to be exact at the threshold
                scale = 10**6
                good = both * scale >= round(how.threshold * scale) * (sizes[rows] + sizes[cols] - both)
                rows, cols = rows[good], cols[good]
                if not len(rows):
                    continue
                links = np.bincount(rows, minlength=len(node)) + np.bincount(cols, minlength=len(node))
                label = stars(len(node), rows, cols)
                some = np.flatnonzero(links)
                root = node[label[some]]
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(root, mask=root == node[some]), pa.array(links[some])], names=["u", "v", "links"])

    return paired(members, "cluster", "node").mapInArrow(frugal(run), "u long, v long, links long")


def near_classes(docs: DataFrame, how: Near | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, class_id, rep_id, n_copies, n_links`` for every row of ``docs``; ``k, h`` that tell its text, and
    ``class_k, class_h`` that tell the text which stands for its class.

    ``rep_id``: smallest key among rows of the same shingle set; ``n_copies``: their number; ``n_links``: how many
    other shingle sets are similar to it by ``threshold`` or more; ``class_id``: smallest ``rep_id`` reachable by links.
    Texts without words are in no class with others: no links, and a class of their own.  Null keys come before all
    others; their own ids are null.  Rows that share a key are told apart by their text.
    """
    how = how or Near()
    texts = docs.select(key_of(key).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.col(text).alias("text"))
    rows = durable(signed(texts, how), "near-signed")
    found = durable(classes(rows), "near-classes")
    edges = candidate_edges(found, how)
    clusters = durable(components(edges, "near-edges"), "near-clusters")
    told = durable(found.select("node", "k", "h", "sig", "n").join(clusters, "node").withColumnRenamed("root", "cluster"), "near-members")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / how.cluster_block), F.ceil(F.sum("n") / how.block_shingles)).cast("int").alias("blocks")
    members = spread_join(told.drop("n"), told.groupBy("cluster").agg(blocks), ["cluster"])
    checked = durable(verified(with_sets(texts, members, how), how), "near-links")
    links = checked.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    ends = components(checked.filter("v is not null").select("u", "v"), "near-ends")
    ends = spread_join(ends, found.select(F.col("node").alias("root"), F.col("k").alias("class_k"), F.col("h").alias("class_h")), ["root"]).drop("root")
    about = durable(
        found.select("a", "b", "node", F.col("k").alias("rep"), F.col("h").alias("rep_h"), "copies").join(links, "node", "left").join(ends, "node", "left").drop("node"),
        "near-about",
    )
    whole = spread_join(rows.select("k", "h", "a", "b"), about, ["a", "b"], "left")
    own = lambda c: F.when(c != NULL_KEY, c)
    rep = F.coalesce("rep", "k")
    return whole.select(
        own(F.col("k")).alias(key),
        own(F.coalesce("class_k", rep)).alias("class_id"),
        own(rep).alias("rep_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        "k",
        "h",
        F.coalesce("class_k", rep).alias("class_k"),
        F.coalesce("class_h", "rep_h", "h").alias("class_h"),
    )
