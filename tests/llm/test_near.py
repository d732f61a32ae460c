import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm.components import components
from millrace.llm.near import Near, Powers, alive, fewest, minhash, near_classes, shared_counts, shingles, stars
from millrace.llm.queries import op5_jaccard

SF = "/root/testdata/sf0.001"


def sets_of(text, n=5):
    w = (text or "").lower().split()
    n = min(n, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def brute(rows, threshold=0.8):
    """Class, representative, copies and links of ``(key, text)`` with distinct keys."""
    sets = {i: sets_of(t) for i, t in rows}
    rep, of = {}, {}
    for i in sorted(sets):
        of[i] = rep.setdefault(sets[i], i) if sets[i] else i
    own = sorted({r for r in of.values() if sets[r]})
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    by_shingle = defaultdict(list)
    for r in own:
        for s in sets[r]:
            by_shingle[s].append(r)
    shared = Counter(p for held in by_shingle.values() for p in itertools.combinations(held, 2))
    for (a, b), n in shared.items():
        if n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-12:
            links[a] += 1
            links[b] += 1
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    copies = Counter(of.values())
    return {i: (root(of[i]), of[i], copies[of[i]], links[of[i]]) for i in sets}


def varied(seed, n):
    """Families of texts, each a base with a few words changed."""
    draw = random.Random(seed)
    rows = []
    for family in range(n):
        base = [f"w{draw.randrange(500)}" for _ in range(draw.randrange(3, 120))]
        for _ in range(draw.randrange(1, 9)):
            text = list(base)
            for _ in range(draw.randrange(0, 4)):
                text[draw.randrange(len(text))] = f"x{draw.randrange(9)}"
            rows.append((len(rows), " ".join(text)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("how", [Near(), Near(bucket_block=2, cluster_block=3)])
def test_against_brute_force(documents, how):
    rows = varied(5, 60)
    got = {r["doc_id"]: (r["class_id"], r["rep_id"], r["n_copies"], r["n_links"]) for r in near_classes(documents(rows), how).collect()}
    assert got == brute(rows)


def test_one_large_group(documents):
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join([*base[: i % 150], f"y{i}", *base[i % 150 + 1 :]])) for i in range(700)]
    got = {r["doc_id"]: (r["class_id"], r["rep_id"], r["n_copies"], r["n_links"]) for r in near_classes(documents(rows), Near(cluster_block=64)).collect()}
    assert got == brute(rows)


def test_hot_classes_and_clusters_are_spread(documents):
    """Over a thousand copies of one text, as many texts like it, and keys that are null: one class and one cluster hold
    most of all rows, and no task gets most of a join's."""
    base = [f"w{i}" for i in range(150)]
    alike = [" ".join([*base[: i % 150], f"y{i}", *base[i % 150 + 1 :]]) for i in range(1100)]
    rows = [(i, " ".join(base)) for i in range(1500)] + [(5000 + i, t) for i, t in enumerate(alike)] + [(None, " ".join(base))] * 1200
    got = near_classes(documents(rows)).groupBy("class_id", "n_copies", "n_links").count().collect()
    assert sorted(tuple(r) for r in got if r["n_copies"] > 1) == [(None, 2700, 1100, 2700)]
    assert sum(r["count"] for r in got) == len(rows) and all(r["class_id"] is None for r in got)


def test_odd_rows(documents, odd_rows):
    got = sorted((tuple(r)[:5] for r in near_classes(documents(odd_rows)).collect()), key=str)
    assert len(got) == len(odd_rows)
    assert Counter(r[0] for r in got) == Counter(i for i, _ in odd_rows)
    by = defaultdict(list)
    for r in got:
        by[r[0]].append(r[1:])
    assert by[1] == [(1, 1, 1, 0)] and by[2] == [(2, 2, 1, 0)]  # no words: no class with others
    assert by[6] == [(6, 6, 2, 0)] * 2
    assert by[4][0][3] == by[5][0][3] == 1 and by[5][0][0] == 4
    assert near_classes(documents([])).count() == 0


def test_query_on_the_tables(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["class_id"], r["rep_id"], r["n_copies"], r["n_links"]) for r in op5_jaccard(spark, SF).collect()}
    assert got == brute(rows)


def test_pruning_follows_the_posterior():
    how = Near(tolerance=1e-3)
    least = fewest(how)
    # The posterior by numeric integration of t^m (1 - t)^(n - m).
    grid = (np.arange(200_000) + 0.5) / 200_000
    for n in (16, 48, 96):
        for m in (least[n] - 1, least[n]):
            density = grid**m * (1 - grid) ** (n - m)
            tail = density[grid >= how.threshold].sum() / density.sum()
            assert (tail >= how.tolerance) == (m >= least[n])
    same = np.zeros((1, how.values), np.uint32)
    assert len(alive(same, same, how, least)) == 1 and len(alive(same, same + 1, how, least)) == 0


def test_minhash_estimates_similarity():
    how, powers = Near(bands=64, rows=4), Powers()
    a = [f"w{i}" for i in range(400)]
    x, y = shingles(" ".join(a), how, powers), shingles(" ".join(a[:300] + ["z"] * 100), how, powers)
    exact = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs((minhash(x, how) == minhash(y, how)).mean() - exact) < 4 * math.sqrt(exact * (1 - exact) / how.values)


def test_shingles_are_those_of_words():
    how, powers = Near(), Powers()
    texts = ["", "a", "A  a\ta", "a b c d e", "a b c d e f", "ab c d e f", "a bc d e f", "e d c b a", "a a a a a a a"]
    for s, t in itertools.product(texts, texts):
        x, y = shingles(s, how, powers), shingles(t, how, powers)
        assert len(x) == len(sets_of(s)) and len(np.intersect1d(x, y)) == len(sets_of(s) & sets_of(t))


def test_dense_and_sparse_intersections_agree():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 30)).astype(np.uint64) for _ in range(20)]
    rows, cols = np.triu_indices(20, 1)
    assert shared_counts(sets, rows, cols).tolist() == [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(rows, cols, strict=True)]
    assert stars(5, np.array([4, 2]), np.array([2, 1])).tolist() == [0, 1, 1, 3, 1]


def test_components_of_paths_stars_and_random_edges(spark):
    draw = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(1000, 1000 + i) for i in range(1, 300)] + [(2000 + draw.randrange(200), 2000 + draw.randrange(200)) for _ in range(150)] + [(5, 5), (1, 0)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            x, y = sorted((root(u), root(v)))
            parent[y] = x
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long"), "test-edges").collect()}
    assert got == {n: root(n) for n in parent}
    assert components(spark.createDataFrame([], "u long, v long"), "test-edges").count() == 0
