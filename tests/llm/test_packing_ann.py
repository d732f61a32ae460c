import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm.ann import AnnSettings, Frame, cheapest, directions, fit_index, k_means, search
from millrace.llm.packing import Capacities, assign, bins, bytes_and_end, pack, words_and_end
from millrace.llm.queries import op8_packing, op9_ivf_pq

SF = "/root/testdata/sf0.001"


def greedy(lengths, how):
    """The packing by its definition, searching all pieces each time."""
    left, out = sorted(lengths, reverse=True), []
    while left:
        best = None
        for capacity in how.lengths:
            if capacity < left[0]:
                continue
            rest, room, held = list(left), capacity, []
            while True:
                fits = [x for x in rest if x <= room]
                if not fits:
                    break
                held.append(max(fits))
                rest.remove(held[-1])
                room -= held[-1]
            rate = how.cost(how.downsized(sum(held))) / sum(held)
            if best is None or rate < best[0]:
                best = rate, held, rest
        out.append((how.downsized(sum(best[1])), sorted(best[1])))
        left = best[2]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_packing_against_its_definition(seed):
    draw = random.Random(seed)
    how = Capacities((16, 50, 64), base=draw.choice([0.0, 5.0]), square=300.0)
    lengths = [draw.randrange(1, 65) for _ in range(120)]
    got = pack(lengths, how)
    assert [(c, sorted(lengths[p] for p in held)) for c, held in got] == greedy(lengths, how)
    assert sorted(p for _, held in got for p in held) == list(range(120))
    assert pack([], how) == []
    with pytest.raises(ValueError):
        Capacities(())


def whole(rows, texts, longest):
    places, spans = defaultdict(list), defaultdict(list)
    for r in rows:
        places[r["bin"]].append((r["offset"], r["tokens"], r["capacity"]))
        spans[r["doc_id"]].append((r["start"], r["tokens"]))
    for held in places.values():
        at = 0
        for offset, tokens, capacity in sorted(held):
            assert offset == at
            at += tokens
        assert at <= held[0][2] and len({c for _, _, c in held}) == 1
    for key, n in texts.items():
        at = 0
        for start, tokens in sorted(spans[key]):
            assert start == at and 0 < tokens <= longest
            at += tokens
        assert at == n
    assert set(spans) == set(texts)


def test_assignment_covers_every_text(documents):
    rows = [(i, "x" * (i * 37 % 5000)) for i in range(200)] + [(999, "y" * 70_001), (1000, None), (1001, "")]
    how = Capacities(shard_pieces=50)
    got = assign(documents(rows), bytes_and_end(F.col("text")), how)
    whole(got.collect(), {i: len(t or "") + 1 for i, t in rows}, 8192)
    packed = bins(got).collect()
    assert all(sum(s["tokens"] for s in b["segments"]) == b["tokens"] <= b["capacity"] for b in packed)
    assert len(packed) == got.select("bin").distinct().count()


def test_packing_odd_rows(documents, odd_rows):
    got = assign(documents(odd_rows), bytes_and_end(F.col("text"))).collect()
    assert sum(r["tokens"] for r in got) == sum(len((t or "").encode()) + 1 for _, t in odd_rows)
    assert assign(documents([]), bytes_and_end(F.col("text"))).count() == 0
    assert documents([(1, "a b\tc "), (2, None)]).select(words_and_end(F.col("text")).alias("n")).collect()[0]["n"] == 4
    assert assign(documents([(1, "a")]), F.lit(None)).count() == 0


def test_packing_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = op8_packing(spark, SF).collect()
    whole(rows, {r["doc_id"]: len(r["text"].encode()) + 1 for r in docs.collect()}, 8192)
    room = {r["bin"]: r["capacity"] for r in rows}
    assert sum(r["tokens"] for r in rows) / sum(room.values()) > 0.97


def brute(ids, x, top=20, every=20):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = x @ x[i]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:top]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def found(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return dict(out)


def test_recall_and_exact_scores(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.array(rows["embedding"].tolist(), np.float32).astype(np.float64)
    truth, got = brute(ids, x), found(op9_ivf_pq(spark, sf))
    assert set(got) == set(truth)
    hits = [len({v for v, _ in got[q]} & {v for v, _ in truth[q]}) / 20 for q in truth]
    assert np.mean(hits) >= 0.9
    at = {int(i): k for k, i in enumerate(ids)}
    for q, held in got.items():
        assert len(held) == 20 and held == sorted(held, key=lambda p: (-p[1], p[0]))
        assert np.allclose([s for _, s in held], [x[at[v]] @ x[at[q]] for v, _ in held], rtol=0, atol=1e-12)


def test_all_lists_visited_gives_all_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 12))
    x[100:200] = x[100]  # a third of all rows are one vector
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], 0, 0) for i in range(300)], "vec_id long, embedding array<double>, list int, id int")
    got = found(search(df, top=7, every=10, how=AnnSettings(visits=300, depth=700, list_block=16, query_block=4)))
    for q, held in brute(np.arange(300), x, 7, 10).items():
        assert [v for v, _ in got[q]] == [v for v, _ in held] or np.allclose([s for _, s in got[q]], [s for _, s in held])


def test_ties_at_the_cut_go_to_smaller_ids(spark):
    """3000 copies of one vector, far more than are reranked, in blocks that also hold others; and a key given 50 times."""
    rng = np.random.default_rng(8)
    x = rng.integers(-3, 4, size=(4000, 16)).astype(float)  # whole numbers, so that scores are exact
    ids = rng.permutation(4000)
    x[:3000] = 9.0
    low = int(ids[:3000].min() + 20) // 20 * 20
    again = [(low, [9.0] * 16)] * 50
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True) if i != low] + again, "vec_id long, embedding array<float>")
    got = found(search(df, how=AnnSettings(visits=5000, depth=200)).filter("query_id % 100 = 0 or query_id = " + str(low)))
    rest = ids != low
    all_ids = np.concatenate([ids[rest], np.full(50, low)])
    all_x = np.concatenate([x[rest], np.full((50, 16), 9.0)])
    hot = set(all_ids[(all_x == 9.0).all(axis=1)].tolist())
    asked = [q for q in got if q in hot]
    assert len(asked) > 10 and low in asked
    for q in asked:
        score = all_x @ all_x[np.flatnonzero(all_ids == q)[0]]
        order = [j for j in np.lexsort((all_ids, -score)) if all_ids[j] != q][:20]
        assert got[q] == [(int(all_ids[j]), float(score[j])) for j in order]


def test_equal_codes_of_unequal_vectors_are_all_reranked(spark):
    """One codebook entry for each group, so that all of a list tie: exact scores decide."""
    rng = np.random.default_rng(9)
    x = rng.integers(-9, 10, size=(3000, 8)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = found(search(df, every=100, how=AnnSettings(visits=2, depth=200, codes=1, most_lists=2, groups=4)))
    assert got == brute(np.arange(3000), x, 20, 100)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, []), (8, [1.0]), (None, [1.0, 1.0]), (1, [1.0, 1.0]), (40, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = found(search(df))
    assert got == {0: [(1, 1.0), (1, 1.0), (20, 0.5)], 20: [(1, 1.0), (1, 1.0), (0, 0.5)]}
    assert search(df.limit(0)).count() == 0 and search(df.filter("vec_id = 3")).count() == 0
    assert search(df.filter("vec_id = 0")).count() == 0


def clustered(n, dim=32, centres=300, spread=0.35, seed=11):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    return (c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))).astype(np.float32)


@pytest.mark.parametrize("lists", [8, 65_536])
def test_recall_where_the_codes_decide(spark, lists):
    """40,000 clustered vectors, also in 8 lists: each holds far more rows than are scored exactly."""
    x = clustered(40_000)
    how = AnnSettings(most_lists=lists)
    rows = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    got = found(search(rows, every=100, how=how))
    truth = brute(np.arange(len(x)), x.astype(np.float64), every=100)
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in truth[q]}) / 20 for q in truth]) >= 0.9


@pytest.mark.parametrize(("low", "high", "kind"), [(1e20, 1e20, "float"), (1.0, 1e25, "float"), (1e150, 1e150, "double")])
def test_recall_at_any_magnitude(spark, low, high, kind):
    """Squares of such vectors are beyond single precision; half of the rows are ``low``, half ``high``."""
    x = clustered(4000).astype(kind)
    x *= np.where(np.arange(len(x)) // 20 % 2, high, low).astype(kind)[:, None]
    rows = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": pa.array(list(x))}), f"vec_id long, embedding array<{kind}>")
    got = found(search(rows))
    truth = brute(np.arange(len(x)), x.astype(np.float64))
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in truth[q]}) / 20 for q in truth]) >= 0.9


def test_frames_keep_the_order_of_inner_products():
    x = clustered(500)[:, :16].astype(np.float64)
    for moved in (x * 1e-200, x * 1e200, x + 1000.0, np.concatenate([x, x[:50] * 1e300])):
        narrow, q = Frame.of(moved).rows(moved), directions(moved[:5])
        assert np.isfinite(narrow).all() and np.isfinite((narrow * narrow).sum(axis=1)).all()
        for i in range(5):
            near = q[i] @ (moved[:500] / np.abs(moved[:500]).max()).T
            assert np.corrcoef(near, q[i] @ narrow[:500].astype(np.float64).T)[0, 1] > 0.999999
    assert (Frame.of(np.ones((9, 4))).rows(np.ones((9, 4))) == 0).all()


def test_cheapest_against_all_choices():
    rng = np.random.default_rng(2)
    turn, rank = rng.geometric(0.2, 400) - 1, rng.geometric(0.02, 400) - 1
    visits, depth = cheapest(turn, rank, 50, 50_000, 20, 0.9)
    assert np.mean((turn < visits) & (rank < depth)) >= 0.9
    work = lambda v, d: v * (1000 + 8 * min(d, 1000))
    depths = {min(20 << k, int(rank.max()) + 1) for k in range(24)}
    assert work(visits, depth) == min(work(v, d) for v in range(1, 60) for d in depths if np.mean((turn < v) & (rank < d)) >= 0.9)


def test_workers_need_no_package(tmp_path):
    """Executors that don't have this package on their path."""
    import os
    import subprocess
    import sys

    import millrace

    root = os.path.dirname(os.path.dirname(os.path.abspath(millrace.__file__)))
    script = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from millrace.llm.ann import search
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
rows = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(100)], "vec_id long, embedding array<float>")
print("rows", search(rows).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows 100" in done.stdout, done.stderr[-2000:]


def test_index_parts():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    index = fit_index(x, 400, AnnSettings(groups=4, codes=256))
    lists = index.nearest(x)
    codes = index.encode(x, lists)
    near = x[:3] @ index.centroids[lists].T + index.distances(x[:3], codes)
    assert np.abs(near - x[:3] @ x.T).mean() < 0.35
    assert len(k_means(np.ones((9, 2), np.float32), 4, 3, rng)) == 1
