import datetime
import itertools
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import monoids
from millrace.operators.grouped import GroupError, OnError, combine, map_rows, reduce_sorted
from millrace.operators.joins import Input, inner_merge, last_of, monoid_join, optional, required
from millrace.operators.keys import flat_key, int_key, key, numeric, packed_key, segments_of, time_of_key, utc_key
from millrace.plans import session
from millrace.operators.stage import aggregate, combiner_agrees, first_by, fold, map_only, over_groups, reduce_by, reduce_with, tee_first


def join_model(inputs, needed):
    """Rows of a join of lists by key, as the rules say."""
    out = Counter()
    last = max(range(len(inputs)), key=str)
    order = [last, *(i for i in range(len(inputs)) if i != last)]
    for k in {k for rows in inputs for k, _ in rows}:
        sides = []
        for rows, must in zip(inputs, needed, strict=True):
            mine = [v for key_, v in rows if key_ == k]
            sides.append(mine or ([] if must else [[]]))
        for combination in itertools.product(*sides):
            out[tuple(sum((list(combination[i]) for i in order), []))] += 1
    return out


@pytest.mark.parametrize("count", [1, 2, 3])
def test_join_matches_the_rules(spark, count):
    draw = random.Random(count)
    for needed in itertools.product([True, False], repeat=count):
        inputs = [[(k, [f"{i}{k}{n}"]) for k in range(4) for n in range(draw.choice([0, 1, 2]))] for i in range(count)]
        frames = [spark.createDataFrame(rows, "k int, value array<string>") for rows in inputs]
        got = monoid_join([Input(f, must) for f, must in zip(frames, needed, strict=True)], "k", monoids.concat_list("string"), keep_keys=False)
        assert Counter(tuple(r["value"]) for r in got.collect()) == join_model(inputs, needed)


def test_of_eleven_inputs_number_nine_is_leftmost(spark):
    assert last_of(10) == 9 and last_of(11) == 9
    one = [required(spark.createDataFrame([(1, str(i))], "k int, value string")) for i in range(11)]
    assert monoid_join(one, "k", monoids.concat_text()).collect()[0]["value"] == "9" + "".join(str(i) for i in range(11) if i != 9)


def test_a_null_that_is_there_is_not_missing(spark):
    left = spark.createDataFrame([(1, 5), (2, 6), (None, 7)], "k int, value int")
    right = spark.createDataFrame([(1, None), (None, 8)], "k int, value int")
    got = {r["k"]: r["value"] for r in monoid_join([required(left), optional(right)], "k", monoids.sum_("int")).collect()}
    assert got == {1: None, 2: 6}


def test_join_on_several_keys_and_inner_merge(spark):
    a = spark.createDataFrame([(1, "x", "a"), (1, "y", "b")], "k int, z string, value string")
    assert monoid_join([required(a), required(a)], ["k", "z"], monoids.concat_text()).count() == 2
    assert {r["value"] for r in inner_merge(a, a, ["k", "z"], monoids.concat_text()).collect()} == {"aa", "bb"}


def test_monoids(spark):
    df = spark.createDataFrame([(1, "b", 2), (2, "a", 3), (3, None, 4)], "o int, v string, n int")
    maps = df.select("o", F.create_map(F.lit("k"), F.col("o")).alias("m"))
    o = F.col("o")
    row = df.agg(
        monoids.first("string").over(F.col("v"), o).alias("first"),
        monoids.last("string").over(F.col("v"), o).alias("last"),
        monoids.product("long").over(F.col("n")).alias("product"),
        monoids.concat_text().over(F.coalesce("v", F.lit("-")), o).alias("text"),
        monoids.set_of("string").over(F.array("v")).alias("set"),
        monoids.concat_list("string").over(F.array("v"), o).alias("list"),
    ).collect()[0]
    assert (row["first"], row["last"], row["product"], row["text"]) == ("b", "a", 24, "ba-")
    assert row["list"] == ["b", "a", None]
    assert maps.agg(monoids.map_of("string", "int").over(F.col("m"), o).alias("m")).collect()[0]["m"] == {"k": 1}
    empty = df.limit(0).agg(monoids.sum_().over(F.col("n")).alias("s"), monoids.all_().over(F.col("n") > 0).alias("a")).collect()[0]
    assert (empty["s"], empty["a"]) == (0, True)
    with pytest.raises(ValueError):
        monoids.concat_text().over(F.col("v"))


@given(st.lists(st.datetimes(datetime.datetime(1000, 1, 1), datetime.datetime(9999, 12, 31)), max_size=6))
@settings(max_examples=5, deadline=None)
def test_times_sort_as_their_keys(spark, times):
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz").select("t", utc_key(F.col("t")).alias("k"))
    rows = df.withColumn("back", time_of_key(F.col("k"))).collect()
    assert [r["t"] for r in sorted(rows, key=lambda r: r["k"])] == sorted(times)
    assert all(r["back"] == r["t"] for r in rows)


def test_instants_are_told_in_utc(spark):
    """Two instants an hour apart that have one wall clock in New York, and a time that New York skips."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("SELECT timestamp_seconds(s) AS t FROM VALUES (1730611800), (1730615400), (-1), (0) AS v(s)").select(utc_key(F.col("t")).alias("k"))
        assert [r["k"] for r in df.collect()] == ["2024-11-03 05:30:00.000000", "2024-11-03 06:30:00.000000", "1969-12-31 23:59:59.000000", "1970-01-01 00:00:00.000000"]
        skipped = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:00.25' AS t").select(utc_key(F.col("t")).alias("k"))
        assert skipped.collect()[0]["k"] == "2024-03-10 02:30:00.250000"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_numbers_beyond_doubles_sort_exactly(spark):
    big = 2**53
    rows = [str(big + 1), str(big), "1e30", "-0.5", "x", str(big + 2), "0.25"]
    df = spark.createDataFrame([(r,) for r in rows], "n string")
    assert [r["n"] for r in df.orderBy(*key(numeric("n"), group=0).sort_expressions()).collect()] == ["x", "-0.5", "0.25", str(big), str(big + 1), str(big + 2), "1e30"]
    longs = spark.createDataFrame([(big + 1,), (big,), (2**63 - 1,), (2**63 - 2,)], "n long")
    assert [r["n"] for r in longs.orderBy(*key(numeric("n", reverse=True), group=0).sort_expressions()).collect()] == [2**63 - 1, 2**63 - 2, big + 1, big]


def test_null_segments_keep_their_place(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None)], "x string, y string")
    assert [r[0] for r in df.select(flat_key("x", "y")).collect()] == ["|a", "a|"]


def test_options_edited_later_hold(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "g string, n int")

    def bad(k, rows):
        for r in rows:
            if k[0] == "a":
                raise ValueError("no")
            yield {"n": r["n"]}

    stage = reduce_with("r", key("g"), bad, "n int")
    assert [r["n"] for r in stage.having(on_error=OnError.SKIP_KEY)(df).collect()] == [2]
    composed = (lambda d: d.filter("n > 0")) >> stage >> (lambda d: d.selectExpr("n * 10 as n"))
    assert [r["n"] for r in composed.having(on_error=OnError.SKIP_KEY)(df).collect()] == [20]
    with pytest.raises(Exception, match="key \\('a',\\)"):
        composed(df).collect()
    counts = aggregate("c", ["g"], {"n": F.count(F.lit(1))}).having(reduce_tasks=3)(df)
    assert counts.rdd.getNumPartitions() == 3 and counts.count() == 2


def test_columns_over_groups(spark):
    df = spark.createDataFrame([("a", 10, 1), ("a", 9, 2), ("b", 1, 5), (None, 1, 7)], "g string, n int, v int")
    by = key("g", numeric("n"), group=1)
    got = over_groups("s", by, {"sum": lambda w: F.sum("v").over(w)})(df).collect()
    assert {(r["g"], r["n"], r["sum"]) for r in got} == {("a", 9, 2), ("a", 10, 3), ("b", 1, 5)}


def test_maps_keep_the_first_of_each_key(spark):
    rows = [(n, {k: n for k in range(n % 5)}) for n in range(200)] + [(500, None)]
    out = reduce_by("m", [], monoids.map_of("int", "int"), F.col("m"), F.col("n"))(spark.createDataFrame(rows, "n int, m map<int,int>")).collect()
    assert out[0]["value"] == {0: 1, 1: 2, 2: 3, 3: 4}


def test_integers_sort_as_text_or_as_numbers(spark):
    df = spark.createDataFrame([(n,) for n in (100, 9, -1, 10, 0)], "n int").select("n", int_key(F.col("n")).alias("k"))
    assert [r["n"] for r in df.orderBy(*key("k", group=0).sort_expressions()).collect()] == [-1, 0, 10, 100, 9]
    assert [r["n"] for r in df.orderBy(*key(numeric("k"), group=0).sort_expressions()).collect()] == [-1, 0, 9, 10, 100]
    assert df.select(packed_key("n").alias("p")).distinct().count() == 5


def test_segments_keep_tabs_of_the_value(spark):
    df = spark.createDataFrame([("a\tb\tc\td",), ("a",)], "v string")
    parts, rest = segments_of(F.col("v"), 2)
    assert [tuple(r) for r in df.select(*parts, rest).collect()] == [("a", "b", "c\td"), ("a", None, "")]


def test_groups_span_batches_and_keep_order(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame([(g, n) for g in ("a", "b\t", "", "é") for n in range(50)], "g string, n int").orderBy(F.rand(1))

        def reducer(k, rows):
            yield {"g": k[0], "seen": [r["n"] for r in rows]}

        got = reduce_sorted(df, key("g", numeric("n", reverse=True), group=1), reducer, "g string, seen array<int>").collect()
        assert len(got) == 4 and all(r["seen"] == list(range(49, -1, -1)) for r in got)

        def early(k, rows):
            yield {"g": k[0], "seen": [next(rows)["n"]]}

        assert sorted(r["g"] for r in reduce_sorted(df, key("g", numeric("n"), group=1), early, "g string, seen array<int>").collect()) == ["", "a", "b\t", "é"]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_reducer_errors(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "g string, n int")

    def bad(k, rows):
        for r in rows:
            if k[0] == "a":
                raise ValueError("no")
            yield {"n": r["n"]}

    assert [r["n"] for r in reduce_sorted(df, key("g"), bad, "n int", OnError.SKIP_KEY).collect()] == [2]
    with pytest.raises(Exception, match="key \\('a',\\)"):
        reduce_sorted(df, key("g"), bad, "n int").collect()
    assert issubclass(GroupError, RuntimeError)

    tries = spark.sparkContext.accumulator(0)

    def once_bad(k, rows):
        tries.add(1)
        for r in rows:
            if not getattr(once_bad, "failed", False):
                once_bad.failed = True
                raise ValueError("first time")
            yield {"n": r["n"]}

    assert sorted(r["n"] for r in reduce_sorted(df, key("g"), once_bad, "n int", OnError.RETRY).collect()) == [1, 2]


def test_combiner_passes_on_what_it_cannot_hold(spark):
    df = spark.createDataFrame([(i % 7, 1) for i in range(100)] + [(None, 1)], "g int, n int")
    merge = lambda a, b: {"g": a["g"], "n": a["n"] + b["n"]}
    for most in (1, 1000):
        got = combine(df, key("g"), merge, most).groupBy("g").sum("n").collect()
        assert {r["g"]: r["sum(n)"] for r in got} == {g: len(range(g, 100, 7)) for g in range(7)}
    assert map_rows(df, lambda rows: ({"n": 1} for _ in rows), "n int", out_batch=3).count() == 101


def test_sessions(spark):
    assert session.local("tests").conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"


def test_empty_inputs(spark):
    df = spark.createDataFrame([], "g string, n long")
    assert aggregate("all", [], {"n": F.count(F.lit(1))})(df).count() == 0
    assert reduce_sorted(df, key(), lambda k, rows: [{"n": 1}], "n long").count() == 0
    assert first_by("f", ["g"], ["n"])(df).count() == 0


def test_fold_first_and_combiner(spark, tmp_path):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 3, "z"), (None, 1, "n")], "g string, n int, t string")
    folded = fold("f", ["g"], F.col("t"), F.col("n"), F.lit(""), lambda a, v: F.concat(a, v))(df)
    assert {r["g"]: r["value"] for r in folded.collect()} == {"a": "xy", "b": "z"}
    assert {r["g"]: r["t"] for r in first_by("f", ["g"], ["n"])(df).collect()} == {"a": "x", "b": "z"}
    assert combiner_agrees(df, ["g"], monoids.sum_(), "n")
    assert tee_first(df, str(tmp_path / "head")).count() == 4 and spark.read.json(str(tmp_path / "head")).count() == 1


def test_stages_compose(spark):
    df = spark.range(10)
    stage = (lambda d: d.filter("id > 2")) >> map_only("m", lambda d: d.selectExpr("id * 2 as id")) >> (lambda d: d.filter("id < 12"))
    assert [r["id"] for r in stage(df).collect()] == [6, 8, 10]
    assert reduce_by("r", ["k"], monoids.sum_(), F.col("id"), mapper=lambda d: d.withColumn("k", F.col("id") % 2)).having(map_tasks=2)(df).count() == 2
