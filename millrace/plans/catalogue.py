"""Registered queries over the driver's tables, and the DuckDB SQL each must agree with.

Every query goes through the library's operators.  Money is summed in cents and counts are longs, so that results don't
depend on the order of additions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import codecs
from millrace.functions.text import lines_of, prefix, words
from millrace.operators import grouped, keys, monoids
from millrace.operators.joins import inner_merge, monoid_join, optional, required
from millrace.operators.keys import key, numeric
from millrace.operators.stage import aggregate, first_by, flat_map, fold, map_only, over_groups, reduce_by, reduce_with, sort_all, top
from millrace.plans.metrics import Counters
from millrace.plans.pipeline import Pipeline
from millrace.plans.session import scratch
from millrace.sources.taps import concat, file_name, tagged, tap
from millrace.streaming.incremental import sessions, windowed

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(value: str | Column) -> Column:
    return F.round((F.col(value) if isinstance(value, str) else value) * 100).cast("long")


def counted() -> Column:
    return F.count(F.lit(1)).cast("long")


# Stages: flat-map, keyed and global aggregation.


@query("SELECT count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)")
def line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = flat_map("lines", lines_of(F.col("text"))) >> aggregate("count", [], {"n": counted()})
    return stage(table(spark, sf_dir, "documents"))


_WORDS = "SELECT unnest(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+')) AS word FROM documents"


@query(f"SELECT word, count(*) AS cnt FROM ({_WORDS}) WHERE word <> '' GROUP BY word")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = aggregate("word count", ["word"], {"cnt": counted()}, mapper=lambda df: df.select(F.explode(words(F.col("text"))).alias("word")))
    return stage(table(spark, sf_dir, "documents"))


@query(f"SELECT 'Total Count' AS label, count(DISTINCT word) AS cnt FROM ({_WORDS}) WHERE word <> ''")
def word_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    pipeline = Pipeline(spark, "wordtotal")
    counts = pipeline.lazily(aggregate("word count", ["word"], {"cnt": counted()}), table(spark, sf_dir, "documents").select(F.explode(words(F.col("text"))).alias("word")))
    return pipeline.lazily(aggregate("total", [], {"cnt": counted()}), counts).select(F.lit("Total Count").alias("label"), "cnt")


@query("SELECT doc_id, substring(text, 1, 5) AS text, substring(lang, 1, 5) AS lang, substring(source, 1, 5) AS source FROM documents")
def truncate_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = map_only("truncate", lambda df: df.select("doc_id", *[prefix(F.col(c), 5).alias(c) for c in ("text", "lang", "source")]))
    return stage(table(spark, sf_dir, "documents"))


@query("SELECT l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def group_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = aggregate("group sum", ["l_returnflag"], {"qty": F.sum(F.col("l_quantity").cast("long")), "n": counted()})
    return stage(table(spark, sf_dir, "lineitem"))


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY ALL")
def money_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce_by("money", ["l_returnflag", "l_linestatus"], monoids.sum_(), cents("l_extendedprice"), out="cents")(table(spark, sf_dir, "lineitem"))


@query("SELECT l_shipmonth, CAST(sum(q) AS BIGINT) AS qty FROM (SELECT strftime(l_shipdate, '%Y-%m') AS l_shipmonth, CAST(l_quantity AS BIGINT) AS q FROM lineitem WHERE l_returnflag = 'R') GROUP BY l_shipmonth HAVING sum(q) > 100")
def pre_post_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = lambda df: df.filter("l_returnflag = 'R'").select(F.date_format("l_shipdate", "yyyy-MM").alias("l_shipmonth"), F.col("l_quantity").cast("long").alias("q"))
    stage = before >> aggregate("months", ["l_shipmonth"], {"qty": F.sum("q")}) >> (lambda df: df.filter("qty > 100"))
    return stage(table(spark, sf_dir, "lineitem"))


@query("SELECT l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM lineitem GROUP BY l_returnflag")
def combiner_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregated in parts, then the parts: what a combiner would do."""
    add = monoids.sum_()
    rows = table(spark, sf_dir, "lineitem").withColumn("part", F.pmod(F.xxhash64("l_orderkey"), F.lit(16)))
    return (reduce_by("parts", ["l_returnflag", "part"], add, F.col("l_quantity").cast("long"), out="qty") >> reduce_by("whole", ["l_returnflag"], add, F.col("qty"), out="qty"))(rows)


@query("SELECT event_id, event_type || ':' || CAST(part AS VARCHAR) AS part FROM (SELECT event_id, event_type, unnest([1, 2]) AS part FROM events) WHERE event_type <> 'view' OR part = 1")
def python_mapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    def twice(rows):
        for row in rows:
            parts = (1,) if row["event_type"] == "view" else (1, 2)
            yield from ({"event_id": row["event_id"], "part": f"{row['event_type']}:{n}"} for n in parts)

    return grouped.map_rows(table(spark, sf_dir, "events").select("event_id", "event_type"), twice, "event_id long, part string")


@query("SELECT user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def python_combiner(spark: SparkSession, sf_dir: str) -> DataFrame:
    def merge(a: dict, b: dict) -> dict:
        return {"user_id": a["user_id"], "cents": a["cents"] + b["cents"], "n": a["n"] + b["n"]}

    def total(user: tuple, rows):
        found = list(rows)
        yield {"user_id": user[0], "cents": sum(r["cents"] for r in found), "n": sum(r["n"] for r in found)}

    rows = table(spark, sf_dir, "events").select("user_id", cents("value").alias("cents"), F.lit(1).cast("long").alias("n"))
    return grouped.reduce_sorted(grouped.combine(rows, key("user_id"), merge), key("user_id"), total, "user_id long, cents long, n long")


@query("SELECT count(*) AS n FROM lineitem WHERE l_quantity < 0 HAVING count(*) > 0")
def empty_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A constant key over no rows gives no row."""
    return aggregate("none", [], {"n": counted()})(table(spark, sf_dir, "lineitem").filter("l_quantity < 0"))


# Joins.


@query("SELECT o_orderkey, coalesce(c_name, '') || '|' || o_orderpriority AS value FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON c_custkey = o_custkey")
def join_required_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.struct(F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("|"), "o_orderpriority").alias("t")).alias("value"))
    people = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"), F.struct(F.lit("").alias("id"), F.col("c_name").alias("t")).alias("value"))
    both = monoid_join([required(orders), optional(people)], "k", monoids.fields({"id": monoids.concat_text(), "t": monoids.concat_text()}))
    return both.select(F.col("value.id").cast("long").alias("o_orderkey"), F.col("value.t").alias("value"))


@query("SELECT coalesce(s_suppkey, k) AS k, CAST(coalesce(n, 0) + coalesce(b, 0) AS BIGINT) AS value FROM (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_discount > 0.09 AND l_quantity > 40 AND l_returnflag = 'R' GROUP BY ALL) FULL JOIN (SELECT s_suppkey, CAST(round(s_acctbal * 100) AS BIGINT) AS b FROM supplier WHERE s_acctbal > 0) ON s_suppkey = k")
def join_all_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = aggregate("sold", ["k"], {"value": counted()}, mapper=lambda df: df.filter("l_discount > 0.09 and l_quantity > 40 and l_returnflag = 'R'").select(F.col("l_suppkey").alias("k")))(table(spark, sf_dir, "lineitem"))
    rich = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("k"), cents("s_acctbal").alias("value"))
    return monoid_join([optional(sold), optional(rich)], "k", monoids.sum_())


@query("SELECT c_custkey AS k, CAST(n * m * 7 AS BIGINT) AS value FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL) ON o_custkey = c_custkey JOIN (SELECT o_custkey AS z, count(DISTINCT o_orderpriority) AS m FROM orders GROUP BY ALL) ON z = c_custkey")
def join_all_required_3way(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey"))
    number = aggregate("orders", ["k"], {"value": counted()})(orders)
    kinds = aggregate("kinds", ["k"], {"value": F.countDistinct("o_orderpriority")})(orders)
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit(7).cast("long").alias("value"))
    return monoid_join([required(number), required(kinds), required(people)], "k", monoids.product("long"))


@query("SELECT o_orderkey, c_mktsegment || ',' || CAST(o_orderkey AS VARCHAR) || ',' || o_orderstatus AS value FROM orders JOIN customer ON c_custkey = o_custkey")
def join_list_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The input listed last comes first in a list; the others follow as listed."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.array(F.col("o_orderkey").cast("string"), "o_orderstatus").alias("value"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.array("c_mktsegment").alias("value"))
    both = monoid_join([required(orders), required(people)], "k", monoids.concat_list("string"))
    return both.select(F.col("value")[1].cast("long").alias("o_orderkey"), F.array_join("value", ",").alias("value"))


@query("SELECT l_orderkey, l_linenumber, o_orderpriority || l_returnflag AS value FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def join_mr_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = monoids.fields({"n": monoids.sum_("int"), "t": monoids.concat_text()})
    left = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.struct(F.lit(0).alias("n"), F.col("o_orderpriority").alias("t")).alias("value"))
    right = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("t")).alias("value"))
    return inner_merge(left, right, "l_orderkey", pair).select("l_orderkey", F.col("value.n").alias("l_linenumber"), F.col("value.t").alias("value"))


@query("SELECT a.n_nationkey AS k, a.n_name || b.n_name AS value FROM nation AS a JOIN nation AS b USING (n_nationkey)")
def join_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("value"))
    return monoid_join([required(names), required(names)], "k", monoids.concat_text())


@query("SELECT l_suppkey, l_returnflag, CAST(n + m AS BIGINT) AS value FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) JOIN (SELECT l_suppkey, l_returnflag, max(l_linenumber) AS m FROM lineitem GROUP BY ALL) USING (l_suppkey, l_returnflag)")
def join_composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["l_suppkey", "l_returnflag"]
    rows = table(spark, sf_dir, "lineitem")
    count = aggregate("n", by, {"value": counted()})(rows)
    most = aggregate("m", by, {"value": F.max("l_linenumber").cast("long")})(rows)
    return monoid_join([required(count), required(most)], by, monoids.sum_())


# Keys, secondary sort, order.


@query("SELECT CAST(o_custkey AS VARCHAR) AS k, count(*) AS n, CAST(row_number() OVER (ORDER BY CAST(o_custkey AS VARCHAR)) AS BIGINT) AS place FROM orders GROUP BY o_custkey")
def int_key_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = aggregate("by text", ["k"], {"n": counted()}, mapper=lambda df: df.select(keys.int_key(F.col("o_custkey")).alias("k")))(table(spark, sf_dir, "orders"))
    return ranked(counts, ["k"])


def ranked(df: DataFrame, by: list[str]) -> DataFrame:
    """Places in a total order without one task for all rows: places within range partitions, shifted by their counts.

    Partitions are written once, as their bounds are drawn anew whenever they are computed; their counts, one row for
    each partition, are summed in one task.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/ranked-{uuid.uuid4().hex}"
    place = F.monotonically_increasing_id()
    df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.shiftright(place, 33)).withColumn("_row", place.bitwiseAND((1 << 33) - 1)).write.parquet(path)
    ordered = spark.read.parquet(path)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("c")).withColumn("shift", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    return ordered.join(F.broadcast(shifts), "_part").withColumn("place", F.col("_row") + F.col("shift") + 1).drop("_part", "_row", "shift")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS k FROM events")
def utc_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", keys.utc_key(F.col("ts")).alias("k"))


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, l_returnflag || '|' || l_linestatus || '|' || CAST(l_linenumber AS VARCHAR) AS k FROM lineitem GROUP BY ALL")
def composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["l_returnflag", "l_linestatus", "l_linenumber"]
    return aggregate("composite", key(*by), {"n": counted()})(table(spark, sf_dir, "lineitem")).withColumn("k", keys.flat_key(*by))


@query("SELECT event_id, user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM events WHERE user_id IS NOT NULL")
def secondary_sort_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", cents("value").alias("cents"))
    by = key("user_id", "ts", numeric("event_id"), group=1)
    stage = over_groups("running", by, {"running": lambda w: F.sum(F.coalesce("cents", F.lit(0))).over(w)})
    return stage(rows).select("event_id", "user_id", "running")


@query("SELECT user_id, count(*) AS events, CAST(sum(new) AS BIGINT) AS sessions FROM (SELECT user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE user_id IS NOT NULL) GROUP BY user_id")
def secondary_sort_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    def sessions_of(user: tuple, rows):
        last, events, found = None, 0, 0
        for row in rows:
            found += last is None or (row["ts"] - last).total_seconds() > 1800
            events, last = events + 1, row["ts"]
        yield {"user_id": user[0], "events": events, "sessions": found}

    return reduce_with("sessions", key("user_id", "ts", numeric("event_id"), group=1), sessions_of, "user_id long, events long, sessions long")(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"))


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS BIGINT) AS place FROM orders WHERE o_custkey IS NOT NULL")
def numeric_comparator(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = over_groups("places", key("o_custkey", numeric("o_orderkey", reverse=True), group=1), {"place": lambda w: F.row_number().over(w).cast("long")})
    return stage(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"))


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS place FROM orders")
def total_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])


@query("SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders ORDER BY cents DESC, o_orderkey LIMIT 25")
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(table(spark, sf_dir, "orders").select("o_orderkey", cents("o_totalprice").alias("cents")), key(numeric("cents", reverse=True), numeric("o_orderkey"), group=0), 25)


@query("SELECT n_name FROM nation ORDER BY n_name")
def sorted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_all(table(spark, sf_dir, "nation").select("n_name"), key("n_name", group=0))


@query("SELECT DISTINCT ON (user_id) event_id, user_id, event_type FROM events WHERE user_id IS NOT NULL ORDER BY user_id, ts, event_id")
def first_of_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_by("first", ["user_id"], ["ts", "event_id"])(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")).drop("ts")


@query("SELECT event_type, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def left_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_user = fold("fold", ["event_type", "user_id"], cents("value"), F.col("event_id"), F.lit(0).cast("long"), lambda a, v: a + F.coalesce(v, F.lit(0)), "part")
    rows = table(spark, sf_dir, "events").fillna({"user_id": -1})
    return (by_user >> reduce_by("total", ["event_type"], monoids.sum_(), F.col("part"), out="total"))(rows)


# Taps and codecs.


@query("SELECT c_name AS name, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer UNION ALL SELECT s_name, CAST(round(s_acctbal * 100) AS BIGINT) FROM supplier")
def union_taps(spark: SparkSession, sf_dir: str) -> DataFrame:
    def named(p: str) -> codecs.Codec:
        return codecs.Codec("parquet", decode=lambda df: df.select(F.col(f"{p}_name").alias("name"), cents(f"{p}_acctbal").alias("cents")))

    return concat(tap(f"{sf_dir}/customer.parquet", named("c")), tap(f"{sf_dir}/supplier.parquet", named("s"))).read(spark)


@query("SELECT 'left' AS tag, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'right', s_suppkey, s_name FROM supplier")
def tagged_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = tagged(table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier"))
    return both.select("tag", F.coalesce("left.c_custkey", "right.s_suppkey").alias("id"), F.coalesce("left.c_name", "right.s_name").alias("name"))


@query("SELECT doc_id, base64(encode(source)) AS packed, source FROM documents")
def base64_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = codecs.base64_binary()
    packed = codec.encode(table(spark, sf_dir, "documents").select("doc_id", F.encode("source", "utf-8").alias("value")))
    back = codec.decode(packed.withColumn("packed", F.col("value")))
    return back.select("doc_id", "packed", F.decode("value", "utf-8").alias("source"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > 0.05")
def filter_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = codecs.filtered(codecs.parquet("l_orderkey long, l_linenumber int, l_discount double"), F.col("l_discount") > 0.05)
    return tap(f"{sf_dir}/lineitem.parquet", codec).read(spark).select("l_orderkey", "l_linenumber")


@query("SELECT tag, count(*) AS n FROM (SELECT CASE WHEN try_cast(v AS BIGINT) IS NOT NULL THEN 'left' ELSE 'right' END AS tag FROM (SELECT unnest([CAST(event_id AS VARCHAR), event_type]) AS v FROM events)) GROUP BY tag")
def either_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = codecs.either(codecs.as_long, lambda c: c)
    mixed = table(spark, sf_dir, "events").select(F.explode(F.array(F.col("event_id").cast("string"), "event_type")).alias("value"))
    return aggregate("tags", ["tag"], {"n": counted()})(codec.decode(mixed))


@query("SELECT CAST(user_id AS VARCHAR) AS key_1, event_type AS key_2, CAST(event_id AS VARCHAR) || chr(9) || 'x' AS value FROM events WHERE user_id IS NOT NULL")
def kv_line_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "events").filter("user_id is not null").select(F.concat_ws("\t", F.col("user_id").cast("string"), "event_type", F.col("event_id").cast("string"), F.lit("x")).alias("value"))
    return codecs.keyed_lines(2).decode(made)


@query("SELECT event_type AS path, count(*) AS count FROM events GROUP BY event_type")
def fanout_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.sources.fanout import fan_out

    return fan_out(table(spark, sf_dir, "events"), F.col("event_type"), f"{scratch(spark)}/fanout-{uuid.uuid4().hex}")


@query("SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def file_name_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda t: table(spark, sf_dir, t).select(F.regexp_extract(file_name(), r"([a-z]+)\.parquet(/[^/]*)?$", 1).alias("name"))
    return aggregate("files", ["name"], {"n": counted()})(named("nation").unionByName(named("region")))


# Monoids.


@query("SELECT event_type, min(event_id) AS least, max(event_id) AS most, bool_or(value > 100) AS some, bool_and(event_id >= 0) AS every FROM events GROUP BY event_type")
def monoid_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"least": monoids.least("long"), "most": monoids.greatest("long"), "some": monoids.any_(), "every": monoids.all_()}
    value = F.struct(F.col("event_id").alias("least"), F.col("event_id").alias("most"), (F.col("value") > 100).alias("some"), (F.col("event_id") >= 0).alias("every"))
    return reduce_by("fields", ["event_type"], monoids.fields(parts), value)(table(spark, sf_dir, "events")).select("event_type", "value.*")


@query("SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS first, arg_max(o_orderpriority, o_orderkey) AS last, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS text, list_aggregate(list_sort(list_distinct(list(o_orderpriority))), 'string_agg', ',') AS kinds FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey")
def monoid_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.col("o_orderkey")
    cells = {
        "first": monoids.first("string").over(F.col("o_orderpriority"), order),
        "last": monoids.last("string").over(F.col("o_orderpriority"), order),
        "text": monoids.concat_text().over(F.col("o_orderstatus"), order),
        "kinds": F.array_join(monoids.set_of("string").over(F.array("o_orderpriority")), ","),
    }
    return aggregate("ordered", ["o_custkey"], cells)(table(spark, sf_dir, "orders"))


# Control, counters.


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_totalprice > 1000")
def shared_vars(spark: SparkSession, sf_dir: str) -> DataFrame:
    pipeline = Pipeline(spark, "sharedvars")
    pipeline.set("threshold", pipeline.run_once("threshold", lambda: 1000))
    return pipeline.lazily(aggregate("above", [], {"n": counted()}), table(spark, sf_dir, "orders").filter(F.col("o_totalprice") > F.lit(pipeline.get("threshold"))))


@query("SELECT 'events' AS name, count(*) AS n FROM events")
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = Counters(spark)
    counts.observe(table(spark, sf_dir, "events").select("event_id"), "events").write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([("events", counts.value("events", "rows"))], "name string, n long")


# The same columns run over streams; here over a table at rest.


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def hourly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed(table(spark, sf_dir, "events"), "ts", "1 hour", "10 minutes", ["event_type"], {"n": counted()})


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS sessions, CAST(sum(n) AS BIGINT) AS events FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY ALL) GROUP BY user_id")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions(table(spark, sf_dir, "events"), "ts", "30 minutes", "10 minutes", ["user_id"], {"n": counted()})
    return found.groupBy("user_id").agg(counted().alias("sessions"), F.sum("n").alias("events"))


# Queries that write and read back register themselves.
from millrace.plans import catalogue_io  # noqa: E402, F401
