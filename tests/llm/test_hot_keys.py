"""Keys that hold a large share of all rows are spread over tasks, and nothing is lost or doubled by it."""

from pyspark.sql import functions as F

from millrace.llm.common import chunks, hot_slots, spread_join
from millrace.llm.packing import Capacities, assign


def test_spread_join_is_a_join(spark):
    left = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("long").alias("k"), F.col("id").alias("v"))
    right = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    assert len(hot_slots(left, ["k"], 1000)) == 1
    for how in ("inner", "left", "left_semi"):
        got, plain = spread_join(left, right, ["k"], how), left.join(right, ["k"], how)
        assert got.columns == plain.columns
        assert not got.exceptAll(plain).count() and not plain.exceptAll(got).count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shares = [r["count"] for r in spread_join(left, right, ["k"]).filter("k = 7").groupBy(F.spark_partition_id()).count().collect()]
        assert len(shares) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(shares) < 1200
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_packing_of_rows_that_share_a_key(spark):
    rows = spark.range(6000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("x").alias("text"))
    got = assign(rows, F.lit(3), Capacities(shard_pieces=2000)).groupBy(F.split("bin", "-")[0]).count().collect()
    assert len(got) == 3 and max(r["count"] for r in got) < 2300 and sum(r["count"] for r in got) == 6000


def test_chunks_cut_at_white_space():
    text = "ab cd  " * 50 + "x" * 300 + " y"
    parts = list(chunks(text, 64))
    assert "".join(parts) == text and sum((p.split() for p in parts), []) == text.split() and len(parts) > 5
    assert list(chunks("")) == [] and list(chunks("x" * 99, 10)) == ["x" * 99]
