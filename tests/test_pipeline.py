import time

import pytest
from pyspark.sql import functions as F

from millrace.functions.codecs import lines, parquet
from millrace.operators.stage import map_only
from millrace.plans import examples  # noqa: F401
from millrace.plans.metrics import Counters, every, status
from millrace.plans.pipeline import APPS, OutputExists, Pipeline, Rerun, StageTimeout, app, main
from millrace.sources.taps import tap
from millrace.streaming.incremental import each_batch, stateful_scan, stream, windowed


def test_rerun_policies(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    def step(df):
        runs.add(1)
        return df.withColumn("x", F.lit(runs.value))

    pipeline, out = Pipeline(spark, "p", str(tmp_path)), tap(str(tmp_path / "out"), parquet())
    stage = map_only("s", step)
    assert pipeline.connect(stage, spark.range(3), out).count() == 3
    with pytest.raises(OutputExists):
        pipeline.connect(stage, spark.range(3), out)
    pipeline.connect(stage, spark.range(3), out, Rerun.SKIP)
    assert runs.value == 1
    assert pipeline.connect(stage, spark.range(3), out, Rerun.RERUN).select("x").first()[0] == 2
    (tmp_path / "out/_SUCCESS").unlink()  # as a job that failed leaves it
    pipeline.connect(stage, spark.range(3), out, Rerun.SKIP)
    assert runs.value == 3 and [h[1] for h in pipeline.history] == ["run", "skipped", "run", "run"]


def test_variables_effects_and_names(spark, tmp_path):
    pipeline = Pipeline(spark, "p1", str(tmp_path))
    made = []
    assert [pipeline.run_once("v", lambda: made.append(1) or 5) for _ in range(2)] == [5, 5] and made == [1]
    assert pipeline.shipped("v", lambda: 6).value == 5 and pipeline.shipped("v", lambda: 6) is pipeline.shipped("v", lambda: 7)
    assert Pipeline(spark, "p2").workspace.startswith("file:")
    pipeline.set("a", 1)
    assert (pipeline.get("a"), pipeline.get("b", 2), pipeline.io(lambda: 3)) == (1, 2, 3)
    seen = spark.sparkContext.accumulator(0)
    assert pipeline.on_nodes(spark.range(4, numPartitions=2), lambda: seen.add(1)).count() == 4 and seen.value == 2
    assert pipeline.temporary().paths != pipeline.temporary().paths
    for bad in ("A", "", "a_b"):
        with pytest.raises(ValueError):
            Pipeline(spark, bad)
        with pytest.raises(ValueError):
            app(bad)


def test_timeout_cancels_the_stage(spark, tmp_path):
    def slow(batches):
        for b in batches:
            time.sleep(30)
            yield b

    stage = map_only("slow", lambda df: df.mapInArrow(slow, df.schema)).having(timeout_s=1.0)
    with pytest.raises(StageTimeout):
        Pipeline(spark, "p").connect(stage, spark.range(1), tap(str(tmp_path / "out"), parquet()))


def test_example_app(spark, tmp_path, capsys):
    (tmp_path / "input").mkdir()
    (tmp_path / "input/a.txt").write_text("one two two\nthreethree\n")
    assert main(["wordcount", "--workspace", str(tmp_path)], spark) == 0
    assert sorted((r[0], r[1]) for r in spark.read.csv(str(tmp_path / "frequencies")).collect()) == [("one", "1"), ("threethree", "1"), ("two", "2")]
    assert spark.read.csv(str(tmp_path / "total")).collect()[0][0] == "3"
    assert "three" in {r[0] for r in spark.read.csv(str(tmp_path / "short")).collect()}
    assert main(["wordcount", "--workspace", str(tmp_path), "--rerun", "skip"], spark) == 0
    assert main(["nothing"], spark) == 2 and "wordcount" in APPS


def test_counters_and_status(spark):
    counts = Counters(spark)
    counts.observe(spark.range(7), "g", {"even": F.count_if(F.col("id") % 2 == 0)}).collect()
    assert counts.value("g", "even") == 4
    ticks = counts.counter("g", "ticks")
    spark.range(10, numPartitions=1).mapInArrow(every(4, lambda n: ticks.add(1)), "id long").collect()
    assert counts.value("g", "ticks") == 2
    status(spark, "testing")


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "n int, t string, k int").select("n", F.col("t").cast("timestamp").alias("t"), "k")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    live = stream(spark, str(tmp_path / "in"), "n int, t timestamp, k int", files_per_batch=1)
    wide = lambda d: windowed(d, "t", "10 minutes", "1 hour", ["k"], {"n": F.count(F.lit(1))})
    q = wide(live).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, wide(df).collect()))

    def step(key, state, frame):
        total = state[0] + int(frame["n"].sum())
        return (total,), frame.assign(total=total)[["k", "total"]].head(1)

    got = []
    q = each_batch(stateful_scan(live.select("k", "n"), ["k"], step, (0,), "k int, total long", "total long"), lambda d, i: got.extend(d.collect()), str(tmp_path / "check"))
    q.awaitTermination()
    assert max(r["total"] for r in got if r["k"] == 0) == sum(n for n, _, k in rows if k == 0)
    assert lines().fmt == "text"
