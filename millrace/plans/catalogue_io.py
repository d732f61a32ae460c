"""Registered queries that write and read back: codecs, taps, fan-out, pipelines, options, effects.

What a query writes goes to a folder of its own in the scratch folder; its result is what is read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import codecs
from millrace.functions.text import prefix, words
from millrace.operators import grouped, keys, monoids
from millrace.operators.grouped import OnError
from millrace.operators.keys import key, numeric
from millrace.operators.stage import Stage, aggregate, combiner_agrees, map_only, over_groups, reduce_by, reduce_with, spread, tee_first
from millrace.plans.catalogue import counted, query, table
from millrace.plans.metrics import Counters, every, status
from millrace.plans.pipeline import APPS, OutputExists, Pipeline, Rerun, StageTimeout, app, main
from millrace.plans.session import scratch
from millrace.sources.fanout import Strategy, fan_out
from millrace.sources.files import Files
from millrace.sources.taps import binary_dir, concat, file_list, read_small, tap, taps


def place(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def round_trip(spark: SparkSession, codec: codecs.Codec, df: DataFrame, name: str) -> DataFrame:
    out = tap(place(spark, name), codec)
    out.write(df)
    return out.read(spark)


# Codecs, through files.

_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS value FROM documents WHERE text IS NOT NULL"


@query(f"SELECT regexp_replace(value, '\\t$', '') AS value FROM ({_LINES})")
def lines_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines out and in; one tab at a line's end is dropped when it is read."""
    rows = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    return round_trip(spark, codecs.lines(), rows, "lines")


@query("SELECT c_custkey, c_name || ', \"' || c_mktsegment || '\"' AS c_name, c_acctbal FROM customer")
def csv_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("c_name"), "c_acctbal")
    return round_trip(spark, codecs.csv("c_custkey long, c_name string, c_acctbal double"), rows, "csv")


@query("SELECT p_partkey, p_name || '|' || p_brand AS p_name FROM part")
def csv_of_single_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a header and another separator; without line ends in fields, so that one file has many readers."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("|", "p_name", "p_brand").alias("p_name"))
    return round_trip(spark, codecs.csv("p_partkey long, p_name string", header=True, sep="|", multi_line=False), rows, "csv-single")


@query("SELECT o_orderkey, o_orderstatus || '|' || o_orderpriority AS a, '' AS b FROM orders")
def csv_fields_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of fields that aren't known by name, separated by bars; a null field comes back empty, in its place."""
    rows = table(spark, sf_dir, "orders").select(F.array(F.col("o_orderkey").cast("string"), F.lit(None).cast("string"), F.concat_ws("|", "o_orderstatus", "o_orderpriority")).alias("fields"))
    back = round_trip(spark, codecs.csv_fields("|"), rows, "fields")
    return back.select(F.col("fields")[0].cast("long").alias("o_orderkey"), F.col("fields")[2].alias("a"), F.col("fields")[1].alias("b"))


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY event_type")
def gzip_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = round_trip(spark, codecs.gzipped(codecs.lines()), table(spark, sf_dir, "events").select(F.col("event_type").alias("value")), "gzip")
    return aggregate("count", ["value"], {"n": counted()})(back)


@query("SELECT n_nationkey, n_name, NULL::VARCHAR AS added FROM nation")
def versioned_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by an older schema, read by a newer one with a field more."""
    out = place(spark, "versioned")
    tap(out, codecs.parquet()).write(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    return tap(out, codecs.parquet("n_nationkey int, n_name string, added string")).read(spark)


@query("SELECT n_nationkey, n_name, NULL::VARCHAR AS added FROM nation")
def versioned_text_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as base64 text of structures, laid over lines."""
    out = place(spark, "versioned-text")
    rows = table(spark, sf_dir, "nation").select(F.struct("n_nationkey", "n_name").alias("value"))
    tap(out, codecs.base64_struct("n_nationkey int, n_name string").over(codecs.lines())).write(rows)
    return tap(out, codecs.base64_struct("n_nationkey int, n_name string, added string").over(codecs.lines())).read(spark).select("value.*")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def json_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, codecs.json_lines("s_suppkey long, s_name string, s_acctbal double"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), "json")


@query("SELECT r_regionkey, r_name FROM region")
def show_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "region").select(F.struct("r_regionkey", "r_name").alias("value"))
    return round_trip(spark, codecs.shown("r_regionkey int, r_name string"), rows, "show").select("value.*")


@query("SELECT user_id, CAST(user_id AS VARCHAR) AS shown FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def show_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = aggregate("users", ["user_id"], {"n": counted()}) >> map_only("show", lambda df: df.select("user_id", keys.int_key(F.col("user_id")).alias("shown")))
    return stage(table(spark, sf_dir, "events"))


@query("SELECT upper(c_mktsegment) AS value, count(*) AS n FROM customer GROUP BY ALL")
def composed_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitals over base64 over gzipped lines."""
    packed = codecs.base64_binary().over(codecs.gzipped(codecs.lines()))
    text = codecs.prism(lambda c: F.upper(F.decode(c, "utf-8")), lambda c: F.encode(F.lower(c), "utf-8")).over(packed)
    back = round_trip(spark, text, table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("value")), "composed")
    return aggregate("count", ["value"], {"n": counted()})(back)


@query("SELECT event_id FROM events WHERE event_type <> 'error'")
def drop_undecodable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose value isn't base64 are dropped on reading; the others hold their id."""
    codec = codecs.base64_binary(on_bad=codecs.OnBad.DROP).over(codecs.lines())
    bad = F.when(F.col("event_type") == "error", F.lit("%%%")).otherwise(F.base64(F.encode(F.col("event_id").cast("string"), "utf-8")))
    out = place(spark, "undecodable")
    tap(out, codecs.lines()).write(table(spark, sf_dir, "events").select(bad.alias("value")))
    return tap(out, codec).read(spark).select(F.decode("value", "utf-8").cast("long").alias("event_id"))


@query("SELECT coalesce(CAST(user_id AS VARCHAR), '') AS key_1, event_type AS key_2, CAST(event_id AS VARCHAR) || chr(9) || 'x' AS value FROM events")
def keyed_lines_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written and read: a null segment is empty and keeps its place, the value keeps its tabs."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key_1"), F.col("event_type").alias("key_2"), F.concat(F.col("event_id").cast("string"), F.lit("\tx")).alias("value"))
    return round_trip(spark, codecs.keyed_lines(2), rows, "keyed")


@query("SELECT CAST(count(*) AS BIGINT) AS files, CAST(sum(octet_length(encode(r_name)) + 1) AS BIGINT) AS bytes FROM region")
def raw_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files, one for each region, by their length."""
    base = place(spark, "raw")
    fan_out(table(spark, sf_dir, "region").select("r_name"), F.col("r_name"), base, "text")
    files = tap(f"{base}/[A-Z]*/part-*", codecs.raw()).read(spark)
    return files.agg(counted().alias("files"), F.sum(F.length("content")).cast("long").alias("bytes"))


# Taps and files.


@query("SELECT n_name AS value FROM nation UNION ALL SELECT r_name FROM region")
def several_taps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations of one codec, read as one; written, it is the first."""
    both = taps([place(spark, "nations"), place(spark, "regions")], codecs.lines())
    both.write(table(spark, sf_dir, "nation").select(F.col("n_name").alias("value")))
    tap(both.paths[1], codecs.lines()).write(table(spark, sf_dir, "region").select(F.col("r_name").alias("value")))
    return both.read(spark)


@query("SELECT r_regionkey, r_name FROM region")
def read_tap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small dataset on the driver, and back from there."""
    rows = read_small(tap(f"{sf_dir}/region.parquet", codecs.parquet("r_regionkey int, r_name string")), spark, most=100)
    return spark.createDataFrame([tuple(r) for r in rows], "r_regionkey int, r_name string")


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY event_type")
def recursive_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in folders within the folder that is read."""
    base = place(spark, "deep")
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("value"))
    fan_out(events, F.concat(F.lit("a/b/"), "value"), base, "text")
    return aggregate("count", ["value"], {"n": counted()})(tap(f"{base}/a", codecs.lines()).read(spark))


@query("SELECT event_type AS value, count(*) AS n FROM events WHERE event_type LIKE 'c%' GROUP BY event_type")
def globbed_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = place(spark, "glob")
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("value"))
    fan_out(events, F.col("value"), base, "text")
    return aggregate("count", ["value"], {"n": counted()})(tap(f"{base}/c*", codecs.lines()).read(spark))


@query("SELECT o_orderstatus AS name, CAST(sum(octet_length(encode(o_orderpriority)) + 1) AS BIGINT) AS bytes FROM orders GROUP BY ALL")
def binary_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of gzipped files, unpacked by their names: the bytes below each folder."""
    base = place(spark, "binary")
    fan_out(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus").select(F.col("o_orderpriority").alias("value"), F.col("o_orderstatus").alias("t")), F.col("t"), base, "csv", compression="gzip", header="false")
    files = binary_dir(spark, base, pattern="part-*.gz").select(F.element_at(F.split("path", "/"), -2).alias("name"), "content")
    per_file = files.select("name", (F.length("content") - 2 * F.size(F.filter(F.split(F.decode("content", "utf-8"), "\n"), lambda x: x != ""))).alias("b"))
    return per_file.groupBy("name").agg(F.sum("b").cast("long").alias("bytes"))


@query("SELECT r_name AS name, CAST(octet_length(encode(r_name)) + 1 AS BIGINT) AS bytes FROM region WHERE r_name LIKE 'A%'")
def files_of_a_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a text file names, one a line."""
    base = place(spark, "listed")
    fan_out(table(spark, sf_dir, "region").select("r_name"), F.col("r_name"), base, "text")
    names = Files(spark).ls(f"{base}/A*").filter(F.col("path").contains("/part-")).select("path")
    listing = place(spark, "listing")
    tap(listing, codecs.lines()).write(names.withColumnRenamed("path", "value"))
    files = file_list(spark, listing)
    return files.select(F.regexp_extract("path", "([^/]+)/part-", 1).alias("name"), F.length("content").cast("long").alias("bytes"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY ALL")
def single_file_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path with an extension is one file."""
    out = tap(f"{place(spark, 'single')}.csv", codecs.csv("c_mktsegment string, n long"))
    out.write(aggregate("segments", ["c_mktsegment"], {"n": counted()})(table(spark, sf_dir, "customer")))
    if Files(spark)._open(out.paths[0])[0].getFileStatus(Files(spark)._open(out.paths[0])[1]).isDirectory():
        raise AssertionError("not a file")
    return out.read(spark)


@query("SELECT 'kept' AS name, count(*) AS n FROM nation")
def file_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders made, a dataset moved, its copy deleted, its lines read."""
    files = Files(spark, place(spark, "files"))
    files.mkdir("one")
    tap(files.at("one/a"), codecs.lines()).write(table(spark, sf_dir, "nation").select(F.col("n_name").alias("value")))
    files.rename("one/a", "two/b")
    gone = not files.exists("one/a") and files.complete("two/b")
    files.delete("one")
    name = F.lit("kept" if gone and not files.exists("one") else "lost")
    return files.cat("two/b").groupBy(name.alias("name")).agg(counted().alias("n"))


@query("SELECT r_name AS name, CAST(octet_length(encode(r_name)) + 1 AS BIGINT) AS size FROM region")
def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and sizes as the listing has them."""
    base = place(spark, "ls")
    fan_out(table(spark, sf_dir, "region").select("r_name"), F.col("r_name"), base, "text")
    listed = Files(spark).ls(f"{base}/[A-Z]*").filter(F.col("path").contains("/part-"))
    return listed.select(F.regexp_extract("path", "([^/]+)/part-", 1).alias("name"), "size")


@query("SELECT CAST(3 AS BIGINT) AS places, count(*) AS n FROM nation")
def temporary_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three temporary taps in a workspace, none in another's place."""
    pipeline = Pipeline(spark, "places", place(spark, "workspace"))
    made = [pipeline.temporary() for _ in range(3)]
    for t in made:
        pipeline.connect(map_only("copy", lambda df: df), table(spark, sf_dir, "nation"), t)
    return made[0].read(spark).agg(F.lit(len({t.paths for t in made})).cast("long").alias("places"), counted().alias("n"))


# Fan-out.


@query("SELECT event_type AS path, count(*) AS count FROM events GROUP BY event_type")
def fanout_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published twice to one place: the second time replaces the first."""
    base = place(spark, "again")
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    fan_out(events.limit(10), F.col("event_type"), base)
    fan_out(events, F.col("event_type"), base, replace=True)
    read = spark.read.option("recursiveFileLookup", "true").parquet(base)
    return read.groupBy(F.col("event_type").alias("path")).agg(counted().alias("count"))


@query("SELECT o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY ALL")
def fanout_open_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the files of all targets open, rows stay in their order."""
    base = place(spark, "open")
    fan_out(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), F.col("o_orderpriority"), base, strategy=Strategy.OPEN)
    read = spark.read.option("recursiveFileLookup", "true").parquet(base)
    return read.groupBy(F.col("o_orderpriority").alias("priority")).agg(counted().alias("n"))


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY ALL")
def fanout_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each run of rows with one target."""
    base = place(spark, "runs")
    fan_out(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), F.col("n_regionkey"), base, strategy=Strategy.RUNS)
    return spark.read.option("recursiveFileLookup", "true").parquet(base).groupBy("n_regionkey").agg(counted().alias("n"))


@query("SELECT event_type AS path, count(*) AS count FROM events GROUP BY event_type")
def fanout_csv_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that a fan-out of text writes to a place of their own."""
    stats = place(spark, "stats")
    fan_out(table(spark, sf_dir, "events").select("event_id", "event_type"), F.col("event_type"), place(spark, "csv"), "csv", stats=stats, rows_per_file=1000)
    return tap(stats, codecs.csv("path string, count long")).read(spark)


# Pipelines.


def tally(spark: SparkSession, sf_dir: str) -> tuple[Stage, DataFrame]:
    return aggregate("tally", ["event_type"], {"n": counted()}), table(spark, sf_dir, "events").select("event_type")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def connect_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage into a named output, read back."""
    stage, rows = tally(spark, sf_dir)
    return Pipeline(spark, "connected").connect(stage, rows, tap(place(spark, "connected"), codecs.parquet()))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def union_of_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage over several inputs reads them as one."""
    stage, rows = tally(spark, sf_dir)
    parts = [rows.filter("event_type = 'view'"), rows.filter("event_type != 'view'")]
    return Pipeline(spark, "union").connect(stage, parts, tap(place(spark, "union"), codecs.csv("event_type string, n long")))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def rerun_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second stage isn't run, as its output is there: the first one's rows come back."""
    stage, rows = tally(spark, sf_dir)
    out = tap(place(spark, "skip"), codecs.parquet())
    pipeline = Pipeline(spark, "skips", rerun=Rerun.SKIP)
    pipeline.connect(stage, rows, out)
    return pipeline.connect(stage, rows.limit(0), out)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def rerun_replaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage, rows = tally(spark, sf_dir)
    out = tap(place(spark, "rerun"), codecs.parquet())
    pipeline = Pipeline(spark, "reruns", rerun=Rerun.RERUN)
    pipeline.connect(stage, rows.limit(3), out)
    return pipeline.connect(stage, rows, out)


@query("SELECT 'refused' AS said, event_type, count(*) AS n FROM events GROUP BY event_type")
def rerun_fails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By default an output that is there is an error, and stays as it was."""
    stage, rows = tally(spark, sf_dir)
    out = tap(place(spark, "fails"), codecs.parquet())
    pipeline = Pipeline(spark, "fails")
    pipeline.connect(stage, rows, out)
    try:
        pipeline.connect(stage, rows.limit(0), out)
        said = "overwritten"
    except OutputExists:
        said = "refused"
    return out.read(spark).withColumn("said", F.lit(said))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def rerun_after_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An output without its success mark is what a failed job left: it is made anew under any policy."""
    stage, rows = tally(spark, sf_dir)
    out = tap(place(spark, "failed"), codecs.parquet())
    pipeline = Pipeline(spark, "failed", rerun=Rerun.SKIP)
    pipeline.connect(stage, rows.limit(3), out)
    pipeline.files.delete(f"{out.paths[0]}/_SUCCESS")
    return pipeline.connect(stage, rows, out)


@query("SELECT substring(word, 1, 5) AS word, substring(CAST(cnt AS VARCHAR), 1, 5) AS cnt FROM (SELECT word, count(*) AS cnt FROM (SELECT unnest(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+')) AS word FROM documents) WHERE word <> '' GROUP BY word)")
def app_on_a_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered program started by its name: three stages over files of its workspace, the last of them read."""
    import millrace.plans.examples  # noqa: F401

    here = place(spark, "app")
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    tap(f"{here}/input", codecs.lines()).write(lines)
    if main(["wordcount", "--workspace", here, "--rerun", "fail"], spark):
        raise AssertionError("the app failed")
    return tap(f"{here}/short", codecs.csv("word string, cnt string")).read(spark)


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL")
def single_step_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program of one stage."""
    out = tap(place(spark, "single-step"), codecs.parquet())
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag")

    @app("singlestep")
    def program(pipeline: Pipeline) -> None:
        pipeline.connect(aggregate("flags", ["l_returnflag"], {"n": counted()}), rows, out)

    main(["singlestep"], spark)
    APPS.pop("singlestep")
    return out.read(spark)


@query("SELECT 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation")
def effects_of_the_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects run where the program gets to them, once each, in order."""
    pipeline, seen = Pipeline(spark, "effects"), []
    for name in ("region", "nation"):
        status(spark, f"counting {name}")
        pipeline.io(lambda: seen.append((name, table(spark, sf_dir, name).count())))  # noqa: B023
    spark.sparkContext.setJobDescription(None)
    return spark.createDataFrame(seen, "name string, n long")


@query("SELECT n_nationkey, n_name FROM nation")
def effects_of_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An effect in every task that reads the rows, which stay as they are."""
    pipeline, seen = Pipeline(spark, "workers"), spark.sparkContext.accumulator(0)
    rows = pipeline.on_nodes(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), lambda: seen.add(1))
    out = pipeline.connect(map_only("copy", lambda df: df), rows, pipeline.temporary())
    if not seen.value:
        raise AssertionError("no effect")
    return out


@query("SELECT p_partkey, CASE WHEN p_size < 25 THEN 'small' ELSE 'large' END AS size FROM part")
def shipped_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value computed once on the driver and read in tasks."""
    names = Pipeline(spark, "shipped").shipped("names", lambda: {True: "small", False: "large"})

    def named(rows):
        for r in rows:
            yield {"p_partkey": r["p_partkey"], "size": names.value[r["p_size"] < 25]}

    return grouped.map_rows(table(spark, sf_dir, "part").select("p_partkey", "p_size"), named, "p_partkey long, size string")


# Options.


@query("SELECT l_suppkey, count(*) AS n, CAST(5 AS INTEGER) AS tasks FROM lineitem GROUP BY ALL")
def reduce_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options edited after the stage was made: column stages have as many reducing tasks as they say."""
    out = aggregate("suppliers", ["l_suppkey"], {"n": counted()}).having(reduce_tasks=5)(table(spark, sf_dir, "lineitem"))
    return out.withColumn("tasks", F.lit(out.rdd.getNumPartitions()))


@query("SELECT l_suppkey, count(*) AS n, CAST(3 AS INTEGER) AS tasks FROM lineitem GROUP BY ALL")
def map_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen: list[int] = []

    def partitions(df: DataFrame) -> DataFrame:
        seen.append(df.rdd.getNumPartitions())
        return df

    out = (partitions >> aggregate("suppliers", ["l_suppkey"], {"n": counted()})).having(map_tasks=3)(table(spark, sf_dir, "lineitem"))
    return out.withColumn("tasks", F.lit(seen[0]))


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def output_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compression and separator of a stage's output."""
    stage = aggregate("priorities", ["o_orderpriority"], {"n": counted()}).having(compression="gzip", separator=";")
    out = place(spark, "options")
    Pipeline(spark, "options").connect(stage, table(spark, sf_dir, "orders"), tap(out, codecs.csv("o_orderpriority string, n long")))
    if not Files(spark).ls(out).filter(F.col("path").endswith(".gz")).count():
        raise AssertionError("not compressed")
    return tap(out, codecs.csv("o_orderpriority string, n long", sep=";")).read(spark)


@query("SELECT 'stopped' AS said, r_name FROM region")
def stage_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage that takes too long is cancelled."""
    import time

    def slow(rows):
        for r in rows:
            time.sleep(20)
            yield r

    regions = table(spark, sf_dir, "region").select("r_name")
    stage = map_only("slow", lambda df: grouped.map_rows(df, slow, "r_name string")).having(timeout_s=1.0)
    pipeline = Pipeline(spark, "timeout")
    try:
        pipeline.connect(stage, regions, pipeline.temporary())
        said = "ran"
    except StageTimeout:
        said = "stopped"
    return regions.withColumn("said", F.lit(said))


def failing(key: tuple, rows):
    """Counts of a group's rows; fails for the group of errors."""
    if key[0] == "error":
        raise ValueError("an error group")
    yield {"event_type": key[0], "n": sum(1 for _ in rows)}


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY event_type")
def skip_failing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy is an option edited after the stage was made."""
    stage = reduce_with("counts", key("event_type"), failing, "event_type string, n long").having(on_error=OnError.SKIP_KEY)
    return stage(table(spark, sf_dir, "events").select("event_type"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def retry_failing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first try of each group fails after it has read some rows."""

    def once_bad(k: tuple, rows):
        tried = once_bad.__dict__.setdefault("tried", set())
        n = 0
        for _ in rows:
            n += 1
            if k not in tried:
                tried.add(k)
                raise ValueError("first try")
        yield {"event_type": k[0], "n": n}

    stage = reduce_with("counts", key("event_type"), once_bad, "event_type string, n long").having(on_error=OnError.RETRY)
    return stage(table(spark, sf_dir, "events").select("event_type"))


@query("SELECT 'rethrown' AS said, r_name FROM region")
def rethrow_failing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = reduce_with("counts", key("event_type"), failing, "event_type string, n long")
    try:
        stage(table(spark, sf_dir, "events").select("event_type")).collect()
        said = "ran"
    except Exception as e:
        said = "rethrown" if "key ('error',)" in str(e) else str(e)
    return table(spark, sf_dir, "region").select(F.lit(said).alias("said"), "r_name")


@query("SELECT p_partkey, unnest([p_brand, p_type]) AS value FROM part")
def spread_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows dealt out evenly, with no key, then mapped."""
    rows = spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), 7)
    return rows.select("p_partkey", F.explode(F.array("p_brand", "p_type")).alias("value"))


@query("SELECT CAST(1 AS BIGINT) AS heads, count(*) AS n FROM supplier")
def snapshot_of_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row is written aside, all rows go on."""
    out = place(spark, "head")
    rows = tee_first(table(spark, sf_dir, "supplier"), out)
    return rows.agg(F.lit(spark.read.json(out).count()).cast("long").alias("heads"), counted().alias("n"))


@query("SELECT CAST(count(*) // 1000 AS BIGINT) AS calls, count(*) AS n FROM events")
def effect_every_so_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An effect at every thousandth row of a task; one task reads all rows here."""
    seen = spark.sparkContext.accumulator(0)
    rows = table(spark, sf_dir, "events").select("event_id").coalesce(1)
    n = rows.mapInArrow(every(1000, lambda _: seen.add(1)), rows.schema).count()
    return spark.createDataFrame([(seen.value, n)], "calls long, n long")


@query("SELECT 'plain' AS name, count(*) AS n FROM orders UNION ALL SELECT 'urgent', count(*) FROM orders WHERE o_orderpriority = '1-URGENT'")
def counters_of_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters that Python code adds to."""
    counts = Counters(spark)
    plain, urgent = counts.counter("orders", "plain"), counts.counter("orders", "urgent")

    def look(rows):
        for r in rows:
            plain.add(1)
            if r["o_orderpriority"] == "1-URGENT":
                urgent.add(1)
            yield r

    grouped.map_rows(table(spark, sf_dir, "orders").select("o_orderpriority"), look, "o_orderpriority string").write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(n, counts.value("orders", n)) for n in ("plain", "urgent")], "name string, n long")


# Keys, monoids, bytes.


@query("SELECT doc_id, substring(hex(encode(text)), 1, 10) AS head FROM documents")
def first_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.hex(prefix(F.col("text"), 5, "bytes")).alias("head"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS k, ts AS back FROM events")
def instant_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants as keys in UTC, and back."""
    seconds = F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp"))
    told = table(spark, sf_dir, "events").select("event_id", keys.utc_key(F.timestamp_micros(seconds)).alias("k"))
    return told.withColumn("back", keys.time_of_key(F.col("k")))


@query("SELECT l_orderkey + 9007199254740992 AS big, CAST(row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS BIGINT) AS place, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 48")
def numbers_beyond_doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers above 2^53 in the order of numbers."""
    rows = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_quantity > 48").select(F.lit(1).alias("one"), (F.col("l_orderkey") + (1 << 53)).alias("big"), "l_linenumber")
    stage = over_groups("places", key("one", numeric("big"), numeric("l_linenumber"), group=1), {"place": lambda w: F.row_number().over(w).cast("long")})
    return stage(rows).select("big", "place", "l_linenumber")


@query("SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE user_id IS NOT NULL")
def whole_group_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns over all of a group."""
    stage = over_groups("sizes", key("user_id"), {"n": lambda w: F.count(F.lit(1)).over(w)}, running=False)
    return stage(table(spark, sf_dir, "events").select("user_id", "event_id"))


@query("SELECT o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS running, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey")
def streamed_reducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python reducer with a state, over groups of any size, of which only the last state is told."""

    def last(k: tuple, rows):
        total = n = 0
        for r in rows:
            total, n = total + r["cents"], n + 1
        yield {"o_custkey": k[0], "running": total, "n": n}

    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return reduce_with("totals", key("o_custkey", numeric("o_orderkey"), group=1), last, "o_custkey long, running long, n long")(rows)


@query("SELECT event_type, arg_min(event_id, event_id) AS first, count(DISTINCT user_id) AS users FROM events WHERE user_id IS NOT NULL GROUP BY event_type")
def monoid_of_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps from user to event, of which each key's first stays."""
    users = monoids.map_of("bigint", "bigint")
    rows = table(spark, sf_dir, "events").filter("user_id is not null").select("event_type", "event_id", F.create_map("user_id", "event_id").alias("m"))
    out = reduce_by("maps", ["event_type"], users, F.col("m"), F.col("event_id"), out="m")(rows)
    return out.select("event_type", F.array_min(F.map_values("m")).alias("first"), F.size("m").cast("long").alias("users"))


@query("SELECT true AS agrees, count(*) AS n FROM lineitem")
def law_of_combiners(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("long").alias("q"))
    return rows.agg(F.lit(combiner_agrees(rows, ["l_returnflag"], monoids.sum_(), "q")).alias("agrees"), counted().alias("n"))


@query("SELECT word, count(*) AS cnt FROM (SELECT unnest(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+')) AS word FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark)) WHERE word <> '' GROUP BY word")
def words_of_two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taps of different codecs, concatenated into one stage."""
    one = lambda t: tap(f"{sf_dir}/{t}.parquet", codecs.Codec("parquet", decode=lambda df: df.select(F.explode(words(F.col("text"))).alias("word"))))
    return Pipeline(spark, "twosources").lazily(aggregate("word count", ["word"], {"cnt": counted()}), concat(one("documents"), one("benchmark")))
