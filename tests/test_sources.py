import gzip

import pytest
from pyspark.sql import functions as F

from millrace.functions import codecs
from millrace.functions.text import prefix
from millrace.sources.fanout import Strategy, fan_out
from millrace.sources.files import Files
from millrace.sources.taps import binary_dir, concat, file_list, read_small, tagged, tap, taps, untagged


def test_lines_drop_one_trailing_tab_and_keep_returns(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"a\t\nb\n\t\nc\t\t\nx\r\nlast")
    got = [r["value"] for r in tap(str(tmp_path / "a.txt"), codecs.lines()).read(spark).collect()]
    assert got == ["a", "b", "", "c\t", "x\r", "last"]


def test_csv_round_trip(spark, tmp_path):
    rows = [("a,b", 'say "x"', 1), ("two\nlines", "", 2)]
    out = tap(str(tmp_path / "out"), codecs.csv("a string, b string, n int"))
    out.write(spark.createDataFrame(rows, "a string, b string, n int"))
    assert sorted((r["a"], r["b"] or "", r["n"]) for r in out.read(spark).collect()) == sorted(rows)


def test_csv_fields(spark):
    codec = codecs.csv_fields()
    df = spark.createDataFrame([('a,"b,""c""",,d',), ("",), ("x",)], "value string")
    got = codec.decode(df)
    assert [r["fields"] for r in got.collect()] == [["a", 'b,"c"', "", "d"], [""], ["x"]]
    assert [r["value"] for r in codec.encode(got).collect()] == ['a,"b,""c""",,d', "", "x"]


def test_fields_with_other_separators_and_nulls(spark):
    codec = codecs.csv_fields("|")
    df = spark.createDataFrame([("a|b|c",), ("|",)], "value string")
    assert [r["fields"] for r in codec.decode(df).collect()] == [["a", "b", "c"], ["", ""]]
    nulls = spark.createDataFrame([(["a", None, "b|c"],)], "fields array<string>")
    assert codec.encode(nulls).collect()[0]["value"] == 'a||"b|c"'
    for sep in ".^]":
        one = spark.createDataFrame([(["x", "y" + sep, ""],)], "fields array<string>")
        assert codecs.csv_fields(sep).decode(codecs.csv_fields(sep).encode(one)).collect()[0]["fields"] == ["x", "y" + sep, ""]


def test_keyed_lines_keep_null_segments_and_refuse_tabs(spark):
    codec = codecs.keyed_lines(2)
    rows = spark.createDataFrame([(None, "b", "v"), ("a", None, None)], "key_1 string, key_2 string, value string")
    assert [r["value"] for r in codec.encode(rows).collect()] == ["\tb\tv", "a\t\t"]
    with pytest.raises(Exception, match="holds a tab"):
        codec.encode(spark.createDataFrame([("a\tb", "c", "v")], "key_1 string, key_2 string, value string")).collect()


def test_csv_without_line_ends_has_many_readers(spark, tmp_path):
    rows = spark.range(20000).selectExpr("id", "repeat('x', 20) as t")
    out = tap(str(tmp_path / "c"), codecs.csv("id long, t string", multi_line=False))
    out.write(rows.coalesce(1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        assert out.read(spark).rdd.getNumPartitions() > 3 and out.read(spark).count() == 20000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_folders_within_folders_and_single_files(spark, tmp_path):
    (tmp_path / "d/e/f").mkdir(parents=True)
    (tmp_path / "d/e/f/x.txt").write_text("deep\n")
    (tmp_path / "d/y.txt").write_text("flat\n")
    assert {r["value"] for r in tap(str(tmp_path / "d"), codecs.lines()).read(spark).collect()} == {"deep", "flat"}
    one = tap(str(tmp_path / "out/one.csv"), codecs.csv("id long"))
    one.write(spark.range(10))
    assert (tmp_path / "out/one.csv").is_file() and one.read(spark).count() == 10
    with pytest.raises(FileExistsError):
        one.write(spark.range(3))
    one.write(spark.range(3), "overwrite")
    assert one.read(spark).count() == 3 and [p.name for p in (tmp_path / "out").iterdir() if "crc" not in p.name] == ["one.csv"]


def test_gzip(spark, tmp_path):
    out = tap(str(tmp_path / "out"), codecs.gzipped(codecs.lines()))
    out.write(spark.createDataFrame([("x",)], "value string"))
    assert any(p.name.endswith(".gz") for p in (tmp_path / "out").iterdir())
    assert read_small(out, spark)[0]["value"] == "x"
    with pytest.raises(ValueError):
        read_small(out, spark, most=0)


def test_bad_base64_fails_or_drops(spark):
    df = spark.createDataFrame([("YQ==",), ("%%%",), (None,)], "value string")
    assert [bytes(r["value"]) for r in codecs.base64_binary(on_bad=codecs.OnBad.DROP).decode(df).collect()] == [b"a"]
    with pytest.raises(Exception, match="can't decode"):
        codecs.base64_binary().decode(df).collect()


def test_structs_either_and_filter(spark, tmp_path):
    packed = codecs.base64_struct("a int, b string")
    df = spark.createDataFrame([((1, "x"),)], "value struct<a:int,b:string>")
    assert codecs.base64_struct("a int, b string, c int").decode(packed.encode(df)).collect()[0]["value"].asDict() == {"a": 1, "b": "x", "c": None}
    numbers = spark.createDataFrame([("12",), (" -3 ",), ("9" * 30,), ("x",), ("1.5",), (None,), ("9223372036854775807",)], "v string")
    assert [r[0] for r in numbers.select(codecs.as_long(F.col("v"))).collect()] == [12, -3, None, None, None, None, 2**63 - 1]
    both = codecs.either(lambda c: c.try_cast("int"), lambda c: F.when(c.startswith("t"), c), on_bad=codecs.OnBad.DROP)
    rows = both.decode(spark.createDataFrame([("1",), ("t",), ("?",)], "value string")).collect()
    assert [(r["tag"], r["left"], r["right"]) for r in rows] == [("left", 1, None), ("right", None, "t")]
    some = tap(str(tmp_path / "f"), codecs.filtered(codecs.lines(), F.col("value") != "no"))
    some.write(spark.createDataFrame([("no",), ("yes",)], "value string"))
    assert [r["value"] for r in some.read(spark).collect()] == ["yes"]
    upper = codecs.prism(lambda c: F.lower(c), lambda c: F.upper(c)).over(codecs.lines())
    tap(str(tmp_path / "u"), upper).write(spark.createDataFrame([("abc",)], "value string"))
    assert spark.read.text(str(tmp_path / "u")).collect()[0]["value"] == "ABC"
    assert tap(str(tmp_path / "u"), upper).read(spark).collect()[0]["value"] == "abc"
    json = tap(str(tmp_path / "j"), codecs.json_lines("a int, b array<string>"))
    json.write(spark.createDataFrame([(1, ["x"])], "a int, b array<string>"))
    assert json.read(spark).collect()[0]["b"] == ["x"]
    assert codecs.keyed_lines(1).encode(codecs.keyed_lines(1).decode(spark.createDataFrame([("k\tv\tw",)], "value string"))).collect()[0]["value"] == "k\tv\tw"


def test_binary_sources_gunzip_by_name(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.bin").write_bytes(b"\x00a")
    (tmp_path / "d/b.gz").write_bytes(gzip.compress(b"b"))
    (tmp_path / "d/skip").write_bytes(b"s")
    found = {r["path"].rsplit("/", 1)[-1]: bytes(r["content"]) for r in binary_dir(spark, str(tmp_path / "d"), lambda p: ~p.endswith("skip")).collect()}
    assert found == {"a.bin": b"\x00a", "b.gz": b"b"}
    (tmp_path / "list").write_text(f"{tmp_path}/d/b.gz\n\n{tmp_path}/d/a.bin\n")
    assert file_list(spark, str(tmp_path / "list")).count() == 2
    (tmp_path / "none").write_text("\n")
    assert file_list(spark, str(tmp_path / "none")).count() == 0


def test_unions(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.txt").write_text(f"{n}\n")
    a, b = (tap(str(tmp_path / f"{n}.txt"), codecs.lines()) for n in "ab")
    assert concat(a, b).read(spark).count() == 2 and taps([*a.paths, *b.paths], codecs.lines()).read(spark).count() == 2
    assert a == tap(a.paths[0], codecs.raw()) and a != b
    left, right = untagged(tagged(spark.range(2), spark.range(3)))
    assert (left.count(), right.count()) == (2, 3)


def test_fan_out(spark, tmp_path):
    rows = [("a/b", 1), ("a/b", 2), ("c=d e", 3), (None, 4)]
    stats = fan_out(spark.createDataFrame(rows, "t string, n int"), F.col("t"), str(tmp_path / "out"), stats=str(tmp_path / "stats"))
    assert {(r["path"], r["count"]) for r in stats.collect()} == {("a/b", 2), ("c=d e", 1), ("__null__", 1)}
    assert spark.read.parquet(str(tmp_path / "out/a/b")).count() == 2
    assert spark.read.parquet(str(tmp_path / "out/c=d e")).select("n").collect()[0]["n"] == 3
    assert not [p for p in tmp_path.iterdir() if "staging" in p.name]


def test_fan_out_to_targets_that_are_there(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "out")
    old = spark.createDataFrame([("a", 1), ("b", 2)], "t string, n int")
    new = spark.createDataFrame([("a", 3), ("c", 4)], "t string, n int")
    fan_out(old, F.col("t"), base)
    rows = lambda: sorted(r["n"] for r in spark.read.option("recursiveFileLookup", "true").parquet(base).collect())
    with pytest.raises(FileExistsError):
        fan_out(new, F.col("t"), base)
    assert rows() == [1, 2]
    # Moving fails midway: all is as before.
    real, calls = Files.rename, []

    def flaky(self, source, target):
        calls.append(target)
        return False if target.endswith("out/c") else real(self, source, target)

    monkeypatch.setattr(Files, "rename", flaky)
    with pytest.raises(OSError):
        fan_out(new, F.col("t"), base, replace=True)
    monkeypatch.undo()
    assert calls and rows() == [1, 2] and not [p for p in tmp_path.iterdir() if "staging" in p.name]
    stats = fan_out(new, F.col("t"), base, replace=True)
    assert rows() == [2, 3, 4] and {(r["path"], r["count"]) for r in stats.collect()} == {("a", 1), ("c", 1)}


def test_fan_out_strategies(spark, tmp_path):
    rows = spark.createDataFrame([("ab"[i // 2 % 2], i) for i in range(12)], "t string, n int").coalesce(1)
    fan_out(rows, F.col("t"), str(tmp_path / "runs"), "json", strategy=Strategy.RUNS)
    assert len(list((tmp_path / "runs/a").iterdir())) == 3 and spark.read.json(str(tmp_path / "runs/a")).count() == 6
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    fan_out(rows, F.col("t"), str(tmp_path / "open"), strategy=Strategy.OPEN)
    assert [r["n"] for r in spark.read.parquet(str(tmp_path / "open/b")).collect()] == [2, 3, 6, 7, 10, 11]
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before


def test_rows_are_computed_once_and_counted_as_written(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(50).mapInArrow(look, "id long")
    for fmt in ("parquet", "json"):
        fan_out(df, F.col("id") % 2, str(tmp_path / fmt), fmt)
    assert seen.value == 100


def test_failed_fan_out_publishes_nothing(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 0)], "t string, n int").withColumn("n", F.when(F.col("n") == 0, F.raise_error(F.lit("stop"))).otherwise(F.col("n")))
    with pytest.raises(Exception, match="stop"):
        fan_out(df, F.col("t"), str(tmp_path / "out"))
    assert not list(tmp_path.iterdir())


def test_files(spark, tmp_path):
    files = Files(spark, str(tmp_path))
    files.mkdir("d")
    (tmp_path / "local").write_text("x\ny\n")
    files.put(str(tmp_path / "local"), "d/f.txt")
    files.chmod("d/f.txt", "600")
    row = files.ls("d").collect()[0]
    assert row["size"] == 4 and row["perms"].startswith("rw-------") and row["path"].endswith("d/f.txt")
    assert files.cat("d/f.txt").count() == 2 and files.exists("d/f.txt")
    files.get("d/f.txt", str(tmp_path / "back"))
    assert (tmp_path / "back").read_text() == "x\ny\n"
    assert files.fresh() != files.fresh()
    files.delete("d")
    assert not files.exists("d") and files.ls("d").count() == 0


def test_prefix_counts_characters_or_bytes(spark):
    row = spark.createDataFrame([("éàbcdef",)], "v string").select(prefix(F.col("v"), 5).alias("c"), prefix(F.col("v"), 5, "bytes").alias("b")).collect()[0]
    assert row["c"] == "éàbcd" and bytes(row["b"]) == "éàb".encode()
