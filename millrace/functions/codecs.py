"""Codecs: how a dataset's rows are read from files and written to them.

A codec has a file format, options for reading and writing, and two transformations of DataFrames: from what the
format reads to rows, and from rows to what it writes.  Codecs compose by laying one's rows over another's.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]


def same(df: DataFrame) -> DataFrame:
    return df


class OnBad(Enum):
    """What becomes of rows that don't decode."""

    FAIL = "fail"
    DROP = "drop"
    NULL = "null"


@dataclass(frozen=True)
class Codec:
    fmt: str
    decode: Step = same
    encode: Step = same
    schema: str | None = None
    read_options: Mapping[str, str] = field(default_factory=dict)
    write_options: Mapping[str, str] = field(default_factory=dict)

    def read(self, spark: SparkSession, *paths: str) -> DataFrame:
        """Files, globs and folders; of folders also what is in their folders, but for Parquet, where those are
        partitions."""
        deep = {} if self.fmt == "parquet" else {"recursiveFileLookup": "true"}
        reader = spark.read.format(self.fmt).options(**{**deep, **self.read_options})
        if self.schema:
            reader = reader.schema(self.schema)
        return self.decode(reader.load(list(paths)))

    def write(self, df: DataFrame, path: str, mode: str = "errorifexists", single_file: bool = False, **options: str) -> None:
        made = self.encode(df)
        if single_file:
            made = made.coalesce(1)
        made.write.format(self.fmt).options(**{**self.write_options, **options}).mode(mode).save(path)

    def over(self, inner: Codec) -> Codec:
        """This codec's rows within the rows of ``inner``, whose format and options hold."""
        return replace(inner, decode=lambda df: self.decode(inner.decode(df)), encode=lambda df: inner.encode(self.encode(df)))

    def with_options(self, read: Mapping[str, str] | None = None, write: Mapping[str, str] | None = None) -> Codec:
        return replace(self, read_options={**self.read_options, **(read or {})}, write_options={**self.write_options, **(write or {})})


def _no_encode(df: DataFrame) -> DataFrame:
    raise TypeError("this codec only reads")


def raw() -> Codec:
    """Whole files: ``path, modificationTime, length, content``."""
    return Codec("binaryFile", encode=_no_encode)


def whole_text() -> Codec:
    return Codec("text", schema="value string", read_options={"wholetext": "true"})


def lines() -> Codec:
    """``value``: a line, without one tab at its end.  Lines end with a line feed alone; carriage returns stay."""
    return Codec("text", decode=lambda df: df.select(F.regexp_replace("value", "\t$", "").alias("value")), encode=lambda df: df.select("value"), schema="value string", read_options={"lineSep": "\n"}, write_options={"lineSep": "\n"})


def csv(schema: str, header: bool = False, sep: str = ",", multi_line: bool = True) -> Codec:
    """Quoted fields may hold separators and quotes, and line ends with ``multi_line``; without it large files are
    read in parts by many tasks."""
    options = {"sep": sep, "header": str(header).lower(), "escape": '"', "quote": '"'}
    return Codec("csv", schema=schema, read_options={**options, "multiLine": str(multi_line).lower(), "mode": "FAILFAST"}, write_options={**options, "emptyValue": "", "quoteAll": "false"})


def csv_fields(sep: str = ",") -> Codec:
    """``fields``: a line's separated fields, of any number, for rows that aren't known by name; ``sep`` is a character.

    A field in quotes may hold the separator and doubled quotes, not line ends.  A null field is written as an empty one.
    """
    cut = re.escape(sep)
    quoted = f'(?:^|(?<={cut}))(?:"((?:[^"]|"")*)"|([^{cut}"]*))(?={cut}|$)'

    def decode(df: DataFrame) -> DataFrame:
        whole = F.regexp_extract_all("value", F.lit(quoted), F.lit(0))
        return df.select(F.transform(whole, lambda f: F.when(f.startswith('"'), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f)).alias("fields"))

    def encode(df: DataFrame) -> DataFrame:
        cell = lambda f: F.when(f.isNull(), "").when(f.rlike(f'[{cut}"\n]'), F.concat(F.lit('"'), F.replace(f, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(f)
        return df.select(F.array_join(F.transform("fields", cell), sep).alias("value"))

    return Codec("text", decode, encode, "value string", {"lineSep": "\n"}, {"lineSep": "\n"})


def gzipped(inner: Codec) -> Codec:
    """Written with gzip; read by the files' extension."""
    return inner.with_options(write={"compression": "gzip"})


def shown(schema: str) -> Codec:
    """``value``, a struct of ``schema``, as one readable line of JSON each: for looking at, and read back."""
    kept = {"ignoreNullFields": "false"}
    return Codec("text", lambda df: df.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("value")), lambda df: df.select(F.to_json("value", kept).alias("value")), "value string", {"lineSep": "\n"}, {"lineSep": "\n"})


def parquet(schema: str | None = None) -> Codec:
    """The format for structured values; columns may be added later, and are null in older files."""
    return Codec("parquet", schema=schema, read_options={"mergeSchema": "true"} if schema is None else {})


def json_lines(schema: str) -> Codec:
    """Readable text of structured values."""
    return Codec("json", schema=schema, read_options={"mode": "FAILFAST"}, write_options={"ignoreNullFields": "false"})


def checked(value: Column, source: Column, on_bad: OnBad, what: str) -> Column:
    """A decoded value, where nulls come of input that doesn't decode."""
    if on_bad is OnBad.FAIL:
        return F.when(value.isNull() & source.isNotNull(), F.raise_error(F.concat(F.lit(f"{what}: can't decode "), source.cast("string")))).otherwise(value)
    return value


def prism(decode: Callable[[Column], Column], encode: Callable[[Column], Column], column: str = "value", on_bad: OnBad = OnBad.FAIL, what: str = "codec") -> Codec:
    """A partial codec of one column: ``decode`` gives null for what it can't read."""

    def read(df: DataFrame) -> DataFrame:
        value = decode(F.col(column))
        out = df.withColumn("_decoded", checked(value, F.col(column), on_bad, what))
        if on_bad is OnBad.DROP:
            out = out.filter(F.col("_decoded").isNotNull())
        return out.drop(column).withColumnRenamed("_decoded", column)

    return Codec("text", read, lambda df: df.withColumn(column, encode(F.col(column))), "value string")


def base64_binary(column: str = "value", on_bad: OnBad = OnBad.FAIL) -> Codec:
    """Binary values as base64 text."""
    return prism(lambda c: F.try_to_binary(c, F.lit("base64")), lambda c: F.base64(c), column, on_bad, "base64")


def base64_struct(schema: str, column: str = "value", on_bad: OnBad = OnBad.FAIL) -> Codec:
    """Structured values as base64 of their JSON; fields added to ``schema`` later read as null from older text."""
    decode = lambda c: F.from_json(F.try_to_binary(c, F.lit("base64")).cast("string"), schema, {"mode": "PERMISSIVE"})
    return prism(decode, lambda c: F.base64(F.encode(F.to_json(c), "utf-8")), column, on_bad, "base64 JSON")


def filtered(inner: Codec, condition: Column) -> Codec:
    """Rows that fail the condition are neither read nor written."""
    keep: Step = lambda df: df.filter(condition)
    return replace(inner, decode=lambda df: keep(inner.decode(df)), encode=lambda df: inner.encode(keep(df)))


def as_long(text: Column) -> Column:
    """An integer in decimal text, else null.  ``try_cast`` raises and catches an error for every other text, which is
    slow; only texts of digits get to it."""
    return F.when(text.rlike(r"^\s*[+-]?[0-9]{1,18}\s*$"), text.cast("long")).when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), text.try_cast("long"))


def either(left: Callable[[Column], Column], right: Callable[[Column], Column], column: str = "value", on_bad: OnBad = OnBad.FAIL) -> Codec:
    """Text read by one decoder or else by another: ``tag`` (left or right), ``left`` and ``right``."""

    def read(df: DataFrame) -> DataFrame:
        a, b = left(F.col(column)), right(F.col(column))
        tag = F.when(a.isNotNull(), "left").when(b.isNotNull(), "right")
        out = df.select(checked(tag, F.col(column), on_bad, "either").alias("tag"), a.alias("left"), F.when(a.isNull(), b).alias("right"))
        return out.filter(F.col("tag").isNotNull()) if on_bad is OnBad.DROP else out

    return Codec("text", read, lambda df: df.select(F.coalesce(F.col("left").cast("string"), F.col("right").cast("string")).alias(column)), "value string")


def keyed_lines(count: int) -> Codec:
    """Lines of ``count`` tab-separated key segments and a value, which may hold tabs: ``key_1 .. value``.

    Nulls are written as empty text, and keep their place; a key with a tab or a line end can't be written and fails.
    """
    from millrace.operators.keys import segments_of

    def read(df: DataFrame) -> DataFrame:
        segments, rest = segments_of(F.col("value"), count)
        return df.select(*[s.alias(f"key_{i + 1}") for i, s in enumerate(segments)], rest.alias("value"))

    def write(df: DataFrame) -> DataFrame:
        text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
        segments = [text(f"key_{i + 1}") for i in range(count)]
        fit = [F.when(s.rlike("[\t\n]"), F.raise_error(F.concat(F.lit("keyed lines: a key holds a tab or line end: "), s))).otherwise(s) for s in segments]
        return df.select(F.concat(*[x for s in fit for x in (s, F.lit("\t"))], text("value")).alias("value"))

    return Codec("text", read, write, "value string", {"lineSep": "\n"}, {"lineSep": "\n"})
