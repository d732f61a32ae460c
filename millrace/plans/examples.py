"""Example app: word frequencies of a folder of text, their number, and words cut short."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.codecs import csv, lines
from millrace.functions.text import prefix, words
from millrace.operators.stage import Stage, aggregate, map_only
from millrace.plans.pipeline import Pipeline, app
from millrace.sources.taps import tap

FREQUENCIES = "word string, cnt long"


def word_frequency() -> Stage:
    return aggregate("word frequency", ["word"], {"cnt": F.count(F.lit(1))}, mapper=lambda df: df.select(F.explode(words(F.col("value"))).alias("word")))


def word_total() -> Stage:
    return aggregate("word total", [], {"cnt": F.count(F.lit(1))})


def cut_short() -> Stage:
    return map_only("cut short", lambda df: df.select(*[prefix(F.col(c).cast("string"), 5).alias(c) for c in df.columns]))


@app("wordcount")
def wordcount(pipeline: Pipeline) -> None:
    """Reads ``input`` in the workspace; writes ``frequencies``, ``total`` and ``short`` there."""
    here = pipeline.workspace.rstrip("/")
    counts = tap(f"{here}/frequencies", csv(FREQUENCIES))
    pipeline.connect(word_frequency(), tap(f"{here}/input", lines()), counts)
    pipeline.connect(word_total(), counts, tap(f"{here}/total", csv("cnt long")))
    pipeline.connect(cut_short(), counts, tap(f"{here}/short", csv("word string, cnt string")))
