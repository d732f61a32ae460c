"""The corpus pipeline: toxicity, near duplicates, repeated passages, packing.

Each stage takes the documents that its predecessor kept and returns documents; the last returns where each piece of
each document is packed.  A stage's decisions take effect: rejected documents go, of each group of near copies the one
of smallest key stays, repeated passages are cut out of the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import near, packing, suffixes, toxicity
from millrace.llm.common import durable, key_of, small_batches, spread_join, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.3, in whole.  The grammar is fitted on the documents given and their labels."""
    small_batches(spark)
    grammar = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs.select(*COLUMNS), grammar)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 or more, the one of smallest key.

    Rows that share a key and a text are one document, and one of them stays; rows without a key come before all others.
    """
    small_batches(spark)
    classes = near.near_classes(docs.select("doc_id", "text"))
    stays = durable(classes.filter((F.col("k") == F.col("class_k")) & (F.col("h") == F.col("class_h"))).select("k", "h").distinct(), "near-stays")
    told = docs.select(*COLUMNS, key_of("doc_id").alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    kept = spread_join(told, stays, ["k", "h"], "left_semi")
    # Which of them stays doesn't depend on the order of rows; a task keeps one before any are brought together.
    one = kept.groupBy("k", "h").agg(F.min(F.struct(*COLUMNS)).alias("one"))
    return one.select(*[F.col(f"one.{c}").alias(c) for c in COLUMNS])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 100 bytes or more that start earlier in the corpus, ``n_chars`` counted anew.

    Bytes of a character that is cut in two are dropped with it.  A document that repeats others throughout stays,
    with an empty text.
    """
    small_batches(spark)
    done = suffixes.remove_repeats(docs, keep=("lang", "source"))
    text = suffixes.readable(done, "kept", "text")
    return text.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, each with its bin, the bin's length and its place there; tokens are UTF-8 bytes."""
    small_batches(spark)
    return packing.assign(docs, packing.bytes_and_end(F.col("text")))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", one_of_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("best-fit packing", pack),
]

#: The stages are learnt, iterative or sequential; tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = durable(docs, f"pipeline-{number}")
    return docs
