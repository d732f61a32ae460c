"""The queries of the training-data operators, with production parameters, and their DuckDB SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import durable, fresh, key_of, small_batches, spread_join, table
from millrace.llm.license_sql import license_sql
from millrace.llm.licenses import LicenseIndex
from millrace.llm.oracles import near_sql, repeats_sql


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.toxicity import learn, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.url_rules import judge

    return judge(table(spark, sf_dir, "pages"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is counted by words and by byte pairs; then words are recounted under a new version, copies of a
    text but the first are deleted, and the first batch is sent again."""
    import public_tokenizers
    from pyspark.sql import functions as F

    from millrace.llm import token_rollup as rollup

    docs = table(spark, sf_dir, "documents")
    by_words = docs.select("doc_id", "source", "lang", F.md5(F.coalesce("text", F.lit(""))).alias("same"), rollup.words(F.col("text")).alias("words"), rollup.letters(F.col("text")).alias("letters"), "text")
    counts = rollup.bpe(by_words, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, out="pairs")
    return _rollup(spark, durable(counts, "token-counts"), {"words-1": "words", "bpe-50k-1": "pairs"}, {"words-1": ("words-2", "letters")})


def token_rollup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op4_token_rollup`` over the tokenizers that SQL can express."""
    from pyspark.sql import functions as F

    from millrace.llm import token_rollup as rollup

    docs = table(spark, sf_dir, "documents")
    counts = docs.select("doc_id", "source", "lang", F.md5(F.coalesce("text", F.lit(""))).alias("same"), rollup.words(F.col("text")).alias("words"), rollup.letters(F.col("text")).alias("letters"))
    return _rollup(spark, durable(counts, "token-counts"), {"words-1": "words"}, {"words-1": ("words-2", "letters")})


def _rollup(spark: SparkSession, counts: DataFrame, versions: dict[str, str], recounted: dict[str, tuple[str, str]]) -> DataFrame:
    from functools import reduce

    from pyspark.sql import functions as F

    from millrace.llm.token_rollup import TokenRollup, changes

    def side(version: str, tokens: str) -> dict:
        return {"source": F.col("source"), "lang": F.col("lang"), "version": F.lit(version), "tokens": F.col(tokens)}

    store = TokenRollup(spark, fresh(spark, "rollup"), fold_every=2)
    all_of = lambda parts: reduce(DataFrame.unionByName, parts)
    ingest = all_of([changes(counts, "insert", new=side(v, c)) for v, c in versions.items()])
    store.commit("1-ingest", ingest)
    store.commit("2-recount", all_of([changes(counts, "revise", new=side(w, d), old=side(v, versions[v])) for v, (w, d) in recounted.items()]))
    live = dict(recounted.get(v, (v, c)) for v, c in versions.items())
    keyed = counts.withColumn("k", key_of("doc_id"))
    first = durable(keyed.groupBy("same").agg(F.min("k").alias("first")), "token-firsts")
    copies = durable(spread_join(keyed, first, ["same"]).filter("k > first"), "token-copies")
    store.commit("3-copies", all_of([changes(copies, "delete", old=side(v, c)) for v, c in live.items()]))
    store.commit("1-ingest", ingest)
    return store.totals()


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.near import near_classes

    return near_classes(table(spark, sf_dir, "documents")).drop("k", "h", "class_k", "class_h")


def op6_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.telephony import digests, store

    return digests(store(table(spark, sf_dir, "documents")))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.suffixes import digests

    return digests(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from millrace.llm.packing import assign, bytes_and_end

    return assign(table(spark, sf_dir, "documents"), bytes_and_end(F.col("text")))


def op9_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.ann import search

    return search(table(spark, sf_dir, "embeddings"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from millrace.llm.sentencepieces import PieceCodec, round_trip_digests

    codec = PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))
    return round_trip_digests(table(spark, sf_dir, "documents"), codec)


Query = Callable[[SparkSession, str], DataFrame]


def in_small_batches(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {
    q.__name__: in_small_batches(q)
    for q in (op1_toxicity, op2_url_rules, op3_licenses, op4_token_rollup, token_rollup_words, op5_jaccard, op6_telephony, op7_suffixes, op8_packing, op9_ivf_pq, op10_sentencepiece)
}

#: Tokens of version words-2: runs of ASCII letters and digits or beyond ASCII.
_LETTERS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"

ORACLE_SQL: dict[str, str] = {
    "op3_licenses": license_sql(LicenseIndex()),
    "op5_jaccard": near_sql(),
    "op7_suffixes": repeats_sql(),
    "token_rollup_words": f"""
        SELECT source, lang, 'words-2' AS version, CAST(count(*) AS BIGINT) AS docs, CAST(sum({_LETTERS}) AS BIGINT) AS tokens
        FROM documents AS d
        WHERE NOT EXISTS (SELECT 1 FROM documents AS e WHERE coalesce(e.text, '') = coalesce(d.text, '') AND e.doc_id < d.doc_id)
        GROUP BY source, lang
    """,
}
