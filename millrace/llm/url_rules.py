"""URL filters: host and path rules first, then association rules that FP-growth mines from labelled URLs.

A URL's tokens are its host's labels, host suffixes, path segments, extension, query keys and scheme, digits folded.
URLs that a host and path rule decides are the labelled ones; all others are unlabelled and teach nothing.  FP-growth
finds token sets that occur often among the labelled; those that tell one label surely enough, and better than the
labels' own shares do, become rules, and a rule is pruned if a shorter one with the same conclusion is as sure.  To
match, each rule is filed under its rarest token; a URL's tokens are looked up there and candidates verified in full.
DataFrame and ML pipeline functions only.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import durable, spread_join
from millrace.llm.licenses import LOWER, UPPER

#: Host suffix and start of the path, with the verdict.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
BLOCK, ALLOW = "block", "allow"


@dataclass(frozen=True)
class Mining:
    """FP-growth sees all labelled URLs, so supports and confidences are those of the pages.

    ``min_certainty`` bounds a rule's certainty factor, the share of the way from its label's own frequency to 1 that
    its confidence goes: where nine of ten labels are block, tokens that say nothing have a confidence of 0.9."""

    min_support: float = 0.005
    min_confidence: float = 0.9
    min_certainty: float = 0.5
    #: Rules beyond which their index is joined rather than broadcast.
    most_broadcast: int = 20_000


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null and without ``://``."""
    place = F.instr(url, "://")
    rest = F.when(place > 0, F.substring(url, place + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    empty = F.lit("")
    return F.coalesce(F.translate(host, UPPER, LOWER), empty), F.coalesce(path, empty)


def first_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule, like ``net/de/``, and its verdict; nulls if none fits.

    A longer suffix of the host counts before a longer path when two rules are equally long.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for suffix, start, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]))):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(start)
        rule, verdict = F.when(fits, suffix + start).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL in order; runs of digits fold to ``0``, so that their number stays bounded."""
    labels = F.split(host, r"\.")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    query = F.regexp_extract_all(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), 1)
    fold = lambda prefix, words: F.transform(words, lambda w: F.concat(F.lit(prefix), F.regexp_replace(w, "[0-9]+", "0")))
    return F.sort_array(
        F.array_distinct(
            F.concat(
                fold("host:", labels),
                fold("path:", segments),
                fold("query:", query),
                F.array(
                    F.concat(F.lit("scheme:"), F.coalesce(F.regexp_extract(url, "^([A-Za-z]+)://", 1), F.lit(""))),
                    F.concat(F.lit("domain:"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)),
                    F.concat(F.lit("extension:"), F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)),
                    F.concat(F.lit("fragment:"), (F.instr(url, "#") > 0).cast("string")),
                    F.concat(F.lit("depth:"), F.size(segments).cast("string")),
                ),
            )
        )
    )


def stand_ins(labelled: DataFrame, mining: Mining) -> DataFrame:
    """``token, rep``: tokens of enough rows, and the first of the alphabet among those of the very same rows.

    Tokens of the same rows tell the same, so the miner sees one of them, and a URL of many tokens that comes often
    has few token sets.  There are no more rows than the tokens of a mean URL over the support.
    """
    row = F.xxhash64("items", "label")
    parts = [F.sum(F.pmod(h, F.lit(1 << 31))) for h in (F.col("h"), F.xxhash64(F.lit(1), "h"))]
    single = labelled.select(F.explode("items").alias("token"), row.alias("h"))
    counted = single.groupBy("token").agg(F.count(F.lit(1)).alias("n"), *[p.alias(f"part{i}") for i, p in enumerate(parts)])
    least = int(mining.min_support * labelled.count())
    alike = Window.partitionBy("n", "part0", "part1")
    return counted.filter(F.col("n") >= least).select("token", F.min("token").over(alike).alias("rep"))


def mine(labelled: DataFrame, mining: Mining, tokens_of: DataFrame | None = None) -> DataFrame:
    """Rules (``items array<string>, says string, confidence double``) from rows of ``items`` and ``label``.

    No rows, or rows of one label only, give no rules: nothing tells the labels apart then.  ``tokens_of`` are their
    ``stand_ins``; rules hold those that stand for others.
    """
    spark = labelled.sparkSession
    schema = "items array<string>, says string, confidence double"
    shares = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    total = sum(shares.values())
    if len(shares) < 2:
        return spark.createDataFrame([], schema)
    tokens_of = stand_ins(labelled, mining) if tokens_of is None else tokens_of
    reps = sorted(r["rep"] for r in tokens_of.select("rep").distinct().collect())
    if not reps:
        return spark.createDataFrame([], schema)
    kept = F.array_intersect("items", F.array(*[F.lit(t) for t in reps]))
    transactions = labelled.select(F.concat(kept, F.array(F.concat(F.lit("label:"), "label"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=mining.min_support, minConfidence=mining.min_confidence).fit(transactions)
    frequent = model.freqItemsets
    is_label = lambda t: t.startswith("label:")
    with_label = frequent.filter(F.exists("items", is_label))
    with_label = with_label.select(F.sort_array(F.filter("items", lambda t: ~is_label(t))).alias("items"), F.substring(F.filter("items", is_label)[0], 7, 99).alias("says"), F.col("freq").alias("both"))
    alone = frequent.filter(~F.exists("items", is_label)).select(F.sort_array("items").alias("items"), "freq")
    share = F.element_at(F.create_map(*[F.lit(x) for label, n in shares.items() for x in (label, n / total)]), F.col("says"))
    sure = with_label.join(alone, "items").select("items", "says", (F.col("both") / F.col("freq")).alias("confidence"))
    sure = sure.filter((F.col("confidence") >= mining.min_confidence) & (F.col("confidence") - share >= mining.min_certainty * (1 - share)))
    return sure.filter(F.size("items") > 0)


Rule = tuple[tuple[str, ...], str, float]


def pruned(rules: list[Rule]) -> list[Rule]:
    """Rules that no shorter rule over part of their tokens, with the same conclusion, is as sure as."""
    return pruned_in_order(sorted(rules, key=lambda r: (len(r[0]), r[0], r[1])))


def pruned_in_order(rules: Iterable[Rule]) -> list[Rule]:
    """``pruned`` of rules that come shorter ones first; holds only what it keeps, filed under the first token."""
    kept: list[Rule] = []
    filed: dict[tuple[str, str], list[tuple[frozenset[str], float]]] = {}
    for items, says, confidence in rules:
        has = frozenset(items)
        if not any(c >= confidence and part < has for t in items for part, c in filed.get((t, says), ())):
            kept.append((items, says, confidence))
            filed.setdefault((items[0], says), []).append((has, confidence))
    return kept


def match(urls: DataFrame, rules: DataFrame, frequency: dict[str, int], most_broadcast: int = 20_000) -> DataFrame:
    """The surest rule's verdict for each distinct ``items`` of ``urls`` that any rule fits: ``same, mined``.

    ``frequency`` says how often each token of a rule occurs.  The rules are broadcast if they are at most
    ``most_broadcast``.
    """
    order = F.array(*[F.lit(t) for t in sorted(frequency, key=lambda t: (frequency[t], t))])
    index = rules.withColumn("token", F.array_intersect(order, F.col("items"))[0])
    if rules.count() <= most_broadcast:
        index = F.broadcast(index)
    distinct = urls.select("same", "items").dropDuplicates(["same"])
    found = distinct.select("same", F.col("items").alias("has"), F.explode("items").alias("token")).join(index, "token")
    fits = found.filter(F.size(F.array_except("items", "has")) == 0)
    best = F.max(F.struct("confidence", F.size("items").alias("size"), "says"))
    return fits.groupBy("same").agg(best.alias("best")).select("same", F.col("best.says").alias("mined"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, mining: Mining | None = None, key: str = "page_id", url: str = "url") -> DataFrame:
    """``key, host, path, rule, verdict, by`` for every row; ``by`` says what decided: rule, mined or default.

    A host and path rule's verdict stands, and is the URL's label; rules of both labels are mined from the URLs so
    labelled.  Where no rule fits, the surest mined rule that fits decides, and without one a URL is allowed.  Null and
    malformed URLs have an empty host and path and are allowed.  Repeated rows stay repeated; equal confidence goes to
    the longer rule, then to block.  Other columns aren't read.
    """
    spark = pages.sparkSession
    mining = mining or Mining()
    host, path = split_url(F.col("u"))
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u")).select("k", "u", host.alias("host"), path.alias("path"))
    rule, verdict = first_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("k", "u", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    items = tokens(F.col("u"), F.col("host"), F.col("path")).alias("items")
    labelled = durable(rows.filter(F.col("verdict").isNotNull()).select(items, F.col("verdict").alias("label")), "url-labelled")
    alike = durable(stand_ins(labelled, mining), "url-tokens")
    found = durable(mine(labelled, mining, alike), "url-rules")
    # Rules come one by one, as only some of them stay.
    kept = pruned_in_order((tuple(r["items"]), r["says"], r["confidence"]) for r in found.orderBy(F.size("items"), "items", "says").toLocalIterator())
    out = [F.col("k").alias(key), "host", "path", "rule"]
    ruled = F.when(F.col("rule").isNotNull(), "rule")
    if not kept:
        return rows.select(*out, F.coalesce("verdict", F.lit(ALLOW)).alias("verdict"), F.coalesce(ruled, F.lit("default")).alias("by"))
    index = durable(spark.createDataFrame([(list(items), says, float(c)) for items, says, c in kept], "items array<string>, says string, confidence double"), "url-index")
    used = F.array(*[F.lit(t) for t in sorted({t for items, _, _ in kept for t in items})])
    frequency = {r["token"]: r["n"] for r in labelled.select(F.explode(F.array_intersect("items", used)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = rows.withColumn("items", F.when(F.col("verdict").isNull() & (F.col("host") != ""), items))
    rows = rows.withColumn("same", F.md5(F.array_join("items", "\n")))
    urls = rows.filter(F.col("items").isNotNull()).dropDuplicates(["same"]).select("same", F.explode("items").alias("token"))
    stood = urls.join(F.broadcast(alike), "token").groupBy("same").agg(F.sort_array(F.collect_set("rep")).alias("items"))
    mined = durable(match(stood, index, frequency, mining.most_broadcast), "url-verdicts")
    joined = spread_join(rows.drop("items"), mined, ["same"], "left")
    by = F.coalesce(ruled, F.when(F.col("mined").isNotNull(), "mined"), F.lit("default")).alias("by")
    return joined.select(*out, F.coalesce("verdict", "mined", F.lit(ALLOW)).alias("verdict"), by)
