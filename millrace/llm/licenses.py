"""License scans by a positional index of rare licence words.

Templates are short licence notices.  Their words that aren't common English form a vocabulary, whose frequency over
all files is counted.  A template is indexed by its own words of highest IDF, and every place of such a word in it is a
posting.  All places of these words in a file that holds a key phrase are looked up, so that no template's words
compete with those of others or of the rest of the file; each hit says where the template would have to begin, and
hits that agree on that place add up.  A template is found where enough of its words agree and all its mandatory key
phrases stand at their places.

DataFrame functions only.  Of a text, one pass keeps the places of licence words; what is shuffled are the places in
files with a key phrase, by file, so copies of one text are spread like other files.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import durable

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words of templates that say nothing about a licence; they are never looked up.
COMMON = frozenset("a an and any are as at be by can do except file for form free from if in into is it may met must name no not of on or other person provided so subject terms that the them they this to under use we with without work you your".split())


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Each must stand at its place in the template.
    phrases: tuple[str, ...]


#: Phrases whose every place counts, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

TEMPLATES = (
    Template("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    Template("apache", "licensed under the apache license version 2 0", ("apache license",)),
    Template("apache", "you may not use this file except in compliance with the apache license", ("compliance with the apache license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("bsd", "released under the bsd license", ("bsd license",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("creative-commons", "licensed under a creative commons attribution license", ("creative commons",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("gnu general public license",)),
    Template("gpl", "licensed under the gnu general public license version 3", ("gnu general public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("distribute this software for any purpose",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
)


def places(phrase: str, text: str) -> list[int]:
    part, whole = phrase.split(), text.split()
    return [i for i in range(len(whole) - len(part) + 1) if whole[i : i + len(part)] == part]


@dataclass(frozen=True)
class LicenseIndex:
    """The templates' postings.  A template is indexed by its ``look_up`` words of highest IDF, and found if a share
    ``least`` of them agree on its place.  All words are counted in the corpus, and none of a file's hits is left out."""

    templates: tuple[Template, ...] = TEMPLATES
    look_up: int = 8
    least: float = 0.5

    def __post_init__(self) -> None:
        for t in self.templates:
            if len(t.text.split()) > 60 or not all(places(p, t.text) for p in t.phrases):
                raise ValueError(f"template {t.label}: over 60 words, or a key phrase that it hasn't")

    def rare(self, template: Template) -> list[tuple[int, str]]:
        return [(i, w) for i, w in enumerate(template.text.split()) if w not in COMMON]

    def vocabulary(self) -> list[str]:
        return sorted({w for t in self.templates for _, w in self.rare(t)} | {anchor(p)[1] for p in BASE} | {anchor(p)[1] for p in self.phrases()})

    def phrases(self) -> list[str]:
        return sorted({p for t in self.templates for p in t.phrases})

    def postings(self) -> list[tuple[str, int, int, int, int]]:
        """Token, template, place, and the bits of its word and of its key phrase.  Tokens of phrases hold blanks."""
        out = []
        for k, t in enumerate(self.templates):
            out += [(w, k, i, 1 << i, 0) for i, w in self.rare(t)]
            out += [(p, k, places(p, t.text)[0], 0, 1 << b) for b, p in enumerate(t.phrases)]
        return out


def anchor(phrase: str) -> tuple[int, str]:
    """The longest uncommon word of a phrase, and its place there."""
    return max(((i, w) for i, w in enumerate(phrase.split()) if w not in COMMON), key=lambda x: (len(x[1]), -x[0]))


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; null counts as empty."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), "")


def starts_of(phrase: str, marks: Column, all_words: Column) -> Column:
    """Where a phrase starts: around each mark of its anchor, its other words are compared."""
    at, word = anchor(phrase)
    others = [(i - at, w) for i, w in enumerate(phrase.split()) if i != at]

    def here(m: Column) -> Column:
        return reduce(lambda x, y: x & y, [F.coalesce(F.get(all_words, m["i"] + d) == w, F.lit(False)) for d, w in others], m["w"] == word)

    return F.transform(F.filter(marks, here), lambda m: m["i"] - at)


def named(token: str, starts: Column) -> Column:
    return F.transform(starts, lambda i: F.struct(F.lit(token).alias("w"), i.alias("i")))


def marked(docs: DataFrame, index: LicenseIndex, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts, places of base phrases, and marks of licence words and key phrases."""
    vocabulary = F.array(*[F.lit(w) for w in index.vocabulary()])
    out = docs.select(F.col(key).alias("doc_id"), words(F.col(text)).alias("words"))
    out = out.select("doc_id", "words", F.array_intersect("words", vocabulary).alias("hits"))
    place = F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    marks = F.when(F.size("hits") > 0, F.filter(place, lambda m: F.array_contains("hits", m["w"])))
    out = out.select("doc_id", "words", "hits", F.coalesce(marks, F.array().cast("array<struct<w:string,i:int>>")).alias("marks"))
    found = [starts_of(p, F.col("marks"), F.col("words")).alias(f"base{k}") for k, p in enumerate(BASE)]
    keys = F.flatten(F.array(*[named(p, starts_of(p, F.col("marks"), F.col("words"))) for p in index.phrases()]))
    return out.select("doc_id", F.size("words").cast("long").alias("n_words"), "hits", "marks", keys.alias("keys"), *found)


def index_of(index: LicenseIndex, hits: DataFrame) -> DataFrame:
    """Postings ``token, template, place, word, phrase`` of each template's rarest words and of its key phrases.

    ``hits`` holds the distinct licence words of every file.  The result has fewer rows than the templates have words.
    """
    spark = hits.sparkSession
    schema = "token string, template int, place int, word long, phrase long"
    rows = index.postings()
    of_words = spark.createDataFrame([r for r in rows if r[3]], schema)
    of_phrases = spark.createDataFrame([r for r in rows if r[4]], schema)
    seen = hits.select(F.explode("hits").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("files"))
    rarity = Window.partitionBy("template").orderBy(F.coalesce("files", F.lit(0)), "token")
    rare = of_words.select("template", "token").distinct().join(seen, "token", "left").withColumn("turn", F.row_number().over(rarity)).filter(F.col("turn") <= index.look_up)
    return of_words.join(rare.select("template", "token"), ["template", "token"]).select(*of_phrases.columns).unionByName(of_phrases)


def scan(docs: DataFrame, index: LicenseIndex | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Licences of every row: ``doc_id``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``,
    ``labels`` and ``score``, the share of the best template's indexed words that agree on a place (0 without a
    template).

    A null text counts as empty: no words, no labels.  Repeated rows, and rows with equal or null keys, each get a
    row of their own.  Words as rare as each other come in the order of the alphabet.  Other columns aren't read.
    """
    index = index or LicenseIndex()
    spark = docs.sparkSession
    kept = durable(marked(docs, index, key, text).withColumn("row", F.monotonically_increasing_id()), "license-marks")

    # Without a key phrase only templates that need none can be found.
    hit = F.size("keys" if all(t.phrases for t in index.templates) else "hits") > 0
    tokens = kept.filter(hit).select("row", F.explode(F.concat("marks", "keys")).alias("m"))
    aligned = (
        tokens.join(F.broadcast(index_of(index, kept)), F.col("m.w") == F.col("token"))
        .groupBy("row", "template", (F.col("m.i") - F.col("place")).alias("begins"))
        .agg(F.bit_or("word").alias("word"), F.bit_or("phrase").alias("phrase"))
    )
    about = spark.createDataFrame([(k, t.label, min(index.look_up, len({w for _, w in index.rare(t)})), (1 << len(t.phrases)) - 1) for k, t in enumerate(index.templates)], "template int, label string, most int, needed long")
    share = F.least(F.lit(1.0), F.bit_count("word") / F.col("most"))
    added = (
        aligned.join(F.broadcast(about), "template")
        .filter((F.col("phrase") == F.col("needed")) & (share >= index.least))
        .groupBy("row")
        .agg(F.collect_set("label").alias("added"), F.max(share).alias("score"))
    )
    spans = F.flatten(F.array(*[F.col(f"base{k}") for k in range(len(BASE))]))
    base_labels = F.array_compact(F.array(*[F.when(F.size(f"base{k}") > 0, label) for k, label in enumerate(BASE.values())]))
    joined = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    found = kept.select(F.col("doc_id").alias(key), "row", "n_words", hit.alias("hit"), spans.alias("spans"), base_labels.alias("base"))
    without = found.filter(~F.col("hit")).withColumns({"added": F.lit(None).cast("array<string>"), "score": F.lit(None).cast("double")})
    return (
        found.filter("hit")
        .join(added, "row", "left")
        .unionByName(without)
        .select(
            key,
            "n_words",
            F.size("spans").cast("long").alias("n_base"),
            F.array_min("spans").cast("long").alias("first_word"),
            F.array_max("spans").cast("long").alias("last_word"),
            joined(F.col("base")).alias("base_labels"),
            joined(F.concat("base", F.coalesce("added", F.array().cast("array<string>")))).alias("labels"),
            F.coalesce("score", F.lit(0.0)).alias("score"),
        )
    )
