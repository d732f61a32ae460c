import re

import pytest

from pyspark.sql import functions as F

from millrace.llm.licenses import BASE, LicenseIndex, Template, scan
from millrace.llm.queries import op2_url_rules
from millrace.llm.url_rules import RULES, Mining, judge, match, mine, pruned

URLS = [
    (1, "https://a.Example.COM/en/5?q#f"), (2, "http://example.com/en/7"), (3, "http://xexample.com/en/7"), (4, "http://com/en/"), (5, "http://x.net/de/8"),
    (6, "http://example.net/de/8x"), (7, None), (8, "no scheme"), (9, "http://"), (10, "http://org?x/es/"), (11, "http://a.org/es/#y"), (12, "http://a.org/es"), (13, "://b.com/EN/"), (None, "http://q.com/fr/1"), (1, "https://a.Example.COM/en/5?q#f"),
]


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, 0, 0) for i, u in URLS], "page_id long, url string, host int, items int")
    got = judge(pages).collect()
    assert len(got) == len(URLS)
    for r in got:
        url = next(u for i, u in URLS if i == r["page_id"])
        host, path, rule, verdict = brute_url(url)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or "allow") or r["by"] == "mined"
    assert judge(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("url", "rule", "verdict"),
    [
        ("http://a.com/en/5", "com/en/", "block"), ("http://example.com/en/7", "example.com/en/7", "allow"), ("http://example.com/en/6", "com/en/", "block"),
        ("http://x.net/de/8", "net/de/", "allow"), ("http://net/de/", "net/de/", "allow"), ("http://example.net/de/7", "net/de/", "allow"),
        ("http://www.Example.NET/de/80?q", "example.net/de/8", "block"), ("http://x.org/es/", "org/es/", "block"),
    ],
)
def test_words_of_the_contracts_rules(spark, url, rule, verdict):
    """Each rule's word is spelled out here, not read from the code."""
    got = judge(spark.createDataFrame([(1, url)], "page_id long, url string")).collect()
    assert [(r["rule"], r["verdict"], r["by"]) for r in got] == [(rule, verdict, "rule")]


def judged(spark, rows, **mining):
    return {r["page_id"]: r for r in judge(spark.createDataFrame(rows, "page_id long, url string"), mining=Mining(**mining)).collect()}


def test_mined_rules_decide_hosts_that_no_rule_names(spark):
    rows = [(i, f"http://s{i}.bad.com/en/{i}/promo") for i in range(60)] + [(100 + i, f"http://s{i}.example.com/en/7{i}/about") for i in range(60)]
    rows += [(200, "http://n.other.org/xx/1/promo"), (201, "http://n.other.org/xx/1/about"), (202, "http://n.other.org/xx/1"), (203, "http://n.bad.com/fr")]
    got = judged(spark, rows, min_support=0.05)
    assert got[1]["rule"] == "com/en/" and got[1]["by"] == "rule" and got[101]["verdict"] == "allow"
    assert [(got[i]["verdict"], got[i]["by"]) for i in (200, 201, 202, 203)] == [("block", "mined"), ("allow", "mined"), ("allow", "default"), ("block", "mined")]
    # URLs that no rule decides teach nothing, however many there are.
    more = rows + [(1000 + i, f"http://n{i}.other.org/xx/{i}/promo") for i in range(500)]
    got = judged(spark, more, min_support=0.05)
    assert all(got[1000 + i]["verdict"] == "block" for i in range(500))


def test_surer_rules_that_allow_and_rules_of_many_tokens(spark):
    """A site that is mostly blocked has a part that never is; and only four tokens together tell what is blocked."""
    rows = [(i, f"http://s{i}.example.com/en/5{i}") for i in range(95)] + [(100 + i, f"http://s{i}.example.com/en/7{i}/about") for i in range(5)]
    rows += [(200 + i, f"http://s{i}.bad.com/en/{i}/about") for i in range(2)]
    rows += [(500, "http://n.example.com/xx/1"), (501, "http://n.example.com/xx/1/about")]
    got = judged(spark, rows, min_support=0.02, min_certainty=0.0)
    assert got[500]["verdict"] == "block" and got[501]["verdict"] == "allow"
    assert got[500]["by"] == got[501]["by"] == "mined"

    rows = [(i, "http://example.com/en/5?a&b&c&d") for i in range(40)] + [(100, "http://example.com/xx/5?a&b&c&d")]
    rows += [(1000 + 100 * k + i, "http://example.com/en/7?" + "&".join(q)) for k, q in enumerate(("abc", "abd", "acd", "bcd")) for i in range(40)]
    rows += [(2000 + k, "http://example.com/xx/5?" + "&".join(q)) for k, q in enumerate(("abc", "bcd"))]
    got = judged(spark, rows, min_support=0.05)
    assert got[100]["verdict"] == "block" and got[100]["by"] == "mined" and all(v["verdict"] == "allow" for i, v in got.items() if i >= 1000)


def test_labels_shares_alone_make_no_rule(spark):
    """Nine of ten labelled URLs are blocked, and a token of them all says nothing."""
    rows = [(i, f"http://s{i}.bad.com/en/{i}") for i in range(90)] + [(100 + i, f"http://s{i}.example.com/en/7{i}") for i in range(10)] + [(500, "http://q.net/xx/3")]
    assert judged(spark, rows)[500]["by"] == "default"


def test_mining_against_brute_force(spark):
    """Every set of tokens, its share of rows and of labels, counted one by one."""
    import itertools
    import random

    draw = random.Random(4)
    rows = []
    for _ in range(120):
        has = {t for t in "abcdef" if draw.random() < 0.45} | ({"g"} if draw.random() < 0.3 else set())
        has |= {"z"} if "a" in has else set()  # z is wherever a is
        rows.append((sorted(has), "block" if "a" in has and "b" in has or draw.random() < 0.2 else "allow"))
    how = Mining(min_support=0.05, min_confidence=0.7, min_certainty=0.3)
    got = {(tuple(r["items"]), r["says"]): r["confidence"] for r in mine(spark.createDataFrame(rows, "items array<string>, label string"), how).collect()}
    expect = {}
    for n in range(1, 8):
        for items in itertools.combinations("abcdefg", n):
            inside = [says for has, says in rows if set(items) <= set(has)]
            for says in ("block", "allow"):
                both, share = inside.count(says), sum(s == says for _, s in rows) / len(rows)
                if both >= 0.05 * len(rows) and both / len(inside) >= 0.7 and both / len(inside) - share >= 0.3 * (1 - share):
                    expect[items, says] = both / len(inside)
    assert got == expect and len(expect) > 5


def test_all_pages_are_mined(spark):
    """600,000 pages of 40 shapes, a tenth of each with the other label: no shape is lost and all shares are exact."""
    n, shapes = 600_000, 40
    label = F.when((F.col("id") % 2 == 0) != (F.expr("id div 40") % 10 == 0), "block").otherwise("allow")
    labelled = spark.range(n).select(F.array(F.concat(F.lit("shape:"), (F.col("id") % shapes).cast("string")), F.lit("all")).alias("items"), label.alias("label"))
    got = {(tuple(r["items"]), r["says"]): r["confidence"] for r in mine(labelled, Mining(min_confidence=0.8)).collect()}
    expect = {}
    for k in range(shapes):
        says = "allow" if k % 2 else "block"
        expect[(f"shape:{k}",), says] = expect[("all", f"shape:{k}"), says] = 0.9
    assert got == expect


def test_pruning_and_matching_against_brute_force(spark):
    rules = [(("a",), "block", 0.9), (("a", "b"), "block", 0.9), (("b", "c"), "block", 0.85), (("a", "b", "c"), "allow", 0.95)]
    kept = pruned(rules)
    assert sorted(kept) == sorted([rules[0], rules[2], rules[3]])
    frame = spark.createDataFrame([(list(i), s, c) for i, s, c in kept], "items array<string>, says string, confidence double")
    sets = [["a"], ["b"], ["b", "c"], ["a", "b", "c"], ["d"], ["a"]]
    urls = spark.createDataFrame([("".join(s), s) for s in sets], "same string, items array<string>")
    got = {r["same"]: r["mined"] for r in match(urls, frame, {"a": 2, "b": 2, "c": 2}).collect()}
    expect = {}
    for s in sets:
        fits = [(c, len(i), says) for i, says, c in kept if set(i) <= set(s)]
        if fits:
            expect["".join(s)] = max(fits)[2]
    assert got == expect


def test_query_keeps_every_page(spark):
    sf = "/root/testdata/sf0.01"
    got = op2_url_rules(spark, sf)
    assert got.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    assert got.count() == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert got.filter("by = 'mined' and verdict = 'block'").count() > 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_license(text):
    words = WORD.findall((text or "").translate(LOWER))
    starts, labels = [], set()
    for phrase, label in BASE.items():
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += found
        labels |= {label} if found else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


LICENSES = [
    (10, "CC BY cc by-NC 4.0. All rights reserved; ALL RIGHTS RESERVED"),
    (11, "x Released under the MIT License. y"),
    (12, "Licensed under the Apache License, Version 2.0."),
    (13, "MIT, and elsewhere a license, released"),
    (14, "general public LICENSE générale GENERAL PUBLİC license"),
    (15, "İcc by cc\x00by ccby cc by"),
    (16, "license " * 5000 + "all rights reserved"),
    (17, "by cc"),
]


def test_base_places_against_brute_force(documents, odd_rows):
    rows = odd_rows + LICENSES
    got = sorted((tuple(r)[:6] for r in scan(documents(rows)).collect()), key=str)
    assert got == sorted(((i, *brute_license(t)) for i, t in rows), key=str)


def test_method_labels(documents):
    got = {r["doc_id"]: r for r in scan(documents(LICENSES)).collect()}
    assert got[10]["labels"] == "cc-by,cc-by-nc,reserved"
    assert got[11]["labels"] == "mit" and got[11]["score"] == 1.0
    assert got[12]["labels"] == "apache"
    assert got[13]["labels"] == "" and got[13]["score"] == 0.0
    assert scan(documents([])).count() == 0


def test_no_notice_hides_another(documents):
    """Three notices in full, with 11 different words; and one in a long text full of rarer licence words."""
    whole = {t.label: t.text for t in LicenseIndex().templates if t.label in ("bsd", "mit") and len(t.text.split()) > 10}
    three = f"{whole['bsd']} ... {whole['mit']} ... Licensed under the Apache License, Version 2.0"
    noise = " ".join(sorted(set(LicenseIndex().vocabulary()) - {"license", "released", "mit"}))
    noisy = "word " * 5000 + noise + " x Released under the MIT License. y " + noise
    common = [(100 + i, "released license mit") for i in range(20)]
    got = {r["doc_id"]: r for r in scan(documents([(1, three), (2, noisy), *common])).collect()}
    assert got[1]["labels"] == "apache,bsd,mit" and got[1]["score"] == 1.0
    assert got[2]["labels"] == "mit" and got[2]["score"] == 1.0
    assert all(got[i]["labels"] == "" and got[i]["score"] == 0.0 for i, _ in common)


def brute_labels(texts, index):
    """Every template at every place of every text, by the definition."""
    split = [WORD.findall((t or "").translate(LOWER)) for t in texts]
    files = {w: sum(w in set(ws) for ws in split) for w in index.vocabulary()}
    out = []
    for ws, text in zip(split, texts, strict=True):
        labels, score = {x for x in brute_license(text)[4].split(",") if x}, 0.0
        for t in index.templates:
            own = t.text.split()
            rare = sorted({w for _, w in index.rare(t)}, key=lambda w: (files[w], w))[: index.look_up]
            for at in range(-len(own), len(ws)):
                here = lambda i: ws[at + i] if 0 <= at + i < len(ws) else None  # noqa: B023, E731
                if all(any(own[i : i + len(p.split())] == p.split() == [here(i + d) for d in range(len(p.split()))] for i in range(len(own))) for p in t.phrases):
                    share = min(1.0, sum(w in rare and here(i) == w for i, w in enumerate(own)) / len(rare))
                    if share >= index.least:
                        labels.add(t.label)
                        score = max(score, share)
        out.append((",".join(sorted(labels)), score))
    return out


def test_several_licences_in_one_file_against_brute_force_and_sql(spark, documents):
    """Files of two, four and all notices, copies of a file, and notices with words missing."""
    import duckdb

    from millrace.llm.license_sql import license_sql

    index = LicenseIndex()
    notices = [t.text for t in index.templates]
    texts = [" ; ".join(notices), " x ".join(notices[:2]), " y ".join([notices[1], notices[11], notices[12], notices[3]]), " ".join(notices[::3]), *notices]
    texts += [" ".join(w for k, w in enumerate(n.split()) if k % m != m - 1) for n in notices for m in (2, 3, 5)] + [texts[2]] * 40
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in scan(documents(rows)).collect()}
    expect = brute_labels(texts, index)
    assert [got[i] for i in range(len(texts))] == expect
    assert set(expect[0][0].split(",")) == {t.label for t in index.templates} | {"gpl", "cc-by"}
    assert set(expect[2][0].split(",")) == {"apache", "lgpl", "gpl", "mit", "bsd"}
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert {r[0]: (r[6], r[7]) for r in duck.sql(license_sql(index)).fetchall()} == got


def test_templates_need_their_phrases():
    with pytest.raises(ValueError):
        LicenseIndex(templates=(Template("x", "one two", ("three",)),))
