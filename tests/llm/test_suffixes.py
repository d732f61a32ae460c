import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm.queries import op7_suffixes
from millrace.llm.suffixes import Parsing, digests, gram_hashes, hot_triggers, parse, phrases, readable, remove_repeats, settle, suffix_ranks, window_min

SF = "/root/testdata/sf0.001"


def brute(rows, length=100):
    """``(n_bytes, n_removed, n_spans, kept_sha256)`` of ``(key, text)``, a null key first, keys distinct."""
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[key] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def patched(seed, n):
    draw = random.Random(seed)
    letters = "abcdé "
    new = lambda k: "".join(draw.choice(letters) for _ in range(k))
    passages = [new(draw.randrange(60, 500)) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [draw.choice([new(draw.randrange(0, 150)), draw.choice(passages)[draw.randrange(40) :]]) for _ in range(draw.randrange(0, 6))]
        rows.append((i, "".join(parts)))
    rows += [(n, "a" * 450), (n + 1, "ab" * 300 + "c"), (n + 2, "a" * 99), (n + 3, "a" * 100), (n + 4, rows[3][1]), (-5, rows[4][1]), (n + 5, "\x00" * 300)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("how", [Parsing(), Parsing(piece=64, held=50), Parsing(spread=1), Parsing(spread=0, piece=300), Parsing(length=30, gram=8)])
def test_against_brute_force(documents, how):
    rows = patched(1, 120)
    assert result(digests(documents(rows), how)) == brute(rows, how.length)


def test_one_passage_in_very_many_texts(documents):
    draw = random.Random(4)
    passage = "".join(draw.choice("abcdefgh ") for _ in range(400))
    rows = [(i, "".join(draw.choice("xyz ") for _ in range(30)) + passage + str(i)) for i in range(400)]
    rows += [(1000 + i, "twin text " * 30) for i in range(300)]
    assert result(digests(documents(rows), Parsing(spread=16))) == brute(rows)


def test_a_line_in_ever_new_surroundings_is_dealt_by_phrase(documents):
    """4000 texts with one line: its trigger has as many phrases, which don't come together in one task."""
    draw = random.Random(5)
    new = lambda k: "".join(draw.choice("abcdefghij ") for _ in range(k))
    line = new(60)
    texts = documents([(i, new(90) + line + new(90)) for i in range(4000)]).selectExpr("doc_id as k", "0L as h", "text")
    how = Parsing()
    hot = hot_triggers(texts, how)
    assert 0 < len(hot) < 100
    most = lambda parsed: parsed.groupBy("trigger").count().agg(F.max("count")).collect()[0][0]
    assert most(parse(texts, how)) > 2048 > most(parse(texts, how, hot))
    opened = settle(parse(texts, how, hot), how)
    assert opened.filter("open = 2").count() > 2048


def test_suffix_ranks_against_sorting():
    draw = random.Random(2)
    for length in (3, 8, 30, 100):
        data = bytes(draw.choice(b"ab\xff") for _ in range(400)) + b"ab" * 150
        keys = [data[i : i + length].ljust(length, b"\0") for i in range(len(data))]
        order = {s: n for n, s in enumerate(sorted(set(keys)))}
        ranks = suffix_ranks(np.frombuffer(data, np.uint8), length)
        assert np.unique(ranks, return_inverse=True)[1].tolist() == np.unique([order[s] for s in keys], return_inverse=True)[1].tolist()


def test_odd_rows(documents, odd_rows):
    got = digests(documents(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    rows = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert rows[1]["n_bytes"] == rows[2]["n_bytes"] == 0
    # the long text has a period of 997 * 13 words; of its copy all goes but the last three bytes, which are new
    assert rows[5]["n_removed"] == rows[5]["n_bytes"] - 3 and rows[4]["n_removed"] > 0
    assert digests(documents([])).count() == 0


def test_rows_that_share_a_key_are_one_place(documents):
    draw = random.Random(6)
    text = "".join(draw.choice("abcdefgh") for _ in range(300))
    twice = result(digests(documents([(1, text), (1, text), (2, text)])))
    assert twice[1][1] == 0 and twice[2][1] == 300
    got = sorted((tuple(r)[:3] for r in digests(documents([(1, text), (1, "b" + text)])).collect()))
    assert got == [(1, 300, 0), (1, 301, 300)]


def test_very_many_rows_of_one_key_and_text(documents):
    draw = random.Random(7)
    text = "".join(draw.choice("abcdefgh") for _ in range(300))
    rows = [(None, text)] * 1500 + [(None, None)] * 1500 + [(3, text), (4, "x" + text[:150])]
    got = digests(documents(rows)).groupBy("doc_id", "n_bytes", "n_removed").count().collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([(None, 300, 0, 1500), (None, 0, 0, 1500), (3, 300, 300, 1), (4, 151, 150, 1)], key=str)


def test_columns_come_along_and_text_stays_readable(documents):
    body = "é" * 120
    docs = documents([(1, "x" + body), (2, "yz" + body[:-1] + "ü")])
    done = readable(remove_repeats(docs, keep=("lang", "k", "score")), "kept", "text")
    rows = {r["doc_id"]: r for r in done.collect()}
    assert rows[1]["k"] == 7 and rows[1]["lang"] is None and rows[2]["text"].startswith("yz")
    assert rows[2]["removed"][0]["start"] == 2


def test_query_on_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert result(op7_suffixes(spark, SF)) == brute([tuple(r) for r in docs.collect()])
    assert op7_suffixes(spark, SF).agg(F.sum("n_removed")).collect()[0][0] > 0


def test_every_string_has_one_owner():
    data = np.frombuffer(("abcab" * 200 + "q" * 300).encode(), np.uint8)
    offsets = np.array([0, 500, 500, 590, len(data)])
    text, start, count, _, _ = phrases(data, offsets, Parsing())
    owned = sorted((int(t), int(s) + j) for t, s, n in zip(text, start, count, strict=True) for j in range(n))
    assert owned == [(t, s) for t in range(4) for s in range(max(0, int(offsets[t + 1] - offsets[t]) - 99))]
    hashes = gram_hashes(data, 24)
    assert hashes[0] == hashes[5] and hashes[0] != hashes[1] and len(set(hashes[1000:].tolist())) == 1
    x = np.random.default_rng(0).integers(0, 99, 50)
    for width in (1, 2, 7, 50):
        assert window_min(x, width).tolist() == [x[i : i + width].min() for i in range(51 - width)]
    with pytest.raises(ValueError):
        Parsing(gram=100)
