import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from millrace.llm.queries import QUERIES, op10_sentencepiece
from millrace.llm.sentencepieces import PieceCodec, decode, distinct_words, encode, keeps_text, round_trip_digests

SF = "/root/testdata/sf0.001"

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def expected(library, text):
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    packed = b"".join(i.to_bytes(4, "little") for i in ids)
    return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_ids_are_the_librarys(library):
    draw, table = random.Random(0), PieceCodec(MODEL).open()
    assert table.separable
    for _ in range(4000):
        text = "".join(draw.choice(" ▁ab\n\x00é\t한🙂z0.") for _ in range(draw.randrange(15)))
        assert table.encode(text).tolist() == library.encode(text, add_bos=True, add_eos=True), repr(text)


def test_a_small_table_starts_anew(library):
    table = PieceCodec(MODEL, table_words=3).open()
    text = " ".join(f"w{i}" for i in range(50))
    assert [table.encode(t).tolist() for t in (text, text[::-1], text)] == [library.encode(t, add_bos=True, add_eos=True) for t in (text, text[::-1], text)]


def test_long_texts_are_cut_at_blanks(library, monkeypatch):
    from millrace.llm import sentencepieces as own

    draw, table = random.Random(1), PieceCodec(MODEL).open()
    monkeypatch.setattr(own, "BLOCK", 7)
    for _ in range(1500):
        text = "".join(draw.choice("  ▁▁ab\n é한🙂z") for _ in range(draw.randrange(60)))
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert table.encode(text).tolist() == ids, repr(text)
        assert table.decode(table.encode(text)) == library.decode(ids), repr(text)


def test_the_table_holds_frequent_words_once(spark, documents, library):
    rows = [(i, " ".join(f"w{j}" for j in range(64) for _ in range(1 + 100 // (j + 1)))) for i in range(8)]
    for most in (5, 20, 1000):
        found = {r["word"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in distinct_words(documents(rows), PieceCodec(MODEL, table_words=most)).collect()}
        assert len(found) <= most and all(ids == library.encode(w) for w, ids in found.items())
        assert "w0" in found and (most < 1000 or len(found) == 64)
        got = round_trip_digests(documents(rows), PieceCodec(MODEL, table_words=most))
        assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == {i: expected(library, t) for i, t in rows}


def test_the_models_normaliser_is_read(library):
    model = library.serialized_model_proto()
    assert keeps_text(model)
    put = lambda number, value: bytes([number << 3, value])
    spec = lambda body: bytes([3 << 3 | 2, len(body)]) + body
    assert keeps_text(spec(put(4, 0)))
    assert not keeps_text(spec(put(4, 1))) and not keeps_text(spec(b"")) and not keeps_text(spec(put(4, 0) + bytes([2 << 3 | 2, 1, 7])))
    assert not keeps_text(spec(put(4, 0) + put(3, 0)))


def test_odd_rows(documents, library, odd_rows):
    got = sorted((tuple(r) for r in round_trip_digests(documents(odd_rows), PieceCodec(MODEL)).collect()), key=str)
    assert got == sorted(((i, *expected(library, t)) for i, t in odd_rows), key=str)
    assert round_trip_digests(documents([]), PieceCodec(MODEL)).count() == 0


def test_encode_and_decode_columns(documents, library, odd_rows):
    coded = encode(documents(odd_rows), PieceCodec(MODEL))
    assert coded.columns[-1] == "ids" and len(coded.columns) == len(documents([]).columns)
    rows = decode(coded, PieceCodec(MODEL)).collect()
    assert all(r["decoded"] == library.decode(library.encode(r["text"] or "")) for r in rows) and len(rows) == len(odd_rows)


def test_query_on_the_tables(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in op10_sentencepiece(spark, SF).collect()}
    assert got == {r["doc_id"]: expected(library, r["text"]) for r in docs.collect()}


def test_stages_against_brute_force(spark):
    """Each stage on what its predecessor kept."""
    from test_near import brute as near
    from test_packing_ann import whole
    from test_suffixes import brute as repeats

    from millrace.llm import toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    grammar = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    first = stages["toxicity"](spark, docs, SF)
    assert first.columns == docs.columns
    clean = texts(first)
    assert clean == {i: t for i, t in texts(docs).items() if grammar.score(t) < 0.3} and len(clean) < docs.count()

    second = stages["n-gram Jaccard join"](spark, first, SF)
    classes = near(list(clean.items()))
    single = texts(second)
    assert second.columns == docs.columns and single == {i: t for i, t in clean.items() if classes[i][0] == i}

    third = stages["suffix-array dedup"](spark, second, SF)
    cut = texts(third)
    assert third.columns == docs.columns and set(cut) == set(single)
    kept = repeats(list(single.items()))
    for r in third.collect():
        assert r["n_chars"] == len(r["text"])
        if kept[r["doc_id"]][1] == 0:
            assert r["text"] == single[r["doc_id"]]
        else:
            assert len(r["text"].encode()) <= kept[r["doc_id"]][0] - kept[r["doc_id"]][1]

    whole(stages["best-fit packing"](spark, third, SF).collect(), {i: len(t.encode()) + 1 for i, t in cut.items()}, 8192)
    assert corpus_pipeline.run(spark, SF).count() == stages["best-fit packing"](spark, third, SF).count()


def test_stages_take_odd_rows(spark, documents, odd_rows):
    docs = documents(odd_rows)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() > 0
    empty = documents([])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0


def test_one_of_exact_copies_stays_whatever_its_key(spark, documents):
    """Copies without a key, repeated rows, and texts without a key that share a passage."""
    draw = random.Random(3)
    passage = "".join(draw.choice("abcdefgh ") for _ in range(300))
    heads = [" ".join("".join(draw.choice("pqrstuvw") for _ in range(5)) for _ in range(400)) for _ in range(3)]
    texts = [passage + h for h in heads]
    rows = [(None, "all alone " + heads[0][::-1])] * 30 + [(5, "again and again " + heads[1][::-1])] * 30 + [(None, t) for t in texts] + [(None, None), (None, ""), (9, None)]
    stages = dict(corpus_pipeline.STAGES)
    second = stages["n-gram Jaccard join"](spark, documents(rows), SF)
    got = sorted(((r["doc_id"], r["text"] or "") for r in second.collect()), key=str)
    assert got == sorted({(i, t or "") for i, t in rows}, key=str)
    third = stages["suffix-array dedup"](spark, second, SF)
    assert sum(passage in r["text"] for r in third.collect()) == 1


def test_registered_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 11))
