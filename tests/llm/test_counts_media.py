import base64
import hashlib
import math
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from millrace.llm import telephony as tel
from millrace.llm import token_rollup as rollup
from millrace.llm.queries import op4_token_rollup


def change(op, new=None, old=None):
    return (op, *(new or (None,) * 4), *(old or (None,) * 4))


def test_rollup_follows_its_changes(spark, tmp_path):
    store = rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    assert store.totals().count() == 0 and store.committed() == []
    batch = lambda *rows: spark.createDataFrame(rows, rollup.CHANGES)
    first = batch(change("insert", ("s", "en", "v1", 5)), change("insert", ("s", "en", "v1", 7)), change("insert", (None, None, "v1", None)))
    assert store.commit("b1", first) and not store.commit("b1", first)
    assert store.commit("b2", batch(change("revise", ("s", "en", "v2", 6), ("s", "en", "v1", 5)), change("delete", old=("s", "en", "v1", 7))))
    assert store.commit("b3", batch())
    got = {(r["source"], r["lang"], r["version"]): (r["docs"], r["tokens"]) for r in store.totals().collect()}
    assert got == {("s", "en", "v2"): (1, 6), (None, None, "v1"): (1, 0)}
    assert store.committed() == ["b1", "b2", "b3"]
    with pytest.raises(ValueError):
        store.commit("../x", first)
    with pytest.raises(Exception, match="unknown operation"):
        store.commit("b4", batch(change("upsert", ("s", "en", "v1", 5))))
    assert store.committed() == ["b1", "b2", "b3"]
    with pytest.raises(ValueError, match="another batch"):
        store.commit("b1", batch(change("insert", ("s", "en", "v1", 5))))
    assert store.totals().count() == 2


def test_totals_are_kept_up(spark, tmp_path):
    store = rollup.TokenRollup(spark, f"file://{tmp_path}/r", fold_every=2)
    for n in range(5):
        assert store.commit(f"b{n}", spark.createDataFrame([change("insert", ("s", "en", "v1", n))], rollup.CHANGES))
    where, folded = store._folded()
    assert where and folded == {"b0", "b1", "b2", "b3"}
    assert [tuple(r) for r in store.totals().collect()] == [("s", "en", "v1", 5, 10)]
    # A fold that has not listed its batches counts for nothing.
    import shutil

    shutil.copytree(where.removeprefix("file://"), f"{tmp_path}/r/totals/000000000009-x")
    shutil.rmtree(f"{tmp_path}/r/totals/000000000009-x/batches")
    assert [tuple(r) for r in store.totals().collect()] == [("s", "en", "v1", 5, 10)]


def test_query_against_brute_force(spark):
    import re

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    first = {}
    for r in docs:
        first[r["text"]] = min(first.get(r["text"], r["doc_id"]), r["doc_id"])
    docs_in, tokens_in = Counter(), Counter()
    for r in docs:
        if first[r["text"]] == r["doc_id"]:
            for version, n in (("words-2", len(re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", r["text"]))), ("bpe-50k-1", len(bpe.encode_ordinary(r["text"])))):
                docs_in[r["source"], r["lang"], version] += 1
                tokens_in[r["source"], r["lang"], version] += n
    got = {(r["source"], r["lang"], r["version"]): (r["docs"], r["tokens"]) for r in op4_token_rollup(spark, sf).collect()}
    assert got == {k: (docs_in[k], tokens_in[k]) for k in docs_in}


def test_counting_odd_rows(documents, odd_rows):
    docs = documents(odd_rows)
    got = rollup.bpe(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert got.count() == len(odd_rows) and {r["tokens"] for r in got.filter("doc_id < 3").collect()} == {0}
    assert docs.limit(0).select(rollup.words(F.col("text"))).count() == 0


def scalar_adpcm(block):
    at, index = int.from_bytes(block[:2].tobytes(), "little", signed=True), min(int(block[2]), 88)
    out = [at]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = tel.IMA_STEPS[index]
            change = step // 8 + (step if code & 4 else 0) + (step // 2 if code & 2 else 0) + (step // 4 if code & 1 else 0)
            at = max(-32768, min(32767, at - change if code & 8 else at + change))
            index = max(0, min(88, index + tel.IMA_SHIFTS[code & 7]))
            out.append(at)
    return out


def test_decoders():
    mu, a = tel.mulaw_table(), tel.alaw_table()
    # values that G.711 gives
    assert [int(mu[c]) for c in (0x00, 0x80, 0x7F, 0xFF, 0x70, 0x01)] == [-32124, 32124, 0, 0, -120, -31100]
    assert [int(a[c]) for c in (0x55, 0xD5, 0x2A, 0xAA)] == [-8, 8, -32256, 32256]
    assert len(set(a.tolist())) == 256 and len(set(mu.tolist())) == 255
    blocks = np.random.default_rng(3).integers(0, 256, (9, 64), dtype=np.uint8)
    assert tel.decode_adpcm(blocks).tolist() == [scalar_adpcm(b) for b in blocks]


def test_resampling():
    x, offsets = np.arange(-100, 100, dtype=np.int16) * 50, np.array([0, 64, 200])
    wide, ends = tel.resample(x, offsets, 2, 1)
    assert ends.tolist() == [0, 128, 400] and (wide[0::2] == x).all()
    same, _ = tel.resample(x, offsets, 3, 3)
    assert (same == x).all()
    assert len(tel.resample(x, np.array([0, 200]), 2, 3)[0]) == 134


def textbook(payload):
    """What a payload sounds like, sample by sample."""
    def mulaw(code):
        code = ~code & 0xFF
        size = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
        return -size if code & 128 else size

    def alaw(code):
        code ^= 0x55
        size, exponent = (code & 15) << 4, (code >> 4) & 7
        size = size + 8 if exponent == 0 else (size + 264) << (exponent - 1)
        return size if code & 128 else -size

    x = [mulaw(c) for c in payload]
    at = lambda i: x[min(max(i, 0), len(x) - 1)]
    wide = []
    for i in range(len(x)):
        between = Fraction(-at(i - 1) + 9 * at(i) + 9 * at(i + 1) - at(i + 2), 16)
        wide += [x[i], max(-32768, min(32767, round(between)))]
    zc = sum((a < 0) != (b < 0) for a, b in zip(wide, wide[1:]))
    crc = zlib.crc32(b"".join(v.to_bytes(2, "little", signed=True) for v in wide))
    blocks = [scalar_adpcm(np.frombuffer(payload[i : i + 64], np.uint8)) for i in range(0, len(payload), 64)]
    coded = zlib.crc32(b"".join(v.to_bytes(2, "little", signed=True) for b in blocks for v in b))
    level = lambda v: math.isqrt(sum(s * s for s in v) // len(v))
    return f"rms={level(wide)} peak={max(map(abs, wide))} zc={zc} pcm16k={crc:08x} alaw_rms={level([alaw(c) for c in payload])} adpcm={coded:08x}", 2 * len(wide)


def test_segments_are_the_whole_clip():
    raw = np.random.default_rng(2).integers(0, 256, 64 * 40, dtype=np.uint8)
    for kind in (tel.MULAW, tel.ALAW, tel.ADPCM, tel.PCM):
        n = tel.samples_in(kind, len(raw))
        whole = tel.decode_many(kind, raw)
        assert len(whole) == n and (tel.decode_part(kind, raw, 100, 200) == whole[100:200]).all()
        for up, down in ((2, 1), (3, 2), (1, 3), (1, 1)):
            wide = tel.resample(whole, np.array([0, n]), up, down)[0]
            parts = [tel.resampled_part(kind, raw, lo, min(len(wide), lo + 97), up, down) for lo in range(0, len(wide), 97)]
            assert (np.concatenate(parts) == wide).all()


def test_payloads_come_back(documents, odd_rows):
    got = sorted((tuple(r) for r in tel.digests(tel.store(documents(odd_rows))).collect()), key=str)
    again = sorted((tuple(r)[:-1] for r in tel.digests(tel.store(documents(odd_rows)), segment=100).collect()), key=str)
    assert again == [r[:-1] for r in got]
    expect = []
    for i, t in odd_rows:
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        wav = tel.wav_header(tel.MULAW, 8000, len(payload), len(payload)) + payload
        feature, n_pcm = textbook(payload)
        n_pcm += len(tel.wav_header(tel.PCM, 16000, 0, 0)) * -(-n_pcm // (2 * tel.SEGMENT))
        expect.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(wav), hashlib.sha256(wav).hexdigest(), feature, n_pcm))
    assert got == sorted(expect, key=str)
    assert tel.digests(tel.store(documents([]))).count() == 0


def test_stored_pcm(spark):
    import io
    import wave

    raw = np.random.default_rng(1).integers(0, 256, 128, dtype=np.uint8).tobytes()
    clips = [(k, tel.wav_header(kind, 8000, 128, n) + raw) for k, (kind, n) in enumerate([(tel.MULAW, 128), (tel.ALAW, 128), (tel.ADPCM, 242), (tel.PCM, 64)])]
    clips.append((4, tel.wav_header(tel.MULAW, 8000, 0, 0)))
    stored = spark.createDataFrame([*clips, (9, None)], "id int, media binary")
    parts = tel.to_pcm(stored, segment=100).collect()
    assert [(r["id"], r["segment"]) for r in parts] == sorted((r["id"], r["segment"]) for r in parts) and {r["segments"] for r in parts if r["id"] == 0} == {3}
    rows = tel.to_pcm(stored).collect()
    for r in rows:
        if r["pcm"]:
            of = lambda b: bytes(tel.read_wav(bytes(b))[2])
            assert of(r["pcm"]) == b"".join(of(p["pcm"]) for p in parts if p["id"] == r["id"])
    for r, samples in zip(rows, (256, 256, 484, 128, 0, None), strict=True):
        if samples is None:
            assert r["pcm"] is None
            continue
        with wave.open(io.BytesIO(bytes(r["pcm"]))) as w:
            assert (w.getframerate(), w.getnframes(), w.getsampwidth()) == (16000, samples, 2)
    with pytest.raises(ValueError):
        tel.read_wav(b"nothing")
