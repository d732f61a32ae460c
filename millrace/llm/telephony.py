"""Telephony audio columns: G.711 companded and IMA ADPCM samples, decoded with numpy, stored as WAV.

mu-law and A-law expand by tables of 256 entries.  ADPCM blocks each begin with their decoder's state, so all blocks
of many rows are decoded side by side: one numpy step for each sample position within a block.

Resampled PCM is stored in segments of bounded length, each a WAV of its own in a row of its own, so that no row and no
array grows with a clip.  Short clips are decoded and resampled many at once, long ones segment by segment.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import by_value, frugal, slices, utf8

by_value(__name__)

UNIT = 64
RATE, WIDE_RATE = 8000, 16000
PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 17

# Fixed values of the IMA ADPCM format: quantiser steps, and index changes by the three low bits of a code.
IMA_STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
    7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]
IMA_SHIFTS = [-1, -1, -1, -1, 2, 4, 6, 8]


def mulaw_table() -> np.ndarray:
    """Linear 16-bit value of every mu-law code."""
    code = ~np.arange(256) & 0xFF
    size = ((((code & 0x0F) << 3) + 0x84) << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Linear 16-bit value of every A-law code."""
    code = np.arange(256) ^ 0x55
    low, exponent = (code & 0x0F) << 4, (code >> 4) & 7
    size = np.where(exponent == 0, low + 8, (low + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def ima_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each (index, code), flattened: the predictor's change and the next index."""
    step, code = np.array(IMA_STEPS, np.int32)[:, None], np.arange(16)[None, :]
    change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    change = np.where(code & 8, -change, change).astype(np.int32)
    following = np.clip(np.arange(len(IMA_STEPS))[:, None] + np.array(IMA_SHIFTS)[code & 7], 0, len(IMA_STEPS) - 1)
    return change.ravel(), (following * 16).ravel().astype(np.int32)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples of mono IMA ADPCM blocks: ``(n, size)`` bytes to ``(n, 1 + 2 * (size - 4))`` 16-bit values."""
    change, following = ima_tables()
    by_place = np.ascontiguousarray(blocks.T)
    predictor = (by_place[0].astype(np.uint16) | by_place[1].astype(np.uint16) << 8).view(np.int16).astype(np.int32)
    index = np.minimum(by_place[2], len(IMA_STEPS) - 1).astype(np.int32) * 16
    out = np.empty((1 + 2 * (len(by_place) - 4), len(blocks)), np.int16)
    out[0] = predictor
    for place in range(4, len(by_place)):
        for half, code in enumerate((by_place[place] & 15, by_place[place] >> 4)):
            at = index + code
            predictor = np.clip(predictor + change[at], -32768, 32767)
            index = following[at]
            out[2 * place - 7 + half] = predictor
    return np.ascontiguousarray(out.T)


def cubic(up: int) -> np.ndarray:
    """Weights of the four samples around each of ``up`` places between two samples."""
    return np.array([(-(f**3) + 2 * f**2 - f, 3 * f**3 - 5 * f**2 + 2, -3 * f**3 + 4 * f**2 + f, f**3 - f**2) for f in np.arange(up) / up]) / 2


def resample(pcm: np.ndarray, offsets: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
    """Cubic resampling of many clips laid end to end, at ``up / down`` times their rate; and their new offsets.

    A clip's edge samples continue beyond it.  No clip is empty.
    """
    counts = np.diff(offsets)
    made = -(-counts * up // down)
    ends = np.concatenate([[0], np.cumsum(made)])
    clip = np.repeat(np.arange(len(counts)), made)
    at = (np.arange(ends[-1]) - ends[clip]) * down
    low, phase = at // up, at % up
    weights = cubic(up)
    first, last = offsets[clip], offsets[clip + 1] - 1
    total = np.zeros(len(at))
    for k in range(4):
        total += weights[phase, k] * pcm[np.clip(first + low + (k - 1), first, last)]
    return np.clip(np.rint(total), -32768, 32767).astype(np.int16), ends


def resampled_part(kind: int, raw: np.ndarray, lo: int, hi: int, up: int, down: int) -> np.ndarray:
    """Samples ``lo`` to ``hi`` of a clip's resampling; only what they need of it is decoded."""
    n = samples_in(kind, len(raw))
    at = np.arange(lo, hi) * down
    low, phase = at // up, at % up
    first, last = max(0, int(low[0]) - 1), min(n - 1, int(low[-1]) + 2)
    pcm = decode_part(kind, raw, first, last + 1)
    weights, total = cubic(up), np.zeros(len(at))
    for k in range(4):
        total += weights[phase, k] * pcm[np.clip(low + (k - 1), 0, n - 1) - first]
    return np.clip(np.rint(total), -32768, 32767).astype(np.int16)


def wav_header(kind: int, rate: int, n_bytes: int, n_samples: int) -> bytes:
    """RIFF header of mono audio in the format ``kind``, up to its data."""
    block, bits, extra = {PCM: (2, 16, b""), ADPCM: (UNIT, 4, struct.pack("<H", 1 + 2 * (UNIT - 4)))}.get(kind, (1, 8, b""))
    speed = rate * n_bytes // max(n_samples, 1)
    about = struct.pack("<HHIIHHH", kind, 1, rate, speed, block, bits, len(extra)) + extra
    chunks = b"fmt " + struct.pack("<I", len(about)) + about + b"fact" + struct.pack("<II", 4, n_samples) + b"data" + struct.pack("<I", n_bytes)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks) + n_bytes) + b"WAVE" + chunks


def read_wav(media: bytes | memoryview) -> tuple[int, int, memoryview]:
    """Format, sample rate and the bytes of the data chunk."""
    view, at, kind, rate = memoryview(media), 12, 0, 0
    if bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
        raise ValueError("not a WAVE file")
    while at + 8 <= len(view):
        name, size = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
        if name == b"fmt ":
            kind, _, rate = struct.unpack_from("<HHI", view, at + 8)
        if name == b"data":
            return kind, rate, view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


ADPCM_SAMPLES = 1 + 2 * (UNIT - 4)


def samples_in(kind: int, n_bytes: int) -> int:
    """Samples of a clip's data chunk; bytes of an unfinished sample or block don't count."""
    return {PCM: n_bytes // 2, ADPCM: n_bytes // UNIT * ADPCM_SAMPLES}.get(kind, n_bytes)


def decode_many(kind: int, raw: np.ndarray) -> np.ndarray:
    """16-bit samples of whole clips of one format, laid end to end."""
    if kind == PCM:
        return raw.view("<i2")
    if kind == ADPCM:
        return decode_adpcm(raw.reshape(-1, UNIT)).ravel()
    return {MULAW: mulaw_table, ALAW: alaw_table}[kind]()[raw]


def decode_part(kind: int, raw: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Samples ``lo`` to ``hi`` of a clip."""
    if kind == ADPCM:
        first = lo // ADPCM_SAMPLES
        last = -(-hi // ADPCM_SAMPLES)
        return decode_many(kind, raw[first * UNIT : last * UNIT])[lo - first * ADPCM_SAMPLES : hi - first * ADPCM_SAMPLES]
    size = 2 if kind == PCM else 1
    return decode_many(kind, raw[lo * size : hi * size])


def store(df: DataFrame, payload: str = "text", media: str = "media", key: str = "doc_id") -> DataFrame:
    """Key, ``n_bytes`` and a mu-law WAV whose samples are the payload's bytes (a string counts as its UTF-8).

    Null payloads count as empty.  Zero bytes fill the payload up to a positive multiple of 64.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in slices(offsets, 2 << 20):
                made = []
                for i in range(lo, hi):
                    own = data[offsets[i] : offsets[i + 1]].tobytes()
                    size = max(UNIT, -(-len(own) // UNIT) * UNIT)
                    made.append(b"".join((wav_header(MULAW, RATE, size, size), own, bytes(size - len(own)))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets[lo : hi + 1])), pa.array(made, pa.binary())], names=[key, "n_bytes", media])

    return df.select(key, payload).mapInArrow(frugal(run), f"`{key}` {kind}, n_bytes long, `{media}` binary")


#: Samples in a segment of stored PCM, at most.
SEGMENT = 1 << 18


def widened(rows: pa.RecordBatch, media: str, segment: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, bytes | None]]]]:
    """For runs of rows: the row of each segment; and its number, the number of segments, and its WAV (null for null)."""
    clips, offsets = utf8(rows.column(media))
    missing = rows.column(media).is_null().to_numpy(zero_copy_only=False)
    for lo, hi in slices(offsets, segment):
        made: dict[int, list[bytes | None]] = {i: [None] for i in range(lo, hi) if missing[i]}
        alike: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for i in range(lo, hi):
            if missing[i]:
                continue
            kind, rate, data = read_wav(clips[offsets[i] : offsets[i + 1]].data)
            raw = np.frombuffer(data, np.uint8)
            up, down = WIDE_RATE // math.gcd(WIDE_RATE, rate), rate // math.gcd(WIDE_RATE, rate)
            n = -(-samples_in(kind, len(raw)) * up // down)
            if n <= segment:
                size = {PCM: 2, ADPCM: UNIT}.get(kind, 1)
                alike.setdefault((kind, rate), []).append((i, raw[: len(raw) // size * size]))
                continue
            # A long clip is a run of its own; its segments follow one by one.
            number = -(-n // segment)
            for k in range(number):
                part = resampled_part(kind, raw, k * segment, min(n, (k + 1) * segment), up, down)
                yield np.array([i]), [(k, number, wav_of(part))]
            made[i] = []
        for (kind, rate), held in alike.items():
            lengths = np.array([samples_in(kind, len(raw)) for _, raw in held])
            some = [i for i, n in enumerate(lengths) if n]
            ends = np.concatenate([[0], np.cumsum(lengths[some])]).astype(np.int64)
            if some:
                pcm = decode_many(kind, np.concatenate([held[i][1] for i in some]))
                wide, ends = resample(pcm, ends, WIDE_RATE // math.gcd(WIDE_RATE, rate), rate // math.gcd(WIDE_RATE, rate))
            for i, n in zip([i for i, _ in held], lengths, strict=True):
                made[i] = [wav_of(np.zeros(0, np.int16))] if not n else made.get(i, [])
            for at, i in enumerate(some):
                made[held[i][0]] = [wav_of(wide[ends[at] : ends[at + 1]])]
        found = [i for i in range(lo, hi) if made[i]]
        if found:
            yield np.array(found), [(0, 1, made[i][0]) for i in found]


def wav_of(pcm: np.ndarray) -> bytes:
    return wav_header(PCM, WIDE_RATE, 2 * len(pcm), len(pcm)) + pcm.astype("<i2").tobytes()


def pcm_rows(batches: Iterator[pa.RecordBatch], media: str, out: str, segment: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [c for c in batch.schema.names if c not in (media, out, "segment", "segments")]
        for at, found in widened(batch, media, segment):
            columns = [batch.column(c).take(pa.array(at)) for c in keep]
            number, count, clip = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(number, pa.int32()), pa.array(count, pa.int32()), pa.array(clip, pa.binary())], names=[*keep, "segment", "segments", out])


def to_pcm(df: DataFrame, media: str = "media", out: str = "pcm", segment: int = SEGMENT) -> DataFrame:
    """Each stored clip, of any of the four formats, as 16-bit PCM at 16 kHz in WAVs of at most ``segment`` samples.

    A row for each segment: the columns of ``df`` but for ``media``, ``segment`` (from 0), ``segments`` and ``out``.  A
    row's segments follow each other in order.  A clip without samples has one empty segment, null one that is null.
    """
    keep = [f for f in df.schema if f.name not in (media, out, "segment", "segments")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + f"{', ' * bool(keep)}segment int, segments int, `{out}` binary"
    return df.mapInArrow(frugal(lambda batches: pcm_rows(batches, media, out, segment)), schema)


def described(batches: Iterator[pa.RecordBatch], key: str, media: str) -> Iterator[pa.RecordBatch]:
    """Digests of stored clips and of the payload in them, and what that is as A-law and as ADPCM; ``media`` stays."""
    alaw = alaw_table().astype(np.int64) ** 2
    for batch in batches:
        clips, offsets = utf8(batch.column(2))
        for lo, hi in slices(offsets, 1 << 20):
            rows = []
            views = [read_wav(clips[offsets[i] : offsets[i + 1]].data)[2] for i in range(lo, hi)]
            raws = [np.frombuffer(v, np.uint8) for v in views]
            short = hi > lo + 1 or len(raws[0]) <= 1 << 20
            blocks = decode_adpcm(np.concatenate(raws).reshape(-1, UNIT)) if short else None
            first = 0
            for i, view, raw in zip(range(lo, hi), views, raws, strict=True):
                coded, power = 0, 0
                for at in range(0, len(raw), 1 << 20):
                    part = raw[at : at + (1 << 20)]
                    n = len(part) // UNIT
                    decoded = blocks[first : first + n] if short else decode_adpcm(part.reshape(-1, UNIT))
                    first += n
                    coded = zlib.crc32(np.ascontiguousarray(decoded, "<i2").data, coded)
                    power += int(np.bincount(part, minlength=256) @ alaw)
                clip = clips[offsets[i] : offsets[i + 1]]
                rows.append((len(raw), hashlib.sha256(view).hexdigest(), zlib.crc32(view[-UNIT:]), len(clip), hashlib.sha256(clip.data).hexdigest(), f"alaw_rms={math.isqrt(power // len(raw))} adpcm={coded:08x}"))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=[key, "n_bytes", media, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "coded"])


def heard(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
    """One row for each clip, from its segments' rows: level, peak, zero crossings and checksum of its PCM, and its size."""
    power = peak = turns = n = size = crc = 0
    below = None
    for batch in batches:
        number, count = (batch.column(c).to_numpy() for c in ("segment", "segments"))
        ends, features, sizes = [], [], []
        for i, clip in enumerate(batch.column("pcm")):
            if number[i] == 0:
                power = peak = turns = n = size = crc = 0
                below = None
            view = clip.as_buffer()
            data = read_wav(memoryview(view))[2]
            pcm = np.frombuffer(data, "<i2")
            if len(pcm):
                wide = pcm.astype(np.float64)
                power += int(wide @ wide)
                peak = max(peak, int(wide.max()), -int(wide.min()))
                low = pcm < 0
                turns += int(np.count_nonzero(low[1:] != low[:-1])) + int(below is not None and below != low[0])
                below = low[-1]
                crc = zlib.crc32(data, crc)
            n += len(pcm)
            size += view.size
            if number[i] == count[i] - 1:
                ends.append(i)
                sizes.append(size)
                features.append(f"rms={math.isqrt(power // max(n, 1))} peak={peak} zc={turns} pcm16k={crc:08x}")
        if ends:
            done = batch.take(pa.array(ends))
            whole = [f"{f} {c}" for f, c in zip(features, done.column("coded").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(done.column(c) for c in keep), pa.array(whole), pa.array(sizes, pa.int64())], names=[*keep, "feature", "pcm_bytes"])


def digests(stored: DataFrame, media: str = "media", key: str = "doc_id", segment: int = SEGMENT) -> DataFrame:
    """Digests and features of what ``store`` wrote, one row for each row: from the bytes read back out of the WAV, and
    from the PCM at 16 kHz stored in segments and read back.  All in whole numbers, so equal anywhere.
    """
    kind = stored.schema[key].dataType.simpleString()
    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    kinds = [kind, "long", "long", "string", "long", "long", "string"]
    small = ", ".join(f"`{n}` {t}" for n, t in zip(names, kinds, strict=True))
    wide = stored.select(key, "n_bytes", media).mapInArrow(
        frugal(lambda batches: pcm_rows(described(batches, key, media), media, "pcm", segment)), f"{small}, coded string, segment int, segments int, pcm binary"
    )
    return wide.mapInArrow(frugal(lambda batches: heard(batches, names)), f"{small}, feature string, pcm_bytes long")
