"""SentencePiece encoding and decoding over a table of distinct marked words.

A text is cut before every run of whitespace markers.  No piece of the model may hold a marker after another
character, so no merge crosses such a cut and each marked word is segmented alone, once, whatever the number of its
occurrences.  A text's ids are its words' ids joined by position.  Models whose pieces do cross markers, or whose
normaliser changes text, are encoded whole by the library instead.

The table of distinct words is made first: each task counts its words, counts are added up, and the most frequent
words, ``table_words`` at most, are segmented once and written with their ids.  The table goes to all tasks as a
broadcast of that bound.  Rarer words are segmented where they occur, once for each worker that has room for them; to
join those too would shuffle an occurrence for each.  Which words the table holds changes no result.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import by_value, durable, frugal

by_value(__name__)

MARK = "▁"


@dataclass(frozen=True)
class PieceCodec:
    """``model_file`` must be readable on every executor.  The shared table holds ``table_words`` words at most, and a
    worker's own beside it as many and one block of a text more."""

    model_file: str
    table_words: int = 300_000
    bos: bool = True
    eos: bool = True

    def open(self, shared: SharedTable | None = None) -> WordTable:
        """This process's table; later tasks of the same Python worker find the words of earlier ones."""
        import sentencepiece

        tables = sentencepiece.__dict__.setdefault("_millrace_tables", {})
        name = self, shared and shared.name
        if name not in tables:
            tables.clear()
            tables[name] = WordTable(self, shared)
        return tables[name]


@dataclass(frozen=True)
class SharedTable:
    """A broadcast of words, the number of ids of each, and all ids."""

    name: str
    rows: object


def proto_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
            yield tag >> 3, data[at : at + size]
            at += size


def keeps_text(model: bytes) -> bool:
    """Whether a model's normaliser keeps every text as it is, but for markers: no mapping, no blanks removed, a marker
    put before each text."""
    spec = dict(proto_fields(b"".join(v for k, v in proto_fields(model) if k == 3)))
    trainer = dict(proto_fields(b"".join(v for k, v in proto_fields(model) if k == 2)))
    return not spec.get(2) and spec.get(3, 1) == 1 and spec.get(4, 1) == 0 and spec.get(5, 1) == 1 and not trainer.get(24, 0)


#: Characters of a text that are cut into words at once, and ids that are decoded at once, about.
BLOCK = 1 << 20
WORD_END = re.compile("(?<! ) ")


class Rows(dict):
    """Row numbers of words; a word that is looked up for the first time gets the next one and is noted in ``fresh``."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        self.fresh.append(word)
        return row


class WordTable:
    def __init__(self, codec: PieceCodec, shared: SharedTable | None = None) -> None:
        import sentencepiece

        self.codec, self.shared = codec, shared
        self.sp = sentencepiece.SentencePieceProcessor(model_file=codec.model_file)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        crossing = any(MARK in p.lstrip(MARK) for p in pieces) or self.sp.piece_to_id(MARK) == self.sp.unk_id()
        self.separable = not crossing and keeps_text(self.sp.serialized_model_proto())
        self.marked = np.array([p.startswith(MARK) for p in pieces])
        self._clear()

    def _clear(self) -> None:
        self.row = Rows()
        self.starts = np.zeros(1024, np.int64)
        self.counts = np.zeros(1024, np.int64)
        self.pool = np.zeros(8192, np.uint32)
        self.rows = self.used = 0
        if self.shared:
            words, counts, pool = self.shared.rows.value
            self.row.update(zip(words.to_pylist(), range(len(words)), strict=True))
            self._put(counts.astype(np.int64), pool)
        self.most = self.rows + self.codec.table_words

    def segmented(self, words: list[str]) -> list[list[int]]:
        """Ids of marked words.  A word comes without its first marker: the library puts it there itself."""
        found = self.sp.encode(words, num_threads=1)
        if "" in words:  # the library puts no marker before an empty text
            found = [ids if w else [self.sp.piece_to_id(MARK)] for w, ids in zip(words, found, strict=True)]
        return found

    def _add(self, words: list[str]) -> None:
        """Segment new words, whose rows are taken already."""
        found = self.segmented(words)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        self._put(counts, np.fromiter((i for ids in found for i in ids), np.uint32, int(counts.sum())))

    def _put(self, counts: np.ndarray, flat: np.ndarray) -> None:
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.rows + len(counts) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        self.pool[self.used : self.used + len(flat)] = flat
        at = slice(self.rows, self.rows + len(counts))
        self.starts[at] = self.used + np.cumsum(counts) - counts
        self.counts[at] = counts
        self.rows += len(counts)
        self.used += len(flat)

    @staticmethod
    def words(text: str) -> list[str]:
        """Marked words of a text, each without its first marker; joined by a blank they give the text back."""
        if MARK in text:
            text = text.replace(MARK, " ")
        parts = text.split(" ")
        if "" not in parts:
            return parts
        # Blanks in a row belong to the word that follows them; those at the end make a word of their own.
        out, blanks = [], 0
        for i, part in enumerate(parts):
            if part:
                out.append(" " * blanks + part)
                blanks = 0
            elif i < len(parts) - 1:
                blanks += 1
            else:
                out.append(" " * blanks)
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text as unsigned 32-bit integers."""
        text = text or ""
        bos = [self.sp.bos_id()] if self.codec.bos else []
        eos = [self.sp.eos_id()] if self.codec.eos else []
        if not text:
            ids = np.zeros(0, np.uint32)
        elif not self.separable:
            ids = np.array(self.sp.encode(text), np.uint32)
        else:
            parts = [self._ids(self.words(part)) for part in blocks(text)]
            ids = np.concatenate(parts) if len(parts) > 1 else parts[0]
        return np.concatenate([np.array(bos, np.uint32), ids, np.array(eos, np.uint32)])

    def _ids(self, words: list[str]) -> np.ndarray:
        if self.rows > self.most:
            self._clear()
        rows = np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))
        if self.row.fresh:
            self._add(self.row.fresh)
            self.row.fresh = []
        counts = self.counts[rows]
        ends = np.cumsum(counts)
        return self.pool[np.repeat(self.starts[rows] - ends + counts, counts) + np.arange(ends[-1])]

    def decoded(self, ids: np.ndarray) -> Iterator[str]:
        """The library's decoding, in parts: cut before pieces that begin with a marker, which is a blank but at the
        beginning of a text."""
        at = 0
        while at < len(ids):
            end = len(ids)
            if self.separable and at + BLOCK < end:
                found = np.flatnonzero(self.marked[ids[at + BLOCK :]])
                end = at + BLOCK + int(found[0]) if len(found) else end
            yield " " * (at > 0) + self.sp.decode(ids[at:end].tolist())
            at = end

    def decode(self, ids: np.ndarray) -> str:
        return "".join(self.decoded(ids))


def blocks(text: str) -> Iterator[str]:
    """A text in parts of about ``BLOCK`` characters, cut at the blank before a word, which belongs to neither."""
    if len(text) > BLOCK and MARK in text:
        text = text.replace(MARK, " ")
    at = 0
    while True:
        found = WORD_END.search(text, at + BLOCK) if at + BLOCK < len(text) else None
        if not found:
            yield text[at:]
            return
        yield text[at : found.start()]
        at = found.end()


def distinct_words(df: DataFrame, codec: PieceCodec, text: str = "text") -> DataFrame:
    """``word, ids``: the most frequent marked words, ``codec.table_words`` at most, each segmented once.

    Tasks pass on what they met at least twice, so counts of rare words may be too small.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held = codec.open(), Counter()
        if not table.separable:
            return  # texts are encoded whole

        def flush() -> pa.RecordBatch:
            often = {w: n for w, n in held.items() if n > 1}
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(often, pa.string()), pa.array(often.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                for value in batch.column(0).slice(lo, 256).to_pylist():
                    for part in blocks(value or ""):
                        held.update(table.words(part))
                if len(held) > 500_000:
                    yield flush()
        yield flush()

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = codec.open()
        for batch in batches:
            for lo in range(0, batch.num_rows, 10_000):
                words = batch.column(0).slice(lo, 10_000).to_pylist()
                ids = [np.array(x, "<u4").tobytes() for x in table.segmented(words)]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(ids, pa.binary())], names=["word", "ids"])

    spark = df.sparkSession
    counted = durable(df.select(text).mapInArrow(frugal(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "pieces-counts")
    # The least power of two such that no more words than wanted are as frequent.
    sizes = sorted(((r["size"], r["count"]) for r in counted.groupBy(F.floor(F.log2("n")).alias("size")).count().collect()), reverse=True)
    least, total = None, 0
    for size, number in sizes:
        total += number
        if total > codec.table_words:
            break
        least = size
    if least is None:
        return spark.createDataFrame([], "word string, ids binary")
    return durable(counted.filter(F.col("n") >= 2**least).select("word").mapInArrow(frugal(segment), "word string, ids binary"), "pieces-table")


def shared_table(df: DataFrame, codec: PieceCodec, text: str = "text") -> SharedTable:
    """``distinct_words`` of a table's texts as a broadcast."""
    found = distinct_words(df, codec, text).toArrow().combine_chunks()
    words, ids = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (found.column("word"), found.column("ids")))
    counts = np.fromiter((len(x) // 4 for x in ids.to_pylist()), np.uint32, len(ids))
    pool = np.frombuffer(b"".join(ids.to_pylist()), "<u4")
    return SharedTable(uuid.uuid4().hex, df.sparkSession.sparkContext.broadcast((words, counts, pool)))


def encode(df: DataFrame, codec: PieceCodec, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with a column ``ids array<bigint>``.  Null and empty texts have the begin and end ids alone."""
    names = df.columns
    keep = [c for c in names if c != ids]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != ids) + f", `{ids}` array<bigint>"
    shared = shared_table(df, codec, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = codec.open(shared)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = [table.encode(t) for t in part.column(text).to_pylist()]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                flat = np.concatenate(found).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[*keep, ids])

    return df.mapInArrow(frugal(run), schema)


def decode(df: DataFrame, codec: PieceCodec, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the library's decoding of ``ids``; a null list decodes to the empty text."""
    keep = [c for c in df.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text) + f", `{text}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = codec.open()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = [table.sp.decode(x or []) for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(found, pa.string())], names=[*keep, text])

    return df.mapInArrow(frugal(run), schema)


def round_trip_digests(df: DataFrame, codec: PieceCodec, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: its key, number of ids, and digests of the ids and of the text decoded from them.

    Ids are hashed as little-endian unsigned 32-bit integers, the decoded text as UTF-8.  Null texts count as empty;
    repeated rows give repeated results; columns other than ``key`` and ``text`` aren't read.
    """
    kind = df.schema[key].dataType.simpleString()
    shared = shared_table(df, codec, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = codec.open(shared)
        for batch in batches:
            counts, coded, decoded = [], [], []
            for lo in range(0, batch.num_rows, 256):
                for value in batch.column(1).slice(lo, 256).to_pylist():
                    ids = table.encode(value)
                    counts.append(len(ids))
                    coded.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    digest = hashlib.sha256()
                    for part in table.decoded(ids):
                        digest.update(part.encode())
                    decoded.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(key, text).mapInArrow(frugal(run), f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
