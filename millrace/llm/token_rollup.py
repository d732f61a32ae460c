"""Token counts kept up by deltas: totals by source, language and tokenizer version.

A batch is a table of changes.  An insert adds a text's count, a delete takes it away, and a revision takes the old
count away where it stood and adds the new one, which may have another source, language or version.  A batch is summed
up to one signed row for each group before anything is stored, so what a commit writes is small.  Batches are
committed under their own names: a commit writes to a folder of its own and moves it into place, and a name that is
already there is left alone, so a batch that is sent twice counts once; a different batch under the same name is refused.
Totals are kept with the list of batches in them and brought up to date by the batches that came later.

A commit is a rename, which must be atomic: on an object store where it isn't, one driver at a time may commit.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import by_value, frugal

by_value(__name__)

GROUP = ("source", "lang", "version")
TOTALS = "source string, lang string, version string, docs long, tokens long"
#: Changes: what a row was before (nulls for an insert) and is after (nulls for a delete).
CHANGES = "op string, source string, lang string, version string, tokens long, old_source string, old_lang string, old_version string, old_tokens long"
NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,99}")


def signed(changes: DataFrame) -> DataFrame:
    """One signed row for each group that a batch of changes touches.  Unknown operations fail the job."""
    known = F.when(F.col("op").isin("insert", "delete", "revise"), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown operation "), F.coalesce("op", F.lit("null")))))

    def side(sign: int, prefix: str) -> Column:
        tokens = F.coalesce(F.col(f"{prefix}tokens"), F.lit(0)) * sign
        return F.struct(*[F.col(f"{prefix}{g}").alias(g) for g in GROUP], F.lit(sign).cast("long").alias("docs"), tokens.cast("long").alias("tokens"))

    after, before = side(1, ""), side(-1, "old_")
    sides = F.when(known == "insert", F.array(after)).when(known == "delete", F.array(before)).otherwise(F.array(before, after))
    rows = changes.select(F.explode(sides).alias("s")).select("s.*")
    return rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs != 0 or tokens != 0")


@dataclass(frozen=True)
class TokenRollup:
    """Totals stored under ``path``, which all executors must share."""

    spark: SparkSession
    path: str
    fold_every: int = 16

    def _fs(self, path: str) -> tuple:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def committed(self) -> list[str]:
        fs, root = self._fs(f"{self.path}/commits")
        if not fs.exists(root):
            return []
        return sorted(s.getPath().getName().removeprefix("batch=") for s in fs.listStatus(root) if s.getPath().getName().startswith("batch="))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of changes; False, and nothing written, if the same batch is there already.

        A different batch under a name that is taken raises ``ValueError``.  Every ``fold_every`` commits the totals
        are brought up to date, so reading them opens few files, however many batches there were.
        """
        if not NAME.fullmatch(batch):
            raise ValueError(f"not a batch name: {batch!r}")
        fs, target = self._fs(f"{self.path}/commits/batch={batch}")
        if fs.exists(target):
            return self._again(batch, signed(changes))
        made = f"{self.path}/pending/{uuid.uuid4().hex}"
        signed(changes).write.parquet(made)
        fs.mkdirs(target.getParent())
        source = self._fs(made)[1]
        # A rename onto a folder that another driver made meanwhile would move into it.
        if fs.exists(target) or not fs.rename(source, target):
            again = self.spark.read.schema(TOTALS).parquet(made)
            try:
                return self._again(batch, again)
            finally:
                fs.delete(source, True)
        if len(self.committed()) - len(self._folded()[1]) >= self.fold_every:
            self.fold()
        return True

    def _again(self, batch: str, rows: DataFrame) -> bool:
        there = self._deltas([batch])
        if rows.exceptAll(there).limit(1).count() or there.exceptAll(rows).limit(1).count():
            raise ValueError(f"another batch is committed under the name {batch!r}")
        return False

    def _deltas(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(TOTALS).parquet(*[f"{self.path}/commits/batch={n}" for n in names])

    def _folded(self) -> tuple[str | None, set[str]]:
        """The newest complete totals, and the batches in them."""
        fs, root = self._fs(f"{self.path}/totals")
        if not fs.exists(root):
            return None, set()
        found = sorted(s.getPath().getName() for s in fs.listStatus(root))
        for name in reversed(found):
            where = f"{self.path}/totals/{name}"
            if fs.exists(self._fs(f"{where}/batches/_SUCCESS")[1]):
                return where, {r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{where}/batches").toLocalIterator()}
        return None, set()

    def fold(self) -> None:
        """Write totals that hold all batches so far.  The list of their batches is written last and makes them valid;
        older totals stay until the next fold, for those that still read them."""
        names = self.committed()
        where = f"{self.path}/totals/{len(names):012d}-{uuid.uuid4().hex}"
        fs, root = self._fs(f"{self.path}/totals")
        before = sorted(s.getPath().getName() for s in fs.listStatus(root)) if fs.exists(root) else []
        self._sum(names).write.parquet(f"{where}/rows")
        self.spark.createDataFrame([(n,) for n in names], "batch string").write.parquet(f"{where}/batches")
        for old in before[:-1]:
            fs.delete(self._fs(f"{self.path}/totals/{old}")[1], True)

    def totals(self) -> DataFrame:
        """``source, lang, version, docs, tokens``: the last totals and what was committed since; groups that came to
        nothing are left out."""
        return self._sum(self.committed())

    def _sum(self, committed: list[str]) -> DataFrame:
        where, folded = self._folded()
        names = [n for n in committed if n not in folded]
        parts = [self._deltas(names)] if names else []
        if where:
            parts.append(self.spark.read.schema(TOTALS).parquet(f"{where}/rows"))
        if not parts:
            return self.spark.createDataFrame([], TOTALS)
        return reduce(DataFrame.unionByName, parts).groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs != 0 or tokens != 0")


def words(text: Column) -> Column:
    """Version ``words-1``: runs of characters other than blanks, tabs and line ends."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \t\n\r\f]+"), "")).cast("long")


def letters(text: Column) -> Column:
    """Version ``letters-1``: runs of ASCII letters and digits and of other characters beyond ASCII."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")).cast("long")


def bpe(df: DataFrame, ranks_file: str, pattern: str, text: str = "text", out: str = "tokens") -> DataFrame:
    """``df`` with the number of byte-pair tokens of each whole text, null counted as empty; ``text`` is dropped.

    ``ranks_file`` must be readable on every executor; each Python worker reads it once.
    """
    keep = [f for f in df.schema if f.name not in (text, out)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), f"`{out}` long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        opened = tiktoken.__dict__.setdefault("_millrace_encodings", {})
        if (ranks_file, pattern) not in opened:
            with open(ranks_file, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            opened[ranks_file, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        encoding = opened[ranks_file, pattern]
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = [len(encoding.encode_ordinary(t or "")) for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in keep), pa.array(found, pa.int64())], names=[*(f.name for f in keep), out])

    return df.mapInArrow(frugal(run), schema)


def changes(rows: DataFrame, op: str, new: dict[str, Column] | None = None, old: dict[str, Column] | None = None) -> DataFrame:
    """Rows as changes: ``new`` and ``old`` give source, lang, version and tokens after and before."""
    nothing = F.lit(None)
    cells = [F.lit(op).alias("op")]
    for prefix, side in (("", new), ("old_", old)):
        cells += [(side or {}).get(c, nothing).cast("string").alias(prefix + c) for c in GROUP]
        cells += [(side or {}).get("tokens", nothing).cast("long").alias(prefix + "tokens")]
    return rows.select(*cells)
