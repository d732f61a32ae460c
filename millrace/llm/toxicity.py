"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon reads a text word by word and writes symbols: insult, threat, target, negation, reported speech, or other.
Its insults are whole words and word beginnings whose weights are log odds learnt from labelled texts, above a seed
list; the others are closed word classes of four languages.  Four transducers then rewrite the symbols of a clause one
after another: negation marks insults and threats within its scope, reported speech those that it embeds, a threat is
completed by a target that follows it, and an insult is aimed by a target before or behind it.  They are composed into
one automaton, which adds up amounts along its path: weight of insults, insults aimed, weight of those negated or
reported, threats, threats negated or reported.  A clause whose path writes none of these is not accepted and scores
nothing; what the amounts weigh is fitted on labelled texts, and a text's score is a logistic curve over its clauses.

Most clauses hold no insult and no threat: their symbols are found by a search, and only the others are read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import by_value, chunks, durable, frugal

by_value(__name__)

# Closed word classes in English, German, French and Spanish.
TARGETS = frozenset("you your yours yourself u he she him her they them his hers their who everyone people dich dir du ihr euch sie ihn ihm tu toi te vous ton ta tes votre vos il elle eux usted ustedes ti tus vosotros ellos ellas".split())
NEGATIONS = frozenset("not no never neither nor cannot isn't aren't wasn't don't doesn't didn't won't nicht kein keine keinen nie niemals pas jamais aucun aucune ni nunca jamás tampoco ningún ninguna".split())
REPORTS = frozenset("said says say told quoted wrote claimed called reported according heard sagte sagt laut meinte schrieb behauptete dit disait selon écrit dijo dice según escribió llamó".split())
THREATS = frozenset("kill hurt destroy beat punch stab shoot burn crush strangle töten schlagen vernichten erschießen tuer frapper détruire brûler matar golpear destruir quemar".split())
INSULTS = {w: 2.0 for w in "idiot moron stupid scum trash loser pathetic worthless disgusting dumb vermin bastard imbecile dummkopf idiotin arschloch abschaum crétin imbécile ordure connard estúpido imbécil idiota basura".split()}

TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:,\n\r|]")
BREAKS = frozenset(".!?;:,\n\r|")
#: Lengths of word beginnings that may become states of the insult trie, and the mark of such an entry.
STEMS = range(4, 11)
STEM = "\x1f"


@dataclass(frozen=True)
class Fit:
    """``labelled_rows`` bounds the labelled texts the grammar is fitted on, those of smallest hash; all if fewer."""

    labelled_rows: int = 20_000
    #: A word or beginning enters the trie if toxic texts hold it in ``least_texts`` and its log odds reach ``least_odds``.
    least_texts: int = 4
    least_odds: float = 2.5
    most_entries: int = 50_000


# Symbols of the lexicon.  An insult's symbol is INSULT plus its weight in eighths.
OTHER, TARGET, NEGATION, REPORT, THREAT, COMMA, STOP = range(7)
INSULT = 16
EIGHTHS = 96
#: What the transducers add to the alphabet: softened insult and threat, and a threat that a target completes.
SOFT_INSULT, SOFT_THREAT, DONE_THREAT, DONE_SOFT = range(7, 11)
ONE_INSULT = 11

#: Words that a negation reaches, words from a threat to its target, and words between an insult and its target.
SCOPE, REACH, BEFORE, BEHIND = 3, 4, 4, 2

#: Amounts of a clause: weight of insults, insults aimed, weight of softened insults, threats, softened threats.
AMOUNTS = ("insult", "aimed", "softened", "threat", "softened_threat")


class Transducer:
    """Deterministic: for a state and a symbol, the next state and the symbol written.  State 0 is the first."""

    def __init__(self, states: int, step: Callable[[int, int], tuple[int, int]]) -> None:
        self.states, self.step = states, step

    def write(self, symbols: list[int]) -> list[int]:
        state, out = 0, []
        for s in symbols:
            state, found = self.step(state, s)
            out.append(found)
        return out


def softened(symbol: int) -> int:
    return {ONE_INSULT: SOFT_INSULT, THREAT: SOFT_THREAT}.get(symbol, symbol)


def negating(state: int, symbol: int) -> tuple[int, int]:
    """The state is how many more words the negation reaches; a clause's end or reported speech ends it."""
    if symbol in (COMMA, STOP, REPORT):
        return 0, symbol
    if symbol == NEGATION:
        return SCOPE, symbol
    return max(0, state - 1), softened(symbol) if state else symbol


def reporting(state: int, symbol: int) -> tuple[int, int]:
    """From a word of reporting on, all up to the end of the sentence is embedded."""
    if symbol == STOP:
        return 0, symbol
    if symbol == REPORT:
        return 1, symbol
    return state, softened(symbol) if state else symbol


def threatening(state: int, symbol: int) -> tuple[int, int]:
    """A threat waits for a target; the state holds how many more words, and above REACH that it is softened."""
    if symbol in (COMMA, STOP):
        return 0, symbol
    if symbol == THREAT:
        return REACH, OTHER
    if symbol == SOFT_THREAT:
        return 2 * REACH, OTHER
    if symbol == TARGET and state:
        return 0, DONE_SOFT if state > REACH else DONE_THREAT
    return 0 if state in (0, 1, REACH + 1) else state - 1, symbol


def aiming(state: int, symbol: int) -> tuple[int, tuple[int, ...]]:
    """The last transducer writes amounts.  Its state holds how many more words a target reaches forward (up to BEFORE)
    and an insult backward (up to BEHIND)."""
    forward, backward = state % (BEFORE + 1), state // (BEFORE + 1)
    if symbol in (COMMA, STOP):
        return 0, ()
    amounts: tuple[int, ...] = ()
    after = max(0, forward - 1), max(0, backward - 1)
    if symbol == ONE_INSULT:
        amounts = (0, 1) if forward else (0,)
        after = after[0], 0 if forward else BEHIND
    elif symbol == SOFT_INSULT:
        amounts = (2,)
    elif symbol in (TARGET, DONE_THREAT, DONE_SOFT):
        amounts = {DONE_THREAT: (3,), DONE_SOFT: (4,)}.get(symbol, ()) + ((1,) if backward else ())
        after = BEFORE, 0
    return after[0] + (BEFORE + 1) * after[1], amounts


CASCADE = (Transducer(SCOPE + 1, negating), Transducer(2, reporting), Transducer(2 * REACH + 1, threatening), Transducer((BEFORE + 1) * (BEHIND + 1), aiming))


def compose(cascade: tuple[Transducer, ...]) -> tuple[list[list[int]], list[list[tuple[int, ...]]]]:
    """The cascade as one automaton over the states that can be reached: next states and amounts, by state and symbol."""
    known, waiting = {(0,) * len(cascade): 0}, [(0,) * len(cascade)]
    follow: list[list[int]] = []
    write: list[list[tuple[int, ...]]] = []
    while len(follow) < len(waiting):
        states = waiting[len(follow)]
        follow.append([])
        write.append([])
        for symbol in range(ONE_INSULT + 1):
            out, after = symbol, []
            for t, state in zip(cascade, states, strict=True):
                now, out = t.step(state, out)
                after.append(now)
            if tuple(after) not in known:
                known[tuple(after)] = len(known)
                waiting.append(tuple(after))
            follow[-1].append(known[tuple(after)])
            write[-1].append(out)
    return follow, write


FOLLOW, WRITE = compose(CASCADE)
HIT = re.compile(b"[" + bytes([THREAT]) + b"\\" + bytes([INSULT]) + b"-\xff]")
SENTENCE = re.compile(b"[^" + bytes([STOP]) + b"]+")
CLAUSE = re.compile(b"[^" + bytes([COMMA, STOP]) + b"]+")


class Lexicon(dict):
    """Symbols of words; those not seen yet are read by their beginnings."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]) -> None:
        super().__init__({w: STOP for w in ".!?;\n\r"} | {w: COMMA for w in ",:|"})
        self.words, self.stems = words, stems

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
            self.__init__(self.words, self.stems)
            if word in self:
                return self[word]
        weight = self.words.get(word, 0.0)
        for n in STEMS:
            if n > len(word):
                break
            weight = max(weight, self.stems.get(word[:n], 0.0))
        eighths = min(EIGHTHS, round(8 * weight))
        found = INSULT + eighths if eighths else THREAT if word in THREATS else NEGATION if word in NEGATIONS else REPORT if word in REPORTS else TARGET if word in TARGETS else OTHER
        self[word] = found
        return found


@dataclass(frozen=True)
class Grammar:
    """Weights of the lexicon and of the composed automaton.  ``words`` are whole words, ``stems`` beginnings of words."""

    words: dict[str, float]
    stems: dict[str, float]
    #: What one of each of AMOUNTS weighs.
    weights: tuple[float, ...] = (1.0, 1.0, 0.35, 2.0, 0.5)
    #: Bias, and weights of the best clause, of all clauses together, and of matched clauses per clause.
    curve: tuple[float, ...] = (-3.0, 1.0, 0.5, 1.0)
    memo: list[Lexicon] = field(default_factory=list, compare=False, repr=False)

    @property
    def threat(self) -> float:
        return self.weights[3]

    def symbols(self, text: str | None) -> bytes:
        """One byte for each word and mark."""
        if not self.memo:
            self.memo.append(Lexicon(self.words, self.stems))
        read = self.memo[0].__getitem__
        return b"".join(bytes(map(read, TOKEN.findall(part.lower()))) for part in chunks(text or ""))

    @staticmethod
    def amounts(sentence: bytes) -> list[list[float]]:
        """Amounts of each clause of a sentence's symbols that the automaton accepts."""
        state, found, out = 0, None, []
        for symbol in sentence:
            weight = (symbol - INSULT) / 8 if symbol >= INSULT else 0.0
            kind = ONE_INSULT if symbol >= INSULT else symbol
            for at in WRITE[state][kind]:
                found = found or [0.0] * len(AMOUNTS)
                found[at] += weight if at in (0, 2) else 1.0
            state = FOLLOW[state][kind]
            if symbol in (COMMA, STOP) and found:
                out.append(found)
                found = None
        if found:
            out.append(found)
        return out

    def clauses(self, text: str | None) -> tuple[int, list[list[float]]]:
        """Number of clauses with words, and the amounts of each that is accepted."""
        symbols = self.symbols(text)
        if not symbols:
            return 0, []
        number = len(CLAUSE.findall(symbols))
        if not HIT.search(symbols):
            return number, []
        return number, [a for s in SENTENCE.findall(symbols) if HIT.search(s) for a in self.amounts(s)]

    def weigh(self, amounts: list[float]) -> float:
        return min(12.0, sum(w * a for w, a in zip(self.weights, amounts, strict=True)))

    def clause_weights(self, text: str | None) -> tuple[int, list[float]]:
        """Number of clauses with words, and the weight of each that is accepted."""
        number, found = self.clauses(text)
        return number, [self.weigh(a) for a in found]

    @staticmethod
    def features(clauses: int, weights: list[float]) -> tuple[float, float, float, float]:
        """What the curve is over: the best clause, all clauses together, and the share of clauses that matched."""
        if not weights:
            return 1.0, 0.0, 0.0, 0.0
        return 1.0, max(weights), math.log1p(sum(weights)), len(weights) / clauses

    def curved(self, clauses: int, weights: list[float]) -> float:
        z = sum(w * x for w, x in zip(self.curve, self.features(clauses, weights), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def score(self, text: str | None) -> float:
        """Between 0 and 1; a text without an accepted clause has the curve's lowest value."""
        return self.curved(*self.clause_weights(text))


def entries(text: str | None) -> set[str]:
    """Distinct words of a text, and their distinct beginnings."""
    words = {w for part in chunks(text or "") for w in TOKEN.findall(part.lower()) if w not in BREAKS}
    return words | {STEM + w[:n] for w in words for n in STEMS if n <= len(w)}


def count_entries(labelled: DataFrame) -> DataFrame:
    """Toxic and clean texts that hold each word or beginning: ``entry, toxic, clean``; rows of ``text, label``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter[str], Counter[str]] = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            names = list(counts[0] | counts[1])
            made = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][x] for x in names], pa.int64()), pa.array([counts[0][x] for x in names], pa.int64())], names=["entry", "toxic", "clean"])
            counts[0].clear(), counts[1].clear()
            return made

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[int(label == 1)].update(entries(text))
                if len(counts[0]) + len(counts[1]) > 150_000:
                    yield flush()
        yield flush()

    return labelled.mapInArrow(frugal(run), "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fitted_weights(totals: np.ndarray, y: np.ndarray, start: tuple[float, ...], ridge: float = 4.0) -> tuple[float, ...]:
    """What amounts weigh: a logistic curve over the logarithm of a text's weighed amounts, fitted by gradient steps.

    Weights are held near ``start`` by a ridge and are never negative, so amounts that no labelled text has keep theirs.
    """
    w, bias, slope = np.array(start), -3.0, 2.0
    rate = 0.5
    for _ in range(400):
        total = totals @ w
        z = np.clip(bias + slope * np.log1p(total), -30, 30)
        miss = 1 / (1 + np.exp(-z)) - y
        scale = max(1.0, float(len(y)))
        grad = (totals * (miss * slope / (1 + total))[:, None]).sum(axis=0) / scale + ridge * (w - start) / scale
        bias -= rate * miss.sum() / scale
        slope = max(0.1, slope - rate * (miss * np.log1p(total)).sum() / scale)
        w = np.clip(w - rate * grad, 0.0, 4.0)
    return tuple(round(float(v), 4) for v in w)


def fit(labelled: DataFrame, how: Fit | None = None) -> Grammar:
    """Fit on rows of ``text, label`` (label 1 is toxic); with no toxic or no clean row the seeds alone are used.

    At most ``how.labelled_rows`` rows may be given: their texts' entries are counted by Spark, and the trie and the
    few numbers of each text for the curve come to the driver.
    """
    how = how or Fit()
    labelled = durable(labelled, "toxicity-labelled")
    sizes = {r["label"]: r["count"] for r in labelled.groupBy((F.col("label") == 1).cast("int").alias("label")).count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if bad + good > how.labelled_rows:
        raise ValueError(f"{bad + good} labelled rows; labelled_rows allows {how.labelled_rows}")
    if not bad or not good:
        return Grammar(dict(INSULTS), {})
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1.0)) - F.log((F.col("clean") + 0.5) / (good + 1.0))
    counted = count_entries(labelled).filter(F.col("toxic") >= how.least_texts).withColumn("odds", odds).filter(F.col("odds") >= how.least_odds)
    found = counted.orderBy(F.col("toxic").desc(), "entry").limit(how.most_entries).collect()
    words = dict(INSULTS)
    stems: dict[str, float] = {}
    for r in found:
        (stems if r["entry"].startswith(STEM) else words)[r["entry"].lstrip(STEM)] = round(min(r["odds"], 8.0), 3)
    # A longer beginning adds nothing to a shorter one that is as sure.
    for stem in sorted(stems, key=len):
        if any(stems.get(stem[:n], 0) >= stems[stem] for n in range(STEMS.start, len(stem))):
            del stems[stem]
    grammar = Grammar(words, stems)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.sum(grammar.clauses(t)[1] or [[0.0] * len(AMOUNTS)], axis=0) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([float(v == 1) for v in batch.column(1).to_pylist()]), *(pa.array([r[k] for r in rows], pa.float64()) for k in range(len(AMOUNTS)))], names=["y", *AMOUNTS])

    got = labelled.mapInArrow(frugal(total), ", ".join(f"{c} double" for c in ("y", *AMOUNTS))).toPandas()
    weights = fitted_weights(got[list(AMOUNTS)].to_numpy(), got["y"].to_numpy(), grammar.weights)
    grammar = Grammar(words, stems, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [grammar.features(*grammar.clause_weights(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([v == 1 for v in batch.column(1).to_pylist()]), *(pa.array([r[k] for r in x], pa.float64()) for k in (1, 2, 3))], names=["y", "a", "b", "c"])

    got = labelled.mapInArrow(frugal(run), "y boolean, a double, b double, c double").toPandas()
    x = np.column_stack([np.ones(len(got)), got[["a", "b", "c"]].to_numpy()])
    curve = logistic(x, got["y"].to_numpy(float), 0.1)
    return Grammar(words, stems, weights, tuple(float(v) for v in curve))


def sampled(docs: DataFrame, labels: DataFrame, how: Fit, label: str = "toxic", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``text, label`` of at most ``how.labelled_rows`` labelled documents, those of smallest hash of the key.

    A key labelled twice is toxic if any of its labels is; of rows that share a key, the one of smallest text stands
    for it.  The sample's keys and labels are bounded, so they are broadcast to the documents.
    """
    one = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("label")).dropna().groupBy("k").agg(F.max("label").alias("label"))
    some = one.orderBy(F.xxhash64("k"), "k").limit(how.labelled_rows)
    found = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(some), "k")
    return found.groupBy("k").agg(F.min("text").alias(text), F.first("label").alias("label")).select(text, "label")


def score(docs: DataFrame, grammar: Grammar, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, score, predicted, clauses, matched`` for every row, from its whole text alone.

    Null and empty texts have the lowest score; rows with null keys are never held out; repeated rows repeat.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            held = [k is not None and zlib.crc32(str(k).encode()) % 4 == 2 for k in keys.to_pylist()]
            scores, clauses, matched = [], [], []
            for value in texts.to_pylist():
                n, weights = grammar.clause_weights(value)
                scores.append(grammar.curved(n, weights))
                clauses.append(n)
                matched.append(len(weights))
            said = [int(s >= threshold) for s in scores]
            yield pa.RecordBatch.from_arrays([keys, pa.array(held), pa.array(scores, pa.float64()), pa.array(said, pa.int32()), pa.array(clauses, pa.int64()), pa.array(matched, pa.int64())], names=[key, "held_out", "score", "predicted", "clauses", "matched"])

    return docs.select(key, text).mapInArrow(frugal(run), f"`{key}` {kind}, held_out boolean, score double, predicted int, clauses long, matched long")


def keep_clean(docs: DataFrame, grammar: Grammar, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with all their columns."""
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [grammar.score(t) < threshold for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(batch.columns, names=names).filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(frugal(run), schema)


def learn(docs: DataFrame, labels: DataFrame, how: Fit | None = None, key: str = "doc_id") -> Grammar:
    """Fit on the labelled documents that are not held out: those with crc32 of the key as text mod 4 other than 2."""
    how = how or Fit()
    usable = labels.filter(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) != 2)
    return fit(sampled(docs, usable, how, key=key), how)
