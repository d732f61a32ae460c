import random
import zlib

import numpy as np
import pytest

from millrace.llm import toxicity as tox
from millrace.llm.toxicity import Fit, Grammar, count_entries, fit, fitted_weights, keep_clean, learn, sampled, score
from millrace.llm.queries import op1_toxicity

GRAMMAR = Grammar({"idiot": 3.0}, {"zurg": 2.0})


def test_clauses_are_weighed_by_what_stands_around():
    weigh = lambda t: GRAMMAR.clause_weights(t)[1]
    plain, aimed, negated, reported = (weigh(t)[0] for t in ("an idiot", "you idiot", "you are not an idiot", "they said you are an idiot"))
    assert aimed > plain > negated and aimed > reported
    assert weigh("you. an idiot") == [plain]  # the target is in another clause
    assert weigh("zurgelig zurgte") == [4.0] and weigh("azurg") == []
    assert weigh("kill you") == [GRAMMAR.threat] and weigh("kill time") == []
    assert GRAMMAR.clause_weights("...!") == (0, []) and GRAMMAR.clause_weights(None) == (0, [])
    assert 0 < GRAMMAR.score("fine") < GRAMMAR.score("you idiot") < 1


def by_definition(symbols):
    """Amounts of one clause by looking around each word, rather than from left to right."""
    out = [0.0] * 5
    words = list(symbols)
    negated = [any(words[j] == tox.NEGATION and not any(words[m] in (tox.REPORT, tox.NEGATION) for m in range(j + 1, i)) for j in range(max(0, i - tox.SCOPE), i)) for i in range(len(words))]
    soft = [negated[i] or tox.REPORT in words[:i] for i in range(len(words))]
    pending, aimed_behind = None, None
    for i, w in enumerate(words):
        if w >= tox.INSULT:
            if soft[i]:
                out[2] += (w - tox.INSULT) / 8
                continue
            out[0] += (w - tox.INSULT) / 8
            if tox.TARGET in words[max(0, i - tox.BEFORE) : i]:
                out[1] += 1
                aimed_behind = None
            else:
                aimed_behind = i
        elif w == tox.THREAT:
            pending = i, soft[i]
        elif w == tox.TARGET:
            if pending and i - pending[0] <= tox.REACH:
                out[4 if pending[1] else 3] += 1
                pending = None
            if aimed_behind is not None and i - aimed_behind <= tox.BEHIND:
                out[1] += 1
            aimed_behind = None
    return out


def test_the_composed_automaton_against_its_transducers_and_the_definition():
    """Random clauses: all transducers one after another, and each word by what stands around it."""
    draw = random.Random(1)
    kinds = [tox.OTHER, tox.TARGET, tox.NEGATION, tox.REPORT, tox.THREAT]
    for n in range(6000):
        clause = [draw.choice(kinds + [tox.INSULT + draw.randrange(1, 40)]) for _ in range(n % 13)]
        stream = [tox.ONE_INSULT if s >= tox.INSULT else s for s in clause]
        for t in tox.CASCADE:
            stream = t.write(stream)
        slow = [0.0] * 5
        for s, amounts in zip(clause, stream, strict=True):
            for at in amounts:
                slow[at] += (s - tox.INSULT) / 8 if at in (0, 2) else 1.0
        fast = Grammar.amounts(bytes(clause))
        assert (fast[0] if fast else [0.0] * 5) == slow == by_definition(clause), clause
    # Reported speech goes on behind a comma, everything else ends there; a full stop ends all.
    insult = tox.INSULT + 8
    assert Grammar.amounts(bytes([tox.REPORT, tox.COMMA, insult])) == [[0, 0, 1.0, 0, 0]]
    assert Grammar.amounts(bytes([tox.NEGATION, tox.TARGET, tox.COMMA, insult])) == [[1.0, 0, 0, 0, 0]]
    assert Grammar.amounts(bytes([tox.REPORT, tox.STOP, insult])) == [[1.0, 0, 0, 0, 0]]


def test_scope_and_order():
    weigh = lambda t: GRAMMAR.clauses(t)[1]
    assert weigh("you are not an idiot") == weigh("they said you are an idiot") == [[0, 0, 3.0, 0, 0]]
    assert weigh("idiot you are not") == weigh("you idiot") == [[3.0, 1.0, 0, 0, 0]]
    assert weigh("not that it matters here, an idiot") == [[3.0, 0, 0, 0, 0]]
    assert weigh("I will kill all of you") == [[0, 0, 0, 1.0, 0]] and weigh("do not kill him") == [[0, 0, 0, 0, 1.0]]
    assert weigh("you may kill time") == [] == weigh("not said you")


def test_long_texts_are_read_in_parts():
    long = "ab, cd idiot. " * 200_000
    assert GRAMMAR.clauses(long)[0] == 400_000 and len(GRAMMAR.clauses(long)[1]) == 200_000
    assert len(GRAMMAR.symbols("x" * 3_000_000)) == 1


def test_weights_are_fitted():
    rng = np.random.default_rng(0)
    totals = np.zeros((2000, 5))
    totals[:500, 0] = totals[500:1000, 2] = 3.0
    y = np.repeat([1.0, 0.0], [500, 1500]) * (rng.random(2000) < 0.95)
    weights = fitted_weights(totals, y, Grammar({}, {}).weights)
    assert weights[0] > 0.8 and weights[2] < 0.1 and weights[3] == 2.0


def test_the_labelled_bound_holds(spark, documents):
    docs = documents([(1, f"row {i}") for i in range(3000)] + [(2, "x"), (3, None)])
    labels = spark.createDataFrame([(i, 1) for i in range(5)], "doc_id long, toxic int")
    assert sampled(docs, labels, Fit(labelled_rows=20_000)).count() == 3
    assert sampled(docs, labels, Fit(labelled_rows=2)).count() <= 2
    with pytest.raises(ValueError, match="labelled_rows"):
        fit(docs.selectExpr("text", "1 as label"), Fit(labelled_rows=100))


def labelled(n):
    bad = ["blork", "snatch", "zurg"]
    return [(i, f"the {i} road went on, {bad[i % 3] + chr(97 + i % 7) if i % 4 == 0 else 'quiet'} and wide. more of it", int(i % 4 == 0)) for i in range(n)]


def test_learns_words_and_beginnings_without_held_out_labels(spark, documents):
    rows = labelled(800)
    docs = documents([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in score(docs, learn(docs, labels)).collect()}
    for i, _, y in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i]["predicted"] == y == int(got[i]["score"] >= 0.3)


def test_counts_against_brute_force(spark):
    rows = [("a bee, a bumble", 1), ("bumble!", 0), (None, 1)]
    got = {r["entry"]: (r["toxic"], r["clean"]) for r in count_entries(spark.createDataFrame(rows, "text string, label int")).collect()}
    assert got["bumble"] == (1, 1) and got["bee"] == (1, 0) and got["\x1fbumb"] == (1, 1)


def test_odd_rows(spark, documents, odd_rows):
    docs = documents(odd_rows)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = score(docs, learn(docs, none)).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    assert not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert score(docs.limit(0), Grammar({}, {})).count() == 0
    odd = spark.createDataFrame([(None, 1), (1, None), (6, 1), (6, 0), (7, 0)], "doc_id long, toxic int")
    assert score(docs, learn(docs, odd)).count() == len(odd_rows)
    assert fit(spark.createDataFrame([], "text string, label int"), Fit()).stems == {}
    assert keep_clean(docs, GRAMMAR).columns == docs.columns and keep_clean(docs, GRAMMAR).count() == len(odd_rows)


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = op1_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert ((got["predicted"] == got["toxic"]).mean()) > 0.95
