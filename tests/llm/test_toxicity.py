import math
import random
import time

import pytest

from dyadica.llm import toxicity
from dyadica.llm.common import fold_of
from dyadica.llm.queries import op4_toxicity
from dyadica.llm.toxicity import (
    FEATURES, TERMS, WINDOW, Model, TermAutomaton, WordTable, edits_allowed, fit, read_text, score_documents,
)
from dyadica.session import BROADCAST_BYTES_KEY, written


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_agrees_with_edit_distance():
    rng = random.Random(4)
    automaton = TermAutomaton(list(TERMS))
    for _ in range(1500):
        word = list(rng.choice(TERMS))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(word) + 1)
            word[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "e", "st"])
        word = "".join(word)
        within = [(distance(word, t), t) for t in TERMS if distance(word, t) <= edits_allowed(len(t))]
        best = min(within, default=None)
        assert automaton.look_up(word) == ((best[1], best[0]) if best else None)


def test_context_separates_quotation_from_abuse():
    table, at = WordTable(TermAutomaton(list(TERMS))), FEATURES.index("log_abuse")
    abuse = read_text("you are such an idiot and a worthless clown", table)[0][at]
    quoted = read_text('the report said that the word "idiot" was used', table)
    assert quoted[2] == 1 and quoted[0][at] < abuse / 3
    assert read_text("what an 1d1ot and a moronn", table)[3] == 2
    # Words that happen to be one letter from a term are no abuse by themselves.
    assert Model().score(read_text("the idiom of a trashy novel", table)[0]) < 0.5
    assert Model().score(read_text("you are such an idiot and a worthless clown", table)[0]) > 0.5


def test_held_out_labels(spark, sf):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = op4_toxicity(spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted for r in rows if r.toxic == 0) == 0
    # Some labels carry no term at all; of those with two or more, all are found.
    assert all(r.predicted for r in rows if r.toxic == 1 and r.n_hits >= 2)
    assert sum(r.predicted for r in rows) >= 3


def test_labels_of_the_held_out_fold_change_nothing(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.selectExpr("doc_id", "quality", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) as toxic")
    a = fit(docs, labels, fold_of("doc_id", 5) != 0)
    b = fit(docs, turned, fold_of("doc_id", 5) != 0)
    assert a.terms == b.terms and a.weights == pytest.approx(b.weights)


def test_edge_rows(spark, edge, nothing):
    scored = score_documents(edge, Model(), ["doc_id"]).collect()
    assert len(scored) == edge.count() and all(0 <= r.score <= 1 for r in scored)
    assert len({r.score for r in scored}) == 1
    assert score_documents(nothing, Model(), ["doc_id"]).count() == 0
    none = spark.createDataFrame([(1, None), (None, 1), (None, None)], "doc_id long, toxic int")
    assert fit(edge, none) == Model() and fit(nothing, none) == Model()


def test_many_hits_in_one_text():
    table = WordTable(TermAutomaton(list(TERMS)))
    start = time.monotonic()
    x, hits, quoted, _ = read_text('you idiot and "moron" ' * 50_000, table)
    assert hits == 100_000 and quoted == 50_000 and time.monotonic() - start < 30
    # Windows of the ends hold fewer hits; all others are alike, so the total grows with the text.
    few = read_text('you idiot and "moron" ' * 5_000, table)[0]
    at = FEATURES.index("log_abuse")
    assert math.expm1(x[at]) / math.expm1(few[at]) == pytest.approx(10, rel=1e-3)


def test_near_hits_by_brute_force():
    table = WordTable(TermAutomaton(list(TERMS)))
    rng = random.Random(10)
    for _ in range(200):
        words = [rng.choice(["idiot", "moron", "word2", "house", "tree"]) for _ in range(40)]
        at = [k for k, w in enumerate(words) if w in ("idiot", "moron")]
        if at:
            scores = [1 + 0.5 * (sum(abs(j - k) <= WINDOW for j in at) - 1) for k in at]
            assert read_text(" ".join(words), table)[0][FEATURES.index("strongest")] == max(scores)


def test_states_are_made_anew_when_there_are_many(monkeypatch):
    monkeypatch.setattr("dyadica.llm.toxicity.STATES_KEPT", 20)
    small, whole = TermAutomaton(list(TERMS)), TermAutomaton(list(TERMS))
    for t in TERMS:
        for k in range(len(t)):
            word = t[:k] + "x" + t[k + 1 :]
            assert small.look_up(word) == TermAutomaton.look_up(whole, word)


def test_model_comes_from_every_labelled_document(spark, conf, monkeypatch):
    """Also where the labels are too many for a broadcast; a document labelled twice counts twice."""
    rows = [(k, f"text {k} about houses and trees" + " you blargish idiot" * (k % 4 == 0)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = [(k, int(k % 4 == 0)) for k in range(200)] + [(7, 0), (None, 1), (8, None), (999, 1)]
    labels = spark.createDataFrame(known, "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE_LABELS", 30, raising=False)
    seen, plain = [], toxicity.learned_terms
    monkeypatch.setattr(toxicity, "learned_terms", lambda rows: seen.append(rows.count()) or plain(rows))
    a = fit(docs, labels)
    conf(BROADCAST_BYTES_KEY, 10)
    mark = written(spark)
    b = fit(docs, labels)
    assert seen == [201, 201] and written(spark) == mark
    assert "blargish" in a.terms and a.terms == b.terms
    assert b.weights == pytest.approx(a.weights, abs=1e-9) and b.intercept == pytest.approx(a.intercept, abs=1e-9)
