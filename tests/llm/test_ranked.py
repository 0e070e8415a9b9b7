import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from dyadica.llm import ranked as R
from dyadica.llm.queries import op12_ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    """(item, rank, doc, score) of all items, every document scored."""
    held = [(i, terms_of(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n_docs, words = len(held), sum(len(t) for _, t in held)
    counts = [(i, len(t), Counter(t)) for i, t in held]
    df = Counter(t for _, _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for i, n, c in counts:
            m = 100 - 90 + (90 * n * n_docs) // words
            score = 0
            for t in set(terms_of(text)):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(found)[:k])]
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3], r[2] or -1))


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], r[2] or -1)
    assert rows_of(got) == sorted(want, key=key)


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in docs], "doc_id long, text string, terms string, n int, item string")
    q = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, id string, rank int")
    return d, q


WORDS = [f"w{k}" for k in range(30)] + ["é", "中文", "Ab", "aB", "x1"]


def made(rng, n):
    sizes = [rng.choice([0, 1, 3, 10, 60]) for _ in range(n)]
    return [" ".join(rng.choices(WORDS, weights=[1 / (k + 1) for k in range(len(WORDS))], k=s)) for s in sizes]


@pytest.mark.parametrize("documents, counts, terms", [(50_000, 500_000, 200_000), (3, 40, 25), (1, 1, 1)])
def test_random_tables_by_brute_force(spark, monkeypatch, documents, counts, terms):
    monkeypatch.setattr(R, "SHARD_DOCUMENTS", documents)
    monkeypatch.setattr(R, "SHARD_COUNTS", counts)
    monkeypatch.setattr(R, "MOST_TERMS", terms)
    rng = random.Random(documents)
    docs = list(enumerate(made(rng, 150)))
    docs += [(i + 1000, t) for i, t in docs[:40]] + [docs[3], docs[3], (None, docs[5][1]), (None, docs[5][1]), (7777, None)]
    items = [(k, t) for k, t in enumerate(made(rng, 8))] + [(2, "w0 w1"), (None, "w3"), (90, None), (91, "!!"), (92, "unknown")]
    d, q = frames(spark, docs, items)
    same(R.search(d.repartition(3), q), brute(docs, items))


def test_edge_rows(spark, edge, nothing):
    items = [(1, "the fox"), (2, "a b x"), (3, None), (None, "dog")]
    _, q = frames(spark, [], items)
    same(R.search(edge, q), brute([(r.doc_id, r.text) for r in edge.collect()], items))
    assert R.search(nothing, q).count() == 0 and R.search(edge, q.limit(0)).count() == 0
    assert R.search(edge, q).columns == ["item_id", "rank", "doc_id", "score"]


def test_query_agrees_with_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    same(op12_ranked(spark, sf), brute(docs, items))


def shard_of(rng, n_docs, n_terms, weights):
    doc, term, tf = [], [], []
    for d in range(n_docs):
        for t in sorted(rng.choice(n_terms, size=rng.integers(1, n_terms + 1), replace=False).tolist()):
            doc.append(d)
            term.append(t)
            tf.append(int(rng.integers(1, 4)))
    sizes = rng.integers(1, 50, size=n_docs)
    args = (np.arange(n_docs), np.zeros(n_docs, bool), sizes, np.array(doc), np.array(term), np.array(tf), weights, n_docs, int(sizes.sum()))
    return R.Shard(*args)


def test_best_positions_and_their_bound():
    rng = np.random.default_rng(3)
    for _ in range(40):
        shard = shard_of(rng, 60, 6, rng.integers(1, 5000, size=6))
        totals = np.bincount(shard.doc, shard.impact, minlength=60).astype(np.int64)
        best = R.Best(4)
        shard.search(np.arange(6), best)
        order = sorted(range(60), key=lambda d: (-totals[d], d))[:4]
        assert list(zip(best.scores.tolist(), best.ids.tolist())) == [(totals[d], d) for d in order]
        # An unseen document cannot exceed the bound at any best positions.
        first, sizes = shard.starts[:-1], np.diff(shard.starts)
        position = np.array([rng.integers(1, s + 1) for s in sizes])
        bound = shard.bound(first, sizes, position)
        seen = {d for a, p in zip(first, position) for d in shard.doc[a : a + p]}
        assert all(totals[d] <= bound for d in range(60) if d not in seen)


def test_reading_stops_before_the_end_and_ties_are_kept():
    # Impacts fall steeply and alike in both lists, so few documents need to be scored.
    n = 2000
    doc, term = np.repeat(np.arange(n), 2), np.tile([0, 1], n)
    sizes = np.arange(1, n + 1) * 50
    shard = R.Shard(np.arange(n), np.zeros(n, bool), sizes, doc, term, np.ones(2 * n, dtype=np.int64), np.array([1000, 900]), n, int(sizes.sum()))
    best = R.Best(5)
    assert shard.search(np.array([0, 1]), best) < n / 10 and best.ids.tolist() == [0, 1, 2, 3, 4]
    again = R.Best(5)
    again.take(best.scores * 2, best.ids, best.absent)
    assert shard.search(np.array([0, 1]), again) == 0
    # With equal impacts everywhere, the bound is never below the k-th score: all must be read.
    flat = R.Shard(np.arange(n)[::-1].copy(), np.zeros(n, bool), np.full(n, 7), doc, term, np.ones(2 * n, dtype=np.int64), np.array([10, 10]), n, 7 * n)
    best = R.Best(5)
    assert flat.search(np.array([0, 1]), best) == n and best.ids.tolist() == [0, 1, 2, 3, 4]


def test_terms_of_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(R, "PIECE_BYTES", 5)
    rng = random.Random(4)
    for _ in range(300):
        t = "".join(rng.choice("abZ09 .\x00\x7f_é中\n-`{") for _ in range(rng.randint(0, 60)))
        assert [x.decode() for p in R.term_pieces(t) for x in p] == terms_of(t)
