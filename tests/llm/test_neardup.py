import random
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from dyadica.llm import neardup as N
from dyadica.llm.graph import components
from dyadica.llm.queries import op1_order_minhash
from dyadica.llm.wordhash import word_hashes


def runs_of(text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    size = min(5, len(words))
    seen, out = Counter(), []
    for k in range(len(words) - size + 1 if words else 0):
        run = tuple(words[k : k + size])
        out.append((run, seen[run]))
        seen[run] += 1
    return out


def alike(a, b):
    place, tails = {x: k for k, x in enumerate(b)}, []
    for x in a:
        if x in place:
            k = bisect_left(tails, place[x])
            tails[k : k + 1] = [place[x]]
    return len(tails) / (len(a) + len(b) - len(tails)) if a or b else 1.0


def brute(rows):
    """Class of every row (id, text): equal texts, and all pairs with a common run that align."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    runs = [runs_of(t or "") for _, t in rows]
    first, at = {}, defaultdict(list)
    for k, (_, t) in enumerate(rows):
        root[find(k)] = find(first.setdefault(t or "", k))
        for x in runs[k]:
            at[x].append(k)
    for i, j in {(i, j) for m in at.values() for j in m for i in m if i < j}:
        if find(i) != find(j) and alike(runs[i], runs[j]) >= N.THRESHOLD:
            root[find(i)] = find(j)
    names = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        names[find(k)].append(i)
    return [min((i for i in names[find(k)] if i is not None), default=None) for k in range(len(rows))]


def test_word_hashes_follow_the_words():
    texts = ["a b  c", "", None, "c\tb\na", " abc ", "ab c", "é é"]
    h, starts = word_hashes(pa.array(texts))
    assert starts.tolist() == [0, 3, 3, 3, 6, 7, 9, 11]
    assert h[0] == h[5] and h[1] == h[4] and h[2] == h[3] == h[8] and h[9] == h[10]
    assert len({int(x) for x in h}) == 6
    sliced = word_hashes(pa.array(texts).slice(3, 3))
    assert (sliced[0] == h[3:9]).all()


def test_alignment_agrees_with_the_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.choice("abcdef") for _ in range(rng.randint(1, 60))]
        b = [x for x in a if rng.random() > 0.03]
        if rng.random() < 0.3 and len(b) > 4:
            k = rng.randrange(len(b) - 3)
            b[k], b[k + 2] = b[k + 2], b[k]
        texts = [" ".join(a), " ".join(b)]
        x, y = N._runs(pa.array(texts))
        want = alike(*map(runs_of, texts))
        got = N.aligned(len(x), len(y), *N.overlap(x, y))
        assert got == pytest.approx(want) if want >= N.THRESHOLD else got < N.THRESHOLD


def test_order_matters():
    words = [f"w{k}" for k in range(200)]
    a, b = " ".join(words), " ".join(words[100:] + words[:100])
    x, y = N._runs(pa.array([a, b]))
    assert N.aligned(len(x), len(y), *N.overlap(x, y)) < N.THRESHOLD
    assert len(np.intersect1d(x, y)) > 0.9 * len(x)


def test_components_of_random_links(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 360)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_agrees_with_brute_force(spark, sf, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.class_id for r in op1_order_minhash(spark, sf).collect()}
    assert got == dict(zip([i for i, _ in rows], brute(rows), strict=True))


def test_groups_chains_and_crowded_buckets(spark, monkeypatch):
    # Many unlike texts are forced into the same buckets: no link may be lost there.
    monkeypatch.setattr(N, "order_minhash", lambda runs: np.full(N.BANDS, 7, dtype=np.uint64))
    rng = random.Random(4)
    rows = []
    for g in range(6):
        base = [f"g{g}w{k}" for k in range(120)]
        for c in range(4):  # each copy moves a little further from the first
            base = base[:]
            base[rng.randrange(120)] = f"x{g}.{c}"
            rows.append((10 * g + c, " ".join(base)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.class_id for r in N.classes(df).collect()}
    assert got == dict(zip([i for i, _ in rows], brute(rows), strict=True))


def test_edge_rows(edge, nothing):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    want = Counter(zip([i for i, _ in rows], brute(rows), strict=True))
    assert Counter((r.doc_id, r.class_id) for r in N.classes(edge).collect()) == want
    kept = N.keep_one(edge)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c in want_classes(rows)})
    assert N.classes(nothing).count() == 0 and N.keep_one(nothing).count() == 0


def want_classes(rows):
    return brute(rows)


def test_a_text_that_repeats_a_run_meets_its_copy_that_does_not(spark, tables):
    words = [f"w{k}" for k in range(120)]
    plain, again = " ".join(words), " ".join(words + words[:7])
    a, b = N._runs(pa.array([plain, again]))
    assert (a == b[: len(a)]).all() and len({*b.tolist()}) == len(b)
    assert N.aligned(len(a), len(b), *N.overlap(a, b)) == pytest.approx(alike(runs_of(plain), runs_of(again)))
    assert {*N.order_minhash(a).tolist()} & {*N.order_minhash(b).tolist()}
    rows = [(1, plain), (2, again), (3, "another text that has nothing in common with the two")]
    folder = tables(documents=spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(tuple(r) for r in op1_order_minhash(spark, folder).collect())
    assert [r[:2] for r in got] == [(1, 1), (2, 1), (3, 3)]
