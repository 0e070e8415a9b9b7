import math
from collections import defaultdict

import pytest

from dyadica.llm.mixing import mix
from dyadica.llm.queries import op8_entropy_mix


def targets(sizes):
    names = sorted((n for n in sizes if n is not None)) + [n for n in sizes if n is None]
    weight = {n: (3, 1, 2)[k % 3] for k, n in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [n for n in names if n not in capped]
        level = (total - sum(2 * sizes[n] for n in capped)) / sum(weight[n] for n in rest) if rest else 0
        over = {n for n in rest if level * weight[n] > 2 * sizes[n]}
        if not over:
            return {n: 2 * sizes[n] if n in capped else level * weight[n] for n in names}
        capped |= over


def check(rows, source_of):
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        s = source_of(r)
        sizes[s] += r["size"]
        taken[s] += r.taken
        largest[s] = max(largest[s], r["size"])
        assert r.copies in (0, 1, 2) and r.taken == r.copies * r["size"]
    want = targets(sizes)
    for r in rows:
        s = source_of(r)
        assert r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s], rel=1e-9)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1


def test_query_meets_targets_and_reruns_agree(spark, sf, docs):
    source = {r.doc_id: r.source for r in docs.collect()}
    rows = op8_entropy_mix(spark, sf).collect()
    check(rows, lambda r: source[r.doc_id])
    again = op8_entropy_mix(spark, sf).repartition(7).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_edge_rows(edge, nothing):
    rows = mix(edge, ["doc_id", "source"]).collect()
    assert len(rows) == edge.count()
    check(rows, lambda r: r.source)
    assert all(r.copies == 1 for r in rows if r["size"] == 0)
    assert mix(nothing, ["doc_id"]).count() == 0


def test_hot_source_and_equal_sizes(spark):
    df = spark.range(3000).selectExpr(
        "id as doc_id", "if(id % 3 = 0, 'a', concat('s', id % 7)) as source", "repeat('w ', if(id % 2 = 0, 5, cast(id % 90 as int))) as text")
    rows = mix(df, ["doc_id", "source"]).collect()
    check(rows, lambda r: r.source)


def test_lone_source_is_tilted(spark):
    df = spark.range(200).selectExpr("id as doc_id", "'only' as source", "repeat('w ', 1 + cast(id as int)) as text")
    rows = mix(df, ["doc_id", "source"]).collect()
    check(rows, lambda r: r.source)
    by_size = sorted((r["size"], r.mean_copies) for r in rows)
    assert all(1 < m < 2 for _, m in by_size) and by_size == sorted(by_size, key=lambda x: x[1])


def test_tilts_by_bisection(spark, sf, docs):
    source = {r.doc_id: r.source for r in docs.collect()}
    rows = op8_entropy_mix(spark, sf).collect()
    by_source = defaultdict(list)
    for r in rows:
        by_source[source[r.doc_id]].append(r)
    open_sources = 0
    for mine in by_source.values():
        unit = sum(r["size"] for r in mine) / len(mine)
        z = [r["size"] / unit for r in mine]
        want = mine[0].target / unit
        if mine[0].target >= 2 * mine[0].source_size * (1 - 1e-12):
            assert all(r.copies == 2 for r in mine if r["size"])
            continue
        low, high = -5000.0, 5000.0
        mean = lambda t, x: 2 / (1 + math.exp(max(-700.0, min(700.0, -t * x))))
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if sum(x * mean(middle, x) for x in z) < want else (low, middle)
        for r, x in zip(mine, z):
            assert r.mean_copies == pytest.approx(mean(low, x), abs=3e-6)
            # Rounding by running sums: no document is further than one copy from its mean.
            assert r.copies in (math.floor(r.mean_copies), math.ceil(r.mean_copies))
        open_sources += 1
    assert open_sources
