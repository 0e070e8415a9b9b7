import hashlib

import pytest
from pyspark.sql import functions as F

from dyadica.llm.queries import op3_sketch
from dyadica.llm.sketch import LEAST, key_cuts, part_of
from dyadica.llm.sketch import FRACTION, HASH_DIGITS, containment, edited_sketches, merged, with_sketch


def plain(text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    runs = [" ".join(words[i : i + 5]) for i in range(len(words) - 4)] or ([" ".join(words)] if words else [])
    hashes = {hashlib.md5(r.encode()).hexdigest()[:HASH_DIGITS] for r in runs}
    limit = format(16**HASH_DIGITS // FRACTION, f"0{HASH_DIGITS}x")
    return sorted(h for h in hashes if h < limit or h == min(hashes))


def alike(a, b):
    return len({*a} & {*b}) / len({*a} | {*b}) if a or b else 1.0


def brute(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = []
    for k, (i, t) in enumerate(rows):
        follow = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 3
        e = t[: len(t) - cut] + follow[:cut]
        a, b, c = plain(t), plain(e), plain(follow)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), "".join(a), "".join(b), alike(a, b), alike(a, c)))
    return sorted(out)


def result(df):
    return sorted(tuple(r)[:7] for r in df.collect())


def test_edge_texts(spark):
    texts = ["", " \n ", "one", "a b c d", "a b c d e", "a\tb\x0bc d e f", "ü " * 900, "p q " * 20_000, "z y x w v u t s r q p o " * 4]
    rows = [(k * 3, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(edited_sketches(df)) == brute(rows)


def test_blocks_join_up(spark, docs, monkeypatch):
    monkeypatch.setattr("dyadica.llm.sketch.BLOCK_ROWS", 7)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(edited_sketches(docs.repartition(5))) == brute(rows)


def test_nulls_repeats_and_emptiness(edge, nothing):
    got = edited_sketches(edge).collect()
    assert len(got) == edge.count()
    assert {r.fingerprint for r in got if r.doc_id in (0, 1, 2)} == {""}
    assert len({r.fingerprint for r in got if r.doc_id in (5, 6)}) == 1
    assert edited_sketches(nothing).count() == 0


def test_one_document_follows_itself(spark):
    r = edited_sketches(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_merge_and_containment(spark):
    words = [f"w{k}" for k in range(900)]
    short, long = " ".join(words[:120]), " ".join(words)
    df = spark.createDataFrame([(short, long)], "a string, b string")
    df = with_sketch(with_sketch(df, "a", "sa"), "b", "sb")
    r = df.select(containment(df["sa"], df["sb"]).alias("c"), merged(df["sa"], df["sb"]).alias("m"), "sb").first()
    assert r.c >= 0.9 and r.m == r.sb


def test_query_agrees_with_brute_force(spark, sf, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(op3_sketch(spark, sf)) == brute(rows)


@pytest.mark.parametrize("hot", [5, None])
def test_documents_of_one_key_are_dealt_over_blocks(spark, monkeypatch, hot):
    monkeypatch.setattr("dyadica.llm.sketch.BLOCK_ROWS", 10)
    rows = [(k, f"text of {k} with some more words in it {k % 7}") for k in range(100)]
    rows += [(hot, f"one of many {k} texts of a key and words {k % 3}") for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    cuts, many = key_cuts(df.select("doc_id"), "doc_id")
    rank = LEAST if hot is None else hot
    assert many[rank] >= 10
    tied = df.filter(F.col("doc_id").eqNullSafe(F.lit(hot))).select(F.lit(rank).alias("r"), F.xxhash64("text").alias("t"))
    sizes = [r["count"] for r in tied.groupBy(part_of(F.col("r"), F.col("t"), many)).count().collect()]
    assert len(sizes) >= 10 and max(sizes) < 40
    # Within a key documents follow each other by the hash of their text.
    tie = {r.text: r.t for r in df.select("text", F.xxhash64("text").alias("t")).collect()}
    placed = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -tie[r[1]]))
    want = sorted((-1 if i is None else i, *x[1:]) for (i, _), x in zip(placed, ordered(placed)))
    assert sorted((-1 if r[0] is None else r[0], *tuple(r)[1:7]) for r in edited_sketches(df).collect()) == want


def ordered(rows):
    """The brute force on rows that are in order, null keys among them."""
    numbered = [(len(rows) - k, t) for k, (_, t) in enumerate(rows)]
    return sorted(brute(numbered), key=lambda r: -r[0])
