"""Near-duplicates by Order MinHash and banded alignment.

Texts are runs of five words, labelled by how often a run occurred before in its text. For each of
BANDS hash functions a text's PICKED smallest labelled runs are kept in the order of the text; texts
that share such a tuple share a bucket. The chance of sharing one grows with how much of the two
texts agrees in the same order, so it follows edit likeness rather than set likeness.

Two texts are linked when their alignment shows a likeness of THRESHOLD or more: aligned runs over
all runs of both. Labelled runs are unique within a text, so the alignment is a longest increasing
subsequence of matching places, kept to the band that the threshold leaves.

Every bucket is settled without comparing all its pairs. All its texts are compared with one
pivot, the text that meets most others in all its buckets, which is the common source where there
is one. Groups are the connected components of the links. Where a bucket still holds texts outside
the pivot's group, two of its texts in different groups can only be linked if what both have of the
pivot, and the runs they share beyond it, suffice for the threshold. What each text has of the pivot
and has beyond it is known from the first comparison, so the pairs that can still be linked come
from counts of shared runs, made block by block; they alone are aligned. The counts lose no link, and
no number of partners or candidates is bounded.

Rows: equal texts are one class whatever their length; null counts as empty, and all empty texts
are one class. A text of fewer than five words is one run. A class is named by its smallest id;
null ids are passed over (a class of null ids alone has a null name). Repeated rows fall together.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from dyadica.llm.common import map_arrow, packed, slices, unpacked
from dyadica.llm.graph import components
from dyadica.llm.wordhash import labelled, mix, shingles_of, word_hashes
from dyadica.session import materialize

THRESHOLD = 0.8
BANDS, PICKED = 16, 3
# Of all runs of two texts, this share must be common to reach THRESHOLD.
LEAST_COMMON = THRESHOLD / (1 + THRESHOLD)
# Texts wanted for comparison are broadcast by their hash up to so many rows (16 bytes each).
MOST_BROADCAST = 1_000_000
# Texts, and runs beyond the pivot, of a block within which texts are counted against each other.
BLOCK_TEXTS, BLOCK_RUNS = 2048, 400_000
# Hash matrices are made for all bands at once up to so many runs.
AT_ONCE = 50_000

_U = np.uint64
_SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))


def order_minhash(runs: np.ndarray) -> np.ndarray:
    """One 64-bit key a band from a text's labelled runs."""
    n = len(runs)
    out = np.empty(BANDS, dtype=np.uint64)
    step = BANDS if n <= AT_ONCE else 1
    for start in range(0, BANDS, step):
        seeds = _SEEDS[start : start + step]
        keys = mix(runs[None, :] ^ seeds[:, None])
        if n > PICKED:
            at = np.argpartition(keys, PICKED - 1, axis=1)[:, :PICKED]
            at.sort(axis=1)
        else:
            at = np.broadcast_to(np.arange(n), (len(seeds), n))
        key = seeds.copy()
        for k in range(at.shape[1]):
            key = mix(key * _U(0x9E3779B97F4A7C15) + runs[at[:, k]])
        out[start : start + step] = key
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` of the runs that ``b`` has too, and their places in ``b``, in the order of
    ``a``."""
    if not len(a) or not len(b):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    order = np.argsort(b)
    at = order[np.minimum(np.searchsorted(b[order], a), len(b) - 1)]
    i = np.flatnonzero(b[at] == a)
    return i, at[i]


def aligned(n: int, m: int, i: np.ndarray, j: np.ndarray) -> float:
    """Likeness of two texts of ``n`` and ``m`` runs that share runs at the places ``i`` and ``j``:
    aligned runs over all runs. Pairs that cannot reach THRESHOLD get 0 early."""
    if not n or not m:
        return float(n == m)
    # Runs that may be left unaligned in all; no aligned pair strays further from the diagonal.
    most = n + m - 2 * (n + m) * LEAST_COMMON + 1e-6
    j = j[np.abs(i - j) <= most]
    if len(j) / (n + m - len(j)) < THRESHOLD:
        return 0.0
    common = len(j)
    if common > 1 and not (j[1:] > j[:-1]).all():
        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        common = len(tails)
    return common / (n + m - common)


def text_key(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _runs(column: pa.Array) -> list[np.ndarray]:
    words, starts = word_hashes(column)
    return [labelled(shingles_of(words[a:b])) for a, b in zip(starts[:-1], starts[1:], strict=True)]


def sketches(texts: DataFrame) -> DataFrame:
    """(h, bucket) for every text (h, text) with a word: BANDS rows each."""

    def run(batch: pa.RecordBatch) -> dict:
        keys: list = []
        for part in slices(batch, "text"):
            for runs in _runs(part.column(1)):
                keys.append(order_minhash(runs).view(np.int64) if len(runs) else np.zeros(0, dtype=np.int64))
        return {"h": batch.column(0), "buckets": keys}

    found = map_arrow(texts.select("h", "text"), run, "h binary, buckets array<long>")
    return found.groupBy("h").agg(F.first("buckets").alias("buckets")).select("h", F.explode("buckets").alias("bucket"))


def compared(pairs: DataFrame, docs: DataFrame, beyond: bool) -> DataFrame:
    """Align the pairs (a, b) of text hashes: likeness; the runs of ``b`` (n), those ``a`` has too
    (common) and, if wanted, the hashes of the others (extras)."""
    pairs = materialize(pairs)
    wanted = materialize(pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct())
    if wanted.count() <= MOST_BROADCAST:
        wanted = F.broadcast(wanted)
    texts = materialize(docs.join(wanted, "h", "left_semi").groupBy("h").agg(F.first("text").alias("text")))
    left = texts.select(F.col("h").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("h").alias("b"), F.col("text").alias("text_b"))

    def run(batch: pa.RecordBatch) -> dict:
        names = batch.schema.names
        out: dict = {"likeness": [], "n": [], "common": [], "extras": []}
        for part in slices(batch, "text_a"):
            a, b = (_runs(part.column(names.index(c))) for c in ("text_a", "text_b"))
            for x, y in zip(a, b, strict=True):
                i, j = overlap(x, y)
                out["likeness"].append(aligned(len(x), len(y), i, j))
                out["n"].append(len(y))
                out["common"].append(len(j))
                out["extras"].append(np.delete(y, j).view(np.int64) if beyond else None)
        return out | {c: batch.column(names.index(c)) for c in ("a", "b")}

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return materialize(map_arrow(joined, run, "a binary, b binary, likeness double, n long, common long, extras array<long>"))


def pivot_pairs(buckets: DataFrame) -> DataFrame:
    """(a, b): every text ``b`` of a bucket with the bucket's pivot ``a``."""
    counts = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("met")).filter("met > 1")
    shared = materialize(buckets.join(counts, "bucket"))
    scores = shared.groupBy("h").agg(F.sum("met").alias("score"))
    pivots = shared.join(scores, "h").groupBy("bucket").agg(F.max(F.struct("score", "h"))["h"].alias("a"))
    return shared.join(pivots, "bucket").filter("h <> a").select("a", F.col("h").alias("b")).distinct()


def open_pairs(first: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) of different groups, compared with the same pivot, that what they share
    leaves able to reach THRESHOLD.

    Texts of a pivot meet in blocks, those outside its group with all. A block counts the runs that
    its texts share beyond the pivot and passes on only the pairs for which they suffice.
    """
    of_a = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
    of_b = roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
    placed = first.join(of_a, "a", "left").join(of_b, "b", "left").select(
        F.col("a").alias("pivot"), "b", "n", "common", "extras",
        F.coalesce("root_b", "b").alias("root"), (F.coalesce("root_b", "b") != F.coalesce("root_a", "a")).alias("outside"),
    )
    placed = materialize(placed)
    sizes = placed.groupBy("pivot").agg(
        F.max("outside").alias("any"), F.count(F.lit(1)).alias("texts"), F.sum(F.size("extras")).alias("runs")
    ).filter("any")
    blocks = F.ceil(F.greatest(F.col("texts") / BLOCK_TEXTS, F.col("runs") / BLOCK_RUNS)).cast("int")
    sizes = materialize(sizes.select("pivot", blocks.alias("blocks")))
    own = F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = placed.join(sizes, "pivot").withColumn("own", own)
    fields = ["pivot", "i", "j", "b", "n", "common", "root", "extras"]
    # Named anew, since both sides come from one table.
    fields = [F.col(c).alias(c) for c in fields]
    left = placed.filter("outside").withColumn("i", F.col("own")).withColumn("j", every).select(*fields)
    right = placed.withColumn("j", F.col("own")).withColumn("i", every).select(*fields)
    key = ["pivot", "i", "j"]
    met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_sharing, "a binary, b binary")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sharing(left: pa.Table, right: pa.Table) -> pa.Table:
    """Pairs of two blocks, of different groups, that share enough runs for THRESHOLD."""
    kind = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    if not left.num_rows or not right.num_rows:
        return kind.empty_table()
    sides = []
    for table in (left, right):
        batch = table.combine_chunks().to_batches()[0]
        extras = batch.column("extras")
        row = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(extras)))
        run = np.asarray(extras.flatten())
        order = np.argsort(run, kind="stable")
        sides.append((batch, row[order], run[order]))
    (one, row_1, run_1), (two, row_2, run_2) = sides
    shared = np.zeros((one.num_rows, two.num_rows), dtype=np.int32)
    both = np.intersect1d(run_1, run_2)
    from_1, to_1 = np.searchsorted(run_1, both), np.searchsorted(run_1, both, side="right")
    from_2, to_2 = np.searchsorted(run_2, both), np.searchsorted(run_2, both, side="right")
    # A labelled run stands once in a text, so no place is counted twice.
    for a, b, c, d in zip(from_1.tolist(), to_1.tolist(), from_2.tolist(), to_2.tolist(), strict=True):
        shared[row_1[a:b, None], row_2[c:d]] += 1
    n = [np.asarray(x.column("n")) for x, _, _ in sides]
    common = [np.asarray(x.column("common")) for x, _, _ in sides]
    names = one.column("root").to_pylist() + two.column("root").to_pylist()
    number = {name: k for k, name in enumerate(dict.fromkeys(names))}
    root = np.array([number[x] for x in names])
    enough = LEAST_COMMON * (n[0][:, None] + n[1]) - np.minimum(common[0][:, None], common[1]) - 1e-6
    i, j = np.nonzero((shared >= enough) & (root[: one.num_rows, None] != root[one.num_rows :]))
    return pa.table([one.column("b").take(pa.array(i)), two.column("b").take(pa.array(j))], schema=kind)


def near_links(docs: DataFrame) -> DataFrame:
    """(node, root) of all texts (h, text) that are linked to another."""
    first = compared(pivot_pairs(materialize(sketches(docs))), docs, beyond=True)
    links = first.filter(F.col("likeness") >= THRESHOLD).select("a", "b")
    roots = components(links)
    rest = compared(open_pairs(first, roots), docs, beyond=False)
    more = rest.filter(F.col("likeness") >= THRESHOLD).select("a", "b")
    return roots if more.isEmpty() else components(links.union(more))


def classes(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, class_id (smallest id of its class), copy_of (smallest id with
    the same text), and the hashes that stand for its text and its class."""
    keyed = docs.select(F.col(id).alias("id"), text_key(text).alias("h"))
    copies = materialize(keyed.groupBy("h").agg(F.min("id").alias("copy_of")))
    roots = near_links(docs.select(text_key(text).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    linked = roots.join(copies, roots["node"] == copies["h"]).select("h", "root", "copy_of")
    names = linked.groupBy("root").agg(F.min("copy_of").alias("class_id"))
    named = linked.join(names, "root").select("h", "root", "class_id")
    all_named = materialize(
        copies.join(named, "h", "left").select(
            "h", "copy_of", F.coalesce("class_id", "copy_of").alias("class_id"), F.coalesce("root", "h").alias("class_h")
        )
    )
    return keyed.join(all_named, "h").select(F.col("id").alias(id), "class_id", "copy_of", "h", "class_h")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents whose id names their class, one row each, with their own columns."""
    found = classes(docs, id, text)
    chosen = (
        found.filter(F.col("class_id").eqNullSafe(F.col(id))).groupBy("class_h")
        .agg(F.min("h").alias("_h"), F.first("class_id").alias("class_id"), F.count(F.lit(1)).alias("_n"))
    )
    chosen = materialize(chosen)
    rows = packed(docs, id, text).select("_row", F.col(id).alias("_id"), text_key(text).alias("_h"))
    kept = rows.join(chosen, "_h").filter(F.col("class_id").eqNullSafe(F.col("_id")))
    if not chosen.filter("_n > 1").isEmpty():
        kept = kept.filter("_n = 1").union(kept.filter("_n > 1").dropDuplicates(["_h"]))
    return unpacked(kept)
