"""Ranked lexical search by the Best Position Algorithm.

Documents are scored against each item by whole-number weights of their common terms. Every term
has an impact list: the documents that hold it, by falling impact. For one item its terms' lists
are read in step, a block of places at a time; every document met is scored in full by direct
accesses to the other lists, and the places found there count as seen too. A list's best position
is the end of its first places that have all been seen, by whichever way. No unseen document can
exceed the sum of the impacts at the best positions, which is a tighter bound than that of the
places last read. Reading ends once this bound is strictly below the k-th best score, so no
document that ties with the k-th is missed.

One pass over the texts writes the counts of the wanted terms of every document. A second pass
over this table deals it into shards of bounded size, has the lists of a shard in memory, and
searches them for every item; the best scores carry over from shard to shard of a task and bound
the next search from its start. Every task hands on no more than k documents an item, which are
ranked together at the end. Items are taken in blocks of about MOST_TERMS terms, so that what tasks
look up is bounded.

Terms are the maximal runs of ASCII letters and digits and of all characters beyond ASCII, with
A-Z in lower case.

Rows: ids of documents are whole numbers. A null text, or one without terms, is in no count and never found. Texts of any length are
read whole. An item that is null or without terms has no results. Documents and items whose
rows or ids repeat are rows of their own. Equal scores go by ascending id, null ids last. Empty
tables give no results. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from dyadica.llm.common import map_arrow
from dyadica.session import materialize

# The parts of the score.
WEIGHT_UNIT, TF_UNIT, TF_FACTOR, LENGTH_FACTOR = 1000, 1_000_000_000, 1000, 8
LENGTH_BASE, LENGTH_SHARE = 10, 90
# Terms of the items of one block, about.
MOST_TERMS = 200_000
# Documents, and counts of terms, that a shard holds.
SHARD_DOCUMENTS, SHARD_COUNTS = 50_000, 500_000
# Places of each list in the first and in later blocks of reading.
FIRST_PLACES, MOST_PLACES = 4, 1024
# Bytes of a text cut into terms at once.
PIECE_BYTES = 1 << 20
TERM_TABLE = bytes(
    b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32
    for b in range(256)
)


def term_pieces(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    raw = text.encode("utf-8", "surrogatepass").translate(TERM_TABLE)
    start = 0
    while start < len(raw):
        end = raw.find(b" ", start + PIECE_BYTES)
        end = len(raw) if end < 0 else end
        yield raw[start:end].split()
        start = end


def item_terms(items: DataFrame, id: str, text: str) -> DataFrame:
    """(item, id, terms): the distinct terms of each item that has any, by a number of its own."""

    def run(batch: pa.RecordBatch) -> dict:
        terms = [sorted({t for piece in term_pieces(x or "") for t in piece}) for x in batch.column(1).to_pylist()]
        return {"id": batch.column(0), "terms": terms}

    picked = items.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    found = map_arrow(picked, run, f"id {kind}, terms array<binary>").filter(F.size("terms") > 0)
    # Written with the numbers, so that they stay what they are.
    return materialize(found.withColumn("item", F.monotonically_increasing_id()))


def term_counts(docs: DataFrame, id: str, text: str, number: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, tfs) of every document with a term: how many terms it has, and which of the
    numbered ones, in order, how often."""
    held = docs.sparkSession.sparkContext.broadcast(number)

    def run(batch: pa.RecordBatch) -> dict:
        get = held.value.get
        sizes, ends, terms, tfs = [], [0], [], []
        for t in batch.column(1).to_pylist():
            n, counts = 0, Counter()
            for words in term_pieces(t or ""):
                n += len(words)
                counts.update(map(get, words))
            counts.pop(None, None)
            mine = sorted(counts)
            terms += mine
            tfs += [counts[k] for k in mine]
            sizes.append(n)
            ends.append(len(terms))
        offsets = pa.array(ends, pa.int32())
        return {
            "id": batch.column(0), "n": sizes,
            "terms": pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
            "tfs": pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64())),
        }

    picked = docs.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("_text"))
    rows = map_arrow(picked, run, "id long, n long, terms array<int>, tfs array<long>", text="_text")
    return rows.filter("n > 0")


class Best:
    """The k best (score, id) so far, best first; a null id is last among equals."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids, self.absent = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """The score below which nothing can enter; 0 while there is room, as for no score at all."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 0

    def take(self, scores: np.ndarray, ids: np.ndarray, absent: np.ndarray) -> None:
        good = scores >= max(1, self.least)
        if good.any():
            scores, ids, absent = (
                np.concatenate([old, new[good]])
                for old, new in ((self.scores, scores), (self.ids, ids), (self.absent, absent))
            )
            order = np.lexsort((ids, absent, -scores))[: self.k]
            self.scores, self.ids, self.absent = scores[order], ids[order], absent[order]


class Shard:
    """The impact lists of some documents, for sorted and for direct access.

    ``doc``, ``term`` and ``tf`` say how often a document (by its place here) holds a term, in order
    of documents and of their terms.
    """

    def __init__(self, ids, absent, sizes, doc, term, tf, weights, documents: int, words: int):
        self.ids, self.absent, self.n_terms = ids, absent, len(weights)
        length = LENGTH_BASE + (LENGTH_SHARE * sizes * documents) // words
        impact = weights[term] * ((TF_UNIT * tf) // (TF_FACTOR * tf + LENGTH_FACTOR * length[doc]))
        self.keys, self.impact_of = doc * self.n_terms + term, impact
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.place = np.empty(len(order), dtype=np.int64)
        self.place[order] = np.arange(len(order))
        self.starts = np.searchsorted(term[order], np.arange(self.n_terms + 1))

    def search(self, terms: np.ndarray, best: Best) -> int:
        """Add to the best documents for these terms; says how many documents were scored."""
        lists = terms[self.starts[terms + 1] > self.starts[terms]]
        if not len(lists):
            return 0
        first, sizes = self.starts[lists], self.starts[lists + 1] - self.starts[lists]
        if best.least and self.impact[first].sum() < best.least:
            return 0
        seen = [np.zeros(s, dtype=bool) for s in sizes.tolist()]
        position = np.zeros(len(lists), dtype=np.int64)
        scored = np.zeros(len(self.ids), dtype=bool)
        read, step, met = 0, FIRST_PLACES, 0
        most = int(sizes.max())
        while read < most:
            docs = []
            for at, size, mine in zip(first.tolist(), sizes.tolist(), seen):
                docs.append(self.doc[at + min(read, size) : at + min(read + step, size)])
                mine[read : read + step] = True
            docs = np.unique(np.concatenate(docs))
            docs = docs[~scored[docs]]
            read, step = read + step, min(2 * step, MOST_PLACES)
            if len(docs):
                scored[docs] = True
                met += len(docs)
                scores, column, place = self._direct(docs, lists)
                best.take(scores, self.ids[docs], self.absent[docs])
                order = np.argsort(column, kind="stable")
                cuts = np.searchsorted(column[order], np.arange(len(lists) + 1)).tolist()
                places = place[order] - first[column[order]]
                for mine, a, b in zip(seen, cuts, cuts[1:]):
                    mine[places[a:b]] = True
            for k, mine in enumerate(seen):
                at = int(position[k])
                if at < len(mine) and mine[at]:
                    beyond = mine[at:]
                    gap = int(beyond.argmin())
                    position[k] = len(mine) if beyond[gap] else at + gap
            if best.least and self.bound(first, sizes, position) < best.least:
                break
        return met

    def bound(self, first: np.ndarray, sizes: np.ndarray, position: np.ndarray) -> int:
        """The sum of the impacts at the best positions; a list seen to its end adds nothing."""
        open_ = position < sizes
        return int(self.impact[first[open_] + np.maximum(position[open_] - 1, 0)].sum())

    def _direct(self, docs: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whole scores of documents, and for each list that holds one: which list, and where."""
        wanted = docs[:, None] * self.n_terms + lists
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        held = self.keys[at] == wanted
        scores = np.where(held, self.impact_of[at], 0).sum(axis=1)
        return scores, np.nonzero(held)[1], self.place[at[held]]


def shards(batches, weights: np.ndarray, documents: int, words: int) -> Iterator[Shard]:
    """Rows (id, n, terms, tfs), dealt into shards of bounded size."""
    held: list[tuple] = []
    n_docs = n_counts = 0

    def out() -> Shard:
        ids, absent, sizes, counts, term, tf = (np.concatenate(c) for c in zip(*held))
        doc = np.repeat(np.arange(len(ids)), counts)
        return Shard(ids, absent, sizes, doc, term.astype(np.int64), tf, weights, documents, words)

    for batch in batches:
        counts = np.asarray(batch.column(2).value_lengths(), dtype=np.int64)
        ends = np.cumsum(counts)
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            room = int(np.searchsorted(ends, before + SHARD_COUNTS - n_counts, side="right"))
            stop = min(max(start + (not held), room), start + SHARD_DOCUMENTS - n_docs, batch.num_rows)
            if stop > start:
                part = batch.slice(start, stop - start)
                ids = part.column(0)
                held.append((
                    np.asarray(ids.fill_null(0)), np.asarray(ids.is_null().to_numpy(zero_copy_only=False)),
                    np.asarray(part.column(1)), counts[start:stop],
                    np.asarray(part.column(2).flatten()), np.asarray(part.column(3).flatten()),
                ))
                n_docs += stop - start
                n_counts += int(ends[stop - 1]) - before
                start = stop
            if start < batch.num_rows:
                yield out()
                held.clear()
                n_docs = n_counts = 0
    if held:
        yield out()


def search_block(docs: DataFrame, items: list, id: str, text: str, k: int) -> DataFrame:
    """(item, id, score): at most ``k`` documents for every item and task, the best of them all
    among these. ``items`` are rows (item, terms)."""
    names = sorted({t for r in items for t in r["terms"]})
    number = {t: i for i, t in enumerate(names)}
    counts = materialize(term_counts(docs, id, text, number))
    totals = counts.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("words")).first()
    documents, words = totals["documents"], int(totals["words"] or 0)
    # One row a term of the block.
    df = np.zeros(len(names), dtype=np.int64)
    for r in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[r["term"]] = r["count"]
    weights = np.array(
        [math.floor(WEIGHT_UNIT * math.log((2 * documents + 2) / (2 * int(c) + 1))) for c in df], dtype=np.int64)
    wanted = [(r["item"], np.array([number[t] for t in r["terms"]], dtype=np.int64)) for r in items]
    held = docs.sparkSession.sparkContext.broadcast((weights, wanted))

    def run(batches):
        weights, wanted = held.value
        best = [Best(k) for _ in wanted]
        for shard in shards(batches, weights, documents, words):
            for (_, terms), mine in zip(wanted, best):
                shard.search(terms, mine)
        sizes = [len(b.scores) for b in best]
        if sum(sizes):
            ids = pa.array(np.concatenate([b.ids for b in best]), pa.int64(), mask=np.concatenate([b.absent for b in best]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([i for i, _ in wanted], sizes), pa.int64()), ids,
                 pa.array(np.concatenate([b.scores for b in best]), pa.int64())],
                names=["item", "id", "score"])

    return counts.filter(F.size("terms") > 0).mapInArrow(run, "item long, id long, score long")


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The ``k`` highest-scoring documents of every item: item_id, rank (from 1), id, score."""
    queries = item_terms(items, item_id, item_text)
    n_terms = queries.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-int(n_terms) // MOST_TERMS))
    kind = F.pmod(F.xxhash64("item"), F.lit(blocks))
    found = docs.sparkSession.createDataFrame([], "item long, id long, score long")
    for block in range(blocks):
        mine = queries.filter(kind == block).select("item", "terms").collect()
        if mine:
            found = found.union(search_block(docs, mine, id, text, k))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    named = queries.select("item", F.col("id").alias("_name"))
    return ranked.join(named, "item").select(F.col("_name").alias(item_id), "rank", F.col("id").alias(id), "score")
