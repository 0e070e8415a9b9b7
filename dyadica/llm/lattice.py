"""Likelihood of texts under a subword unigram model, summed over all segmentations.

The pieces are those of an existing vocabulary, and its scores order them: before any text is
seen a piece has probability in inverse proportion to its rank. Their probabilities are then
re-estimated on the training texts by expectation and maximisation: the expected use of every piece
over all segmentations of all training words, from forward and backward sums in log space. A text
is the string of its words, each led by the word mark, and an end. Every piece of the vocabulary
may stand wherever its letters do, and any letter may be spelled by its bytes, so each text has a
probability; it is the sum over all segmentations, which parts by words.

The base is an add-one unigram model of whole words, from counts over all training texts.

Words are counted once over the cluster. A bounded table of the most frequent words is handed to
all tasks and settles most words where they stand; the others are shuffled as hashes to the count
table. No count, piece or word is dropped.

Words of more than LONG_LETTERS are summed block by block: the forward sums need no more than the
last few, and the backward pass makes a block's forward sums again from those kept at its start.

Rows: null and empty texts have their end alone. Words of any length are summed whole. Lower-casing is of A-Z. Repeated rows are rows of
their own. An empty table, or one without training rows, leaves all counts at 0.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dyadica.llm.common import arrow_schema, map_arrow, slices, texts_of, with_fields
from dyadica.llm.wordhash import mix, word_hashes
from dyadica.session import materialize

# Words whose counts are handed to all tasks: 24 bytes each.
FREQUENT_WORDS = 400_000
# Words held while counting in one task, before they are passed on.
COUNTED_WORDS = 400_000
EM_ROUNDS = 2
# Weight of the vocabulary's own order against the corpus, in pieces.
PRIOR_PIECES = 2_000.0
# Rank that byte pieces count as, and what is added to every rank.
BYTE_RANK, RANK_OFFSET = 40_000, 10
CHUNK_BYTES = 2 * 1024 * 1024
# Letters of words in one numpy step.
CELLS = 200_000
# Letters from which a word is summed by itself, and those of one of its blocks.
LONG_LETTERS, BLOCK_LETTERS = 2000, 50_000

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_FILTER_BITS = 22
MARK = "▁"
# What a mark within a word becomes: no piece has it.
NO_PIECE = 0x110000


class Vocabulary:
    """Pieces of a sentencepiece model, found by the hashes of their letters."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        rank = np.full(self.size, np.inf)
        self.byte = np.zeros(256, dtype=np.int64)
        hashes, ids = [], []
        self.longest = 1
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                rank[i] = BYTE_RANK
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and MARK not in piece[1:]:
                rank[i] = -sp.get_score(i)
                h = _U(0)
                for c in piece:
                    h = h * _BASE + _letter(np.array([ord(c)], dtype=np.uint64))[0]
                hashes.append(h)
                ids.append(i)
                self.longest = max(self.longest, len(piece))
        order = np.argsort(np.array(hashes, dtype=np.uint64))
        self.hashes = np.array(hashes, dtype=np.uint64)[order]
        self.ids = np.array(ids, dtype=np.int64)[order]
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[_slot(self.hashes)] = True
        # The end of a text is one more piece.
        self.prior = np.append(np.where(np.isfinite(rank), 1.0 / (np.maximum(rank, 0) + RANK_OFFSET), 0.0), 1.0 / RANK_OFFSET)
        self.prior /= self.prior.sum()

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat places of the hashes that are pieces, and the pieces."""
        flat = h.ravel()
        at = np.flatnonzero(self.filter[_slot(flat)])
        place = np.minimum(np.searchsorted(self.hashes, flat[at]), len(self.hashes) - 1)
        good = self.hashes[place] == flat[at]
        return at[good], self.ids[place[good]]


def _letter(codes: np.ndarray) -> np.ndarray:
    return mix(codes + _U(1)) | _U(1)


def _slot(h: np.ndarray) -> np.ndarray:
    return (mix(h) >> _U(64 - _FILTER_BITS)).astype(np.int64)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary a Python worker."""
    with np.errstate(over="ignore"):
        return Vocabulary(path)


class Lattice:
    """All segmentations of some words of at most one length, as arrays."""

    def __init__(self, words: list[str], vocab: Vocabulary, logp: np.ndarray):
        n, width = len(words), max(map(len, words)) + 1
        self.lengths = np.array([len(w) + 1 for w in words])
        codes = np.zeros((n, width), dtype=np.uint64)
        codes[:, 0] = ord(MARK)
        for k, w in enumerate(words):
            codes[k, 1 : len(w) + 1] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes[:, 1:][codes[:, 1:] == ord(MARK)] = NO_PIECE
        self.vocab, self.n, self.width = vocab, n, width
        self.most = min(vocab.longest, width)
        inside = np.arange(width)[None, :] < self.lengths[:, None]
        with np.errstate(over="ignore"):
            sums = np.zeros((n, width + 1), dtype=np.uint64)
            letters = _letter(codes)
            for j in range(width):
                sums[:, j + 1] = sums[:, j] * _BASE + letters[:, j]
            # edge[:, j, k]: log probability of the piece of k + 1 letters that ends after letter j.
            self.edge = np.full((n, width, self.most), -np.inf)
            self.pieces = []
            power = _U(1)
            for k in range(self.most):
                power = power * _BASE
                h = sums[:, k + 1 :] - sums[:, : width - k] * power
                at, ids = vocab.find(h)
                row, j = at // (width - k), at % (width - k) + k
                good = inside[row, j]
                row, j, ids = row[good], j[good], ids[good]
                self.edge[row, j, k] = logp[ids]
                self.pieces.append((row, j, ids))
        self.letters, self.letter_at = np.unique(codes[inside], return_inverse=True)
        self.spelled = [spelling(int(c)) for c in self.letters]
        by_bytes = np.array([logp[vocab.byte[list(s)]].sum() for s in self.spelled])
        row, j = np.nonzero(inside)
        self.row, self.j = row, j
        self.by_bytes = by_bytes[self.letter_at]
        self.edge[row, j, 0] = np.logaddexp(self.edge[row, j, 0], self.by_bytes)

    def forward(self) -> np.ndarray:
        alpha = np.full((self.n, self.width + 1), -np.inf)
        alpha[:, 0] = 0.0
        for j in range(self.width):
            k = min(self.most, j + 1)
            alpha[:, j + 1] = _log_sum(alpha[:, j - k + 1 : j + 1][:, ::-1] + self.edge[:, j, :k])
        return alpha

    def backward(self) -> np.ndarray:
        beta = np.full((self.n, self.width + 1), -np.inf)
        beta[np.arange(self.n), self.lengths] = 0.0
        for j in range(self.width - 1, -1, -1):
            k = min(self.most, self.width - j)
            ahead = self.edge[:, np.arange(j, j + k), np.arange(k)] + beta[:, j + 1 : j + k + 1]
            beta[:, j] = np.logaddexp(beta[:, j], _log_sum(ahead))
        return beta

    def log_probability(self) -> np.ndarray:
        return self.totals(self.forward())

    def totals(self, alpha: np.ndarray) -> np.ndarray:
        return alpha[np.arange(self.n), self.lengths]

    def expected(self, logp: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected use of every piece over all segmentations of the words, times their counts."""
        alpha, beta = self.forward(), self.backward()
        total = self.totals(alpha)
        out = np.zeros(len(logp))
        for k, (row, j, ids) in enumerate(self.pieces):
            weight = np.exp(alpha[row, j - k] + logp[ids] + beta[row, j + 1] - total[row]) * counts[row]
            out += np.bincount(ids, weight, minlength=len(out))
        weight = np.exp(alpha[self.row, self.j] + self.by_bytes + beta[self.row, self.j + 1] - total[self.row]) * counts[self.row]
        for weight_of, spelled in zip(np.bincount(self.letter_at, weight, minlength=len(self.letters)), self.spelled, strict=True):
            for b in spelled:
                out[self.vocab.byte[b]] += weight_of
        return out


class LongLattice:
    """All segmentations of one long word, block by block."""

    def __init__(self, word: str, vocab: Vocabulary, logp: np.ndarray):
        self.codes = np.frombuffer((MARK + word).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
        self.codes[1:][self.codes[1:] == ord(MARK)] = NO_PIECE
        self.vocab, self.logp, self.most = vocab, logp, vocab.longest

    def _pieces(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pieces that lie in the letters lo..hi-1: where they begin and end, their log probability
        and number; -1 - c stands for letter c spelled by bytes."""
        codes = self.codes[lo:hi]
        n = len(codes)
        starts, ends, ids = [], [], []
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, dtype=np.uint64)
            total, letters = _U(0), _letter(codes.astype(np.uint64))
            for j in range(n):
                total = total * _BASE + letters[j]
                sums[j + 1] = total
            power = _U(1)
            for k in range(min(self.most, n)):
                power = power * _BASE
                at, found = self.vocab.find(sums[k + 1 :] - sums[: n - k] * power)
                starts.append(at)
                ends.append(at + k + 1)
                ids.append(found)
        kinds, which = np.unique(codes, return_inverse=True)
        spelled = np.array([self.logp[self.vocab.byte[list(spelling(int(c)))]].sum() for c in kinds])
        lp = np.concatenate([self.logp[np.concatenate(ids)], spelled[which]])
        starts, ends = np.concatenate([*starts, np.arange(n)]), np.concatenate([*ends, np.arange(1, n + 1)])
        return starts + lo, ends + lo, lp, np.concatenate([*ids, -1 - codes.astype(np.int64)])

    def _forward(self, lo: int, hi: int, before: list[float]) -> list[float]:
        """Sums at the places lo+1..hi, from those at the last places up to lo."""
        first = lo - len(before) + 1
        starts, ends, lp, _ = self._pieces(first, hi)
        return _running(starts - first, ends - first, lp, before, hi - lo)

    def log_probability(self) -> np.ndarray:
        for _, _, alpha in self._blocks():
            total = alpha[-1]
        return np.array([total])

    def _blocks(self):
        """(start, sums up to it that its pieces need, sums in it) of the blocks in order."""
        before = [0.0]
        for lo in range(0, len(self.codes), BLOCK_LETTERS):
            alpha = self._forward(lo, min(lo + BLOCK_LETTERS, len(self.codes)), before)
            yield lo, before, alpha
            before = (before + alpha)[-self.most :]

    def expected(self, logp: np.ndarray, counts: np.ndarray) -> np.ndarray:
        kept = [(lo, before, alpha[-1]) for lo, before, alpha in self._blocks()]
        total, n = kept[-1][2], len(self.codes)
        out = np.zeros(len(logp))
        after = [0.0]  # backward sums at the places from the block's end on
        for lo, before, _ in reversed(kept):
            hi = min(lo + BLOCK_LETTERS, n)
            alpha = np.array([before[-1], *self._forward(lo, hi, before)])
            starts, ends, lp, ids = self._pieces(lo, min(hi + self.most - 1, n))
            mine = starts < hi
            starts, ends, lp, ids = starts[mine], ends[mine], lp[mine], ids[mine]
            # Backward is forward from the other end.
            last = hi + len(after) - 1
            beta = _running(last - ends, last - starts, lp, after[::-1], hi - lo)[::-1]
            beta = np.array(beta + after)
            weight = np.exp(alpha[starts - lo] + lp + beta[ends - lo] - total) * counts[0]
            whole = ids >= 0
            out += np.bincount(ids[whole], weight[whole], minlength=len(out))
            kinds, which = np.unique(-1 - ids[~whole], return_inverse=True)
            for c, w in zip(kinds.tolist(), np.bincount(which, weight[~whole]), strict=True):
                np.add.at(out, self.vocab.byte[list(spelling(c))], w)
            after = beta[: self.most].tolist()
        return out


def _running(starts: np.ndarray, ends: np.ndarray, lp: np.ndarray, known: list[float], more: int) -> list[float]:
    """The next ``more`` log sums after the known ones, over arcs between numbered places."""
    good = ends >= len(known)
    order = np.argsort(ends[good], kind="stable")
    starts, ends, lp = starts[good][order], ends[good][order], lp[good][order].tolist()
    cuts = np.searchsorted(ends, np.arange(len(known), len(known) + more + 1)).tolist()
    starts, sums = starts.tolist(), list(known)
    for a, b in zip(cuts, cuts[1:]):
        if b == a + 1:
            sums.append(sums[starts[a]] + lp[a])
        else:
            terms = [sums[i] + p for i, p in zip(starts[a:b], lp[a:b])]
            top = max(terms)
            sums.append(top + math.log(sum([math.exp(t - top) for t in terms])))
    return sums[len(known) :]


def spelling(code: int) -> bytes:
    return chr(ord(MARK) if code == NO_PIECE else code).encode("utf-8", "surrogatepass")


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - safe[:, None]).sum(axis=1)) + safe


def lattices(words: list[str], vocab: Vocabulary, logp: np.ndarray):
    """Lattices of all words, of like lengths together, and the places of their words."""
    order = np.argsort([len(w) for w in words], kind="stable")
    start = 0
    while start < len(order):
        end, width = start, 0
        while end < len(order):
            width = len(words[order[end]]) + 1
            if width > LONG_LETTERS:
                break
            if end > start and (end - start + 1) * width > CELLS:
                break
            end += 1
        if end == start:
            yield order[start : start + 1], LongLattice(words[order[start]], vocab, logp)
            start += 1
            continue
        at = order[start:end]
        yield at, Lattice([words[k] for k in at], vocab, logp)
        start = end


def word_log_probability(words: list[str], vocab: Vocabulary, logp: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words))
    for at, lattice in lattices(words, vocab, logp):
        out[at] = lattice.log_probability()
    return out


# ------------------------------------------------------------------ jobs


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c): every word of every text (text, train), with its count over training texts."""
    kind = arrow_schema("word binary, c long")

    def out(counts: Counter):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], schema=kind)

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                for t, train in zip(texts_of(part, "text"), part.column(1).to_pylist(), strict=True):
                    words = t.encode("utf-8", "surrogatepass").lower().split()
                    if train:
                        counts.update(words)
                    else:
                        counts.update(dict.fromkeys(words, 0))
                if len(counts) > COUNTED_WORDS:
                    yield out(counts)
                    counts = Counter()
        if counts:
            yield out(counts)

    return docs.select("text", "train").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _batched(column: pa.Array) -> list[str]:
    return [w.decode("utf-8", "surrogatepass") for w in column.to_pylist()]


def fit_pieces(counts: DataFrame, ends: int, path: str) -> np.ndarray:
    """Natural log probabilities of all pieces, the end last, from (word, c). The driver gets one
    number a piece and round."""
    spark = counts.sparkSession
    vocab = vocabulary(path)
    p = vocab.prior
    with np.errstate(divide="ignore"):
        logp = np.log(p)
    for _ in range(EM_ROUNDS):
        now = spark.sparkContext.broadcast(logp)

        def run(batches, now=now):
            vocab = vocabulary(path)
            total = np.zeros(vocab.size + 1)
            for b in batches:
                words, c = _batched(b.column(0)), np.asarray(b.column(1), dtype=np.float64)
                for at, lattice in lattices(words, vocab, now.value):
                    total += lattice.expected(now.value, c[at])
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(some), pa.array(total[some])], names=["piece", "used"])

        rows = counts.filter("c > 0").mapInArrow(run, "piece long, used double")
        # Fixed-point sums do not depend on their order.
        used = np.zeros(vocab.size + 1)
        for r in rows.groupBy("piece").agg(F.sum(F.col("used").cast("decimal(38,6)")).cast("double").alias("used")).collect():
            used[r.piece] = r.used
        used[-1] = ends
        p = used + PRIOR_PIECES * vocab.prior
        with np.errstate(divide="ignore"):
            logp = np.log(p / p.sum())
    return logp


def frequent_words(table: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes in order, counts and log probabilities of the most frequent words: those from the
    least count up, in sixteenths of a doubling, at which they are at most FREQUENT_WORDS."""
    level = F.floor(F.log2("c") * 16)
    held = table.filter("c > 0").withColumn("level", level)
    total, cut = 0, None
    for r in sorted(held.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        total += r["count"]
        if total > FREQUENT_WORDS:
            break
        cut = r["level"]
    some = held.filter(F.col("level") >= cut) if cut is not None else held.filter("false")
    found = some.select("h", "c", "lp").toArrow()
    h, c, lp = (found.column(k).to_numpy() for k in range(3))
    order = np.argsort(h)
    return h[order], c[order], lp[order]


def score_documents(docs: DataFrame, path: str, train: Column, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``; n_tokens, n_known, train_tokens; base_score and score, in log10."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    counts = materialize(count_words(texts))
    ends = texts.filter("train").count()
    sums = counts.agg(F.sum("c"), F.sum(F.when(F.col("c") > 0, 1).otherwise(0))).first()
    tokens = int(sums[0] or 0) + ends
    kinds = int(sums[1] or 0) + (ends > 0)
    below = math.log10(tokens + kinds + 1)
    logp = fit_pieces(counts, ends, path)
    held = spark.sparkContext.broadcast(logp)
    ten = math.log(10)

    def scored(batch: pa.RecordBatch) -> dict:
        words = _batched(batch.column(0))
        lp = word_log_probability(words, vocabulary(path), held.value) / ten
        h = np.concatenate([word_hashes(part.column(0).cast(pa.string()))[0] for part in slices(batch, "word", CHUNK_BYTES)])
        return {"h": h.view(np.int64), "c": batch.column(1), "lp": lp}

    table = materialize(map_arrow(counts, scored, "h long, c long, lp double"))
    frequent = spark.sparkContext.broadcast(frequent_words(table))
    end_base, end_lp = math.log10(ends + 1) - below, float(logp[-1]) / ten
    end_known = int(ends > 0)

    local = with_fields(
        docs, keep, "n_tokens long, n_known long, base_score double, score double, rare array<long>, times array<int>")

    def settle(batch: pa.RecordBatch) -> dict:
        known_h, known_c, known_lp = frequent.value
        log_c = np.log10(known_c + 1.0) - below
        out: dict = {n: [] for n in ("n_tokens", "n_known", "base_score", "score", "rare", "times")}
        for part in slices(batch, "_text", CHUNK_BYTES):
            hashes, starts = word_hashes(part.column(part.schema.get_field_index("_text")), lower=True)
            h = hashes.view(np.int64)
            at = np.minimum(np.searchsorted(known_h, h), max(0, len(known_h) - 1))
            known = known_h[at] == h if len(known_h) else np.zeros(len(h), dtype=bool)
            at = at[known]
            marks = np.concatenate([[0], np.cumsum(known)])[starts]
            for a, b, x, y in zip(starts[:-1], starts[1:], marks[:-1], marks[1:], strict=True):
                mine = at[x:y]
                rare, times = np.unique(h[a:b][~known[a:b]], return_counts=True)
                out["n_tokens"].append(int(b - a) + 1)
                out["n_known"].append(int((known_c[mine] > 0).sum()) + end_known)
                out["base_score"].append(math.fsum(log_c[mine].tolist()) + end_base)
                out["score"].append(math.fsum(known_lp[mine].tolist()) + end_lp)
                out["rare"].append(rare)
                out["times"].append(times.astype(np.int32))
        return out | {c: batch.column(k) for k, c in enumerate(keep)}

    picked = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("_text"))
    # Written before it is numbered again: the numbers stay what they are.
    rows = materialize(map_arrow(picked, settle, local).withColumn("_row", F.monotonically_increasing_id()))
    rare = rows.select("_row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select(
        "_row", F.col("w.rare").alias("h"), F.col("w.times").alias("n"))
    more = rare.join(table, "h").groupBy("_row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("_known"),
        F.sum(F.col("n") * (F.log10(F.col("c") + 1.0) - below)).alias("_base"),
        F.sum(F.col("n") * F.col("lp")).alias("_score"),
    )
    return rows.drop("rare", "times").join(more, "_row", "left").select(
        *[F.col(f"`{c}`") for c in keep], "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("_score", F.lit(0.0))).alias("score"),
    )
