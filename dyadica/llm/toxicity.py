"""Toxicity from a lexicon that also catches misspelled terms, read in context.

The lexicon's trie is intersected with Levenshtein automata: a state of the intersection is a set
of (trie node, edits so far), a step reads one letter, and states are made when first reached, so
a word is looked up by one transition a letter and most words die within a few. Words of up to
EXACT_LENGTH letters must match exactly, longer ones may differ by one edit, words of
LONG_LENGTH letters by two.

A hit is scored in a window of words around it: more hits close by and words that address
somebody raise it, quotation marks around it and words of reporting lower it. A document's
features (scores, counts, shares; never its id, language or source) go into a logistic
regression fitted on labelled documents. Further terms are learned from the same documents: words
that stand in several toxic ones and far less often elsewhere.

All labelled documents are used to fit. With fewer than LEAST_LABELS of either label, fixed weights
are used.

Rows: null and empty texts have no hits and get the score of a clean text. Texts are read whole.
Labels that are null do not count; a document labelled twice counts twice. Repeated rows get
equal scores.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dyadica.llm.common import map_arrow, texts_of, with_fields
from dyadica.session import materialize, release, written
from dyadica.sources.sizing import fits_broadcast

LEAST_LABELS = 10
# A learned term stands in at least so many labelled toxic documents and in this share of them,
# so many times more often than in the others.
TERM_DOCUMENTS, TERM_SHARE, TERM_LIFT = 5, 0.002, 12.0
EXACT_LENGTH, LONG_LENGTH = 4, 10
WINDOW = 8
# Entries after which the table of words, and that of the automaton's states, is filled anew.
WORDS_KEPT, STATES_KEPT = 100_000, 50_000
# The seed terms.
TERMS = (
    "idiot", "moron", "stupid", "loser", "trash", "scum", "worthless", "pathetic", "clown",
    "dumbass", "imbecile", "jerk", "bastard", "bitch", "asshole", "retard", "disgusting",
    "filthy", "vermin", "garbage", "cretin", "lowlife", "degenerate", "dumb", "fool",
)
# Words of reporting and of addressing.
REPORTING = {"said", "says", "wrote", "called", "quote", "quoted", "quoting", "term", "word", "insult", "slur", "allegedly"}
ADDRESSING = {"you", "your", "youre", "yourself", "he", "she", "they", "them", "u", "ur"}
QUOTES = "\"'«»“”„‘’`"
# Look-alikes of letters.
LOOKALIKE = str.maketrans("013457@$", "oieastas")
WORD = re.compile(r"[^\s.,;:!?()\[\]{}<>|*#%&/\\]+")


class TermAutomaton:
    """The lexicon's trie intersected with the Levenshtein automata of what is read."""

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.depth = [0]
        for t in terms:
            node = 0
            for c in t:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.depth.append(self.depth[node] + 1)
                node = self.children[node][c]
            self.term[node] = t
        # Most edits a node's terms allow: what a state keeps beyond that is dead.
        self.allowed = [0] * len(self.children)
        for node in range(len(self.children) - 1, -1, -1):
            own = edits_allowed(len(self.term[node])) if self.term[node] else 0
            self.allowed[node] = max([own, *(self.allowed[c] for c in self.children[node].values())])
        self.forget()

    def forget(self) -> None:
        """Drop all states but the start."""
        self.states: list[tuple[tuple[int, int], ...]] = []
        self.number: dict[tuple, int] = {}
        self.steps: list[dict[str, int]] = []
        self.match: list[tuple[str, int] | None] = []
        self.start = self._state({0: 0})

    def _close(self, nodes: dict[int, int]) -> dict[int, int]:
        """Letters of a term left out of the text cost an edit each."""
        todo = list(nodes.items())
        while todo:
            node, cost = todo.pop()
            for child in self.children[node].values():
                if cost + 1 <= self.allowed[child] and cost + 1 < nodes.get(child, 9):
                    nodes[child] = cost + 1
                    todo.append((child, cost + 1))
        return nodes

    def _state(self, nodes: dict[int, int]) -> int:
        nodes = self._close({n: c for n, c in nodes.items() if c <= self.allowed[n]})
        key = tuple(sorted(nodes.items()))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            ends = [(c, self.term[n]) for n, c in key if self.term[n] and c <= edits_allowed(len(self.term[n]))]
            best = min(ends, default=None)
            self.match.append((best[1], best[0]) if best else None)
        return self.number[key]

    def step(self, state: int, letter: str) -> int:
        to = self.steps[state].get(letter)
        if to is None:
            nodes: dict[int, int] = {}
            for node, cost in self.states[state]:
                if cost + 1 <= self.allowed[node]:  # a letter too many
                    nodes[node] = min(nodes.get(node, 9), cost + 1)
                for c, child in self.children[node].items():
                    new = cost + (c != letter)
                    if new <= self.allowed[child]:
                        nodes[child] = min(nodes.get(child, 9), new)
            to = self.steps[state][letter] = self._state(nodes) if nodes else -1
        return to

    def look_up(self, word: str) -> tuple[str, int] | None:
        """The closest term within its allowed edits, and the edits."""
        if len(self.states) > STATES_KEPT:
            self.forget()
        state = self.start
        steps = self.steps
        for c in word:
            state = steps[state].get(c, -2)
            if state == -2:
                state = self._walk(word)
                break
            if state < 0:
                return None
        return self.match[state] if state >= 0 else None

    def _walk(self, word: str) -> int:
        state = self.start
        for c in word:
            state = self.step(state, c)
            if state < 0:
                break
        return state


def edits_allowed(length: int) -> int:
    return 0 if length <= EXACT_LENGTH else 1 if length < LONG_LENGTH else 2


class WordTable(dict):
    """Words as they stand in a text, to (term, edits) or None."""

    def __init__(self, automaton: TermAutomaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str):
        if len(self) >= WORDS_KEPT:
            self.clear()
        low = word.lower().strip(QUOTES + "-_~^=+")
        hit = self.automaton.look_up(low) if low else None
        if hit is None and low and not low.isalpha():
            plain = low.translate(LOOKALIKE)
            if plain != low and (found := self.automaton.look_up(plain)):
                hit = (found[0], max(1, found[1]))
        if len(word) <= 64:
            self[word] = hit
        return hit


def forget_tables() -> None:
    _tables.clear()


FEATURES = ("log_abuse", "strongest", "log_exact", "log_misspelled", "quoted_share", "per_hundred", "any", "several")
# Weights where there are too few labels to fit.
FIXED = ([1.5, 0.6, 0.5, -1.0, -1.5, 0.02, 0.2, 1.0], -3.5)


@dataclass
class Model:
    terms: list[str] = field(default_factory=lambda: list(TERMS))
    weights: list[float] = field(default_factory=lambda: list(FIXED[0]))
    intercept: float = FIXED[1]

    def score(self, x: list[float]) -> float:
        z = self.intercept + sum(w * v for w, v in zip(self.weights, x, strict=True))
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, z))))


def read_text(text: str, table: WordTable) -> tuple[list[float], int, int, int]:
    """A text's features, and its hits: all, quoted, misspelled."""
    words = WORD.findall(text)
    found = list(map(table.__getitem__, words))
    at = [k for k, h in enumerate(found) if h is not None]
    if not at:
        return [0.0] * len(FEATURES), 0, 0, 0
    scores, quoted, misspelled = [], 0, 0
    for k in at:
        lo, hi = max(0, k - WINDOW), k + WINDOW + 1
        near = bisect_left(at, hi) - bisect_left(at, lo) - 1
        around = {w.lower().strip(QUOTES) for w in words[lo:k]} | {w.lower().strip(QUOTES) for w in words[k + 1 : hi]}
        opened = words[k][0] in QUOTES or any(w[0] in QUOTES and w[-1] not in QUOTES for w in words[lo:k])
        closed = words[k][-1] in QUOTES or any(w[-1] in QUOTES and w[0] not in QUOTES for w in words[k + 1 : hi])
        in_quotes = opened and closed
        reported = bool(around & REPORTING)
        quoted += in_quotes
        misspelled += found[k][1] > 0
        score = (1.0 + 0.5 * near) * (1.5 if around & ADDRESSING else 1.0) / (1 + found[k][1])
        scores.append(score * (0.2 if in_quotes else 1.0) * (0.5 if reported else 1.0))
    total = sum(scores)
    x = [
        math.log1p(total), max(scores), math.log1p(len(at) - misspelled), math.log1p(misspelled),
        quoted / len(at), min(20.0, 100.0 * len(at) / len(words)), 1.0, float(total >= 2.0),
    ]
    return x, len(at), quoted, misspelled


_tables: dict[tuple[str, ...], WordTable] = {}


def table_of(terms: list[str]) -> WordTable:
    """One table a Python worker and lexicon."""
    key = tuple(terms)
    if key not in _tables:
        _tables.clear()
        _tables[key] = WordTable(TermAutomaton(terms))
    return _tables[key]


def labelled_documents(docs: DataFrame, labels: DataFrame, usable: Column, id: str, text: str, label: str) -> DataFrame:
    """Texts and labels of all labelled documents that may be learned from. Labels measured as too
    many for a broadcast meet the texts in a shuffle, and the rows found are written once."""
    some = labels.filter(usable & F.col(label).isNotNull() & F.col(id).isNotNull()).select(
        F.col(id).alias("_id"), F.col(label).cast("int").alias("label")
    )
    texts = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    if fits_broadcast(some, some.count()):
        return texts.join(F.broadcast(some), "_id")
    return materialize(texts.join(some.hint("merge"), "_id"), tidy=True)


def learned_terms(labelled: DataFrame) -> list[str]:
    """Words of the toxic documents that are rare in the others."""
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("_text", F.lit(""))), F.lit(r"(?<![\p{L}\p{N}])\p{L}{4,20}(?![\p{L}\p{N}])"), F.lit(0))))
    totals = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return []
    counts = labelled.select("label", word.alias("word")).groupBy("word").agg(
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("t"),
        F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("c"),
    )
    lift = (F.col("t") / toxic) / ((F.col("c") + 1) / (clean + 1))
    least = max(TERM_DOCUMENTS, TERM_SHARE * toxic)
    # Bounded: a toxic document holds at most 1 / TERM_SHARE of them a word.
    return [r["word"] for r in counts.filter((F.col("t") >= least) & (lift >= TERM_LIFT)).select("word").collect()]


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn terms and weights from labelled documents. Only terms and weights reach the driver."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    spark, rows = docs.sparkSession, None
    mark = written(spark)
    try:
        labelled = labelled_documents(docs, labels, F.lit(True) if usable is None else usable, id, text, label)
        counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
        if min(counts.get(0, 0), counts.get(1, 0)) < LEAST_LABELS:
            return Model()
        terms = sorted({*TERMS, *learned_terms(labelled)})

        def run(batch: pa.RecordBatch) -> dict:
            table = table_of(terms)
            x = [read_text(t, table)[0] for t in texts_of(batch, "_text")]
            return {"label": batch.column(batch.schema.get_field_index("label")), "x": x}

        binary = labelled.filter("label in (0, 1)")
        found = map_arrow(binary, run, "label double, x array<double>", release=forget_tables, text="_text")
        # Each text is read once; only its few numbers are kept.
        rows = found.select("label", array_to_vector("x").alias("features")).persist()
        lr = LogisticRegression(maxIter=60, regParam=1e-3, standardization=True)
        fitted = lr.fit(rows)
    finally:
        if rows is not None:
            rows.unpersist()
        release(spark, mark)
    return Model(terms, [float(w) for w in fitted.coefficients], float(fitted.intercept))


def score_documents(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, score (0 to 1), predicted, and the hits: all, quoted, misspelled. No shuffle."""
    schema = with_fields(docs, keep, "score double, predicted int, n_hits long, n_quoted long, n_misspelled long")

    def run(batch: pa.RecordBatch) -> dict:
        table = table_of(model.terms)
        rows = [read_text(t, table) for t in texts_of(batch, "_text")]
        score = np.array([model.score(r[0]) for r in rows])
        out = {"score": score, "predicted": (score >= 0.5).astype(np.int32)}
        out |= {n: [r[k] for r in rows] for k, n in ((1, "n_hits"), (2, "n_quoted"), (3, "n_misspelled"))}
        return out | {c: batch.column(k) for k, c in enumerate(keep)}

    picked = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("_text"))
    return map_arrow(picked, run, schema, release=forget_tables, text="_text")
