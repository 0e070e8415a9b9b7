"""Personal data: generators propose overlapping spans, boosted trees choose among them.

Exact patterns give the base spans, which always stay. Wider generators propose further spans of
the same kinds (spelled-out addresses, defanged numbers, numbers without a country code). Each
proposal becomes a vector of format and context features; gradient-boosted trees score it, and a
threshold per kind, calibrated on held-out proposals, decides. Proposals that overlap are taken by
descending score.

The trees learn from the corpus itself: positives are base spans and the same spans rewritten in
the wider forms within their own context; negatives are proposals away from base spans, and base
spans corrupted so that they break their kind's rule. They learn from every document, their splits
included, and thresholds count every held-out proposal. Without LEAST_EXAMPLES of either label there is no
model, and base spans alone are given.

Rows: null and empty texts have no spans. Texts are searched whole. Repeated rows give repeated
results. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dyadica.llm.common import map_arrow, texts_of, with_fields

KINDS = ("email", "ip", "card", "phone")
LEAST_EXAMPLES = 30
ROUNDS, DEPTH = 10, 3
# Spark takes the candidates for splits from so many rows, or the square of the bins if that is more.
LEAST_BINS, SPLIT_ROWS = 32, 10_000
# Precision asked of each kind's threshold on held-out proposals, and the least threshold.
PRECISION, LEAST_THRESHOLD = 0.98, 0.9
# Scores are told apart in steps of one thousandth when thresholds are set.
SCORE_STEPS = 1000

# The exact patterns.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match takes whole runs of digits, so it starts where no digit precedes.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Wider forms.
WIDER = {
    "email": re.compile(
        r"[A-Za-z0-9._%+-]{1,64}\s?(?:[\[({]\s?at\s?[\])}]|\sat\s)\s?[A-Za-z0-9-]{1,63}"
        r"(?:\s?(?:[\[({]\s?dot\s?[\])}]|\sdot\s|\.)\s?[A-Za-z0-9-]{1,63})+", re.I),
    "ip": re.compile(r"(?<![0-9])[0-9]{1,4}(?:\s?(?:\[\.\]|\(\.\)|\[dot\]|,|\.)\s?[0-9]{1,4}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[ ./_-]{0,2}[0-9]){11,20}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])\(?[0-9]{1,4}\)?(?:[ ./-]{1,2}\(?[0-9]{2,4}\)?){1,4}(?![0-9])"),
}
# Where the sign of the wider e-mail form starts, and the characters before it.
AT = re.compile(r"[\[({\s](?=(?<=\s)at\s|(?<!\s)\s?at\s?[\])}])", re.I)
BEFORE_AT = re.compile(r"[A-Za-z0-9._%+-]", re.I)
# Words that announce a kind.
CUES = {
    "email": {"email", "e-mail", "mail", "contact", "write", "address"},
    "ip": {"ip", "host", "server", "address", "from", "client"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "payment", "account"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "cell", "contact"},
}
WINDOW = 40


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each sign outwards, in time linear in the text."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and LOCAL.match(text[start - 1]):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all exact matches that hold their kind's rule, in order."""
    spans = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
                spans.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
                spans.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(digits_of(m.group())) <= 15:
                    spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def spelled_emails(text: str):
    """All matches of the wider e-mail form, in order. They are tried only before an 'at' between
    spaces or brackets, which every match holds, at the first place from which it can be reached."""
    last = 0
    for sign in AT.finditer(text):
        end = sign.start()
        if end > last and text[end - 1].isspace():
            end -= 1
        start = end
        while start > last and end - start < 64 and BEFORE_AT.match(text[start - 1]):
            start -= 1
        m = WIDER["email"].match(text, start) if start < end else None
        if m:
            yield m
            last = m.end()


def proposals(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """What the wider generators find that does not overlap a base span."""
    found = []
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    has_digit = DIGIT.search(text) is not None
    for number, kind in enumerate(KINDS):
        if kind == "email":
            matches = spelled_emails(text)
        elif has_digit:
            matches = WIDER[kind].finditer(text)
        else:
            continue
        for m in matches:
            a, b = m.span()
            while b > a and text[b - 1].isspace():
                b -= 1
            before = bisect_left(starts, b)
            if not before or reach[before - 1] <= a:
                found.append((a, number, b))
    return found


FEATURES = (
    "is_email", "is_ip", "is_card", "is_phone", "length", "digits", "groups", "longest_group", "shortest_group",
    "separators", "kinds_of_separator", "plus", "brackets", "luhn", "largest_group_value", "spelled_at", "spelled_dot",
    "dots", "before", "after", "cues", "digits_around", "marks_around", "upper_around", "domain_letters",
)


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    s = text[start:end]
    groups = re.findall(r"[0-9]+", s)
    marks = re.findall(r"[^A-Za-z0-9]", s)
    around = text[max(0, start - WINDOW) : start] + text[end : end + WINDOW]
    size = max(1, len(around))
    side = lambda c: 0.0 if not c or c.isspace() else 1.0 if c.isalnum() else 2.0
    words = re.findall(r"[\w-]+", text[max(0, start - WINDOW) : start].lower())[-5:]
    d = digits_of(s)
    low = s.lower()
    return [
        *(float(kind == k) for k in range(4)),
        float(len(s)), float(len(d)), float(len(groups)),
        float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)),
        float(len(marks)), float(len(set(marks))), float("+" in s), float("(" in s or "[" in s),
        float(bool(d) and luhn(d)), float(max((min(int(g[:6]), 999_999) for g in groups), default=0)),
        float(re.search(r"\bat\b", low) is not None), float(re.search(r"\bdot\b", low) is not None),
        float(s.count(".")), side(text[start - 1 : start]), side(text[end : end + 1]),
        float(sum(w in CUES[KINDS[kind]] for w in words)),
        len(digits_of(around)) / size, sum(not c.isalnum() and not c.isspace() for c in around) / size,
        sum(c.isupper() for c in around) / size,
        float(len(re.sub(r"[^a-z]", "", low.rsplit(".", 1)[-1]))),
    ]


def rewritten(kind: int, s: str) -> list[tuple[str, int]]:
    """The same datum in wider forms (1), and corrupted (0)."""
    pick = zlib.crc32(s.encode())
    d = digits_of(s)
    if kind == 0:
        name, host = s.split("@", 1)
        at, dot = ((" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "."))[pick % 3]
        return [(name + at + host.replace(".", dot), 1), (name + " at " + host.split(".")[0] + ". " + name, 0)]
    if kind == 1:
        parts = s.split(".")
        sign = ("[.]", "(.)", " . ")[pick % 3]
        wrong = [str(256 + (pick + 37 * k) % 700) for k in range(4)]
        return [(sign.join(parts), 1), (sign.join(wrong), 0), (".".join(parts[:2] + wrong[:1] + ["0"]), 0), (", ".join(parts[:3] + ["1900"]), 0)]
    if kind == 2:
        sign = (".", "/", "  ")[pick % 3]
        cut = [d[k : k + 4] for k in range(0, len(d), 4)]
        wrong = d[:-1] + str((int(d[-1]) + 1 + pick % 8) % 10)
        return [(sign.join(cut), 1), (sign.join(wrong[k : k + 4] for k in range(0, len(d), 4)), 0), (wrong, 0)]
    local = d[-10:]
    forms = (f"({local[:3]}) {local[3:6]}-{local[6:]}", f"{local[:3]}-{local[3:6]}-{local[6:]}", f"00{d[:-10]} {local[:3]} {local[3:6]} {local[6:]}")
    return [(forms[pick % 3], 1), (forms[(pick + 1) % 3], 1), (f"{local[:4]}-{local[4:6]}-{local[6:8]}", 0), (f"{local[:2]}.{local[2:4]}", 0), (f"19{local[:2]} 20{local[2:4]} 19{local[4:6]}", 0), (f"{local[:3]} {local[3:5]} {local[5:7]} {local[7:9]} {local[:3]}", 0)]


@dataclass
class Model:
    """Boosted trees as arrays (feature, threshold, left, right, value), and a threshold a kind."""

    trees: list[tuple[list[int], list[float], list[int], list[int], list[float]]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=lambda: [1.1] * len(KINDS))

    def score(self, x: list[float]) -> float:
        total = 0.0
        for (feature, threshold, left, right, value), w in zip(self.trees, self.weights, strict=True):
            at = 0
            while feature[at] >= 0:
                at = left[at] if x[feature[at]] <= threshold[at] else right[at]
            total += w * value[at]
        return 1.0 / (1.0 + math.exp(-2.0 * total))


def find(text: str, model: Model | None) -> list[tuple[int, int, int, bool]]:
    """All spans of a text, (start, kind number, end, is base), in order."""
    base = base_spans(text)
    out = [(*s, True) for s in base]
    if model is not None and model.trees:
        scored = []
        for a, kind, b in proposals(text, base):
            p = model.score(features(text, a, kind, b))
            if p >= model.thresholds[kind]:
                scored.append((-p, a, kind, b))
        starts: list[int] = []
        ends: list[int] = []
        for _, a, kind, b in sorted(scored):
            at = bisect_right(starts, a)
            if (not at or ends[at - 1] <= a) and (at == len(starts) or b <= starts[at]):
                starts.insert(at, a)
                ends.insert(at, b)
                out.append((a, kind, b, False))
    return sorted(out)


def examples(docs: DataFrame, text: str) -> DataFrame:
    """Labelled proposals of every document given: label, part (the held-out fifth is 0), kind,
    and the features."""
    schema = "label double, part int, kind int, x array<double>"

    def run(batch: pa.RecordBatch) -> dict:
        out: dict = {"label": [], "part": [], "kind": [], "x": []}

        def add(t, a, kind, b, label):
            out["label"].append(float(label))
            out["part"].append(zlib.crc32(t[max(0, a - WINDOW) : b + WINDOW].encode()) % 5)
            out["kind"].append(kind)
            out["x"].append(features(t, a, kind, b))

        for t in texts_of(batch, "_text"):
            base = base_spans(t)
            for a, kind, b in base:
                add(t, a, kind, b, 1)
                for s, label in rewritten(kind, t[a:b]):
                    lo = max(0, a - 2 * WINDOW)
                    add(t[lo:a] + s + t[b : b + 2 * WINDOW], a - lo, kind, a - lo + len(s), label)
            for a, kind, b in proposals(t, base):
                add(t, a, kind, b, 0)
        return out

    return map_arrow(docs.select(F.col(text).alias("_text")), run, schema, text="_text")


def held_out_counts(rows: DataFrame, model: Model) -> np.ndarray:
    """Counts of scored proposals by kind, label and score, in steps of 1 / SCORE_STEPS: scored and
    counted on the executors."""

    def run(batch: pa.RecordBatch) -> dict:
        step = [int(model.score(x) * SCORE_STEPS) for x in batch.column(2).to_pylist()]
        return {"label": batch.column(0), "kind": batch.column(1), "step": step}

    scored = map_arrow(rows.select("label", "kind", "x"), run, "label double, kind int, step int")
    counts = np.zeros((len(KINDS), 2, SCORE_STEPS + 1), dtype=np.int64)
    for r in scored.groupBy("kind", "label", "step").count().collect():
        counts[r["kind"], int(r["label"]), r["step"]] = r["count"]
    return counts


def bins(n: int) -> int:
    """So many bins that Spark takes the candidates for splits from all of ``n`` rows."""
    return LEAST_BINS if n <= SPLIT_ROWS else max(LEAST_BINS, math.isqrt(n - 1) + 1)


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text") -> Model:
    """Boosted trees from the proposals of all documents; the driver sees only the trees and counts
    of the held-out proposals' scores. Every row counts, whatever its ``id``."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    rows = examples(docs, text).persist()
    try:
        counts = {r["label"]: r["count"] for r in rows.filter("part <> 0").groupBy("label").count().collect()}
        if min(counts.get(0.0, 0), counts.get(1.0, 0)) < LEAST_EXAMPLES:
            return Model()
        ready = rows.select("label", "part", "kind", array_to_vector("x").alias("features"), "x")
        gbt = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.3, seed=7, maxBins=bins(sum(counts.values())))
        fitted = gbt.fit(ready.filter("part <> 0").select("label", "features"))
        model = Model(weights=[float(w) for w in fitted.treeWeights])
        for tree in fitted.trees:
            model.trees.append(_arrays(tree))
        counts = held_out_counts(rows.filter("part = 0"), model)
    finally:
        rows.unpersist()
    model.thresholds = [calibrated(counts[kind]) for kind in range(len(KINDS))]
    return model


def calibrated(counts: np.ndarray) -> float:
    """The least threshold from LEAST_THRESHOLD up that keeps PRECISION, from the counts of wrong
    and right proposals by score; beyond 1 if none does."""
    wrong, right = (np.cumsum(c[::-1])[::-1] for c in counts)
    for step in range(math.ceil(LEAST_THRESHOLD * SCORE_STEPS), SCORE_STEPS + 1):
        taken = wrong[step] + right[step]
        if taken and right[step] / taken >= PRECISION:
            return step / SCORE_STEPS
    return 1.1


def _arrays(tree) -> tuple:
    feature, threshold, left, right, value = [], [], [], [], []

    def walk(node) -> int:
        at = len(feature)
        for column, v in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (value, float(node.prediction()))):
            column.append(v)
        if node.subtreeDepth() > 0:
            feature[at], threshold[at] = int(node.split().featureIndex()), float(node.split().threshold())
            left[at] = walk(node.leftChild())
            right[at] = walk(node.rightChild())
        return at

    walk(tree._call_java("rootNode"))
    return feature, threshold, left, right, value


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def find_documents(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``; base counts a kind; the base spans' digest; all spans. No shuffle."""
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    schema = with_fields(docs, keep, f"{counts}, base_sha256 string, spans string, n_spans long")

    def run(batch: pa.RecordBatch) -> dict:
        out: dict = {f"n_{k}": [] for k in KINDS} | {"base_sha256": [], "spans": [], "n_spans": []}
        for t in texts_of(batch, "_text"):
            spans = find(t, model)
            base = [s[:3] for s in spans if s[3]]
            for number, kind in enumerate(KINDS):
                out[f"n_{kind}"].append(sum(s[1] == number for s in base))
            out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
            out["spans"].append(written([s[:3] for s in spans]))
            out["n_spans"].append(len(spans))
        return out | {c: batch.column(k) for k, c in enumerate(keep)}

    picked = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("_text"))
    return map_arrow(picked, run, schema, text="_text")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Spans become their kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for a, kind, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact_documents(docs: DataFrame, model: Model, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The same columns, with spans redacted and the count of characters brought up to date; a
    null text stays null. No shuffle."""
    names = docs.columns

    def run(batch: pa.RecordBatch) -> dict:
        out = {c: batch.column(k) for k, c in enumerate(names)}
        found = batch.column(names.index(text)).to_pylist()
        texts = [t if t is None else redact(t, [s[:3] for s in find(t, model)]) for t in found]
        out[text] = texts
        if n_chars in names:
            old = batch.column(names.index(n_chars)).to_pylist()
            out[n_chars] = [o if t is None else len(t) for t, o in zip(texts, old, strict=True)]
        return out

    return map_arrow(docs, run, docs.schema, text=text)
