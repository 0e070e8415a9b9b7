import hashlib
import random
import re
import time

import numpy as np
import pytest

from dyadica.llm import pii
from dyadica.llm.queries import op6_pii

# The exact patterns as they are stated.
STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, s):
    digits = "".join(re.findall("[0-9]", s))
    if kind == "ip":
        return all(int(p.lstrip("0") or 0) <= 255 for p in s.split("."))
    if kind == "card":
        total = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(digits[::-1]))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    out = []
    for number, kind in enumerate(pii.KINDS):
        out += [(m.start(), number, m.end()) for m in re.finditer(STATED[kind], text) if holds(kind, m.group())]
    return sorted(out)


def test_base_spans_of_random_texts():
    rng = random.Random(5)
    for alphabet in ("ab@.-+ 1_%é", "0123456789.. +()-", "4111 -12", "+1 (2).-34567890 ", "2501.39"):
        for _ in range(1500):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert pii.base_spans(t) == brute(t), t
    assert pii.base_spans("x 4111 1111 1111 1111, a.b@c.d.") == [(2, 2, 21), (23, 0, 30)]


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_model_takes_wider_forms_and_leaves_numbers(model):
    kinds = lambda t: [pii.KINDS[s[1]] for s in pii.find(t, model)]
    assert kinds("please call (743) 555-3824 today") == ["phone"]
    assert kinds("write bob.k [at] mail3.example [dot] com") == ["email"]
    assert kinds("from host 10[.]20[.]3[.]40 at noon") == ["ip"]
    for clean in ("on 2024-01-02 we met", "version 2.0.1 of it", "in 1999 2000 2001", "1,2,3,4 and so on", "no numbers here"):
        assert kinds(clean) == []


def test_query_agrees_with_brute_force_on_the_base(spark, sf, docs):
    got = {r.doc_id: r for r in op6_pii(spark, sf).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        spans, g = brute(r.text or ""), got[r.doc_id]
        stated = pii.written(spans)
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(s[1] == k for s in spans) for k in range(4)]
        assert g.base_sha256 == hashlib.sha256(stated.encode()).hexdigest()
        assert {*stated.split(",")} <= {*g.spans.split(",")} or not stated


def test_redaction(spark, model):
    assert pii.redact("a b@c.de f", [(2, 0, 8)]) == "a [EMAIL] f"
    assert pii.redact("0123456789", [(1, 2, 5), (3, 3, 7)]) == "0[CARD]789"
    df = spark.createDataFrame([(1, "mail b@c.de", 11), (2, None, 0), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.redact_documents(df, model).collect()}
    assert got == {1: ("mail [EMAIL]", 12), 2: (None, 0), 3: ("clean", 5)}


def test_edge_rows(edge, nothing):
    assert pii.fit(edge) == pii.Model() and pii.fit(nothing) == pii.Model()
    rows = pii.find_documents(edge, pii.Model(), ["doc_id"]).collect()
    assert len(rows) == edge.count() and all(r.spans == "" for r in rows)
    assert pii.find_documents(nothing, pii.Model(), ["doc_id"]).count() == 0
    assert pii.redact_documents(edge, pii.Model()).columns == edge.columns
    changed = pii.redact_documents(edge, pii.Model()).exceptAll(edge)
    assert [r.text for r in changed.collect()] == ["text of a null source and language"]  # its n_chars was null


def test_spelled_emails_need_no_other_word_in_the_text():
    for t in ("ask bob at example.org now", "ask bob [ at ] example.org now", "ask bob { AT }example.org now"):
        assert [t[a:b] for a, kind, b in pii.proposals(t, []) if kind == 0] == [t[4:-4]], t
    rng = random.Random(6)
    parts = [" ", " ", "\n", "at", "AT", "[at]", "( at )", "{at", "dot", ".", " dot ", "bob", "x.y", "b" * 70, "[", ")", "ſ", "é", " at "]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [m.span() for m in pii.spelled_emails(t)] == [m.span() for m in pii.WIDER["email"].finditer(t)], t


def test_zeros_long_runs_and_many_addresses(model):
    zeros = "0" * 5000
    assert pii.base_spans(zeros + "1.1.1.1") == [(0, 1, 5007)]
    assert pii.base_spans("9" * 5000 + ".1.1.1 " + zeros + "." + zeros + ".1.255") == [(5007, 1, 15014)]
    start = time.monotonic()
    digits = "".join(random.Random(7).choice("0123456789") for _ in range(1_000_000))
    assert pii.base_spans(digits) == [] and pii.find("+" + digits + ".", model) == []
    many = " ".join(f"10.0.{k % 256}.{k // 256} x{k}@y.org call (743) 555-{k % 10000:04d}," for k in range(20_000))
    spans = pii.find(many, model)
    assert sum(s[1] == 1 and s[3] for s in spans) == 20_000 and sum(s[1] == 0 for s in spans) == 20_000
    taken = [s for s in spans if not s[3]]
    assert all(a[2] <= b[0] for a, b in zip(taken, taken[1:]))
    assert time.monotonic() - start < 60


def test_overlaps_by_brute_force(model):
    rng = random.Random(8)
    parts = ["1.2.3.4", " ", "a@b.cd", "+1 234 567 8901", "(743) 555-3824", "4111 1111 1111 1111", "10[.]2[.]3[.]4", "bob at x.org", "-", "."]
    for _ in range(300):
        t = "".join(rng.choice(parts) for _ in range(8))
        base = pii.base_spans(t)
        free = lambda a, b: not any(a < e and s < b for s, _, e in base)
        assert all(free(a, b) for a, _, b in pii.proposals(t, base))
        scored = sorted(
            (-model.score(pii.features(t, a, k, b)), a, k, b) for a, k, b in pii.proposals(t, base)
        )
        taken = []
        for p, a, k, b in scored:
            if -p >= model.thresholds[k] and all(b <= s or e <= a for s, _, e in taken):
                taken.append((a, k, b))
        assert [s[:3] for s in pii.find(t, model) if not s[3]] == sorted(taken)


def test_thresholds_from_counts():
    counts = np.zeros((2, pii.SCORE_STEPS + 1), dtype=int)
    assert pii.calibrated(counts) == 1.1
    counts[1, 950], counts[0, 920], counts[0, 100] = 98, 3, 500
    assert pii.calibrated(counts) == 0.921
    counts[0, 920] = 2
    assert pii.calibrated(counts) == 0.9


def test_spelled_addresses_of_many_labels():
    t = "ask bob at a.b.c.d.e.f.g.h.org now"
    assert [t[a:b] for a, kind, b in pii.proposals(t, []) if kind == 0] == [t[4:-4]]


def test_model_and_thresholds_come_from_every_document(spark, monkeypatch):
    rows = [(k, f"write u{k}@x{k % 7}.org or call +1 555 010 {1000 + k}, see 1{k % 10}.2.3.4 and {k} {2 * k} {1000 + k}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(pii, "SAMPLE_DOCUMENTS", 10, raising=False)
    counted, plain = [], pii.held_out_counts
    monkeypatch.setattr(pii, "held_out_counts", lambda rows, model: counted.append(plain(rows, model)) or counted[0])
    assert pii.fit(docs).trees
    every = pii.examples(docs, "text")
    assert counted[0].sum() == every.filter("part = 0").count() > 100


def test_splits_are_chosen_among_all_proposals(spark, monkeypatch):
    """Spark samples the square of the bins, or 10,000 rows if that is more; here 100 stand for them."""
    from pyspark.ml.classification import GBTClassifier

    used, plain = [], GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, rows: used.append(self.getMaxBins()) or plain(self, rows))
    monkeypatch.setattr(pii, "SPLIT_ROWS", 100, raising=False)
    rows = [(k, f"write u{k}@x{k % 7}.org or call +1 555 010 {1000 + k}, see 1{k % 10}.2.3.4 and {k} {2 * k} {1000 + k}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert pii.fit(docs).trees
    n = pii.examples(docs, "text").filter("part <> 0").count()
    assert used[0] ** 2 >= n > 32 ** 2
