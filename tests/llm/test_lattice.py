import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadica.llm import lattice as L
from dyadica.llm.queries import op7_lattice, tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
WORDS = ["the", "therhean", "é", "中文字", "🎉a", "x" * 40, "a▁b", "retitioning", "z", "ﬁ́"]


@pytest.fixture(scope="module")
def vocab():
    return L.vocabulary(PATH)


@pytest.fixture(scope="module")
def logp(vocab):
    with np.errstate(divide="ignore"):
        return np.log(vocab.prior)


def marginal(word, vocab, logp):
    """All segmentations of the marked word, one place after the other, in plain Python."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    known = {sp.id_to_piece(int(i)): int(i) for i in vocab.ids}
    s = L.MARK + word
    sums = [0.0] + [-math.inf] * len(s)
    for j in range(1, len(s) + 1):
        terms = [sums[j - 1] + sum(logp[vocab.byte[b]] for b in s[j - 1].encode())]
        for i in range(max(0, j - vocab.longest), j):
            piece = s[i:j]
            if piece in known and (i == 0 or L.MARK not in piece):
                terms.append(sums[i] + logp[known[piece]])
        top = max(terms)
        sums[j] = top + math.log(sum(math.exp(t - top) for t in terms))
    return sums[-1]


def test_marginal_over_all_segmentations(vocab, logp):
    got = L.word_log_probability(WORDS, vocab, logp)
    assert got == pytest.approx([marginal(w, vocab, logp) for w in WORDS], rel=1e-12)


def test_expected_use_is_the_gradient(vocab, logp):
    used = np.zeros(len(logp))
    for at, lattice in L.lattices(WORDS, vocab, logp):
        used += lattice.expected(logp, np.ones(len(at)))
    base = L.word_log_probability(WORDS, vocab, logp).sum()
    for piece in np.argsort(-used)[:12].tolist() + [int(vocab.byte[0xE2])]:
        more = logp.copy()
        more[piece] += 1e-6
        assert (L.word_log_probability(WORDS, vocab, more).sum() - base) / 1e-6 == pytest.approx(used[piece], abs=1e-3)


def test_rounds_of_fitting_raise_the_likelihood(spark, vocab, logp):
    words = {"the": 50, "therhean": 4, "anthe": 9, "zq": 1}
    df = spark.createDataFrame([(w.encode(), c) for w, c in words.items()], "word binary, c long")
    fitted = L.fit_pieces(df, 5, PATH)
    assert np.exp(fitted).sum() == pytest.approx(1.0)
    weight = np.array(list(words.values()))
    assert weight @ L.word_log_probability(list(words), vocab, fitted) > weight @ L.word_log_probability(list(words), vocab, logp)


def base(texts, train):
    tokens = []
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        tokens.append(re.findall(r"[^\x20\x09-\x0D]+", low) + [None])
    counts = Counter(x for t, yes in zip(tokens, train, strict=True) if yes for x in t)
    n, v = sum(counts.values()), len(counts)
    return [
        (len(t), sum(counts[x] > 0 for x in t), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t)) for t in tokens
    ]


def agree(got, want):
    assert got[:3] == want[:3] and got[3] == pytest.approx(want[3], rel=1e-9)


@pytest.mark.parametrize("frequent", [L.FREQUENT_WORDS, 50])
def test_query_agrees_with_brute_force_on_the_base(spark, sf, docs, monkeypatch, frequent):
    monkeypatch.setattr(L, "FREQUENT_WORDS", frequent)
    rows = docs.collect()
    want = base([r.text for r in rows], [zlib.crc32(str(r.doc_id).encode()) % 7 != 2 for r in rows])
    got = {r.doc_id: r for r in op7_lattice(spark, sf).collect()}
    for r, w in zip(rows, want, strict=True):
        g = got[r.doc_id]
        agree((g.n_tokens, g.n_known, g.train_tokens, g.base_score), w)
        assert g.score < 0 and g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)


def test_edge_rows(edge, nothing):
    rows = edge.collect()
    train = [r.doc_id is not None and r.doc_id % 2 == 0 for r in rows]
    want = sorted(zip([r.doc_id or -1 for r in rows], base([r.text for r in rows], train), strict=True))
    got = L.score_documents(edge, PATH, F.col("doc_id") % 2 == 0, ["doc_id"]).collect()
    got = sorted(((g.doc_id or -1), (g.n_tokens, g.n_known, g.train_tokens, g.base_score)) for g in got)
    assert len(got) == len(want)
    for (i, g), (j, w) in zip(got, want, strict=True):
        assert i == j
        agree(g, w)
    assert L.score_documents(nothing, PATH, F.lit(True), ["doc_id"]).count() == 0
    untrained = L.score_documents(edge, PATH, F.lit(False), ["doc_id"]).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in untrained)


@pytest.mark.parametrize("block", [7, 40, 1000])
def test_long_words_in_blocks(vocab, logp, monkeypatch, block):
    rng = random.Random(11)
    words = ["".join(rng.choice(["the", "a", "é", "中", "re", "▁", "z", "tion"]) for _ in range(60)) for _ in range(4)] + WORDS
    counts = np.arange(1.0, len(words) + 1)
    plain, used = L.word_log_probability(words, vocab, logp), np.zeros(len(logp))
    for at, lattice in L.lattices(words, vocab, logp):
        used += lattice.expected(logp, counts[at])
    monkeypatch.setattr(L, "LONG_LETTERS", 1)
    monkeypatch.setattr(L, "BLOCK_LETTERS", block)
    assert L.word_log_probability(words, vocab, logp) == pytest.approx(plain, rel=1e-12)
    again = np.zeros(len(logp))
    for at, lattice in L.lattices(words, vocab, logp):
        assert isinstance(lattice, L.LongLattice)
        again += lattice.expected(logp, counts[at])
    assert again == pytest.approx(used, rel=1e-9, abs=1e-12)


def test_a_word_of_two_million_letters(vocab, logp):
    rng = random.Random(12)
    word = "".join(rng.choice("etaoinshrdlu0123") for _ in range(2_000_000))
    start = time.monotonic()
    whole = L.word_log_probability([word], vocab, logp)[0]
    assert whole < 0 and time.monotonic() - start < 90
