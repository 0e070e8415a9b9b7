import hashlib
import random

import numpy as np
import pytest

from dyadica.llm.bpe import Encoder, TokenAutomaton, encode_documents
from dyadica.llm.queries import op5_bpe, tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return Encoder(PATH)


def test_random_texts_agree_with_the_library(library, own):
    rng = random.Random(1)
    letters = list("abe th'sllrevm \n\t\x1c\x85\xa0éßñ0123.,!?-_ÄÄ") + ["中文", "🎉", "<|endoftext|>", "​", "\x00"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    texts += ["a" * 3000, " " * 3000, "=-" * 2000, "<|endoftext|>" * 3, "\n" * 500, "the " * 300]
    for t, ids in zip(texts, own.encode_all(texts)):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids
        assert own.encode(t).tolist() == ids.tolist()
        assert own.decode(ids) == t


def test_full_step_table_and_small_chunks(library, monkeypatch):
    monkeypatch.setattr("dyadica.llm.bpe.STEPS_KEPT", 300)
    monkeypatch.setattr("dyadica.llm.bpe.WORK_BYTES", 200)
    own = Encoder(PATH)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefgh é中") for _ in range(rng.randint(1, 300))) for _ in range(50)]
    texts.append("".join(rng.choice("abcdefgh") for _ in range(5000)))
    for t, ids in zip(texts, own.encode_all(texts)):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids


def literal_arcs(letters, merges):
    """The merge gadgets carried out one after the other on whole sets of arcs."""
    goes = {None: set(letters)} | {c: set(letters) for c in letters}
    for u, v in merges:
        if u not in goes or v not in goes[u]:
            continue
        w = u + v
        if w not in goes:
            goes[w] = set(goes[v])
        goes[u].discard(v)
        for arcs in goes.values():
            if u in arcs:
                arcs.add(w)
    return goes


def merged(word, merges):
    """BPE by its definition: all places of one merge after the other, from the left."""
    parts = list(word)
    for u, v in merges:
        k, out = 0, []
        while k < len(parts):
            both = parts[k : k + 2] == [u, v]
            out.append(u + v if both else parts[k])
            k += 2 if both else 1
        parts = out
    return parts


def test_compiled_arcs_are_those_of_the_gadgets():
    rng = random.Random(3)
    for _ in range(60):
        tokens, merges = list("abc"), []
        while len(merges) < 12:
            u, v = rng.choice(tokens), rng.choice(tokens)
            if u + v not in tokens and len(u + v) < 9:
                tokens.append(u + v)
                merges.append((u, v))
        vocab = {t: k for k, t in enumerate(tokens)}
        own = TokenAutomaton(vocab, merges, {})
        goes = literal_arcs("abc", merges)
        for u in goes:
            for v in tokens:
                if u is not None and v in goes:
                    assert own.arc(vocab[u], vocab[v]) == (v in goes[u]), (merges, u, v)
        for _ in range(40):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
            assert [tokens[i] for i in own.encode_word(word.encode())] == merged(word, merges)


def test_repeated_letter_merge():
    vocab = {"a": 0, "b": 1, "aa": 2, "aaa": 3, "ab": 4}
    own = TokenAutomaton(vocab, [("a", "a"), ("aa", "a"), ("a", "b")], {})
    assert own.encode_word(b"aaaa") == [2, 2]
    assert own.encode_word(b"aab") == [2, 1]
    assert own.encode_word(b"ab") == [4]


def test_merge_of_an_unreachable_pair_makes_no_token():
    # "ab" takes every a before a b, so the pair (a, bc) never stands in a tokenization.
    vocab = {"a": 0, "b": 1, "c": 2, "ab": 3, "bc": 4, "abc": 5}
    own = TokenAutomaton(vocab, [("a", "b"), ("b", "c"), ("a", "bc")], {})
    assert own.encode_word(b"abc") == [3, 2]
    assert not own.carried[5]


def test_edge_rows(edge, nothing, library):
    rows = encode_documents(edge, PATH, ["doc_id"]).join(edge.select("doc_id", "text").distinct(), "doc_id").collect()
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == (r.text or "")
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert encode_documents(edge, PATH, ["doc_id"]).count() == edge.count()
    assert encode_documents(nothing, PATH, ["doc_id"]).count() == 0


def test_query_agrees_on_every_document(spark, library):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op5_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        digest = hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256) == (len(ids), digest)
        back = library.decode(ids, skip_special_tokens=False)
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_a_word_of_a_million_letters(library, own):
    rng = random.Random(4)
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000))
    assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
