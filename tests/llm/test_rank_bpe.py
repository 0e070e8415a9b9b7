import hashlib
import random
import time

import numpy as np
import pytest

from dyadica.llm import rank_bpe as R
from dyadica.llm.queries import op13_tiktoken, split_pattern, tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    return R.RankEncoder(PATH, split_pattern())


def merged(piece, ranks):
    """BPE by its definition: the pair of least rank, leftmost first, until none is left."""
    parts = [bytes([b]) for b in piece]
    while True:
        found = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        k = min(found)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_library_agrees_with_the_definition(own):
    import regex

    ranks = R.read_ranks(PATH)

    rng = random.Random(1)
    letters = list("abe th'sllre \n\t\x1c\x85\xa0éß0123.,!?-_ÄÄ") + ["中文", "🎉", "<|endoftext|>", "​", "\x00", "'s", "n't"]
    for _ in range(300):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        # The class of other characters, spelled with the property, needs its own form.
        pieces = regex.findall(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
            r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+", t)
        assert "".join(pieces) == t
        assert own.encode(t) == [i for p in pieces for i in merged(p.encode(), ranks)]
        assert own.decode(own.encode(t)) == t.encode()



@pytest.mark.parametrize("chunk, run", [(1, 3), (7, 2), (40, 5)])
def test_cuts_change_nothing(own, monkeypatch, chunk, run):
    rng = random.Random(2)
    letters = list("ab'sllret  \n\n\t\x85\xa0é019.,!?'’́") + ["'s", "'re", "   ", "中", "x'd", "٣", "²", "   "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 120))) for _ in range(1500)]
    whole = [own.coding.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(R, "CHUNK_CHARS", chunk)
    monkeypatch.setattr(R, "RUN_CHARS", run)
    parts = 0
    for t, ids in zip(texts, whole):
        assert own.encode(t) == ids, t
        assert "".join(p for p, _ in R.cut(t)) == t
        parts += sum(1 for _ in R.cut(t))
    assert parts > 3 * len(texts)


@pytest.mark.parametrize("tail", ["", "x", " x", "\n", "\nx"])
@pytest.mark.parametrize("unit", [" ", "\n ", "\xa0"])
def test_runs_on_which_the_library_gives_up(own, unit, tail):
    long = "start" + unit * 1_200_000 + tail
    with pytest.raises(BaseException, match="StackOverflow"):
        own.coding.encode_ordinary(long)
    assert own.decode(own.encode(long)) == long.encode()
    # A shorter run that the library does take, cut and whole.
    short = "start" + unit * 60_000 + tail
    assert own.encode(short) == own.coding.encode_ordinary(short)


def test_very_long_texts_in_linear_time(own):
    start = time.monotonic()
    rng = random.Random(3)
    for t in ("x" * 2_000_000, "".join(rng.choices("abcdefgh", k=2_000_000)), "ab 1. " * 500_000, "^" * 1_000_000):
        assert own.decode(own.encode(t)) == t.encode()
    assert time.monotonic() - start < 60


def test_edge_rows(edge, nothing, own):
    docs = edge.withColumnRenamed("label", "decoded_sha256").withColumnRenamed("h", "n_tokens")
    rows = R.encode_documents(docs.select("doc_id", "text", "ids", "copies"), PATH, split_pattern(), ["doc_id", "copies"]).collect()
    texts = {r.doc_id: r.text or "" for r in edge.collect()}
    assert len(rows) == edge.count()
    for r in rows:
        ids = own.coding.encode_ordinary(texts[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids) and bytes(r.decoded) == texts[r.doc_id].encode()
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert R.encode_documents(docs, PATH, split_pattern(), ["doc_id"], ids=False, decoded=False).columns == [
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert R.encode_documents(nothing, PATH, split_pattern(), ["doc_id"]).count() == 0


def test_query_agrees_on_every_document(spark):
    import base64

    import public_tokenizers
    import tiktoken

    lines = open(PATH, "rb").read().split(b"\n")
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op13_tiktoken(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode_ordinary(r.text or "")
        digest = hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        back = hashlib.sha256(library.decode_bytes(ids)).hexdigest()
        g = got[r.doc_id]
        assert (g.n_tokens, g.ids_sha256, g.decoded_sha256) == (len(ids), digest, back)
