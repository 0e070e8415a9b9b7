"""Byte-level BPE by the tiktoken library, from a local file of ranks.

Long texts are cut before they are encoded, at places where no match of the split pattern can
reach across: after a letter before anything else, after a digit before anything else, and before
white space. A match holds letters, or digits, only at its end, white space only at its start or
alone, and looks no further than behind white space; so the matches on both sides of such a
place are those of the whole text, and a cut after at least CHUNK_CHARS bounds the work of one call.
A very long run of white space, on which the library's pattern engine gives up, is encoded as the
one match that it is: the run less its last character where more text follows, else all of it.

Decoding joins the tokens' bytes; they need not be valid text, as tokens may end within a letter.

Rows: a null or empty text gives no ids and no bytes; texts of any length are taken whole; repeated
rows give repeated results; other columns are carried or left out as asked, and cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from dyadica.llm.common import map_arrow, texts_of, with_fields

# Texts longer than this are cut, and runs of white space from RUN_CHARS on are taken out.
CHUNK_CHARS, RUN_CHARS = 100_000, 20_000
SAFE = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=\P{White_Space})(?=\p{White_Space})")


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks, one base64 token and one number a line."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


class RankEncoder:
    def __init__(self, path: str, pattern: str):
        import tiktoken

        self.coding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, its special tokens taken as plain text."""
        if len(text) <= CHUNK_CHARS:
            return self.coding.encode_ordinary(text)
        ids: list[int] = []
        for part, is_run in cut(text):
            ids += self.coding._encode_single_piece(part) if is_run else self.coding.encode_ordinary(part)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.coding.decode_bytes(ids)


def cut(text: str) -> Iterator[tuple[str, bool]]:
    """Parts of a text that are encoded each by itself, and whether a part is one match of white
    space."""
    at = 0
    for m in regex.finditer(rf"\p{{White_Space}}{{{RUN_CHARS},}}", text):
        # A run after a run's last character cannot be: runs are whole.
        stop = m.end() if m.end() == len(text) else m.end() - 1
        yield from ((part, False) for part in chunks(text, at, m.start()))
        yield text[m.start() : stop], True
        at = stop
    yield from ((part, False) for part in chunks(text, at, len(text)))


def chunks(text: str, start: int, stop: int) -> Iterator[str]:
    """Stretches of at least CHUNK_CHARS between safe places; the last may be shorter."""
    while start < stop:
        m = SAFE.search(text, start + CHUNK_CHARS, stop) if stop - start > CHUNK_CHARS else None
        end = m.start() if m else stop
        yield text[start:end]
        start = end


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> RankEncoder:
    """One encoder a Python worker."""
    return RankEncoder(path, pattern)


def forget_encoder() -> None:
    encoder.cache_clear()


def encode_documents(
    docs: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text",
    ids: bool = True, decoded: bool = True,
) -> DataFrame:
    """Encode and decode every text by the ranks in ``path`` and the split ``pattern``.

    Columns: ``keep``, then ``ids`` (array of int) and ``decoded`` (binary) if wanted, ``n_tokens``,
    ``ids_sha256`` (of ids as little-endian unsigned 32-bit integers) and ``decoded_sha256``. No
    shuffle. Each Python worker reads the rank file from where ``path`` points on its machine.
    """
    extra = ("ids array<int>, " if ids else "") + ("decoded binary, " if decoded else "")
    schema = with_fields(docs, keep, f"{extra}n_tokens long, ids_sha256 string, decoded_sha256 string")

    def run(batch: pa.RecordBatch) -> dict:
        enc = encoder(path, pattern)
        out: dict = {n: [] for n in ("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")}
        for t in texts_of(batch, "_text"):
            coded = enc.encode(t)
            numbers, back = np.array(coded, dtype="<u4"), enc.decode(coded)
            out["n_tokens"].append(len(coded))
            out["ids_sha256"].append(hashlib.sha256(numbers.tobytes()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
            if ids:
                out["ids"].append(numbers.astype(np.int32))
            if decoded:
                out["decoded"].append(back)
        return out | {c: batch.column(k) for k, c in enumerate(keep)}

    picked = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("_text"))
    return map_arrow(picked, run, schema, release=forget_encoder, text="_text")
