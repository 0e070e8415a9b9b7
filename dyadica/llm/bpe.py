"""Byte-level BPE by a tokenization automaton.

The merge list is compiled into a deterministic automaton over tokens, one merge gadget after
the other. At the start every byte token may follow every other. The gadget of a merge
``u v -> w`` gives the state reached by ``u`` a copy without the arc ``v``, lets ``u`` lead
there, and adds the arc ``w`` wherever ``u`` was, leading to where ``v`` leads. All arcs of one
token lead to one state, so a state is named by its token; what a state lost is kept per gadget,
and a copy shares what it inherits. The automaton accepts exactly the token strings that BPE
makes, so the encoding of a word is its only accepted path over the bytes.

For encoding, arcs are read byte by byte and the automaton is made deterministic over bytes: a
row of the step table is made when it is first asked for. A word takes one table step a byte, and
each state names the token that ends there, so the path is read off from the end of the word.

Rows: a null or empty text gives no ids and empty text; texts of any length are taken whole;
repeated rows give repeated results; other columns are carried or left out as asked.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from dyadica.llm.common import CHUNK_BYTES, map_arrow, texts_of, with_fields

# The split pattern of the byte-level pre-tokenizer, with Unicode white space.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
# Slots of the step table, and the entries after which it is emptied and filled anew. Words are
# taken together in chunks of WORK_BYTES, so that a chunk cannot overfill it; words over
# WORD_BYTES go alone.
SLOTS, STEPS_KEPT = 1 << 20, 600_000
WORK_BYTES, WORD_BYTES = 1 << 18, 64
NEVER, NONE = 1 << 60, -1
ID_BITS = 24


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    return letters | {chr(256 + k): b for k, b in enumerate(rest)}


class TokenAutomaton:
    """Arcs over tokens compiled from a vocabulary and its merges in order, and the table of byte
    steps that follows from them."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        letters = byte_letters()
        self.label = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.special = special
        self.label |= {i: t.encode() for t, i in special.items()}
        top = max(self.label, default=0) + 1
        # Per token that arcs carry: the pair and the gadget that made it. A byte has none.
        self.left, self.right = array("i", [NONE] * top), array("i", [NONE] * top)
        self.born = array("i", [NONE] * top)
        self.carried = bytearray(top)
        # The gadget that took the arc of the second token from the state of the first.
        self.lost: dict[int, int] = {}
        for i, t in self.label.items():
            if len(t) == 1 and i not in special.values():
                self.carried[i] = 1
        for at, (a, b) in enumerate(merges):
            self._gadget(vocab[a], vocab[b], vocab[a + b], at)
        self._grow_trie()
        sizes = np.zeros(top, dtype=np.int64)
        for i, t in self.label.items():
            sizes[i] = len(t)
        self.sizes, self.offsets = sizes, np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.letters = np.frombuffer(b"".join(self.label.get(i, b"") for i in range(top)), dtype=np.uint8)
        # The step table: open hashing of (state, byte) to the next state.
        self.keys, self.values = array("q", bytes(8 * SLOTS)), array("i", bytes(4 * SLOTS))
        self.ends, self.nodes, self.held = array("i"), array("i"), []
        self.numbers: dict[tuple, int] = {}
        self.forget()

    # ------------------------------------------------------------------ arcs

    def _gadget(self, u: int, v: int, w: int, at: int) -> None:
        if not (self.carried[u] and self.carried[v] and self.arc(u, v)):
            return  # the pair never stands in a tokenization, so the merge never applies
        if not self.carried[w]:
            self.carried[w] = 1
            self.left[w], self.right[w], self.born[w] = u, v, at
        self.lost.setdefault(u << ID_BITS | v, at)

    def arc(self, state: int, token: int) -> bool:
        """Whether the arc ``token`` leaves the state reached by the token ``state``.

        The state began as a copy of that of its right part, made by the gadget that made it, and
        the arc was laid beside that of its left part; both go back so to bytes.
        """
        lost, left, born = self.lost, self.left, self.born
        copied = NEVER
        while state != NONE:
            part, used = token, NEVER
            while part != NONE:
                at = lost.get(state << ID_BITS | part)
                if at is not None and at < copied and at <= used:
                    return False
                used, part = min(used, born[part]), left[part]
            copied, state = min(copied, born[state]), self.right[state]
        return True

    # ------------------------------------------------------------ byte steps

    def _grow_trie(self) -> None:
        """A trie of all labels, each node linked to its longest suffix that is a node too."""
        self.edge: dict[int, int] = {}
        self.token, self.depth = array("i", [NONE]), array("i", [0])
        for i, t in self.label.items():
            if not self.carried[i]:
                continue
            node = 0
            for byte in t:
                to = self.edge.get(node << 8 | byte)
                if to is None:
                    to = self.edge[node << 8 | byte] = len(self.token)
                    self.token.append(NONE)
                    self.depth.append(self.depth[node] + 1)
                node = to
            self.token[node] = i
        self.suffix = array("i", bytes(4 * len(self.token)))
        for key in sorted(self.edge, key=lambda k: self.depth[k >> 8]):
            node, byte = key >> 8, key & 255
            if node:
                self.suffix[self.edge[key]] = self._follow(self.suffix[node], byte)

    def _follow(self, node: int, byte: int) -> int:
        while (to := self.edge.get(node << 8 | byte)) is None and node:
            node = self.suffix[node]
        return to or 0

    def forget(self) -> None:
        """Drop all rows of the step table but the start's."""
        np.frombuffer(self.keys, dtype=np.int64)[:] = NONE
        self.steps = 0
        self.numbers.clear()
        del self.ends[:], self.nodes[:], self.held[:]
        self._number(0, NONE, ())

    def _number(self, node: int, end: int, held: tuple[int, ...]) -> int:
        key = (node, end, held)
        state = self.numbers.get(key)
        if state is None:
            state = self.numbers[key] = len(self.nodes)
            self.nodes.append(node)
            self.ends.append(end)
            self.held.append(held)
        return state

    def _row(self, state: int, byte: int) -> int:
        """Make one entry of the step table.

        A state of bytes is the set of states of the token automaton that a prefix can be in: the
        token that ends here, and, for every suffix that may grow into a token, the token that
        ended where the suffix begins. Exactly one accepted path ends at each place.
        """
        node, end, held = self.nodes[state], self.ends[state], self.held[state]
        depth, suffix = self.depth, self.suffix
        before, at = {0: end}, node
        for token in held:
            before[depth[at]] = token
            at = suffix[at]
        to = at = self._follow(node, byte)
        found, kept = NONE, []
        while at:
            last, token = before[depth[at] - 1], self.token[at]
            if found == NONE and token != NONE and (last == NONE or self.arc(last, token)):
                found = token
            kept.append(last)
            at = suffix[at]
        if found == NONE:
            raise ValueError(f"byte {byte} is not in the vocabulary")
        new = self._number(to, found, tuple(kept))
        slot = _slot(state << 8 | byte)
        while self.keys[slot] != NONE:
            slot = (slot + 1) % SLOTS
        self.keys[slot], self.values[slot] = state << 8 | byte, new
        self.steps += 1
        return new

    def _next(self, state: int, byte: int) -> int:
        key = state << 8 | byte
        slot = _slot(key)
        while (found := self.keys[slot]) != key:
            if found == NONE:
                return self._row(state, byte)
            slot = (slot + 1) % SLOTS
        return self.values[slot]

    def _next_of_all(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The next state of every word, its table entries made where they are missing."""
        wanted = states << 8 | letters
        keys, values = np.frombuffer(self.keys, dtype=np.int64), np.frombuffer(self.values, dtype=np.int32)
        slots = _slot(wanted)
        out = values[slots].astype(np.int64)
        open_ = np.flatnonzero(keys[slots] != wanted)
        while len(open_):
            missing = keys[slots[open_]] == NONE
            if missing.any():
                asked, back = np.unique(wanted[open_[missing]], return_inverse=True)
                made = [self._next(key >> 8, key & 255) for key in asked.tolist()]
                out[open_[missing]] = np.array(made, dtype=np.int64)[back]
                open_ = open_[~missing]
            slots[open_] = (slots[open_] + 1) % SLOTS
            hit = keys[slots[open_]] == wanted[open_]
            out[open_[hit]] = values[slots[open_[hit]]]
            open_ = open_[~hit]
        return out

    def encode_word(self, word: bytes) -> list[int]:
        """One step a byte, then the accepted path read from its end."""
        state, last = 0, array("i")
        for byte in word:
            if self.steps >= STEPS_KEPT:
                here = self.nodes[state], self.ends[state], self.held[state]
                self.forget()
                state = self._number(*here)
            state = self._next(state, byte)
            last.append(self.ends[state])
        path, at = [], len(word)
        while at:
            token = last[at - 1]
            path.append(token)
            at -= len(self.label[token])
        path.reverse()
        return path

    def encode_words(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The ids of adjoining words, which begin at ``starts`` and fill ``data``: all words take
        their steps together. Long words go alone."""
        sizes = np.diff(np.append(starts, len(data)))
        tokens = np.full(len(data), NONE, dtype=np.int32)
        for k in np.flatnonzero(sizes > WORD_BYTES).tolist():
            at = int(starts[k])
            for token in self.encode_word(data[at : at + int(sizes[k])].tobytes()):
                tokens[at] = token
                at += len(self.label[token])
        if self.steps + len(data) > STEPS_KEPT:
            self.forget()
        order = np.argsort(-sizes, kind="stable")
        order = order[np.searchsorted(-sizes[order], -WORD_BYTES) :]
        at, left = starts[order], sizes[order]
        last = np.empty(len(data), dtype=np.int32)
        states = np.zeros(len(order), dtype=np.int64)
        for k in range(int(left[0]) if len(left) else 0):
            alive = np.searchsorted(-left, -k)
            states = self._next_of_all(states[:alive], data[at[:alive] + k].astype(np.int64))
            last[at[:alive] + k] = np.frombuffer(self.ends, dtype=np.int32)[states]
        while len(at):
            token = last[at + left - 1]
            left = left - self.sizes[token]
            tokens[at + left] = token
            at, left = at[left > 0], left[left > 0]
        return tokens[tokens != NONE]

    def decode(self, ids: np.ndarray) -> bytes:
        """The labels of the arcs, one after the other."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        places = np.repeat(self.offsets[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ids) else 0)
        return self.letters[places].tobytes()


def _slot(key):
    """Where a (state, byte) number, or each of an array, is first looked for."""
    return (key ^ key >> 15) * 40503 % SLOTS


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.automaton = TokenAutomaton(vocab, merges, special)
        self.split = regex.compile(SPLIT)
        by_length = sorted(special, key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, by_length))) if special else None

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        if self.specials is None or not (found := list(self.specials.finditer(text))):
            return self._encode_plain(text)
        out, at = [], 0
        for m in found:
            out += [self._encode_plain(text[at : m.start()]), np.array([self.automaton.special[m[0]]], dtype="<u4")]
            at = m.end()
        return np.concatenate(out + [self._encode_plain(text[at:])])

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; texts without special tokens are taken together."""
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = []
        for k, text in enumerate(texts):
            if self.specials is not None and self.specials.search(text):
                out[k] = self.encode(text)
            else:
                plain.append(k)
        cuts = [self._cut(texts[k]) for k in plain]
        ids = self._encode_cuts([c for c in cuts if len(c[0])])
        for k, (data, _) in zip(plain, cuts):
            out[k] = ids.pop(0) if len(data) else np.empty(0, dtype="<u4")
        return out

    def _encode_plain(self, text: str) -> np.ndarray:
        data, starts = self._cut(text)
        return self._encode_cuts([(data, starts)])[0] if len(data) else np.empty(0, dtype="<u4")

    def _cut(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of a text, and where its words begin."""
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        if len(text) <= CHUNK_BYTES:
            ends = np.cumsum(np.fromiter(map(len, self.split.findall(text)), dtype=np.int64))
        else:
            ends = np.fromiter((m.end() for m in self.split.finditer(text)), dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        if len(data) != len(text):
            points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
            widths = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
            starts = (np.cumsum(widths) - widths)[starts]
        return data, starts

    def _encode_cuts(self, cuts: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """Ids of texts that are not empty. Words are encoded in chunks of bounded size; every
        text begins a word, so no chunk's words are torn."""
        sizes = np.array([len(d) for d, _ in cuts], dtype=np.int64)
        ends = np.cumsum(sizes)
        if not len(cuts):
            return []
        data = np.concatenate([d for d, _ in cuts])
        starts = np.concatenate([s + off for (_, s), off in zip(cuts, ends - sizes)])
        tokens, lengths, first = [], [], 0
        while first < len(starts):
            at = starts[first]
            last = max(first + 1, int(np.searchsorted(starts, at + WORK_BYTES)))
            stop = starts[last] if last < len(starts) else len(data)
            tokens.append(self.automaton.encode_words(data[at:stop], starts[first:last] - at))
            first = last
        ids = np.concatenate(tokens)
        places = np.cumsum(self.automaton.sizes[ids])
        return np.split(ids.astype("<u4"), np.searchsorted(places, ends[:-1], side="right"))

    def decode(self, ids: np.ndarray) -> str:
        return self.automaton.decode(ids).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a Python worker."""
    return Encoder(path)


def forget_encoder() -> None:
    encoder.cache_clear()


def encode_documents(
    docs: DataFrame, path: str, keep: list[str], text: str = "text", ids: bool = True, decoded: bool = True
) -> DataFrame:
    """Encode and decode every text.

    Columns: ``keep``, then ``ids`` (array of int, if wanted), ``n_tokens``, ``ids_sha256``,
    ``decoded`` (if wanted) and ``decoded_sha256``. No shuffle. The vocabulary file is
    read by each Python worker from the installed package.
    """
    extra = ("ids array<int>, " if ids else "") + ("decoded string, " if decoded else "")
    schema = with_fields(docs, keep, f"{extra}n_tokens long, ids_sha256 string, decoded_sha256 string")

    def run(batch: pa.RecordBatch) -> dict:
        enc = encoder(path)
        coded = enc.encode_all(texts_of(batch, "_text"))
        back = [enc.decode(c) for c in coded]
        out = {c: batch.column(k) for k, c in enumerate(keep)}
        out["n_tokens"] = [len(c) for c in coded]
        out["ids_sha256"] = [hashlib.sha256(c.tobytes()).hexdigest() for c in coded]
        out["decoded_sha256"] = [hashlib.sha256(t.encode()).hexdigest() for t in back]
        if ids:
            out["ids"] = [c.astype(np.int32) for c in coded]
        if decoded:
            out["decoded"] = back
        return out

    picked = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("_text"))
    return map_arrow(picked, run, schema, release=forget_encoder, text="_text")
