"""Licence scan: Aho-Corasick over words and text, and a shunting-yard parser for expressions.

A text is lower-cased (A-Z), cut into words, and written with single spaces. One Aho-Corasick
pass over the words finds the notice phrases, one over the plain lower-case text the identifier
tags, and one over that text with single spaces the notice openings, so that wrapped notices are
read on. What follows a tag, up to the end of its line or the next tag, or an opening, up to the
first word that cannot continue it, is parsed as an expression of ``and``, ``or``, ``with`` and
brackets. ``with`` binds closest, then ``and``, then ``or``. An expression is evaluated to its
licence families and to whether it can be met by permissive licences alone. An opening inside an
expression that was already read belongs to it, so every word is parsed once.

Unknown identifiers are operands too, behind a tag any word and elsewhere words shaped like one
(``licenseref-x``, ``name-2.0``). What they ask for is not known, so an expression with one is
null for whether it is permissive.

Rows: null and empty texts have no words, no labels and score 0. Texts are scanned whole. An
expression that does not parse gives the labels of all its identifiers, and null for whether it
is permissive. Repeated rows give repeated results.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dyadica.llm.common import map_arrow, texts_of, with_fields

# Phrases whose places are the base, with their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further notice phrases.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "2 clause bsd": "bsd",
    "3 clause bsd": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by nc sa": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0",
    "creative commons zero": "cc0",
    "gnu gpl": "gpl",
    "gnu lgpl": "lgpl",
    "gnu agpl": "agpl",
    "gplv2": "gpl",
    "gplv3": "gpl",
    "lgplv2": "lgpl",
    "lgplv3": "lgpl",
    "agplv3": "agpl",
    "released into the public domain": "public-domain",
    "all rights reserved": "proprietary",
}
# How identifiers start, longest first, with their families.
FAMILIES = {
    "cc-by-nc": "cc-by-nc", "cc-by-nd": "cc-by-nd", "cc-by-sa": "cc-by-sa", "cc-by": "cc-by",
    "cc0": "cc0", "apache": "apache", "agpl": "agpl", "lgpl": "lgpl", "gpl": "gpl", "mpl": "mpl",
    "epl": "epl", "bsd": "bsd", "bsl": "bsl", "isc": "isc", "mit": "mit", "unlicense": "public-domain",
    "zlib": "zlib", "0bsd": "bsd", "python": "psf", "psf": "psf", "artistic": "artistic",
}
# Families whose terms ask for no more than notice.
PERMISSIVE = {"apache", "mit", "bsd", "isc", "bsl", "cc0", "cc-by", "public-domain", "zlib", "psf"}
# Texts after which an expression stands; the first is an identifier tag.
OPENINGS = ("spdx-license-identifier:", "licensed under", "released under", "license:", "licence:")
BINDS = {"or": 1, "and": 2, "with": 3}
# How sure a label is: by identifier tag, by notice opening, by a phrase alone.
BY_TAG, BY_OPENING, BY_PHRASE = 1.0, 0.9, 0.7

SKIPPED = {"the", "a", "license", "licence", "terms", "of", "gnu"}
# What may follow an identifier and belongs to it.
VERSION = re.compile(r"(?:v|version)?[0-9][0-9.]*\+?$|version$")
LATER = {"later", "newer"}
IDENTIFIER = re.compile(r"licenseref-|[a-z][a-z0-9]*(?:-[a-z0-9]+)*-v?[0-9]")
TOKEN = re.compile(r"\(|\)|[a-z0-9][a-z0-9.+-]*")
WORD_TABLE = bytes(
    b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32
    for b in range(256)
)


@lru_cache(maxsize=4096)
def family(identifier: str) -> str | None:
    """The family of an identifier such as ``gpl-2.0-only`` or ``gplv3``; None where it is unknown."""
    for start, name in FAMILIES.items():
        if identifier == start or re.match(re.escape(start) + r"(?:[-+.0-9]|v[0-9])", identifier):
            return name
    return None


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: operands and operators in postfix order, or None if it does not parse."""
    out, held, operand_next = [], [], True
    for t in tokens:
        if t in BINDS:
            if operand_next:
                return None
            while held and held[-1] != "(" and BINDS[held[-1]] >= BINDS[t]:
                out.append(held.pop())
            held.append(t)
            operand_next = True
        elif t == "(":
            if not operand_next:
                return None
            held.append(t)
        elif t == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held or operand_next:
                return None
            held.pop()
        else:
            if not operand_next:
                return None
            out.append(t)
            operand_next = False
    if operand_next or "(" in held:
        return None
    return out + held[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], bool] | None:
    """The families named, and whether permissive licences alone can meet the expression.
    None where an operand is no known licence; what follows ``with`` is an exception."""
    stack: list[tuple[set[str], bool] | str] = []

    def licence(x):
        if isinstance(x, str):
            name = family(x)
            return None if name is None else ({name}, name in PERMISSIVE)
        return x

    for t in postfix:
        if t not in BINDS:
            stack.append(t)
            continue
        b, a = stack.pop(), licence(stack.pop())
        if t == "with":
            if a is None or not isinstance(b, str):
                return None
            stack.append(a)
            continue
        b = licence(b)
        if a is None or b is None:
            return None
        stack.append((a[0] | b[0], (a[1] or b[1]) if t == "or" else (a[1] and b[1])))
    return licence(stack[0])


def both(a: bool | None, b: bool | None) -> bool | None:
    """And, where None is not known."""
    return False if a is False or b is False else None if a is None or b is None else True


class Expression(NamedTuple):
    """What stands behind a tag or an opening: its text, families, and whether permissive licences
    can meet it (None: not known)."""

    text: str
    families: set[str]
    permissive: bool | None


def parse(text: str, start: int = 0, end: int | None = None, strict: bool = False) -> Expression | None:
    return read_on(text, start, end, strict)[0]


def read_on(text: str, start: int = 0, end: int | None = None, strict: bool = False) -> tuple[Expression | None, int]:
    """The expression at ``start``, and the first token that cannot continue it, where reading ends.

    ``the`` and ``license`` and versions are skipped. With ``strict``, any word may be an operand,
    and an operator without one is a fault; else the text goes on as prose there.
    """
    tokens, operands, whole, depth, operand_next = [], [], 0, 0, True
    stop = len(text) if end is None else end
    for m in TOKEN.finditer(text, start, stop):
        t = m.group().rstrip(".")
        if t in SKIPPED or not operand_next and VERSION.match(t):
            continue
        exception = bool(tokens) and tokens[-1] == "with"
        if not operand_next:
            if t in BINDS:
                operand_next = True
            elif t == ")" and depth:
                depth -= 1
            else:
                stop = m.start()
                break
        elif t in LATER and tokens and tokens[-1] == "or":
            tokens.pop()
            operand_next = False
            continue
        elif t == "(" and not exception:
            depth += 1
        elif t in BINDS or t in ("(", ")") or not (strict or exception or family(t) or IDENTIFIER.match(t)):
            stop = m.start()
            break
        else:
            operand_next = False
            operands.append((len(tokens), t, exception))
        tokens.append(t)
        if not depth and not operand_next:
            whole = len(tokens)
    families = {name for _, t, exception in operands if not exception and (name := family(t))}
    if not operands or not (families or strict):
        return None, stop
    faulty = not whole or operands[-1][0] >= whole or strict and len(tokens) > whole
    value = None if faulty else evaluate(to_postfix(tokens[:whole]))
    return Expression(" ".join(tokens[: whole or None]), families, value[1] if value else None), stop


@lru_cache(maxsize=1)
def automata():
    import ahocorasick

    phrases = ahocorasick.Automaton()
    for phrase, name in {**NOTICES, **BASE}.items():
        phrases.add_word(f" {phrase} ", (len(phrase) + 1, name, phrase in BASE))
    phrases.make_automaton()
    tags, openings = ahocorasick.Automaton(), ahocorasick.Automaton()
    for opening in OPENINGS:
        (tags if opening is OPENINGS[0] else openings).add_word(opening, opening)
    tags.make_automaton()
    openings.make_automaton()
    return phrases, tags, openings


def scan(text: str) -> dict:
    phrases, tags, openings = automata()
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.translate(WORD_TABLE).split()
    line = b" " + b" ".join(words) + b" "
    places, base, labels, score = [], set(), set(), 0.0
    seen, at = 0, 0
    for end, (back, name, is_base) in sorted((e - v[0], v) for e, v in phrases.iter(line.decode("latin-1"))):
        labels.add(name)
        score = max(score, BY_PHRASE)
        if is_base:
            at += line.count(b" ", seen, end)
            seen = end
            places.append(at)
            base.add(name)
    lower = raw.lower()
    flowing = b" ".join(lower.split()).decode("latin-1")
    lower = lower.decode("latin-1")
    expressions, permissive = set(), []

    def add(found: Expression | None, sure: float) -> None:
        nonlocal score
        if found is not None:
            expressions.add(found.text)
            permissive.append(found.permissive)
            labels.update(found.families)
            score = max(score, sure if found.families else 0.0)

    after = [end + 1 for end, _ in tags.iter(lower)]
    for start, following in zip(after, [*after[1:], len(lower) + len(OPENINGS[0])]):
        stop = lower.find("\n", start, following - len(OPENINGS[0]))
        add(parse(lower, start, following - len(OPENINGS[0]) if stop < 0 else stop, strict=True), BY_TAG)
    reach = -1
    for end, _ in openings.iter(flowing):
        if reach <= end:  # an opening within what an earlier one reads belongs to that
            found, reach = read_on(flowing, end + 1)
            add(found, BY_OPENING)
    return {
        "n_words": len(words), "n_base": len(places),
        "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": score,
        "expressions": "; ".join(sorted(expressions)), "permissive": reduce(both, permissive) if permissive else None,
    }


SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double, expressions string, permissive boolean"
)


def scan_documents(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and what the scan finds in every text: counts and places of base phrases, labels,
    the expressions parsed, and whether all of them can be met permissively. No shuffle."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batch: pa.RecordBatch) -> dict:
        rows = [scan(t) for t in texts_of(batch, "_text")]
        return {n: [r[n] for r in rows] for n in names} | {c: batch.column(k) for k, c in enumerate(keep)}

    picked = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("_text"))
    return map_arrow(picked, run, with_fields(docs, keep, SCHEMA), text="_text")
