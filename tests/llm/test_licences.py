import random
import re
import time

import pytest

from dyadica.llm.licences import BASE, PERMISSIVE, evaluate, family, parse, scan, scan_documents, to_postfix
from dyadica.llm.queries import op9_licences


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = []
    for phrase, label in BASE.items():
        p = phrase.split()
        places += [(k, label) for k in range(len(words)) if words[k : k + len(p)] == p]
    at = [k for k, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def base_of(r):
    return r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]


def test_places_of_phrases():
    for t in (
        "", "mit license", "MIT License. MIT LICENSE;mit-license", "xmit license", "cc by cc by", "gnu\ngeneral public  license",
        "éapache license ñ", "Apache License, Version 2.0", "mit\x00license \x7f {apache} license", "mitlicense cc_by",
    ):
        assert base_of(scan(t)) == brute(t), t


def test_precedence_and_brackets():
    assert to_postfix("mit or apache-2.0 and gpl-2.0 with x".split()) == ["mit", "apache-2.0", "gpl-2.0", "x", "with", "and", "or"]
    assert to_postfix(["(", "mit", "or", "isc", ")", "and", "mpl-2.0"]) == ["mit", "isc", "or", "mpl-2.0", "and"]
    for bad in (["mit", "isc"], ["or", "mit"], ["(", "mit"], ["mit", ")"], ["mit", "and"], []):
        assert to_postfix(bad) is None
    assert evaluate(["gpl-2.0", "mit", "or"]) == ({"gpl", "mit"}, True)
    assert evaluate(["gpl-2.0", "mit", "and"]) == ({"gpl", "mit"}, False)
    assert evaluate(["gpl-2.0", "classpath-exception-2.0", "with"]) == ({"gpl"}, False)
    assert evaluate(["foo", "mit", "or"]) is None


def test_tags_and_notices():
    r = scan("// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND BSD-3-Clause\ncode")
    assert r["labels"] == "bsd,gpl,mit" and r["permissive"] is True and r["score"] == 1.0 and r["base_labels"] == ""
    assert scan("Released under the MIT License.")["expressions"] == "mit"
    assert parse("apache-2.0 and nothing else")[0] == "apache-2.0"
    assert parse("whatever you like") is None
    assert family("gpl-3.0-or-later") == "gpl" and family("mitx") is None and family("cc-by-nc-4.0") == "cc-by-nc"
    assert scan("no word of it")["score"] == 0.0


def test_query_agrees_with_brute_force_on_the_base(spark, sf, docs):
    got = {r.doc_id: r for r in op9_licences(spark, sf).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        assert base_of(got[r.doc_id]) == brute(r.text)
        assert {*filter(None, got[r.doc_id].base_labels.split(","))} <= {*got[r.doc_id].labels.split(",")}


def test_edge_rows(edge, nothing):
    rows = scan_documents(edge, ["doc_id", "text"]).collect()
    assert len(rows) == edge.count()
    for r in rows:
        assert base_of(r) == brute(r.text)
    assert scan_documents(nothing, ["doc_id"]).count() == 0


@pytest.mark.parametrize("n", [5_000])
def test_long_text(n):
    t = "mit license " * n
    assert base_of(scan(t)) == (2 * n, n, 0, 2 * n - 2, "mit")


def test_notices_wrapped_over_lines():
    r = scan("Released under\nBSD-3-Clause")
    assert r["labels"] == "bsd" and r["score"] == 0.9
    r = scan("This is licensed under MIT or\n  GPL-2.0\nand more words")
    assert r["labels"] == "gpl,mit" and r["expressions"] == "mit or gpl-2.0"
    assert scan("licensed under MIT and\r\nGPL-2.0")["permissive"] is False
    assert scan("it is licensed\n\tunder  the\nApache-2.0 terms")["expressions"] == "apache-2.0"
    # A tag ends with its line.
    assert scan("SPDX-License-Identifier: MIT\nor GPL-2.0")["labels"] == "mit"
    assert scan("SPDX-License-Identifier:\nMIT")["labels"] == ""
    assert scan("license: " * 50_000 + "mit")["expressions"] == "mit"


def test_unknown_operands_and_faults():
    tag = "SPDX-License-Identifier: "
    r = scan(tag + "(MIT OR Apache-2.0) AND LicenseRef-x")
    assert r["labels"] == "apache,mit" and r["permissive"] is None and r["score"] == 1.0
    r = scan(tag + "MIT AND (GPL-2.0 OR")
    assert r["labels"] == "gpl,mit" and r["permissive"] is None
    assert scan("licensed under MIT and (GPL-2.0 or")["permissive"] is None
    r = scan("licensed under MIT and distributed to all")
    assert r["expressions"] == "mit" and r["permissive"] is True
    assert scan("licensed under MIT and EUPL-1.2")["permissive"] is None
    r = scan(tag + "LicenseRef-x")
    assert r["labels"] == "" and r["permissive"] is None and r["score"] == 0.0
    assert scan(tag + "MIT\n" + tag + "LicenseRef-x\n" + tag + "GPL-2.0")["permissive"] is False


def test_forms_of_gpl():
    for t in ("under GPLv3", "GNU GPL v3", "SPDX-License-Identifier: GPLv2", "licensed under the GNU GPL v3", "license: gplv2+"):
        assert scan(t)["labels"] == "gpl", t
    r = scan("licensed under the GNU GPL v3 or MIT")
    assert r["labels"] == "gpl,mit" and r["permissive"] is True and r["expressions"] == "gpl or mit"
    r = scan("licensed under GPL version 2 or later and Apache-2.0")
    assert r["expressions"] == "gpl and apache-2.0" and r["permissive"] is False


def met(tokens):
    """Recursive descent over an expression, as the rules state them."""

    def part(level):
        if level == 3:
            if tokens[0] == "(":
                tokens.pop(0)
                value = part(1)
                tokens.pop(0)
                return value
            name = family(tokens.pop(0))
            if tokens[:1] == ["with"]:
                del tokens[:2]
            return {name}, name in PERMISSIVE
        names, value = part(level + 1)
        while tokens[:1] == [("or", "and")[level - 1]]:
            tokens.pop(0)
            more, other = part(level + 1)
            names, value = names | more, (value or other) if level == 1 else (value and other)
        return names, value

    return part(1)


def test_random_expressions_by_recursive_descent():
    rng = random.Random(9)

    def made(depth):
        if depth == 0 or rng.random() < 0.3:
            one = [rng.choice(["mit", "gpl-2.0", "apache-2.0", "mpl-2.0", "bsd-3-clause"])]
            return one + ["with", "classpath-exception-2.0"] if rng.random() < 0.2 else one
        out = made(depth - 1) + [rng.choice(["and", "or"])] + made(depth - 1)
        return ["(", *out, ")"] if rng.random() < 0.5 else out

    for _ in range(500):
        tokens = made(4)
        names, value = met(list(tokens))
        for strict in (False, True):
            found = parse(" ".join(tokens), strict=strict)
            assert (found.text.split(), found.families, found.permissive) == (tokens, names, value)


def test_many_openings_in_linear_time():
    start = time.monotonic()
    r = scan("license: mit and " * 20_000)
    assert r["labels"] == "mit" and len(r["expressions"]) < 9 * 20_000
    assert scan("license: ((( " * 20_000)["labels"] == ""
    assert scan("SPDX-License-Identifier: mit and " * 20_000)["labels"] == "mit"
    assert time.monotonic() - start < 20
