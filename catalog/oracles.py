"""SQL that states the registered queries over the same tables, for another engine."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from catalog.fixtures import BOUNDED, LINE_KEYS, LISTED, OFFSET, OUTSIDE, PLANTED, SECOND, SEED, SEGMENTS
from catalog.queries import CHOSEN_THRESHOLD, DECAYED, MODES, STEPS, STREAM, WEIGHTS_3, WEIGHTS_5, WEIGHTS_TERMS
from dyadica.functions.hashing import stream_words

# ------------------------------------------------------------------- building blocks


def r6(e: str) -> str:
    return f"round({e}, 6) + 0.0"


def h48(prefix: str, key: str) -> str:
    return f"(('0x' || substr(md5('{prefix}' || ({key})), 1, 12))::BIGINT)"


def _times(e: str, c: int) -> str:
    return f"((({e})::HUGEINT * {c}) & 4294967295)::BIGINT"


def _turned(e: str, bits: int) -> str:
    return f"(({e} << {bits}) & 4294967295) | ({e} >> {32 - bits})"


def _murmur(tag: str, key: str, word: int) -> list[str]:
    """Columns, each on those before: ``tag`` is the Murmur3 hash of the word and of the number in
    ``key``, as an unsigned number of 32 bits. Words and halves of the number are hashed alike."""
    cols, last = [], "42"
    for part, (block, size) in enumerate(((str(word), 4), (f"({key} & 4294967295), ({key} >> 32)", 8))):
        for k, e in enumerate(block.split(", ")):
            t = f"{tag}_{part}{k}"
            cols += [
                f"{_times(e, 0xCC9E2D51)} AS {t}k", f"{_turned(f'{t}k', 15)} AS {t}l", f"{_times(f'{t}l', 0x1B873593)} AS {t}m",
                f"xor({last}::BIGINT, {t}m) AS {t}x", f"{_turned(f'{t}x', 13)} AS {t}y", f"({t}y * 5 + {0xE6546B64}) & 4294967295 AS {t}z",
            ]
            last = f"{t}z"
        t = f"{tag}_{part}f"
        cols += [
            f"xor({last}, {size}::BIGINT) AS {t}a", f"{_times(f'xor({t}a, {t}a >> 16)', 0x85EBCA6B)} AS {t}b",
            f"{_times(f'xor({t}b, {t}b >> 13)', 0xC2B2AE35)} AS {t}c", f"xor({t}c, {t}c >> 16) AS {t}d",
        ]
        last = f"{t}d"
    return [*cols, f"{last} AS {tag}"]


def drawn(rows: str, key: str = "pair_id", stream: str = STREAM) -> str:
    """The rows with two uniform 48-bit numbers ha, hb drawn from ``key``."""
    cols = [c for tag, w in zip(("ma", "mb", "mc"), stream_words(stream)) for c in _murmur(tag, key, w)]
    return f"(SELECT *, {', '.join(cols)}, ma * 65536 + (mb & 65535) AS ha, mc * 65536 + (mb >> 16) AS hb FROM {rows})"


def pairs(count: str, batch: str, stream: str = STREAM, n: str = "(SELECT count(*) FROM raw)") -> str:
    """CTE pr(pair_id, trial, i, j): ``count`` pairs in batches of ``batch``."""
    return (
        f"nn AS (SELECT {n} AS n), "
        f"pr AS (SELECT pair_id, pair_id // ({batch}) AS trial, ha % n AS i, hb % n AS j "
        f"FROM {drawn(f'(SELECT unnest(range(({count})::BIGINT)) AS pair_id)', stream=stream)}, nn)"
    )


def stimuli(
    rows: str, features: Sequence[tuple[str, bool]], y: str | None, scale: bool = True, where: str = "true"
) -> str:
    """CTEs raw and st(sid, f0.., y); features are (column, numeric). Rows that do not hold to
    ``where`` have positions, but no features, and no part in their bounds."""
    bounds, values = ["count(*) AS rows_"], []
    for k, (c, numeric) in enumerate(features):
        if numeric and scale:
            bounds += [f"min({c}::DOUBLE) AS lo{k}", f"max({c}::DOUBLE) AS hi{k}"]
            values.append(
                f"({c}::DOUBLE - lo{k}) * (CASE WHEN hi{k} > lo{k} THEN 1.0::DOUBLE / (hi{k} - lo{k}) "
                f"ELSE 1.0 END) AS f{k}"
            )
        else:
            values.append(f"{c} AS f{k}")
    if y is not None:
        values.append(f"{y} AS y")
    return (
        f"raw AS ({rows}), bd AS (SELECT {', '.join(bounds)} FROM raw WHERE {where}), "
        f"st AS (SELECT sid, {', '.join(values)} FROM raw, bd WHERE {where})"
    )


L2 = "list_distance(a.y, b.y)"
L1 = "list_sum(list_transform(range(1, len(a.y) + 1), lambda k: abs(a.y[k] - b.y[k])))"
NORM_A, NORM_B = "sqrt(list_dot_product(a.y, a.y))", "sqrt(list_dot_product(b.y, b.y))"
COS = f"1.0 - list_dot_product(a.y, b.y) / (greatest({NORM_A}, 1e-8) * greatest({NORM_B}, 1e-8))"
NORM_DIFF = f"abs({NORM_A} - {NORM_B})"
LARGEST = "list_max(list_transform(range(1, len(a.y) + 1), lambda k: abs(a.y[k] - b.y[k])))"


def terms(p: int, interactions: bool) -> list[str]:
    if interactions:
        return [f"d{r} * d{c}" for r in range(p) for c in range(r + 1)]
    return [f"d{k} * d{k}" for k in range(p)]


def distances(
    features: Sequence[tuple[str, bool]], d: str | None = None, interactions: bool = False, fill: float = 0.0
) -> str:
    """CTE ds(pair_id, trial, i, j, x0.., d)."""
    cols = []
    for k, (_, numeric) in enumerate(features):
        known = f"least(1.0::DOUBLE, abs(a.f{k} - b.f{k}))" if numeric else f"(a.f{k} <> b.f{k})::INT::DOUBLE"
        cols.append(
            f"CASE WHEN a.f{k} IS NULL OR b.f{k} IS NULL THEN {fill}::DOUBLE ELSE {known} END AS d{k}"
        )
    if d is not None:
        cols.append(f"{d} AS d")
    xs = [f"{t} AS x{k}" for k, t in enumerate(terms(len(features), interactions))]
    if d is not None:
        xs.append("d")
    return (
        f"dd AS (SELECT pr.*, {', '.join(cols)} FROM pr JOIN st a ON a.sid = pr.i JOIN st b ON b.sid = pr.j), "
        f"ds AS (SELECT pair_id, trial, i, j, {', '.join(xs)} FROM dd)"
    )


def corr_eps(x: str, y: str) -> str:
    return (
        f"covar_pop({x}, {y}) * count(*) / ((sqrt(greatest(var_pop({x}) * count(*), 0)) + 1e-8) "
        f"* (sqrt(greatest(var_pop({y}) * count(*), 0)) + 1e-8))"
    )


def weighted(weights: Sequence[float]) -> str:
    return " + ".join(["0.0::DOUBLE", *[f"{w}::DOUBLE * x{k}" for k, w in enumerate(weights)]])


# --------------------------------------------------------------------------- stimuli

_f1 = "(c_acctbal - (SELECT min(c_acctbal) FROM customer)) * (1.0::DOUBLE / ((SELECT max(c_acctbal) FROM customer) - (SELECT min(c_acctbal) FROM customer)))"
_planted_y = ", ".join(
    [f"{PLANTED[0] ** 0.5!r}::DOUBLE * {_f1}"]
    + [f"{(PLANTED[1] / 2) ** 0.5!r}::DOUBLE * (c_mktsegment = '{s}')::INT" for s in SEGMENTS]
    + [f"{PLANTED[2] ** 0.5!r}::DOUBLE * (c_nationkey % 2)"]
)
_second_y = f"{SECOND[0]!r}::DOUBLE * {_f1}, {SECOND[1]!r}::DOUBLE * (c_nationkey % 2)"
PLANTED_ROWS = (
    f"SELECT c_custkey AS sid, {_f1} AS f1, c_mktsegment AS f2, (c_nationkey % 2)::DOUBLE AS f3, "
    f"c_nationkey AS f4, [{_planted_y}]::DOUBLE[] AS y0 FROM customer"
)
SECOND_ROWS = PLANTED_ROWS.replace(_planted_y, _second_y)
PLANTED_F = [("f1", True), ("f2", False), ("f3", False), ("f4", False)]


def planted(rows: str = PLANTED_ROWS, p: int = 3, where: str = "true") -> str:
    return stimuli(rows, PLANTED_F[:p], "y0", where=where)


CUSTOMER_F = [("c_acctbal", True), ("c_mktsegment", False), ("c_nationkey", False)]
CUSTOMERS = stimuli(
    "SELECT c_custkey AS sid, * FROM customer", CUSTOMER_F, "[c_acctbal]::DOUBLE[]"
)
VECTOR_F = [("label", False)]
VECTORS = stimuli("SELECT vec_id AS sid, * FROM embeddings", VECTOR_F, "embedding::DOUBLE[]")
DESCRIBED_F = [("lang", False), ("source", False), ("n_chars", True)]
DESCRIBED = stimuli(
    "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS sid, e.embedding, d.lang, d.source, d.n_chars "
    "FROM embeddings e LEFT JOIN documents d ON e.vec_id = d.doc_id",
    DESCRIBED_F,
    "embedding::DOUBLE[]",
)
LABELLED_ROWS = (
    "SELECT row_number() OVER (ORDER BY d.doc_id) - 1 AS sid, d.doc_id, d.lang, d.n_chars, l.quality, l.toxic "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
)
PART_F = [("p_brand", False), ("p_type", False)]
PARTS = stimuli(
    "SELECT p_partkey AS sid, * FROM part", PART_F, "[p_size::DOUBLE, p_retailprice]::DOUBLE[]"
)
LINE_F = [
    ("l_quantity", True), ("l_extendedprice", True), ("l_discount", True),
    ("l_returnflag", False), ("l_linestatus", False),
]
LINES = stimuli(
    f"SELECT row_number() OVER (ORDER BY {', '.join(LINE_KEYS)}) - 1 AS sid, * FROM lineitem",
    LINE_F,
    "[l_tax, l_discount]::DOUBLE[]",
)
N = "(SELECT count(*) FROM raw)"


def listed(
    count: str, batch: str, stream: str = STREAM, interactions: bool = False, offset: float = 0.0,
    weights: Sequence[float] = LISTED,
) -> str:
    """CTEs up to ds for the list of customer pairs with precomputed distances."""
    made = (
        CUSTOMERS
        + ", "
        + "p0 AS (SELECT ha % n AS i, hb % n AS j "
        f"FROM {drawn(f'(SELECT unnest(range((4 * {N})::BIGINT)) AS k)', 'k', '7')}, (SELECT {N} AS n)), "
        "g0 AS (SELECT DISTINCT p0.i, p0.j, sqrt(least(1.0::DOUBLE, abs(a.f0 - b.f0)) * least(1.0::DOUBLE, abs(a.f0 - b.f0))) AS gap, "
        "(a.f1 <> b.f1)::INT::DOUBLE AS mismatch FROM p0 JOIN st a ON a.sid = p0.i JOIN st b ON b.sid = p0.j), "
        "lp AS (SELECT row_number() OVER (ORDER BY i, j) - 1 AS row_, *, "
        f"sqrt({weights[0]!r}::DOUBLE * gap * gap + {weights[1]!r}::DOUBLE * gap * mismatch "
        f"+ {weights[2]!r}::DOUBLE * mismatch * mismatch) "
        f"+ {offset!r}::DOUBLE AS d FROM g0), "
    )
    x = "gap * gap AS x0, mismatch * gap AS x1, mismatch * mismatch AS x2" if interactions else (
        "gap * gap AS x0, mismatch * mismatch AS x1"
    )
    return made + (
        f"pr AS (SELECT pair_id, pair_id // ({batch}) AS trial, ha % n AS row_ "
        f"FROM {drawn(f'(SELECT unnest(range(({count})::BIGINT)) AS pair_id)', stream=stream)}, "
        "(SELECT count(*) AS n FROM lp)), "
        f"ds AS (SELECT pair_id, trial, i, j, {x}, d FROM pr JOIN lp USING (row_))"
    )


def bounded(count: str, batch: str, stream: str) -> str:
    """CTEs up to ds for the list of customer pairs with a feature that shortens distances."""
    d = distances(CUSTOMER_F).replace("pr.", "p0.").replace("FROM pr ", "FROM p0 ").replace("= pr.", "= p0.")
    names = ("gap", "mismatch", "nation")
    y = " + ".join([f"{BOUNDED[0]!r}::DOUBLE", *[f"{w!r}::DOUBLE * {n} * {n}" for w, n in zip(BOUNDED[1:], names)]])
    return (
        f"{CUSTOMERS}, p0 AS (SELECT k AS pair_id, 0 AS trial, ha % n AS i, hb % n AS j "
        f"FROM {drawn(f'(SELECT unnest(range((4 * {N})::BIGINT)) AS k)', 'k', '7')}, (SELECT {N} AS n)), "
        + d.replace("ds AS", "d0 AS") + ", "
        f"g0 AS (SELECT DISTINCT i, j, {', '.join(f'sqrt(x{k}) AS {n}' for k, n in enumerate(names))} FROM d0), "
        f"lp AS (SELECT row_number() OVER (ORDER BY i, j) - 1 AS row_, *, sqrt({y}) AS d FROM g0), "
        f"pr AS (SELECT pair_id, pair_id // ({batch}) AS trial, ha % n AS row_ "
        f"FROM {drawn(f'(SELECT unnest(range(({count})::BIGINT)) AS pair_id)', stream=stream)}, "
        "(SELECT count(*) AS n FROM lp)), "
        f"ds AS (SELECT pair_id, trial, i, j, {', '.join(f'{n} * {n} AS x{k}' for k, n in enumerate(names))}, d FROM pr JOIN lp USING (row_))"
    )


LISTED_N = "(SELECT count(*) FROM lp)"


# ----------------------------------------------------------------------------- queries


def _spearman(prefix: str, pred: str, ties: str) -> str:
    v = f"v AS (SELECT trial, pair_id, ({pred})::FLOAT + 0::FLOAT AS p, d::FLOAT + 0::FLOAT AS y FROM ds)"
    if ties == "ordinal":
        rank = "row_number() OVER (PARTITION BY trial ORDER BY {c}, pair_id) - 1"
    else:
        rank = (
            "rank() OVER (PARTITION BY trial ORDER BY {c}) - 1 "
            "+ (count(*) OVER (PARTITION BY trial, {c}) - 1) / 2.0"
        )
    rk = f"rk AS (SELECT trial, ({rank.format(c='p')})::DOUBLE AS rp, ({rank.format(c='y')})::DOUBLE AS ry FROM v)"
    return f"WITH {prefix}, {v}, {rk} SELECT trial, {r6(corr_eps('rp', 'ry'))} AS spearman FROM rk GROUP BY trial"


def pfi_ctes(
    prefix: str, weights: Sequence[float], names: Sequence[str], batch: str, n_perm: int,
    stream: str = STREAM, tag: str = "",
) -> str:
    """CTE im(feature, permutation, baseline, permuted, importance)."""
    k = f"trial // {n_perm}"
    rest = " + ".join(
        ["0.0::DOUBLE"]
        + [f"CASE WHEN {k} <> {i} THEN {w}::DOUBLE * x{i} ELSE 0.0 END" for i, w in enumerate(weights)]
    )
    part = f"CASE {k} " + " ".join(f"WHEN {i} THEN {w}::DOUBLE * x{i}" for i, w in enumerate(weights)) + " END"
    label = f"CASE {k} " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(names)) + " END"
    rank = "(row_number() OVER (PARTITION BY trial ORDER BY {c}, pair_id) - 1)::DOUBLE"
    t = tag
    return (
        f"{prefix}, "
        f"ba{t} AS (SELECT trial, pair_id, pair_id % ({batch}) AS own, {rest} AS rest, {part} AS part, d::FLOAT + 0::FLOAT AS y FROM ds), "
        f"pe{t} AS (SELECT trial, part AS moved, row_number() OVER (PARTITION BY trial ORDER BY "
        f"{h48(stream + ':p:', 'pair_id')}, pair_id) - 1 AS slot FROM ba{t}), "
        f"mx{t} AS (SELECT ba{t}.trial, pair_id, y, (rest + part)::FLOAT + 0::FLOAT AS base, "
        f"(rest + moved)::FLOAT + 0::FLOAT AS perm "
        f"FROM ba{t} JOIN pe{t} ON pe{t}.trial = ba{t}.trial AND pe{t}.slot = ba{t}.own), "
        f"rk{t} AS (SELECT trial, {rank.format(c='y')} AS ry, {rank.format(c='base')} AS rb, "
        f"{rank.format(c='perm')} AS rp FROM mx{t}), "
        f"sc{t} AS (SELECT trial, {corr_eps('rb', 'ry')} AS baseline, {corr_eps('rp', 'ry')} AS permuted "
        f"FROM rk{t} GROUP BY trial), "
        f"im{t} AS (SELECT {label} AS feature, (trial % {n_perm})::INT AS permutation, baseline, permuted, "
        f"baseline - permuted AS importance FROM sc{t})"
    )


PFI_OUT = f"feature, permutation, {r6('baseline')} AS baseline, {r6('permuted')} AS permuted, {r6('importance')} AS importance"


def pfi(prefix: str, weights, names, batch: str, n_perm: int) -> str:
    return f"WITH {pfi_ctes(prefix, weights, names, batch, n_perm)} SELECT {PFI_OUT} FROM im"


def _held(condition: str) -> str:
    return (
        "SELECT row_number() OVER (ORDER BY sid) - 1 AS sid, f1, f2, f3, f4, y0 "
        f"FROM ({PLANTED_ROWS}) WHERE {condition}"
    )


def _planted_pairs(count: str, batch: str, d: str = L2, rows: str = PLANTED_ROWS, p: int = 3,
                   interactions: bool = False, stream: str = STREAM, where: str = "true") -> str:
    return ", ".join(
        [planted(rows, p, where), pairs(count, batch, stream), distances(PLANTED_F[:p], d, interactions)]
    )


def _moments(q: int) -> str:
    """CTE mo: covariances of the terms and the scaled squared distance."""
    cols = [f"covar_pop(x{r}, x{c}) AS s{r}{c}" for r in range(q) for c in range(r + 1)]
    cols += [f"covar_pop(x{k}, s) AS c{k}" for k in range(q)]
    return (
        "lim AS (SELECT min(d) AS m, max(d) AS mm FROM ds), "
        "sq AS (SELECT ds.*, pow((d - m) / (mm - m + 1e-8), 2) AS s FROM ds, lim), "
        f"mo AS (SELECT {', '.join(cols)} FROM sq)"
    )


_TWO = "w AS (SELECT greatest(s11 * c0 - s10 * c1, 0) AS w0, greatest(s00 * c1 - s10 * c0, 0) AS w1 FROM mo)"


def _det(m: list[list[str]]) -> str:
    """Determinant by expansion along the first row."""
    if len(m) == 1:
        return m[0][0]
    parts = []
    for k, cell in enumerate(m[0]):
        minor = [[v for c, v in enumerate(row) if c != k] for row in m[1:]]
        parts.append(f"{'-' if k % 2 else '+'} {cell} * {_det(minor)}")
    return f"({' '.join(parts)})"


def _cramer(q: int) -> str:
    """CTE w: least squares weights; the planted ones are not negative, but for rounding."""
    sym = [[f"s{max(r, c)}{min(r, c)}" for c in range(q)] for r in range(q)]
    out = []
    for k in range(q):
        m = [[f"c{r}" if c == k else v for c, v in enumerate(row)] for r, row in enumerate(sym)]
        out.append(f"{_det(m)} / {_det(sym)} AS w{k}")
    return f"w AS (SELECT {', '.join(out)} FROM mo)"


def _bounded_squares(q: int) -> str:
    """CTE w: least squares over weights of 0 or more. Of the sets of features that may be above 0,
    the one whose solution is, and at which no other feature would gain, is the answer."""
    sym = [[f"s{max(r, c)}{min(r, c)}" for c in range(q)] for r in range(q)]
    tried = []
    for chosen in range(1, 1 << q):
        inside = [k for k in range(q) if chosen >> k & 1]
        det = _det([[sym[r][c] for c in inside] for r in inside])
        w = {}
        for k in inside:
            m = [[f"c{r}" if c == k else sym[r][c] for c in inside] for r in inside]
            w[k] = f"{_det(m)} / {det}"
        ws = ", ".join(f"{w.get(k, '0.0::DOUBLE')} AS w{k}" for k in range(q))
        holds = [f"w{k} > 0" for k in inside]
        holds += [f"c{k} <= {' + '.join(f'{sym[k][j]} * w{j}' for j in inside)}" for k in range(q) if k not in inside]
        tried.append(
            f"SELECT {', '.join(f'w{k}' for k in range(q))} FROM (SELECT *, {ws} FROM mo) WHERE {' AND '.join(holds)}"
        )
    return f"w AS (SELECT * FROM ({' UNION ALL '.join(tried)}) LIMIT 1)"


def _edge(points: int = 2000, rounds: int = 4) -> str:
    """CTE w: the best singular matrix of two features, cos^2, sin cos, sin^2 of an angle, by
    ever finer rows of angles."""
    w = ["pow(cos(t), 2)", "sin(t) * cos(t)", "pow(sin(t), 2)"]
    up = " + ".join(f"({e}) * c{k}" for k, e in enumerate(w))
    down = " + ".join(f"({w[r]}) * ({w[c]}) * s{max(r, c)}{min(r, c)}" for r in range(3) for c in range(3))
    out, middle, half = [], "0.0::DOUBLE", "pi() / 2"
    for k in range(rounds):
        angles = f"SELECT {middle} + {half} * (u - {points}) / {points} AS t FROM (SELECT unnest(range({2 * points + 1})) AS u)"
        out.append(f"t{k} AS (SELECT arg_max(t, ({up}) / sqrt({down})) AS t FROM ({angles}), mo)")
        middle, half = f"(SELECT t FROM t{k})", f"pi() / 2 / pow({points / 4}, {k + 1})"
    length = "sqrt(" + " + ".join(f"{2 if k == 1 else 1} * pow({e}, 2)" for k, e in enumerate(w)) + ")"
    cols = ", ".join(f"({e}) / {length} AS w{k}" for k, e in enumerate(w))
    return ", ".join(out) + f", w AS (SELECT {cols} FROM t{rounds - 1})"


def _fitted(pairs_ctes: str, q: int) -> str:
    """CTE wn: fitted unit-length weights w0.. in one row."""
    norm = "sqrt(" + " + ".join(f"pow(greatest(w{k}, 0), 2)" for k in range(q)) + ")"
    cols = ", ".join(f"greatest(w{k}, 0) / {norm} AS w{k}" for k in range(q))
    return f"wn AS (WITH {pairs_ctes}, {_moments(q)}, {_cramer(q)} SELECT {cols} FROM w)"


def adam_steps(prefix: str, start: Sequence[float], steps: int, lr: float, decay: float, patience: int) -> str:
    """CTE best: the weights that scored best over Adam steps on per-trial moments of ``ds``.

    One row a step carries the parameters, both Adam averages, the best weights so far and the
    steps since; bounds of the distance only widen.
    """
    q = len(start)
    tri = [(r, c) for r in range(q) for c in range(r + 1)]
    cols = [f"covar_pop(x{r}, x{c}) AS s{r}_{c}" for r, c in tri]
    cols += [f"covar_pop(x{k}, s) AS c{k}" for k in range(q)]
    sigma = lambda r, c: f"s{max(r, c)}_{min(r, c)}"
    soft = ", ".join(f"ln(1 + exp(t{k})) AS p{k}" for k in range(q))
    norm = "sqrt(" + " + ".join(f"p{k} * p{k}" for k in range(q)) + ")"
    weights = ", ".join(f"p{k} / pn AS w{k}" for k in range(q))
    sw = ", ".join("(" + " + ".join(f"{sigma(k, j)} * w{j}" for j in range(q)) + f") AS u{k}" for k in range(q))
    dot = lambda a, b: "(" + " + ".join(f"{a}{k} * {b}{k}" for k in range(q)) + ")"
    grad = ", ".join(
        f"(c{k} - u{k} * wc / wsw) / sqrt(wsw * sv) * (1 / (1 + exp(-t{k}))) / pn AS g{k}" for k in range(q)
    )
    m = ", ".join(f"0.9::DOUBLE * m{k} + (1 - 0.9::DOUBLE) * g{k} AS m{k}" for k in range(q))
    v = ", ".join(f"0.999::DOUBLE * v{k} + (1 - 0.999::DOUBLE) * g{k} * g{k} AS v{k}" for k in range(q))
    moved = ", ".join(
        f"t{k} * (1 - {lr!r}::DOUBLE * {decay!r}::DOUBLE) + {lr!r}::DOUBLE * (m{k} / (1 - pow(0.9::DOUBLE, step + 1))) "
        f"/ (sqrt(v{k} / (1 - pow(0.999::DOUBLE, step + 1))) + 1e-8) AS t{k}" for k in range(q)
    )
    kept = ", ".join(f"CASE WHEN r > best THEN w{k} ELSE b{k} END AS b{k}" for k in range(q))
    names = lambda *x: ", ".join(f"{a}{k}" for a in x for k in range(q))
    first = ", ".join([f"{s!r}::DOUBLE AS t{k}" for k, s in enumerate(start)] + [f"0.0::DOUBLE AS {a}{k}" for a in "mvb" for k in range(q)])
    return (
        f"{prefix}, lim AS (SELECT trial, min(min(d)) OVER w AS lo, max(max(d)) OVER w AS hi FROM ds GROUP BY trial "
        "WINDOW w AS (ORDER BY trial ROWS UNBOUNDED PRECEDING)), "
        "sq AS (SELECT ds.*, pow((d - lo) / (hi - lo + 1e-8), 2) AS s FROM ds JOIN lim USING (trial)), "
        f"mo AS MATERIALIZED (SELECT trial, var_pop(s) AS sv, {', '.join(cols)} FROM sq GROUP BY trial), "
        f"run AS (SELECT 0 AS step, {first}, '-infinity'::DOUBLE AS best, 0 AS waited "
        f"UNION ALL SELECT step + 1, {moved}, {names('m', 'v', 'b')}, best, waited FROM ("
        f"SELECT step, {names('t')}, {m}, {v}, {kept}, greatest(best, r) AS best, "
        "CASE WHEN r > best THEN 0 ELSE waited + 1 END AS waited FROM ("
        f"SELECT *, wc / sqrt(wsw * sv) AS r, {grad} FROM ("
        f"SELECT *, {dot('w', 'c')} AS wc, {dot('w', 'u')} AS wsw FROM ("
        f"SELECT *, {sw} FROM (SELECT *, {weights} FROM (SELECT *, {norm} AS pn FROM ("
        f"SELECT *, {soft} FROM run JOIN mo ON mo.trial = run.step "
        f"WHERE run.step < {steps} AND run.waited < {patience})))))))), "
        f"best AS (SELECT {names('b')} FROM run ORDER BY step DESC LIMIT 1)"
    )


def fit_and_score(train: str, test: str, n_perm: int, count: int = 8, where: str = "true") -> str:
    """Fit four planted features on the rows ``train`` and score on the rows ``test``."""
    full = "(SELECT count(*) FROM customer)"
    fitted = _fitted(
        _planted_pairs(f"{count} * {full}", full, rows=train, p=4, stream=f"{SEED}:fit", where=where), 4
    )
    body = pfi_ctes(
        _planted_pairs(f"4 * {n_perm} * {full}", full, rows=test, p=4),
        [f"(SELECT w{k} FROM wn)" for k in range(4)], ["f1", "f2", "f3", "f4"], full, n_perm,
    )
    return f"WITH {fitted}, {body} SELECT {PFI_OUT} FROM im"


def _weights_out(names: Sequence[str]) -> str:
    norm = "sqrt(" + " + ".join(f"w{k} * w{k}" for k in range(len(names))) + ")"
    return " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {r6(f'w{k} / {norm}')} AS weight FROM w" for k, f in enumerate(names)
    )


def _pairs_of_features(p: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(1, p) for b in range(a)]


def _corr_list(p: int) -> str:
    return ", ".join(
        f"{{'a': {a}, 'b': {b}, 'corr': {corr_eps(f'x{a}', f'x{b}')}}}" for a, b in _pairs_of_features(p)
    )


def _encoded(column: str, name: str | None = None) -> str:
    name = name or column
    return (
        f"CASE WHEN {column} IS NULL THEN NULL ELSE dense_rank() OVER (ORDER BY {column} NULLS LAST) - 1 END::DOUBLE AS {name}"
    )


def _minmax(column: str, rows: str) -> str:
    lo, hi = f"(SELECT min({column}) FROM {rows})", f"(SELECT max({column}) FROM {rows})"
    return f"({column}::DOUBLE - {lo}) * (1.0::DOUBLE / ({hi} - {lo}))"


def build() -> dict[str, str]:
    out: dict[str, str] = {}
    lines = "lineitem"
    out["encode_minmax"] = "SELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(
        f"{r6(_minmax(c, lines))} AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ) + " FROM lineitem"
    out["encode_codes"] = "SELECT p_partkey, " + ", ".join(
        _encoded(c) for c in ("p_brand", "p_type", "p_size")
    ) + " FROM part"
    out["encode_missing"] = (
        f"WITH raw AS ({LABELLED_ROWS}) SELECT doc_id, {r6(_minmax('n_chars', 'raw'))} AS n_chars, "
        f"{_encoded('lang')}, {r6(_minmax('quality', 'raw'))} AS quality, {_encoded('toxic')} FROM raw"
    )
    out["encode_types"] = (
        "WITH raw AS (SELECT o_orderkey, o_orderstatus = 'F' AS filled, o_orderdate::DATE AS day, "
        "o_totalprice::DECIMAL(18,2)::DOUBLE AS price, o_orderdate AS at_ FROM orders) "
        f"SELECT o_orderkey, {_encoded('filled')}, {_encoded('day')}, {r6(_minmax('price', 'raw'))} AS price, "
        f"{_encoded('at_', 'at')} FROM raw"
    )

    out["sample_pairs"] = (
        f"WITH raw AS (SELECT * FROM customer), {pairs(f'2 * {N}', '1')} SELECT pair_id, i, j FROM pr"
    )
    out["sample_trials"] = (
        f"WITH raw AS (SELECT * FROM orders), {pairs(f'4 * {N}', N)} SELECT pair_id, trial, i, j FROM pr"
    )

    def xs(names):
        return ", ".join(f'{r6(f"x{k}")} AS "{f}"' for k, f in enumerate(names))

    line_names = [c for c, _ in LINE_F]
    customer_names = [c for c, _ in CUSTOMER_F]
    customer_terms = [
        customer_names[r] if r == c else f"{customer_names[r]} x {customer_names[c]}"
        for r in range(3) for c in range(r + 1)
    ]
    out["feature_dist"] = (
        f"WITH {LINES}, {pairs(N, N)}, {distances(LINE_F)} SELECT pair_id, i, j, {xs(line_names)} FROM ds"
    )
    out["interactions"] = (
        f"WITH {CUSTOMERS}, {pairs(f'2 * {N}', '1')}, {distances(CUSTOMER_F, None, True)} "
        f"SELECT pair_id, {xs(customer_terms)} FROM ds"
    )
    missing_f = [("quality", True), ("toxic", False), ("n_chars", True)]
    out["missing_fill"] = (
        f"WITH {stimuli(LABELLED_ROWS, missing_f, None)}, {pairs(f'2 * {N}', '1')}, "
        f"{distances(missing_f, fill=1.0)} SELECT pair_id, {xs(['quality', 'toxic', 'n_chars'])} FROM ds"
    )
    raw_f = [("u", True), ("v", True)]
    raw_rows = "SELECT p_partkey AS sid, p_size / 40::DOUBLE AS u, p_retailprice / 1000 AS v FROM part"
    out["raw_features"] = (
        f"WITH {stimuli(raw_rows, raw_f, None, scale=False)}, {pairs(f'2 * {N}', '1')}, {distances(raw_f)} "
        f"SELECT pair_id, {xs(['feature_0', 'feature_1'])} FROM ds"
    )

    def dist(st, feats, d, per_row):
        return (
            f"WITH {st}, {pairs(f'{per_row} * {N}', '1')}, {distances(feats, d)} "
            f"SELECT pair_id, {r6('d')} AS d FROM ds"
        )

    out["euclidean"] = dist(VECTORS, VECTOR_F, L2, 4)
    for mode in MODES:
        out[f"feature_dist_{mode}"] = out["feature_dist"]
        out[f"euclidean_{mode}"] = out["euclidean"]
    out["manhattan"] = dist(VECTORS, VECTOR_F, L1, 4)
    out["cosine"] = dist(VECTORS, VECTOR_F, COS, 4)
    out["norm_diff"] = dist(PARTS, PART_F, NORM_DIFF, 2)
    out["custom_distance"] = dist(VECTORS, VECTOR_F, LARGEST, 4)
    out["scalar_target"] = dist(CUSTOMERS, CUSTOMER_F, L2, 2)
    nested = stimuli(
        "SELECT p_partkey AS sid, * FROM part", [("p_type", False)],
        "[p_size::DOUBLE, p_retailprice, p_retailprice / 10]::DOUBLE[]",
    )
    out["nested_target"] = dist(nested, [("p_type", False)], L1, 2)

    out["precomputed"] = (
        f"WITH {listed(LISTED_N, LISTED_N, interactions=True)} SELECT pair_id, i, j, "
        f"{xs(['gap', 'mismatch x gap', 'mismatch'])}, {r6('d')} AS d FROM ds"
    )
    out["minmax_square"] = (
        f"WITH {VECTORS}, {pairs(f'4 * {N}', f'4 * {N}')}, {distances(VECTOR_F, L2)}, "
        "lim AS (SELECT min(d) AS m, max(d) AS mm FROM ds) "
        f"SELECT pair_id, {r6('pow((d - m) / (mm - m + 1e-8), 2)')} AS s FROM ds, lim"
    )
    out["running_minmax"] = (
        f"WITH {PARTS}, {pairs(f'8 * {N}', N)}, {distances(PART_F, L2)}, "
        "per AS (SELECT trial, min(d) AS m, max(d) AS mm FROM ds GROUP BY trial), "
        "run AS (SELECT trial, min(m) OVER w AS m, max(mm) OVER w AS mm FROM per "
        "WINDOW w AS (ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) "
        f"SELECT pair_id, trial, {r6('pow((d - m) / (mm - m + 1e-8), 2)')} AS s FROM ds JOIN run USING (trial)"
    )

    trials4 = _planted_pairs(f"4 * {N}", N)
    out["pearson_eps"] = (
        f"WITH {trials4} SELECT trial, {r6(corr_eps('x0', 'd'))} AS balance, {r6(corr_eps('x1', 'd'))} AS segment, "
        f"{r6(corr_eps('x0 * 0.0', 'd'))} AS constant FROM ds GROUP BY trial"
    )
    out["pearson_plain"] = (
        f"WITH {DESCRIBED}, {pairs(f'4 * {N}', N)}, {distances(DESCRIBED_F, L2)} SELECT trial, "
        + ", ".join(f"{r6(f'corr(x{k}, d)')} AS {c}" for k, c in enumerate(["lang", "source", "n_chars"]))
        + " FROM ds GROUP BY trial"
    )
    corrs = (
        f"WITH {LINES}, {pairs(f'4 * {N}', N)}, {distances(LINE_F)}, "
        f"cr AS (SELECT trial, unnest([{_corr_list(5)}], recursive := true) FROM ds GROUP BY trial)"
    )
    out["feature_corr"] = f"{corrs} SELECT trial, a, b, {r6('corr')} AS corr FROM cr"
    out["corr_std"] = (
        f"{corrs}, pf AS (SELECT a, b, stddev_samp(corr) AS sd, avg(corr) AS mean FROM cr GROUP BY a, b) "
        f"SELECT {r6('max(sd)')} AS max_std, {r6('max(abs(mean))')} AS max_corr FROM pf"
    )

    exact_f = [("n_chars", True), ("lang", False), ("quality", True), ("toxic", False)]
    every = "nn AS (SELECT 0), pr AS (SELECT 0 AS pair_id, 0 AS trial, a.sid AS i, b.sid AS j FROM st a, st b)"
    cells4 = [(a, b) for a in range(4) for b in range(a + 1)]
    out["exact_feature_cov"] = (
        f"WITH {stimuli(LABELLED_ROWS, exact_f, None)}, {every}, {distances(exact_f, fill=0.5)}, "
        "al AS (SELECT " + ", ".join(
            [f"avg(x{a}) AS m{a}" for a in range(4)]
            + [f"covar_pop(x{a}, x{b}) AS c{a}{b}, corr(x{a}, x{b}) AS r{a}{b}" for a, b in cells4]
        ) + " FROM ds) " + " UNION ALL ".join(
            f"SELECT '{exact_f[a][0]}' AS a, '{exact_f[b][0]}' AS b, {r6(f'm{a}')} AS mean, {r6(f'c{a}{b}')} AS cov, "
            f"{r6(f'r{a}{b}')} AS corr FROM al" for a, b in cells4
        )
    )

    out["spearman_ordinal"] = _spearman(
        f"{DESCRIBED}, {pairs(f'8 * {N}', f'8 * {N}')}, {distances(DESCRIBED_F, COS)}",
        weighted(WEIGHTS_3), "ordinal",
    )
    out["spearman_average"] = _spearman(trials4, weighted(WEIGHTS_3), "average")
    out["spearman_batched"] = _spearman(_planted_pairs(f"8 * {N}", N), weighted(WEIGHTS_3), "ordinal")
    soft = f"v AS (SELECT trial, pair_id, d, {weighted(WEIGHTS_3)} AS p FROM ds)"
    out["soft_rank_affine"] = (
        f"WITH {trials4}, {soft} SELECT trial, pair_id, "
        f"{r6('p - avg(p) OVER (PARTITION BY trial) + (count(*) OVER (PARTITION BY trial) + 1) / 2.0')} AS soft FROM v"
    )
    # The fit at a place is the largest, over the stretches' ends, of the least mean over their starts.
    out["soft_rank_wide"] = (
        f"WITH {_planted_pairs(f'2 * {N}', N)}, v AS (SELECT trial, pair_id, ({weighted(WEIGHTS_3)}) * n AS p, n FROM ds, nn), "
        "o AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY p DESC, pair_id) - 1 AS k FROM v), "
        "t AS (SELECT *, sum(p - (n - k)) OVER (PARTITION BY trial ORDER BY k) AS upto, p - (n - k) AS own FROM o), "
        "m AS (SELECT a.trial, a.k, b.k AS e, min((b.upto - a.upto + a.own) / (b.k - a.k + 1)) "
        "OVER (PARTITION BY a.trial, b.k ORDER BY a.k) AS least FROM t a JOIN t b ON a.trial = b.trial AND a.k <= b.k), "
        "f AS (SELECT trial, k, max(least) AS fit FROM m GROUP BY trial, k) "
        f"SELECT trial, pair_id, {r6('p - fit')} AS soft FROM t JOIN f USING (trial, k)"
    )
    out["spearman_soft"] = (
        f"WITH {trials4}, {soft}, per AS (SELECT trial, min(d) AS m, max(d) AS mm FROM ds GROUP BY trial), "
        "run AS (SELECT trial, min(m) OVER w AS m, max(mm) OVER w AS mm FROM per "
        "WINDOW w AS (ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) "
        f"SELECT trial, {r6('corr(p, pow((d - m) / (mm - m + 1e-8), 2))')} AS spearman "
        "FROM v JOIN run USING (trial) GROUP BY trial"
    )

    by_size = (
        f"WITH RECURSIVE {LINES}, nn AS (SELECT {N} AS n), "
        "sz(b) AS (SELECT 256::BIGINT UNION ALL SELECT b * 2 FROM sz, nn WHERE b * 2 < n), "
        "ids AS (SELECT t * n + k AS pair_id, t AS trial, k FROM (SELECT unnest(range(4)) AS t), "
        "(SELECT unnest(range((SELECT max(b) FROM sz))) AS k), nn), "
        f"pr AS (SELECT pair_id, trial, k, ha % n AS i, hb % n AS j FROM {drawn('ids')}, nn), "
        f"{distances(LINE_F).replace('pair_id, trial, i, j,', 'pair_id, trial, k, i, j,')}, "
        f"cr AS (SELECT b AS size, trial, unnest([{_corr_list(5)}], recursive := true) "
        "FROM ds JOIN sz ON k < sz.b GROUP BY sz.b, trial), "
        "pf AS (SELECT size, a, b, stddev_samp(corr) AS sd, avg(corr) AS mean FROM cr GROUP BY size, a, b) "
    )
    out["batch_size"] = (
        by_size + f"SELECT size AS batch_size, {r6('max(sd)')} AS max_std, {r6('max(abs(mean))')} AS max_corr "
        "FROM pf GROUP BY size"
    )

    out["chosen_batch_size"] = by_size.rstrip() + (
        ", stable AS (SELECT size, max(sd) AS m FROM pf GROUP BY size) "
        f"SELECT coalesce(min(size) FILTER (WHERE m < {CHOSEN_THRESHOLD}), (SELECT max(b) * 2 FROM sz))::BIGINT AS batch_size FROM stable"
    )

    fit_stream = f"{SEED}:fit"
    out["fit_two_features"] = (
        f"WITH {_planted_pairs(f'8 * {N}', N, p=2, stream=fit_stream)}, {_moments(2)}, {_TWO} "
        + _weights_out(["f1", "f2"])
    )
    out["fit_weights"] = (
        f"WITH {_planted_pairs(f'8 * {N}', N, stream=fit_stream)}, {_moments(3)}, {_cramer(3)} "
        + _weights_out(["f1", "f2", "f3"])
    )
    eight = f"8 * {LISTED_N}"
    cells = [("gap", "gap"), ("mismatch", "gap"), ("mismatch", "mismatch")]
    out["fit_interactions"] = (
        f"WITH {listed(eight, LISTED_N, fit_stream, True)}, {_moments(3)}, {_cramer(3)} "
        + " UNION ALL ".join(
            f"SELECT '{r}' AS row_feature, '{c}' AS col_feature, "
            f"{r6(f'w{k} / sqrt(w0 * w0 + 2 * w1 * w1 + w2 * w2)')} AS weight FROM w"
            for k, (r, c) in enumerate(cells)
        )
    )
    length = "sqrt(w0 * w0 + 2 * w1 * w1 + w2 * w2)"
    out["square_weights"] = (
        f"WITH {listed(eight, LISTED_N, fit_stream, True)}, {_moments(3)}, {_cramer(3)} "
        f"SELECT 'gap' AS row_feature, {r6(f'w0 / {length}')} AS gap, NULL::DOUBLE AS mismatch FROM w UNION ALL "
        f"SELECT 'mismatch', {r6(f'w1 / {length}')}, {r6(f'w2 / {length}')} FROM w"
    )
    out["fit_precomputed"] = (
        f"WITH {listed(eight, LISTED_N, fit_stream)}, {_moments(2)}, {_TWO} "
        + _weights_out(["gap", "mismatch"])
    )
    for name, more in (("fit_steps", {}), ("fit_steps_decay", DECAYED)):
        start = np.random.default_rng(SEED).uniform(0.0, 1.0, 4).tolist()
        ctes = adam_steps(
            _planted_pairs(f"{STEPS} * {N}", N, p=4, stream=fit_stream), start, STEPS,
            more.get("lr", 0.1), more.get("weight_decay", 0.0), more.get("patience", 50),
        )
        out[name] = f"WITH RECURSIVE {ctes} " + " UNION ALL ".join(
            f"SELECT 'f{k + 1}' AS feature, {r6(f'b{k}')} AS weight FROM best" for k in range(4)
        )
    out["fit_offset"] = (
        f"WITH {listed(eight, LISTED_N, fit_stream, offset=OFFSET)}, {_moments(2)}, {_TWO} "
        + _weights_out(["gap", "mismatch"])
    )
    out["predict"] = (
        f"WITH {LINES}, {pairs(N, N)}, {distances(LINE_F)} "
        f"SELECT pair_id, {r6(weighted(WEIGHTS_5))} AS prediction FROM ds"
    )

    out["permutation"] = (
        f"WITH {CUSTOMERS}, {pairs(f'4 * {N}', N)}, {distances(CUSTOMER_F)}, "
        f"pe AS (SELECT trial, x0 AS moved, row_number() OVER (PARTITION BY trial ORDER BY "
        f"{h48(STREAM + ':p:', 'pair_id')}, pair_id) - 1 AS slot FROM ds) "
        f"SELECT ds.trial, pair_id, {r6('x0')} AS v, {r6('moved')} AS moved FROM ds "
        f"JOIN pe ON pe.trial = ds.trial AND pe.slot = pair_id % {N}"
    )
    names3 = ["f1", "f2", "f3"]
    terms3 = ["f1", "f2 x f1", "f2", "f3 x f1", "f3 x f2", "f3"]
    main = _planted_pairs(f"6 * 2 * {N}", f"2 * {N}")
    out["pfi_literal_weights"] = pfi(main, WEIGHTS_3, names3, f"2 * {N}", 2)
    out["pfi_lines"] = pfi(
        f"{LINES}, {pairs(f'5 * {N}', N)}, {distances(LINE_F, L1)}", WEIGHTS_5, line_names, N, 1
    )
    out["pfi_interactions"] = pfi(
        _planted_pairs(f"12 * {N}", N, interactions=True), WEIGHTS_TERMS, terms3, N, 2
    )
    out["pfi_precomputed"] = pfi(
        listed(f"4 * {LISTED_N}", LISTED_N), (0.9, 0.4), ["gap", "mismatch"], LISTED_N, 2
    )
    held = _held(f"{h48(f'{SEED}:split:', 'sid')} % 100 >= 75")
    out["pfi_holdout"] = pfi(
        _planted_pairs(f"6 * 2 * {N}", f"2 * {N}", rows=held), WEIGHTS_3, names3, f"2 * {N}", 2
    )
    folds = []
    for f in range(3):
        rows = _held(f"{h48(f'{SEED}:fold:', 'sid')} % 3 = {f}")
        body = pfi_ctes(
            _planted_pairs(f"3 * 2 * {N}", f"2 * {N}", rows=rows), WEIGHTS_3, names3, f"2 * {N}", 1
        )
        folds.append(f"SELECT {f} AS split, * FROM (WITH {body} SELECT {PFI_OUT} FROM im)")
    out["pfi_kfold"] = " UNION ALL ".join(folds)
    out["importances_wide"] = (
        f"WITH {pfi_ctes(main, WEIGHTS_3, names3, f'2 * {N}', 2)} SELECT permutation, "
        + ", ".join(f"{r6(f'max(CASE WHEN feature = {chr(39)}{f}{chr(39)} THEN importance END)')} AS {f}" for f in names3)
        + " FROM im GROUP BY permutation"
    )
    spread = pfi_ctes(_planted_pairs(f"9 * {N}", N, NORM_DIFF), WEIGHTS_3, names3, N, 3)
    out["score_spread"] = (
        f"WITH {spread} SELECT count(baseline) AS n, {r6('stddev_samp(baseline)')} AS sd FROM im"
    )
    out["fit_and_score"] = fit_and_score(PLANTED_ROWS, PLANTED_ROWS, 5)
    bucket = h48(f"{SEED}:split:", "sid")
    out["fit_and_score_holdout"] = fit_and_score(
        _held(f"{bucket} % 100 < 75"), _held(f"{bucket} % 100 >= 75"), 2
    )
    bucket = h48(f"{SEED}:fold:", "sid")
    out["fit_and_score_kfold"] = " UNION ALL ".join(
        f"SELECT {f} AS split, * FROM ("
        + fit_and_score(_held(f"{bucket} % 3 <> {f}"), _held(f"{bucket} % 3 = {f}"), 1)
        + ")"
        for f in range(3)
    )
    # Pairs over all rows: 8 * (3 / 2) ** 2 a row, so that 8 a row are left within two folds of three.
    out["fit_and_score_folds"] = " UNION ALL ".join(
        f"SELECT {f} AS split, * FROM ("
        + fit_and_score(PLANTED_ROWS, _held(f"{bucket} % 3 = {f}"), 1, 18, f"{bucket} % 3 <> {f}")
        + ")"
        for f in range(3)
    )
    out["fit_many"] = " UNION ALL ".join(
        f"SELECT '{name}' AS target, * FROM (WITH {_planted_pairs(f'8 * {N}', N, rows=rows, stream=fit_stream)}, "
        f"{_moments(3)}, {_bounded_squares(3)} {_weights_out(['f1', 'f2', 'f3'])})"
        for name, rows in (("planted", PLANTED_ROWS), ("second", SECOND_ROWS))
    )
    out["fit_zero_weight"] = (
        f"WITH {bounded(eight, LISTED_N, fit_stream)}, {_moments(3)}, {_bounded_squares(3)} "
        + _weights_out(["gap", "mismatch", "nation"])
    )
    out["fit_edge"] = (
        f"WITH {listed(eight, LISTED_N, fit_stream, True, weights=OUTSIDE)}, {_moments(3)}, {_edge()} "
        + " UNION ALL ".join(
            f"SELECT '{r}' AS row_feature, '{c}' AS col_feature, {r6(f'w{k}')} AS weight FROM w"
            for k, (r, c) in enumerate(cells)
        )
    )
    out["train_test"] = (
        f"SELECT o_orderkey, CASE WHEN {h48(f'{SEED}:split:', 'o_orderkey')} % 100 < 75 THEN 'train' ELSE 'test' END "
        "AS side FROM orders"
    )
    out["folds"] = f"SELECT o_orderkey, ({h48(f'{SEED}:fold:', 'o_orderkey')} % 5)::INT AS fold FROM orders"
    return out


ORACLES = build()
