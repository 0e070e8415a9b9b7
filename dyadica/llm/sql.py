"""SQL for the registered queries of this package that SQL can express."""

from dyadica.llm.ranked import LENGTH_BASE, LENGTH_FACTOR, LENGTH_SHARE, TF_FACTOR, TF_UNIT, WEIGHT_UNIT
from dyadica.llm.sketch import FRACTION, HASH_DIGITS, SHINGLE_WORDS, threshold

SPACE = r"[\x20\x09-\x0D]+"


def _shingles(text: str) -> str:
    flat = f"trim(regexp_replace({text}, '{SPACE}', ' ', 'g'), ' ')"
    return f"""(SELECT CASE WHEN f = '' THEN []::VARCHAR[]
        WHEN len(w) < {SHINGLE_WORDS} THEN [f]
        ELSE list_transform(range(1, len(w) - {SHINGLE_WORDS - 2}),
            lambda i: array_to_string(list_slice(w, i, i + {SHINGLE_WORDS - 1}), ' ')) END
        FROM (SELECT f, string_split(f, ' ') AS w FROM (SELECT {flat} AS f)))"""


def _sketch(text: str) -> str:
    return f"""(SELECT list_sort(list_distinct(list_filter(h, lambda x: x < '{threshold()}' OR x = list_min(h))))
        FROM (SELECT list_transform({_shingles(text)}, lambda s: left(md5(s), {HASH_DIGITS})) AS h))"""


def _likeness(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"""CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE
        ELSE {both}::DOUBLE / (len({a}) + len({b}) - {both}) END"""


assert FRACTION > 1

TERM = r"[0-9a-z\x{80}-\x{10FFFF}]+"


def _terms(text: str) -> str:
    low = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({low}, '{TERM}')"


ORACLES: dict[str, str] = {
    "op3_sketch": f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    s AS (SELECT doc_id, t, length(t) AS n, {_sketch('t')} AS sk FROM d),
    f AS (SELECT *, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nt,
            coalesce(lead(sk) OVER w, first_value(sk) OVER w) AS nsk
          FROM s WINDOW w AS (ORDER BY doc_id DESC)),
    e AS (SELECT *, left(t, n - n // 3) || left(nt, n // 3) AS et FROM f),
    g AS (SELECT *, {_sketch('et')} AS esk FROM e)
    SELECT doc_id, n::BIGINT AS n_chars, sha256(et) AS edited_sha256,
        array_to_string(sk, '') AS fingerprint, array_to_string(esk, '') AS edited_fingerprint,
        {_likeness('sk', 'esk')} AS near_edited, {_likeness('sk', 'nsk')} AS near_next,
        CASE WHEN len(esk) = 0 THEN 1.0::DOUBLE
            ELSE len(list_intersect(esk, sk))::DOUBLE / len(esk) END AS edited_contained
    FROM g""",
    "op12_ranked": f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_terms('text')} AS terms FROM documents),
    held AS (SELECT r, doc_id, len(terms) AS n, terms FROM d WHERE len(terms) > 0),
    totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM held),
    q AS (SELECT row_number() OVER () AS i, item_id, {_terms('text')} AS terms FROM benchmark),
    qt AS (SELECT DISTINCT i, item_id, unnest(terms) AS term FROM q),
    tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM held)
        WHERE term IN (SELECT term FROM qt) GROUP BY r, term),
    w AS (SELECT term, floor({WEIGHT_UNIT} * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
        FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals),
    m AS (SELECT r, doc_id, {LENGTH_BASE} + ({LENGTH_SHARE} * n * docs) // words AS m FROM held, totals),
    scores AS (SELECT i, any_value(item_id) AS item_id, any_value(doc_id) AS doc_id,
            sum(w * (({TF_UNIT} * tf) // ({TF_FACTOR} * tf + {LENGTH_FACTOR} * m)))::BIGINT AS score
        FROM qt JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY i, r),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank
        FROM scores WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
}
