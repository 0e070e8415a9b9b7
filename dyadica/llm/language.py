"""Language of web pages by fusing evidence.

Four kinds of evidence are combined as if independent given the language: the likelihood of the
text by letter trigrams, the language that the markup declares, the suffix of the address, and a
prior of the host. The trigram model is fitted on labelled documents. The chances of a declaration
and of a suffix given a language come from counts over all pages, weighted by what the text alone
says and pulled to their chance whatever the language. The host's prior is smoothed in steps: all pages, then the registered domain, then the host,
each pulled to the level above; a page does not count towards its own prior. All counts are
grouped aggregations; pages are read once.

Rows: null and empty pages have no text evidence and go by the rest. A null or malformed address
has an empty host and suffix; a missing declaration is a value of its own. Pages are read whole:
text in menus, headers and the like counts for less, unless it is the larger part of the page, as
where all of it lies in a form; scripts and styles are no text.
Repeated rows count as pages of their own. An empty table gives no rows; without labelled
documents the language is null and the confidence 0.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dyadica.llm.common import map_arrow, slices, texts_of, with_fields
from dyadica.llm.wordhash import mix
from dyadica.session import materialize

# About so many labelled documents of each language fit the trigram model, all where there are
# fewer. The model has SLOTS numbers a language.
LANGUAGE_DOCUMENTS = 20_000
SLOTS = 1 << 14
# What a trigram of a menu or the like counts, beside one of running text.
ASIDE_WEIGHT = 0.2
# Trigrams of running text overlap: this share of their log likelihood counts.
TEMPER = 0.25
ADD = 0.5
# Pages that a level counts for against the level below it.
STRENGTH = 4.0
LEAST_LETTERS = 40
CHUNK_BYTES = 4 * 1024 * 1024

TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>")
LANG = re.compile(r"""\blang\s*=\s*["']?\s*([a-zA-Z]{2,3})""")
LETTERS = re.compile(r"[^\W\d_]+")
# Elements that hold no running text of the page.
ASIDE = {"script", "style", "nav", "footer", "header", "aside", "form", "noscript", "template", "svg"}
VOID = {"br", "img", "hr", "input", "meta", "link"}
ADVERT = re.compile(r"""\b(?:class|id)\s*=\s*["']?[^"']*\b(?:ads?|advert|banner|cookie|promo|sidebar|menu)\b""")
# Second levels under which domains are registered.
SECOND_LEVEL = {"co", "com", "org", "net", "ac", "gov", "edu"}


def read_parts(page: str) -> tuple[str, str, str]:
    """The running text of a page, its text in menus, headers and the like, and the language that
    its markup declares (or empty)."""
    declared = ""
    running, aside = [], []
    closes: str | None = None
    depth = at = 0
    for m in TAG.finditer(page):
        text = page[at : m.start()]
        if text and closes not in ("script", "style"):
            (running if closes is None else aside).append(text)
        at = m.end()
        name = m.group(2).lower()
        if name == "html" and not m.group(1) and not declared:
            found = LANG.search(m.group(3))
            declared = found.group(1).lower() if found else ""
        if closes is None:
            if not m.group(1) and name not in VOID and (name in ASIDE or name in ("div", "section", "ul") and ADVERT.search(m.group(3))):
                closes, depth = name, 1
        elif name == closes:
            depth += -1 if m.group(1) else 1
            if depth == 0:
                closes = None
        running.append(" ")
        aside.append(" ")
    if closes not in ("script", "style"):
        (running if closes is None else aside).append(page[at:])
    return html.unescape("".join(running)), html.unescape("".join(aside)), declared


def letters_in(text: str) -> int:
    return sum(map(len, LETTERS.findall(text)))


def read_page(page: str) -> tuple[str, str]:
    """The text of a page that counts in full, and the language its markup declares (or empty)."""
    return weighed_parts(page)[::2]


def weighed_parts(page: str) -> tuple[str, str, str]:
    """The text that counts in full, the text that counts for less, and the declared language.

    All text counts in full where the running text has next to no letters, or fewer than the rest.
    """
    running, aside, declared = read_parts(page)
    if letters_in(running) < max(LEAST_LETTERS, letters_in(aside)):
        return " ".join(filter(None, (running, aside))), "", declared
    return running, aside, declared


def slots_of(text: str) -> np.ndarray:
    """The slots of a text's letter trigrams, words parted by one space."""
    letters = " " + " ".join(LETTERS.findall(text.lower())) + " "
    codes = np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(codes) < 3:
        return np.zeros(0, dtype=np.int64)
    grams = (codes[:-2] << np.uint64(42)) ^ (codes[1:-1] << np.uint64(21)) ^ codes[2:]
    return (mix(grams) & np.uint64(SLOTS - 1)).astype(np.int64)


def fit_trigrams(docs: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """Languages and log chances of slots (languages x SLOTS), from labelled documents."""
    docs = docs.filter(F.col(lang).isNotNull())
    # One row a language.
    sizes = docs.groupBy(F.col(lang).alias("_lang")).agg(F.count("*").alias("_n")).collect()
    # Languages of more documents than wanted are thinned, each by its own step.
    steps = {r["_lang"]: -(-r["_n"] // LANGUAGE_DOCUMENTS) for r in sizes}
    if not steps:
        return [], np.full((0, SLOTS), ADD)
    step = F.create_map(*[F.lit(x) for pair in steps.items() for x in pair])[F.col(lang)]
    sample = docs.filter(F.pmod(F.xxhash64(id, text), step) == 0)

    def run(batch: pa.RecordBatch) -> dict:
        totals: dict[str, np.ndarray] = {}
        for part in slices(batch, "text", CHUNK_BYTES):
            for t, name in zip(texts_of(part, "text"), part.column(1).to_pylist(), strict=True):
                counts = np.bincount(slots_of(t), minlength=SLOTS)
                totals[name] = totals[name] + counts if name in totals else counts
        names, slots, counts = [], [], []
        for name, c in totals.items():
            at = np.flatnonzero(c)
            names += [name] * len(at)
            slots.append(at)
            counts.append(c[at])
        if not names:
            return None
        return {"lang": names, "slot": np.concatenate(slots), "n": np.concatenate(counts)}

    rows = map_arrow(sample.select(F.col(text).alias("text"), F.col(lang).alias("lang")), run, "lang string, slot int, n long")
    counts = rows.groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    # At most SLOTS numbers a language.
    found = counts.groupBy("lang").agg(F.collect_list("slot").alias("slots"), F.collect_list("n").alias("n")).toArrow()
    languages = sorted(found.column("lang").to_pylist())
    table = np.full((len(languages), SLOTS), ADD)
    for name, slots, n in zip(found.column("lang").to_pylist(), found.column("slots"), found.column("n")):
        table[languages.index(name), np.asarray(slots.values)] += np.asarray(n.values)
    return languages, np.log(table / table.sum(axis=1, keepdims=True)) if languages else table


def address_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, registered domain and suffix of an address; empty where there is none."""
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))
    labels = F.split(host, r"\.")
    size = F.size(labels)
    second = F.get(labels, size - 2).isin(*SECOND_LEVEL) & (F.length(F.get(labels, size - 1)) == 2)
    depth = F.when(second, 3).otherwise(2)
    domain = F.substring_index(host, ".", -2)
    domain = F.when(depth == 3, F.substring_index(host, ".", -3)).otherwise(domain)
    return host, domain, F.substring_index(host, ".", -1)


def _added(column: str, n: int) -> Column:
    return F.array(*[F.sum(F.get(column, F.lit(k))) for k in range(n)])


def identify(pages: DataFrame, languages: list[str], chances: np.ndarray, keep: list[str], url: str = "url", page: str = "html") -> DataFrame:
    """``keep``; lang and its confidence; what the text alone says, what is declared; host."""
    n = len(languages)
    host, domain, suffix = address_parts(F.col(url))
    kept = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)]
    if not n:
        return pages.select(
            *[F.col(f"`{c}`") for c in keep], F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"),
            F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("declared"), host.alias("host"))
    held = pages.sparkSession.sparkContext.broadcast(chances)  # SLOTS numbers a language
    picked = pages.select(*kept, host.alias("host"), domain.alias("domain"), suffix.alias("suffix"), F.col(page).alias("_page"))
    carried = picked.columns[:-1]

    def run(batch: pa.RecordBatch) -> dict:
        table = held.value
        declared, text = [], []
        for part in slices(batch, "_page", CHUNK_BYTES):
            for p in texts_of(part, "_page"):
                body, aside, said = weighed_parts(p)
                declared.append(said)
                z = np.zeros(n)
                for part_of_page, weight in ((body, TEMPER), (aside, TEMPER * ASIDE_WEIGHT)):
                    if len(at := slots_of(part_of_page)):
                        z += weight * table[:, at].sum(axis=1)
                text.append(z - z.max())
        return {"declared": declared, "text": text} | {c: batch.column(k) for k, c in enumerate(carried)}

    rows = map_arrow(picked, run, with_fields(picked, carried, "declared string, text array<double>"))
    # What the text alone says, as chances, and as votes.
    raw = F.transform("text", lambda z: F.exp(z))
    rows = rows.withColumn("_raw", raw).withColumn("_sum", F.aggregate("_raw", F.lit(0.0), lambda a, x: a + x))
    rows = rows.withColumn("by_text", F.transform("_raw", lambda x: x / F.col("_sum"))).drop("_raw", "_sum")
    # A page whose text says nothing has no vote, one whose text is sure has a whole one.
    sure = (n * F.array_max("by_text") - 1) / (n - 1) if n > 1 else F.lit(1.0)
    rows = rows.withColumn("vote", sure).withColumn("votes", F.transform("by_text", lambda x: x * F.col("vote")))
    rows = materialize(rows.drop("by_text"))

    hosts = rows.groupBy("host", "domain").agg(_added("votes", n).alias("at_host"), F.sum("vote").alias("n_host"))
    hosts = materialize(hosts)
    domains = hosts.groupBy("domain").agg(_added("at_host", n).alias("at_domain"), F.sum("n_host").alias("n_domain"))
    declarations = rows.groupBy("declared").agg(_added("votes", n).alias("by"))
    suffixes = hosts.withColumn("suffix", F.substring_index("host", ".", -1)).groupBy("suffix").agg(_added("at_host", n).alias("by"))
    overall = hosts.agg(_added("at_host", n).alias("all")).first()
    total = np.array([float(x or 0.0) for x in overall["all"]])
    prior = (total + ADD) / (total.sum() + ADD * n)
    everything = max(float(total.sum()), 1.0)

    def given(df: DataFrame, name: str) -> DataFrame:
        """Chance of a declaration, or of a suffix, given each language: counts over all pages,
        pulled to the chance whatever the language."""
        own = [F.get("by", F.lit(k)) for k in range(n)]
        share = sum(own[1:], own[0]) / everything + 1e-9
        per = F.array(*[F.log((own[k] + STRENGTH * share) / F.lit(float(total[k]) + STRENGTH)) for k in range(n)])
        return df.select(name, per.alias(f"log_{name}"))

    known = hosts.join(domains, "domain").withColumn("suffix", F.substring_index("host", ".", -1)).join(given(suffixes, "suffix"), "suffix").drop("suffix", "domain")
    # Declarations have two or three ASCII letters: at most 18,253 rows of a number a language.
    said = F.broadcast(given(declarations, "declared"))
    fused = rows.drop("domain", "suffix").join(known, "host").join(said, "declared")

    def posterior(k: int) -> Column:
        own = F.get("votes", F.lit(k))
        at = F.lit(k)
        base = F.lit(float(prior[k]))
        in_domain = (F.get("at_domain", at) - own + STRENGTH * base) / (F.col("n_domain") - F.col("vote") + STRENGTH)
        in_host = (F.get("at_host", at) - own + STRENGTH * in_domain) / (F.col("n_host") - F.col("vote") + STRENGTH)
        return F.get("text", at) + F.get("log_declared", at) + F.get("log_suffix", at) + F.log(F.greatest(in_host, F.lit(1e-12)))

    names = F.array(*[F.lit(x) for x in languages])
    best = lambda c: F.get(names, (F.array_position(c, F.array_max(c)) - 1).cast("int"))
    fused = fused.withColumn("_log", F.array(*[posterior(k) for k in range(n)]))
    fused = fused.withColumn("_top", F.array_max("_log"))
    spread = F.aggregate("_log", F.lit(0.0), lambda a, z: a + F.exp(z - F.col("_top")))
    return fused.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], best(F.col("_log")).alias("lang"),
        (1.0 / spread).alias("confidence"), best(F.col("text")).alias("text_lang"), "declared", "host",
    )
