"""Threshold-scaled document sketches, from SQL functions alone.

A document's shingles are its runs of five words, joined by single spaces (the whole text where
it has fewer). A shingle is retained when its 64-bit hash, the first 16 hex digits of its md5,
lies below a fixed share ``1 / FRACTION`` of all values. The smallest hash is retained too, so
that no text with a word has an empty sketch; of two sketches, the united retained hashes
restricted below the share, with the smaller minimum, are the sketch of the united documents.
The share does not depend on a document's length, so containment of a short text in a long one
can be told from their sketches.

Rows: null and empty texts, and texts of white space, have an empty sketch, which is as like
another empty one as can be (1) and unlike any other (0). Equal texts have equal sketches.
Repeated shingles count once. Texts are taken whole.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window, functions as F

SHINGLE_WORDS = 5
# One hash in so many is retained.
FRACTION = 8
HASH_DIGITS = 16
# Documents in a block of neighbours, on average.
BLOCK_ROWS = 4000
MOST_BLOCKS = 10_000
# The rank of a null key.
LEAST = -(2**63)
# ASCII white space.
SPACE = r"[\x20\x09-\x0D]"


def threshold() -> str:
    """Hashes below this hex text are retained."""
    return format(16**HASH_DIGITS // FRACTION, f"0{HASH_DIGITS}x")


def flattened(text: Column) -> Column:
    """A text with single spaces between its words and none around it."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def word_runs(flat: Column) -> Column:
    """All runs of five words of a flattened text: each word is passed once, looking ahead."""
    return F.regexp_extract_all(flat, F.lit("(?=([^ ]++" + " [^ ]++" * (SHINGLE_WORDS - 1) + "))[^ ]++"), F.lit(1))


def hashed(runs: Column) -> Column:
    return F.transform(runs, lambda s: F.substring(F.md5(s.cast("binary")), 1, HASH_DIGITS))


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add a text's sketch, an array of hex texts in order (``name``); and the hashes below the
    threshold in the order of the text (``name_kept``) with the numbers of their runs
    (``name_at``).

    Each step is a column of its own, so that none is worked out twice.
    """
    flat, runs, hashes, at, kept = (f"{name}_{c}" for c in ("flat", "runs", "hashes", "at", "kept"))
    few = F.when(F.col(flat) != "", F.array(flat)).otherwise(F.array().cast("array<string>"))
    return (
        df.withColumn(flat, flattened(F.col(text)))
        .withColumn(runs, word_runs(F.col(flat)))
        .withColumn(hashes, hashed(F.when(F.size(runs) > 0, F.col(runs)).otherwise(few)))
        .withColumn(at, F.filter(F.sequence(F.lit(0), F.size(hashes)), lambda i: F.get(hashes, i) < threshold()))
        .withColumn(kept, F.transform(at, lambda i: F.get(hashes, i)))
        .withColumn(name, F.array_compact(F.array_append(kept, F.array_min(hashes))))
        .withColumn(name, F.array_sort(F.array_distinct(name)))
        .drop(flat, runs, hashes)
    )


def as_text(hashes: Column) -> Column:
    return F.array_join(hashes, "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two documents from their sketches."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first document's shingles that the second has."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: Column, b: Column) -> Column:
    """The sketch of two documents together, from theirs."""
    united = F.array_union(a, b)
    kept = F.filter(united, lambda h: h < threshold())
    return F.array_sort(F.array_distinct(F.array_compact(F.array_append(kept, F.array_min(united)))))


def block_of(rank: Column, cuts: list[int]) -> Column:
    """How many of the descending cuts lie above ``rank``, by a search of two levels."""
    if not cuts:
        return F.lit(0)
    width = math.isqrt(len(cuts) - 1) + 1
    groups = [cuts[k : k + width] for k in range(0, len(cuts), width)]
    lasts = F.array(*[F.lit(g[-1]) for g in groups])
    whole = F.size(F.filter(lasts, lambda c: c > rank))
    within = F.get(F.array(*[F.array(*[F.lit(c) for c in g]) for g in groups]), whole)
    return whole * width + F.coalesce(F.size(F.filter(within, lambda c: c > rank)), F.lit(0))


def key_cuts(df: DataFrame, key: str) -> tuple[list[int], dict[int, int]]:
    """Quantiles of the key, descending, that part the rows into blocks; and the keys that hold
    several blocks of rows by themselves, with how many. A null key counts as the least number."""
    sizes = df.agg(F.count(F.lit(1)), F.count(key)).first()
    n_blocks = int(max(1, min(MOST_BLOCKS, sizes[0] // BLOCK_ROWS)))
    if n_blocks == 1:
        return [], {}
    found = df.approxQuantile(key, [k / n_blocks for k in range(1, n_blocks)], 0.2 / n_blocks) if sizes[1] else []
    counts = Counter(int(c) for c in found)
    # A key that is several quantiles holds all rows between the first and the last of them.
    hot = {c: times for c, times in counts.items() if times > 1}
    absent = -(-(sizes[0] - sizes[1]) * n_blocks // sizes[0])
    if absent > 1:
        hot[LEAST] = absent
    return sorted({*counts, *hot}, reverse=True), hot


def part_of(rank: Column, tie: Column, hot: dict[int, int]) -> Column:
    """Within a block: 0, or for a key with several blocks of rows 1 and more, by descending tie."""
    if not hot:
        return F.lit(0)
    parts = F.create_map(*[F.lit(x) for pair in hot.items() for x in pair])[rank]
    # Between 0 and 1, falling as the tie rises.
    share = F.lit(0.5) - tie.cast("double") / F.lit(2.0**64)
    return F.coalesce(F.lit(1) + F.least(F.floor(share * parts), parts - 1), F.lit(0))


def edited_sketches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's sketch, and that of its text with the last third replaced by the start of
    the next document's, in descending order of the key.

    The last document's next is the first. Null keys come last; documents that share a key follow
    each other by a hash of their text. Every document is dealt once, into blocks of neighbours,
    which also part the documents of one key where they are many;
    a block also gets a copy of the document that starts the next one, so that none needs another
    block, and no window spans more than a block. Beyond MOST_BLOCKS, blocks grow with the table.
    """
    cuts, hot = key_cuts(docs.select(key), key)
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("_key"), content.alias("_text")).select(
        "*", F.coalesce(F.col("_key").cast("bigint"), F.lit(LEAST)).alias("_rank"), F.xxhash64("_text").alias("_tie")
    )
    step = max(hot.values(), default=0) + 1
    block = block_of(F.col("_rank"), cuts).cast("bigint") * step + part_of(F.col("_rank"), F.col("_tie"), hot)
    placed = rows.withColumn("_block", block)
    # One row a block: at most twice as many as there are quantiles.
    by_block = Window.orderBy("_block")
    everywhere = by_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = (
        placed.groupBy("_block").agg(F.max(F.struct("_rank", "_tie")).alias("_first"))
        .withColumn("_before", F.coalesce(F.lag("_block").over(by_block), F.max("_block").over(everywhere)))
    )
    own = F.struct(F.col("_block").alias("block"), F.lit(0).alias("copy"))
    also = F.struct(F.col("_before").alias("block"), F.lit(1).alias("copy"))
    starts = F.struct("_rank", "_tie") == F.col("_first")
    dealt = placed.join(F.broadcast(firsts), "_block").select(
        "_key", "_text", "_rank", "_tie", F.explode(F.when(starts, F.array(own, also)).otherwise(F.array(own))).alias("_to")
    )
    dealt = dealt.select("_key", "_text", "_rank", "_tie", F.col("_to.block").alias("_block"), F.col("_to.copy").alias("_copy"))
    order = Window.partitionBy("_block").orderBy("_copy", F.desc("_rank"), F.desc("_tie"))
    followed = (
        with_sketch(dealt.repartition(len(cuts) + 1 + sum(hot.values()), "_block"), "_text", "_sketch")
        .withColumn("_next_text", F.lead("_text").over(order))
        .withColumn("_next_sketch", F.lead("_sketch").over(order))
        .filter("_copy = 0")
    )
    return with_edited(followed).select(
        F.col("_key").alias(key), "n_chars",
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("_sketch")).alias("fingerprint"),
        as_text(F.col("_edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("_sketch"), F.col("_edited_sketch")).alias("near_edited"),
        likeness(F.col("_sketch"), F.col("_next_sketch")).alias("near_next"),
        containment(F.col("_edited_sketch"), F.col("_sketch")).alias("edited_contained"),
    )


def with_edited(df: DataFrame) -> DataFrame:
    """Add the edited text and its sketch.

    Runs that lie within the part that stays keep the hashes they have. The others start in its
    last five words or later: only those and the new part are hashed. Where nothing is below the
    threshold, the smallest hash is sought in the whole edited text.
    """
    n = F.length("_text")
    cut = F.floor(n / 3).cast("int")
    back = F.lit(SHINGLE_WORDS)
    out = (
        df.withColumn("n_chars", n.cast("bigint"))
        .withColumn("_stays", F.left(F.col("_text"), n - cut))
        .withColumn("_new", F.left(F.col("_next_text"), cut))
        .withColumn("_edited", F.concat("_stays", "_new"))
        .withColumn("_stays", F.ltrim(F.regexp_replace("_stays", f"{SPACE}+", " ")))
        # The last of these words may go on in the new part; runs before it are whole.
        .withColumn("_words", F.length("_stays") - F.length(F.replace(F.col("_stays"), F.lit(" "))) + 1)
        .withColumn("_whole", F.greatest(F.col("_words") - back, F.lit(0)))
        .withColumn("_tail", flattened(F.concat(F.substring_index("_stays", " ", -SHINGLE_WORDS), F.col("_new"))))
        .withColumn("_tail_runs", word_runs(F.col("_tail")))
    )
    alone = F.when((F.col("_whole") == 0) & (F.col("_tail") != ""), F.array("_tail")).otherwise(F.array().cast("array<string>"))
    out = out.withColumn("_tail_hashes", hashed(F.when(F.size("_tail_runs") > 0, F.col("_tail_runs")).otherwise(alone)))
    own = F.slice("_sketch_kept", 1, F.size(F.filter("_sketch_at", lambda i: i < F.col("_whole"))))
    out = out.withColumn("_edited_kept", F.concat(own, F.filter("_tail_hashes", lambda h: h < threshold())))
    smallest = F.when(F.size("_edited_kept") > 0, F.lit(None).cast("string")).otherwise(
        F.least(F.array_min("_tail_hashes"), F.array_min(hashed(word_runs(flattened(F.col("_edited"))))))
    )
    return out.withColumn("_edited_sketch", F.array_compact(F.array_append("_edited_kept", smallest))).withColumn(
        "_edited_sketch", F.array_sort(F.array_distinct("_edited_sketch"))
    )
