"""Mix sources to token targets by entropy balancing, from DataFrame operations alone.

A document may be taken 0, 1 or 2 times. Before balancing its copies follow the binomial law of
two fair draws, of mean 1. Among all laws that meet each source's token target, the one closest
to it in relative entropy tilts it exponentially: the mean copies of a document of size ``z`` (in
mean sizes of its source) become ``2 / (1 + exp(-lambda z))``. The dual in the lambdas is convex
and parts by source. Newton steps on it are taken for all sources at once, each by one grouped
sum over the counts of (source, size), and are kept inside a bracket that every step narrows.

The mean copies are rounded by running sums: sources go from large documents to small, and a
document gets as many copies as whole numbers are passed. A source's words then miss its target by
less than its largest document. Within one size it makes no difference which documents are taken;
a hash of the row decides, in many small groups, so that no source or size is one group.

All sums that decide are of integers or decimals, so reruns agree.

Rows: a null text has size 0 and is taken once, as all documents of size 0. A null source is a
source of its own, last in order. Repeated rows are documents of their own. No document exceeds
two copies. An empty table gives an empty mix.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window, functions as F

from dyadica.llm.common import WORD_CHARS
from dyadica.session import materialize

# Weights of the sources in order, repeating, and the share of all words taken.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
# Newton ends when every source is this close to its target, in parts of it.
TOLERANCE = 1e-9
MOST_STEPS = 60
WIDEST = 4096.0
# Mean copies are held as multiples of 1 / RATE_UNIT.
RATE_UNIT = 1 << 20
# Rows of one source and size are ranked in groups of about so many rows, at least so many groups.
GROUP_ROWS = 20_000
LEAST_GROUPS = 64

SOURCE = ["_absent", "_name"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CHARS)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame) -> DataFrame:
    """Targets of the sources (one row each, with ``source_size``), by weights that repeat in
    order of the names; none exceeds MOST_COPIES times its size, what is over goes to the rest by
    weight.

    Sources are capped in the order of their size for their weight, so the level of the rest
    follows from running sums over one row a source.
    """
    in_order = Window.orderBy(*SOURCE)
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    ranked = sizes.withColumn("_weight", F.get(weights, (F.row_number().over(in_order) - 1) % len(WEIGHTS)))
    ranked = ranked.withColumn("_cap", F.col("source_size") * float(MOST_COPIES))
    by_fill = Window.orderBy(F.col("_cap") / F.col("_weight"), *SOURCE)
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * SHARE - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    filled = ranked.withColumn("_level", left / F.sum("_weight").over(rest))
    filled = filled.withColumn("_capped", F.col("_cap") <= F.col("_level") * F.col("_weight"))
    # Once a source is below its cap, all after it are.
    level = F.min(F.when(~F.col("_capped"), F.struct((F.col("_cap") / F.col("_weight")).alias("at"), *SOURCE, "_level"))).over(everything)
    return filled.select(
        *SOURCE, "source_size",
        F.when(F.col("_capped"), F.col("_cap")).otherwise(level["_level"] * F.col("_weight")).alias("target"),
    )


def mean_copies(tilt: Column, size: Column) -> Column:
    return float(MOST_COPIES) / (1.0 + F.exp(-tilt * size))


def solve_tilts(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """The tilt of every source: safeguarded Newton on the dual, one grouped sum a step."""
    unit = counts.groupBy(*SOURCE).agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("_unit"))
    state = materialize(
        targets.join(unit, SOURCE).select(
            *SOURCE, "source_size", "target", "_unit",
            (F.col("source_size") > 0).alias("_open"),
            F.lit(0.0).alias("_tilt"), F.lit(-WIDEST).alias("_low"), F.lit(WIDEST).alias("_high"),
        )
    )
    # A source at its cap is taken twice throughout; one without words has nothing to solve.
    is_open = F.col("_open") & (F.col("target") < F.col("source_size") * float(MOST_COPIES))
    state = state.withColumn("_open", is_open)
    for _ in range(MOST_STEPS):
        z = F.col("size") / F.col("_unit")
        mean = mean_copies(F.col("_tilt"), z)
        terms = counts.join(state.filter("_open"), SOURCE).select(
            *SOURCE,
            (F.col("n") * z * mean).cast("decimal(38,12)").alias("_value"),
            (F.col("n") * z * z * mean * (1.0 - mean / MOST_COPIES)).cast("decimal(38,12)").alias("_slope"),
        )
        sums = terms.groupBy(*SOURCE).agg(F.sum("_value").cast("double").alias("_value"), F.sum("_slope").cast("double").alias("_slope"))
        over = F.col("_value") - F.col("target") / F.col("_unit")
        miss = F.abs(over) / F.greatest(F.col("target") / F.col("_unit"), F.lit(1e-300))
        low = F.when(over < 0, F.col("_tilt")).otherwise(F.col("_low"))
        high = F.when(over > 0, F.col("_tilt")).otherwise(F.col("_high"))
        step = F.when(F.col("_slope") > 0, F.col("_tilt") - over / F.col("_slope"))
        inside = step.isNotNull() & (step > low) & (step < high)
        joined = state.join(sums, SOURCE, "left").withColumn("_done", ~F.col("_open") | (miss <= TOLERANCE))
        state = materialize(
            joined.select(
                *SOURCE, "source_size", "target", "_unit", (~F.col("_done")).alias("_open"),
                F.when(F.col("_done"), F.col("_tilt")).when(inside, step).otherwise((low + high) / 2).alias("_tilt"),
                F.when(F.col("_done"), F.col("_low")).otherwise(low).alias("_low"),
                F.when(F.col("_done"), F.col("_high")).otherwise(high).alias("_high"),
            )
        )
        if state.filter("_open").isEmpty():
            break
    else:
        # Halving alone brings a bracket down to the spacing of doubles within so many steps.
        warnings.warn(f"some sources are not within {TOLERANCE} of their targets after {MOST_STEPS} steps", UserWarning, stacklevel=2)
    return state.select(*SOURCE, "source_size", "target", "_unit", "_tilt")


def mix(docs: DataFrame, keep: list[str], text: str = "text", source: str = "source") -> DataFrame:
    """``keep`` and per document: ``size``, ``source_size``, ``target``, ``mean_copies``,
    ``copies`` and ``taken`` (words, repeats counted)."""
    name = F.col(source).cast("string")
    sized = docs.select(
        *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)],
        name.isNull().alias("_absent"), F.coalesce(name, F.lit("")).alias("_name"),
        word_count(F.col(text)).alias("size"), F.xxhash64(F.col(text), *[F.col(f"`{c}`") for c in keep]).alias("_hash"),
    )
    n_rows = docs.count()
    groups = max(LEAST_GROUPS, n_rows // GROUP_ROWS)
    sized = sized.withColumn("_part", F.pmod("_hash", F.lit(groups)).cast("int"))
    # Counts of (source, size, part): integers, no text.
    parts = materialize(sized.groupBy(*SOURCE, "size", "_part").agg(F.count(F.lit(1)).alias("n")))
    counts = materialize(parts.groupBy(*SOURCE, "size").agg(F.sum("n").alias("n")))
    targets = materialize(source_targets(counts.groupBy(*SOURCE).agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))))
    tilts = solve_tilts(counts, targets)

    tilted = mean_copies(F.col("_tilt"), F.col("size") / F.col("_unit"))
    full = F.col("target") >= F.col("source_size") * float(MOST_COPIES)
    mean = F.when(F.col("size") == 0, 1.0).when(full, float(MOST_COPIES)).otherwise(tilted)
    rate = F.round(mean * RATE_UNIT).cast("bigint")
    # Running sums from the largest size down: over the sizes of a source, then over the parts of
    # a size. A source has one row a size, however many documents it has.
    down = Window.partitionBy(*SOURCE).orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    rates = counts.join(tilts, SOURCE).withColumn("_rate", rate)
    rates = rates.withColumn("_start", F.coalesce(F.sum(F.col("_rate") * F.col("n")).over(down), F.lit(0)) + RATE_UNIT // 2)
    across = Window.partitionBy(*SOURCE, "size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        parts.withColumn("_ahead", F.coalesce(F.sum("n").over(across), F.lit(0)))
        .join(rates.drop("n"), [*SOURCE, "size"])
        .select(*SOURCE, "size", "_part", "source_size", "target", "_rate",
                (F.col("_start") + F.col("_ahead") * F.col("_rate")).alias("_start"))
    )
    key = [*SOURCE, "size", "_part"]
    place = F.row_number().over(Window.partitionBy(*key).orderBy("_hash"))
    after = F.col("_start") + F.col("_place") * F.col("_rate")
    whole = lambda c: F.shiftright(c, RATE_UNIT.bit_length() - 1)  # noqa: E731  floor without rounding
    copies = whole(after) - whole(after - F.col("_rate"))
    return (
        sized.withColumn("_place", place).join(starts, key)
        .select(
            *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "size", "source_size", "target",
            (F.col("_rate") / RATE_UNIT).alias("mean_copies"), copies.cast("bigint").alias("copies"),
            (copies * F.col("size")).cast("bigint").alias("taken"),
        )
    )
