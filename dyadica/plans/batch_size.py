"""How many pairs are enough for stable feature correlations."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from dyadica.operators.correlation import prefix_correlations, stability
from dyadica.operators.moments import moment_vectors, provisional_centre
from dyadica.operators.pairs import sample_prefixes

# The first job covers all sizes up to this many pairs over all trials; each later job adds
# a few sizes, so that stopping early saves the large ones. A table that every job has to
# scan gets a larger first job.
FIRST_BLOCK_PAIRS = 1 << 18
FIRST_BLOCK_PAIRS_LARGE = 1 << 20
BLOCK_SIZES = 8
# The provisional centre comes from so many pairs; it decides digits, not results.
CENTRE_PAIRS = 4096


def candidate_sizes(smallest: int, largest: int, factor: float) -> tuple[list[int], int]:
    """Sizes to try, and the size returned when none of them is stable."""
    if not factor > 1:
        raise ValueError(f"factor must exceed 1, got {factor}")
    sizes, b = [], smallest
    while b < largest:
        sizes.append(b)
        b = max(b + 1, int(b * factor))
    return sizes, b


def size_stability(
    source, sizes: Sequence[int], n_trials: int, stride: int,
    stream: str, nan_to_num: float = 0.0,
) -> DataFrame:
    """Stability of every size from one job: (step, batch_size, max_std, max_corr).

    The sizes are nested prefixes of the same trials; trials stay independent.
    """
    n_pairs = sizes[-1] * n_trials
    pairs = sample_prefixes(source, sizes, n_trials, stride, stream)
    dist = source.distances(pairs, n_pairs, None, False, nan_to_num)
    few = pairs.filter(F.col("pair_id") < min(CENTRE_PAIRS, sizes[-1]))
    start = source.distances(few, CENTRE_PAIRS, None, False, nan_to_num)
    centre = provisional_centre(start, source.n_features, False)
    moments = moment_vectors(dist, source.n_features, by=("trial", "step"), centre=centre)
    table = stability(prefix_correlations(moments, source.n_features))
    size = F.element_at(F.array(*[F.lit(int(s)) for s in sizes]), F.col("step") + 1)
    return table.select("step", size.cast("bigint").alias("batch_size"), "max_std", "max_corr")


def _blocks(sizes: Sequence[int], n_trials: int, first_pairs: int) -> list[tuple[int, int]]:
    first = sum(s * n_trials <= first_pairs for s in sizes)
    first = min(max(first, BLOCK_SIZES), len(sizes))
    edges = [0, *range(first, len(sizes), BLOCK_SIZES), len(sizes)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def estimate_batch_size(
    source,
    batch_size_min: int = 256,
    n_trials: int = 64,
    threshold: float = 0.01,
    factor: float = 1.2,
    batch_size_max: int = 2**20,
    corr_warning_threshold: float = 0.5,
    stream: str = "0",
    nan_to_num: float = 0.0,
) -> int:
    """The smallest candidate size whose feature correlations vary little over the trials."""
    sizes, last = candidate_sizes(batch_size_min, batch_size_max, factor)
    if source.n_features < 2:
        return batch_size_min
    chosen, max_corr = None, None
    first = FIRST_BLOCK_PAIRS if source.is_small() else FIRST_BLOCK_PAIRS_LARGE
    for a, b in _blocks(sizes, n_trials, first):
        rows = size_stability(
            source, sizes[:b], n_trials, batch_size_max, stream, nan_to_num
        ).collect()
        for row in sorted(rows, key=lambda r: r["step"])[a:]:
            max_corr = row["max_corr"]
            if row["max_std"] is not None and row["max_std"] < threshold:
                chosen = int(row["batch_size"])
                break
        if chosen is not None:
            break
    if max_corr is not None and max_corr > corr_warning_threshold:
        warnings.warn(
            f"Two features correlate by {max_corr:.2g}, above {corr_warning_threshold:.2g}; "
            "read their importances with care or balance the features.",
            UserWarning,
            stacklevel=2,
        )
    if chosen is None:
        warnings.warn(
            f"No size up to {batch_size_max} pairs was stable; using {last}.",
            UserWarning,
            stacklevel=2,
        )
        return last
    return chosen
