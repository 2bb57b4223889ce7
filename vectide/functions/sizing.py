"""How many clusters, how many to probe, and when to split or merge: pure arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the sizing policy
TARGET_ROWS = 196  # rows a cluster is meant to hold
MAX_ROWS = 256  # hard cap of a cluster
MIN_BOOTSTRAP = 64  # no index below so many rows
MIN_SPLIT = 8  # no split below so many rows
RADIUS_FACTOR = 2  # sick: radius beyond so many mean radii
MERGE_FLOOR = 3
PROBE_FLOOR = 511
PROBE_DIVISOR = 32
PROBE_CEILING_DIVISOR = 4
PROBE_MIN_CEILING = 16
CLUSTER_FLOOR = 16
SPLIT_NUMERATOR, SPLIT_DENOMINATOR, MERGE_DIVISOR = 7, 5, 4
MERGE_TRIES = 16
SAMPLE_FACTOR, SAMPLE_FLOOR = 32, 4096


def round_sqrt(n: int) -> int:
    """The square root to the nearest whole number."""
    return math.floor(math.sqrt(n) + 0.5) if n > 0 else 0


def hood_k(rows: int) -> int:
    """Clusters for so many rows."""
    if rows < 1:
        return 1
    k = max(-(-rows // TARGET_ROWS), min(CLUSTER_FLOOR, round_sqrt(rows)))
    return min(max(k, 1), rows)


def default_nprobe(k: int) -> int:
    """Clusters a query reads of k; may exceed k for few clusters."""
    return max(1, min(max(PROBE_FLOOR, k // PROBE_DIVISOR), max(PROBE_MIN_CEILING, k // PROBE_CEILING_DIVISOR)))


def hood_size(rows: int) -> int:
    """Rows a cluster is meant to hold at so many rows in all."""
    return max(1, rows // hood_k(rows))


def split_above(rows: int) -> int:
    """Rows past which a cluster owes a split, at so many rows in all."""
    return hood_size(rows) * SPLIT_NUMERATOR // SPLIT_DENOMINATOR


def merge_below(rows: int) -> int:
    """Rows up to which a cluster should be merged, at so many rows in all."""
    return max(MERGE_FLOOR, hood_size(rows) // MERGE_DIVISOR)


def sample_size(k: int) -> int:
    """Rows k-means trains on."""
    return max(SAMPLE_FLOOR, SAMPLE_FACTOR * k)


def sample_size_for(k: int, dims: int, max_bytes: int) -> int:
    """The same within a budget of bytes for float32 rows, one at least; no budget if it is 0."""
    n = sample_size(k)
    return max(1, min(n, max_bytes // (4 * max(1, dims)))) if max_bytes > 0 else n


# the same as expressions over a column of row counts or cluster counts


def _half_up_sqrt(n: Column) -> Column:
    return F.floor(F.sqrt(n.cast("double")) + 0.5)


def hood_k_col(n: Column) -> Column:
    k = F.greatest(F.ceil(n.cast("double") / TARGET_ROWS).cast("long"), F.least(F.lit(CLUSTER_FLOOR).cast("long"), _half_up_sqrt(n).cast("long")))
    return F.when(n < 1, F.lit(1).cast("long")).otherwise(F.least(F.greatest(k, F.lit(1).cast("long")), n.cast("long")))


def _div(n: Column, by: int) -> Column:
    return F.floor(n.cast("long") / F.lit(by)).cast("long")


def default_nprobe_col(k: Column) -> Column:
    low = F.greatest(F.lit(PROBE_FLOOR).cast("long"), _div(k, PROBE_DIVISOR))
    high = F.greatest(F.lit(PROBE_MIN_CEILING).cast("long"), _div(k, PROBE_CEILING_DIVISOR))
    return F.greatest(F.lit(1).cast("long"), F.least(low, high))


def hood_size_col(n: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(n.cast("double") / hood_k_col(n)).cast("long"))


def split_above_col(n: Column) -> Column:
    return _div(hood_size_col(n) * SPLIT_NUMERATOR, SPLIT_DENOMINATOR)


def merge_below_col(n: Column) -> Column:
    return F.greatest(F.lit(MERGE_FLOOR).cast("long"), _div(hood_size_col(n), MERGE_DIVISOR))
