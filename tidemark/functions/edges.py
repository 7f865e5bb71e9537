"""Bucket edges and the count-of-edges-below expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bucket edges, in seconds, of the two recency presets.
RECENCY_ORIGINAL = [
    5, 10, 15, 20, 25, 30, 35, 40, 45, 50, 55, 60,
    120, 180, 240, 300, 360, 420, 480, 540, 600,
    900, 1200, 1500, 1800, 2100, 2400, 2700, 3000, 3300, 3600,
    5400, 7200, 9000, 10800, 12600, 14400, 16200, 18000, 19800, 21600,
    32400, 43200, 54000, 64800, 75600, 86400,
    172800, 259200, 345600, 432000, 518400, 604800,
    1123200, 1641600, 2160000, 2592000,
    4320000, 6048000, 7776000,
    11664000, 15552000,
    31536000,
]
RECENCY_HYBRID_V1 = [
    60, 600, 3600, 21600, 43200, 86400,
    126000, 259200, 403200, 547200, 687600, 990000,
    1148400, 1303200, 1461600, 1616400, 1778400, 1936800,
    2102400, 2271600, 2592000, 2764800, 3024000, 3196800,
    3369600, 3542400, 3715200, 3974400, 4147200, 4406400,
    4838400, 5011200, 5270400, 5529600, 5788800, 6048000,
    6307200, 6566400, 6825600, 7430400, 7776000, 8121600,
    8467200, 8726400, 9158400, 9590400, 10022400, 10540800,
    11059200, 12096000, 12787200, 13392000, 13910400,
    14342400, 14860800, 15465600, 15984000, 16588800,
    17884800, 18576000, 19440000, 20390400, 21513600,
]
PRESETS = {"original": RECENCY_ORIGINAL, "hybrid_v1": RECENCY_HYBRID_V1}
#: Gap edges: powers of two from 1 second.
GAP_EDGES = [1 << k for k in range(31)]
# Position buckets (name, first position, first position beyond).
POSITION_BUCKETS = [("pos0_10", 0, 10), ("pos10_50", 10, 50), ("pos50_100", 50, 100), ("pos100_256", 100, 256), ("pos256_plus", 256, None)]


def preset(name: str) -> list[int]:
    """Edges of a recency preset; an unknown name is an error that lists the known ones."""
    if name not in PRESETS:
        raise ValueError(f"no bucket preset {name!r}; there are {', '.join(sorted(PRESETS))}")
    return PRESETS[name]


def count_less(value: Column, edges: list[int]) -> Column:
    """How many edges are strictly below value: a balanced CASE tree, so six comparisons for 63 edges, all in generated code."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value <= F.lit(edges[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(edges))


def position_bucket(pos: Column) -> Column:
    out = F.lit(POSITION_BUCKETS[-1][0])
    for name, _, end in reversed(POSITION_BUCKETS[:-1]):
        out = F.when(pos < end, F.lit(name)).otherwise(out)
    return out
