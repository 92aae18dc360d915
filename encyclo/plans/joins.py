"""Join helpers with explicit, checked broadcast decisions.

Rule of the library: a side is broadcast only when its size has a proven
bound -- either by construction (``limit(n)`` with a small ``n``, a fixed
lookup table) or by a cheap runtime check (``limit(max_rows + 1).count()``).
Everything else is left to the planner, where AQE converts a join to a
broadcast join from *measured* shuffle sizes and splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest row count the library will broadcast on its own initiative.  A row
# of a lookup side is a few dozen bytes, so this bounds a broadcast to a few
# tens of MB per executor.
MAX_BROADCAST_ROWS = 1_000_000


def broadcast_bounded(df: DataFrame, bound: int | None) -> DataFrame:
    """Broadcast ``df`` when ``bound`` (a proven upper bound on its rows) is small."""
    if bound is not None and bound <= MAX_BROADCAST_ROWS:
        return F.broadcast(df)
    return df


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only after checking it has at most ``max_rows`` rows.

    The check runs ``limit(max_rows + 1).count()`` -- it stops reading once the
    bound is exceeded.  Beyond the bound the plain DataFrame is returned and
    the planner picks a shuffle join.  Use for cheap-to-compute sides only
    (the side is evaluated once for the check).
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df
