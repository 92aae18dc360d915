"""Table exploration: case-insensitive row search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def search_rows(df: DataFrame, query: str, columns: list[str] | None = None,
                first_only: bool = False, order_by: str | None = None) -> DataFrame:
    """Rows with any cell (as text) equal to ``query``, ignoring case.

    ``first_only`` keeps the row with the smallest ``order_by`` (default: the
    first column) -- a top-1, planned as TakeOrderedAndProject.
    """
    cols = columns or df.columns
    q = F.lit(query.lower())
    cond = F.exists(F.array(*[F.col(c).cast("string") for c in cols]), lambda x: F.lower(x) == q)
    out = df.where(cond)
    if first_only:
        out = out.orderBy(order_by or df.columns[0]).limit(1)
    return out
