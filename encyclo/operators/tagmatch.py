"""Tag-match join: titles or category names against class tag lists.

Rule: a tag matches a key when it starts the key or follows ``_``, and is
followed by the end, ``_`` or ``s``.  The first class in list order wins.

Plan: the rule is a theta condition, but every match is a substring of the
key that starts at a word start and ends before ``_``/``s``/the end.  Those
substrings are enumerated per key (a few dozen for a title) and equi-joined
with the tags, so no nested-loop join is needed; whether the tags are broadcast
is left to the planner, from their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _candidates(key: Column) -> Column:
    n = F.length(key)
    chars = F.split(key, "")
    idx = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    starts = F.filter(idx, lambda i: (i == 1) | (F.element_at(chars, F.greatest(i - 1, F.lit(1))) == "_"))
    ends = F.filter(idx, lambda i: (i == n) | F.try_element_at(chars, i + 1).isin("_", "s"))
    return F.array_distinct(F.flatten(F.transform(
        starts, lambda s: F.transform(F.filter(ends, lambda e: e >= s),
                                      lambda e: F.substring(key, s, e - s + 1)))))


# Fixed value: a class that a key naming another place must not get.
UNLESS = {"virginia": "west_virginia"}


def tag_match(keys: DataFrame, tags: DataFrame, key_col: str = "title", prefix: str = "Category:",
              unless: dict[str, str] | None = None) -> DataFrame:
    """``keys(..., key_col)``, ``tags(class_idx, class_name, tag)`` ->
    keys plus ``class_idx, class_name`` of the first matching class (unmatched dropped).

    Keys are compared in lower case and without ``prefix``; a class named in
    ``unless`` is not given to a key that holds the string beside it.
    """
    t = tags.select(F.lower("tag").alias("_cand"), "class_idx", "class_name").distinct()
    k = F.lower(F.col(key_col))
    k = F.when(k.startswith(prefix.lower()), F.substring(k, len(prefix) + 1, 1 << 30)).otherwise(k)
    cand = keys.select(key_col, k.alias("_k")).distinct().select(key_col, "_k", F.explode(_candidates(F.col("_k"))).alias("_cand"))
    hits = cand.join(t, "_cand")
    for name, other in (UNLESS if unless is None else unless).items():
        hits = hits.where((F.col("class_name") != name) | ~F.col("_k").contains(other))
    first = (hits.groupBy(key_col)
             .agg(F.min_by(F.struct("class_idx", "class_name"), F.col("class_idx")).alias("_c")))
    return keys.join(first.select(key_col, "_c.class_idx", "_c.class_name"), key_col, "inner")


def class_sizes(matched_categories: DataFrame, size_col: str = "size") -> DataFrame:
    """Sum of the sizes of the categories matched to each class (each category once; empty ones skipped)."""
    return (matched_categories.where(F.col(size_col) > 0)
            .groupBy("class_idx", "class_name").agg(F.sum(size_col).alias("class_size")))
