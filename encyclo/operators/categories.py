"""Category sizes, the n largest categories and article -> category assignment.

The category side (``id, category_id[, pos]``) is an edge table.  Sizes come
from a partial+final ``count`` (a category holding a third of all articles is
pre-aggregated map-side).  The n largest categories form a ``limit(n)``
result, so their size is bounded by ``n`` and they may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.indexing import dense_index
from ..plans.joins import broadcast_bounded
from ..session import reliable_checkpoint


def category_sizes(categories: DataFrame) -> DataFrame:
    """(id, category_id) -> (category_id, size): articles per category."""
    return categories.groupBy("category_id").agg(F.count(F.lit(1)).alias("size"))


def largest_categories(categories: DataFrame, titles: DataFrame, n: int = 120) -> DataFrame:
    """The ``n`` largest titled categories: (title, category_id, size).

    Untitled categories are dropped before the cut; ties by id.  Asking for
    more than exist returns all.  ``orderBy().limit()`` plans as a
    TakeOrderedAndProject: every partition keeps its own top n.
    """
    sizes = category_sizes(categories)
    t = titles.select(F.col("id").alias("category_id"), "title")
    return (sizes.join(t, "category_id", "inner")
            .orderBy(F.col("size").desc(), F.col("category_id"))
            .limit(n)
            .select("title", "category_id", "size"))


def assign_category(categories: DataFrame, largest: DataFrame, titles: DataFrame | None = None,
                    n: int | None = None) -> DataFrame:
    """Each article -> its smallest category among ``largest``.

    Ties go to the earlier category of the article's list (``pos`` when given,
    else the smaller id).  Articles without a title are dropped when
    ``titles`` is given.  ``largest`` is broadcast when ``n`` bounds it.
    """
    big = broadcast_bounded(largest.select("category_id", "size"), n)
    order_cols = [F.col("size")]
    if "pos" in categories.columns:
        order_cols.append(F.col("pos"))
    order_cols.append(F.col("category_id"))
    chosen = (categories.join(big, "category_id", "inner")
              .groupBy("id")
              .agg(F.min_by(F.col("category_id"), F.struct(*order_cols)).alias("category_id")))
    if titles is not None:
        chosen = chosen.join(titles.select("id"), "id", "left_semi")
    return chosen


def effective_sizes(largest: DataFrame, assigned: DataFrame) -> DataFrame:
    """Articles assigned to each large category; zero kept."""
    counts = assigned.groupBy("category_id").agg(F.count(F.lit(1)).alias("effective_size"))
    return (largest.join(counts, "category_id", "left")
            .select("title", "category_id", "size",
                    F.coalesce(F.col("effective_size"), F.lit(0)).cast("bigint").alias("effective_size")))


def compile_categories(categories: DataFrame, titles: DataFrame, n: int = 20000) -> dict[str, DataFrame]:
    """Sizes, the n largest, the assignment and the effective sizes in one go."""
    largest = largest_categories(categories, titles, n)
    assigned = assign_category(categories, largest, titles, n)
    return {"largest": largest, "assigned": assigned,
            "effective": effective_sizes(largest, assigned)}


def category_children(parents: DataFrame) -> DataFrame:
    """(child_id, parent_id) -> (category_id, n_children), in no order.

    The lists themselves, ordered by their length, are ``paged_lists``.
    """
    return (parents.groupBy(F.col("parent_id").alias("category_id"))
            .agg(F.count(F.lit(1)).alias("n_children")))


def category_members(categories: DataFrame, titles: DataFrame) -> DataFrame:
    """(category_id, id, title): long form of category -> article lists."""
    t = titles.select("id", "title")
    return categories.select("category_id", "id").join(t, "id", "left")


def list_stats(edges: DataFrame, key: str, name: str) -> DataFrame:
    """(list_name, n_keys, n_items, mean_len) for an edge table keyed by ``key``."""
    return edges.agg(
        F.lit(name).alias("list_name"),
        F.countDistinct(key).alias("n_keys"),
        F.count(F.lit(1)).alias("n_items"),
    ).select("list_name", "n_keys", "n_items",
             F.round(F.col("n_items") / F.col("n_keys"), 6).alias("mean_len"))


def paged_lists(edges: DataFrame, key: str, item: str, page_size: int = 1000) -> DataFrame:
    """Adjacency lists in pages, longest lists first: (rank, key, n_items, page, items).

    ``rank`` orders the keys by number of distinct items, descending, then by key; page 0, 1, ...
    hold ``page_size`` items each in ascending order (the last one what is left).  Positions come
    from buckets of the sort order, so a key with any share of the edges is dealt out
    over its pages and no row is longer than a page.
    """
    e = edges.select(key, item).where(F.col(key).isNotNull() & F.col(item).isNotNull()).distinct()
    placed = reliable_checkpoint(dense_index(reliable_checkpoint(e), [key, item], "_pos"))
    sizes = placed.groupBy(key).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("n_items"))
    ranked = dense_index(reliable_checkpoint(sizes), ["n_items", key], "rank", descending=("n_items",))
    return (placed.join(ranked, key)
            .groupBy("rank", key, "n_items", F.floor((F.col("_pos") - F.col("_first")) / page_size).cast("int").alias("page"))
            .agg(F.array_sort(F.collect_list(item)).alias("items")))
