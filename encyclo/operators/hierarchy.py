"""Category hierarchy: ancestors within a depth bound, deepened article categories.

Semi-naive evaluation: each round joins only the pairs first found in the
previous round with the parent edges and removes pairs already known, so
cycles and diamonds do not multiply rows.  After ``checkpoint_every`` rounds
the lineage is cut with a reliable checkpoint (``spark.checkpoint.dir``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reliable_checkpoint


def ancestors(parents: DataFrame, max_depth: int = 3, checkpoint_every: int = 4) -> DataFrame:
    """(child_id, parent_id) -> (category_id, ancestor_id, depth), depth = shortest distance <= max_depth."""
    edges = parents.select(F.col("child_id").alias("mid"), F.col("parent_id").alias("ancestor_id")).distinct()
    frontier = edges.select(F.col("mid").alias("category_id"), "ancestor_id", F.lit(1).alias("depth"))
    known = frontier
    for d in range(2, max_depth + 1):
        step = (frontier.select("category_id", F.col("ancestor_id").alias("mid"))
                .join(edges, "mid", "inner")
                .select("category_id", "ancestor_id")
                .distinct())
        new = step.join(known.select("category_id", "ancestor_id"), ["category_id", "ancestor_id"], "left_anti")
        frontier = new.select("category_id", "ancestor_id", F.lit(d).alias("depth"))
        known = known.unionByName(frontier)
        if checkpoint_every and d % checkpoint_every == 0:
            known = reliable_checkpoint(known)
            frontier = known.where(F.col("depth") == d)
    return known


def deepen_categories(categories: DataFrame, anc: DataFrame) -> DataFrame:
    """Article categories plus their ancestors: (id, category_id, depth), depth 0 = direct.

    The ancestors of a category come as one row, so article categories are read and joined
    once.  Rows are dealt before they are grouped, over all shuffle partitions: adaptive
    coalescing goes by compressed bytes and puts millions of these short rows into one hash table."""
    above = anc.groupBy("category_id").agg(F.collect_list(F.struct("ancestor_id", "depth")).alias("_a"))
    itself = F.array(F.struct(F.col("category_id").alias("ancestor_id"), F.lit(0).alias("depth")))
    rows = (categories.select("id", "category_id").join(above, "category_id", "left")
            .select("id", F.explode(F.when(F.col("_a").isNull(), itself).otherwise(F.concat(itself, "_a"))).alias("_a"))
            .select("id", F.col("_a.ancestor_id").alias("category_id"), F.col("_a.depth").alias("depth")))
    parts = int(categories.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "id", "category_id").groupBy("id", "category_id").agg(F.min("depth").alias("depth"))
