"""Connected components of a link table by alternating large and small stars.

Every round sends each node's neighbours to the smallest node among them; only
minima are aggregated (combined before the shuffle), no neighbour list is ever
collected, so hubs with millions of links are ordinary rows.  Rounds are
written to the shared folder and end when the star forest is unchanged.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def merge_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union of the classes of ``i[k]`` and ``j[k]`` for all k.

    ``labels[n]`` is the smallest known member of n's class.
    """
    while len(i):
        a, b = labels[i], labels[j]
        open_ = a != b
        if not open_.any():
            break
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
    return labels


def components(links: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """``links(a, b)`` (undirected, any repeats) -> ``(node, component)``.

    ``component`` is the smallest node reachable; nodes without a link to
    another node do not appear.  Null ends are ignored; an empty table gives
    an empty result.
    """
    edges = (links.select("a", "b").where("a <> b")
             .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    edges = stage(edges, "links")
    before, rounds = None, 0
    while max_rounds is None or rounds < max_rounds:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        # large star: larger neighbours go to the smallest neighbour or the node itself
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = (both.join(low, both["a"] == low["u"]).where("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        # small star: the node and its smaller neighbours go to the smallest one
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = (large.join(least, large["a"] == least["u"])
                 .select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        edges = stage(small, "stars")
        rounds += 1
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")) \
        .unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()) \
        .groupBy("node").agg(F.min("component").alias("component"))
