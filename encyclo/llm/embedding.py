"""Embedding near-duplicates by int8 quantised tile products.

Vectors are scaled to length one and quantised to int8 with one scale each;
the length of the quantisation error is kept with the vector.  For two vectors
x = s q + e and y = t r + f the cosine differs from s t (q . r) by at most
|s q| |f| + |e|, so a product of two int8 tiles tells for every pair whether it
is surely below the threshold, surely above it, or open; only open pairs are
computed in double precision.

Equal vectors collapse first.  Vectors are then dealt into tiles of
``TILE_ROWS`` along the nearest of a bounded set of pivots, and a pair of tiles
whose centres are further apart than their radii and the threshold allow is
skipped.  A task takes one tile and streams the others past it; links are
counted in the task and leave it as stars of local classes, so a large group of
near copies makes no large output.  Pairs of tiles are multiplied in rounds of as many
as there are tiles, so that the tiles on their way take twice the vectors at most; what
a step has read is deleted.

Vectors that are null, zero, or hold null or non-finite components link with
nothing and are their own component, as are vectors of another length than the
one compared.  Repeated ids count as one vector each time they appear; a null id
is linked but is no component's name unless alone.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_unused_shuffles, stored
from .common import stage
from .components import components, merge_labels

THRESHOLD = 0.9
TILE_ROWS = 4096
PIVOTS = 256
SLACK = 1e-9  # beyond what rounding in double precision can do to a sum of products


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1)[:, None]


def quantise(unit: np.ndarray):
    """int8 rows, their scales, and the lengths of the rounded vectors and of the errors."""
    scale = np.abs(unit).max(axis=1) / 127.0
    q = np.rint(unit / scale[:, None])
    rounded = q * scale[:, None]
    return q.astype(np.int8), scale, np.linalg.norm(rounded, axis=1), np.linalg.norm(unit - rounded, axis=1) + SLACK


def tile_links(ux, uy, qx, qy, threshold: float, same: bool):
    """(i, j) of the linked pairs of two tiles, in blocks of rows; i < j if they are the same tile."""
    (q, s, length, err), (r, t, _, far) = qx, qy
    wide = r.T.astype(np.float32)  # products of int8 add up exactly in float32 up to 2^24 / 127^2 components
    exact = q.shape[1] <= 1024
    if not exact:
        wide = wide.astype(np.float64)
    for at in range(0, len(q), 512):
        rows = slice(at, at + 512)
        approx = (q[rows].astype(wide.dtype) @ wide) * s[rows, None].astype(np.float64) * t[None, :]
        bound = length[rows, None] * far[None, :] + err[rows, None]
        near = approx + bound >= threshold
        if same:
            near &= np.arange(len(r))[None, :] > np.arange(at, at + approx.shape[0])[:, None]
        i, j = np.nonzero(near)
        open_ = approx[i, j] - bound[i, j] < threshold
        ok = ~open_
        for k in range(0, int(open_.sum()), 1 << 16):
            pick = np.flatnonzero(open_)[k:k + (1 << 16)]
            ok[pick] = np.einsum("ij,ij->i", ux[i[pick] + at], uy[j[pick]]) >= threshold
        yield i[ok] + at, j[ok]


def links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
          tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(id, n_links, component_id)`` of every row of ``vectors``."""
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    good = F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
                      & F.exists(v, lambda x: x != 0), F.lit(False))
    single = vectors.schema[vector_col].dataType.elementType.simpleString() == "float"
    number = "float" if single else "double"  # as the table holds them; all sums are in double precision
    rows = vectors.select(F.col(id_col).alias("id"), F.when(good, v).alias("v"))
    # equal vectors are one; zero and negative zero are equal too
    rows = rows.withColumn("v", F.transform("v", lambda x: x + 0.0)).withColumn(
        "k", F.when(F.col("v").isNotNull(), F.sha2(F.to_json(F.struct("v")).cast("binary"), 256)))
    keyed, drop_keyed = stored(rows.withColumn("v", F.col("v").cast(f"array<{number}>")), "vectors")
    distinct = keyed.where("k is not null").groupBy("k").agg(F.first("v").alias("v"), F.count("*").alias("n"), F.min("id").alias("low"))
    distinct, drop_distinct = stored(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct-vectors")
    ids = stage(keyed.select("id", "k"), "vector-ids")
    drop_keyed()
    drop_unused_shuffles(spark)
    n = distinct.count()
    tiles = max(1, -(-n // tile_rows))
    sample = distinct.select("v").limit(PIVOTS).toPandas()["v"]  # pivots only shape the tiles
    pivots = spark.sparkContext.broadcast({d: unit_rows(np.array([x for x in sample if len(x) == d], dtype=np.float64))
                                           for d in {len(x) for x in sample}})

    def nearest(batches):
        for b in batches:
            flat = b.column(1)
            size = np.diff(flat.offsets.to_numpy())
            order = np.zeros(b.num_rows)
            for d in np.unique(size).tolist():
                at = np.flatnonzero(size == d)
                x = unit_rows(np.array(flat.take(pa.array(at)).values.to_numpy(), dtype=np.float64).reshape(-1, d))
                p = pivots.value.get(d)
                if p is not None and len(p):
                    c = x @ p.T
                    order[at] = c.argmax(axis=1) + (1 - c.max(axis=1)) / 4
                order[at] += d * (PIVOTS + 1.0)
            yield pa.RecordBatch.from_arrays([b.column(0), flat, b.column(2), pa.array(order)], names=["node", "v", "n", "at"])

    placed, drop_placed = stored(distinct.select("node", "v", "n").mapInArrow(nearest, f"node long, v array<{number}>, n long, at double"), "placed")
    named = stage(distinct.select("k", "node", "n", "low"), "vector-names")
    drop_distinct()
    # tiles are ranges of the order; few distinct edges of a bounded summary
    edges = np.unique(np.array(placed.approxQuantile("at", [k / tiles for k in range(1, tiles)], 0.2 / tiles))) if tiles > 1 else np.zeros(0)
    cut = spark.sparkContext.broadcast(edges)
    n_tiles = len(edges) + 1

    @F.pandas_udf("int")
    def tile_of(at):
        import pandas as pd
        return pd.Series(np.searchsorted(cut.value, at.to_numpy(), side="right").astype(np.int32))

    # equal places may overfill a range, so a tile is cut by node as well
    members = placed.withColumn("tile", tile_of("at"))
    counts = members.groupBy("tile").count()
    split = counts.select(F.col("tile").alias("_t"), F.ceil(F.col("count") / (2 * tile_rows)).alias("_cuts"))
    members = (members.join(F.broadcast(split), members["tile"] == split["_t"])  # a row per tile
               .withColumn("tile", F.struct("tile", F.pmod(F.xxhash64("node"), "_cuts").alias("part"))))

    def pack(key, table):
        import pandas as pd
        out = []
        lists = table.column("v").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        for d in np.unique(size).tolist():
            at = np.flatnonzero(size == d)
            raw = np.ascontiguousarray(lists.take(pa.array(at)).values.to_numpy().reshape(-1, d))
            x = unit_rows(raw.astype(np.float64))
            centre = x.mean(axis=0)
            norm = np.linalg.norm(centre)
            centre = centre / norm if norm > 0 else x[0]
            reach = float(np.arccos(np.clip((x @ centre).min() - SLACK, -1, 1)))
            out.append((f"{key[0].as_py()['tile']}/{key[0].as_py()['part']}/{d}", d, centre.tolist(), reach,
                        np.take(table.column("node").to_numpy(), at).tobytes(), np.take(table.column("n").to_numpy(), at).tobytes(),
                        raw.tobytes()))
        return pa.Table.from_pandas(pd.DataFrame(out, columns=["tile", "d", "centre", "reach", "nodes", "weights", "vectors"]),
                                    preserve_index=False)

    packed, drop_packed = stored(members.select("tile", "node", "n", "v").groupBy("tile").applyInArrow(
        pack, "tile string, d long, centre array<double>, reach double, nodes binary, weights binary, vectors binary"), "tiles")
    drop_placed()
    drop_unused_shuffles(spark)
    # pairs of tiles that can hold a link: centres within the radii and the threshold's angle
    summary = packed.select("tile", "d", "centre", "reach")
    left, right = summary.select(*[F.col(c).alias("l_" + c) for c in summary.columns]), summary
    dot = F.aggregate(F.zip_with("l_centre", "centre", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot)))
    # one side in slices, the other sent to every slice, so that no task holds all pairs
    slices = max(1, n_tiles // 32)
    left = left.withColumn("_s", F.pmod(F.xxhash64("l_tile"), F.lit(slices)))
    right = right.withColumn("_r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    pairs = (left.join(right, (left["l_d"] == right["d"]) & (left["_s"] == right["_r"]) & (left["l_tile"] <= right["tile"]))
             .where(angle - 1e-6 <= F.col("l_reach") + F.col("reach") + float(np.arccos(threshold)))
             .select("l_tile", F.col("tile").alias("r_tile")))
    pairs = stage(pairs, "tile-pairs")
    width = packed.count()
    rounds = max(1, -(-pairs.count() // max(width, 1)))
    pairs = pairs.withColumn("round", F.pmod(F.xxhash64("l_tile", "r_tile"), F.lit(rounds)))
    body = packed.select("tile", "nodes", "weights", "vectors", "d")

    def multiply(batches):
        before = None
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b.column(i)[k].as_py() for i, c in enumerate(b.schema.names)}
                same = row["l_tile"] == row["r_tile"]
                nodes, weights = (np.frombuffer(row[c], np.int64) for c in ("nodes", "weights"))
                x = unit_rows(np.frombuffer(row["vectors"], np.float32 if single else np.float64).reshape(-1, row["d"]).astype(np.float64))
                at, tile = (row["l_tile"], row["r_tile"]), (nodes, weights, x, quantise(x))
                one, before = (tile if same else before and before[0] == at and before[1]), (at, tile)
                if not one:
                    continue
                (nx, wx, ux, qx), (ny, wy, uy, qy) = one, tile
                off = 0 if same else len(nx)
                nodes = nx if same else np.concatenate([nx, ny])
                count = np.zeros(len(nodes))
                labels = np.arange(len(nodes))
                for i, j in tile_links(ux, uy, qx, qy, threshold, same):
                    labels = merge_labels(labels, i, j + off)
                    count += np.bincount(i, weights=wy[j], minlength=len(nodes))
                    count += np.bincount(j + off, weights=wx[i], minlength=len(nodes))
                hit = np.flatnonzero((count > 0) | (labels != np.arange(len(nodes))))
                if len(hit):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(nodes[hit]), pa.array(nodes[labels[hit]]), pa.array(count[hit].astype(np.int64))],
                        names=["a", "b", "n"])

    found = None
    for r in range(rounds):
        now = pairs.where(F.col("round") == r)
        asked = (now.select(F.col("l_tile").alias("_t"), "l_tile", "r_tile", F.lit(0).alias("side"))
                 .unionByName(now.where("l_tile <> r_tile").select(F.col("r_tile").alias("_t"), "l_tile", "r_tile", F.lit(1).alias("side"))))
        # some two names a tile, so the tiles leave the scan only for their pairs
        both = (body.join(F.broadcast(asked), F.col("tile") == F.col("_t")).drop("tile", "_t")
                .repartition(max(width, 1), "l_tile", "r_tile").sortWithinPartitions("l_tile", "r_tile", "side"))
        made = stage(both.mapInArrow(multiply, "a long, b long, n long"), "tile-links")
        found = made if found is None else found.unionByName(made)
        drop_unused_shuffles(spark)
    drop_packed()
    part = components(found)
    degree = found.groupBy("a").agg(F.sum("n").alias("others"))
    of = (named.join(part.withColumnRenamed("node", "_c"), F.col("node") == F.col("_c"), "left")
          .join(degree, F.col("node") == F.col("a"), "left")
          .select("k", "low", F.coalesce("component", "node").alias("component"),
                  (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    low = of.groupBy("component").agg(F.min("low").alias("component_id"))
    of = of.join(low, "component").select(F.col("k").alias("_k"), "n_links", "component_id")
    return (ids.join(of, F.col("k") == F.col("_k"), "left")
            .select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "id").alias("component_id")))
