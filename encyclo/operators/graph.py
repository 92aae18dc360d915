"""Shortest paths over a weighted edge table, many (source, target) pairs at once.

The exact search goes from both ends of every pair (``_meet``).  A row of its state is
a node of a pair with the cheapest known way from the source and the cheapest known way
to the target, so a node with both is a path.  Each round the side with fewer open
nodes expands those within one mean edge cost of its cheapest.  With ``top`` the cost of
the cheapest open node of a side and ``mu`` the best path's, a pair is finished when
``top + top' >= mu`` (edge costs are >= 0, so no path can be cheaper), or when a side
has no open node left: then all it can reach is known.  Finished pairs leave the state.
A pair costs two balls of half the path's cost instead of one of the whole, and an
unreachable one the smaller of both sides.  Every round's state is stored under
``spark.checkpoint.dir`` and the last one deleted, so a lost executor repeats at most
one round and no more than two states are on disk.

``beam``/``heuristic_weight`` turn the search into a weighted A*-like beam
search (f = g + w * (1 - cos(node, goal)), best ``beam`` nodes per query per
round) -- faster, not exact; the exact search is its yardstick.  It is a frontier
relaxation from the source: state ``(qid, node, cost, path)``, and candidates at or
above the target's cost are dropped once it has one.  Pairs without any path are
found first, by both ends; pairs that end without a path are searched again with a
wider beam, until nothing was pruned.

A graph of at most ``local_legs`` legs (an edge is one each way) is sent to the tasks
instead, which run the same rounds pair by pair (``paths``); larger ones, ids that are no
longs, costs that are null or NaN, and for the beam repeated ids go over the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import paths
from ..session import drop_unused_shuffles, ensure_checkpoint_dir, reliable_checkpoint, stored

WIDEN = 4


def shortest_paths(edges: DataFrame, pairs: DataFrame, *, max_rounds: int | None = None,
                   vectors: DataFrame | None = None, heuristic_weight: float = 0.0,
                   beam: int | None = None, id_col: str = "vec_id",
                   vec_col: str = "embedding", pairs_per_batch: int | None = None,
                   local_legs: int = 0) -> DataFrame:
    """``edges(src, dst, cost)``, ``pairs(qid, source, target)`` ->
    ``(qid, source, target, cost, hops, path)``; unreachable pairs are absent.

    The state holds the balls of half a path's cost around both ends of the pairs at
    work.  With ``pairs_per_batch`` the pairs are hashed into batches of about that many
    queries; each batch runs the relaxation on its own (bounded state) and its
    result is checkpointed before the next batch starts.
    """
    kw = dict(max_rounds=max_rounds, vectors=vectors, heuristic_weight=heuristic_weight, beam=beam,
              id_col=id_col, vec_col=vec_col)
    if local_legs and max_rounds is None and pairs_per_batch is None:
        local = _local(edges, pairs, legs=local_legs, **kw)
        if local is not None:
            return local
    if pairs_per_batch:
        n = pairs.count()
        batches = max(1, -(-n // pairs_per_batch))
        if batches > 1:
            keyed = reliable_checkpoint(pairs.withColumn("_b", F.pmod(F.xxhash64("qid"), F.lit(batches))))
            parts = [reliable_checkpoint(_search(edges, keyed.where(F.col("_b") == b).drop("_b"), **kw))
                     for b in range(batches)]
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            return out
    return _search(edges, pairs, **kw)


def _search(edges: DataFrame, pairs: DataFrame, *, beam: int | None, **kw) -> DataFrame:
    """One batch of pairs; those a beam leaves without a path get one ``WIDEN`` times as wide."""
    if beam is None:
        if kw["max_rounds"] is None:
            return _meet(edges, pairs)
        return _relax(edges, pairs, beam=None, **kw)[0]
    if kw["max_rounds"] is None:
        some = _meet(edges, pairs, any_path=True).select("qid").distinct()
        pairs = reliable_checkpoint(pairs.join(some, "qid", "left_semi"))
    out = None
    while True:
        found, pruned = _relax(edges, pairs, beam=beam, **kw)
        found = reliable_checkpoint(found)
        out = found if out is None else out.unionByName(found)
        if not pruned:
            return out
        pairs = reliable_checkpoint(pairs.join(found.select("qid"), "qid", "left_anti"))
        if pairs.isEmpty():
            return out
        beam *= WIDEN


PAIR = ["source", "target"]
LOCAL_VECTORS = 16_000_000  # numbers of the vectors that tasks may hold for the beam


def _legs(edges: DataFrame) -> DataFrame:
    """Each edge once in either direction, at its least cost."""
    e = edges.select("src", "dst", F.col("cost").cast("double").alias("w"))
    return (e.select(F.lit(False).alias("back"), F.col("src").alias("node"), F.col("dst").alias("next"), "w")
            .unionByName(e.select(F.lit(True).alias("back"), F.col("dst").alias("node"), F.col("src").alias("next"), "w"))
            .groupBy("back", "node", "next").agg(F.min("w").alias("w")))


def _local(edges: DataFrame, pairs: DataFrame, *, legs: int, vectors: DataFrame | None, heuristic_weight: float,
           beam: int | None, id_col: str, vec_col: str, max_rounds: int | None) -> DataFrame | None:
    """The paths of all pairs searched in the tasks, or None where the tables are needed."""
    import numpy as np
    import pyarrow as pa
    spark = edges.sparkSession
    types = [edges.schema[c].dataType for c in ("src", "dst")] + [pairs.schema[c].dataType for c in ("qid", *PAIR)]
    if beam is not None:
        if vectors is None or heuristic_weight <= 0:
            return None
        types.append(vectors.schema[id_col].dataType)
    if any(t.simpleString() != "bigint" for t in types) or 2 * edges.count() > legs:
        return None
    bad = F.col("cost").cast("double")
    if not edges.where(bad.isNull() | F.isnan(bad) | F.col("src").isNull() | F.col("dst").isNull()).isEmpty():
        return None
    whole = pairs.where("qid is not null and source is not null and target is not null")
    goals = None
    if beam is not None:
        v = vectors.select(F.col(id_col).alias("i"), F.transform(vec_col, lambda x: x.cast("double")).alias("v"))
        n, ids, least, most = v.agg(F.count("*"), F.count_distinct("i"), F.min(F.coalesce(F.size("v"), F.lit(-1))), F.max(F.size("v"))).first()
        sound = F.coalesce(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
        repeated = pairs.groupBy("qid").count().where("count > 1")
        if (not n or n != ids or least != most or least < 1 or n * least > LOCAL_VECTORS or not v.where(~sound).isEmpty()
                or not repeated.isEmpty()):
            return None
        rows = vectors.select(F.col(id_col).alias("i"), F.col(vec_col).alias("v")).toArrow()
        flat = rows.column("v").combine_chunks().flatten().to_numpy().reshape(n, least)
        order = np.argsort(rows.column("i").to_numpy())
        goals = rows.column("i").to_numpy()[order], flat[order], heuristic_weight
    table, drop = stored(_legs(edges), "path-legs")
    step = table.agg(F.avg("w")).first()[0] or 0.0
    got = {c: x.to_numpy() for c, x in zip(table.columns, table.toArrow().columns)}
    drop()
    sides = [tuple(got[c][got["back"] == back] for c in ("node", "next", "w")) for back in (False, True)]
    sent = spark.sparkContext.broadcast((sides, goals))

    def search(batches):
        (ahead, behind), goals = [paths.Legs(*s) for s in sent.value[0]], sent.value[1]
        for batch in batches:
            qids, sources, targets = (batch.column(c).to_pylist() for c in range(3))
            for at in range(0, len(qids), 256):
                out = []
                for qid, source, target in zip(qids[at:at + 256], sources[at:at + 256], targets[at:at + 256]):
                    path = paths.meet(ahead, behind, step, source, target, any_path=beam is not None)
                    if beam is not None and path is not None:
                        goal, width, pruned, path = paths.Goal(*goals, target), beam, True, None
                        while path is None and pruned:
                            path, pruned = paths.relax(ahead, goal, source, target, width)
                            width *= WIDEN
                        path = path and (path[0], len(path[1]) - 1, path[1])
                    if path is not None:
                        out.append((qid, source, target, path[0], path[1], list(path[2])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (
                        pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.list_(pa.int64())))],
                        names=["qid", *PAIR, "cost", "hops", "path"])

    asked = whole.select("qid", *PAIR) if beam is not None else whole.select(F.lit(0).cast("long").alias("qid"), *PAIR).distinct()
    # a pair is little to send and much to do
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    found = reliable_checkpoint(asked.repartition(parts, *PAIR).mapInArrow(
        search, "qid long, source long, target long, cost double, hops int, path array<long>"))
    if beam is not None:
        return found
    return pairs.where(F.col("qid").isNotNull()).join(found.drop("qid"), PAIR).select("qid", *PAIR, "cost", "hops", "path")


def _meet(edges: DataFrame, pairs: DataFrame, any_path: bool = False) -> DataFrame:
    """The search from both ends; with ``any_path`` a pair is finished with its first path, cheapest or not.

    Equal costs go to the path with fewer hops, then to the smaller one."""
    spark = edges.sparkSession
    legs, drop_legs = stored(_legs(edges), "path-legs")
    step = legs.agg(F.avg("w")).first()[0] or 0.0
    asked = pairs.where(F.col("qid").isNotNull()).select(*PAIR).distinct().where("source is not null and target is not null")
    node_type = asked.schema["source"].dataType.simpleString()
    # cost, nodes, path; on the way to the target also its edges' costs, to sum from the source on
    there, back = f"struct<c:double,n:int,p:array<{node_type}>>", f"struct<c:double,n:int,p:array<{node_type}>,w:array<double>>"

    def merged(rows: DataFrame) -> DataFrame:
        """One row a pair and node from known ones (``of``, ``ob``: still open) and new ones (``of``, ``ob`` null)."""
        m = rows.groupBy(*PAIR, "node").agg(
            F.min("f").alias("f"), F.min("b").alias("b"), F.max("limit").alias("limit"),
            *[x for k in "fb" for x in (F.max(F.when(F.col(f"o{k}").isNotNull(), F.col(f"{k}.c"))).alias(f"_{k}"),
                                        F.max(f"o{k}").alias(f"_o{k}"))])
        better = {k: F.col(f"{k}").isNotNull() & (F.col(f"_{k}").isNull() | (F.col(f"{k}.c") < F.col(f"_{k}"))) for k in "fb"}
        # a new node that the other side has not reached is at least its cheapest open node's cost away from its end
        useful = (F.col("limit").isNull() | (F.col("f").isNotNull() & F.col("b").isNotNull()) | F.col("_f").isNotNull()
                  | F.col("_b").isNotNull() | (F.coalesce("f.c", "b.c") < F.col("limit")))
        return m.where(useful).select(*PAIR, "node", "f", "b", *[
            F.when(F.col(k).isNotNull(), better[k] | F.coalesce(f"_o{k}", F.lit(False))).alias(f"o{k}") for k in "fb"])

    no = {k: F.lit(None).cast(t) for k, t in (("f", there), ("b", back), ("limit", "double"), ("open", "boolean"))}
    start = (asked.select(*PAIR, F.col("source").alias("node"),
                          F.struct(F.lit(0.0).alias("c"), F.lit(1).alias("n"), F.array("source").alias("p")).cast(there).alias("f"),
                          no["b"].alias("b"), no["limit"].alias("limit"), no["open"].alias("of"), no["open"].alias("ob"))
             .unionByName(asked.select(*PAIR, F.col("target").alias("node"), no["f"].alias("f"),
                                       F.struct(F.lit(0.0).alias("c"), F.lit(1).alias("n"), F.array("target").alias("p"),
                                                F.array().cast("array<double>").alias("w")).cast(back).alias("b"),
                                       no["limit"].alias("limit"), no["open"].alias("of"), no["open"].alias("ob"))))
    state, drop = stored(merged(start), "path-state")
    done = []
    while True:
        # the whole path's cost summed from the source on, as a search from there does
        total = F.aggregate("b.w", F.col("f.c"), lambda s, w: s + w)
        whole = F.when(F.col("f").isNotNull() & F.col("b").isNotNull(), F.struct(
            total.alias("cost"), (F.col("f.n") + F.col("b.n") - 2).alias("hops"),
            F.concat("f.p", F.slice("b.p", 2, F.greatest(F.col("b.n") - 1, F.lit(0)))).alias("path")))
        now, drop_now = stored(state.groupBy(*PAIR).agg(
            F.min(F.when(F.col("of"), F.col("f.c"))).alias("tf"), F.min(F.when(F.col("ob"), F.col("b.c"))).alias("tb"),
            F.count(F.when(F.col("of"), 1)).alias("nf"), F.count(F.when(F.col("ob"), 1)).alias("nb"), F.min(whole).alias("best")), "path-now")
        more = F.col("best").isNull() if any_path else F.col("best").isNull() | (F.col("tf") + F.col("tb") < F.col("best.cost"))
        active = F.coalesce(F.col("tf").isNotNull() & F.col("tb").isNotNull() & more, F.lit(False))
        done.append(reliable_checkpoint(now.where(~active & F.col("best").isNotNull()).select(*PAIR, "best.*")))
        todo = now.where(active).select(*PAIR, "tf", "tb", (F.col("nb") < F.col("nf")).alias("back"), F.col("best.cost").alias("mu"))
        if todo.isEmpty():
            break
        live = state.join(todo, PAIR)
        left = F.coalesce("mu", F.lit(float("inf")))
        out = {"f": ~F.col("back") & F.col("of") & (F.col("f.c") <= F.col("tf") + step) & (F.col("f.c") + F.col("tb") < left),
               "b": F.col("back") & F.col("ob") & (F.col("b.c") <= F.col("tb") + step) & (F.col("b.c") + F.col("tf") < left)}
        out = {k: F.coalesce(v, F.lit(False)) for k, v in out.items()}
        known = live.select(*PAIR, "node", "f", "b", no["limit"].alias("limit"),
                            (F.col("of") & ~out["f"]).alias("of"), (F.col("ob") & ~out["b"]).alias("ob"))
        at = F.when(F.col("back"), F.col("b.c")).otherwise(F.col("f.c")) + F.col("w")
        new = (live.where(out["f"] | out["b"]).join(legs, ["back", "node"]).where(at < left)
               .select(*PAIR, F.col("next").alias("node"),
                       F.when(~F.col("back"), F.struct(at.alias("c"), (F.col("f.n") + 1).alias("n"),
                                                       F.concat("f.p", F.array("next")).alias("p"))).cast(there).alias("f"),
                       F.when(F.col("back"), F.struct(at.alias("c"), (F.col("b.n") + 1).alias("n"), F.concat(F.array("next"), "b.p").alias("p"),
                                                      F.concat(F.array("w"), "b.w").alias("w"))).cast(back).alias("b"),
                       (left - F.when(F.col("back"), F.col("tf")).otherwise(F.col("tb"))).alias("limit"),
                       no["open"].alias("of"), no["open"].alias("ob")))
        following, drop_following = stored(merged(known.unionByName(new)), "path-state")
        drop()
        drop_now()
        state, drop = following, drop_following
        drop_unused_shuffles(spark)
    drop()
    drop_now()
    drop_legs()
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    return (pairs.where(F.col("qid").isNotNull()).join(found, PAIR)
            .select("qid", "source", "target", "cost", "hops", "path"))


def _relax(edges: DataFrame, pairs: DataFrame, *, max_rounds: int | None, vectors: DataFrame | None,
           heuristic_weight: float, beam: int | None, id_col: str, vec_col: str) -> tuple[DataFrame, bool]:
    """The frontier relaxation itself, and whether the beam left out a node."""
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    e = edges.select(F.col("src").alias("node"), "dst", F.col("cost").alias("w"))
    goals = pairs.select("qid", "target")
    state = reliable_checkpoint(pairs.select("qid", F.col("source").alias("node"), F.lit(0.0).alias("cost"),
                                             F.array(F.col("source")).alias("path")))
    frontier = state
    goal_vec = None
    if beam is not None and vectors is not None and heuristic_weight > 0:
        goal_vec = (goals.join(vectors.select(F.col(id_col).alias("target"), F.col(vec_col).alias("gv")), "target")
                    .select("qid", "gv"))
        node_vec = vectors.select(F.col(id_col).alias("node"), F.col(vec_col).alias("nv"))
    rounds, pruned = 0, False
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        bound = (state.join(goals, (state.qid == goals.qid) & (state.node == goals.target))
                 .select(state.qid, F.col("cost").alias("_bound")))
        cand = (frontier.join(e, "node")
                .select("qid", F.col("dst").alias("node"), (F.col("cost") + F.col("w")).alias("cost"),
                        F.concat("path", F.array("dst")).alias("path"))
                .where(~F.array_contains(F.slice("path", 1, F.size("path") - 1), F.col("node"))))
        cand = (cand.join(bound, "qid", "left")
                .where(F.col("_bound").isNull() | (F.col("cost") < F.col("_bound"))).drop("_bound"))
        best = (cand.groupBy("qid", "node")
                .agg(F.min_by(F.struct("cost", "path"), F.struct("cost", "path")).alias("b"))
                .select("qid", "node", "b.cost", "b.path"))
        improved = (best.join(state.select("qid", "node", F.col("cost").alias("_old")), ["qid", "node"], "left")
                    .where(F.col("_old").isNull() | (F.col("cost") < F.col("_old"))).drop("_old"))
        improved = reliable_checkpoint(improved)
        if improved.isEmpty():
            break
        state = reliable_checkpoint(state.join(improved.select("qid", "node"), ["qid", "node"], "left_anti")
                                    .unionByName(improved))
        frontier = improved
        if goal_vec is not None:
            # every improvement is recorded in the state (so a pruned node only
            # comes back through a cheaper path); only the best `beam` nodes
            # per query by f = g + w * h are expanded next
            f = F.col("cost") + F.lit(heuristic_weight) * (F.lit(1.0) - F.coalesce(V.cosine("nv", "gv"), F.lit(1.0)))
            ranked = (improved.join(node_vec, "node", "left").join(goal_vec, "qid", "left")
                      .withColumn("_r", F.row_number().over(Window.partitionBy("qid").orderBy(f, "node"))))
            frontier = ranked.where(F.col("_r") <= beam).select("qid", "node", "cost", "path")
            pruned = pruned or not improved.groupBy("qid").count().where(F.col("count") > beam).isEmpty()
    res = state.join(pairs, (state.qid == pairs.qid) & (state.node == pairs.target))
    return res.select(state.qid, "source", "target", F.col("cost"), (F.size("path") - 1).alias("hops"), "path"), pruned
