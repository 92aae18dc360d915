"""Vector queries over ``embeddings(vec_id, embedding, label)``.

Analogy questions are derived from the table itself: for every vector ``a``
the question is ``a : a+1 :: a+2 : ?`` with expected answer ``a+3`` (ids that
exist only) -- one question per vector, so the work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import vectors as VO
from ..sources.fixtures import Tables
from ..session import reliable_checkpoint
from .registry import register

# DuckDB building blocks: vectors in DOUBLE with their norms, class means.
_E = ("e AS (select vec_id, cast(embedding as double[]) v, "
      "sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))) n, label from embeddings)")
_COS = "list_dot_product({a}.v, {b}.v) / ({a}.n * {b}.n)"
_MEANS = ("m AS (select label, list(x order by i) v from (select label, i, avg(x) x from "
          "(select label, unnest(cast(embedding as double[])) x, generate_subscripts(embedding, 1) i from embeddings) u "
          "group by label, i) g group by label), "
          "mn AS (select label, v, sqrt(list_dot_product(v, v)) n from m)")
_Q = ("q AS (select a.vec_id qid, a.vec_id a, b.vec_id b, c.vec_id c from e a "
      "join e b on b.vec_id = a.vec_id + 1 join e c on c.vec_id = a.vec_id + 2)")


def _emb(spark, sf_dir):
    return Tables(spark, sf_dir).embeddings


def _questions(emb, with_answer: bool = False):
    ids = emb.select(F.col("vec_id").cast("long").alias("a"))
    q = (ids.join(ids.select(F.col("a").alias("b")), F.col("b") == F.col("a") + 1)
         .join(ids.select(F.col("a").alias("c")), F.col("c") == F.col("a") + 2))
    if with_answer:
        q = q.join(ids.select(F.col("a").alias("d")), F.col("d") == F.col("a") + 3)
    return q.withColumn("qid", F.col("a"))


def _topk_sql(score_from: str, k: int, cols: str) -> str:
    return (f"select {cols} from (select *, row_number() over (partition by qid order by s desc, cand) rn "
            f"from ({score_from}) x) y where rn <= {k}")


@register("v9_similar_articles", f"""WITH {_E}
    select id, neighbor_id, cast("rank" as integer) as "rank", similarity from (
      select id, neighbor_id, similarity,
             row_number() over (partition by id order by similarity desc, neighbor_id) as "rank"
      from (select a.vec_id id, b.vec_id neighbor_id, round({_COS.format(a='a', b='b')}, 6) similarity
            from e a join e b on a.vec_id <> b.vec_id) s) r
    where "rank" <= 10""")
def v9_similar_articles(spark, sf_dir):
    return VO.similar_articles(_emb(spark, sf_dir), k=10)


@register("v4_nearest_docs", f"""WITH {_E}
    select id, neighbor_id, cast("rank" as integer) as "rank", similarity from (
      select id, neighbor_id, similarity,
             row_number() over (partition by id order by similarity desc, neighbor_id) as "rank"
      from (select a.vec_id id, b.vec_id neighbor_id, round({_COS.format(a='a', b='b')}, 6) similarity
            from e a join e b on a.vec_id <> b.vec_id) s) r
    where "rank" <= 20""")
def v4_nearest_docs(spark, sf_dir):
    return VO.similar_articles(_emb(spark, sf_dir), k=20)


@register("g6_knn_graph", f"""WITH {_E}
    select id as src, neighbor_id as dst, round(1.0 - similarity, 6) as cost from (
      select id, neighbor_id, similarity,
             row_number() over (partition by id order by similarity desc, neighbor_id) as rk
      from (select a.vec_id id, b.vec_id neighbor_id, round({_COS.format(a='a', b='b')}, 6) similarity
            from e a join e b on a.vec_id <> b.vec_id) s) r
    where rk <= 5""")
def g6_knn_graph(spark, sf_dir):
    return VO.knn_graph(_emb(spark, sf_dir), k=5)


@register("v3_nearest_to_class_means", f"""WITH {_E}, {_MEANS}
    select cast(label as bigint) as qid, id, cast("rank" as integer) as "rank", similarity from (
      select label, id, similarity,
             row_number() over (partition by label order by similarity desc, id) as "rank"
      from (select mn.label, e.vec_id id, round({_COS.format(a='mn', b='e')}, 6) similarity from mn join e on true) s) r
    where "rank" <= 10""")
def v3_nearest_to_class_means(spark, sf_dir):
    emb = _emb(spark, sf_dir)
    means = VO.class_vectors(emb).select(F.col("label").alias("qid"), "vec")
    return VO.nearest(means, emb, k=10)


@register("v10_category_distribution", f"""WITH {_E}, {_MEANS}
    select e.vec_id, mn.label, round(list_dot_product(e.v, mn.v), 6) as dot,
           round({_COS.format(a='e', b='mn')}, 6) as cosine
    from e join mn on true""")
def v10_category_distribution(spark, sf_dir):
    emb = _emb(spark, sf_dir)
    return VO.category_distribution(emb, VO.class_vectors(emb)).withColumnRenamed("qid", "vec_id")


@register("v6_analogy", f"""WITH {_E}, {_Q},
    t AS (select q.qid, q.a, q.b, q.c,
                 list_transform(range(1, len(ea.v) + 1),
                                lambda i: (eb.v[i] / eb.n + ec.v[i] / ec.n) - ea.v[i] / ea.n) v
          from q join e ea on ea.vec_id = q.a join e eb on eb.vec_id = q.b join e ec on ec.vec_id = q.c),
    tn AS (select *, sqrt(list_dot_product(v, v)) n from t)
    {_topk_sql("select tn.qid, e.vec_id cand, round(" + _COS.format(a='tn', b='e') + ", 6) s from tn join e on e.vec_id not in (tn.a, tn.b, tn.c)", 1, 'qid, cand as answer, cast(rn as integer) as "rank", s as similarity')}""")
def v6_analogy(spark, sf_dir):
    emb = _emb(spark, sf_dir)
    return VO.analogy(_questions(emb), emb, k=1)


@register("v5_cosmul", f"""WITH {_E}, {_Q}
    {_topk_sql(
        "select q.qid, e.vec_id cand, round(((1.0 + " + _COS.format(a='eb', b='e') + ") / 2.0) * ((1.0 + "
        + _COS.format(a='ec', b='e') + ") / 2.0) / ((1.0 + " + _COS.format(a='ea', b='e') + ") / 2.0 + 0.001), 6) s "
        "from q join e ea on ea.vec_id = q.a join e eb on eb.vec_id = q.b join e ec on ec.vec_id = q.c "
        "join e on e.vec_id not in (q.a, q.b, q.c)", 1, 'qid, cand as answer, cast(rn as integer) as "rank", s as score')}""")
def v5_cosmul(spark, sf_dir):
    emb = _emb(spark, sf_dir)
    return VO.cosmul(_questions(emb), emb, k=1)


@register("v13_analogy_accuracy", f"""WITH {_E}, {_Q},
    d AS (select q.* from q join e on e.vec_id = q.a + 3),
    t AS (select d.qid, d.a, d.b, d.c,
                 list_transform(range(1, len(ea.v) + 1),
                                lambda i: (eb.v[i] / eb.n + ec.v[i] / ec.n) - ea.v[i] / ea.n) v
          from d join e ea on ea.vec_id = d.a join e eb on eb.vec_id = d.b join e ec on ec.vec_id = d.c),
    tn AS (select *, sqrt(list_dot_product(v, v)) n from t),
    ans AS ({_topk_sql("select tn.qid, e.vec_id cand, round(" + _COS.format(a='tn', b='e') + ", 6) s from tn join e on e.vec_id not in (tn.a, tn.b, tn.c)", 1, 'qid, cand')})
    select count(*) as n_questions, cast(coalesce(sum(case when ans.cand = d.a + 3 then 1 else 0 end), 0) as bigint) as n_correct,
           round(coalesce(sum(case when ans.cand = d.a + 3 then 1 else 0 end), 0) / count(*), 6) as accuracy
    from d left join ans on d.qid = ans.qid""")
def v13_analogy_accuracy(spark, sf_dir):
    emb = _emb(spark, sf_dir)
    return VO.analogy_accuracy(_questions(emb, with_answer=True), emb)


@register("v8_outlier", f"""WITH u AS (select label, vec_id,
        list_transform(cast(embedding as double[]),
                       lambda x: x / sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[])))) v
        from embeddings),
    m AS (select label, list(x order by i) v from (select label, i, avg(x) x from
          (select label, unnest(v) x, generate_subscripts(v, 1) i from u) z group by label, i) g group by label),
    s AS (select u.label, u.vec_id,
                 round(list_dot_product(u.v, m.v) / (sqrt(list_dot_product(u.v, u.v)) * sqrt(list_dot_product(m.v, m.v))), 6) sim
          from u join m on u.label = m.label)
    select label, vec_id, sim as similarity from (
      select *, row_number() over (partition by label order by sim, vec_id) rn from s) r where rn = 1""")
def v8_outlier(spark, sf_dir):
    emb = _emb(spark, sf_dir)
    return VO.outlier(emb.select("label", "vec_id"), emb)


@register("v12_cosine", f"""WITH {_E}
    select a.vec_id, b.vec_id as next_id, round({_COS.format(a='a', b='b')}, 6) as cosine
    from e a join e b on b.vec_id = a.vec_id + 1""")
def v12_cosine(spark, sf_dir):
    emb = _emb(spark, sf_dir)
    nxt = emb.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("next_id"),
                     F.col("embedding").alias("e2"))
    return emb.join(nxt, "vec_id").select("vec_id", "next_id",
                                          F.round(V.cosine("embedding", "e2"), 6).alias("cosine"))


@register("v7_word_algebra", f"""WITH {_E}, {_Q},
    mixed AS ({_topk_sql(
        "select q.qid, e.vec_id cand, round(((1.0 + " + _COS.format(a='ea', b='e') + ") / 2.0) * ((1.0 + "
        + _COS.format(a='eb', b='e') + ") / 2.0) / ((1.0 + " + _COS.format(a='ec', b='e') + ") / 2.0 + 0.001), 6) s "
        "from q join e ea on ea.vec_id = q.a join e eb on eb.vec_id = q.b join e ec on ec.vec_id = q.c "
        "join e on e.vec_id not in (q.a, q.b, q.c)", 1, 'qid, cand as answer, s as score')}),
    neg AS ({_topk_sql(
        "select a.vec_id + 1099511627776 as qid, e.vec_id cand, round(-(" + _COS.format(a='a', b='e') + "), 6) s "
        "from e a join e on e.vec_id <> a.vec_id", 1, 'qid, cand as answer, s as score')})
    select * from mixed union all select * from neg""")
def v7_word_algebra(spark, sf_dir):
    """a + b - c per derived question (3CosMul), and '- a' (additive) for every vector."""
    emb = _emb(spark, sf_dir)
    q = _questions(emb)
    mixed = q.select(F.col("qid"), F.array("a", "b").alias("positives"), F.array("c").alias("negatives"))
    only_neg = emb.select((F.col("vec_id").cast("long") + F.lit(1 << 40)).alias("qid"),
                          F.array().cast("array<long>").alias("positives"),
                          F.array(F.col("vec_id").cast("long")).alias("negatives"))
    return VO.word_algebra(mixed.unionByName(only_neg), emb)


# legs of a graph that tasks may hold: 16 bytes each, so 48 MB a worker
LOCAL_LEGS = 3_000_000


@register("g3_shortest_paths")
def g3_shortest_paths(spark, sf_dir):
    """Exact shortest path from every vector to the next id over its 5-NN graph (cost 1 - cos)."""
    from ..operators.graph import shortest_paths
    emb = _emb(spark, sf_dir)
    edges = reliable_checkpoint(VO.knn_graph(emb, k=5))
    ids = emb.select(F.col("vec_id").cast("long").alias("source"))
    pairs = (ids.join(ids.select(F.col("source").alias("target")), F.col("target") == F.col("source") + 1)
             .withColumn("qid", F.col("source")))
    return shortest_paths(edges, pairs, local_legs=LOCAL_LEGS)


@register("g4_beam_paths")
def g4_beam_paths(spark, sf_dir):
    """Weighted A*-like beam search (w=4, beam 60) for the same pairs as g3."""
    from ..operators.graph import shortest_paths
    emb = _emb(spark, sf_dir)
    edges = reliable_checkpoint(VO.knn_graph(emb, k=5))
    ids = emb.select(F.col("vec_id").cast("long").alias("source"))
    pairs = (ids.join(ids.select(F.col("source").alias("target")), F.col("target") == F.col("source") + 1)
             .withColumn("qid", F.col("source")))
    return shortest_paths(edges, pairs, vectors=emb, heuristic_weight=4.0, beam=60, local_legs=LOCAL_LEGS)


@register("j14_neighbors_as_text", f"""WITH {_E},
    nb AS (select id, neighbor_id, "rank" from (
      select id, neighbor_id, row_number() over (partition by id order by similarity desc, neighbor_id) as "rank"
      from (select a.vec_id id, b.vec_id neighbor_id, round({_COS.format(a='a', b='b')}, 6) similarity
            from e a join e b on a.vec_id <> b.vec_id) s) r where "rank" <= 10),
    titles AS (select p_partkey id, concat('Part_', cast(p_partkey as varchar)) title from part)
    select nb.id, string_agg(t.title, ' | ' order by nb."rank") as neighbors
    from nb left join titles t on nb.neighbor_id = t.id
    group by nb.id having count(*) = count(t.title)""")
def j14_neighbors_as_text(spark, sf_dir):
    """Top-10 neighbours of each vector as ' | '-joined article titles (vector id = part key)."""
    from ..operators.resolve import titles_for_lists
    emb = _emb(spark, sf_dir)
    nb = VO.similar_articles(emb, k=10)
    titles = Tables(spark, sf_dir).w_titles
    return titles_for_lists(nb, titles, key="id", member="neighbor_id", pos="rank", out="neighbors")



# Bellman-Ford as 40 levels of min-cost relaxation (more than the hop count of
# any shortest path on the 5-NN graph at the checked scale factor).
_BF = """d0 AS (select q.qid, q.a node, 0.0::double cost from q0 q),
    d1 AS (select qid, node, min(cost) cost from (select * from d0 union all select d.qid, g.dst, d.cost + g.cost from d0 d join g on d.node = g.src) x group by qid, node),
    d2 AS (select qid, node, min(cost) cost from (select * from d1 union all select d.qid, g.dst, d.cost + g.cost from d1 d join g on d.node = g.src) x group by qid, node),
    d3 AS (select qid, node, min(cost) cost from (select * from d2 union all select d.qid, g.dst, d.cost + g.cost from d2 d join g on d.node = g.src) x group by qid, node),
    d4 AS (select qid, node, min(cost) cost from (select * from d3 union all select d.qid, g.dst, d.cost + g.cost from d3 d join g on d.node = g.src) x group by qid, node),
    d5 AS (select qid, node, min(cost) cost from (select * from d4 union all select d.qid, g.dst, d.cost + g.cost from d4 d join g on d.node = g.src) x group by qid, node),
    d6 AS (select qid, node, min(cost) cost from (select * from d5 union all select d.qid, g.dst, d.cost + g.cost from d5 d join g on d.node = g.src) x group by qid, node),
    d7 AS (select qid, node, min(cost) cost from (select * from d6 union all select d.qid, g.dst, d.cost + g.cost from d6 d join g on d.node = g.src) x group by qid, node),
    d8 AS (select qid, node, min(cost) cost from (select * from d7 union all select d.qid, g.dst, d.cost + g.cost from d7 d join g on d.node = g.src) x group by qid, node),
    d9 AS (select qid, node, min(cost) cost from (select * from d8 union all select d.qid, g.dst, d.cost + g.cost from d8 d join g on d.node = g.src) x group by qid, node),
    d10 AS (select qid, node, min(cost) cost from (select * from d9 union all select d.qid, g.dst, d.cost + g.cost from d9 d join g on d.node = g.src) x group by qid, node),
    d11 AS (select qid, node, min(cost) cost from (select * from d10 union all select d.qid, g.dst, d.cost + g.cost from d10 d join g on d.node = g.src) x group by qid, node),
    d12 AS (select qid, node, min(cost) cost from (select * from d11 union all select d.qid, g.dst, d.cost + g.cost from d11 d join g on d.node = g.src) x group by qid, node),
    d13 AS (select qid, node, min(cost) cost from (select * from d12 union all select d.qid, g.dst, d.cost + g.cost from d12 d join g on d.node = g.src) x group by qid, node),
    d14 AS (select qid, node, min(cost) cost from (select * from d13 union all select d.qid, g.dst, d.cost + g.cost from d13 d join g on d.node = g.src) x group by qid, node),
    d15 AS (select qid, node, min(cost) cost from (select * from d14 union all select d.qid, g.dst, d.cost + g.cost from d14 d join g on d.node = g.src) x group by qid, node),
    d16 AS (select qid, node, min(cost) cost from (select * from d15 union all select d.qid, g.dst, d.cost + g.cost from d15 d join g on d.node = g.src) x group by qid, node),
    d17 AS (select qid, node, min(cost) cost from (select * from d16 union all select d.qid, g.dst, d.cost + g.cost from d16 d join g on d.node = g.src) x group by qid, node),
    d18 AS (select qid, node, min(cost) cost from (select * from d17 union all select d.qid, g.dst, d.cost + g.cost from d17 d join g on d.node = g.src) x group by qid, node),
    d19 AS (select qid, node, min(cost) cost from (select * from d18 union all select d.qid, g.dst, d.cost + g.cost from d18 d join g on d.node = g.src) x group by qid, node),
    d20 AS (select qid, node, min(cost) cost from (select * from d19 union all select d.qid, g.dst, d.cost + g.cost from d19 d join g on d.node = g.src) x group by qid, node),
    d21 AS (select qid, node, min(cost) cost from (select * from d20 union all select d.qid, g.dst, d.cost + g.cost from d20 d join g on d.node = g.src) x group by qid, node),
    d22 AS (select qid, node, min(cost) cost from (select * from d21 union all select d.qid, g.dst, d.cost + g.cost from d21 d join g on d.node = g.src) x group by qid, node),
    d23 AS (select qid, node, min(cost) cost from (select * from d22 union all select d.qid, g.dst, d.cost + g.cost from d22 d join g on d.node = g.src) x group by qid, node),
    d24 AS (select qid, node, min(cost) cost from (select * from d23 union all select d.qid, g.dst, d.cost + g.cost from d23 d join g on d.node = g.src) x group by qid, node),
    d25 AS (select qid, node, min(cost) cost from (select * from d24 union all select d.qid, g.dst, d.cost + g.cost from d24 d join g on d.node = g.src) x group by qid, node),
    d26 AS (select qid, node, min(cost) cost from (select * from d25 union all select d.qid, g.dst, d.cost + g.cost from d25 d join g on d.node = g.src) x group by qid, node),
    d27 AS (select qid, node, min(cost) cost from (select * from d26 union all select d.qid, g.dst, d.cost + g.cost from d26 d join g on d.node = g.src) x group by qid, node),
    d28 AS (select qid, node, min(cost) cost from (select * from d27 union all select d.qid, g.dst, d.cost + g.cost from d27 d join g on d.node = g.src) x group by qid, node),
    d29 AS (select qid, node, min(cost) cost from (select * from d28 union all select d.qid, g.dst, d.cost + g.cost from d28 d join g on d.node = g.src) x group by qid, node),
    d30 AS (select qid, node, min(cost) cost from (select * from d29 union all select d.qid, g.dst, d.cost + g.cost from d29 d join g on d.node = g.src) x group by qid, node),
    d31 AS (select qid, node, min(cost) cost from (select * from d30 union all select d.qid, g.dst, d.cost + g.cost from d30 d join g on d.node = g.src) x group by qid, node),
    d32 AS (select qid, node, min(cost) cost from (select * from d31 union all select d.qid, g.dst, d.cost + g.cost from d31 d join g on d.node = g.src) x group by qid, node),
    d33 AS (select qid, node, min(cost) cost from (select * from d32 union all select d.qid, g.dst, d.cost + g.cost from d32 d join g on d.node = g.src) x group by qid, node),
    d34 AS (select qid, node, min(cost) cost from (select * from d33 union all select d.qid, g.dst, d.cost + g.cost from d33 d join g on d.node = g.src) x group by qid, node),
    d35 AS (select qid, node, min(cost) cost from (select * from d34 union all select d.qid, g.dst, d.cost + g.cost from d34 d join g on d.node = g.src) x group by qid, node),
    d36 AS (select qid, node, min(cost) cost from (select * from d35 union all select d.qid, g.dst, d.cost + g.cost from d35 d join g on d.node = g.src) x group by qid, node),
    d37 AS (select qid, node, min(cost) cost from (select * from d36 union all select d.qid, g.dst, d.cost + g.cost from d36 d join g on d.node = g.src) x group by qid, node),
    d38 AS (select qid, node, min(cost) cost from (select * from d37 union all select d.qid, g.dst, d.cost + g.cost from d37 d join g on d.node = g.src) x group by qid, node),
    d39 AS (select qid, node, min(cost) cost from (select * from d38 union all select d.qid, g.dst, d.cost + g.cost from d38 d join g on d.node = g.src) x group by qid, node),
    d40 AS (select qid, node, min(cost) cost from (select * from d39 union all select d.qid, g.dst, d.cost + g.cost from d39 d join g on d.node = g.src) x group by qid, node)"""


@register("g3_path_costs", f"""WITH {_E},
    g AS (select id as src, neighbor_id as dst, round(1.0 - similarity, 6) as cost from (
      select id, neighbor_id, similarity,
             row_number() over (partition by id order by similarity desc, neighbor_id) as rk
      from (select a.vec_id id, b.vec_id neighbor_id, round({_COS.format(a='a', b='b')}, 6) similarity
            from e a join e b on a.vec_id <> b.vec_id) s) r where rk <= 5),
    q0 AS (select a.vec_id qid, a.vec_id a, b.vec_id b from e a join e b on b.vec_id = a.vec_id + 1),
    {_BF}
    select q0.qid, q0.a as source, q0.b as target, round(d.cost, 6) as cost
    from q0 join d40 d on d.qid = q0.qid and d.node = q0.b""")
def g3_path_costs(spark, sf_dir):
    """Costs of the exact shortest paths of ``g3_shortest_paths`` (checked by Bellman-Ford in SQL)."""
    return g3_shortest_paths(spark, sf_dir).select("qid", "source", "target", F.round("cost", 6).alias("cost"))
