"""Cases that once went wrong: rows lost by data layout, caps, and small wrong answers."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from encyclo.functions import markup as M
from encyclo.functions import text as X
from encyclo.operators import corpus as K
from encyclo.operators import graph as G
from encyclo.operators import learn as L
from encyclo.operators import resolve as R
from encyclo.operators import tagmatch as TM
from encyclo.operators import vectors as V
from encyclo.plans.indexing import dense_index
from encyclo.sources import sinks


def test_dense_index_keeps_wide_rows(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    try:
        df = spark.range(400_000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), F.repeat(F.lit("x"), 200).alias("w"))
        out = dense_index(df, ["k"], rows_per_bucket=20_000)
        s = out.agg(F.count("*"), F.countDistinct("idx"), F.min("idx"), F.max("idx")).first()
        assert tuple(s) == (400_000, 400_000, 0, 399_999)
        pairs = out.where("idx % 1000 = 0").select("idx", "k").orderBy("idx").collect()
        assert [r.k for r in pairs] == sorted(r.k for r in pairs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_dense_index_nulls_and_directions(spark):
    rows = [(None, "a"), (3, "b"), (3, "a"), (1, None), (1, "z"), (None, "b")] + [(k, "q") for k in range(10, 60)]
    df = spark.createDataFrame(rows, "n int, w string")
    for down in ((), ("n",), ("n", "w"), ("w",)):
        got = [tuple(r)[:2] for r in dense_index(df, ["n", "w"], descending=down, rows_per_bucket=5).orderBy("idx").collect()]
        want = [tuple(r) for r in df.orderBy(*[F.col(c).desc() if c in down else F.col(c) for c in ("n", "w")]).collect()]
        assert got == want


def test_class_batches_of_a_large_class(spark):
    df = spark.range(300_000).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("label"))
    out = L.class_batches(df, 1000).groupBy("label").agg(F.count("*").alias("n"), F.max("pos_in_class").alias("top"),
                                                        F.countDistinct("pos_in_class").alias("d")).collect()
    assert {(r.label, r.n, r.top, r.d) for r in out} == {("a", 100_000, 99_999, 100_000), ("b", 200_000, 199_999, 200_000)}


def test_dictionary_order_does_not_depend_on_the_cut(spark):
    tok = spark.createDataFrame([(k, ["a"] * (k < 9) + ["b"] * (k < 6) + ["c"] * (k < 6) + ["d"] * (k < 4)) for k in range(20)], "id long, tokens array<string>")
    order = [[r.word for r in K.build_dictionary(tok, keep_n=n).orderBy("word_id").collect()] for n in (10, None)]
    assert order[0] == order[1] == ["a", "b", "c", "d"]


def test_long_shortest_path(spark):
    edges = spark.createDataFrame([(k, k + 1, 1.0) for k in range(8)], "src long, dst long, cost double")
    pairs = spark.createDataFrame([(0, 0, 8)], "qid long, source long, target long")
    assert [tuple(r)[3:5] for r in G.shortest_paths(edges, pairs).collect()] == [(8.0, 8)]


@pytest.mark.parametrize("depth", [12, 400])
def test_nests_of_any_depth(spark, depth):
    df = spark.createDataFrame([("a" + "(" * depth + ")" * depth + "b", "x" + "{{" * depth + "}}" * depth + "y")], "p string, t string")
    assert tuple(df.select(X.remove_target("p", "()"), M.remove_nested("t", "{{", "}}")).first()) == ("ab", "xy")


def test_text_after_a_bullet_stays(spark):
    df = spark.createDataFrame([("one * two",)], "t string")
    assert tuple(df.select(M.clean_text("t"), M.clean_text("t", truncate_at_bullet=True)).first()) == ("one * two", "one")


def test_update_touches_for_any_column(spark):
    old = datetime(2001, 1, 1)
    target = spark.createDataFrame([(k, "q", "i", old) for k in (1, 2, 3)], "id long, quality string, importance string, updated_at timestamp")
    updates = spark.createDataFrame([(1, None, "new"), (2, "new", None), (3, None, None)], "id long, quality string, importance string")
    got = {r.id: r.updated_at > old for r in sinks.update_columns(target, updates).collect()}
    assert got == {1: True, 2: True, 3: False}


def test_broken_redirect_drops_the_link(spark):
    titles = spark.createDataFrame([("A", 1), ("B", 2)], "title string, id long")
    redirects = spark.createDataFrame([("B", "Missing"), ("C", "A")], "title string, target_title string")
    links = spark.createDataFrame([(9, 0, "A"), (9, 1, "B"), (9, 2, "C")], "id long, pos int, link string")
    assert sorted(tuple(r) for r in R.resolve_links(links, titles, redirects).collect()) == [(9, 0, 1), (9, 2, 1)]


def test_word_algebra_refuses_unknown_words(spark):
    vectors = spark.createDataFrame([(k, [float(k == 0), float(k == 1), 1.0 + k]) for k in range(5)], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [0, 1], [2]), (2, [0, 99], []), (3, [], [99])], "qid long, positives array<long>, negatives array<long>")
    assert {r.qid for r in V.word_algebra(queries, vectors).collect()} == {1}


def test_bare_model_loads(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors
    df = spark.createDataFrame([(0.0, Vectors.dense(0.0)), (1.0, Vectors.dense(1.0))], ["label", "features"])
    LogisticRegression(maxIter=2).fit(df).save(str(tmp_path / "m"))
    assert L.load_model(str(tmp_path / "m")).numClasses == 2


def test_tag_match_of_category_names(spark):
    tags = spark.createDataFrame([(0, "virginia", "virginia"), (1, "west_virginia", "west_virginia"), (2, "ohio", "ohio")],
                                 "class_idx int, class_name string, tag string")
    keys = spark.createDataFrame([("Category:Virginia",), ("west_virginia_towns",), ("Towns_in_Ohio",), ("Category:Ohioan",)], "title string")
    got = {r.title: r.class_name for r in TM.tag_match(keys, tags).collect()}
    assert got == {"Category:Virginia": "virginia", "west_virginia_towns": "west_virginia", "Towns_in_Ohio": "ohio"}


def test_topics_take_the_whole_vocabulary(spark, monkeypatch):
    from encyclo.plans import q_learn
    words = " ".join(f"word{k}" for k in range(2500))
    texts = spark.createDataFrame([(1, words), (2, words)], "id long, text string")
    monkeypatch.setattr(q_learn, "Tables", lambda *a: type("T", (), {"w_text": texts}))
    sizes, topics = [], L.topics
    monkeypatch.setattr(L, "topics", lambda *a, **k: (out := topics(*a, **k), sizes.append(len(out[1])))[0])
    assert q_learn.m14_topics(spark, "").count() == 5 and sizes == [2500]


def test_beam_finds_every_reachable_pair(spark):
    # the beam of one follows the cheap dead ends; node 8 has no vector
    edges = spark.createDataFrame([(1, 2, 0.1), (2, 3, 0.1), (1, 4, 0.5), (1, 5, 0.6), (5, 8, 0.1), (8, 9, 0.1)],
                                  "src long, dst long, cost double")
    pairs = spark.createDataFrame([(1, 1, 9), (2, 1, 3), (3, 9, 1)], "qid long, source long, target long")
    vec = spark.createDataFrame([(k, [1.0, float(k)]) for k in (1, 2, 3, 4, 5, 9)], "vec_id long, embedding array<double>")
    got = G.shortest_paths(edges, pairs, vectors=vec, heuristic_weight=0.1, beam=1)
    assert {(r.qid, tuple(r.path)) for r in got.collect()} == {(1, (1, 5, 8, 9)), (2, (1, 2, 3))}


def test_beam_query_has_the_pairs_of_the_exact_one(spark):
    from conftest import SF01
    from encyclo.plans.registry import load_all
    pairs = [{(r.source, r.target) for r in load_all()[q].fn(spark, SF01).select("source", "target").collect()}
             for q in ("g3_shortest_paths", "g4_beam_paths")]
    assert pairs[0] == pairs[1]
