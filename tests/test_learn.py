"""Learning helpers, batching under skew, tag matching against a regex brute force."""

import re

from pyspark.sql import functions as F

from conftest import SF001
from encyclo.operators import learn as L
from encyclo.operators import vectors as VO
from encyclo.operators.tagmatch import tag_match
from encyclo.plans.indexing import dense_index
from encyclo.sources.fixtures import Tables


def test_class_batches_hot_class(spark):
    # one class holds most rows: positions must still be dense per class
    rows = [(i, 0 if i % 10 else 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, label int").repartition(7)
    got = L.class_batches(df, 100).collect()
    by = {}
    for r in got:
        by.setdefault(r.label, []).append((r.id, r.pos_in_class, r.batch))
    for lab, xs in by.items():
        xs.sort()
        assert [p for _, p, _ in xs] == list(range(len(xs)))
        assert all(b == p // 100 for _, p, b in xs)


def test_dense_index_matches_sorted_order(spark):
    df = spark.createDataFrame([(f"w{i:05d}",) for i in range(997)], "word string").repartition(5)
    got = sorted((r.idx, r.word) for r in dense_index(df, ["word"], "idx").collect())
    assert got == list(enumerate(sorted(f"w{i:05d}" for i in range(997))))


def test_cap_confusion_weights(spark):
    df = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (3, 1, 1), (4, 1, 1), (5, 1, 0)],
                               "id long, label int, prediction int")
    cm = {(r.label, r.prediction): (r.n, r.row_fraction) for r in L.confusion_matrix(df).collect()}
    assert cm == {(0, 0): (1, 0.5), (0, 1): (1, 0.5), (1, 1): (2, 0.666667), (1, 0): (1, 0.333333)}
    assert L.accuracy(df).first().accuracy == 0.6
    w = {r.label: r.weight for r in L.class_weights(df).collect()}
    assert w == {0: 1.5, 1: 1.0}
    assert sorted(r.id for r in L.cap_per_class(df, 1).collect()) == [1, 3]
    u = L.unanimous_label(spark.createDataFrame([(1, 0), (1, 0), (2, 0), (2, 1), (3, None)], "id long, label int"))
    assert [(r.id, r.label) for r in u.collect()] == [(1, 0)]


def test_one_hot_argmax_split(spark):
    r = spark.range(1).select(L.one_hot(F.lit(2), 4).alias("o"),
                              L.argmax_label(F.array(F.lit(0.1), F.lit(0.7), F.lit(0.2))).alias("a"),
                              L.argmax_label(F.array(F.lit(-0.1), F.lit(0.0))).alias("b")).first()
    assert list(r.o) == [0, 0, 1, 0] and r.a == 1 and r.b == -1
    df = spark.range(10000)
    tr, te = L.split_train_test(df, "id", 0.8)
    n1, n2 = tr.count(), te.count()
    assert n1 + n2 == 10000 and 7600 < n1 < 8400
    assert tr.join(te, "id").count() == 0


def test_tag_match_equals_regex(spark):
    titles = Tables(spark, SF001).part.select(F.col("p_partkey").alias("id"),
                                             F.replace("p_name", F.lit(" "), F.lit("_")).alias("title"))
    tags = [(0, "hw", "bolt"), (0, "hw", "ring"), (1, "col", "red"), (2, "sz", "small"), (3, "x", "ol")]
    tdf = spark.createDataFrame(tags, "class_idx int, class_name string, tag string")
    got = {r.id: r.class_idx for r in tag_match(titles, tdf).collect()}
    for r in titles.collect():
        exp = None
        for idx, _, tag in tags:
            if re.search(r"(^|_)" + re.escape(tag) + r"(_|s|$)", r.title):
                exp = idx if exp is None else min(exp, idx)
        assert got.get(r.id) == exp, r.title


def test_models_run(spark):
    emb = L.features(Tables(spark, SF001).embeddings).withColumn("label", F.col("label").cast("double"))
    tr, te = L.split_train_test(emb, "vec_id")
    out = L.run_task(tr, te, "logistic", id_col="vec_id", max_iter=10)
    assert out["predictions"].count() == te.count()
    assert 0.0 <= out["accuracy"].first().accuracy <= 1.0
    assert L.training_log(out["model"]).count() >= 1
    dec = VO.decode(emb.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec")).limit(5),
                    Tables(spark, SF001).embeddings)
    assert all(r.qid == r.id and abs(r.similarity - 1.0) < 1e-6 for r in dec.collect())


def test_model_save_load_and_vocab_export(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from encyclo.operators import corpus as K
    from encyclo.sources import sinks as S
    emb = L.features(Tables(spark, SF001).embeddings).withColumn("label", F.col("label").cast("double"))
    model = Pipeline(stages=[LogisticRegression(maxIter=5)]).fit(emb)
    path = str(tmp_path / "model_2021-05-01_09-00-00")
    S.save_model(model, path)
    again = L.load_model(S.latest_version([str(tmp_path / "model_2020-01-01_00-00-00"), path]))
    a = [r.prediction for r in model.transform(emb).orderBy("vec_id").collect()]
    b = [r.prediction for r in again.transform(emb).orderBy("vec_id").collect()]
    assert a == b
    w2v = L.train_embeddings(K.tokens(Tables(spark, SF001).w_text), vector_size=8, min_count=3)
    S.write_vocab(w2v, str(tmp_path / "vocab"))
    assert spark.read.text(str(tmp_path / "vocab")).count() == w2v.getVectors().count()
