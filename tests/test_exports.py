"""Sorted exports and paged adjacency lists; class weights and stacked models as stated."""

import glob

from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from encyclo.operators import categories as C
from encyclo.operators import learn as L
from encyclo.sources import sinks as S


def test_concatenated_parts_are_sorted(spark, tmp_path):
    frame = spark.range(5000).select(F.lit("a\tb\nc").alias("title"), ((F.col("id") * 7919) % 5003).alias("id"), F.array(F.lit("x\ty"), F.lit("z")).alias("l")).repartition(5)
    manifest = S.export_sorted(frame, str(tmp_path / "out"), "id", partitions=6).orderBy("file").collect()
    lines = [x for f in sorted(glob.glob(f"{tmp_path}/out/part-*")) for x in open(f).read().splitlines()]
    assert len(lines) == 5000 and {x.split("\t", 1)[1] for x in lines} == {"a b c\tx y z"}
    ids = [int(x.split("\t")[0]) for x in lines]
    assert ids == sorted(ids) and len(manifest) == 6 and sum(m.n_rows for m in manifest) == 5000
    assert all(a.last_key < b.first_key for a, b in zip(manifest, manifest[1:]))
    assert manifest[0].first_key == ids[0] and manifest[-1].last_key == ids[-1]
    assert S.export_sorted(frame.limit(0), str(tmp_path / "none"), "id").collect() == []


def test_a_hub_makes_no_large_row(spark):
    hub = spark.range(3000).select(F.lit(7).alias("parent"), F.col("id").alias("child"))
    rest = spark.range(6000).select((100 + F.col("id") % 2000).alias("parent"), F.col("id").alias("child"))
    odd = spark.createDataFrame([(7, 5), (7, None), (None, 3)], "parent int, child long")
    rows = C.paged_lists(hub.union(rest.select(F.col("parent").cast("int"), "child")).union(odd), "parent", "child", page_size=250).collect()
    assert max(len(r["items"]) for r in rows) == 250
    own = sorted((r.page, r["items"]) for r in rows if r.parent == 7)
    assert [p for p, _ in own] == list(range(12)) and [x for _, i in own for x in i] == list(range(3000))
    ranks = {r.parent: (r["rank"], r.n_items) for r in rows}
    assert ranks[7] == (0, 3000) and sorted(ranks, key=lambda k: ranks[k][0]) == sorted(ranks, key=lambda k: (-ranks[k][1], k))
    assert len(ranks) == 2001 and C.paged_lists(odd.limit(0), "parent", "child").collect() == []


def test_weights_of_absent_classes(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "label string")
    classes = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    assert sorted(tuple(r) for r in L.class_weights(df, classes=classes).collect()) == [("a", 2, 1.0), ("b", 1, 2.0), ("c", 0, 1.0)]


def test_stacked_and_cross_validation_by_kind(spark):
    rows = [(i, Vectors.dense([i % 3 == k and 2.0 or 0.1 * (i % 5) for k in range(3)]), float(i % 3)) for i in range(120)]
    df = spark.createDataFrame(rows, ["id", "features", "label"]).cache()
    model = L.train_classifier(df, "stacked", n_classes=3, max_iter=30)
    assert [type(s).__name__ for s in model.stages] == ["OneVsRestModel", "MultilayerPerceptronClassificationModel", "LogisticRegressionModel"]
    assert model.stages[2].numFeatures == 3
    assert L.accuracy(L.predict(model, df)).first().accuracy > 0.9
    cv = L.cross_validate(df, "ovr", folds=3, max_iter=10)
    assert type(cv.bestModel).__name__ == "OneVsRestModel" and cv.avgMetrics[0] > 0.9
