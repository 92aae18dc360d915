"""Epoch training with validation, and the stored text pipelines of the named tasks."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from encyclo.operators import textpipe as TP
from encyclo.operators.epochs import judge, train_epochs


def points(spark, n, seed, flip=False, batch=0):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        y = int(rng.integers(3))
        x = rng.normal(size=4) + 2.5 * np.eye(4)[y]
        rows.append((Vectors.dense(x), float((y + 1) % 3 if flip else y), batch))
    return spark.createDataFrame(rows, ["features", "label", "batch"])


@pytest.mark.parametrize("kind", ["logistic", "doc_mlp"])
def test_a_worse_epoch_is_not_kept(spark, kind):
    """The second batch has wrong labels: the loss rises, training stops, the first epoch's model is returned."""
    train = points(spark, 300, 1).unionByName(points(spark, 300, 2, flip=True, batch=1)).cache()
    val = points(spark, 200, 3).cache()
    run = train_epochs(train, val, kind, epochs=5, iterations=15, batch_col="batch")
    assert run.best_epoch == 0 and run.stopped
    log = run.log.collect()
    assert [(r.epoch, r.iteration) for r in log] == sorted((r.epoch, r.iteration) for r in log) and {r.epoch for r in log} == {0, 1}
    judged = [r for r in log if r.val_loss is not None]
    assert len(judged) == 2 and judged[1].val_loss > judged[0].val_loss and [r.best for r in judged] == [True, False]
    assert judge(run.model, val) == pytest.approx((judged[0].val_loss, judged[0].val_accuracy)) and judged[0].val_accuracy > 0.9


def test_epochs_go_on_from_the_weights_before(spark):
    train, val = points(spark, 300, 1).cache(), points(spark, 200, 3).cache()
    run = train_epochs(train, val, epochs=4, iterations=3, patience=9)
    ends, starts = {}, {}
    for r in run.log.collect():
        starts.setdefault(r.epoch, r.train_loss)
        ends[r.epoch] = r.train_loss
    assert not run.stopped and len(ends) == 4
    for e in range(1, 4):
        assert starts[e] == pytest.approx(ends[e - 1], abs=1e-6) and ends[e] <= starts[e]
    with pytest.raises(ValueError):
        train_epochs(train, val.limit(0))


def corpus(spark):
    """Two kinds of articles by their words; ratings, importance and categories follow the kind."""
    rng = np.random.default_rng(5)
    kinds = [["river", "lake", "water", "shore"], ["engine", "wheel", "motor", "road"]]
    texts, ratings, cats = [], [], []
    for i in range(240):
        k = i % 2
        words = [str(rng.choice(kinds[k])) if rng.random() < .6 else str(rng.choice(["the", "of", "and", "big"])) for _ in range(30)]
        texts.append((i, "The " + " ".join(words[:15]) + ". And, (" + " ".join(words[15:]) + ")"))
        ratings.append((i, ["fa", "stub"][k] if i % 9 else "list", ["top", "low"][k]))
        cats.append((i, ["Category:Rivers_of_Ohio", "Category:Roads_in_Texas"][k]))
        if i % 10 == 0:
            cats.append((i, "Category:Things"))
    texts += [(900, None), (901, ""), (902, "unseen words only")]
    ratings += [(900, "fa", "top"), (901, "stub", "low"), (902, "fa", "low")]
    tags = spark.createDataFrame([(0, "Ohio", "ohio"), (1, "Texas", "texas")], "class_idx int, class_name string, tag string")
    content = spark.createDataFrame([(0, "nature", "river"), (1, "transport", "road")], "class_idx int, class_name string, tag string")
    return (spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(ratings, "id long, quality string, importance string"),
            spark.createDataFrame(cats, "id long, title string"), tags, content)


@pytest.mark.parametrize("name", ["quality", "importance", "us_state", "content"])
def test_named_tasks_from_text_to_confusion_and_back(spark, tmp_path, name):
    texts, ratings, cats, states, content = corpus(spark)
    done = TP.named_task(name, texts, ratings, cats, states if name == "us_state" else content, stop_words=["the", "of", "and"],
                         size=8, window=3, minCount=2, sample=0.0, maxWords=12, max_iter=20)
    pred = {r.id: (r.prediction, tuple(r.probs)) for r in done["predictions"].collect()}
    assert done["accuracy"].first().accuracy > 0.9 and not {900, 901, 902} & set(pred)
    assert sum(r.n for r in done["confusion"].collect()) == len(pred) > 30
    done["model"].write().overwrite().save(str(tmp_path / "task"))
    back = TP.load_task(str(tmp_path / "task"))
    again = back.transform(texts).select("id", "prediction", "words", "seq").collect()
    assert all(pred[r.id][0] == r.prediction for r in again if r.id in pred) and {r.id for r in again} >= set(pred)
    assert all(len(r.seq) == 12 and not {"the", "of", "and"} & set(r.words) for r in again)


def test_window_counts_known_words(spark):
    words = spark.createDataFrame([("a", 5, [1.0, 0.0], 11), ("b", 5, [0.0, 1.0], 12)], "word string, n long, vector array<float>, word_id long")
    model = TP.WordVectorsModel(words)
    model._set(size=2, maxWords=3, minWords=2, inputCol="words")
    rows = spark.createDataFrame([(1, ["x", "b", "a", "x", "a", "b"]), (2, ["a", "x"]), (3, []), (4, ["a", "a"])], "id long, words array<string>")
    got = {r.id: (r.seq, r.features.toArray().round(6).tolist()) for r in model.transform(rows).collect()}
    assert got == {1: ([12, 11, 11], [0.666667, 0.333333]), 4: ([11, 11, 0], [1.0, 0.0])}
