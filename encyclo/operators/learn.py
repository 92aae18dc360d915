"""Labelled data, class statistics, batching, classifiers and their evaluation.

Models are MLlib estimators (LogisticRegression, OneVsRest,
MultilayerPerceptronClassifier, Word2Vec, LDA): training is distributed by
MLlib; the library only prepares DataFrames and evaluates predictions with
ordinary aggregations.
"""

from __future__ import annotations

from itertools import chain

from pyspark.ml import Pipeline
from pyspark.ml.classification import (LogisticRegression, MultilayerPerceptronClassifier,
                                       OneVsRest)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import argmax
from ..plans.indexing import dense_index

# Label maps of the classification tasks.
QUALITY_CLASSES = {"fa": 0, "a": 0, "ga": 0, "bplus": 0, "b": 1, "c": 2, "stub": 2}   # good/mediocre/poor
IMPORTANCE_CLASSES = {"top": 0, "high": 1, "mid": 2, "low": 3}


def label_map(col, mapping: dict) -> Column:
    """Literal map lookup; NULL for unmapped codes."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.element_at(m, F.lower(F.col(col) if isinstance(col, str) else col))


def labelled(data: DataFrame, labels: DataFrame, on: str = "id") -> DataFrame:
    """Inner join of data with its labels (texts or vectors)."""
    return data.join(labels, on, "inner")


def unanimous_label(assign: DataFrame, id_col: str = "id", label_col: str = "label") -> DataFrame:
    """Keep ids whose mapped labels all agree (NULL labels ignored): (id, label)."""
    return (assign.where(F.col(label_col).isNotNull())
            .groupBy(id_col).agg(F.min(label_col).alias("_mn"), F.max(label_col).alias("_mx"))
            .where(F.col("_mn") == F.col("_mx")).select(id_col, F.col("_mn").alias(label_col)))


def class_counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    """(label, n); rows without a class are counted under the null label."""
    return df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))


def class_lengths(df: DataFrame, tokens_col: str = "tokens", label_col: str = "label") -> DataFrame:
    return df.groupBy(label_col).agg(F.round(F.avg(F.size(tokens_col)), 6).alias("mean_len"))


def class_weights(df: DataFrame, label_col: str = "label", classes: DataFrame | None = None) -> DataFrame:
    """Largest class count / class count; the largest count is a scalar
    subquery over the per-class counts (one row per class).  With ``classes`` (one
    column, the label) every one has a row: an absent class has n 0 and weight 1."""
    c = class_counts(df, label_col)
    top = c.select(F.max("n")).scalar()
    weighed = c.select(label_col, "n", F.round(top / F.col("n"), 6).alias("weight"))
    if classes is None:
        return weighed
    return classes.select(label_col).distinct().join(weighed, label_col, "left").select(
        label_col, F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("weight", F.lit(1.0)).alias("weight"))


def cap_per_class(df: DataFrame, k: int, label_col: str = "label", order_col: str = "id") -> DataFrame:
    """First ``k`` rows per class in ``order_col`` order.  ``row_number() <= k``
    plans a partial WindowGroupLimit: each task forwards at most k rows per
    class, so a class holding a third of the data is no hot spot."""
    w = Window.partitionBy(label_col).orderBy(order_col)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def class_batches(df: DataFrame, k: int, label_col: str = "label", order_col: str = "id") -> DataFrame:
    """Batch number per row: ``floor(position_in_class / k)``.  Positions come
    from buckets of the sort order + their offsets (``dense_index``), so a huge
    class is split across tasks."""
    pos = dense_index(df, [label_col, order_col], "_gpos")
    first = pos.groupBy(label_col).agg(F.min("_gpos").alias("_first"))
    return (pos.join(first, label_col)
            .withColumn("pos_in_class", F.col("_gpos") - F.col("_first"))
            .withColumn("batch", F.floor(F.col("pos_in_class") / k).cast("long"))
            .drop("_gpos", "_first"))


def split_train_test(df: DataFrame, id_col: str = "id", train_frac: float = 0.8, seed: int = 42):
    """Reproducible split by a hash of the id: (train, test)."""
    h = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(10_000))
    cut = int(round(train_frac * 10_000))
    return df.where(h < cut), df.where(h >= cut)


def one_hot(label, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == label).cast("int"))


def vocab_band(words: DataFrame, lo: int = 3000, hi: int = 1_000_000, col: str = "doc_freq") -> DataFrame:
    return words.where(F.col(col).between(lo, hi))


def sequence_dataset(tokens: DataFrame, vocabulary: DataFrame, max_words: int = 120,
                     id_col: str = "id", drop_unknown: bool = False) -> DataFrame:
    """(id, seq): token ids (word_id + 1; 0 = unknown/padding) of the first
    ``max_words`` positions, padded with 0.  The regroup is per document (its
    own tokens, bounded by the document size)."""
    ex = tokens.select(id_col, F.posexplode("tokens").alias("pos", "word"))
    v = vocabulary.select("word", (F.col("word_id") + 1).alias("wid"))
    j = ex.join(v, "word", "left")
    if drop_unknown:
        j = j.where(F.col("wid").isNotNull())
    g = (j.groupBy(id_col)
         .agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("wid", F.lit(0)).alias("w")))).alias("_s")))
    seq = F.slice(F.col("_s.w"), 1, max_words)
    return g.select(id_col, F.concat(seq, F.array_repeat(F.lit(0).cast("long"), F.lit(max_words) - F.size(seq)))
                    .alias("seq"))


def features(df: DataFrame, vec_col: str = "embedding", out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(vec_col)))


def train_classifier(train: DataFrame, kind: str = "logistic", label_col: str = "label",
                     features_col: str = "features", n_classes: int | None = None, seed: int = 7,
                     max_iter: int = 50):
    """Fit 'logistic', 'ovr' (one-vs-rest logistic), 'mlp' (hidden 100,50,20,5), 'doc_mlp' (64,64) or
    'stacked' (one-vs-rest scores -> MLP(3,3) -> logistic on the network's probabilities)."""
    return _estimator(train, kind, label_col, features_col, n_classes, seed, max_iter).fit(train)


def _estimator(train: DataFrame, kind: str, label_col: str, features_col: str, n_classes: int | None, seed: int, max_iter: int):
    if kind == "logistic":
        return LogisticRegression(featuresCol=features_col, labelCol=label_col, maxIter=max_iter)
    one_vs_rest = OneVsRest(classifier=LogisticRegression(maxIter=max_iter), featuresCol=features_col,
                            labelCol=label_col, parallelism=4)
    if kind == "ovr":
        return one_vs_rest
    k = int(n_classes or train.select(F.max(label_col)).first()[0] + 1)
    if kind in ("mlp", "doc_mlp"):
        dim = len(train.select(features_col).first()[0])
        hidden = [100, 50, 20, 5] if kind == "mlp" else [64, 64]
        return MultilayerPerceptronClassifier(featuresCol=features_col, labelCol=label_col,
                                              layers=[dim, *hidden, k], maxIter=max_iter, seed=seed)
    if kind == "stacked":
        # one-vs-rest reads its classifier's raw column under the name of its own
        first = OneVsRest(classifier=LogisticRegression(maxIter=max_iter, rawPredictionCol="r1"), featuresCol=features_col,
                          labelCol=label_col, rawPredictionCol="r1", predictionCol="y1", parallelism=4)
        mlp = MultilayerPerceptronClassifier(featuresCol="r1", labelCol=label_col, layers=[k, 3, 3, k],
                                             maxIter=max_iter, seed=seed, probabilityCol="p2",
                                             rawPredictionCol="r2", predictionCol="y2")
        last = LogisticRegression(featuresCol="p2", labelCol=label_col, maxIter=max_iter)
        return Pipeline(stages=[first, mlp, last])
    raise ValueError(kind)


def predict(model, df: DataFrame, id_col: str = "id", label_col: str = "label") -> DataFrame:
    """(id, label, prediction, probs array<double>)."""
    out = model.transform(df)
    cols = [id_col, label_col, F.col("prediction").cast("int").alias("prediction")]
    if "probability" in out.columns:
        cols.append(vector_to_array("probability").alias("probs"))
    return out.select(*cols)


def argmax_label(probs) -> Column:
    return argmax(probs)


def confusion_matrix(pred: DataFrame, label_col: str = "label", pred_col: str = "prediction") -> DataFrame:
    """(label, prediction, n, row_fraction): long form; the row sums come from a
    window over the per-cell counts (one row per cell)."""
    c = pred.groupBy(label_col, pred_col).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("row_fraction", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(label_col)), 6))


def accuracy(pred: DataFrame, label_col: str = "label", pred_col: str = "prediction") -> DataFrame:
    return pred.agg(F.count(F.lit(1)).alias("n"),
                    F.round(F.avg((F.col(label_col) == F.col(pred_col)).cast("double")), 6).alias("accuracy"))


def accuracy_with_folds(pred: DataFrame, fold_col: str = "fold", label_col: str = "label",
                        pred_col: str = "prediction") -> DataFrame:
    """Overall accuracy plus mean and 2 x std of the per-fold accuracies, from
    one per-fold aggregate (one row per fold)."""
    ok = (F.col(label_col) == F.col(pred_col)).cast("long")
    per = pred.groupBy(fold_col).agg(F.count(F.lit(1)).alias("nf"), F.sum(ok).alias("cf"))
    acc = F.col("cf") / F.col("nf")
    return per.agg(F.sum("nf").alias("n"), F.round(F.sum("cf") / F.sum("nf"), 6).alias("accuracy"),
                   F.count(F.lit(1)).alias("n_folds"), F.round(F.avg(acc), 6).alias("mean_accuracy"),
                   F.round(2 * F.stddev_pop(acc), 6).alias("two_std"))


def fold_scores(pred: DataFrame, fold_col: str = "fold", label_col: str = "label",
                pred_col: str = "prediction") -> DataFrame:
    """Mean accuracy over folds and twice its population standard deviation."""
    per = pred.groupBy(fold_col).agg(F.avg((F.col(label_col) == F.col(pred_col)).cast("double")).alias("acc"))
    return per.agg(F.count(F.lit(1)).alias("n_folds"), F.round(F.avg("acc"), 6).alias("mean_accuracy"),
                   F.round(2 * F.stddev_pop("acc"), 6).alias("two_std"))


def cross_validate(train: DataFrame, kind: str = "logistic", folds: int = 5, label_col: str = "label",
                   features_col: str = "features", seed: int = 7, n_classes: int | None = None, max_iter: int = 50):
    """k-fold cross validation of any ``kind`` on the training data; returns the fitted CrossValidatorModel."""
    est = _estimator(train, kind, label_col, features_col, n_classes, seed, max_iter)
    grid = ParamGridBuilder().build()
    ev = MulticlassClassificationEvaluator(labelCol=label_col, metricName="accuracy")
    return CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=ev, numFolds=folds,
                          seed=seed, parallelism=2).fit(train)


def training_log(model) -> DataFrame:
    """Loss per iteration of a fitted logistic model: (iteration, loss).  The
    history has one value per iteration (bounded by ``maxIter``)."""
    from pyspark.sql import SparkSession
    hist = model.summary.objectiveHistory
    return SparkSession.getActiveSession().createDataFrame(
        [(i, float(x)) for i, x in enumerate(hist)], "iteration int, loss double")


def score_documents(model, docs: DataFrame, id_col: str = "id") -> DataFrame:
    """Class probabilities and the arg-max class (-1 when no class is positive)."""
    out = model.transform(docs).select(id_col, vector_to_array("probability").alias("probs"))
    return out.withColumn("pred_class", argmax("probs"))


def score_words(model, words: DataFrame, min_prob: float = 0.6, id_col: str = "word") -> DataFrame:
    s = score_documents(model, words, id_col)
    return s.where(F.array_max("probs") > min_prob)


def train_embeddings(tokens: DataFrame, vector_size: int = 300, window: int = 8, min_count: int = 3,
                     max_iter: int = 1, partitions: int | None = None, seed: int = 7):
    """Word2Vec (skip-gram) over token arrays; returns the fitted model."""
    from pyspark.ml.feature import Word2Vec
    if partitions is None:  # as many training tasks as the corpus has partitions
        partitions = max(1, tokens.rdd.getNumPartitions())
    return Word2Vec(vectorSize=vector_size, windowSize=window, minCount=min_count, maxIter=max_iter,
                    numPartitions=partitions, seed=seed, inputCol="tokens", outputCol="vec").fit(tokens)


def doc_vectors(model, tokens: DataFrame, id_col: str = "id") -> DataFrame:
    """Document vector = mean of its word vectors (Word2VecModel.transform)."""
    return model.transform(tokens).select(id_col, vector_to_array("vec").alias("vec"))


def word_vectors(model, words: DataFrame, word_col: str = "word") -> DataFrame:
    """(word, vec) of the words in ``words`` that the model knows: each as a text of one word.

    ``getVectors`` makes the whole vocabulary a local table in the driver's plan; here the model
    goes to the tasks as it does for texts.  A word that it does not know has the zero vector."""
    one = model.transform(words.select(word_col, F.array(word_col).alias(model.getInputCol())))
    return (one.select(word_col, vector_to_array(model.getOutputCol()).alias("vec"))
            .where(F.exists("vec", lambda x: x != 0)))


def topics(tokens: DataFrame, k: int = 10, vocab_size: int = (1 << 31) - 1, max_iter: int = 10, seed: int = 7):
    """LDA topic model over token arrays: (model, vocabulary)."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer
    cv = CountVectorizer(inputCol="tokens", outputCol="counts", vocabSize=vocab_size, minDF=2).fit(tokens)
    lda = LDA(k=k, maxIter=max_iter, seed=seed, featuresCol="counts").fit(cv.transform(tokens))
    return lda, cv.vocabulary


def vector_dataset(vectors: DataFrame, labels: DataFrame, per_class: int | None = None,
                   id_col: str = "id", label_col: str = "label") -> DataFrame:
    """Labelled document vectors, optionally the first ``per_class`` per class."""
    j = labelled(vectors, labels, id_col)
    return cap_per_class(j, per_class, label_col, id_col) if per_class else j


def load_model(path: str):
    """Load a saved model of any kind (see ``sinks.save_model``)."""
    import json

    from pyspark.ml.util import DefaultParamsReader
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    meta = json.loads(spark.read.text(f"{path.rstrip('/')}/metadata").first()[0])
    name = meta["class"].replace("org.apache.spark", "pyspark")
    return DefaultParamsReader._DefaultParamsReader__get_class(name).load(path)


def run_task(train: DataFrame, test: DataFrame, kind: str = "logistic", label_col: str = "label",
             id_col: str = "id", **kw) -> dict:
    """One classification task end to end: fit, predict, accuracy, confusion matrix."""
    model = train_classifier(train, kind, label_col=label_col, **kw)
    pred = predict(model, test, id_col, label_col)
    return {"model": model, "predictions": pred, "accuracy": accuracy(pred, label_col),
            "confusion": confusion_matrix(pred, label_col)}
