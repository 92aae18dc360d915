"""Training by epochs with validation: warm starts, a log of metrics, the best model kept.

An epoch goes on from the weights of the one before, on the whole training set or
on the batch that is its turn (``learn.class_batches``).  After it the model is judged on
the validation set; when the loss has risen ``patience`` epochs in a row training
stops, and the model of the least validation loss is returned.

A multinomial logistic model is the network without a hidden layer: both kinds
are MLlib networks, whose weights can be handed on.  Gradients are summed over
the data by Spark; the driver holds the weights and one line of the log per
iteration.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIDDEN = {"logistic": [], "mlp": [100, 50, 20, 5], "doc_mlp": [64, 64]}
LOG = "epoch int, iteration int, train_loss double, val_loss double, val_accuracy double, best boolean"


@dataclass
class Run:
    """``log``: (epoch, iteration, train_loss, val_loss, val_accuracy, best) by epoch and iteration;
    validation stands at an epoch's last iteration, ``best`` at the one whose model this is."""

    model: MultilayerPerceptronClassificationModel
    log: DataFrame
    best_epoch: int
    stopped: bool


def judge(model, rows: DataFrame, label_col: str = "label") -> tuple[float, float]:
    """Mean negative log probability of the labels, and accuracy."""
    p = F.greatest(F.element_at(vector_to_array("probability"), F.col(label_col).cast("int") + 1), F.lit(1e-15))
    loss, acc = model.transform(rows).agg(F.avg(-F.log(p)), F.avg((F.col("prediction") == F.col(label_col)).cast("double"))).first()
    return loss, acc


def train_epochs(train: DataFrame, validation: DataFrame, kind: str = "logistic", epochs: int = 10, iterations: int = 10,
                 patience: int = 1, n_classes: int | None = None, batch_col: str | None = None, label_col: str = "label",
                 features_col: str = "features", seed: int = 7) -> Run:
    """Fit 'logistic', 'mlp' (hidden 100, 50, 20, 5) or 'doc_mlp' (64, 64) by epochs.

    With ``batch_col`` (0, 1, ... without a gap) epoch ``e`` takes the batch ``e`` modulo their number.
    """
    first = train.select(features_col).first()
    if first is None or validation.isEmpty():
        raise ValueError("training and validation need rows")
    k = n_classes or int(train.unionByName(validation, allowMissingColumns=True).agg(F.max(label_col)).first()[0]) + 1
    batches = train.agg(F.max(batch_col)).first()[0] + 1 if batch_col else 1
    net = MultilayerPerceptronClassifier(featuresCol=features_col, labelCol=label_col, layers=[len(first[0]), *HIDDEN[kind], k],
                                         maxIter=iterations, seed=seed)
    lines, best, best_loss, best_epoch, risen, last = [], None, None, -1, 0, None
    for epoch in range(epochs):
        rows = train.where(F.col(batch_col) == epoch % batches) if batch_col else train
        model = net.fit(rows)
        net = net.copy({net.initialWeights: model.weights})
        loss, acc = judge(model, validation, label_col)
        history = [float(x) for x in model.summary().objectiveHistory]
        lines += [[epoch, i, x, None, None, False] for i, x in enumerate(history)]
        lines[-1][3:5] = [float(loss), float(acc)]
        if best_loss is None or loss < best_loss:
            best, best_loss, best_epoch, best_line = model, loss, epoch, len(lines) - 1
        risen = risen + 1 if last is not None and loss > last else 0
        last = loss
        if risen >= patience:
            break
    lines[best_line][5] = True
    log = train.sparkSession.createDataFrame([tuple(x) for x in lines], LOG).orderBy("epoch", "iteration")
    return Run(best, log, best_epoch, risen >= patience)
