"""Training of direction classifiers with Spark ML, and scoring with those or with any other model."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType, IntegralType

from . import dataset, evaluate


def train_classifier(df: DataFrame, columns: list[str], kind: str = "logistic", hidden: tuple[int, ...] = (32, 16), iterations: int = 50, weighted: bool = True, seed: int = 1) -> PipelineModel:
    """``logistic``: multinomial regression with class weights. ``mlp``: a perceptron; it takes no weights, so balance
    its rows beforehand (:func:`dataset.balanced_resample`)."""
    assemble = VectorAssembler(inputCols=columns, outputCol="_features")
    if kind == "logistic":
        df = dataset.with_weights(df) if weighted else df.withColumn("weight", F.lit(1.0))
        model = LogisticRegression(featuresCol="_features", labelCol="label", weightCol="weight", family="multinomial", maxIter=iterations)
    elif kind == "mlp":
        model = MultilayerPerceptronClassifier(featuresCol="_features", labelCol="label", layers=[len(columns), *hidden, 3], maxIter=iterations, seed=seed)
    else:
        raise ValueError(f"no such classifier: {kind}")
    return Pipeline(stages=[assemble, model]).fit(df)


def score(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    """(model, ticker, ts, actual, logits): log probabilities stand for logits."""
    p = vector_to_array("probability")
    logits = F.transform(p, lambda x: F.log(F.greatest(x, F.lit(1e-12))))
    return model.transform(df).select(F.lit(name).alias("model"), "ticker", "ts", F.col("label").cast("int").alias("actual"), logits.alias("logits"))


@cache
def _made(load: Callable, args: tuple, more: tuple) -> Callable[[np.ndarray], np.ndarray]:
    return load(*args, **dict(more))


def _loaded(load: Callable) -> Callable[[np.ndarray], np.ndarray]:
    """A worker's copy of a model: made once, and used for all its tasks."""
    if isinstance(load, partial):
        return _made(load.func, load.args, tuple(sorted(load.keywords.items())))
    return _made(load, (), ())


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of numbers, all lists of one length, as rows of a matrix; missing numbers are NaN."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _places(column: pa.Array) -> np.ndarray:
    """A list column of structs of numbers, all lists of one length, as rows of a matrix, place by place; missing numbers are NaN."""
    fields = [f.to_numpy(zero_copy_only=False).astype(np.float64) for f in column.flatten().flatten()]
    return np.stack(fields, axis=-1).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def score_with(load: Callable[[], Callable[[np.ndarray], np.ndarray]], df: DataFrame, columns: list[str], name: str, window: str | None = None, rows: int = 4_096) -> DataFrame:
    """(model, ticker, ts, actual, logits) by a model of the user's own. ``load`` gives a function from inputs to logits, rows
    by classes; it is called once for each worker, reads what the model needs where workers can reach it, and must be known
    by name (a function of a module, or a ``functools.partial`` of one with hashable arguments).

    Inputs are rows by ``columns``, or, with ``window`` (an array of structs as :func:`dataset.sequences` makes them), rows by
    places in the sequence by columns: what recurrent and convolutional nets take. ``rows`` bounds a call. Missing values are
    NaN for the model; rows whose window is of another length than the first of their batch are an error."""
    parts = F.array(*[F.col(c).cast("double") for c in columns])
    fields = df.schema[window].dataType.elementType.fields if window else []
    whole_window = bool(window) and [x.name for x in fields] == columns and all(isinstance(x.dataType, (FractionalType, IntegralType)) for x in fields)
    if whole_window:
        parts = F.col(window)
    elif window:
        parts = F.flatten(F.transform(window, lambda x: F.array(*[x[c].cast("double") for c in columns])))
    actual = F.col("label").cast("int") if "label" in df.columns else F.lit(None).cast("int")
    wide = df.select("ticker", "ts", actual.alias("actual"), parts.alias("_x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(load)
        for whole in batches:
            for batch in (whole.slice(k, rows) for k in range(0, len(whole), rows)):
                x = _places(batch.column("_x")) if whole_window else _matrix(batch.column("_x"))
                if window:
                    x = x.reshape(len(batch), -1, len(columns))
                logits = np.asarray(model(x), dtype=np.float64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * logits.shape[1], pa.int32()), pa.array(logits.ravel()))
                kept = [batch.column(c) for c in ("ticker", "ts", "actual")]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(batch)), *kept, lists], ["model", "ticker", "ts", "actual", "logits"])

    kinds = dict(wide.dtypes)
    return wide.mapInArrow(run, f"model string, ticker {kinds['ticker']}, ts {kinds['ts']}, actual int, logits array<double>")


def dense(weights: tuple[tuple[float, ...], ...], bias: tuple[float, ...]) -> Callable[[np.ndarray], np.ndarray]:
    """A linear layer; of sequences it takes the last place."""
    w, b = np.array(weights), np.array(bias)
    return lambda x: (x[:, -1] if x.ndim == 3 else x) @ w + b


def elman(inner: tuple[tuple[float, ...], ...], own: tuple[tuple[float, ...], ...], weights: tuple[tuple[float, ...], ...], bias: tuple[float, ...]) -> Callable[[np.ndarray], np.ndarray]:
    """A recurrent net over sequences: h = tanh(x inner + h own), logits from the last h."""
    u, r, head = np.array(inner), np.array(own), dense(weights, bias)

    def run(x: np.ndarray) -> np.ndarray:
        h = np.zeros((len(x), len(r)))
        for t in range(x.shape[1]):
            h = np.tanh(x[:, t] @ u + h @ r)
        return head(h)

    return run


def compare(*scored: DataFrame) -> DataFrame:
    """(model, accuracy, weighted_f1, place): all models by accuracy, the best first, ties by name."""
    rows = evaluate.predicted(dataset.union_all(*scored))
    both = evaluate.accuracy(rows).join(evaluate.weighted_f1(rows), "model")
    return both.withColumn("place", F.row_number().over(W.partitionBy().orderBy(F.col("accuracy").desc(), "model")))  # a row for each model
