"""Evaluation of scored tables: (model, actual, logits) with logits an array of three numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CLASSES = 3


def softmax(logits: Column | str) -> Column:
    x = F.col(logits) if isinstance(logits, str) else logits
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def argmax(logits: Column | str) -> Column:
    """The first class with the largest value, from 0."""
    x = F.col(logits) if isinstance(logits, str) else logits
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def predicted(scores: DataFrame) -> DataFrame:
    """Adds pred, p_down, p_neutral and p_up."""
    scores = scores.withColumns({"pred": argmax("logits"), "_p": softmax("logits")})
    return scores.withColumns({f"p_{n}": F.get("_p", F.lit(i)) for i, n in enumerate(("down", "neutral", "up"))}).drop("_p")


def accuracy(scored: DataFrame) -> DataFrame:
    return scored.groupBy("model").agg((F.avg((F.col("pred") == F.col("actual")).cast("double")) * 100).alias("accuracy"))


def _grid(scored: DataFrame, *names: str) -> DataFrame:
    """Every model with every class (or pair of classes)."""
    out = scored.select("model").distinct()
    for n in names:
        out = out.withColumn(n, F.explode(F.array(*[F.lit(i) for i in range(CLASSES)])))
    return out


def confusion(scored: DataFrame) -> DataFrame:
    """(model, actual, pred, n) for all pairs of classes."""
    n = scored.groupBy("model", "actual", "pred").agg(F.count("*").alias("n"))
    return _grid(scored, "actual", "pred").join(n, ["model", "actual", "pred"], "left").select("model", "actual", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def class_scores(scored: DataFrame) -> DataFrame:
    """(model, label, precision, recall, f1, support); 0 where a denominator is 0."""
    m = confusion(scored)
    by = m.withColumn("label", F.explode(F.array(*[F.lit(i) for i in range(CLASSES)]))).groupBy("model", "label").agg(
        F.sum(F.when((F.col("actual") == F.col("label")) & (F.col("pred") == F.col("label")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("pred") == F.col("label"), F.col("n")).otherwise(0)).alias("n_pred"),
        F.sum(F.when(F.col("actual") == F.col("label"), F.col("n")).otherwise(0)).alias("support"),
    )
    zero = F.lit(0.0)
    by = by.withColumns({"precision": F.coalesce(F.try_divide("tp", "n_pred"), zero), "recall": F.coalesce(F.try_divide("tp", "support"), zero)})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero)
    return by.withColumn("f1", f1).select("model", "label", "precision", "recall", "f1", "support", "tp")


def report(scored: DataFrame) -> DataFrame:
    """Rows 0, 1, 2, accuracy, macro avg and weighted avg of each model."""
    by = class_scores(scored)
    total = F.sum("support").alias("support")
    share = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
    right = (F.sum("tp") / F.sum("support"))
    rows = [
        by.select("model", F.col("label").cast("string").alias("row"), "precision", "recall", "f1", "support"),
        by.groupBy("model").agg(right.alias("precision"), right.alias("recall"), right.alias("f1"), total).select("model", F.lit("accuracy").alias("row"), "precision", "recall", "f1", "support"),
        by.groupBy("model").agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], total).select("model", F.lit("macro avg").alias("row"), "precision", "recall", "f1", "support"),
        by.groupBy("model").agg(*[share(c) for c in ("precision", "recall", "f1")], total).select("model", F.lit("weighted avg").alias("row"), "precision", "recall", "f1", "support"),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def weighted_f1(scored: DataFrame) -> DataFrame:
    return class_scores(scored).groupBy("model").agg((F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def cross_entropy(scores: DataFrame, weights: DataFrame, smoothing: float = 0.1) -> DataFrame:
    """Weighted, label-smoothed loss of each model over all its rows; ``weights`` has (label, weight)."""
    w = F.broadcast(weights.select(F.col("label").alias("actual"), "weight"))
    rows = scores.withColumn("_log_p", F.transform(softmax("logits"), lambda v: F.log(v))).join(w, "actual")
    nll = -((1 - smoothing) * F.get("_log_p", F.col("actual")) + smoothing / CLASSES * F.aggregate("_log_p", F.lit(0.0), lambda a, b: a + b))
    return rows.groupBy("model").agg((F.sum(F.col("weight") * nll) / F.sum("weight")).alias("loss"))


def best_model(metrics: DataFrame, value: str = "accuracy") -> DataFrame:
    """The first model (by name) with the largest value."""
    return metrics.orderBy(F.col(value).desc(), "model").limit(1).select("model", value)


def best_epoch(log: DataFrame) -> DataFrame:
    """Of each run: the epoch with the least test loss, that loss, and how far test is above train at the last epoch."""
    return log.groupBy("run").agg(
        F.min_by("epoch", F.struct("test_loss", "epoch")).alias("best_epoch"), F.min("test_loss").alias("best_loss"), F.max_by(F.col("test_loss") - F.col("train_loss"), "epoch").alias("last_gap")
    )


def early_stop(log: DataFrame, patience: int = 6, margin: float = 1e-4) -> DataFrame:
    """Of each run: the epoch at which training stops, and the best epoch kept. A loss is better only if it is below the
    kept best by more than ``margin``; after ``patience`` epochs without, the run stops."""
    run = F.sort_array(F.collect_list(F.struct("epoch", "test_loss")))
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(-1).alias("kept"), F.lit(0).alias("waited"), F.lit(-1).alias("stopped"))

    def step(s: Column, x: Column) -> Column:
        better = x["test_loss"] < s["best"] - margin
        waited = F.when(better, 0).otherwise(s["waited"] + 1)
        new = F.struct(F.when(better, x["test_loss"]).otherwise(s["best"]).alias("best"), F.when(better, x["epoch"]).otherwise(s["kept"]).alias("kept"), waited.alias("waited"), F.when(waited >= patience, x["epoch"]).otherwise(F.lit(-1)).alias("stopped"))
        return F.when(s["stopped"] >= 0, s).otherwise(new)

    done = log.groupBy("run").agg(F.aggregate(run, start, step).alias("_s"), F.max("epoch").alias("_last"))
    return done.select("run", F.col("_s.kept").alias("best_epoch"), F.col("_s.best").alias("best_loss"), F.when(F.col("_s.stopped") >= 0, F.col("_s.stopped")).otherwise(F.col("_last")).alias("stop_epoch"))


def prediction_head(scored: DataFrame, n: int = 200) -> DataFrame:
    """The first n rows of each model in test order, with 0/1 columns of predicted and actual classes."""
    first = scored.withColumn("_n", F.row_number().over(W.partitionBy("model").orderBy("ticker", "ts"))).where(F.col("_n") <= n).drop("_n")
    return first.withColumns({f"{k}_{name}": (F.col(k) == i).cast("int") for k in ("pred", "actual") for i, name in enumerate(("down", "neutral", "up"))})
