"""Metrics of long prediction tables (row_id, method, split, y, prediction)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import running_totals
from .charts import histogram

GROUP = ["method", "split"]
# Labels of a confusion matrix; more are no classes, and the matrix has their square.
MOST_LABELS = 1000


def regression_metrics(predictions: DataFrame, flat_r2: str = "zero") -> DataFrame:
    """mse, rmse, mae, r2 per method and split in one aggregate.

    For a constant truth r2 is 0; ``flat_r2="exact"`` gives 1 to an exact prediction.
    """
    e = F.col("y") - F.col("prediction")
    squares, n = F.sum(e * e), F.count(e)
    total = F.var_pop("y") * n
    flat = F.when(squares == 0, 1.0).otherwise(0.0) if flat_r2 == "exact" else F.lit(0.0)
    return predictions.groupBy(*GROUP).agg(
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.when(total == 0, flat).otherwise(1 - F.try_divide(squares, total)).alias("r2"))


def accuracy(predictions: DataFrame) -> DataFrame:
    hit = F.avg((F.col("y") == F.col("prediction")).cast("double"))
    return predictions.groupBy(*GROUP).agg(hit.alias("accuracy"), (1 - hit).alias("error"))


def weighted_scores(predictions: DataFrame) -> DataFrame:
    """Precision, recall and F1 per class, weighted by the rows of the class."""
    cells = predictions.groupBy(*GROUP, "y", "prediction").agg(F.count(F.lit(1)).alias("n"))
    # Each cell counts once towards its true and once towards its predicted class.
    sides = cells.select(*GROUP, F.inline(F.array(
        F.struct(F.col("y").alias("label"), F.col("n").alias("true"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("y") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("prediction").alias("label"), F.lit(0).cast("bigint").alias("true"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("hit")))))
    classes = sides.groupBy(*GROUP, "label").agg(F.sum("true").alias("t"), F.sum("predicted").alias("p"), F.sum("hit").alias("h"))
    precision = F.coalesce(F.try_divide("h", "p"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("h", "t"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("h"), F.col("p") + F.col("t")), F.lit(0.0))
    weight = F.sum("t")
    return classes.groupBy(*GROUP).agg(
        (F.sum(precision * F.col("t")) / weight).alias("precision"),
        (F.sum(recall * F.col("t")) / weight).alias("recall"),
        (F.sum(f1 * F.col("t")) / weight).alias("f1"))


def confusion(predictions: DataFrame) -> DataFrame:
    """Counts for every pair of true and predicted label, zeros kept.

    Predictions with over ``MOST_LABELS`` labels are refused.
    """
    cells = predictions.groupBy(*GROUP, "y", "prediction").agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(*GROUP, F.explode(F.array("y", "prediction")).alias("label")).groupBy(*GROUP).agg(F.count_distinct("label").alias("n"))
    most = sides.agg(F.max("n")).first()[0] or 0
    if most > MOST_LABELS:
        raise ValueError(f"{most} labels are too many for a confusion matrix")
    labels = cells.groupBy(*GROUP).agg(
        F.array_sort(F.array_union(F.collect_set("y"), F.collect_set("prediction"))).alias("labels"))
    # The matrix itself is label by label; the labels of a classifier are few.
    frame = labels.select(*GROUP, F.explode("labels").alias("y"), "labels").select(
        *GROUP, "y", F.explode("labels").alias("prediction"))
    return frame.join(cells, [*GROUP, "y", "prediction"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def roc(predictions: DataFrame, small: int | None = None) -> DataFrame:
    """ROC points per method and split at each distinct score, highest first.

    ``y`` is 0 or 1. Rows without a truth or a score (null or NaN) have no place on
    the curve and are left out. Rows collapse to distinct scores before anything is
    ordered.
    """
    placed = predictions.where("y IS NOT NULL AND prediction IS NOT NULL AND NOT isnan(CAST(prediction AS DOUBLE))")
    cells = placed.groupBy(*GROUP, F.col("prediction").alias("score")).agg(
        F.sum(F.col("y").cast("bigint")).alias("pos"), F.sum(1 - F.col("y").cast("bigint")).alias("neg"))
    totals = cells.groupBy(*GROUP).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    limits = {} if small is None else {"small": small, "pieces": 7}
    running = running_totals(cells, GROUP, "score", {"tp": "pos", "fp": "neg"}, descending=True, **limits)
    return running.join(F.broadcast(totals), GROUP).select(
        *GROUP, "score", "pos", "neg", "tp", "fp",
        F.try_divide("tp", "all_pos").alias("tpr"), F.try_divide("fp", "all_neg").alias("fpr"), "all_pos", "all_neg")


def auc(predictions: DataFrame, small: int | None = None) -> DataFrame:
    """Area under the ROC points; a step's trapezoid needs only its own counts."""
    step = F.col("neg") * (2 * F.col("tp") - F.col("pos")) / 2.0
    return roc(predictions, small).groupBy(*GROUP).agg(
        F.try_divide(F.sum(step), F.max(F.col("all_pos").cast("double") * F.col("all_neg"))).alias("auc"))


def residual_histogram(predictions: DataFrame, bins: int = 20) -> DataFrame:
    rows = predictions.select(*GROUP, (F.col("y") - F.col("prediction")).alias("residual"))
    return histogram(rows, "residual", bins, by=GROUP)


def harden_binary(c: Column) -> Column:
    return F.when(c.isNotNull(), (c > 0.5).cast("double"))


def harden_multiclass(c: Column, highest: float) -> Column:
    """Nearest class, halves to the even one, within [0, highest]."""
    return F.bround(F.least(F.greatest(c, F.lit(0.0)), F.lit(float(highest))), 0)


def drop_invalid(predictions: DataFrame) -> DataFrame:
    """Leave out methods whose predictions are all missing or all zero."""
    p = F.col("prediction")
    usable = predictions.groupBy("method").agg(
        F.max((p.isNotNull() & ~F.isnan(p) & (p != 0)).cast("int")).alias("usable")).where("usable = 1")
    return predictions.join(F.broadcast(usable.select("method")), "method", "left_semi")


def long_metrics(table: DataFrame) -> DataFrame:
    """(method, split, metric, value) from a metric table."""
    names = [c for c in table.columns if c not in GROUP]
    return table.unpivot(GROUP, names, "metric", "value")


def bundle(predictions: DataFrame, task: str) -> DataFrame:
    """All metrics of the task in long form."""
    if task == "regression":
        return long_metrics(regression_metrics(predictions))
    return long_metrics(accuracy(predictions)).unionByName(long_metrics(weighted_scores(predictions)))
