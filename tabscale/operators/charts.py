"""The tables behind the charts; drawing is left to the caller."""

from __future__ import annotations

import itertools

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, numeric_columns
from ..functions.ordering import fits, with_position
from ..functions.quantiles import grouped_quantiles
from ..functions.stats import normal_quantile, safe_corr
from .profile import CLASSIFICATION, class_distribution, task_by_share, with_class_code

# Up to this many columns all pairs share one aggregate.
PAIR_LIMIT = 4
# Groups whose ends may be broadcast (about 100 bytes each).
FEW_GROUPS = 100_000


def histogram(df: DataFrame, column: str, bins: int = 30, by: list[str] | None = None) -> DataFrame:
    """Equal-width bins from the smallest to the largest value, empty ones included.

    The last bin holds the maximum. Equal values all fall into a unit range
    around them. ``by`` repeats the bins for each group over its own range.
    """
    keys = list(by or [])
    data = df.where(col(column).isNotNull()).select(*[col(k) for k in keys], col(column).cast("double").alias("x"))
    ends = data.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    ends = ends.select(
        *keys,
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    if keys:
        # The groups are few (methods, splits), so a row need not move to meet its ends; beyond that it does.
        placed = data.join(F.broadcast(ends) if fits(ends, FEW_GROUPS) else ends, keys)
    else:
        lo, hi = ends.first()
        ends = df.sparkSession.range(1).select(F.lit(lo).cast("double").alias("lo"), F.lit(hi).cast("double").alias("hi"))
        placed = data.withColumn("lo", F.lit(lo).cast("double")).withColumn("hi", F.lit(hi).cast("double"))
    at = F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    counts = placed.groupBy(*keys, F.least(at, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return frame.join(counts, [*keys, "bin"], "left").select(
        *keys, "bin",
        (F.col("lo") + F.col("bin") * width).alias("bin_start"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("n"))


def normal_plot(df: DataFrame, column: str, key: str) -> DataFrame:
    """Each ordered value next to its normal quantile, with the fitted line."""
    data = df.where(col(column).isNotNull()).select(col(column).cast("double").alias("value"), col(key).alias("_k"))
    n = data.count()
    ranked = with_position(data, [F.col("value"), F.col("_k")], "_i")
    i = F.col("_i") + 1
    # Filliben's order-statistic medians.
    ends = 0.5 ** (1.0 / n)
    p = F.when(i == n, F.lit(ends)).when(i == 1, F.lit(1.0 - ends)).otherwise((i - 0.3175) / (n + 0.365))
    points = ranked.select(i.alias("rank"), normal_quantile(p).alias("theoretical"), "value")
    slope, intercept = points.agg(
        F.regr_slope("value", "theoretical"), F.regr_intercept("value", "theoretical")).first()
    return points.withColumn("line", F.lit(slope) * F.col("theoretical") + F.lit(intercept))


def class_bars(df: DataFrame, target: str) -> DataFrame:
    return class_distribution(df, target).select("class", "n").orderBy(F.desc("n"), "class")


def class_pie(df: DataFrame, target: str) -> DataFrame:
    """Share of each class among the rows that have one."""
    total = df.where(col(target).isNotNull()).count()
    return class_distribution(df, target).select("class", (100.0 * F.col("n") / F.lit(float(total))).alias("pct"))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every ordered pair of columns, over complete pairs."""
    data = df.select(*[col(c).cast("double").alias(c) for c in columns])
    pairs = list(itertools.combinations_with_replacement(columns, 2))
    if len(columns) <= PAIR_LIMIT:
        row = data.agg(*[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), safe_corr(col(a), col(b)).alias("correlation")).alias(f"p{i}")
            for i, (a, b) in enumerate(pairs)
        ])
        upper = row.select(F.inline(F.array(*[F.col(f"p{i}") for i in range(len(pairs))])))
        return _mirrored(upper)
    if data.where(F.greatest(*[col(c).isNull() for c in columns])).limit(1).count():
        # Nulls differ by column: each pair needs its own complete rows.
        cells = F.array(*[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), col(a).alias("x"), col(b).alias("y")) for a, b in pairs])
        rows = data.select(F.inline(cells))
        return _mirrored(rows.groupBy("a", "b").agg(safe_corr(F.col("x"), F.col("y")).alias("correlation")))
    # The ML matrix is p x p numbers whatever the row count.
    vectors = VectorAssembler(inputCols=columns, outputCol="v").transform(data)
    matrix = Correlation.corr(vectors, "v").first()[0].toArray()
    cells = [
        (a, b, None if matrix[i, j] != matrix[i, j] else float(matrix[i, j]))
        for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return df.sparkSession.createDataFrame(cells, "a string, b string, correlation double")


def _mirrored(upper: DataFrame) -> DataFrame:
    lower = upper.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "correlation")
    return upper.unionByName(lower)


def target_correlation_matrix(df: DataFrame, target: str, key: str, features: list[str] | None = None) -> DataFrame:
    """Matrix of the numeric features and the target, a class target coded by first appearance in ``key`` order."""
    features = features or numeric_columns(df, exclude=[target, key])
    if task_by_share(df, target).first().task == CLASSIFICATION:
        coded = with_class_code(df.select(*[col(c) for c in features], col(target), col(key)), target, "_code", order=key)
        df = coded.drop(target).withColumnRenamed("_code", target)
    return correlation_matrix(df, [*features, target])


def correlation_bars(table: DataFrame, top: int = 6, label: int = 10) -> DataFrame:
    """First rows of a correlation table with shortened labels and a colour by sign."""
    name = F.when(F.length("feature") > label, F.concat(F.substring("feature", 1, label), F.lit("..."))).otherwise(F.col("feature"))
    # The limit is the chart: it shows the first six rows of the table.
    first = table.orderBy(F.desc_nulls_last("correlation"), "feature").limit(top)
    return first.select(
        name.alias("label"), "correlation", F.when(F.col("correlation") >= 0, "green").otherwise("red").alias("colour"))


def metric_bars(metrics: DataFrame, names: list[str]) -> DataFrame:
    """(metric, method, train, test) from a long metric table."""
    wanted = metrics.where(F.col("metric").isin(names))
    return wanted.groupBy("metric", "method").pivot("split", ["train", "test"]).agg(F.first("value"))


def metric_pairs(metrics: DataFrame, x: str, y: str, split: str = "test") -> DataFrame:
    """One (x, y) point per method."""
    return metrics.where(F.col("split") == split).groupBy("method").pivot("metric", [x, y]).agg(F.first("value"))


def rank_bars(metrics: DataFrame, metric: str, ascending: bool, split: str = "test") -> DataFrame:
    """Methods by one metric with medal colours."""
    rows = metrics.where((F.col("metric") == metric) & (F.col("split") == split))
    order = F.asc("value") if ascending else F.desc("value")
    # One row per method, so one task orders a handful of rows.
    rank = F.row_number().over(Window.partitionBy("metric").orderBy(order, "method"))
    colour = F.when(F.col("rank") == 1, "gold").when(F.col("rank") == 2, "silver").otherwise("lightcoral")
    return rows.select("method", "value", rank.alias("rank")).withColumn("colour", colour)


def score_boxes(scores: DataFrame) -> DataFrame:
    """Five-number summary of the scores per scenario and number of features."""
    keys = ["scenario", "p", "method"]
    found = grouped_quantiles(scores, keys, "score", (0.0, 0.25, 0.5, 0.75, 1.0))
    # A method without any score keeps its row.
    five = scores.select(*keys).distinct().join(found, keys, "left")
    names = ["low", "q25", "median", "q75", "high"]
    return five.select("scenario", "p", "method", *[F.col("q")[i].alias(n) for i, n in enumerate(names)])
