"""Missing values: analysis, choice of strategy, imputation.

Statistics come back to the driver as one small row; the fills are literals in
one projection over the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, is_text, numeric_columns, stack, text_columns
from ..functions.quantiles import exact_quantiles
from ..functions.stats import safe_corr
from .profile import REGRESSION, missing_counts

DROP, MODE, MEAN, MEDIAN, KNN = "DROP_COLUMN", "FILL_MODE", "FILL_MEAN", "FILL_MEDIAN", "FILL_KNN"

# Null shares in percent that decide the strategy.
DROP_ABOVE, SIMPLE_BELOW = 50.0, 5.0


def overview(df: DataFrame) -> DataFrame:
    """Number of nulls and share of rows without any, in percent."""
    complete = F.lit(True)
    for c in df.columns:
        complete = complete & col(c).isNotNull()
    nulls = sum((F.count_if(col(c).isNull()) for c in df.columns), F.lit(0).cast("bigint"))
    return df.agg(
        nulls.alias("total_missing"),
        F.try_divide(100.0 * F.count_if(complete), F.count(F.lit(1))).alias("pct_complete"))


def strategies(df: DataFrame, task: str) -> DataFrame:
    """(feature, missing_count, missing_pct, strategy) of the columns holding nulls."""
    table = missing_counts(df).where("missing_count > 0")
    text = F.col("feature").isin(text_columns(df)) if text_columns(df) else F.lit(False)
    chosen = (
        F.when(F.col("missing_pct") > DROP_ABOVE, DROP)
        .when(text, MODE)
        .when(F.col("missing_pct") < SIMPLE_BELOW, MEAN if task == REGRESSION else MEDIAN)
        .otherwise(KNN))
    return table.withColumn("strategy", chosen).orderBy(F.desc("missing_pct"), "feature")


def means(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    if not columns:
        return {}
    return dict(zip(columns, df.agg(*[F.avg(col(c).cast("double")) for c in columns]).first(), strict=True))


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    return {c: q[0] for c, q in exact_quantiles(df, columns, [0.5]).items()} if columns else {}


def modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Most frequent text, the smallest on a tie; 'missing' for a column without any."""
    if not columns:
        return {}
    counts = stack(df, columns, dtype="string").where("value IS NOT NULL").groupBy("feature", "value").count()
    best = counts.groupBy("feature").agg(F.min(F.struct((-F.col("count")).alias("m"), "value")).alias("top"))
    found = {r.feature: r.top.value for r in best.collect()}
    return {c: found.get(c, "missing") for c in columns}


def fill(df: DataFrame, values: dict) -> DataFrame:
    return df.select(*[
        F.coalesce(col(c), F.lit(values[c])).alias(c) if values.get(c) is not None else col(c) for c in df.columns])


def fill_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    return fill(df, means(df, columns))


def fill_median(df: DataFrame, columns: list[str]) -> DataFrame:
    return fill(df, medians(df, columns))


def fill_mode(df: DataFrame, columns: list[str]) -> DataFrame:
    return fill(df, modes(df, columns))


def fill_correlated(df: DataFrame, column: str, key: str | None = None, regression: bool = False) -> DataFrame:
    """Fill from the numeric column with the largest absolute correlation.

    The fill is that column times the absolute correlation and stays null where
    it is null. ``regression`` uses the least-squares line instead. Without
    another numeric column the median stands in, for text the mode.
    """
    if is_text(df, column):
        return fill_mode(df, [column])
    others = [c for c in numeric_columns(df, exclude=[key] if key else []) if c != column]
    if not others:
        return fill_median(df, [column])
    y = col(column).cast("double")
    row = df.agg(*[F.abs(safe_corr(col(c).cast("double"), y)) for c in others]).first()
    known = [(r, -i) for i, r in enumerate(row) if r is not None]
    if not known:
        return fill_median(df, [column])
    strength, at = max(known)
    other = col(others[-at]).cast("double")
    if regression:
        slope, intercept = df.agg(F.regr_slope(y, other), F.regr_intercept(y, other)).first()
        guess = other * F.lit(slope) + F.lit(intercept)
    else:
        guess = other * F.lit(strength)
    return df.withColumn(column, F.coalesce(y, guess))


def fill_auto(df: DataFrame, task: str, key: str | None = None) -> DataFrame:
    """Apply the recommended strategies, the emptiest column first.

    Only the correlation fill sees earlier fills, so the constants of all other
    columns come from one pass each over the unfilled table.
    """
    plan = [(r.feature, r.strategy) for r in strategies(df.drop(key) if key else df, task).collect()]
    constants = {
        **means(df, [c for c, s in plan if s == MEAN]),
        **medians(df, [c for c, s in plan if s == MEDIAN]),
        **modes(df, [c for c, s in plan if s == MODE]),
    }
    for c, strategy in plan:
        if strategy == DROP:
            df = df.drop(c)
        elif strategy == KNN:
            df = fill_correlated(df, c, key)
        else:
            df = fill(df, {c: constants[c]})
    return df
