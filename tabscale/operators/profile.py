"""Table profiles: sizes, nulls, duplicates, target statistics, correlations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, is_text, numeric_columns, per_feature, stack, text_columns
from ..functions.ordering import lookup, with_position
from ..functions.quantiles import exact_quantiles
from ..functions.stats import safe_corr, sample_kurtosis, sample_skewness

REGRESSION, CLASSIFICATION = "regression", "classification"


def task_by_share(df: DataFrame, target: str) -> DataFrame:
    """Task rule of the profile: text, or few distinct values for the row count."""
    stats = df.agg(F.count_distinct(col(target)).alias("n_unique"), F.count(F.lit(1)).alias("n_rows"))
    few = F.col("n_unique") < F.least(F.lit(20.0), 0.1 * F.col("n_rows"))
    classes = F.lit(True) if is_text(df, target) else few
    return stats.select(F.when(classes, CLASSIFICATION).otherwise(REGRESSION).alias("task"), "n_unique", "n_rows")


def task_by_count(df: DataFrame, target: str, most: int = 20) -> DataFrame:
    """Task rule of the models: at most ``most`` distinct values, null being one."""
    distinct = F.count_distinct(col(target)) + F.max(col(target).isNull().cast("int"))
    stats = df.agg(distinct.cast("bigint").alias("n_unique"))
    return stats.select(F.when(F.col("n_unique") <= most, CLASSIFICATION).otherwise(REGRESSION).alias("task"), "n_unique")


def basic_info(df: DataFrame, target: str) -> DataFrame:
    return task_by_share(df, target).select(
        "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(len(df.columns) - 1).alias("n_features"),
        F.lit(target).alias("target"),
        "task",
    )


def missing_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null count and share in percent of every column."""
    columns = columns or df.columns
    return per_feature(
        df.select(*[col(c).isNull().alias(c) for c in columns]), columns,
        {
            "missing_count": lambda c, p: F.count_if(c),
            "missing_pct": lambda c, p: F.try_divide(100.0 * F.count_if(c), F.count(F.lit(1))),
        },
        dtype="boolean",
    )


def missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns holding nulls, the emptiest first."""
    return missing_counts(df, columns).where("missing_count > 0").orderBy(F.desc("missing_pct"), "feature")


def duplicates(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier row (nulls being equal), and their share."""
    groups = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
        F.try_divide(100.0 * F.sum(F.col("n") - 1), F.sum("n")).alias("duplicate_pct"),
    )


def target_base(df: DataFrame, target: str) -> DataFrame:
    c = col(target)
    return df.agg(
        F.first(F.lit(df.schema[target].dataType.simpleString())).alias("type"),
        F.count_if(c.isNull()).alias("missing"),
        F.count_distinct(c).alias("n_unique"),
    )


def target_regression(df: DataFrame, target: str) -> DataFrame:
    q25, q50, q75 = exact_quantiles(df, [target], [0.25, 0.5, 0.75])[target]
    c = col(target).cast("double")
    return df.agg(
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("std"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
        sample_skewness(c).alias("skewness"),
        sample_kurtosis(c).alias("kurtosis"),
    ).select(
        "mean", F.lit(q50).cast("double").alias("median"), "std", "min", "max",
        F.lit(q25).cast("double").alias("q25"), F.lit(q75).cast("double").alias("q75"), "skewness", "kurtosis")


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Rows per class and share of all rows, those without a class included."""
    total = df.count()
    counts = df.where(col(target).isNotNull()).groupBy(col(target).cast("string").alias("class"))
    return counts.agg(F.count(F.lit(1)).alias("n")).withColumn("proportion", F.col("n") / F.lit(float(total)))


def class_imbalance(df: DataFrame, target: str) -> DataFrame:
    """Largest class over smallest."""
    return class_distribution(df, target).agg(
        F.count(F.lit(1)).alias("n_classes"),
        (F.max("n") / F.min("n")).alias("imbalance"),
    )


def correlations(df: DataFrame, target: str, features: list[str] | None = None) -> DataFrame:
    """Pearson correlation of each numeric feature with a numeric target."""
    features = features or numeric_columns(df, exclude=[target])
    y = col(target).cast("double")
    return per_feature(
        df.select(*[col(c) for c in features], y.alias(target)), features,
        {"correlation": lambda c, p: safe_corr(c, col(target))}, keep=[target],
    ).orderBy(F.desc_nulls_last("correlation"), "feature")


def class_codes(df: DataFrame, target: str, order: str = "value") -> DataFrame:
    """One row per class: (target, n, code), coded by sorted value or by first row.

    ``order`` is ``value`` or the column that gives the rows their order.
    """
    present = df.where(col(target).isNotNull())
    if order == "value":
        counts = present.groupBy(col(target)).agg(F.count(F.lit(1)).alias("n"))
        return with_position(counts, [col(target)], "code")
    counts = present.groupBy(col(target)).agg(F.count(F.lit(1)).alias("n"), F.min(col(order)).alias("_first"))
    return with_position(counts, [F.col("_first")], "code").drop("_first")


def with_class_code(df: DataFrame, target: str, name: str, order: str = "value") -> DataFrame:
    """Add the class code as a double; -1 for a missing class."""
    codes = class_codes(df, target, order).select(col(target), "n", F.col("code").alias(name))
    coded = lookup(df, codes, target, "n")
    return coded.withColumn(name, F.coalesce(col(name).cast("double"), F.lit(-1.0)))


def class_correlations(df: DataFrame, target: str, features: list[str] | None = None) -> DataFrame:
    """Correlation of each numeric feature with the class code, strongest first."""
    features = features or numeric_columns(df, exclude=[target])
    coded = with_class_code(df.select(*[col(c) for c in features], col(target)), target, "_code")
    return correlations(coded, "_code", features).orderBy(F.desc_nulls_last(F.abs("correlation")), "feature")


def iqr_bounds(df: DataFrame, columns: list[str], factor: float = 1.5) -> dict[str, dict[str, float]]:
    bounds = {}
    for c, (q1, q3) in exact_quantiles(df, columns, [0.25, 0.75]).items():
        if q1 is None:
            bounds[c] = {"lower": None, "upper": None}
        else:
            bounds[c] = {"lower": q1 - factor * (q3 - q1), "upper": q3 + factor * (q3 - q1)}
    return bounds


def _outside(c, p):
    return F.count_if((c < p["lower"]) | (c > p["upper"]))


def iqr_outlier_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return per_feature(df, columns, {"outliers_iqr": _outside}, iqr_bounds(df, columns))


def distributions(df: DataFrame, columns: list[str]) -> DataFrame:
    """Skewness, kurtosis and number of values outside the IQR fences."""
    return per_feature(
        df, columns,
        {
            "skewness": lambda c, p: sample_skewness(c),
            "kurtosis": lambda c, p: sample_kurtosis(c),
            "outliers_iqr": _outside,
        },
        iqr_bounds(df, columns),
    )


def categorical(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct values, most frequent value (smallest on a tie) and nulls of text columns."""
    columns = columns or text_columns(df)
    counts = stack(df, columns, dtype="string").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    present = F.col("value").isNotNull()
    return counts.groupBy("feature").agg(
        F.count_if(present).alias("n_unique"),
        F.min(F.when(present, F.struct((-F.col("n")).alias("m"), F.col("value").alias("v")))).alias("top"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("missing"),
    ).select(
        "feature", "n_unique", F.col("top.v").alias("top_value"), (-F.col("top.m")).alias("top_value_freq"), "missing")


def _cells(df: DataFrame, section: str, feature, names: Mapping[str, str]) -> DataFrame:
    """Turn the named columns of a report into (section, feature, key, value) rows."""
    cells = F.array(*[
        F.struct(F.lit(k).alias("key"), F.col(c).cast("double").alias("value")) for k, c in names.items()])
    return df.select(F.lit(section).alias("section"), feature.alias("feature"), F.inline(cells))


def summary(df: DataFrame, target: str, key: str | None = None) -> DataFrame:
    """All profile sections as (section, feature, key, value) rows.

    ``key`` names a row identifier, which is left out of every section.
    """
    df = df.drop(key) if key else df
    features = numeric_columns(df, exclude=[target])
    texts = text_columns(df, exclude=[target])
    whole = F.lit(target)
    parts = [
        _cells(basic_info(df, target), "basic", whole, {"rows": "n_rows", "columns": "n_columns", "features": "n_features"}),
        _cells(missing(df), "missing", F.col("feature"), {"count": "missing_count", "pct": "missing_pct"}),
        _cells(duplicates(df), "duplicates", whole, {"count": "duplicates", "pct": "duplicate_pct"}),
        _cells(target_base(df, target), "target", whole, {"missing": "missing", "n_unique": "n_unique"}),
    ]
    if task_by_share(df, target).first().task == CLASSIFICATION:
        parts.append(_cells(class_imbalance(df, target), "target", whole, {"imbalance": "imbalance"}))
        parts.append(_cells(class_distribution(df, target), "classes", F.col("class"), {"n": "n", "proportion": "proportion"}))
        corr = class_correlations(df, target, features)
    else:
        stats = ["mean", "median", "std", "min", "max", "q25", "q75", "skewness", "kurtosis"]
        parts.append(_cells(target_regression(df, target), "target", whole, {s: s for s in stats}))
        corr = correlations(df, target, features)
    parts.append(_cells(corr, "correlation", F.col("feature"), {"correlation": "correlation"}))
    parts.append(_cells(
        distributions(df, features), "distribution", F.col("feature"),
        {"skewness": "skewness", "kurtosis": "kurtosis", "outliers_iqr": "outliers_iqr"}))
    if texts:
        parts.append(_cells(
            categorical(df, texts), "categorical", F.col("feature"),
            {"n_unique": "n_unique", "top_value_freq": "top_value_freq", "missing": "missing"}))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def insights(df: DataFrame, target: str, few_features: int = 10) -> DataFrame:
    """Verdicts on width, target shape and class balance."""
    width = "simple" if len(df.columns) - 1 < few_features else "complex"
    if task_by_share(df, target).first().task == CLASSIFICATION:
        stats = class_imbalance(df, target).select(
            F.when(F.col("imbalance") < 3, "balanced").otherwise("imbalanced").alias("verdict"),
            F.col("imbalance").alias("value"))
    else:
        stats = df.agg(sample_skewness(col(target).cast("double")).alias("value")).select(
            F.when(F.abs("value") < 0.5, "normal").otherwise("skewed").alias("verdict"), "value")
    return stats.select(F.lit(target).alias("target"), F.lit(width).alias("width"), "verdict", "value")


def profile_tables(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """One row per table: size, nulls, duplicates and task of ``{name: (df, target)}``."""
    out = None
    for name, (df, target) in tables.items():
        info = basic_info(df, target)
        nulls = missing_counts(df).agg(F.sum("missing_count").alias("missing"))
        dups = duplicates(df).select("duplicates")
        # Three one-row reports of the same table, put side by side by its name.
        row = (
            info.withColumn("table_name", F.lit(name))
            .join(nulls.withColumn("table_name", F.lit(name)), "table_name")
            .join(dups.withColumn("table_name", F.lit(name)), "table_name")
            .select("table_name", "target", "task", "n_rows", "n_features", "missing", "duplicates")
        )
        out = row if out is None else out.unionByName(row)
    return out
