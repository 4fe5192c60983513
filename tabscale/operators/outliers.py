"""Outliers by IQR fences, z-scores and modified z-scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, numeric_columns, per_feature
from ..functions.quantiles import exact_quantiles
from ..functions.stats import sample_skewness
from .profile import iqr_bounds

# The customary limits of the three methods.
Z_LIMIT, MODIFIED_LIMIT, MODIFIED_SCALE = 3.0, 3.5, 0.6745


def _limits(df: DataFrame, columns: list[str], method: str) -> dict[str, dict[str, float | None]]:
    """Per column the numbers its outlier test and its clipping need."""
    if method == "iqr":
        return iqr_bounds(df, columns)
    if method == "zscore":
        rows = per_feature(df, columns, {"m": lambda c, p: F.avg(c), "s": lambda c, p: F.stddev_samp(c)})
        out = {}
        for r in rows.collect():
            known = r.m is not None and r.s is not None
            out[r.feature] = {
                "mean": r.m, "std": r.s,
                "lower": r.m - Z_LIMIT * r.s if known else None, "upper": r.m + Z_LIMIT * r.s if known else None}
        return out
    if method == "modified_zscore":
        points = exact_quantiles(df, columns, [0.01, 0.5, 0.99])
        spread = df.select(*[F.abs(col(c).cast("double") - F.lit(points[c][1])).alias(c) for c in columns])
        mads = exact_quantiles(spread, columns, [0.5])
        holed = df.agg(*[F.max(col(c).isNull().cast("int")) for c in columns]).first()
        return {
            c: {
                "median": points[c][1],
                # A null anywhere leaves the deviation undefined: no value is an outlier.
                "mad": None if has_null else mads[c][0],
                "lower": points[c][0], "upper": points[c][2],
            }
            for c, has_null in zip(columns, holed, strict=True)
        }
    raise ValueError(f"unknown outlier method {method}")


def _is_outlier(c: Column, p: dict[str, Column], method: str) -> Column:
    if method == "iqr":
        return (c < p["lower"]) | (c > p["upper"])
    if method == "zscore":
        return F.abs(F.try_divide(c - p["mean"], p["std"])) > Z_LIMIT
    score = F.abs(F.try_divide(F.lit(MODIFIED_SCALE) * (c - p["median"]), p["mad"]))
    return F.when(p["mad"] == 0, c != p["median"]).otherwise(score > MODIFIED_LIMIT)


def _literals(limits: dict[str, float | None]) -> dict[str, Column]:
    return {k: F.lit(v).cast("double") for k, v in limits.items()}


def detect(df: DataFrame, columns: list[str] | None = None, methods=("iqr", "zscore", "modified_zscore")) -> DataFrame:
    """(feature, method, count, pct, lower, upper)."""
    columns = columns or numeric_columns(df)
    out = None
    for method in methods:
        shown = method != "modified_zscore"  # its fences only serve clipping
        table = per_feature(
            df, columns,
            {
                "count": lambda c, p, m=method: F.count_if(_is_outlier(c, p, m)),
                "pct": lambda c, p, m=method: F.try_divide(100.0 * F.count_if(_is_outlier(c, p, m)), F.count(F.lit(1))),
                "lower": lambda c, p, s=shown: F.max(p["lower"] if s else F.lit(None).cast("double")),
                "upper": lambda c, p, s=shown: F.max(p["upper"] if s else F.lit(None).cast("double")),
            },
            _limits(df, columns, method),
        ).select("feature", F.lit(method).alias("method"), "count", "pct", "lower", "upper")
        out = table if out is None else out.unionByName(table)
    return out


def clip(df: DataFrame, columns: list[str], method: str = "iqr") -> DataFrame:
    """Pull values beyond the fences onto them, in columns that have outliers."""
    limits = _limits(df, columns, method)
    hit = df.agg(*[
        F.max(_is_outlier(col(c).cast("double"), _literals(limits[c]), method).cast("int")) for c in columns]).first()
    clipped = {}
    for c, any_outlier in zip(columns, hit, strict=True):
        if any_outlier:
            x, p = col(c).cast("double"), _literals(limits[c])
            clipped[c] = F.when(x.isNotNull(), F.least(F.greatest(x, p["lower"]), p["upper"])).alias(c)
    return df.select(*[clipped.get(c, col(c)) for c in df.columns])


def remove(df: DataFrame, columns: list[str], method: str = "iqr") -> DataFrame:
    """Drop outlier rows column by column; later fences come from the survivors.

    Each column adds one filter with literal fences, so the plan stays a chain
    of scan filters however many columns there are.
    """
    for c in columns:
        p = _literals(_limits(df, [c], method)[c])
        df = df.where(~F.coalesce(_is_outlier(col(c).cast("double"), p, method), F.lit(False)))
    return df


def transform(df: DataFrame, columns: list[str], method: str = "iqr") -> DataFrame:
    """Columns with outliers: log for positive right-skewed ones, else square root if not negative."""
    limits = _limits(df, columns, method)
    stats = per_feature(
        df, columns,
        {
            "hits": lambda c, p: F.count_if(_is_outlier(c, p, method)),
            "low": lambda c, p: F.min(c),
            "skew": lambda c, p: sample_skewness(c),
        },
        limits,
    ).collect()
    changed = {}
    for r in stats:
        x = col(r.feature).cast("double")
        if r.hits and r.low > 0 and r.skew is not None and r.skew > 1:
            changed[r.feature] = F.log1p(x).alias(r.feature)
        elif r.hits and r.low >= 0:
            changed[r.feature] = F.sqrt(x).alias(r.feature)
    return df.select(*[changed.get(c, col(c)) for c in df.columns])


def clip_if_many(df: DataFrame, columns: list[str], more_than: int = 20) -> DataFrame:
    """Clip at the IQR fences only if the columns hold enough outliers together."""
    total = detect(df, columns, ("iqr",)).agg(F.sum("count")).first()[0]
    return clip(df, columns) if total > more_than else df
