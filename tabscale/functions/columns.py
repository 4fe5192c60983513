"""Column selection and per-column aggregation."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A wide aggregate pays for every expression when its code is generated and
# compiled, and leaves whole-stage codegen when the method grows too large.
# Above this many cells the columns are stacked into (feature, value) rows.
WIDE_LIMIT = 24


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def text_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Spark orders NaN as a value; the operators expect NULL for missing."""
    floating = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(
        *[F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floating else col(c) for c in df.columns]
    )


def _numbered(df: DataFrame, columns: list[str], keep: Iterable[str], dtype: str) -> DataFrame:
    values = F.array(*[col(c).cast(dtype) for c in columns])
    return df.select(*[col(k) for k in keep], F.posexplode(values).alias("_at", "value"))


def _by_number(values: list) -> Column:
    """The entry of ``values`` for the column number in ``_at``."""
    return F.array(*[F.lit(v) for v in values])[F.col("_at")]


def stack(df: DataFrame, columns: list[str], keep: Iterable[str] = (), dtype: str = "double") -> DataFrame:
    """Rows of (keep..., feature, value), one per row and column."""
    rows = _numbered(df, columns, keep, dtype)
    return rows.select(*[col(k) for k in keep], _by_number(columns).alias("feature"), "value")


def per_feature(
    df: DataFrame,
    columns: list[str],
    stats: Mapping[str, Callable[[Column, Mapping[str, Column]], Column]],
    params: Mapping[str, Mapping[str, float]] | None = None,
    keep: Iterable[str] = (),
    dtype: str = "double",
) -> DataFrame:
    """One row per column holding the aggregates in ``stats``.

    Each aggregate is a function of the column and of that column's ``params``.
    ``keep`` names further columns an aggregate reads, such as the target.
    """
    if not columns:
        raise ValueError("no columns to aggregate")
    if len(columns) * len(stats) <= WIDE_LIMIT:
        packed = []
        for i, c in enumerate(columns):
            p = {k: F.lit(v).cast("double") for k, v in (params or {}).get(c, {}).items()}
            cells = [fn(col(c).cast(dtype), p).alias(name) for name, fn in stats.items()]
            packed.append(F.struct(F.lit(c).alias("feature"), *cells).alias(f"f{i}"))
        row = df.agg(*packed)
        return row.select(F.inline(F.array(*[F.col(f"f{i}") for i in range(len(columns))])))
    # Grouped by column number: an integer key, with names and params looked up by it.
    rows = _numbered(df, columns, keep, dtype)
    names = sorted({k for p in (params or {}).values() for k in p})
    tables = {n: _by_number([params.get(c, {}).get(n) for c in columns]).cast("double") for n in names}
    grouped = rows.groupBy("_at").agg(*[fn(F.col("value"), tables).alias(name) for name, fn in stats.items()])
    return grouped.select(_by_number(columns).alias("feature"), *stats)
