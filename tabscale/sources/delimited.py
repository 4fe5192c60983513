"""Delimited and white-space separated text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col

_EXTRA = "_beyond_last"


def _typed(df: DataFrame) -> DataFrame:
    """Columns whose every value is a number become numbers; other text stays, '?' included."""
    checks = []
    for c in df.columns:
        text = F.trim(col(c))
        filled = text.isNotNull() & (text != "")

        def every(test: Column, filled=filled) -> Column:
            return F.coalesce(F.bool_and(F.when(filled, test)), F.lit(False))

        # An integer must look like one: a cast to bigint would also accept '1.0'.
        whole = text.rlike(r"^[+-]?\d+$") & text.try_cast("bigint").isNotNull()
        checks.append(F.struct(every(whole).alias("whole"), every(text.try_cast("double").isNotNull()).alias("number")))
    kinds = df.agg(*checks).first()

    def cast(c: str, i: int) -> Column:
        if kinds[i].whole:
            return F.trim(col(c)).try_cast("bigint").alias(c)
        return F.trim(col(c)).try_cast("double").alias(c) if kinds[i].number else col(c)

    return df.select(*[cast(c, i) for i, c in enumerate(df.columns)])


def read_delimited(
    spark: SparkSession, path: str, separator: str = ",", header: bool = True, columns: Sequence[str] = ()
) -> DataFrame:
    """Rows with too many fields are skipped, short ones padded with nulls.

    One more text column than the table has catches what lies beyond the last
    field; dropping malformed rows instead would lose the short ones too.
    """
    reader = spark.read.option("sep", separator)
    if not columns:
        first = reader.option("header", header).csv(path)
        columns = first.columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, _EXTRA]])
    raw = spark.read.option("sep", separator).option("header", header).option("enforceSchema", True).schema(schema).csv(path)
    return _typed(raw.where(col(_EXTRA).isNull()).select(*[col(c) for c in columns]))


def read_whitespace(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Fields separated by any white space; quoted ones may hold spaces."""
    fields = F.regexp_extract_all("value", F.lit(r'("[^"]*"|\S+)'), F.lit(1))
    rows = spark.read.text(path).where(F.trim("value") != "").select(fields.alias("f")).where(F.size("f") <= len(columns))
    return _typed(rows.select(*[F.trim(F.get("f", F.lit(i)), F.lit('"')).alias(c) for i, c in enumerate(columns)]))
