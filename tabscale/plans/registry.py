"""Query registry shared by the family modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Register a query and, if it has one, its SQL.

    ``doubles`` lists the floating columns as ``name`` or ``name:digits``; both
    sides round them alike (6 digits by default), since sums of doubles differ
    in their last bits between engines.
    """
    digits = {}
    for item in doubles.split():
        column, _, d = item.partition(":")
        digits[column] = int(d or 6)

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.select(*[
                (F.round(F.col(c), digits[c]) + F.lit(0.0)).alias(c) if c in digits else F.col(c)
                for c in df.columns
            ])

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = _rounded(sql, digits)
        return fn

    return register


def _rounded(sql: str, digits: dict[str, int]) -> str:
    sql = sql.strip()
    if not digits:
        return sql
    replace = ", ".join(
        f"CASE WHEN isnan({c}) THEN NULL ELSE round({c}, {d}) + 0.0 END::DOUBLE AS {c}" for c, d in digits.items())
    return f"SELECT * REPLACE ({replace}) FROM (\n{sql}\n) AS q"
