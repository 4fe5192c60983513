"""Writers for result tables. Spark writes one file per partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compare


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_scores(scores: DataFrame, prefix: str) -> None:
    """Summary and detail table of a benchmark as ``{prefix}_summary`` and ``{prefix}_detailed``."""
    write_csv(compare.advantage(compare.rep_stats(scores)), f"{prefix}_summary")
    write_csv(compare.flatten(scores), f"{prefix}_detailed")


def nested_results(scores: DataFrame) -> DataFrame:
    """One row per scenario: its cells, each with the statistics of its methods."""
    stats = compare.rep_stats(scores)
    cells = stats.groupBy("scenario", "p").agg(
        F.array_sort(F.collect_list(F.struct("method", "mean", "std", "min", "max", "n_successful", "success_rate"))).alias("methods"))
    return cells.groupBy("scenario").agg(F.array_sort(F.collect_list(F.struct("p", "methods"))).alias("cells"))
