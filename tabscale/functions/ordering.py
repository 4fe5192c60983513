"""Global positions and running totals without a single-task window."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# Rows a single task may order; larger tables go through range partitions.
SMALL = 1_000_000
# Rows that a piece of a running total should have, or a task that draws columns.
PIECE_ROWS = 250_000
# Bytes of a key table that may be broadcast.
BROADCAST = 32 * 1024 * 1024
_MASK = (1 << 33) - 1  # monotonically_increasing_id keeps the row number in 33 bits


def fits(df: DataFrame, limit: int = SMALL) -> bool:
    return df.count() <= limit


def spread(df: DataFrame) -> DataFrame:
    """``df`` in a task for every ``PIECE_ROWS`` rows at least, for a scan that many draws follow: few
    bytes a row make few tasks of a scan."""
    tasks = math.ceil(df.count() / PIECE_ROWS)
    return df.repartition(tasks) if tasks > max(1, df.rdd.getNumPartitions()) else df


def with_position(df: DataFrame, order: Sequence, name: str = "position", small: int = SMALL) -> DataFrame:
    """Add the 0-based global position of each row in ``order``.

    ``order`` should end in a unique column, so that a frequent value spreads
    over several range partitions.
    """
    if fits(df, small):
        w = Window.orderBy(*order)
        return df.withColumn(name, (F.row_number().over(w) - 1).cast("bigint"))
    ranged = cut_lineage(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start"))
    placed = ranged.join(F.broadcast(starts), "_part")
    return placed.withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit(_MASK))).drop(
        "_at", "_part", "_start", "_n")


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: dict[str, str],
    descending: bool = False,
    small: int = SMALL,
    pieces: int | None = None,
) -> DataFrame:
    """Add inclusive running sums of ``sums`` (new name -> column) within ``keys``.

    ``order`` must be numeric, without null or NaN, and unique within ``keys``.
    Beyond ``small`` rows the range of ``order`` is cut at sketched quantiles
    into pieces of about ``PIECE_ROWS`` rows: totals of whole pieces come from
    one small aggregate, and only rows of one piece are ordered in one task.
    """
    direction = F.desc if descending else F.asc
    rows = df.count()
    if rows <= small:
        w = Window.partitionBy(*keys).orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(c).over(w).alias(n) for n, c in sums.items()])
    pieces = pieces or max(2, math.ceil(rows / PIECE_ROWS))
    grid = F.array(*[F.lit(i / pieces) for i in range(1, pieces)])
    cuts = sorted(set(df.agg(F.percentile_approx(F.col(order).cast("double"), grid, max(20_000, 10 * pieces))).first()[0]))
    edges = [float("-inf"), *[c for c in cuts if math.isfinite(c)], float("inf")]
    marked = Bucketizer(splits=edges, inputCol=order, outputCol="_piece").transform(df)
    totals = marked.groupBy(*keys, "_piece").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy(direction("_piece")).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *keys, "_piece",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in sums])
    local = Window.partitionBy(*keys, "_piece").orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
    # Both sides are keyed by (keys, piece): the window reuses the join's partitioning.
    joined = marked.join(starts, [*keys, "_piece"])
    out = joined.select(
        *df.columns, *[(F.col(f"_s_{n}") + F.sum(c).over(local)).alias(n) for n, c in sums.items()])
    return out


def lookup(big: DataFrame, table: DataFrame, key: str, count: str, small: int = BROADCAST) -> DataFrame:
    """Left join of a key table (one row per key, with its row count in ``big``).

    A table of at most ``small`` bytes is broadcast. Otherwise keys holding over a thousandth of the
    rows (at most a thousand of them) are broadcast and the others shuffled, so
    no key makes a hot partition.
    """
    keys, length, total = table.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(key).cast("string"))), F.sum(count)).first()
    if keys * (16 + 8 * len(table.columns)) + (length or 0) <= small:
        return big.join(F.broadcast(table.drop(count)), key, "left")
    is_hot = F.col(count) > total / 1000.0
    hot = table.where(is_hot).select(key, F.lit(True).alias("_hot"))
    marked = big.join(F.broadcast(hot), key, "left")
    first = marked.where(F.col("_hot")).drop("_hot").join(
        F.broadcast(table.where(is_hot).drop(count)), key, "left")
    # A null key is matched by no row of the table: spread it instead of sending it to one task.
    other = marked.where(F.col("_hot").isNull() & F.col(key).isNotNull()).drop("_hot")
    second = other.join(table.where(~is_hot).drop(count), key, "left")
    null_rows = marked.where(F.col("_hot").isNull() & F.col(key).isNull()).drop("_hot")
    extra = [c for c in table.columns if c not in (key, count)]
    third = null_rows.select("*", *[F.lit(None).cast(table.schema[c].dataType).alias(c) for c in extra])
    return first.unionByName(second).unionByName(third)


def beside(big: DataFrame, means: DataFrame, keys: Sequence[str], most: int = 100_000) -> DataFrame:
    """Inner join of a table of few numbers per key; up to ``most`` keys are broadcast, so
    rows of a frequent key need not meet in one task. Beyond, Spark joins by shuffle and
    splits uneven partitions."""
    return big.join(F.broadcast(means) if fits(means, most) else means, list(keys))
