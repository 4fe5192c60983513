"""Bootstraps of exactly n of n rows, drawn apart for every range of hashed keys.

Drawing n of n rows gives multinomial counts. They are split like a tree: how many draws fall
into the lower half of a range of hashes is binomial, given how many fall into the range. A
task follows the path to its range, drawing the same numbers as every other task that
passes there, and deals the draws of the range to its rows. So the totals are exact
although no task sees all rows, and do not depend on how the rows are laid out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.draws import text_code
from ..session import cut_lineage, ready_workers

# Rows that a range should have; a range is drawn in one task.
RANGE_ROWS = 20_000


def _path(sizes: list[np.ndarray], place: int, total: int, seed: int, tree: int) -> int:
    """Draws that fall into the range ``place``; ``sizes[d]`` counts the rows of the 2^d ranges of depth d."""
    draws = total
    for depth in range(1, len(sizes)):
        at = place >> (len(sizes) - 1 - depth)
        low, high = int(sizes[depth][at & ~1]), int(sizes[depth][at | 1])
        if draws and low + high:
            rng = np.random.default_rng([seed, tree, depth, at >> 1])
            lower = int(rng.binomial(draws, low / (low + high)))
            draws = draws - lower if at & 1 else lower
    return draws


def exact_bootstrap(rows: DataFrame, key: str, trees: int, seed: int | str = 42, range_rows: int = RANGE_ROWS, name: str = "w") -> DataFrame:
    """``rows`` with ``name``, an array of weights that sum to the number of rows in every tree.

    Rows of one key are told apart by their place among all rows of that key, which is arbitrary but does
    not change the totals. An empty table stays empty.
    """
    ready_workers(rows.sparkSession)
    n = rows.count()
    depth = max(0, math.ceil(math.log2(max(1, n) / range_rows))) if n else 0
    hashed = F.xxhash64(F.lit(f"{seed}|bootstrap"), col(key))
    placed = cut_lineage(rows.select(
        "*", hashed.alias("_hash"), F.shiftrightunsigned(hashed, 64 - depth).cast("int").alias("_range") if depth else F.lit(0).alias("_range")))
    counts = np.zeros(1 << depth, np.int64)
    # One number per RANGE_ROWS rows.
    for r in placed.groupBy("_range").count().collect():
        counts[r["_range"]] = r["count"]
    sizes = [counts]
    while len(sizes[0]) > 1:
        sizes.insert(0, sizes[0].reshape(-1, 2).sum(axis=1))
    shared = rows.sparkSession.sparkContext.broadcast(sizes)
    code = text_code(str(seed))
    names = rows.columns

    def draw(part: pa.Table) -> pa.Table:
        part = part.sort_by([("_hash", "ascending")])
        at, size = part["_range"][0].as_py(), len(part)
        w = np.zeros((size, trees), np.int32)
        for tree in range(trees):
            draws = _path(shared.value, at, n, code, tree)
            rng = np.random.default_rng([code, tree, at, 7])
            w[:, tree] = np.bincount(rng.integers(0, size, draws), minlength=size)
        listed = pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * trees), pa.array(w.ravel()))
        return part.select(names).append_column(name, listed)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{name}` array<int>"
    parts = max(1 << depth, 1)
    return placed.repartition(parts, "_range").groupBy("_range").applyInArrow(draw, schema)
