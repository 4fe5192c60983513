"""Embedding whitening with distributed block matrices.

Vectors become whole numbers, so that their sums are exact. The centred rows are indexed
and dealt into blocks of a ``BlockMatrix``; the transposed matrix times itself is the
scatter, whose eigenvectors are found on the driver (dimensions by dimensions), and
the block matrix times the whitening matrix projects every row.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear_names, stored

#: Fixed values of the contract: how entries become whole numbers, and the components shown.
SCALE, SHIFT, SHOWN = 1024, 100_000, 8
#: Rows and columns of a block.
BLOCK_ROWS, BLOCK_COLS = 1024, 1024
#: Blocks that one task of a product adds up.
BLOCKS_PER_TASK = 64
#: Eigenvalues below this share of the largest stand for directions in which the vectors do not vary.
FLAT = 1e-12


def whole_numbers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x array<bigint>) of the vectors whose entries are all finite.

    Null and empty vectors are left out, and so are vectors shorter than the longest: the
    entries they lack are null.
    """
    rows = clear_names(vectors, key, vector).select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where(F.col("v").isNotNull() & (F.size("v") == max(width, 1)) & ~bad).select(
        "vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def numbered(rows: DataFrame) -> tuple[DataFrame, int]:
    """Stored ``rows`` with a gapless ``index``, and their number."""
    at = F.monotonically_increasing_id()
    kept = stored(rows.select("*", F.shiftright(at, 33).alias("_part"), at.bitwiseAND((1 << 33) - 1).alias("_at")), "whitening-rows")
    starts, total = [], 0
    # One row per task of the write.
    for r in kept.groupBy("_part").count().orderBy("_part").collect():
        starts.append((r["_part"], total))
        total += r["count"]
    if not starts:
        return kept.withColumn("index", F.col("_at")).drop("_part", "_at"), 0
    table = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part bigint, _start bigint"))
    return kept.join(table, "_part").select("*", (F.col("_start") + F.col("_at")).alias("index")).drop("_part", "_at", "_start"), total


def sums_of(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of every dimension."""
    found = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).orderBy("i").collect()
    return (found[0]["n"] if found else 0), [int(r["s"]) for r in found]


def _java(matrix):
    return matrix._java_matrix_wrapper._java_model


def _scatter(blocks: BlockMatrix, n: int) -> np.ndarray:
    """Transpose times matrix; the rows are split, so that partial products are added up in many tasks."""
    splits = max(1, -(-n // (BLOCK_ROWS * BLOCKS_PER_TASK)))
    product = _java(blocks).transpose().multiply(_java(blocks), splits)
    return np.array(product.toLocalMatrix().toArray()).reshape(product.numCols(), product.numRows()).T


def components(scatter: np.ndarray, n: int, shown: int = SHOWN) -> tuple[np.ndarray, np.ndarray, float]:
    """(unit eigenvectors as columns, eigenvalues, trace) of the covariance, largest first, without flat directions."""
    covariance = (scatter + scatter.T) / (2 * n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = [i for i in range(min(shown, len(values))) if values[i] > FLAT * max(values[0], 1e-300)]
    return vectors[:, keep], values[keep], float(np.trace(covariance))


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", shown: int = SHOWN) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): one row per vector and component.

    ``deviation`` is the exact sum of squares of n * x - S over the dimensions. Vectors that are null,
    empty, shorter than others or hold null, NaN or infinite entries are left out; repeated rows and ids
    stay apart; null ids stay null. Directions in which the vectors do not vary have no
    component, so equal vectors, a single one or an empty table give no rows.
    """
    spark = vectors.sparkSession
    rows, n = numbered(whole_numbers(vectors, key, vector))
    _, sums = sums_of(rows)
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if n == 0:
        return spark.createDataFrame([], schema)
    total = F.array(*[F.lit(s) for s in sums]) if len(sums) <= 64 else F.from_json(F.lit(str(sums)), "array<bigint>")
    off = rows.withColumn("d", F.zip_with("x", total, lambda x, s: x * n - s))
    square = F.aggregate("d", F.lit(0).cast("decimal(38,0)"), lambda a, d: (a + d.cast("decimal(19,0)") * d.cast("decimal(19,0)")).cast("decimal(38,0)"))
    centred = off.select("index", array_to_vector(F.transform("d", lambda d: d.cast("double") / n)).alias("vector"))
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(centred, "vector"), n, len(sums))
    wide = min(len(sums), BLOCK_COLS)
    blocks = matrix.toBlockMatrix(BLOCK_ROWS, wide)
    axes, values, trace = components(_scatter(blocks, n), n, shown)
    if not len(values):
        return spark.createDataFrame([], schema)
    whitening = axes / np.sqrt(values)
    parts = [((i, 0), Matrices.dense(*whitening[s:s + wide].shape, whitening[s:s + wide].T.ravel()))
             for i, s in enumerate(range(0, len(sums), wide))]
    k = len(values)
    right = BlockMatrix(spark.sparkContext.parallelize(parts, len(parts)), wide, k, len(sums), k)
    projected = callMLlibFunc("getIndexedRows", _java(blocks.multiply(right).toIndexedRowMatrix()))
    flat = MLUtils.convertVectorColumnsToML(projected, "vector").select("index", vector_to_array("vector").alias("w"))
    flat = stored(flat, "whitened")
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    w = [F.get("w", F.lit(i)) for i in range(k)]
    found = flat.agg(*[F.avg(e) for e in w], *[F.avg(w[i] * w[j]) for i, j in pairs]).first()
    error = max(abs(found[k + at] - found[i] * found[j] - (i == j)) for at, (i, j) in enumerate(pairs))
    shares = F.array(*[F.lit(float(e / trace)) for e in values])
    scored = off.select("vec_id", "index", square.cast("bigint").alias("deviation")).join(flat, "index")
    return scored.select("vec_id", "deviation", F.posexplode("w").alias("i", "whitened")).select(
        "vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("i")).alias("explained"), F.lit(float(error)).alias("identity_error"))
