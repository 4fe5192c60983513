"""Feature preparation: noise columns, split, scaling, encoding.

Fitted numbers (means, spreads, thresholds) are one small row each and enter
the data path as literals, so preparing a table is one projection over it plus
the lookups of the text codes.
"""

from __future__ import annotations

import hashlib

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, numeric_columns, per_feature, text_columns
from ..functions.ordering import lookup, with_position
from ..functions.quantiles import order_statistic
from ..functions.rand import batch_normals, hash_normal_array, hash_uniform
from .profile import CLASSIFICATION, REGRESSION

WIDTH = 500          # columns of a prepared table
TRAIN_ROWS = 150     # rows of its training part
MAX_INDICATORS = 1000  # indicator columns that a text column may become


def first_columns(df: DataFrame, k: int = WIDTH) -> DataFrame:
    return df.select(*[col(c) for c in df.columns[:k]])


def modeling_ready(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """Every column as a double; text that is no number becomes null."""
    return df.select(*[col(k) for k in keep], *[col(c).try_cast("double").alias(c) for c in columns])


def numeric_label(df: DataFrame, column: str) -> Column:
    """Predicted label as a number: numbers stay, '1' and true are 1, other text is 0."""
    if isinstance(df.schema[column].dataType, T.StringType):
        return F.when(col(column) == "1", 1.0).otherwise(0.0)
    return col(column).cast("double")


def random_label_if_nan(c: Column, seed, *keys) -> Column:
    """A missing prediction becomes 0 or 1 at random."""
    coin = F.when(hash_uniform(seed, *keys) < 0.5, 0.0).otherwise(1.0)
    return F.when(c.isNull() | F.isnan(c), coin).otherwise(c)


def finite_or_zero(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


# --- noise columns ------------------------------------------------------------------


def _pick(seed, i: int, k: int) -> int:
    word = hashlib.md5(f"{seed}|pick|{i}".encode()).hexdigest()[:8]
    return int(int(word, 16) / 4294967296.0 * k)


def _signals(df: DataFrame, features: list[str], n: int, seed) -> tuple[list[str], dict[str, tuple[float, float]]]:
    """The feature that each of ``n`` noise columns is mixed with, and the mean and spread of those."""
    picks = [features[_pick(seed, i, len(features))] for i in range(n)] if features else []
    used = sorted(set(picks))
    if not used:
        return picks, {}
    rows = per_feature(df, used, {"m": lambda c, p: F.avg(c), "s": lambda c, p: F.stddev_pop(c)})
    return picks, {r.feature: (r.m, r.s) for r in rows.collect()}


def _with_noise(df: DataFrame, key: str, n: int, seed, picks: list[str], stats: dict[str, tuple[float, float]]) -> DataFrame:
    """Add the array column ``_noise`` of ``n`` mixed noise values."""
    df = _parallel(df)
    noise = batch_normals(f"{seed}|mix", n, key)
    if not picks:
        return df.select("*", noise.alias("_noise"))
    scaled = {c: (col(c) - F.lit(m)) / F.lit((s or 0.0) + 1e-8) for c, (m, s) in stats.items()}
    if n <= 32:
        # Few columns stay generated code; many share one lambda.
        drawn = df.select("*", noise.alias("_drawn"))
        mixed = F.array(*[scaled[c] + 2.0 * F.get("_drawn", F.lit(i)) for i, c in enumerate(picks)])
        return drawn.select(*[col(c) for c in df.columns], mixed.alias("_noise"))
    used = list(scaled)
    at = F.array(*[F.lit(used.index(c) + 1) for c in picks])
    mixed = F.zip_with(at, noise, lambda i, e: F.element_at(F.col("_signals"), i) + 2.0 * e)
    return df.select("*", F.array(*scaled.values()).alias("_signals")).select(*[col(c) for c in df.columns], mixed.alias("_noise"))


def _parallel(df: DataFrame) -> DataFrame:
    """Deal out rows before a heavy projection if the table lies in fewer pieces than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _mixed_noise(df: DataFrame, features: list[str], key: str, n: int, seed) -> DataFrame:
    return _with_noise(df, key, n, seed, *_signals(df, features, n, seed))


def noise_mix(df: DataFrame, features: list[str], key: str, n: int, seed=42) -> DataFrame:
    """Add ``n`` columns of one part standardised feature and two parts noise."""
    return _spread(_mixed_noise(df, features, key, n, seed), n, "noise_signal_1to2") if n > 0 else df


def noise_pad(df: DataFrame, features: list[str], key: str, width: int = WIDTH, name="extra_noise", seed=42) -> DataFrame:
    """Add normal noise columns until there are ``width`` features."""
    n = max(0, width - len(features))
    df = _parallel(df) if n else df
    return _spread(df.select("*", hash_normal_array(f"{seed}|pad", n, key).alias("_noise")), n, name) if n else df


def _spread(df: DataFrame, n: int, name: str) -> DataFrame:
    """The elements of the array column ``_noise`` as ``n`` columns."""
    return df.select(*[col(c) for c in df.columns if c != "_noise"], *[F.col("_noise")[i].alias(f"{name}_{i}") for i in range(n)])


# --- split ------------------------------------------------------------------------------


def split(df: DataFrame, key: str, train_rows: int = TRAIN_ROWS, seed=42) -> tuple[DataFrame, DataFrame]:
    """Exactly ``train_rows`` random rows to train on, the others to test on.

    The rows are ordered by a hash of the key. Only the last training row is
    looked up; both parts are then filters, without a join or a stored shuffle.
    """
    h = hash_uniform(seed, key)
    order = F.struct(h.alias("h"), col(key).alias("k"))
    if train_rows <= 10_000:
        last = df.select(order.alias("o")).orderBy("o").limit(train_rows).agg(F.max("o").alias("o")).first().o
        if last is None:
            return df, df.where(F.lit(False))
        h_last, k_last = last.h, last.k
    elif df.count() < train_rows:
        return df, df.where(F.lit(False))
    else:
        h_last = order_statistic(df.select(h.alias("h")), "h", train_rows - 1)
        below = df.where(h < h_last).count()
        ties = df.where(h == h_last).select(col(key).alias("k")).orderBy("k").limit(train_rows - below)
        k_last = ties.agg(F.max("k")).first()[0]
    chosen = (h < F.lit(h_last)) | ((h == F.lit(h_last)) & (col(key) <= F.lit(k_last)))
    return df.where(chosen), df.where(~chosen)


def split_fraction(df: DataFrame, key: str, share: float, seed=42) -> tuple[DataFrame, DataFrame]:
    """About ``share`` of the rows to train on; no row is looked up."""
    chosen = hash_uniform(seed, key) < share
    return df.where(chosen), df.where(~chosen)


# --- scaling -------------------------------------------------------------------------------


def scale(train: DataFrame, test: DataFrame, columns: list[str], eps: float | None = None):
    """Standardise both parts by the mean and population spread of the training part.

    A constant column is only centred; with ``eps`` the spread is shifted instead.
    """
    rows = per_feature(train, columns, {"m": lambda c, p: F.avg(c), "s": lambda c, p: F.stddev_pop(c)})
    stats = {r.feature: (r.m, r.s + eps if eps is not None else (r.s or 1.0)) for r in rows.collect() if r.m is not None}

    def apply(df):
        return df.select(*[
            ((col(c).cast("double") - F.lit(stats[c][0])) / F.lit(stats[c][1])).alias(c) if c in stats else col(c)
            for c in df.columns])

    return apply(train), apply(test)


# --- encoding ---------------------------------------------------------------------------------


def _codes(values: DataFrame, column: str) -> DataFrame:
    counts = values.groupBy(col(column)).agg(F.count(F.lit(1)).alias("_n"))
    return with_position(counts, [col(column)], "_code")


def _encode(df: DataFrame, codes: DataFrame, column: str) -> DataFrame:
    coded = lookup(df, codes, column, "_n")
    return coded.withColumn(column, F.col("_code").cast("double")).select(*[col(c) for c in df.columns])


def label_encode(train: DataFrame, test: DataFrame, columns: list[str]):
    """Text to its index among the sorted values of both parts; null counts as 'nan'."""
    for c in columns:
        train = train.withColumn(c, F.coalesce(col(c), F.lit("nan")))
        test = test.withColumn(c, F.coalesce(col(c), F.lit("nan")))
        codes = _codes(train.select(col(c)).unionByName(test.select(col(c))), c)
        train, test = _encode(train, codes, c), _encode(test, codes, c)
    return train, test


def encode_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text to its index among the sorted values of the table; null counts as 'missing'."""
    for c in columns:
        df = df.withColumn(c, F.coalesce(col(c), F.lit("missing")))
        df = _encode(df, _codes(df.select(col(c)), c), c)
    return df


def one_hot(train: DataFrame, test: DataFrame, columns: list[str]):
    """Indicator columns ``{column}_{value}`` of the training values; unseen values are all 0.

    Over ``MAX_INDICATORS`` values of a column are an error: ``one_hot_vector`` is for those.
    """
    for c in columns:
        values = train.where(col(c).isNotNull()).select(col(c).alias("v")).distinct()
        found = [r.v for r in values.limit(MAX_INDICATORS + 1).collect()]
        if len(found) > MAX_INDICATORS:
            raise ValueError(f"{c} has over {MAX_INDICATORS} values; use one_hot_vector")
        found.sort()

        def apply(df, c=c, found=found):
            cells = [F.coalesce((col(c) == v).cast("double"), F.lit(0.0)).alias(f"{c}_{v}") for v in found]
            return df.select(*[col(o) for o in df.columns if o != c], *cells)

        train, test = apply(train), apply(test)
    return train, test


def one_hot_vector(train: DataFrame, test: DataFrame, column: str):
    """The indicators of ``column`` as one sparse vector; unseen values are the zero vector."""
    codes = _codes(train.where(col(column).isNotNull()).select(col(column)), column)
    unseen = codes.count()

    def coded(df):
        out = lookup(df, codes, column, "_n")
        return out.withColumn("_code", F.coalesce(F.col("_code"), F.lit(unseen)).cast("double"))

    encoder = OneHotEncoder(inputCol="_code", outputCol="_vector", handleInvalid="keep", dropLast=True)
    # The encoder needs the number of codes only, so it is fitted on the code table.
    model = encoder.fit(codes.select(F.col("_code").cast("double").alias("_code")))

    def apply(df):
        out = model.transform(coded(df))
        return out.drop(column, "_code").withColumnRenamed("_vector", column)

    return apply(train), apply(test)


# --- the whole preparation ----------------------------------------------------------------------


def prepare(
    df: DataFrame, target: str, key: str, task: str, width: int = WIDTH, train_rows: int = TRAIN_ROWS, seed=42,
    truncate: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Split, encoding, noise columns and scaling to exactly ``width`` features.

    Noise fills what the encoded features leave. More features than ``width`` are an
    error; with ``truncate`` the last ones are cut.
    """
    numeric = numeric_columns(df, exclude=[target, key])
    texts = text_columns(df, exclude=[target, key])
    names = [c for c in df.columns if c not in (target, key)]
    narrow = df.select(col(key), col(target), *[col(c) for c in texts], *[col(c).cast("double").alias(c) for c in numeric])
    train, test = split(narrow, key, train_rows, seed)
    train, test = (label_encode if task == REGRESSION else one_hot)(train, test, texts)
    encoded = [c for c in train.columns if c not in (key, target, *numeric)]
    if len(numeric) + len(encoded) > width and not truncate:
        raise ValueError(f"{len(numeric) + len(encoded)} features do not fit into {width} columns")
    n = max(0, width - len(numeric) - len(encoded))
    # Noise and scaling work on one array column, which becomes hundreds of
    # columns only in the last projection.
    if n:
        signals = _signals(narrow, numeric, n, seed)
        train, test = (_with_noise(part, key, n, seed, *signals) for part in (train, test))
    values = F.array(*[col(c) for c in numeric]) if numeric else F.array().cast("array<double>")
    values = F.concat(values, F.col("_noise")) if n else values
    kept = [key, target, *encoded]
    train, test = (part.select(*[col(c) for c in kept], values.alias("_values")) for part in (train, test))
    train, test = _scale_array(train, test, "_values")
    mixed = [f"noise_signal_1to2_{i}" for i in range(n)]
    at = {c: i for i, c in enumerate([*numeric, *mixed])}
    if task == REGRESSION:
        order = [*[c for c in names if c in at or c in encoded], *mixed]
    else:
        order = [*[c for c in names if c in at], *encoded, *mixed]
    return tuple(
        part.select(col(key), *[F.col("_values")[at[c]].alias(c) if c in at else col(c) for c in order[:width]], col(target))
        for part in (train, test))


def _scale_array(train: DataFrame, test: DataFrame, column: str):
    """``scale`` for the elements of an array column."""
    stats = (
        train.select(F.posexplode(col(column)).alias("i", "v")).groupBy("i")
        .agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect())
    means = F.array(*[F.lit(r.m or 0.0) for r in stats])
    spreads = F.array(*[F.lit(r.s or 1.0) for r in stats])

    def apply(df):
        marked = F.transform(col(column), lambda v, i: (v - means[i]) / spreads[i])
        return df.withColumn(column, marked)

    return (apply(train), apply(test)) if stats else (train, test)


def summary(train: DataFrame, test: DataFrame, target: str, task: str) -> DataFrame:
    """Rows per split with the target mean, or rows per split and class."""
    both = train.select(F.lit("train").alias("split"), col(target).alias("y")).unionByName(
        test.select(F.lit("test").alias("split"), col(target).alias("y")))
    if task == CLASSIFICATION:
        return both.groupBy("split", F.col("y").cast("string").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("target_mean"))


def report(tables: DataFrame) -> DataFrame:
    """Averages over prepared tables by task, from (table, task, n_features, n_noise) rows."""
    return tables.groupBy("task").agg(
        F.count(F.lit(1)).alias("n_tables"),
        F.avg("n_features").alias("mean_features"),
        F.avg("n_noise").alias("mean_noise"))
