"""Response surfaces with known relevant columns, over hash columns of any table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rand import hash_normal, hash_normal_array, hash_uniform
from ..functions.stats import normal_cdf

AR_CORRELATION = 0.9
NOISE = 0.5  # spread of the additive noise


def hash_columns(df: DataFrame, key: str, p: int, seed="surface") -> DataFrame:
    """Columns x0... uniform on [0, 1), drawn by the row key."""
    return df.select("*", *[hash_uniform(f"{seed}|{j}", key).alias(f"x{j}") for j in range(p)])


def probit_label(x1: Column, x2: Column, seed, key: str) -> Column:
    """1 with the normal probability of 10 (x1 - 1) + 20 |x2 - 0.5|."""
    score = 10 * (x1 - 1) + 20 * F.abs(x2 - 0.5)
    return (hash_uniform(f"{seed}|label", key) < normal_cdf(score)).cast("int")


def local_surface(x1: Column, x2: Column, seed, key: str) -> Column:
    """100 (x1 - 0.5)^2 max(x2 - 0.25, 0) and noise."""
    return 100 * (x1 - 0.5) * (x1 - 0.5) * F.greatest(x2 - 0.25, F.lit(0.0)) + NOISE * hash_normal(f"{seed}|noise", key)


def interaction_columns(p: int) -> list[int]:
    """Columns 50, 100, 150, 200, or like places of a narrower table."""
    if p >= 200:
        return [49, 99, 149, 199]
    return [int(0.25 * p), int(0.5 * p), int(0.75 * p), min(int(0.99 * p), p - 1)]


def interaction_surface(x: Column, p: int, seed, key: str) -> Column:
    """2 x50 x100 + 2 x150 x200 and noise, of an array column."""
    a, b, c, d = interaction_columns(p)
    return 2 * x[a] * x[b] + 2 * x[c] * x[d] + NOISE * hash_normal(f"{seed}|noise", key)


def linear_columns(p: int) -> list[int]:
    """Columns 50, 100, 150, or like places of a narrower table."""
    if p >= 150:
        return [49, 99, 149]
    return [int(0.33 * p), int(0.66 * p), min(int(0.99 * p), p - 1)]


def linear_surface(x: Column, p: int, seed, key: str) -> Column:
    """2 x50 + 2 x100 + 4 x150 and noise, of an array column."""
    a, b, c = linear_columns(p)
    return 2 * x[a] + 2 * x[b] + 4 * x[c] + NOISE * hash_normal(f"{seed}|noise", key)


def normal_columns(p: int, seed, key: str) -> Column:
    """Array of independent standard normals."""
    return hash_normal_array(f"{seed}|z", p, key)


def correlated_columns(p: int, seed, key: str, rho: float = AR_CORRELATION) -> Column:
    """Array of normals with correlation rho^|i - j|: each is rho times the one before plus its own draw."""
    spread = math.sqrt(1 - rho * rho)
    return F.aggregate(
        normal_columns(p, seed, key), F.array().cast("array<double>"),
        lambda seen, z: F.concat(seen, F.array(F.when(
            F.size(seen) > 0, rho * F.element_at(seen, -1) + spread * z).otherwise(z))))
