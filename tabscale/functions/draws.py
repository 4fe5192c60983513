"""Random draws by arithmetic modulo a prime, alike in Spark SQL and in numpy.

Spark hashes a row's key once, into a code. All further draws follow from codes by
``fold``, so that a task which grows a whole subtree draws the same numbers as passes
over the rows do.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .rand import poisson_steps

PRIME = (1 << 31) - 1
_A, _B = 742938285, 950706376
_COARSE = 15  # bits dropped before a Poisson count is looked up


def text_code(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:4], "big") % PRIME


def row_code(seed: str, key) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(PRIME))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _times(a: Column, b: Column) -> Column:
    return F.pmod(a * b, F.lit(PRIME))


def fold(code: Column | int, value: Column | int) -> Column:
    """The code of (code, value): a linear step, then the fifth power, which permutes."""
    code, value = (F.lit(v).cast("bigint") if isinstance(v, int) else v.cast("bigint") for v in (code, value))
    start = F.pmod(code * F.lit(_A) + value * F.lit(_B) + F.lit(1), F.lit(PRIME))
    return _let(start, lambda t: _let(_times(t, t), lambda s: _times(_times(s, s), t)))


def uniform(code: Column) -> Column:
    return code / F.lit(float(PRIME))


def pick(code: Column, n: Column) -> Column:
    """A whole number below ``n``."""
    return F.floor(code * n / F.lit(PRIME)).cast("int")


def _limits(mean: float) -> list[int]:
    return [math.ceil(s * (1 << (31 - _COARSE))) for s in poisson_steps(mean) if s < 1]


def poisson(row: Column, other: Column, mean: float) -> Column:
    """Poisson copies of a row for another code, such as that of a trial."""
    coarse = F.shiftright(_times(row, other), _COARSE)
    return _let(coarse, lambda u: sum(((u >= s).cast("int") for s in _limits(mean)), F.lit(0)))


# --- the same in numpy ---------------------------------------------------------------


def np_reduce(x: np.ndarray) -> np.ndarray:
    """Products of two numbers below the prime, modulo it."""
    if x.size < 4000:
        return x % PRIME
    out = x >> 31
    x = x & PRIME
    out += x
    out -= (out >= PRIME) * PRIME
    return out


def np_fold(code, value) -> np.ndarray:
    code, value = np.asarray(code, np.int64), np.asarray(value, np.int64)
    t = (code * _A + value * _B + 1) % PRIME
    s = np_reduce(t * t)
    return np_reduce(np_reduce(s * s) * t)


def int_fold(code: int, value: int) -> int:
    t = (code * _A + value * _B + 1) % PRIME
    return pow(t, 5, PRIME)


def np_uniform(code: np.ndarray) -> np.ndarray:
    return code / float(PRIME)


def np_pick(code: np.ndarray, n: int) -> np.ndarray:
    # As Spark divides: the product as a double by the prime as a double.
    return np.floor((code * n) / PRIME).astype(np.int64)


def poisson_table(mean: float) -> np.ndarray:
    """Counts by the upper bits of a draw, for ``np_poisson``."""
    return np.searchsorted(np.array(_limits(mean)), np.arange(1 << (31 - _COARSE)), side="right").astype(np.int8)


def np_poisson(row: np.ndarray, other: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np_reduce(row * other) >> _COARSE]
