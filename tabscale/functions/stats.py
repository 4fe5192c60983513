"""Statistical column expressions that Spark does not offer ready-made."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_skewness(c: Column) -> Column:
    """Bias-corrected skewness; NULL below three values."""
    n = F.count(c).cast("double")
    return F.when(n >= 3, F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def sample_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis; NULL below four values."""
    n = F.count(c).cast("double")
    return F.when(
        n >= 4,
        F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6),
    )


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation over complete pairs; NULL when either is constant."""
    x = F.when(b.isNotNull(), a)
    y = F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(x) * F.stddev_samp(y))


def _polynomial(x: Column, coefficients) -> Column:
    acc = F.lit(coefficients[0])
    for c in coefficients[1:]:
        acc = acc * x + F.lit(c)
    return acc


# Coefficients of the published double-precision rational
# approximation of the normal distribution function (Hart 5666, as given by West).
CDF_TOP = [
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
]
CDF_BOTTOM = [
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
]

# Coefficients of Acklam's published approximation of the normal
# quantile function.
PPF_A = [
    -3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
    1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00,
]
PPF_B = [
    -5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
    6.680131188771972e+01, -1.328068155288572e+01, 1.0,
]
PPF_C = [
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
    -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00,
]
PPF_D = [
    7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
    3.754408661907416e+00, 1.0,
]
PPF_LOW = 0.02425


def normal_cdf(x: Column) -> Column:
    z = F.abs(x)
    e = F.exp(-z * z / 2)
    near = e * _polynomial(z, CDF_TOP) / _polynomial(z, CDF_BOTTOM)
    far = e / (z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))) / math.sqrt(2 * math.pi)
    tail = F.when(z > 37, F.lit(0.0)).when(z < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def normal_quantile(p: Column) -> Column:
    low = F.sqrt(F.lit(-2.0) * F.ln(F.when(p < PPF_LOW, p)))
    high = F.sqrt(F.lit(-2.0) * F.ln(F.when(p > 1 - PPF_LOW, 1 - p)))
    q = p - 0.5
    r = q * q
    return (
        F.when(p < PPF_LOW, _polynomial(low, PPF_C) / _polynomial(low, PPF_D))
        .when(p > 1 - PPF_LOW, -_polynomial(high, PPF_C) / _polynomial(high, PPF_D))
        .otherwise(_polynomial(r, PPF_A) * q / _polynomial(r, PPF_B))
    )
