"""Standard normal distribution as column expressions."""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Service level in percent -> safety factor.
Z_TABLE = {
    80: 0.842, 85: 1.036, 90: 1.282, 91: 1.341, 92: 1.405, 93: 1.476,
    94: 1.555, 95: 1.645, 96: 1.751, 97: 1.881, 98: 2.054, 99: 2.326,
}
Z_DEFAULT = 1.645

# Hart's rational approximation of the normal tail, highest power first (public, ~1e-15).
HART_TOP = [
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
]
HART_BOTTOM = [
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
]

# Acklam's rational approximation of the inverse (public, ~1e-9), highest power first.
ACKLAM_A = [
    -3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
    1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00,
]
ACKLAM_B = [
    -5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
    6.680131188771972e+01, -1.328068155288572e+01, 1.0,
]
ACKLAM_C = [
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
    -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00,
]
ACKLAM_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00, 1.0]
ACKLAM_TAIL = 0.02425


def _horner(coefficients: list[float], x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def z_value(service_level: float) -> float:
    """Exact inverse normal for one level known when the plan is built."""
    if not 0 < service_level < 1:
        raise ValueError("service_level must lie strictly between 0 and 1")
    return NormalDist().inv_cdf(service_level)


def z_from_table(percent: Column) -> Column:
    """Safety factor by whole percent; levels outside the table get the 95 % factor."""
    table = F.create_map(*[F.lit(x) for pair in Z_TABLE.items() for x in pair])
    return F.coalesce(F.try_element_at(table, percent.cast("int")), F.lit(Z_DEFAULT))


def normal_cdf(x: Column) -> Column:
    size = F.abs(x)
    bell = F.exp(-size * size / 2.0)
    near = bell * _horner(HART_TOP, size) / _horner(HART_BOTTOM, size)
    fraction = size + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = size + F.lit(k) / fraction
    far = bell / fraction / math.sqrt(2 * math.pi)
    tail = F.when(size < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, 1.0 - tail).otherwise(tail)


def normal_inverse(p: Column) -> Column:
    """Inverse normal per row: rational start, then one Newton step; NULL outside (0, 1).

    The start is bound once as a lambda argument; pasted in at each use it would outgrow generated code.
    """
    centre = p - 0.5
    square = centre * centre
    middle = centre * _horner(ACKLAM_A, square) / _horner(ACKLAM_B, square)
    low_t = F.sqrt(-2.0 * F.ln(p))
    high_t = F.sqrt(-2.0 * F.ln(1.0 - p))
    low = _horner(ACKLAM_C, low_t) / _horner(ACKLAM_D, low_t)
    high = -_horner(ACKLAM_C, high_t) / _horner(ACKLAM_D, high_t)
    start = F.when(p < ACKLAM_TAIL, low).when(p > 1 - ACKLAM_TAIL, high).otherwise(middle)

    def refined(z: Column) -> Column:
        return z - (normal_cdf(z) - p) / (F.exp(-z * z / 2.0) / math.sqrt(2 * math.pi))

    return F.when((p > 0) & (p < 1), F.transform(F.array(start), refined)[0])
