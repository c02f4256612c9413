"""Two-sided p-values of Student's t as column expressions: no Python worker."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pairs of terms of the continued fraction; more than enough for 10^5 degrees of freedom.
PAIRS = 400


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: Stirling's series at x + 8, brought back by the recurrence."""
    y, product = x + 8, x
    for k in range(1, 8):
        product = product * (x + k)
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7))) + 1 / (1188 * F.pow(y, F.lit(9)))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - F.ln(product)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, from its last term to its first."""

    def pair(rest: Column, m: Column) -> Column:
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return even / (1 + odd / (1 + rest))

    rest = F.aggregate(F.sequence(F.lit(PAIRS), F.lit(1), F.lit(-1)), F.lit(0.0), lambda rest, m: pair(rest, m.cast("double")))
    return 1 / (1 - (a + b) * x / (a + 1) / (1 + rest))


def student_p(t: Column, freedom: Column) -> Column:
    """P(|T| >= |t|) for ``freedom`` degrees; null for null or no degrees, NaN for NaN, 0 for an infinite t."""
    v = freedom.cast("double")
    square = t * t
    x, rest = v / (v + square), square / (v + square)
    a, b = v / 2, F.lit(0.5)
    near = x < (a + 1) / (a + b + 2)
    one, two = F.when(near, a).otherwise(b), F.when(near, b).otherwise(a)
    low, high = F.when(near, x).otherwise(rest), F.when(near, rest).otherwise(x)
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b)) * F.pow(low, one) * F.pow(high, two) / one
    tail = front * _fraction(one, two, low)
    p = F.when(near, tail).otherwise(1 - tail)
    certain = F.when(F.isnan(t), F.lit(float("nan"))).when(F.abs(t) == float("inf"), F.lit(0.0)).when(t == 0, F.lit(1.0))
    return F.when((v > 0) & t.isNotNull(), F.when(F.isnan(t) | (F.abs(t) == float("inf")) | (t == 0), certain).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))))
