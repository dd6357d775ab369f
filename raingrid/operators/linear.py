"""Small dense linear algebra and distributions as column expressions.

A system per row: matrices are arrays of rows, solved inside the JVM. Nothing here shuffles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from raingrid.operators.common import total

#: Pivots below this share of the largest diagonal entry count as zero.
TINY = 1e-13


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def products(columns: Column) -> Column:
    """Matrix of the products of all pairs of ``columns`` (arrays of one length)."""
    return let(columns, lambda z: F.transform(z, lambda a: F.transform(z, lambda b: dot(a, b))))


def solve(matrix: Column, size: Column) -> Column:
    """Solutions of a symmetric system, one array per unknown with a value for each right side.

    ``matrix`` has ``size`` rows of ``size`` coefficients and then the right sides. Rows are
    eliminated in turn; an unknown that depends on those before it becomes 0.
    """
    def eliminated(m, least):
        def step(m, j):
            pivot = F.get(m, j)
            unit = let(F.get(pivot, j), lambda at: F.transform(
                pivot, lambda x: F.when(F.abs(at) > least, x / at).otherwise(0.0)))
            return let(unit, lambda p: F.transform(m, lambda row, i: F.when(i == j, p).otherwise(
                let(F.get(row, j), lambda by: F.zip_with(row, p, lambda x, y: x - by * y)))))

        done = F.aggregate(F.sequence(F.lit(0), size - 1), m, step)
        return F.transform(done, lambda row: F.slice(row, size + 1, F.size(row)))

    def largest(m):
        return F.array_max(F.transform(F.sequence(F.lit(0), size - 1),
                                       lambda i: F.abs(F.get(F.get(m, i), i))))

    return let(matrix, lambda m: let(TINY * largest(m), lambda least: eliminated(m, least)))


def residuals(matrix: Column) -> Column:
    """Squared residual of the last variable after regressing it on the first 1, 2, .. others.

    ``matrix`` holds the products of all pairs of variables. One elimination serves all orders.
    """
    def below(m, pivot, at, j):
        return F.transform(m, lambda row, i: F.when(i <= j, row).otherwise(
            let(F.coalesce(F.try_divide(F.get(row, j), at), F.lit(0.0)), lambda by: F.zip_with(
                row, pivot, lambda x, y: x - by * y))))

    def step(s, j):
        m = let(F.get(s["m"], j), lambda pivot: below(s["m"], pivot, F.get(pivot, j), j))
        return let(m, lambda m: F.struct(m.alias("m"), F.concat(s["out"], F.array(
            F.element_at(F.element_at(m, -1), -1))).alias("out")))

    def swept(m):
        start = F.struct(m.alias("m"), F.array().cast("array<double>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(m) - 2), start, step)["out"]

    return let(matrix, swept)


#: Rational formula of the normal distribution, error below 7.5e-8.
NORMAL = (0.2316419, 0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_share(x: Column) -> Column:
    """Share of the standard normal distribution up to ``x``."""
    k = 1.0 / (1.0 + NORMAL[0] * F.abs(x))
    poly = F.lit(0.0)
    for c in reversed(NORMAL[1:]):
        poly = (poly + c) * k
    upper = poly * F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    return F.when(x >= 0, 1.0 - upper).otherwise(upper)


#: Series for the logarithm of the gamma function.
GAMMA = (76.18009172947146, -86.50532032941677, 24.01409824083091, -1.231739572450155,
         1.208650973866179e-3, -5.395239384953e-6)


def log_gamma(x: Column) -> Column:
    base = x + 5.5
    series = F.lit(1.000000000190015)
    for i, c in enumerate(GAMMA, 1):
        series = series + c / (x + float(i))
    return (x + 0.5) * F.log(base) - base + F.log(2.5066282746310005 * series / x)


def beta_share(x: Column, a: Column, b: Column, terms: int = 200) -> Column:
    """Regularised incomplete beta function, by its continued fraction.

    The fraction is worked out from the far end, where it converges fast (x below the mean);
    elsewhere the function of 1 - x with ``a`` and ``b`` changed over is taken from 1.
    """
    def fraction(x, a, b):
        def step(tail, k):
            m = F.floor(k / 2).cast("double")
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            return F.when(k % 2 == 0, even).otherwise(odd) / (1.0 + tail)

        # d_k / (1 + d_k+1 / (1 + ..)) from the last term on; d_1 is the first
        tail = F.aggregate(F.sequence(F.lit(terms), F.lit(1)), F.lit(0.0), step)
        front = F.exp(a * F.log(x) + b * F.log(1.0 - x)
                      + log_gamma(a + b) - log_gamma(a) - log_gamma(b))
        return front / (a * (1.0 + tail))

    return (F.when(x <= 0, 0.0).when(x >= 1, 1.0)
            .when(x < (a + 1.0) / (a + b + 2.0), fraction(x, a, b))
            .otherwise(1.0 - fraction(1.0 - x, b, a)))


def student_tails(t: Column, freedom: Column) -> Column:
    """Probability of a value as far from 0 as ``t`` or farther, on either side, under Student's
    distribution."""
    nu = freedom.cast("double")
    return beta_share(nu / (nu + t * t), nu / 2.0, F.lit(0.5))
