"""Aggregates: weighted sums, raw and weighted moments, population moments, standard errors, quantiles, allele frequencies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def weighted_sum(x, w) -> Column:
    return F.sum(_c(w) * _c(x))


def weighted_mean(x, w) -> Column:
    return F.sum(_c(w) * _c(x)) / F.sum(_c(w))


def exact_sum(x, digits: int = 18) -> Column:
    """A sum without rounding of its terms: decimals with so many digits after the point, 38 in all; fails if they overflow."""
    return F.sum(_c(x).cast(f"decimal(38,{digits})")).cast("double")


def exact_weighted_sum(x, w, digits: int = 9) -> Column:
    """A weighted sum without rounding: x and w as decimals with so many digits after the point, and twice as many in the sum."""
    term = lambda c: _c(c).cast(f"decimal({19},{digits})")
    return F.sum(term(x) * term(w)).cast("double")


def scaled_sum(x) -> Column:
    """A sum of any magnitude with a small error: terms are split at the unit, whole parts and rests are summed apart."""
    rest = _c(x) % 1
    return F.sum((_c(x) - rest).cast("decimal(38,0)")).cast("double") + F.sum(rest.cast("decimal(38,18)")).cast("double")


def variance(x) -> Column:
    """Population variance."""
    return F.var_pop(_c(x))


def moment(x, n: int) -> Column:
    """Raw moment of order n."""
    return F.avg(F.pow(_c(x), F.lit(float(n))))


def weighted_moment(x, w, n: int) -> Column:
    return F.sum(_c(w) * F.pow(_c(x), F.lit(float(n)))) / F.sum(_c(w))


def skewness(x) -> Column:
    return F.skewness(_c(x))


def kurtosis(x) -> Column:
    """Excess kurtosis of the population."""
    return F.kurtosis(_c(x))


def error_of_mean(x) -> Column:
    """Standard error, with the n - 1 variance."""
    return F.stddev_samp(_c(x)) / F.sqrt(F.count(_c(x)))


def quantiles(x, probs: list[float], accuracy: int = 10_000, exact: bool = False) -> Column:
    """Approximate by a sketch of bounded size, or exact."""
    return F.percentile(_c(x), F.array(*map(F.lit, probs))) if exact else F.percentile_approx(_c(x), F.array(*map(F.lit, probs)), F.lit(accuracy))


def minor_allele_frequency(allele) -> Column:
    p = F.avg(_c(allele).cast("double"))
    return F.least(p, 1 - p)


def minmax(x) -> Column:
    return F.struct(F.min(_c(x)).alias("min"), F.max(_c(x)).alias("max"))
