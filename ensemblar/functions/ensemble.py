"""Scores of one case: its sorted members in an array, and the observation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def members(value: str = "value") -> Column:
    """Aggregate: the case's values, sorted; NULL members are left out."""
    return F.array_sort(F.collect_list(value))


def _total(xs: Column, each) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + each(x))


def crps(xs: Column, obs: Column, fair: bool = True) -> Column:
    """Order-statistic form: mean|x - y| - sum (2k - n - 1) x(k) / (n (n - 1)), or / n² if not fair. One member has no spread term; no member gives NULL."""
    n = F.size(xs)
    error = _total(xs, lambda x: F.abs(x - obs)) / n
    weighed = F.transform(xs, lambda x, k: (2 * (k + 1) - n - 1) * x)
    spread = _total(weighed, lambda x: x) / (n * (n - 1) if fair else n * n)
    return F.when((n > 0) & obs.isNotNull(), error - F.when(n > 1, spread).otherwise(0.0))


def crps_pairwise(xs: Column, obs: Column) -> Column:
    """mean|x - y| - sum over pairs |xi - xj| / (2 n (n - 1)); the same value as the fair order-statistic form."""
    n = F.size(xs)
    pairs = _total(xs, lambda x: _total(xs, lambda z: F.abs(x - z)))
    return F.when((n > 0) & obs.isNotNull(), _total(xs, lambda x: F.abs(x - obs)) / n - F.when(n > 1, pairs / (2 * n * (n - 1))).otherwise(0.0))


def crps_normal(y: Column, cdf: Column, pdf: Column) -> Column:
    """CRPS of the standard normal distribution at y."""
    return y * (2 * cdf - 1) + 2 * pdf - 1 / F.sqrt(F.pi())


def below(xs: Column, obs: Column) -> Column:
    return F.size(F.filter(xs, lambda x: x < obs))


def ties(xs: Column, obs: Column) -> Column:
    return F.size(F.filter(xs, lambda x: x == obs))


def rank(xs: Column, obs: Column, u: Column) -> Column:
    """Members below, plus a uniform place among the ties."""
    return below(xs, obs) + F.floor(u * (ties(xs, obs) + 1)).cast("int")
