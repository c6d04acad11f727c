"""Weights, angles, the normal distribution and keyed uniform numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rational approximation of erf, Abramowitz and Stegun 7.1.26.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def cos_weight(lat: Column) -> Column:
    return F.cos(F.radians(lat))


def sqrt_cos_weight(lat: Column) -> Column:
    return F.sqrt(F.cos(F.radians(lat)))


def mjo_phase(rmm1: Column, rmm2: Column) -> Column:
    """Phases 1..8, counted from the angle -180 degrees in eighths."""
    return F.least(F.floor((F.degrees(F.atan2(rmm2, rmm1)) + 180) / 45).cast("int") + 1, F.lit(8))


def amplitude(rmm1: Column, rmm2: Column) -> Column:
    return F.hypot(rmm1, rmm2)


def amplitude_stratum(size: Column) -> Column:
    return F.when(size >= 1.5, "strong").when(size >= 1, "moderate").when(size < 1, "inactive")


def transition_group(size: Column, later: Column, threshold: float = 1.0) -> Column:
    """sustained: active at both times; onset-decay: at one of them."""
    both, either = (size >= threshold) & (later >= threshold), (size >= threshold) | (later >= threshold)
    return F.when(both, "sustained").when(either, "onset-decay")


def wrap_angle(degrees: Column) -> Column:
    """The angle in [-180, 180)."""
    return F.pmod(degrees + 180, F.lit(360.0)) - 180


def normal_pdf(y: Column) -> Column:
    return F.exp(-y * y / 2) / F.sqrt(2 * F.pi())


def normal_cdf(y: Column) -> Column:
    """Good to 1.5e-7; stays inside generated code, as no UDF does."""
    x = F.abs(y) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + ERF_P * x)
    poly = reduce(lambda acc, a: (acc + F.lit(a)) * t, reversed(ERF_A), F.lit(0.0))
    erf = 1 - poly * F.exp(-x * x)
    return F.when(y >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def trend_value(ybar: Column, slope: Column, xbar: Column, year: Column) -> Column:
    return ybar + slope * (year - xbar)


def uniform(*keys: Column | str) -> Column:
    """A number in [0, 1) that depends on the keys alone, not on partitions. Keys: integers, dates and strings."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *keys)), 1, 8), 16, 10).cast("bigint") / 4294967296.0
