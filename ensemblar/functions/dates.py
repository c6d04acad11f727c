"""Calendar functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doy_index(day: Column) -> Column:
    """Day of year from 0; days after February stand one later in leap years."""
    return F.dayofyear(day) - 1


def valid_date(init: Column, lead_day: Column) -> Column:
    return F.date_add(init, lead_day)


def winter_year(day: Column) -> Column:
    """December counts to the next year's winter."""
    return F.year(day) + (F.month(day) == 12).cast("int")


def block_key(day: Column, by: str) -> Column:
    """Resampling block of a date: 'none' (each date), 'month', or 'season' of the calendar year (December with January and February of its own year)."""
    if by == "none":
        return day.cast("string")
    if by == "month":
        return F.date_format(day, "yyyy-MM")
    if by == "season":
        return F.concat_ws("-", F.year(day), F.floor((F.month(day) % 12) / 3))
    raise ValueError(f"unknown block {by!r}")


def step_key(time: Column) -> Column:
    """YYYY_SSSS: six-hour steps since the start of the year."""
    hours = (F.dayofyear(time) - 1) * 24 + F.hour(time)
    return F.concat_ws("_", F.year(time), F.lpad(F.floor(hours / 6).cast("string"), 4, "0"))


def step_time(key: Column) -> Column:
    """The timestamp of a YYYY_SSSS key."""
    parts = F.split(key, "_")
    start = F.make_timestamp(parts[0].cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return start + F.make_interval(hours=parts[1].cast("int") * 6)


def name_date(name: Column, pattern: str = r"_(\d{8})", fmt: str = "yyyyMMdd") -> Column:
    """The date in a file name; null where the pattern is not found."""
    return F.try_to_date(F.regexp_extract(name, pattern, 1), fmt)


def week_of(lead_day: Column) -> Column:
    """Week k holds lead days 7k-6..7k; day 0 belongs to none."""
    return F.when(lead_day > 0, F.ceil(lead_day / 7).cast("int"))
