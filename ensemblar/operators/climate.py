"""Climatologies, anomalies and bias corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import doy_index
from .segments import rolling


def doy_climatology(obs: DataFrame, keys: list[str], years: tuple[int, int] | None = None) -> DataFrame:
    """Mean and number of values by day of year."""
    kept = obs if years is None else obs.where(F.year("valid_date").between(*years))
    return kept.groupBy(doy_index(F.col("valid_date")).alias("doy"), *keys).agg(F.avg("value").alias("clim"), F.count("value").alias("n"))


def trend_climatology(obs: DataFrame, keys: list[str]) -> DataFrame:
    """ybar, slope and xbar of the line over years for each day of year; the slope is NULL where the years do not vary."""
    x, y = F.year("valid_date").cast("double"), F.col("value")
    sums = obs.where("value is not null").groupBy(doy_index(F.col("valid_date")).alias("doy"), *keys).agg(F.avg(y).alias("ybar"), F.avg(x).alias("xbar"), F.avg(x * y).alias("_xy"), F.avg(x * x).alias("_xx"))
    var = F.col("_xx") - F.col("xbar") * F.col("xbar")
    return sums.select("doy", *keys, "ybar", F.when(var > 1e-9, F.try_divide(F.col("_xy") - F.col("xbar") * F.col("ybar"), var)).alias("slope"), "xbar")


def anomalies(df: DataFrame, clim: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``columns`` minus the climatology of the valid day; co-partitioned by cell and day, not broadcast."""
    joined = df.withColumn("doy", doy_index(F.col("valid_date"))).join(clim.select("doy", *keys, "clim"), ["doy", *keys])
    return joined.withColumns({c: F.col(c) - F.col("clim") for c in columns})


def leave_one_year_out(pairs: DataFrame, keys: list[str], f: str = "fa", o: str = "oa", year: str = "year") -> DataFrame:
    """The mean of f - o over all years but each one: (total - own) / (count - own count). NULL where there is one year only."""
    per = pairs.groupBy(year, *keys).agg(F.coalesce(F.sum(F.col(f) - F.col(o)), F.lit(0.0)).alias("_s"), F.count(F.col(f) - F.col(o)).alias("_c"))
    w = Window.partitionBy(*keys)
    return per.select(year, *keys, F.try_divide(F.sum("_s").over(w) - F.col("_s"), F.sum("_c").over(w) - F.col("_c")).alias("bias"))


def remove_bias(pairs: DataFrame, keys: list[str], f: str = "fa", o: str = "oa", year: str = "year", fill: bool = False) -> DataFrame:
    """f minus its leave-one-year-out bias; with ``fill`` an undefined bias counts as 0."""
    bias = leave_one_year_out(pairs, keys, f, o, year)
    own = F.coalesce("bias", F.lit(0.0)) if fill else F.col("bias")
    return pairs.join(bias, [year, *keys], "left").withColumn(f, F.col(f) - own).drop("bias")


def correct_fields(fc: DataFrame, cases: DataFrame, keys: list[str]) -> DataFrame:
    """Every member's value minus its cell's leave-one-year-out bias, that of ensemble means; NULL where no other year has truth.

    ``cases`` (init_date, keys, mean, obs) must have every case of ``fc``, those without truth too.
    """
    bias = leave_one_year_out(cases.withColumn("year", F.year("init_date")), keys, "mean", "obs")
    joined = fc.withColumn("year", F.year("init_date")).join(bias, ["year", *keys], "left")
    return joined.withColumn("value", F.col("value") - F.col("bias")).drop("bias", "year")


def remove_group_mean(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Each column minus its group's mean."""
    w = Window.partitionBy(*by)
    return df.withColumns({c: F.col(c) - F.avg(c).over(w) for c in columns})


def high_pass(df: DataFrame, keys: list[str], day: str, width: int = 120, value: str = "value", segment: int | None = None) -> DataFrame:
    """value minus the mean of the last ``width`` rows, its own included; rows with fewer before them go. With ``segment`` a key's series is spread over tasks in segments of that many rows."""
    means = {"_n": F.count(value), "_m": F.avg(value)}
    if segment is None:
        w = Window.partitionBy(*keys).orderBy(day).rowsBetween(1 - width, 0)
        passed = df.withColumns({name: c.over(w) for name, c in means.items()})
    else:
        passed = rolling(df, keys, [day], width - 1, 0, means, segment)
    passed = passed.where(F.col("_n") == width)
    return passed.withColumn(value, F.col(value) - F.col("_m")).drop("_n", "_m")


def season_running_mean(df: DataFrame, day: str, months: list[int], width: int = 7, value: str = "value", keys: list[str] | None = None, segment: int | None = None) -> DataFrame:
    """Means of ``width`` rows from each on, where all lie in the season. With ``segment`` and columns as ``keys`` a key's series is spread over tasks."""
    means = {"_n": F.count(value), "_in": F.min(F.month(day).isin(months).cast("int")), "running": F.avg(value)}
    if segment is None:
        w = Window.partitionBy(*(keys or [F.year(day)])).orderBy(day).rowsBetween(0, width - 1)
        found = df.withColumns({name: c.over(w) for name, c in means.items()})
    else:
        found = rolling(df, keys or [], [day], 0, width - 1, means, segment)
    return found.where(F.col("_n") == width).where("_in = 1").drop("_n", "_in")


def meridional_mean(df: DataFrame, south: float, north: float, keys: list[str]) -> DataFrame:
    """Unweighted mean over a latitude band."""
    return df.where(F.col("lat").between(south, north)).groupBy(*keys).agg(F.avg("value").alias("value"))


def fill_by_proxy(x: DataFrame, proxy: DataFrame, keys: list[str], time: str) -> DataFrame:
    """x, and after its last time the proxy times mean(x y) / max(var(y), 1e-30) over their common times."""
    both = x.join(proxy.withColumnRenamed("value", "_y"), [*keys, time])
    scale = both.groupBy(*keys).agg((F.avg(F.col("value") * F.col("_y")) / F.greatest(F.var_pop("_y"), F.lit(1e-30))).alias("_scale"))
    last = x.groupBy(*keys).agg(F.max(time).alias("_last"))
    tail = proxy.join(scale, keys).join(last, keys).where(F.col(time) > F.col("_last")).select(*keys, time, (F.col("value") * F.col("_scale")).alias("value"))
    return x.select(*keys, time, "value").unionByName(tail)


def year_bias(df: DataFrame, by: list[str], f: str = "fa", o: str = "oa") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.col(f) - F.col(o)).alias("bias"), F.count(F.lit(1)).alias("n"))


def agreeing_mean(df: DataFrame, key: str, value: str, most: float = 1e-3, fail: bool = False) -> DataFrame:
    """The mean of sources by key; where they differ by more than ``most`` it is NULL, or the job fails."""
    gap = F.max(value) - F.min(value)
    odd = F.raise_error(F.lit("sources differ")).cast("double") if fail else F.lit(None).cast("double")
    return df.groupBy(key).agg(F.when(gap <= most, F.avg(value)).otherwise(odd).alias(value), gap.alias("gap"))
