"""Monsoon onset from rain, observed and forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .align import rolling_sum


def observed_onset(rain: DataFrame, keys: list[str], start: str = "06-02", threshold: str = "threshold", wet: float = 1.0) -> DataFrame:
    """The first day after ``start`` (month-day) with more than ``wet`` rain whose five-day sum from then on exceeds the cell's threshold. ``rain`` has year, valid_date and the threshold."""
    rolled = rolling_sum(rain, ["year", *keys], "valid_date", 5, "rain", ahead=True)
    after = F.col("valid_date") > F.to_date(F.concat_ws("-", "year", F.lit(start)))
    hit = after & (F.col("rain") > wet) & (F.col("rolled") > F.col(threshold))
    return rolled.groupBy("year", *keys).agg(F.min(F.when(hit, F.col("valid_date"))).alias("onset"))


def member_onset(rain: DataFrame, keys: list[str], threshold: str = "threshold", wet: float = 1.0, last_day: int = 15, start: str | None = "06-02") -> DataFrame:
    """Each member's first day 1..last_day that qualifies (missing rain counts as none), NULL if there is none; with ``start`` only from that date on."""
    rolled = rolling_sum(rain, ["init_date", "number", *keys], "lead_day", 5, "rain", strict=False, ahead=True)
    day = F.date_add("init_date", F.col("lead_day"))
    hit = F.col("lead_day").between(1, last_day) & (F.coalesce("rain", F.lit(0.0)) > wet) & (F.col("rolled") > F.col(threshold))
    if start is not None:
        hit &= day >= F.to_date(F.concat_ws("-", F.year(day), F.lit(start)))
    return rolled.groupBy("init_date", "number", *keys).agg(F.min(F.when(hit, F.col("lead_day"))).alias("onset_day"))


def before_onset(members: DataFrame, onset: DataFrame, keys: list[str]) -> DataFrame:
    """Forecasts started before the cell's observed onset of that year; cells without onset go."""
    seen = onset.where("onset is not null")
    return members.withColumn("year", F.year("init_date")).join(seen, ["year", *keys]).where(F.col("init_date") < F.col("onset"))


def onset_probability(members: DataFrame, keys: list[str], bins: list[tuple[int, int]]) -> DataFrame:
    """For each bin of days the share of members with onset in it, p, and whether it was observed there, o."""
    spread = members.withColumn("b", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(z).alias("z")) for a, z in bins))))
    inside = F.coalesce(F.col("onset_day").between(F.col("b.a"), F.col("b.z")), F.lit(False))
    seen = F.datediff("onset", "init_date").between(F.col("b.a"), F.col("b.z"))
    label = F.concat_ws("-", "b.a", "b.z").alias("bin_days")
    return spread.groupBy("year", "init_date", *keys, label).agg(F.avg(inside.cast("double")).alias("p"), F.max(seen.cast("int")).alias("o"))


def onset_statistics(pairs: DataFrame) -> DataFrame:
    """Numbers, base rates and mean probabilities by year, by bin and in all, in one pass."""
    sets = pairs.groupingSets([["year"], ["bin_days"], []], "year", "bin_days")
    return sets.agg(F.count(F.lit(1)).alias("n"), F.avg("o").alias("base"), F.avg("p").alias("p_mean"))
