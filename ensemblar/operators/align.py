"""Alignment of forecasts with truth: projections, filters, joins and re-labelling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import valid_date, week_of
from .segments import carried


def ensemble_cases(fc: DataFrame, obs: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """One row a case: sorted members xs, their number n (n_all with missing ones), mean, and the truth at init + lead on the same cell.

    Members are packed before the join, so that the join moves a row a case. With
    ``how="left"`` cases without truth stay, with a NULL obs.
    """
    packed = fc.groupBy(*keys).agg(F.array_sort(F.collect_list("value")).alias("xs"), F.count("value").alias("n"), F.count(F.lit(1)).alias("n_all"), F.avg("value").alias("mean"))
    truth = obs.select("valid_date", "cell", F.col("value").alias("obs"))
    return packed.withColumn("valid_date", valid_date(F.col("init_date"), F.col("lead_day"))).join(truth, ["valid_date", "cell"], how).drop("valid_date")


def select_level(df: DataFrame, level: float) -> DataFrame:
    return df.where(F.col("level") == level)


def scale_units(df: DataFrame, config: DataFrame, scale_col: str, keys: list[str], most_rows: int = 10_000) -> DataFrame:
    """value times the configured scale. The configuration is refused above ``most_rows``, so that it can be broadcast."""
    if config.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"the variable map has more than {most_rows} rows")
    scales = F.broadcast(config.select(*keys, F.col(scale_col).alias("_scale")))
    return df.join(scales, keys).withColumn("value", F.col("value") * F.col("_scale")).drop("_scale")


def renumber_members(df: DataFrame, case: list[str], order: list[str], name: str = "number") -> DataFrame:
    """Members 0..n-1 within each case, whatever their ids were."""
    return df.withColumn(name, F.dense_rank().over(Window.partitionBy(*case).orderBy(*order)) - 1)


def cap_members(df: DataFrame, most: int) -> DataFrame:
    """The first ``most`` members in all, after renumbering."""
    return df.where(F.col("number") < most)


def first_inits(df: DataFrame, most: int, by: list[str], day: str = "init_date") -> DataFrame:
    """Rows of each group's first ``most`` inits; only the distinct inits are ranked."""
    inits = df.select(*by, day).distinct().withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(day)))
    return df.join(inits.where(F.col("_k") <= most).drop("_k"), [*by, day], "left_semi")


def least_members(df: DataFrame, case: list[str], least: int) -> DataFrame:
    """Rows of cases with at least ``least`` members."""
    enough = df.groupBy(*case).agg(F.count_distinct("number").alias("_n")).where(F.col("_n") >= least).select(*case)
    return df.join(enough, case, "left_semi")


def in_season(df: DataFrame, day: str, years: tuple[int, int] | None = None, months: list[int] | None = None, weekdays: list[int] | None = None) -> DataFrame:
    """Rows by year range, months and weekdays (Monday is 0)."""
    keep = F.lit(True)
    if years:
        keep &= F.year(day).between(*years)
    if months:
        keep &= F.month(day).isin(months)
    if weekdays:
        keep &= F.weekday(day).isin(weekdays)
    return df.where(keep)


def listed(df: DataFrame, dates: DataFrame, key: str = "init_date") -> tuple[DataFrame, DataFrame]:
    """Rows whose date is listed, and the listed dates that have no row."""
    return df.join(dates, key, "left_semi"), dates.join(df.select(key).distinct(), key, "left_anti")


def daily_steps(df: DataFrame, step: str = "lead_h", most: int | None = None) -> DataFrame:
    """Whole days only, without step 0."""
    keep = (F.col(step) % 24 == 0) & (F.col(step) > 0)
    return df.where(keep if most is None else keep & (F.col(step) <= 24 * most))


def box(df: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    """Rows of a box; west above east means that it crosses longitude 0."""
    lon = F.col("lon").between(west, east) if west <= east else (F.col("lon") >= west) | (F.col("lon") <= east)
    return df.where(F.col("lat").between(south, north) & lon)


def complete_groups(df: DataFrame, by: str, parts: list[str], needed: int) -> DataFrame:
    """The values of ``by`` for which every combination of ``parts`` is there (relational division)."""
    return df.groupBy(by).agg(F.count_distinct(*parts).alias("_n")).where(F.col("_n") == needed).select(by)


def first_of(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row a key, the first in order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def blend(a: Column, b: Column, wa: float, wb: float) -> Column:
    """Weighted mean of two layers, NULL if one is missing."""
    return (wa * a + wb * b) / (wa + wb)


def log_pressure(inner: Column, outer: Column, p_inner: float, p_outer: float, p: float) -> Column:
    """A level's value from two others, linear in the logarithm of pressure; outside them it extrapolates."""
    return inner + math.log(p_inner / p) / math.log(p_outer / p_inner) * (inner - outer)


def nearest_time(left: DataFrame, right: DataFrame, keys: list[str], time: str, tolerance_s: int | None = None, segment: int | None = None) -> DataFrame:
    """For each left row the right value at the nearest time; of two as near, the earlier.

    The rows of both sides stand in one window; the last right row at or before and
    the first at or after are the only candidates. One shuffle by ``keys``, no
    product. With ``segment`` a key's rows are spread over tasks in segments of that many rows, and
    candidates are carried from one to the next.
    """
    both = left.select(*keys, F.col(time).alias("_t"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.schema["value"].dataType).alias("_v"), F.lit(1).alias("_s"))
    other = right.where("value is not null").select(*keys, F.col(time).alias("_t"), F.lit(None).cast(both.schema["_l"].dataType).alias("_l"), F.col("value").alias("_v"), F.lit(0).alias("_s"))
    hit = F.when(F.col("_s") == 0, F.struct("_t", "_v"))
    if segment is None:
        back = Window.partitionBy(*keys).orderBy("_t", "_s")
        ahead = Window.partitionBy(*keys).orderBy(F.desc("_t"), "_s")
        found = both.unionByName(other).withColumns({"_b": F.last(hit, True).over(back), "_a": F.last(hit, True).over(ahead)}).where("_s = 1")
    else:
        # a right row at a left row's own time is the one before it, and so the earlier of two as near
        found = carried(both.unionByName(other), keys, ["_t", "_s"], hit, segment).withColumnsRenamed({"_last": "_b", "_next": "_a"}).where("_s = 1")
    since, until = (F.col("_t").cast("double") - F.col("_b._t").cast("double"), F.col("_a._t").cast("double") - F.col("_t").cast("double"))
    pick = F.when(until.isNull() | (since <= until), F.col("_b")).otherwise(F.col("_a"))
    gap = F.least(since, until)
    ok = F.lit(True) if tolerance_s is None else gap <= tolerance_s
    return found.select("_l.*", F.when(ok, pick["_t"]).alias("matched_time"), F.when(ok, pick["_v"]).alias("matched"))


def truth_by_rule(fc: DataFrame, truth: DataFrame, rules: DataFrame) -> DataFrame:
    """Joins the truth of each model's convention, ``offset_days`` later than init + lead. ``rules`` has a row a model and variable."""
    ruled = fc.join(rules, "model")
    return ruled.withColumn("valid_date", F.date_add("init_date", F.col("lead_day") + F.col("offset_days"))).join(truth, ["convention", "valid_date", "cell"])


def common_dates(dates: DataFrame, by: str = "model", key: str = "init_date", models: int = 2) -> DataFrame:
    """Dates that all ``models`` have."""
    return dates.groupBy(key).agg(F.count_distinct(by).alias("_n")).where(F.col("_n") == models).select(key)


def nearest_init(ref: DataFrame, other: DataFrame, tolerance: int) -> DataFrame:
    """(ref_date, other_date, offset): for each reference date the nearest other within ``tolerance`` days; of two as near, the earlier.

    Each reference date is spread over its few candidate dates, so that the range join is an equi-join.
    """
    spread = ref.select(F.col("init_date").alias("ref_date"), F.explode(F.sequence(F.lit(-tolerance), F.lit(tolerance))).alias("offset"))
    near = spread.withColumn("other_date", F.date_add("ref_date", F.col("offset"))).join(other.select(F.col("init_date").alias("other_date")).distinct(), "other_date")
    return first_of(near, ["ref_date"], [F.abs("offset"), F.col("other_date")]).select("ref_date", "other_date", "offset")


def pair_inits(ref: DataFrame, other: DataFrame, most_days: int, cut=lambda df: df) -> DataFrame:
    """One-to-one pairs (ref_date, other_date, offset), offsets tried in the order 0, 1, -1, 2, -2, ...

    Within one offset the shift is one to one, so that a pass is an equi-join of the dates still
    free. ``cut`` may cut the lineage of each pass.
    """
    left = ref.select(F.col("init_date").alias("ref_date")).distinct()
    right = other.select(F.col("init_date").alias("other_date")).distinct()
    done = None
    for offset in [0, *(s * k for k in range(1, most_days + 1) for s in (1, -1))]:
        free_l = left if done is None else left.join(done, "ref_date", "left_anti")
        free_r = right if done is None else right.join(done, "other_date", "left_anti")
        met = free_l.withColumn("other_date", F.date_add("ref_date", offset)).join(free_r, "other_date").select("ref_date", "other_date", F.lit(offset).alias("offset"))
        done = cut(met if done is None else done.unionByName(met))
    return done


def relabel(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """init_date by its real date where ``mapping`` (label_date, real_date) has one."""
    return df.join(mapping, F.col("init_date") == F.col("label_date"), "left").withColumn("real_init", F.coalesce("real_date", "init_date")).drop("label_date", "real_date")


def same_month(df: DataFrame, dates: DataFrame) -> DataFrame:
    """Rows whose init month occurs among ``dates``."""
    months = dates.select(F.date_format("init_date", "yyyyMM").alias("_m")).distinct()
    return df.withColumn("_m", F.date_format("init_date", "yyyyMM")).join(months, "_m", "left_semi").drop("_m")


def shared_support(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of two fields on the steps and members that both have."""
    return a.join(b, keys)


def fill_from(primary: DataFrame, fallback: DataFrame, key: str, value: str) -> DataFrame:
    """The primary value, else the fallback's."""
    return primary.join(fallback.withColumnRenamed(value, "_f"), key, "full_outer").select(key, F.coalesce(value, "_f").alias(value))


def deaccumulate(df: DataFrame, keys: list[str], step: str, value: str = "value") -> DataFrame:
    """Differences from step to step; the first step goes."""
    w = Window.partitionBy(*keys).orderBy(step)
    return df.withColumns({value: F.col(value) - F.lag(value).over(w), "_k": F.row_number().over(w)}).where("_k > 1").drop("_k")


def rolling_sum(df: DataFrame, keys: list[str], step: str, width: int, value: str = "value", strict: bool = True, ahead: bool = False) -> DataFrame:
    """Sum over ``width`` rows, ending at the row or (``ahead``) starting there. Strict: NULL unless all are there; else missing counts as 0."""
    w = Window.partitionBy(*keys).orderBy(step).rowsBetween(*((0, width - 1) if ahead else (1 - width, 0)))
    if strict:
        return df.withColumn("rolled", F.when(F.count(value).over(w) == width, F.sum(value).over(w)))
    return df.withColumn("rolled", F.when(F.count(F.lit(1)).over(w) == width, F.sum(F.coalesce(value, F.lit(0.0))).over(w)))


def daily_mean(df: DataFrame, keys: list[str], time: str = "valid_time", strict: int | None = None) -> DataFrame:
    """Means by date; with ``strict`` only days with that many values."""
    means = df.groupBy(*keys, F.to_date(time).alias("valid_date")).agg(F.avg("value").alias("value"), F.count("value").alias("n"))
    return means if strict is None else means.where(F.col("n") == strict)


def block_mean(df: DataFrame, keys: list[str], lead_h: str, hours: int = 24, step: int = 6) -> DataFrame:
    """Means of lead steps by blocks that end at multiples of ``hours``."""
    block = F.floor((F.col(lead_h) - step) / hours).cast("int")
    return df.groupBy(*keys, block.alias("block")).agg(F.avg("value").alias("value"), F.count("value").alias("n"))


def weekly_means(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Weeks 1..6 of lead days 7k-6..7k (NULL if a row is NULL), and week3-4 and week5-6, the means of two weeks."""
    strict = F.when(F.count(value) == F.count(F.lit(1)), F.avg(value))
    weeks = df.withColumn("_w", week_of(F.col("lead_day"))).where("_w between 1 and 6").groupBy(*keys, "_w").agg(strict.alias(value))
    single = weeks.select(*keys, F.concat(F.lit("week"), F.col("_w")).alias("week"), value)
    pair = F.when(F.col("_w").isin(3, 4), "week3-4").when(F.col("_w").isin(5, 6), "week5-6")
    double = weeks.withColumn("week", pair).where("week is not null").groupBy(*keys, "week").agg(F.when(F.count(value) == 2, F.avg(value)).alias(value))
    return single.unionByName(double)


def pad_leads(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Every key with leads 1..most; absent leads are NULL."""
    frame = df.select(*keys).distinct().withColumn("lead_day", F.explode(F.sequence(F.lit(1), F.lit(most))))
    return frame.join(df, [*keys, "lead_day"], "left")


def gaps(days: DataFrame, day: str = "valid_date", keys: list[str] | None = None) -> DataFrame:
    """The first missing date of each gap in each key's daily series: days after a date that are not there themselves. No ordering of a whole series is needed."""
    keys = keys or []
    missing = days.select(*keys, F.date_add(day, 1).alias(day)).distinct().join(days.select(*keys, day).distinct(), [*keys, day], "left_anti")
    last = days.groupBy(*keys).agg(F.max(day).alias("_last"))
    missing = missing.join(last, keys) if keys else missing.join(F.broadcast(last), F.lit(True))
    return missing.where(F.col(day) <= F.col("_last")).select(*keys, F.col(day).alias("gap_start"))
