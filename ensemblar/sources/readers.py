"""Scans into the canonical forecast and analysis schemas, and a registry of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import nan_to_null
from .forecast_files import register

LOADERS: dict[str, Callable[..., DataFrame]] = {}


def loader(name: str):
    """Registers a function (spark, path, ...) -> DataFrame under a format's name."""

    def add(f):
        LOADERS[name] = f
        return f

    return add


def load_forecast(kind: str, spark: SparkSession, *args, **options) -> DataFrame:
    """A format's rows, NaN as NULL."""
    if kind not in LOADERS:
        raise ValueError(f"unknown format {kind!r}; there are {sorted(LOADERS)}")
    return nan_to_null(LOADERS[kind](spark, *args, **options))


def renumber_seeds(df: DataFrame, case: list[str]) -> DataFrame:
    """Members of seed files as 0..n-1 in each init, by (seed, member), so that ids that differ do not split an ensemble."""
    return df.withColumn("number", F.dense_rank().over(Window.partitionBy(*case).orderBy("seed", "member")) - 1)


@loader("seed_dirs")
def seed_directories(spark: SparkSession, path: str, most_members: int | None = None) -> DataFrame:
    """init_date=/seed= folders of rows with member; renumbered, and capped in all."""
    df = renumber_seeds(spark.read.parquet(path), ["init_date"])
    return df if most_members is None else df.where(F.col("number") < most_members)


@loader("flat_files")
def flat_files(spark: SparkSession, path: str) -> DataFrame:
    """One file a member, named ..._YYYYMMDDHH_ens_M.parquet."""
    df = spark.read.parquet(path).withColumn("_name", F.col("_metadata.file_name"))
    init = F.try_to_timestamp(F.regexp_extract("_name", r"_(\d{10})_ens_(\d+)", 1), F.lit("yyyyMMddHH"))
    return df.withColumns({"init_time": init, "number": F.regexp_extract("_name", r"_(\d{10})_ens_(\d+)", 2).cast("int")}).drop("_name")


@loader("nested")
def nested(spark: SparkSession, path: str) -> DataFrame:
    """init_date=/number=/lead_day= folders, one file a lead; leads are days."""
    return spark.read.parquet(path)


def _by_folder(spark: SparkSession, paths: dict[int, str], name: str) -> DataFrame:
    """The files of several folders as one scan, with the number that each folder stands for."""
    plain = lambda c: F.regexp_replace(c, r"^\w+:/+", "/")
    pairs = [x for number, path in paths.items() for x in (plain(F.lit(path.rstrip("/"))), F.lit(number))]
    df = spark.read.option("mergeSchema", True).parquet(*paths.values())
    folder = F.regexp_extract(plain(F.col("_metadata.file_path")), r"^(.*)/[^/]+$", 1)
    return df.withColumn(name, F.element_at(F.create_map(*pairs), folder))


@loader("stations")
def stations(spark: SparkSession, paths: dict[int, str]) -> DataFrame:
    """Rain by year in one scan; columns are brought to one set of names, whichever a year has."""
    df = _by_folder(spark, paths, "year")
    for name, others in {"lat": ["latitude"], "lon": ["longitude"], "valid_date": ["TIME", "time"]}.items():
        have = [c for c in (name, *others) if c in df.columns]
        df = df.withColumn("_x", F.coalesce(*have)).drop(*have).withColumnRenamed("_x", name) if have else df
    return df


@loader("member_files")
def member_files(spark: SparkSession, paths: dict[int, str], keys: list[str], time: str) -> DataFrame:
    """One path a member brought together as a cube in one scan: number, and day 0..n-1 by time within each key and member."""
    df = _by_folder(spark, paths, "number")
    return df.withColumn("day", F.row_number().over(Window.partitionBy(*keys, "number").orderBy(time)) - 1)


@loader("forecast_files")
def forecast_files(spark: SparkSession, path: str, layout: str, most_members: int | None = None, **options: str) -> DataFrame:
    """Files by what their names say, as the data source lists them; ``most_members`` is a filter on the list where names have the member."""
    register(spark)
    df = spark.read.format("forecast_files").options(layout=layout, **options).load(path)
    return df if most_members is None else df.where(F.col("number") < most_members)


@loader("months")
def by_months(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Rows of year=/month= folders whose month lies in a range that may go over the year's end."""
    return month_range(spark.read.parquet(path), F.col("month"), first, last)


def month_range(df: DataFrame, month, first: int, last: int) -> DataFrame:
    months = [m for m in range(1, 13) if (first <= m <= last if first <= last else m >= first or m <= last)]
    return df.where(month.isin(months))


def stacked_levels(df: DataFrame, variable: str, levels: list[float], keys: list[str]) -> DataFrame:
    """Columns of one level each as rows with level."""
    return df.unpivot(keys, [f"{variable}_{v:g}" for v in levels], "_name", "value").select(*keys, F.regexp_extract("_name", r"_([0-9.]+)$", 1).cast("double").alias("level"), "value")


def sound_axis(df: DataFrame, offset: str = "lead_day", most: int = 399) -> DataFrame:
    """Rows whose time offset is in range."""
    return df.where(F.col(offset).between(0, most))


def fan_out(df: DataFrame, years: str = "hindcast_years", base: str = "base_date") -> DataFrame:
    """A row for each hindcast year, with its own init date; 29 February without one in that year goes."""
    out = df.withColumn("_y", F.explode(years))
    return out.withColumn("init_date", F.try_make_timestamp(F.col("_y"), F.month(base), F.dayofmonth(base), F.lit(0), F.lit(0), F.lit(0)).cast("date")).where("init_date is not null").drop("_y", years)


def with_control(control: DataFrame, perturbed: DataFrame, most: int) -> DataFrame:
    """Control as member 0, perturbed members after it, ``most`` in all."""
    order = Window.partitionBy("init_date").orderBy("number")
    rest = perturbed.withColumn("number", F.dense_rank().over(order))
    return control.withColumn("number", F.lit(0)).unionByName(rest).where(F.col("number") < most)


def analysis_years(analysis: DataFrame, years: list[int], time: str = "valid_date") -> DataFrame:
    """The years asked for and the one after them, which December's leads reach."""
    return analysis.where(F.year(time).isin([*years, max(years) + 1]))


def climatological_ensemble(inits: DataFrame, leads: int, obs: DataFrame) -> DataFrame:
    """Past years as members: the value of each year at the valid day of year, 366 as 365."""
    day = lambda c: F.least(F.dayofyear(c), F.lit(365))
    calendar = inits.select("init_date", F.explode(F.sequence(F.lit(1), F.lit(leads))).alias("lead_day"))
    calendar = calendar.withColumn("_d", day(F.date_add("init_date", F.col("lead_day"))))
    years = obs.groupBy(F.year("valid_date").alias("number"), day(F.col("valid_date")).alias("_d"), "cell").agg(F.avg("value").alias("value"))
    return calendar.join(years, "_d").drop("_d")


def init_calendar(spark: SparkSession, template: int, target: int, months: list[int], weekdays: list[int]) -> DataFrame:
    """Init dates of a target year: month-days that in the template year fall on ``weekdays`` (Monday is 0)."""
    days = spark.range(1).select(F.explode(F.expr(f"sequence(date'{template}-01-01', date'{template}-12-31')")).alias("d"))
    picked = days.where(F.month("d").isin(months) & F.weekday("d").isin(weekdays))
    made = F.try_make_timestamp(F.lit(target), F.month("d"), F.dayofmonth("d"), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    return picked.select(made.alias("init_date")).where("init_date is not null")


def missing_only(inputs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs without an output yet."""
    return inputs.join(done.select(*keys).distinct(), keys, "left_anti")


def by_priority(df: DataFrame, keys: list[str], priority: str) -> DataFrame:
    """Rows of the source that comes first for each key."""
    least = df.groupBy(*keys).agg(F.min(priority).alias("_p"))
    return df.join(least, keys).where(F.col(priority) == F.col("_p")).drop("_p")


def complete_runs(df: DataFrame, members: int, run: str = "run", key: str = "init_date") -> DataFrame:
    """Members 0..members-1 of one run for each init: the newest that has all; runs are never mixed."""
    whole = df.where(F.col("number") < members).groupBy(run, key).agg(F.count_distinct("number").alias("_n")).where(F.col("_n") == members)
    best = whole.groupBy(key).agg(F.max(run).alias(run))
    return df.where(F.col("number") < members).join(best, [run, key], "left_semi")
