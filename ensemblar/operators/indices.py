"""Climate indices: patterns, projections, phases and reliability by state."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import winter_year
from ..shared import cut
from . import packed
from .climate import season_running_mean


def gram(anomalies: DataFrame, time: str, cell: list[str], value: str = "value", most_times: int = 4096) -> DataFrame:
    """(t, s, g): sums over cells of products of two times, t <= s. As many rows as pairs of times, ``most_times`` squared numbers in a task at most."""
    times = packed.numbered(anomalies, time, most_times)
    g = packed.gram_matrix(packed.pack(anomalies, cell, time, times, value), len(times))
    kind = anomalies.schema[time].dataType.simpleString()
    rows = [(times[i], times[j], float(g[i, j])) for i in range(len(times)) for j in range(i, len(times))]
    return anomalies.sparkSession.createDataFrame(rows, f"t {kind}, s {kind}, g double")


def snapshot_eof(anomalies: DataFrame, time: str, cell: list[str], value: str = "value", modes: int = 1, most_gram: int = 400) -> tuple[DataFrame, list[float]]:
    """(mode, cell, loading) of the leading patterns and their shares of variance; a pattern has length one.

    Each cell's series is packed in one row, and no cell meets another. Up to ``most_gram`` times their Gram matrix is decomposed; beyond,
    a few vectors over times are iterated, each round one pass over the packed rows. Only what has
    the length of the times reaches the driver: loadings are made and stay in Spark. Signs are arbitrary: see align_sign.
    """
    times = packed.numbered(anomalies, time)
    series = cut(packed.pack(anomalies, cell, time, times, value))
    modes = min(modes, len(times))
    if len(times) <= most_gram:
        values, vectors = np.linalg.eigh(packed.gram_matrix(series, len(times)))
        total, values, vectors = values.sum(), values[::-1][:modes], vectors[:, ::-1][:, :modes]
    else:
        values, vectors, total = packed.leading_columns(series, len(times), modes)
    loadings = packed.times_columns(series, cell, vectors / np.sqrt(values))
    return loadings.select("mode", *cell, "loading"), [float(v / total) for v in values]


def combined_eof(df: DataFrame, time: str, feature: str, value: str = "value", k: int = 2) -> tuple[DataFrame, list[float]]:
    """(feature, pc1..pck) of several fields side by side, one feature a field and longitude, and the shares of variance.

    The patterns of ``snapshot_eof`` over the features' anomalies. Times that lack a feature go. Signs are arbitrary: see align_sign.
    """
    given = df.where(F.col(value).isNotNull())
    features = given.select(feature).distinct().count()
    whole = given.groupBy(time).agg(F.count_distinct(feature).alias("_n")).where(F.col("_n") == features).select(time)
    kept = given.join(whole, time)
    means = kept.groupBy(feature).agg(F.avg(value).alias("_m"))
    centred = kept.join(means, feature).select(time, feature, (F.col(value) - F.col("_m")).alias(value))
    loadings, shares = snapshot_eof(centred, time, [feature], value, k)
    pcs = [F.max(F.when(F.col("mode") == m + 1, F.col("loading"))).alias(f"pc{m + 1}") for m in range(k)]
    return loadings.groupBy(feature).agg(*pcs), shares


def project(df: DataFrame, eof: DataFrame, cell: list[str], keys: list[str], value: str = "value") -> DataFrame:
    """sum(value * wgt * loading) over the pattern's cells."""
    return df.join(eof.select(*cell, "wgt", "loading"), cell).groupBy(*keys).agg(F.sum(F.col(value) * F.col("wgt") * F.col("loading")).alias("pc"))


def normalised(df: DataFrame, day: str, months: list[int], value: str = "value", width: int = 7) -> DataFrame:
    """The season's rows with daily_index and weekly_index: the value, and the mean of ``width`` rows from it on that all lie in the season, each over its deviation.

    A season that goes over the year's end must end by November, as rows are held by winters.
    """
    winter = winter_year(F.col(day))
    running = season_running_mean(df, day, months, width, value, [winter]).select(day, "running")
    inside = df.where(F.month(day).isin(months)).join(running, day, "left")
    sd = inside.agg(F.stddev_pop(value).alias("_d"), F.stddev_pop("running").alias("_w"))  # one row
    return inside.join(F.broadcast(sd), F.lit(True)).withColumns({"daily_index": F.try_divide(value, "_d"), "weekly_index": F.try_divide("running", "_w")}).drop("_d", "_w", "running")


def align_sign(df: DataFrame, keys: list[str], a: str, ref: str, flip: list[str]) -> DataFrame:
    """``flip`` columns times -1 where the product sum of ``a`` and ``ref`` over a key is negative."""
    s = F.sum(F.col(a) * F.col(ref)).over(Window.partitionBy(*keys))
    return df.withColumns({c: F.when(s < 0, -F.col(c)).otherwise(F.col(c)) for c in flip})


def pattern_units(eof: DataFrame, sd: float, gravity: float = 9.80665) -> DataFrame:
    """The pattern in geopotential metres for one standard deviation of its index."""
    return eof.withColumn("gpm", F.col("loading") / F.col("wgt") * sd / gravity)


def trajectory(rmm: DataFrame, obs: DataFrame) -> DataFrame:
    """Ensemble mean and observed index by init and lead."""
    mean = rmm.groupBy("model", "init_date", "lead_day").agg(F.avg("rmm1").alias("f1"), F.avg("rmm2").alias("f2"))
    return mean.withColumn("valid_date", F.date_add("init_date", F.col("lead_day"))).join(obs, "valid_date")


def init_state(df: DataFrame, state: DataFrame) -> DataFrame:
    """The index of the init day on every row."""
    return df.join(state.withColumnRenamed("valid_date", "init_date"), "init_date", "left")


def with_persistence(pairs: DataFrame, state: DataFrame, name: str = "persistence") -> DataFrame:
    """Pairs of ``trajectory`` with those of a model that keeps the init day's state, on the inits of the model that has the most (of equals the first by name)."""
    most = pairs.groupBy("model").agg(F.count_distinct("init_date").alias("_n")).orderBy(F.desc("_n"), "model").limit(1).select("model")
    start = state.select(F.col("valid_date").alias("init_date"), F.col("o1").alias("f1"), F.col("o2").alias("f2"))
    kept = pairs.join(F.broadcast(most), "model").drop("f1", "f2").join(start, "init_date").withColumn("model", F.lit(name))
    return pairs.unionByName(kept)


def lead_window(df: DataFrame, width: int, lead: str = "lead_day") -> DataFrame:
    """Each row at every lead within ``width`` of its own, for pooling."""
    return df.withColumn(lead, F.explode(F.sequence(F.col(lead) - width, F.col(lead) + width)))
