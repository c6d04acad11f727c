"""Queries that write files into the shared folder and read them through loaders, and streams over such files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import mjo_phase
from ..operators import indices
from ..sources import readers
from ..sources.sinks import write_table
from ..streaming import accumulate
from .registry import Tables, query, rounded, uniform_sql
from ..shared import shared_path


@query("s1_seed_folders", "with m as (select date_trunc('month', init_date)::date as init_date, number // 3 as seed, (number % 3) * 10 as member, avg(value) as value from fc group by 1, 2, 3), r as (select *, row_number() over (partition by init_date order by seed, member) - 1 as number from m) select init_date, number::int as number, round(value, 4) as value from r where number < 5")
def seed_folders(t: Tables) -> DataFrame:
    """A folder for each init and seed, read by its loader: members renumbered from 0, five at most."""
    path = shared_path(t.spark, "seeds")
    month = F.trunc("init_date", "month").alias("init_date")
    rows = t.fc.groupBy(month, F.floor(F.col("number") / 3).cast("int").alias("seed"), (F.col("number") % 3 * 10).alias("member")).agg(F.avg("value").alias("value"))
    rows.repartition("init_date").write.partitionBy("init_date", "seed").parquet(path)
    read = readers.load_forecast("seed_dirs", t.spark, path, most_members=5)
    return rounded(read.select("init_date", F.col("number").cast("int").alias("number"), "value"))


@query("d3_pruned_scan", "with m as (select date_trunc('month', init_date)::date as init_date, number // 3 as seed, avg(value) as value from fc group by 1, 2) select init_date, seed::int as seed, round(value, 4) as value, (select count(distinct init_date) from m where init_date >= date '1997-01-01' and init_date < date '1999-01-01' and seed <> 1)::int as partitions from m where init_date >= date '1997-01-01' and init_date < date '1999-01-01' and seed <> 1")
def pruned_scan(t: Tables) -> DataFrame:
    """The data source plans two years of all inits and two of three seeds from names; partitions is the number that it planned."""
    path = shared_path(t.spark, "pruned")
    rows = t.fc.groupBy(F.trunc("init_date", "month").alias("init_date"), F.floor(F.col("number") / 3).cast("int").alias("seed")).agg(F.avg("value").alias("value"))
    rows.repartition("init_date").write.partitionBy("init_date", "seed").parquet(path)
    read = readers.load_forecast("forecast_files", t.spark, path, layout="seed_dirs")
    kept = read.where((F.col("init_date") >= F.lit("1997-01-01").cast("date")) & (F.col("init_date") < F.lit("1999-01-01").cast("date")) & (F.col("seed") != 1))
    return rounded(kept.select("init_date", "seed", "value", F.lit(kept.rdd.getNumPartitions()).alias("partitions")))


@query("s10_station_years", "select year(valid_date)::int as year, round(lat, 2) as lat, round(lon, 2) as lon, count(*) as n, round(sum(greatest(value - 150, 0)), 3) as rain from obs join cells using (cell) group by 1, 2, 3")
def station_years(t: Tables) -> DataFrame:
    """A file a year, whose coordinates bear other names in one of them."""
    path = shared_path(t.spark, "stations")
    rain = t.obs.join(F.broadcast(t.cells), "cell").select(F.year("valid_date").alias("year"), "lat", "lon", "valid_date", F.greatest(F.col("value") - 150, F.lit(0.0)).alias("rain"))
    old = rain.where("year <> 1998").withColumnsRenamed({"lat": "latitude", "lon": "longitude", "valid_date": "TIME"})
    old.write.partitionBy("year").parquet(f"{path}/old")
    rain.where("year = 1998").drop("year").withColumnRenamed("valid_date", "time").write.parquet(f"{path}/new")
    years = [r[0] for r in t.spark.read.parquet(f"{path}/old").select("year").distinct().orderBy("year").collect()]  # one number a year
    read = readers.load_forecast("stations", t.spark, {**{y: f"{path}/old/year={y}" for y in years}, 1998: f"{path}/new"})
    return rounded(read.groupBy("year", "lat", "lon").agg(F.count(F.lit(1)).alias("n"), F.sum("rain").alias("rain")), 3)


@query("s11_member_cube", "with c as (select *, row_number() over (partition by model, init_date, cell, number order by lead_day) - 1 as day from fc) select number, day::int as day, count(*) as n, round(avg(value), 4) as value from c group by 1, 2")
def member_cube(t: Tables) -> DataFrame:
    """A path for each member, brought together with days from 0."""
    path = shared_path(t.spark, "members")
    t.fc.write.partitionBy("number").parquet(path)
    members = [r[0] for r in t.spark.read.parquet(path).select("number").distinct().orderBy("number").collect()]  # one number a member
    cube = readers.load_forecast("member_files", t.spark, {m: f"{path}/number={m}" for m in members}, ["model", "init_date", "cell"], "lead_day")
    return rounded(cube.groupBy("number", F.col("day").cast("int").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value")))


PHASE = "least(floor((degrees(atan2({b}, {a})) + 180) / 45)::int + 1, 8)"


@query("s14_long_table", f"select f.model, f.init_date, f.lead_day, f.number, round(rmm1, 4) as rmm1, round(rmm2, 4) as rmm2, {PHASE.format(a='rmm1', b='rmm2')} as phase, {PHASE.format(a='v.o1', b='v.o2')} as phase_obs, {PHASE.format(a='i.o1', b='i.o2')} as init_phase_obs, sqrt(rmm1 ** 2 + rmm2 ** 2) >= 1 as is_active_fcst, sqrt(v.o1 ** 2 + v.o2 ** 2) >= 1 as is_active_obs, coalesce(sqrt(i.o1 ** 2 + i.o2 ** 2) >= 1, false) as init_active_obs from rmm f join rmm_obs v on v.valid_date = f.init_date + f.lead_day left join rmm_obs i on i.valid_date = f.init_date")
def long_table(t: Tables) -> DataFrame:
    """Members beside the truth of the valid and the init day, with flags, as CSV and back."""
    path = shared_path(t.spark, "long")
    size = lambda a, b: F.sqrt(F.col(a) * F.col(a) + F.col(b) * F.col(b))
    valid = t.rmm_obs.withColumnsRenamed({"o1": "v1", "o2": "v2"})
    joined = indices.init_state(t.rmm, t.rmm_obs).withColumn("valid_date", F.date_add("init_date", F.col("lead_day"))).join(valid, "valid_date")
    table = joined.select(
        "model", "init_date", "lead_day", "number", "rmm1", "rmm2", mjo_phase(F.col("rmm1"), F.col("rmm2")).alias("phase"),
        mjo_phase(F.col("v1"), F.col("v2")).alias("phase_obs"), mjo_phase(F.col("o1"), F.col("o2")).alias("init_phase_obs"),
        (size("rmm1", "rmm2") >= 1).alias("is_active_fcst"), (size("v1", "v2") >= 1).alias("is_active_obs"), F.coalesce(size("o1", "o2") >= 1, F.lit(False)).alias("init_active_obs"),
    )
    write_table(rounded(table), path, "csv")
    return t.spark.read.schema(table.schema).option("header", True).csv(path)


@query("x1_streamed_rank_counts", f"with ranked as (select model, n, (len(list_filter(xs, lambda x: x < obs)) + floor({uniform_sql('0, init_date, lead_day, cell')} * (len(list_filter(xs, lambda x: x = obs)) + 1)))::int as rank from cases where n = n_all and n > 0) select model, n, rank, count(*) as count from ranked group by 1, 2, 3")
def streamed_rank_counts(t: Tables) -> DataFrame:
    """Counts from a stream of forecast rows in two runs. Every init is split over both runs' files and held until it is whole. Equal to the batch's."""
    base = shared_path(t.spark, "stream")
    keys = ["model", "init_date", "lead_day", "cell"]
    t.fc.withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy("model", "init_date"))).write.parquet(f"{base}/all")
    t.obs.write.parquet(f"{base}/truth")
    fc, truth = t.spark.read.parquet(f"{base}/all"), t.spark.read.parquet(f"{base}/truth")
    for late in (False, True):
        part = fc.where(((F.col("lead_day") + F.col("number")) % 2 == 0) == late)
        part.write.mode("append").parquet(f"{base}/in")
        rows = accumulate.whole_inits(accumulate.forecast_stream(t.spark, f"{base}/in", fc.schema), ["model", "init_date"], ["lead_day", "cell", "number"], "rows")
        accumulate.run_available(rows, f"{base}/checkpoint", f"{base}/out", lambda df: accumulate.rank_counts(df, truth, keys, ["model"]))
    return accumulate.summed(t.spark, f"{base}/out", ["model", "n", "rank"])


@query("x2_streamed_six_hourly", "with w as (select event_type, time_bucket(interval '6 hours', ts, timestamp '2000-01-01') as valid_time, avg(sqrt(value)) as value, count(*) as n from events group by 1, 2) select event_type, valid_time, round(value, 4) as value, n from w")
def streamed_six_hourly(t: Tables) -> DataFrame:
    """Six-hour means of an event stream in two runs, by watermark and window in update mode; windows that both runs touch are right too."""
    base = shared_path(t.spark, "stream6h")
    events = t.table("events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), F.sqrt("value").alias("value"))
    for early in (True, False):
        part = events.where((F.col("ts") < F.lit("2024-01-16 02:30:00").cast("timestamp")) == early)
        part.write.mode("append").parquet(f"{base}/in")
        means = accumulate.six_hourly(t.spark.readStream.schema(events.schema).parquet(f"{base}/in"))
        accumulate.run_available(means, f"{base}/checkpoint", f"{base}/out")
    return rounded(accumulate.latest(t.spark, f"{base}/out", ["event_type", "valid_time"], ["value", "n"]))
