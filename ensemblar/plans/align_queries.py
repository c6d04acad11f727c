"""Queries of alignment, filters, joins, windows, top-k, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, maths
from ..operators import align, climate, masks, scores
from ..sources import readers
from .registry import Tables, query, rounded

CASE = ["model", "init_date", "lead_day", "cell"]


# Sources


@query("s1_member_renumbering", "select model, init_date, lead_day, cell, (dense_rank() over (partition by model, init_date, lead_day, cell order by number) - 1)::int as number, round(value, 4) as value from fc where number <> 0")
def member_renumbering(t: Tables) -> DataFrame:
    """Member ids 0..n-1 within each case, whatever they were."""
    return rounded(align.renumber_members(t.fc.where("number <> 0"), CASE, ["number"]).withColumn("number", F.col("number").cast("int")))


@query("s2_file_name_parts", "with n as (select 'v_' || strftime(init_date, '%Y%m%d') || '00_ens_' || number || '.nc' as name from fc) select strptime(regexp_extract(name, '_(\\d{10})_ens_(\\d+)', 1), '%Y%m%d%H')::date as init_date, regexp_extract(name, '_(\\d{10})_ens_(\\d+)', 2)::int as number, count(*) as n from n group by 1, 2")
def file_name_parts(t: Tables) -> DataFrame:
    """Init and member out of file names."""
    name = F.concat(F.lit("v_"), F.date_format("init_date", "yyyyMMdd"), F.lit("00_ens_"), F.col("number"), F.lit(".nc"))
    named = t.fc.select(name.alias("name"))
    init = dates.name_date(F.col("name"), r"_(\d{8})\d{2}_ens")
    return named.groupBy(init.alias("init_date"), F.regexp_extract("name", r"_(\d{10})_ens_(\d+)", 2).cast("int").alias("number")).agg(F.count(F.lit(1)).alias("n"))


@query("s3_lead_days", "select lead_day, lead_day * 24 as lead_h, count(*) as n from fc group by 1, 2")
def lead_days(t: Tables) -> DataFrame:
    """S3: nested files' leads are days of 24 hours."""
    return t.fc.groupBy("lead_day", (F.col("lead_day") * 24).alias("lead_h")).agg(F.count(F.lit(1)).alias("n"))


@query("s4_levels", "select cell, level, round(avg(value), 4) as value from (select cell, 500.0::double as level, value from obs union all select cell, 850.0::double, value * 2 from obs) group by 1, 2")
def levels(t: Tables) -> DataFrame:
    """Columns of one level each become rows."""
    wide = t.obs.select("valid_date", "cell", F.col("value").alias("t_500"), (F.col("value") * 2).alias("t_850"))
    return rounded(readers.stacked_levels(wide, "t", [500, 850], ["valid_date", "cell"]).groupBy("cell", "level").agg(F.avg("value").alias("value")))


@query("s5_axis_guard", "select model, count(*) as n from (select model, lead_day * 10 - 5 as lead_day from fc) where lead_day between 0 and 399 group by 1")
def axis_guard(t: Tables) -> DataFrame:
    """Rows whose offset is out of range go."""
    return readers.sound_axis(t.fc.withColumn("lead_day", F.col("lead_day") * 10 - 5)).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query("s6_hindcast_fan_out", "with b as (select distinct init_date as base_date from fc), y as (select base_date, unnest([2010, 2011, 2012]) as y from b), d as (select base_date, try_cast(y || strftime(base_date, '-%m-%d') as date) as init_date from y) select init_date, count(*) as n from d where init_date is not null group by 1")
def hindcast_fan_out(t: Tables) -> DataFrame:
    """One init for each hindcast year of a file."""
    base = t.fc.select(F.col("init_date").alias("base_date"), F.array(F.lit(2010), F.lit(2011), F.lit(2012)).alias("hindcast_years")).distinct()
    return readers.fan_out(base).groupBy("init_date").agg(F.count(F.lit(1)).alias("n"))


@query("s7_control_and_perturbed", "with p as (select init_date, cell, (dense_rank() over (partition by init_date order by number))::int as number, value from fc where number > 0), u as (select init_date, cell, 0 as number, value from fc where number = 0 union all select * from p) select number, count(*) as n, round(avg(value), 4) as value from u where number < 5 group by 1")
def control_and_perturbed(t: Tables) -> DataFrame:
    """Control as member 0, the others after it, five in all."""
    rows = t.fc.select("init_date", "cell", "number", "value")
    both = readers.with_control(rows.where("number = 0"), rows.where("number > 0"), 5)
    return rounded(both.groupBy("number").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value")))


@query("s8_analysis_years", "select year(valid_date)::int as year, count(*) as n from obs where year(valid_date) in (1996, 1998, 1999) group by 1")
def analysis_years(t: Tables) -> DataFrame:
    """The years asked for and the one after."""
    return readers.analysis_years(t.obs, [1996, 1998]).groupBy(F.year("valid_date").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("s9_climatological_ensemble", "with i as (select distinct init_date from fc), c as (select init_date, l::int as lead_day, least(dayofyear(init_date + l::int), 365) as d from i, range(1, 6) r(l)), y as (select year(valid_date)::int as number, least(dayofyear(valid_date), 365) as d, cell, avg(value) as value from obs group by 1, 2, 3) select init_date, lead_day, cell, count(*) as n, round(avg(value), 4) as value from c join y using (d) group by 1, 2, 3")
def climatological_ensemble(t: Tables) -> DataFrame:
    """Past years' values at the same day of year as members."""
    inits = t.fc.select("init_date").distinct()
    members = readers.climatological_ensemble(inits, 5, t.obs)
    return rounded(members.groupBy("init_date", "lead_day", "cell").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value")))


@query("s12_month_range", "select month(init_date)::int as month, count(*) as n from fc where month(init_date) in (11, 12, 1, 2) group by 1")
def months_wrapping(t: Tables) -> DataFrame:
    """November to February."""
    return readers.month_range(t.fc, F.month("init_date"), 11, 2).groupBy(F.month("init_date").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("s15_missing_only", "select distinct init_date from fc where model = 'A' and init_date not in (select init_date from fc where model = 'B')")
def missing_only(t: Tables) -> DataFrame:
    """Inputs that have no output yet."""
    inits = t.fc.select("model", "init_date").distinct()
    return readers.missing_only(inits.where("model = 'A'").select("init_date"), inits.where("model = 'B'"), ["init_date"])


@query("s16_init_calendar", "with d as (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-12-31', interval 1 day))::date as d), c as (select make_date(1997, month(d), day(d)) as init_date from d where month(d) between 5 and 7 and isodow(d) in (1, 4)) select init_date, count(f.number) as n from c join fc f using (init_date) group by 1")
def init_calendar(t: Tables) -> DataFrame:
    """Mondays and Thursdays of a template year mapped onto 1997, with the forecasts of those days."""
    calendar = readers.init_calendar(t.spark, 2024, 1997, [5, 6, 7], [0, 3])
    return t.fc.join(F.broadcast(calendar), "init_date").groupBy("init_date").agg(F.count("number").alias("n"))


# Projections, filters and predicates


@query("p2_unit_scaling", "select model, round(avg(value * case when model = 'A' then 9.80665 else 0.024 end), 4) as value from fc group by 1")
def unit_scaling(t: Tables) -> DataFrame:
    """Scales out of the variable map."""
    config = t.fc.select("model").distinct().withColumn("scale", F.when(F.col("model") == "A", 9.80665).otherwise(0.024))
    return rounded(align.scale_units(t.fc, config, "scale", ["model"]).groupBy("model").agg(F.avg("value").alias("value")))


@query("p3_member_cap", "with r as (select *, dense_rank() over (partition by model, init_date, lead_day, cell order by number) - 1 as k from fc) select model, count(*) as n, round(avg(value), 4) as value from r where k < 3 group by 1")
def member_cap(t: Tables) -> DataFrame:
    """Three members in all."""
    return rounded(align.cap_members(align.renumber_members(t.fc, CASE, ["number"]), 3).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value")))


@query("p4_least_members", "with c as (select model, init_date, lead_day, cell from fc group by 1, 2, 3, 4 having count(distinct number) >= 4) select model, count(*) as n from fc semi join c using (model, init_date, lead_day, cell) group by 1")
def least_members(t: Tables) -> DataFrame:
    """Cases of at least four members."""
    return align.least_members(t.fc, CASE, 4).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query("p5_season_filter", "select init_date, count(*) as n from fc where year(init_date) between 1996 and 1998 and month(init_date) in (12, 1, 2) and isodow(init_date) in (1, 4) group by 1")
def season_filter(t: Tables) -> DataFrame:
    """P5: years, months and weekdays."""
    return align.in_season(t.fc, "init_date", (1996, 1998), [12, 1, 2], [0, 3]).groupBy("init_date").agg(F.count(F.lit(1)).alias("n"))


@query("p6_listed_dates", "with l as (select distinct valid_date as init_date from obs where day(valid_date) = 7) select 'found' as status, init_date from fc semi join l using (init_date) group by 2 union all select 'missing', init_date from l anti join fc using (init_date)")
def listed_dates(t: Tables) -> DataFrame:
    """Listed inits, and those listed without a forecast."""
    wanted = t.obs.select(F.col("valid_date").alias("init_date")).where(F.dayofmonth("init_date") == 7).distinct()
    found, missing = align.listed(t.fc.select("init_date"), wanted)
    return found.distinct().select(F.lit("found").alias("status"), "init_date").unionByName(missing.select(F.lit("missing").alias("status"), "init_date"))


@query("p7_lead_stride", "select lead_h::int as lead_h, count(*) as n from (select lead_day * 6 as lead_h from fc) where lead_h % 24 = 0 and lead_h > 0 and lead_h <= 240 group by 1")
def lead_stride(t: Tables) -> DataFrame:
    """Whole days up to ten, without step 0."""
    return align.daily_steps(t.fc.select((F.col("lead_day") * 6).alias("lead_h")), most=10).groupBy("lead_h").agg(F.count(F.lit(1)).alias("n"))


@query("p8_box_with_wrap", "select valid_date, count(*) as n, round(avg(value), 4) as value from obs join cells using (cell) where lat between 20 and 80 and (lon >= 270 or lon <= 40) group by 1")
def box_with_wrap(t: Tables) -> DataFrame:
    """A box across longitude 0."""
    rows = align.box(t.obs.join(F.broadcast(t.cells), "cell"), 20, 80, 270, 40)
    return rounded(rows.groupBy("valid_date").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value")))


@query("p10_dilated_mask", "with v as (select ilat, ilon, case when cell % 7 = 3 then null else value end as value from obs join cells using (cell)), m as (select ilat, ilon from v group by 1, 2 having count(value) = 0), g as (select distinct ilat + a as ilat, ilon + b as ilon from m, (values (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(a, b)) select ilat, ilon, count(value) as n from v anti join g using (ilat, ilon) group by 1, 2")
def dilated_mask(t: Tables) -> DataFrame:
    """P10: cells that never have truth, and their neighbours, are left out."""
    v = t.obs.join(F.broadcast(t.cells), "cell").withColumn("value", F.when(F.col("cell") % 7 != 3, F.col("value")))
    return v.join(masks.dilated_missing(v), ["ilat", "ilon"], "left_anti").groupBy("ilat", "ilon").agg(F.count("value").alias("n"))


@query("p11_screened_cases", "select model, lead_day, count(*) as n from cases where obs >= 120 and n = n_all and list_min(xs) >= 120 group by 1, 2")
def screened_cases(t: Tables) -> DataFrame:
    """Truth and every member above a threshold."""
    return masks.screen_cases(t.cases, 120.0).groupBy("model", "lead_day").agg(F.count(F.lit(1)).alias("n"))


LSM = "lsm as (select ilat, ilon, cell, least(1.0, avg(value) / 170)::double as lsm from obs join cells using (cell) group by 1, 2, 3)"


def _lsm(t: Tables) -> DataFrame:
    return t.obs.join(F.broadcast(t.cells), "cell").groupBy("ilat", "ilon", "cell").agg(F.least(F.lit(1.0), F.avg("value") / 170).alias("lsm"))


@query("p12_land_ocean", f"with {LSM} select case when lsm >= 0.9 then 'land' else 'ocean' end as surface, count(*) as n, round(avg(value), 4) as value from obs join lsm using (cell) group by 1")
def land_ocean(t: Tables) -> DataFrame:
    """A split by land share."""
    surface = F.when(F.col("lsm") >= 0.9, "land").otherwise("ocean").alias("surface")
    return rounded(t.obs.join(_lsm(t).select("cell", "lsm"), "cell").groupBy(surface).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value")))


@query("p13_land_interior", f"with {LSM}, s as (select m.ilat, m.ilon, least(greatest(m.ilat + a, 0), 5) as jlat, (m.ilon + b + 4) % 4 as jlon from lsm m, (values (-1), (0), (1)) x(a), (values (-1), (0), (1)) y(b) where m.lsm >= 0.9) select s.ilat, s.ilon from s join lsm l on l.ilat = s.jlat and l.ilon = s.jlon group by 1, 2 having min(l.lsm) >= 0.8")
def land_interior(t: Tables) -> DataFrame:
    """Land cells whose eight neighbours are land; longitude wraps, pole rows repeat."""
    return masks.land_interior(_lsm(t), 6, 4, 0.9, 0.8)


@query("p14_complete_groups", "select init_date from fc group by 1 having count(distinct (model, number)) = 14")
def complete_groups(t: Tables) -> DataFrame:
    """Inits for which every model and member is there."""
    return align.complete_groups(t.fc, "init_date", ["model", "number"], 14)


@query("p15_first_of_time", "select event_type, date_trunc('hour', ts) as hour, event_id from (select *, row_number() over (partition by event_type, date_trunc('hour', ts) order by ts, event_id) as k from events) where k = 1")
def first_of_time(t: Tables) -> DataFrame:
    """Repeated times keep their first row."""
    rows = t.table("events").withColumn("hour", F.date_trunc("hour", "ts"))
    return align.first_of(rows, ["event_type", "hour"], ["ts", "event_id"]).select("event_type", "hour", "event_id")


@query("p16_flips", "select 5 - ilat as ilat, (case when lon >= 180 then lon - 360 else lon end) as lon, round(avg(-value), 4) as value from obs join cells using (cell) group by 1, 2")
def flips(t: Tables) -> DataFrame:
    """Latitude order, longitude range and sign."""
    lon = F.when(F.col("lon") >= 180, F.col("lon") - 360).otherwise(F.col("lon"))
    return rounded(t.obs.join(F.broadcast(t.cells), "cell").groupBy((5 - F.col("ilat")).cast("int").alias("ilat"), lon.alias("lon")).agg(F.avg(-F.col("value")).alias("value")))


@query("p17_layer_blend", "select a.valid_date, round((7 * a.value + 13 * b.value) / 20, 4) as value from obs a join obs b on b.valid_date = a.valid_date and a.cell = 0 and b.cell = 1")
def layer_blend(t: Tables) -> DataFrame:
    """Two layers in one, where both are there."""
    a, b = (t.obs.where(F.col("cell") == k).select("valid_date", F.col("value").alias(n)) for k, n in ((0, "a"), (1, "b")))
    return rounded(a.join(b, "valid_date").select("valid_date", align.blend(F.col("a"), F.col("b"), 7, 13).alias("value")))


@query("p18_log_pressure", "select a.valid_date, round(a.value + ln(250.0 / 200) / ln(500.0 / 250) * (a.value - b.value), 4) as value from obs a join obs b on b.valid_date = a.valid_date and a.cell = 0 and b.cell = 1")
def log_pressure(t: Tables) -> DataFrame:
    """200 hPa from 250 and 500."""
    a, b = (t.obs.where(F.col("cell") == k).select("valid_date", F.col("value").alias(n)) for k, n in ((0, "a"), (1, "b")))
    return rounded(a.join(b, "valid_date").select("valid_date", align.log_pressure(F.col("a"), F.col("b"), 250, 500, 200).alias("value")))


# Joins


@query("j1_valid_time_join", "select f.model, f.init_date, f.lead_day, f.cell, round(avg(f.value), 4) as mean, round(any_value(o.value), 4) as obs from fc f left join obs o on o.valid_date = f.init_date + f.lead_day and o.cell = f.cell group by 1, 2, 3, 4")
def valid_time_join(t: Tables) -> DataFrame:
    """Truth at init + lead on the same integer cell; cases without truth stay."""
    return rounded(align.ensemble_cases(t.fc, t.obs, CASE, "left").select(*CASE, "mean", "obs"))


J2 = "with o as (select cell, valid_date::timestamp + interval 36 hours as tm, value from obs), l as (select distinct cell, init_date::timestamp as tm from fc), r as (select l.cell, l.tm, o.tm as matched_time, o.value as matched, row_number() over (partition by l.cell, l.tm order by abs(epoch(o.tm) - epoch(l.tm)), o.tm) as k from l join o on o.cell = l.cell and o.tm between l.tm - interval 5 days and l.tm + interval 5 days) select l.cell, l.tm as init_time, matched_time, round(matched, 4) as matched from l left join r on r.cell = l.cell and r.tm = l.tm and r.k = 1"


@query("j2_nearest_time", J2)
def nearest_time(t: Tables) -> DataFrame:
    """The truth nearest in time within five days; of two as near, the earlier."""
    left = t.fc.select("cell", F.col("init_date").cast("timestamp").alias("init_time")).distinct()
    right = t.obs.select("cell", (F.col("valid_date").cast("timestamp") + F.expr("interval 36 hours")).alias("init_time"), "value")
    return rounded(align.nearest_time(left, right, ["cell"], "init_time", 5 * 86400))


@query("j2_segments", J2)
def nearest_time_by_segments(t: Tables) -> DataFrame:
    """The same, a cell's series spread over tasks; candidates are carried from segment to segment."""
    left = t.fc.select("cell", F.col("init_date").cast("timestamp").alias("init_time")).distinct()
    right = t.obs.select("cell", (F.col("valid_date").cast("timestamp") + F.expr("interval 36 hours")).alias("init_time"), "value")
    return rounded(align.nearest_time(left, right, ["cell"], "init_time", 5 * 86400, segment=1000))


@query("j4_truth_rule", "with f as (select model, init_date, lead_day, cell, avg(value) as f from fc group by 1, 2, 3, 4) select f.model, f.lead_day, count(*) as n, round(avg(f.f - o.value * case when model = 'A' then 1 else 2 end), 4) as bias from f join obs o on o.cell = f.cell and o.valid_date = f.init_date + f.lead_day + case when model = 'A' then 0 else 1 end group by 1, 2")
def truth_rule(t: Tables) -> DataFrame:
    """Each model's own truth convention and day offset."""
    truth = t.obs.select("valid_date", "cell", F.explode(F.array(F.struct(F.lit("00z").alias("convention"), F.col("value").alias("o")), F.struct(F.lit("dailymean").alias("convention"), (F.col("value") * 2).alias("o")))).alias("x")).select("valid_date", "cell", "x.*")
    rules = t.fc.select("model").distinct().select("model", F.when(F.col("model") == "A", "00z").otherwise("dailymean").alias("convention"), F.when(F.col("model") == "A", 0).otherwise(1).alias("offset_days"))
    means = t.fc.groupBy(*CASE).agg(F.avg("value").alias("f"))
    return rounded(align.truth_by_rule(means, truth, rules).groupBy("model", "lead_day").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("f") - F.col("o")).alias("bias")))


@query("j7_nearest_init", "with a as (select distinct init_date from fc where model = 'A'), b as (select distinct init_date from fc where model = 'B'), m as (select a.init_date as ref_date, b.init_date as other_date, (b.init_date - a.init_date)::int as offset, row_number() over (partition by a.init_date order by abs(b.init_date - a.init_date), b.init_date) as k from a join b on b.init_date between a.init_date - 3 and a.init_date + 3) select ref_date, other_date, \"offset\" from m where k = 1")
def nearest_init(t: Tables) -> DataFrame:
    """The nearest other init within three days."""
    inits = t.fc.select("model", "init_date").distinct()
    a = inits.where("model = 'A'")
    return align.nearest_init(a, inits.where("model = 'B'"), 3)


PASS = "select a.init_date as ref_date, b.init_date as other_date, {k} as off from a join b on b.init_date = a.init_date + {k}"


@query("j8_one_to_one_pairs", "with a as (select distinct init_date from fc where model = 'A'), b as (select distinct init_date from fc where model = 'B'), p0 as (" + PASS.format(k=0) + "), p1 as (select * from p0 union all (" + PASS.format(k=1) + " where a.init_date not in (select ref_date from p0) and b.init_date not in (select other_date from p0))), p2 as (select * from p1 union all (" + PASS.format(k=-1) + " where a.init_date not in (select ref_date from p1) and b.init_date not in (select other_date from p1))) select ref_date, other_date, off as offset from p2")
def one_to_one_pairs(t: Tables) -> DataFrame:
    """Greedy pairs within a day, each partner used once."""
    inits = t.fc.select("model", "init_date").distinct()
    a = inits.where("model = 'A'")
    return align.pair_inits(a, inits.where("model = 'B'"), 1)


@query("j9_relabelled", "select case when day(init_date) = 1 then init_date - 1 else init_date end as real_init, count(*) as n from fc group by 1")
def relabelled(t: Tables) -> DataFrame:
    """Labels give way to real inits where there is a mapping."""
    firsts = t.fc.select(F.col("init_date").alias("label_date")).where(F.dayofmonth("label_date") == 1).distinct().withColumn("real_date", F.date_sub("label_date", 1))
    return align.relabel(t.fc, firsts).groupBy("real_init").agg(F.count(F.lit(1)).alias("n"))


@query("j10_region_members", "select region, count(*) as n from (select unnest(case when abs(lat) <= 20 then ['global', 'tropics'] when lat > 0 then ['global', 'NH'] else ['global', 'SH'] end) as region from obs join cells using (cell)) group by 1")
def region_members(t: Tables) -> DataFrame:
    """A cell counts in every region that holds it."""
    return t.obs.join(F.broadcast(masks.cell_region(t.cells).select("cell", "region")), "cell").groupBy("region").agg(F.count(F.lit(1)).alias("n"))


@query("j11_same_month", "select init_date, count(*) as n from fc where model = 'B' and strftime(init_date, '%Y%m') in (select strftime(init_date, '%Y%m') from fc where model = 'A' and number = 6) group by 1")
def same_month(t: Tables) -> DataFrame:
    """Inits whose month occurs in the other set."""
    other = t.fc.where("model = 'A' and number = 6").select("init_date")
    return align.same_month(t.fc.where("model = 'B'"), other).groupBy("init_date").agg(F.count(F.lit(1)).alias("n"))


@query("j12_fill_from", "with p as (select valid_date, value from daily where day(valid_date) > 5), s as (select valid_date, value * 2 as value from daily where day(valid_date) < 20) select coalesce(p.valid_date, s.valid_date) as valid_date, round(coalesce(p.value, s.value), 4) as value from p full join s on s.valid_date = p.valid_date")
def fill_from(t: Tables) -> DataFrame:
    """The primary record, else the fallback's."""
    day = F.dayofmonth("valid_date")
    return rounded(align.fill_from(t.daily.where(day > 5), t.daily.where(day < 20).withColumn("value", F.col("value") * 2), "valid_date", "value"))


@query("j16_rounded_coordinates", "select round(c.lat * 100)::bigint as klat, round(c.lon * 100)::bigint as klon, count(*) as n from obs join cells c using (cell) group by 1, 2")
def rounded_coordinates(t: Tables) -> DataFrame:
    """Coordinates that differ by less than a hundredth meet on integer keys."""
    off = t.obs.join(F.broadcast(t.cells), "cell").withColumns({"lat": F.col("lat") + 0.003, "lon": F.col("lon") - 0.003})
    key = lambda c: F.round(F.col(c) * 100).cast("bigint")
    grid = t.cells.select(key("lat").alias("klat"), key("lon").alias("klon"))
    return off.select(key("lat").alias("klat"), key("lon").alias("klon")).join(F.broadcast(grid), ["klat", "klon"]).groupBy("klat", "klon").agg(F.count(F.lit(1)).alias("n"))


@query("j17_shared_support", "select a.lead_day, count(*) as n, round(avg(a.value - b.value), 4) as gap from (select init_date, lead_day, number, avg(value) as value from fc where cell < 12 group by 1, 2, 3) a join (select init_date, lead_day, number, avg(value) as value from fc where cell >= 12 group by 1, 2, 3) b using (init_date, lead_day, number) group by 1")
def shared_support(t: Tables) -> DataFrame:
    """Steps and members that two fields share."""
    keys = ["init_date", "lead_day", "number"]
    a, b = (t.fc.where(c).groupBy(*keys).agg(F.avg("value").alias(n)) for c, n in (("cell < 12", "a"), ("cell >= 12", "b")))
    return rounded(align.shared_support(a, b, keys).groupBy("lead_day").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("a") - F.col("b")).alias("gap")))


# Windows


W1 = "with w as (select cell, valid_date, value, count(value) over g as n, avg(value) over g as m from obs window g as (partition by cell order by valid_date rows between 119 preceding and current row)) select cell, valid_date, round(value - m, 4) as value from w where n = 120"


@query("w1_high_pass", W1)
def high_pass(t: Tables) -> DataFrame:
    """Values minus the mean of their last 120 rows."""
    return rounded(climate.high_pass(t.obs, ["cell"], "valid_date").select("cell", "valid_date", "value"))


@query("w1_segments", W1)
def high_pass_by_segments(t: Tables) -> DataFrame:
    """The same, a cell's series spread over tasks, each segment with the rows in front that its windows reach."""
    return rounded(climate.high_pass(t.obs, ["cell"], "valid_date", segment=500).select("cell", "valid_date", "value"))


@query("w2_season_running_mean", "with w as (select year(valid_date)::int as y, valid_date, count(value) over g as n, avg(value) over g as running, min((month(valid_date) in (5, 6, 7, 8))::int) over g as inside from daily window g as (partition by year(valid_date) order by valid_date rows between current row and 6 following)) select y, round(stddev_pop(running), 4) as sd, count(*) as n from w where n = 7 and inside = 1 group by 1")
def season_running_mean(t: Tables) -> DataFrame:
    """Deviation of seven-day means that lie in the season."""
    runs = climate.season_running_mean(t.daily, "valid_date", [5, 6, 7, 8])
    return rounded(runs.groupBy(F.year("valid_date").alias("y")).agg(F.stddev_pop("running").alias("sd"), F.count(F.lit(1)).alias("n")))


@query("w7_deaccumulation", "with s as (select event_type, valid_time, sum(value) over (partition by event_type order by valid_time) as total from ev6), d as (select *, total - lag(total) over (partition by event_type order by valid_time) as value, row_number() over (partition by event_type order by valid_time) as k from s) select event_type, valid_time, round(value, 4) as value from d where k > 1")
def deaccumulation(t: Tables) -> DataFrame:
    """Steps out of running totals."""
    total = F.sum("value").over(Window.partitionBy("event_type").orderBy("valid_time"))
    return rounded(align.deaccumulate(t.ev6.withColumn("value", total), ["event_type"], "valid_time").select("event_type", "valid_time", "value"))


@query("w8_rolling_accumulation", "select event_type, valid_time, round(case when count(value) over g = 4 then sum(value) over g end, 4) as rolled from ev6 window g as (partition by event_type order by valid_time rows between 3 preceding and current row)")
def rolling_accumulation(t: Tables) -> DataFrame:
    """Totals of four steps of six hours."""
    return rounded(align.rolling_sum(t.ev6, ["event_type"], "valid_time", 4).select("event_type", "valid_time", "rolled"))


@query("w9_persistence", "with w as (select cell, valid_date, avg(value) over (partition by cell order by valid_date rows between 6 preceding and current row) as p from obs) select f.cell, f.lead_day, round(avg(abs(w.p - o.value)), 4) as mae from (select distinct init_date, lead_day, cell from fc) f join w on w.cell = f.cell and w.valid_date = f.init_date join obs o on o.cell = f.cell and o.valid_date = f.init_date + f.lead_day group by 1, 2")
def persistence(t: Tables) -> DataFrame:
    """The mean of the last seven values at init as a forecast."""
    w = Window.partitionBy("cell").orderBy("valid_date").rowsBetween(-6, 0)
    start = t.obs.select("cell", F.col("valid_date").alias("init_date"), F.avg("value").over(w).alias("p"))
    truth = t.obs.withColumnRenamed("value", "o")
    rows = t.fc.select("init_date", "lead_day", "cell").distinct().join(start, ["cell", "init_date"])
    rows = rows.withColumn("valid_date", F.date_add("init_date", F.col("lead_day"))).join(truth, ["valid_date", "cell"])
    return rounded(rows.groupBy("cell", "lead_day").agg(F.avg(F.abs(F.col("p") - F.col("o"))).alias("mae")))


SKILL = "c as (select model, lead_day, sum((mean - 150) * (obs - 150)) / sqrt(sum((mean - 150) ** 2) * sum((obs - 150) ** 2)) + 0.9 - lead_day / 30.0::double as acc from cases where mean is not null group by 1, 2), l as (select *, lag(acc) over g as b, lag(lead_day) over g as bl, max(lead_day) over (partition by model) as top, min(lead_day) over (partition by model) as low from c window g as (partition by model order by lead_day))"


@query("w10_skill_day", f"with {SKILL} select model, round(coalesce(min(case when acc < 0.5 then coalesce(bl, 0) end), max(lead_day)), 4)::double as before_drop, min(case when acc < 0.5 then lead_day end)::double as first_below, (min(case when acc < 0.5 then lead_day end) - any_value(low))::double as first_below_0, (max(case when acc >= 0.5 then lead_day end) - any_value(low) + 1)::double as last_above, round(coalesce(min_by(case when b is null then 0 else bl + (b - 0.5) / (b - acc) * (lead_day - bl) end, lead_day) filter (acc < 0.5), max(lead_day)), 4)::double as crossing from l group by 1")
def skill_day(t: Tables) -> DataFrame:
    """The five rules for a skill day."""
    f, o = F.col("mean") - 150, F.col("obs") - 150
    curve = t.cases.where("mean is not null").groupBy("model", "lead_day").agg((F.sum(f * o) / F.sqrt(F.sum(f * f) * F.sum(o * o))).alias("acc"))
    curve = curve.withColumn("acc", F.col("acc") + 0.9 - F.col("lead_day") / 30.0)
    out = None
    for rule in ("before_drop", "first_below", "first_below_0", "last_above", "crossing"):
        days = scores.skill_day(curve, ["model"], rule).withColumnRenamed("skill_day", rule)
        out = days if out is None else out.join(days, "model")
    return rounded(out)


@query("w12_gaps", "with d as (select distinct cell, valid_date from obs), l as (select *, lead(valid_date) over (partition by cell order by valid_date) as following from d) select cell, (valid_date + 1)::date as gap_start from l where following > valid_date + 1")
def gaps(t: Tables) -> DataFrame:
    """Where a daily series breaks off."""
    return align.gaps(t.obs, keys=["cell"])


@query("w13_padded_leads", "with k as (select model, cell, unnest(range(1, 46))::int as lead_day from (select distinct model, cell from fc)), v as (select model, cell, lead_day, avg(value) as value from fc group by 1, 2, 3) select k.model, k.cell, k.lead_day, round(value, 4) as value from k left join v using (model, cell, lead_day)")
def padded_leads(t: Tables) -> DataFrame:
    """Leads 1..45 of every key, NULL where absent."""
    return rounded(align.pad_leads(t.fc.groupBy("model", "cell", "lead_day").agg(F.avg("value").alias("value")), ["model", "cell"], 45))


# Top-k and sets


@query("t3_first_init_of_month", "with i as (select distinct case when model = 'A' then 0 else 1 end as rank, init_date from fc) select strftime(init_date, '%Y-%m') as month, min_by(init_date, (rank, init_date)) as init_date from i group by 1")
def first_init_of_month(t: Tables) -> DataFrame:
    """A month's first init, of the dataset that comes first."""
    i = t.fc.select(F.when(F.col("model") == "A", 0).otherwise(1).alias("rank"), "init_date").distinct()
    return i.groupBy(F.date_format("init_date", "yyyy-MM").alias("month")).agg(F.min_by("init_date", F.struct("rank", "init_date")).alias("init_date"))


@query("t4_nearest_lead", "select model, cell, min_by(lead_day, (abs(lead_day - 20.4), lead_day)) as lead_day from fc group by 1, 2")
def nearest_lead(t: Tables) -> DataFrame:
    """T4: the lead nearest to one asked for."""
    return t.fc.groupBy("model", "cell").agg(F.min_by("lead_day", F.struct(F.abs(F.col("lead_day") - 20.4), F.col("lead_day"))).alias("lead_day"))


@query("t5_most_inits", "select max_by(model, n) as model, max(n) as n from (select model, count(distinct init_date) as n from fc group by 1)")
def most_inits(t: Tables) -> DataFrame:
    """T5: the model with the most inits."""
    n = t.fc.groupBy("model").agg(F.count_distinct("init_date").alias("n"))
    return n.agg(F.max_by("model", "n").alias("model"), F.max("n").alias("n"))


@query("u1_common_inits", "select init_date from fc where model = 'A' intersect select init_date from fc where model = 'B'")
def common_inits(t: Tables) -> DataFrame:
    """Inits that both models have."""
    inits = lambda m: t.fc.where(F.col("model") == m).select("init_date")
    return inits("A").intersect(inits("B"))


@query("u4_source_preference", "with r as (select *, case when model = 'B' then 0 else 1 end as p from fc), k as (select init_date, min(p) as p from r group by 1) select init_date, any_value(model) as model, count(*) as n from r join k using (init_date, p) group by 1")
def source_preference(t: Tables) -> DataFrame:
    """U4: the primary source of each init, else the secondary."""
    rows = t.fc.withColumn("p", F.when(F.col("model") == "B", 0).otherwise(1))
    return readers.by_priority(rows, ["init_date"], "p").groupBy("init_date").agg(F.first("model").alias("model"), F.count(F.lit(1)).alias("n"))


@query("u6_complete_runs", "with w as (select model, init_date from fc where number < 5 group by 1, 2 having count(distinct number) = 5), b as (select init_date, max(model) as model from w group by 1) select init_date, model as run, count(*) as n from fc join b using (init_date, model) where number < 5 group by 1, 2")
def complete_runs(t: Tables) -> DataFrame:
    """Five members of one run, the newest that has all."""
    rows = t.fc.withColumnRenamed("model", "run")
    return readers.complete_runs(rows, 5).groupBy("init_date", "run").agg(F.count(F.lit(1)).alias("n"))


# Scalar functions


@query("f_date_keys", "select init_date, (dayofyear(init_date) - 1)::int as doy, (year(init_date) + (month(init_date) = 12)::int)::int as winter, strftime(init_date, '%Y-%m') as month_block, year(init_date) || '-' || ((month(init_date) % 12) // 3) as season_block, year(init_date) || '_' || lpad((((dayofyear(init_date) - 1) * 24) // 6)::varchar, 4, '0') as step_key from (select distinct init_date from fc)")
def date_keys(t: Tables) -> DataFrame:
    """day of year, winters, blocks and step keys."""
    d = t.fc.select("init_date").distinct()
    day = F.col("init_date")
    key = dates.step_key(day.cast("timestamp"))
    checked = F.when(dates.step_time(key).cast("date") == day, key)
    return d.select("init_date", dates.doy_index(day).alias("doy"), dates.winter_year(day).cast("int").alias("winter"), dates.block_key(day, "month").alias("month_block"), dates.block_key(day, "season").alias("season_block"), checked.alias("step_key"))


@query("f3_phases", "select valid_date, least(floor((degrees(atan2(o2, o1)) + 180) / 45)::int + 1, 8) as phase, round(sqrt(o1 * o1 + o2 * o2), 4) as amplitude, case when sqrt(o1 * o1 + o2 * o2) >= 1.5 then 'strong' when sqrt(o1 * o1 + o2 * o2) >= 1 then 'moderate' else 'inactive' end as stratum, round((degrees(atan2(o2, o1)) + 200 + 540) % 360 - 180, 4) as turned from rmm_obs")
def phases(t: Tables) -> DataFrame:
    """phase, amplitude, stratum and a wrapped angle."""
    a, b = F.col("o1"), F.col("o2")
    size = maths.amplitude(a, b)
    return rounded(t.rmm_obs.select("valid_date", maths.mjo_phase(a, b).alias("phase"), size.alias("amplitude"), maths.amplitude_stratum(size).alias("stratum"), maths.wrap_angle(F.degrees(F.atan2(b, a)) + 200).alias("turned")))


@query("a40_phase_contingency", "with p as (select least(floor((degrees(atan2(o2, o1)) + 180) / 45)::int + 1, 8) as phase, sqrt(o1 * o1 + o2 * o2) >= 1 as active from rmm_obs) select phase, count(*) filter (active) as active, count(*) filter (not active) as inactive from p group by 1")
def phase_contingency(t: Tables) -> DataFrame:
    """Days by phase and activity."""
    p = t.rmm_obs.select(maths.mjo_phase(F.col("o1"), F.col("o2")).alias("phase"), F.when(maths.amplitude(F.col("o1"), F.col("o2")) >= 1, "active").otherwise("inactive").alias("state"))
    counts = p.groupBy("phase").pivot("state", ["active", "inactive"]).count()
    return counts.na.fill(0)
