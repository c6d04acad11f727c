"""Queries of regridding, index patterns, monsoon onset, resampling and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import mjo_phase, sqrt_cos_weight, transition_group
from ..operators import align, climate, indices, masks, monsoon, regrid, resample, scores
from ..shared import shared_path
from ..sources.sinks import ScoreStore
from .registry import Tables, query, rounded, uniform_sql

LAT = [-75.0, -45.0, -15.0, 15.0, 45.0, 75.0]
LON = [0.0, 90.0, 180.0, 270.0]
FINE_LAT = [-90.0 + 15 * k for k in range(13)]
FINE_LON = [30.0 * k for k in range(12)]


# Regridding


def _grid(t: Tables) -> DataFrame:
    return t.obs.join(F.broadcast(t.cells.select("cell", "ilat", "ilon")), "cell")


AXES = "la as (select j, y, greatest(least(floor((y + 75) / 30)::int, 4), 0) as i, least(greatest((y + 75) / 30, 0), 5) as p from (select range::int as j, -90.0::double + 15 * range as y from range(13))), lo as (select range::int as j, floor(range / 3)::int as i, (range % 3) / 3.0::double as v from range(12)), wa as (select i as ilat, j as jlat, 1 - (p - i) as w from la where 1 - (p - i) > 0 union all select i + 1, j, p - i from la where p - i > 0), wo as (select i as ilon, j as jlon, 1 - v as w from lo where 1 - v > 0 union all select (i + 1) % 4, j, v from lo where v > 0)"


def _apply(out: str = "jlat, jlon") -> str:
    return f"select valid_date, jlat, jlon, round(case when count(value) = count(*) and round(sum(wa.w * wo.w), 9) = 1 then sum(wa.w * wo.w * value) end, 4) as value from obs join cells using (cell) join wa using (ilat) join wo using (ilon) group by 1, 2, 3"


@query("r1_bilinear", f"with {AXES} {_apply()}")
def bilinear(t: Tables) -> DataFrame:
    """Bilinear onto a finer grid; longitude goes round, rows beyond the outermost take it."""
    return rounded(regrid.regrid(_grid(t), regrid.linear_axis(LAT, FINE_LAT), regrid.linear_axis(LON, FINE_LON, 360.0), ["valid_date"], tile=4))


@query("r3_bilinear_box", f"with {AXES} select * from ({_apply()}) where jlat between 7 and 11 and (jlon >= 9 or jlon <= 1)")
def bilinear_box(t: Tables) -> DataFrame:
    """The same onto a box only; weights outside it are not made."""
    lat = [w for w in regrid.linear_axis(LAT, FINE_LAT) if 7 <= w[1] <= 11]
    lon = [w for w in regrid.linear_axis(LON, FINE_LON, 360.0) if w[1] >= 9 or w[1] <= 1]
    return rounded(regrid.regrid(_grid(t), lat, lon, ["valid_date"]))


@query("r4_longitude_shift", "with d as (select valid_date, ilat, avg(case when ilon = 0 then value end) as a, avg(case when ilon = 1 then value end) as b, avg(case when ilon = 2 then value end) as c, avg(case when ilon = 3 then value end) as e from obs join cells using (cell) group by 1, 2), s as (select valid_date, ilat as jlat, unnest([0, 1, 2, 3]) as jlon, unnest([(a + b) / 2, (b + c) / 2, (c + e) / 2, (e + a) / 2]) as value from d) select valid_date, jlat, jlon, round(value, 4) as value from s where value is not null")
def longitude_shift(t: Tables) -> DataFrame:
    """Half a cell along a periodic axis."""
    lon = regrid.linear_axis(LON, [x + 45 for x in LON], 360.0)
    same = regrid.nearest_axis(LAT, LAT)
    return rounded(regrid.regrid(_grid(t), same, lon, ["valid_date"]).where("value is not null"))


@query("r5_nearest", "select valid_date, unnest(case ilat when 0 then [0] when 2 then [1] when 4 then [2] else [] end)::int as jlat, ilon as jlon, round(value, 4) as value from obs join cells using (cell)")
def nearest(t: Tables) -> DataFrame:
    """Nearest rows."""
    return rounded(regrid.regrid(_grid(t), regrid.nearest_axis(LAT, [-70.0, -10.0, 50.0]), regrid.nearest_axis(LON, LON, 360.0), ["valid_date"]))


@query("r6_block_mean", "select valid_date, (ilat // 2)::int as jlat, (ilon // 2)::int as jlon, round(avg(value), 4) as value from obs join cells using (cell) group by 1, 2, 3")
def block_mean(t: Tables) -> DataFrame:
    """Means of two by two cells."""
    return rounded(regrid.block_mean(_grid(t), ["valid_date"], 2, 6, 4))


@query("r8_conservative", "with wa as (select s.i as ilat, d.j as jlat, (sin(radians(least(s.b, d.b))) - sin(radians(greatest(s.a, d.a)))) / (sin(radians(d.b)) - sin(radians(d.a))) as w from (select range::int as i, -90.0::double + 30 * range as a, -60.0::double + 30 * range as b from range(6)) s join (select range::int as j, -90.0::double + 45 * range as a, -45.0::double + 45 * range as b from range(4)) d on s.a < d.b and d.a < s.b), wo as (select s.i as ilon, d.j as jlon, (least(s.b, d.b) - greatest(s.a, d.a)) / (d.b - d.a) as w from (select range::int as i, 90.0::double * range as a, 90.0::double * range + 90 as b from range(4)) s join (select range::int as j, 120.0::double * range as a, 120.0::double * range + 120 as b from range(3)) d on s.a < d.b and d.a < s.b) " + _apply())
def conservative(t: Tables) -> DataFrame:
    """First-order conservative by overlaps of cell bounds."""
    bounds = lambda start, step, n: [(start + step * k, start + step * (k + 1)) for k in range(n)]
    lat, lon = regrid.conservative_axes(bounds(-90.0, 30.0, 6), bounds(-90.0, 45.0, 4), bounds(0.0, 90.0, 4), bounds(0.0, 120.0, 3))
    return rounded(regrid.regrid(_grid(t), lat, lon, ["valid_date"]))


# Patterns and projections

MONTHS = "mon as (select year(valid_date) * 100 + month(valid_date) as ym, cell, avg(value) as m from obs where month(valid_date) in (12, 1, 2) group by 1, 2), anom as (select ym::int as ym, cell, (m - avg(m) over (partition by cell)) * sqrt(cos(radians(lat))) as value from mon join cells using (cell))"


def _anomalies(t: Tables) -> DataFrame:
    """Weighted winter-month anomalies: at most 36 rows a decade and cell."""
    ym = (F.year("valid_date") * 100 + F.month("valid_date")).cast("int").alias("ym")
    months = t.obs.where(F.month("valid_date").isin(12, 1, 2)).groupBy(ym, "cell").agg(F.avg("value").alias("value"))
    gone = climate.remove_group_mean(months, ["cell"], ["value"]).join(F.broadcast(t.cells), "cell")
    return gone.withColumns({"wgt": sqrt_cos_weight(F.col("lat")), "value": F.col("value") * sqrt_cos_weight(F.col("lat"))}).select("ym", "cell", "value", "wgt")


@query("e1_gram_matrix", f"with {MONTHS} select a.ym as t, b.ym as s, round(sum(a.value * b.value), 3) as g from anom a join anom b using (cell) where a.ym <= b.ym group by 1, 2")
def gram_matrix(t: Tables) -> DataFrame:
    """Products of the months, the matrix that a pattern comes from."""
    return rounded(indices.gram(_anomalies(t), "ym", ["cell"]), 3)


def _power(name: str, matrix: str, n: int) -> str:
    """CTEs ``name``: (v, l), the leading eigenvector and eigenvalue of a symmetric matrix of lists, by squaring it 18 times."""
    times = "list_transform(m, lambda r: list_transform(m, lambda c: list_inner_product(r, c)))"
    trace = f"list_sum(list_transform(range(1, {n + 1}), lambda i: m[i][i]))"
    return (
        f"{name}_p as (select 0 as k, m, m as c from ({matrix}) union all select k + 1, list_transform(m, lambda r: list_transform(r, lambda x: x / tr)), c from (select k, m, c, {trace} as tr from (select k, {times} as m, c from {name}_p where k < 18))), "
        f"{name}_i as (select m, c, list_position(d, list_max(d)) as i from (select m, c, list_transform(range(1, {n + 1}), lambda i: m[i][i]) as d from {name}_p where k = 18)), "
        f"{name} as (select v, c, list_inner_product(v, list_transform(c, lambda r: list_inner_product(r, v))) as l from (select c, list_transform(m[i], lambda x: x / sqrt(list_inner_product(m[i], m[i]))) as v from {name}_i))"
    )


def _covariance(rows: str, time: str, n: int) -> str:
    """The matrix of lists of (time, cell, value) rows; what is missing counts as nothing."""
    return f"select list(r order by cell) as m from (select x.cell, list(coalesce(s, 0)::double order by y.cell) as r from (select range as cell from range({n})) x cross join (select range as cell from range({n})) y left join (select a.cell as c, b.cell as d, sum(a.value * b.value) as s from {rows} a join {rows} b using ({time}) group by 1, 2) on c = x.cell and d = y.cell group by 1)"


def _eof(t: Tables) -> DataFrame:
    """EOF1, its sign set so that the last row's mean loading is positive."""
    a = _anomalies(t)
    eof, shares = indices.snapshot_eof(a.select("ym", "cell", "value"), "ym", ["cell"])
    eof = eof.join(a.select("cell", "wgt").distinct(), "cell").withColumn("share", F.lit(shares[0]))
    ref = F.sum(F.when(F.col("cell") % 6 == 5, F.col("loading"))).over(Window.partitionBy("mode"))
    return eof.withColumn("loading", F.when(ref < 0, -F.col("loading")).otherwise(F.col("loading")))


@query("e1_daily_pattern", f"with recursive anom as (select valid_date, cell, (value - avg(value) over (partition by cell)) * sqrt(cos(radians(lat))) as value from obs join cells using (cell)), {_power('lead', _covariance('anom', 'valid_date', 24), 24)}, tot as (select sum(value * value) as total from anom), s as (select case when list_sum(v) < 0 then -1 else 1 end as sign, v, l / total as share from lead, tot) select (range)::int as cell, round(sign * v[range + 1], 4) as loading, round(share, 4) as share from s, range(24) where range in (select cell from anom)")
def daily_pattern(t: Tables) -> DataFrame:
    """The leading pattern of daily anomalies, by iteration where there are more than 400 days; the mean loading is positive."""
    gone = climate.remove_group_mean(t.obs, ["cell"], ["value"]).join(F.broadcast(t.cells), "cell")
    eof, shares = indices.snapshot_eof(gone.select("valid_date", "cell", (F.col("value") * sqrt_cos_weight(F.col("lat"))).alias("value")), "valid_date", ["cell"])
    sign = F.when(F.sum("loading").over(Window.partitionBy("mode")) < 0, -1).otherwise(1)
    return rounded(eof.select("cell", (sign * F.col("loading")).alias("loading"), F.lit(shares[0]).alias("share")))


@query("e2_projection", f"with recursive {MONTHS}, {_power('lead', _covariance('anom', 'ym', 24), 24)}, e as (select range::int as cell, v[range + 1] as loading, sum(case when range % 6 = 5 then v[range + 1] end) over () as ref from lead, range(24)), pc as (select valid_date, sum(value * sqrt(cos(radians(lat))) * case when ref < 0 then -loading else loading end) as pc from obs join cells using (cell) join e using (cell) group by 1) select valid_date, round((pc - avg(pc) over ()) / stddev_pop(pc) over (), 4) as index from pc")
def projection(t: Tables) -> DataFrame:
    """The daily index of the leading pattern over its deviation."""
    eof = _eof(t)
    pc = indices.project(t.obs, eof, ["cell"], ["valid_date"])
    sd = pc.agg(F.stddev_pop("pc").alias("sd"), F.avg("pc").alias("m"))
    return rounded(pc.join(F.broadcast(sd), F.lit(True)).select("valid_date", ((F.col("pc") - F.col("m")) / F.col("sd")).alias("index")))


HALVES = "half as (select (year(valid_date) * 2 + (month(valid_date) - 1) // 6)::int as half, cell, avg(value) as a, avg(value * value) as b from obs group by 1, 2), ff as (select half, cell as cell, a as value from half union all select half, cell + 24, b from half), cc as (select half, cell, value - avg(value) over (partition by cell) as value from ff), sc as (select half, cell, value / stddev_pop(value) over (partition by cell >= 24) as value from cc), wh as (select half from sc group by 1 having count(distinct cell) = (select count(distinct cell) from sc)), zz as (select half, cell, value - avg(value) over (partition by cell) as value from sc semi join wh using (half))"
DEFLATED = "select list_transform(range(1, 49), lambda i: list_transform(range(1, 49), lambda j: c[i][j] - l * v[i] * v[j])) as m from one"


@query("e4_combined_eof", f"with recursive {HALVES}, {_power('one', _covariance('zz', 'half', 48), 48)}, {_power('two', DEFLATED, 48)}, f as (select range::int as feature, one.v[range + 1] as p, two.v[range + 1] as q from one, two, range(48) where range in (select cell from zz)), g as (select sign(max_by(p, abs(p))) as sp, sign(max_by(q, abs(q))) as sq from f) select feature, round(p * sp, 4) as pc1, round(q * sq, 4) as pc2 from f, g")
def combined_eof(t: Tables) -> DataFrame:
    """The two leading patterns of two fields side by side over half-years, each field over its own deviation."""
    half = (F.year("valid_date") * 2 + F.floor((F.month("valid_date") - 1) / 6)).cast("int").alias("half")
    means = t.obs.groupBy(half, "cell").agg(F.avg("value").alias("a"), F.avg(F.col("value") * F.col("value")).alias("b"))
    fields = means.select("half", F.explode(F.array(F.struct((F.col("cell")).alias("feature"), F.col("a").alias("value")), F.struct((F.col("cell") + 24).alias("feature"), F.col("b").alias("value")))).alias("x")).select("half", "x.*")
    w = Window.partitionBy((F.col("feature") >= 24))
    centred = climate.remove_group_mean(fields, ["feature"], ["value"])
    scaled = centred.withColumn("value", F.col("value") / F.stddev_pop("value").over(w))
    eof, _ = indices.combined_eof(scaled, "half", "feature")
    top = F.max_by("pc1", F.abs("pc1")).over(Window.partitionBy(F.lit(0))), F.max_by("pc2", F.abs("pc2")).over(Window.partitionBy(F.lit(0)))
    return rounded(eof.select("feature", (F.col("pc1") * F.signum(top[0])).alias("pc1"), (F.col("pc2") * F.signum(top[1])).alias("pc2")))


@query("e11_pattern_units", "with s as (select stddev_pop(value) as sd from daily) select cell, round(sin(radians(cell * 15.0)) / sqrt(cos(radians(lat))) * sd / 9.80665, 4) as gpm from cells, s")
def pattern_units(t: Tables) -> DataFrame:
    """A pattern in metres for one deviation of its index."""
    sd = t.daily.agg(F.stddev_pop("value")).first()[0]  # one number
    eof = t.cells.select("cell", F.sin(F.radians(F.col("cell") * 15.0)).alias("loading"), sqrt_cos_weight(F.col("lat")).alias("wgt"))
    return rounded(indices.pattern_units(eof, sd or 0.0).select("cell", "gpm"))


@query("e5_reprojection", "with a as (select valid_date, cell, value - avg(value) over (partition by cell) as v from obs) select valid_date, round(sum(v * sin(radians(cell * 15.0))) / sqrt(12.0), 4) as pc1, round(sum(v * cos(radians(cell * 15.0))) / sqrt(12.0), 4) as pc2 from a group by 1")
def reprojection(t: Tables) -> DataFrame:
    """E5: an index pair by projection on two given patterns over the root of their eigenvalue."""
    a = climate.remove_group_mean(t.obs, ["cell"], ["value"])
    angle = F.radians(F.col("cell") * 15.0)
    eofs = t.cells.select("cell", F.sin(angle).alias("e1"), F.cos(angle).alias("e2"))
    joined = a.join(F.broadcast(eofs), "cell")
    return rounded(joined.groupBy("valid_date").agg((F.sum(F.col("value") * F.col("e1")) / F.sqrt(F.lit(12.0))).alias("pc1"), (F.sum(F.col("value") * F.col("e2")) / F.sqrt(F.lit(12.0))).alias("pc2")))


@query("e6_sign_alignment", "with m as (select f.model, f.init_date, f.lead_day, avg(rmm1) * case when day(f.init_date) % 2 = 0 then -1 else 1 end as f1, any_value(o1) as o1 from rmm f join rmm_obs b on b.valid_date = f.init_date + f.lead_day group by 1, 2, 3) select model, init_date, lead_day, round(case when sum(f1 * o1) over (partition by model, init_date) < 0 then -f1 else f1 end, 4) as f1 from m")
def sign_alignment(t: Tables) -> DataFrame:
    """Forecasts turned where their product with the reference is negative."""
    flip = F.when(F.dayofmonth("init_date") % 2 == 0, -1).otherwise(1)
    m = t.rmm.groupBy("model", "init_date", "lead_day").agg(F.avg("rmm1").alias("f1")).withColumn("f1", F.col("f1") * flip)
    m = m.withColumn("valid_date", F.date_add("init_date", F.col("lead_day"))).join(t.rmm_obs, "valid_date")
    return rounded(indices.align_sign(m, ["model", "init_date"], "f1", "o1", ["f1"]).select("model", "init_date", "lead_day", "f1"))


# the bias of a cell is the mean error of the other years' inits; errors are those of ensemble means
FIELD = "fe as (select f.model, f.init_date, f.lead_day, f.cell, year(f.init_date) as y, avg(f.value) - any_value(o.value) as e from fc f left join obs o on o.valid_date = f.init_date + f.lead_day and o.cell = f.cell group by 1, 2, 3, 4), fb as (select p.model, p.lead_day, p.cell, p.y, avg(q.e) as bias from (select distinct model, lead_day, cell, y from fe) p join fe q on q.model = p.model and q.lead_day = p.lead_day and q.cell = p.cell and q.y <> p.y group by 1, 2, 3, 4), fcc as (select f.model, f.init_date, f.lead_day, f.number, f.cell, f.value - b.bias as value from fc f join fb b on b.model = f.model and b.lead_day = f.lead_day and b.cell = f.cell and b.y = year(f.init_date)), frmm as (select model, init_date, lead_day, number, (avg(value) - 150) / 60 as rmm1, (avg(value * cos(radians(cell * 15.0))) + 5) / 60 as rmm2 from fcc where value is not null group by 1, 2, 3, 4)"
VERSIONS = FIELD + ", m as (select model, lead_day, init_date, avg(rmm1) as f1, avg(rmm2) as f2, any_value(o1) as o1, any_value(o2) as o2 from rmm f join rmm_obs b on b.valid_date = f.init_date + f.lead_day group by 1, 2, 3), y as (select *, year(init_date) as y from m), s as (select *, sum(f1 - o1) over l - sum(f1 - o1) over o as s1, sum(f2 - o2) over l - sum(f2 - o2) over o as s2, count(*) over l - count(*) over o as c from y window l as (partition by model, lead_day), o as (partition by model, lead_day, y)), v as (select 'raw' as version, model, lead_day, f1, f2, o1, o2 from m union all select 'corrected', model, lead_day, f1 - s1 / nullif(c, 0), f2 - s2 / nullif(c, 0), o1, o2 from s where c > 0 union all select 'field', f.model, f.lead_day, avg(rmm1), avg(rmm2), any_value(o1), any_value(o2) from frmm f join rmm_obs b on b.valid_date = f.init_date + f.lead_day group by f.model, f.lead_day, f.init_date)"


def _corrected_index(t: Tables) -> DataFrame:
    cases = align.ensemble_cases(t.fc, t.obs, ["model", "init_date", "lead_day", "cell"], "left")
    return t.index_pair(climate.correct_fields(t.fc, cases, ["model", "lead_day", "cell"]))


@query("e8_field_correction", f"with {FIELD} select model, init_date, lead_day, number, round(rmm1, 4) as rmm1, round(rmm2, 4) as rmm2 from frmm union all select model, init_date, lead_day, -1, round(avg(rmm1), 4), round(avg(rmm2), 4) from frmm group by 1, 2, 3")
def field_correction(t: Tables) -> DataFrame:
    """Every member's index made of fields without their leave-one-year-out bias; member -1 is the ensemble mean."""
    members = _corrected_index(t)
    mean = members.groupBy("model", "init_date", "lead_day").agg(F.lit(-1).alias("number"), F.avg("rmm1").alias("rmm1"), F.avg("rmm2").alias("rmm2"))
    return rounded(members.unionByName(mean))


@query("e7_band_anomaly", "with band as (select valid_date, ilon, avg(value) as v from obs join cells using (cell) where lat between -15 and 15 group by 1, 2), c as (select dayofyear(valid_date) as d, ilon, avg(v) as clim from band where year(valid_date) between 1995 and 1999 group by 1, 2) select b.valid_date, b.ilon, round(v - clim, 4) as value from band b join c on c.ilon = b.ilon and c.d = dayofyear(b.valid_date)")
def band_anomaly(t: Tables) -> DataFrame:
    """A band's mean by longitude less the mean of its day of year over the base years."""
    band = climate.meridional_mean(t.obs.join(F.broadcast(t.cells), "cell"), -15, 15, ["valid_date", "ilon"])
    clim = climate.doy_climatology(band, ["ilon"], (1995, 1999))
    return rounded(climate.anomalies(band, clim, ["ilon"], ["value"]).select("valid_date", "ilon", "value"))


@query("e3_normalised", "with a as (select valid_date, value - avg(value) over (partition by dayofyear(valid_date)) as pc, month(valid_date) in (12, 1, 2) as fit from daily), r as (select *, avg(pc) over w as run, count(*) over w = 7 and bool_and(fit) over w as ok from a window w as (order by valid_date rows between current row and 6 following)), s as (select stddev_pop(pc) filter (fit) as sd, stddev_pop(run) filter (ok) as sw from r) select valid_date, round(pc / sd, 4) as daily_index, round(case when ok then run / sw end, 4) as weekly_index from r, s where fit")
def normalised(t: Tables) -> DataFrame:
    """The winter's daily index over its deviation, and seven-day means over theirs."""
    a = climate.remove_group_mean(t.daily.withColumn("doy", F.dayofyear("valid_date")), ["doy"], ["value"])
    return rounded(indices.normalised(a, "valid_date", [12, 1, 2]).select("valid_date", "daily_index", "weekly_index"))


@query("e9_version_comparison", f"with {VERSIONS} select version, model, lead_day, count(*) as n, round(case when count(*) > 1 then sum(f1 * o1 + f2 * o2) / nullif(sqrt(sum(f1 * f1 + f2 * f2) * sum(o1 * o1 + o2 * o2)), 0) end, 4) as acc, round(sqrt(avg((f1 - o1) ** 2 + (f2 - o2) ** 2)), 4) as rmse from v group by 1, 2, 3")
def version_comparison(t: Tables) -> DataFrame:
    """Scores of an index as it is, after its own leave-one-year-out correction, and made of corrected fields."""
    m = indices.trajectory(t.rmm, t.rmm_obs).withColumn("year", F.year("init_date"))
    done = climate.remove_bias(climate.remove_bias(m, ["model", "lead_day"], "f1", "o1"), ["model", "lead_day"], "f2", "o2")
    cols = ["model", "lead_day", "f1", "f2", "o1", "o2"]
    both = m.select(F.lit("raw").alias("version"), *cols).unionByName(done.select(F.lit("corrected").alias("version"), *cols))
    field = indices.trajectory(_corrected_index(t), t.rmm_obs).select(F.lit("field").alias("version"), *cols)
    return rounded(scores.bivariate(both.unionByName(field), ["version", "model", "lead_day"]))


@query("e10_trajectory", "select f.model, f.init_date, f.lead_day, round(avg(rmm1), 4) as f1, round(avg(rmm2), 4) as f2, round(any_value(o1), 4) as o1, round(any_value(o2), 4) as o2 from rmm f join rmm_obs b on b.valid_date = f.init_date + f.lead_day group by 1, 2, 3")
def trajectory(t: Tables) -> DataFrame:
    """Phase-space rows of every init."""
    return rounded(indices.trajectory(t.rmm, t.rmm_obs).select("model", "init_date", "lead_day", "f1", "f2", "o1", "o2"))


@query("j13_init_state", "select f.model, least(floor((degrees(atan2(o2, o1)) + 180) / 45)::int + 1, 8) as init_phase, count(*) as n, round(avg(rmm1), 4) as rmm1 from rmm f left join rmm_obs b on b.valid_date = f.init_date group by 1, 2")
def init_state(t: Tables) -> DataFrame:
    """Forecasts by the phase of their init day; days without one count under NULL."""
    rows = indices.init_state(t.rmm, t.rmm_obs)
    return rounded(rows.groupBy("model", mjo_phase(F.col("o1"), F.col("o2")).alias("init_phase")).agg(F.count(F.lit(1)).alias("n"), F.avg("rmm1").alias("rmm1")))


@query("f9_transition_groups", "with s as (select a.valid_date, sqrt(a.o1 ** 2 + a.o2 ** 2) as x, sqrt(b.o1 ** 2 + b.o2 ** 2) as y from rmm_obs a join rmm_obs b on b.valid_date = a.valid_date + 10) select case when x >= 1 and y >= 1 then 'sustained' when x >= 1 or y >= 1 then 'onset-decay' end as grp, count(*) as n from s group by 1")
def transition_groups(t: Tables) -> DataFrame:
    """days by activity now and ten days on."""
    size = F.hypot("o1", "o2")
    now, later = t.rmm_obs.select("valid_date", size.alias("x")), t.rmm_obs.select(F.date_sub("valid_date", 10).alias("valid_date"), size.alias("y"))
    return now.join(later, "valid_date").groupBy(transition_group(F.col("x"), F.col("y")).alias("grp")).agg(F.count(F.lit(1)).alias("n"))


# Monsoon

RAIN = "rain as (select year(valid_date)::int as year, valid_date, cell % 6 as cell, avg(greatest(value - 150, 0)) as rain, 40 + cell % 6 as threshold from obs group by 1, 2, 3, 5), roll as (select *, case when count(rain) over g = 5 then sum(rain) over g end as rolled from rain window g as (partition by year, cell order by valid_date rows between current row and 4 following)), onset as (select year, cell, min(case when valid_date > make_date(year, 6, 2) and rain > 1 and rolled > threshold then valid_date end) as onset from roll group by 1, 2)"
FRAIN = "fday as (select init_date, number, cell, lead_day, avg(greatest(value - 150, 0)) as rain from (select init_date, number, cell % 6 as cell, lead_day, value from fc) group by 1, 2, 3, 4), froll as (select *, 40 + cell as threshold, case when count(*) over g = 5 then sum(coalesce(rain, 0)) over g end as rolled from fday window g as (partition by init_date, number, cell order by lead_day rows between current row and 4 following)), mem as (select init_date, number, cell, min(case when lead_day between 1 and 15 and coalesce(rain, 0) > 1 and rolled > threshold then lead_day end) as onset_day from froll group by 1, 2, 3)"
# a missing member value has no part in its cells' mean; DuckDB's greatest passes over NULL and would count it as dry
FRAIN_THERE = FRAIN.replace("greatest(value - 150, 0)", "case when value is not null then greatest(value - 150, 0) end")
PROB = f"with {RAIN}, {FRAIN}, pairs as (select year(init_date)::int as year, init_date, m.cell, b.a || '-' || b.z as bin_days, avg(coalesce(onset_day between b.a and b.z, false)::int) as p, max((onset - init_date between b.a and b.z)::int) as o from mem m join onset s on s.cell = m.cell and s.year = year(init_date) and s.onset is not null and init_date < s.onset, (values (1, 5), (6, 10), (11, 15)) b(a, z) group by 1, 2, 3, 4)"


def _rain(t: Tables) -> DataFrame:
    rain = t.obs.groupBy(F.year("valid_date").alias("year"), "valid_date", (F.col("cell") % 6).alias("cell")).agg(F.avg(F.greatest(F.col("value") - 150, F.lit(0.0))).alias("rain"))
    return rain.withColumn("threshold", F.col("cell") + 40)


def _pairs(t: Tables) -> DataFrame:
    onset = monsoon.observed_onset(_rain(t), ["cell"])
    fday = t.fc.withColumn("cell", F.col("cell") % 6).groupBy("init_date", "number", "cell", "lead_day").agg(F.avg(F.greatest(F.col("value") - 150, F.when(F.col("value").isNotNull(), 0.0))).alias("rain"))
    members = monsoon.member_onset(fday.withColumn("threshold", F.col("cell") + 40), ["cell"], start=None)
    return monsoon.onset_probability(monsoon.before_onset(members, onset, ["cell"]), ["cell"], [(1, 5), (6, 10), (11, 15)])


@query("w3_observed_onset", f"with {RAIN} select year, cell, onset from onset")
def observed_onset(t: Tables) -> DataFrame:
    """The first wet day from which five days are wet enough, by year and cell."""
    return monsoon.observed_onset(_rain(t), ["cell"])


@query("w4_member_onset", f"with {FRAIN_THERE} select onset_day, count(*) as n from mem group by 1")
def member_onset(t: Tables) -> DataFrame:
    """Onset days of members, NULL where there is none. A day's rain is the mean over the values that are there; a day without any counts as 0 in the sum."""
    fday = t.fc.withColumn("cell", F.col("cell") % 6).groupBy("init_date", "number", "cell", "lead_day").agg(F.avg(F.greatest(F.col("value") - 150, F.when(F.col("value").isNotNull(), 0.0))).alias("rain"))
    members = monsoon.member_onset(fday.withColumn("threshold", F.col("cell") + 40), ["cell"], start=None)
    return members.groupBy("onset_day").agg(F.count(F.lit(1)).alias("n"))


@query("a20_onset_brier", PROB + " select bin_days, round(avg((p - o) ** 2), 4) as bs, round(avg(o), 4) as base, count(*) as n, round(1 - avg((p - o) ** 2) / nullif(avg(o) * (1 - avg(o)), 0), 4) as bss from pairs group by 1")
def onset_brier(t: Tables) -> DataFrame:
    """Brier score of onset probabilities by bin of days."""
    return rounded(scores.brier(_pairs(t), ["bin_days"]))


@query("a39_onset_statistics", PROB + " select year, bin_days, count(*) as n, round(avg(o), 4) as base, round(avg(p), 4) as p_mean from pairs group by grouping sets ((year), (bin_days), ())")
def onset_statistics(t: Tables) -> DataFrame:
    """Numbers and rates by year, by bin and in all."""
    return rounded(monsoon.onset_statistics(_pairs(t)))


# Resampling

R = 1000
LEVELS = 13  # ranges of up to 8192 blocks


def _binomial(name: str, frm: str, n: str, p: str, u: str, keep: str) -> str:
    """CTEs ``name``: ``keep`` of ``frm`` with k, the least number whose binomial distribution function reaches u."""
    term = "exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(p) + (n - k) * ln(1 - p))"
    wide = "10 * sqrt(n * p * (1 - p)) + 10"
    return (
        f"{name}_n as (select {keep}, {n} as n, {p} as p, {u} as u from {frm}), "
        f"{name}_k as (select n, p, unnest(range(greatest(0, floor(n * p - ({wide})))::bigint, least(n, ceil(n * p + {wide}))::bigint + 1)) as k from (select distinct n, p from {name}_n where n > 0 and p > 0 and p < 1)), "
        f"{name}_c as (select n, p, k, sum({term}) over (partition by n, p order by k) as c from {name}_k), "
        f"{name} as (select x.* exclude (p, u), coalesce(y.k, case when x.p >= 1 then x.n else 0 end)::bigint as k from {name}_n x asof left join {name}_c y on x.n = y.n and x.p = y.p and x.u <= y.c)"
    )


def _drawn(seed: int) -> str:
    """Counts of draws by halving: how many of a range's draws fall into its left half."""
    parts = ["num as (select block, row_number() over (order by block) - 1 as k from (select distinct block from blocked))", "cnt as (select count(*) as nb from num)", f"l0 as (select r as replicate, 0 as lo, nb as m from cnt, range(1, {R + 1}) x(r))"]
    for level in range(LEVELS):
        size = 1 << (LEVELS - level)
        share = f"(least(nb, lo + {size // 2}) - lo)::double / (least(nb, lo + {size}) - lo)"
        hashed = f"(('0x' || substr(md5(concat_ws('|', {seed}, replicate // 4, {size}, lo)), 1 + 8 * (replicate % 4)::int, 8))::bigint + 0.5) / 4294967296.0::double"
        parts.append(_binomial(f"d{level}", f"l{level}, cnt", "m", share, hashed, "replicate, lo, nb"))
        parts.append(f"l{level + 1} as (select replicate, lo, k as m from d{level} where k > 0 union all select replicate, lo + {size // 2}, n - k from d{level} where n > k)")
    parts.append(f"bw as (select replicate, block, m as weight from l{LEVELS} join num on num.k = lo union all select 0, block, 1 from num)")
    return ", ".join(parts)


BLOCKS = f"blocked as (select *, year(init_date) || '-' || lpad(month(init_date)::varchar, 2, '0') as block from weekly where fa is not null and oa is not null), {_drawn(7)}"
SEASONS = f"blocked as (select *, year(init_date) || '-' || (month(init_date) % 12) // 3 as block from weekly where fa is not null and oa is not null), {_drawn(11)}"
# each cell's correlation in each replicate, then the mean over a region's cells that have one
REGIONAL = "sums as (select block, model, week, cell, count(*) as n, sum(fa) as f, sum(oa) as o, sum(fa * fa) as ff, sum(oa * oa) as oo, sum(fa * oa) as fo from blocked group by 1, 2, 3, 4), rep as (select replicate, model, week, cell, sum(weight * n)::double as n, sum(weight * f) as f, sum(weight * o) as o, sum(weight * ff) as ff, sum(weight * oo) as oo, sum(weight * fo) as fo from sums join bw using (block) group by 1, 2, 3, 4), v as (select *, ff / n - (f / n) ** 2 as vf, oo / n - (o / n) ** 2 as vo from rep), tcc as (select replicate, model, week, cell, case when n > 1 and vf > 1e-9 * ff / n and vo > 1e-9 * oo / n then (fo / n - f / n * (o / n)) / sqrt(vf * vo) end as r from v), located as (select *, cos(radians(lat)) as w, unnest(case when abs(lat) <= 20 then ['global', 'tropics'] when lat > 0 then ['global', 'NH'] else ['global', 'SH'] end) as region from tcc join cells using (cell)), cor as (select replicate, model, week, region, sum(w * r) / sum(case when r is not null then w end) as r from located group by 1, 2, 3, 4), keys as (select * from (select distinct replicate from bw), (select distinct model, week, region from cor)), whole as (select * from keys left join cor using (replicate, model, week, region))"


def _weekly_blocks(t: Tables, by: str = "month") -> DataFrame:
    from ..functions.dates import block_key

    return t.weekly.where("fa is not null and oa is not null").withColumn("block", block_key(F.col("init_date"), by))


def _replicates(t: Tables, by: str = "month", seed: int = 7) -> DataFrame:
    wk = _weekly_blocks(t, by)
    sums = resample.pair_sums(wk, ["block", "model", "week", "cell"], "fa", "oa")
    regions = masks.cell_region(t.cells).select("cell", "region", F.cos(F.radians("lat")).alias("weight"))
    return resample.replicate_regional_correlation(sums, resample.draws(wk, R, seed=seed), ["model", "week"], regions)


@query("b1_block_weights", f"with {BLOCKS} select replicate, block, weight from bw")
def block_weights(t: Tables) -> DataFrame:
    """B1: how often each replicate draws each month block; replicate 0 is the sample."""
    return resample.weights(resample.draws(_weekly_blocks(t), R, seed=7)).withColumn("weight", F.col("weight").cast("long"))


@query("b2_replicate_tcc", f"with {BLOCKS}, {REGIONAL} select replicate, model, week, region, round(r, 4) as r from whole")
def replicate_tcc(t: Tables) -> DataFrame:
    """B2: in each replicate a correlation for each cell out of block sums, then the regions' cos-lat means."""
    return rounded(_replicates(t))


@query("b3_tcc_interval", f"with {BLOCKS}, {REGIONAL} select model, week, region, round(max(r) filter (replicate = 0), 4) as value, round(quantile_cont(r, 0.025) filter (replicate > 0), 4) as low, round(quantile_cont(r, 0.975) filter (replicate > 0), 4) as high from whole group by 1, 2, 3")
def tcc_interval(t: Tables) -> DataFrame:
    """Exact percentile intervals of regional means."""
    return rounded(resample.intervals(_replicates(t), ["model", "week", "region"], "r"))


@query("b3_season_interval", f"with {SEASONS}, {REGIONAL} select model, week, region, round(max(r) filter (replicate = 0), 4) as value, round(quantile_cont(r, 0.025) filter (replicate > 0), 4) as low, round(quantile_cont(r, 0.975) filter (replicate > 0), 4) as high from whole group by 1, 2, 3")
def season_interval(t: Tables) -> DataFrame:
    """The same with seasons as blocks."""
    return rounded(resample.intervals(_replicates(t, "season", 11), ["model", "week", "region"], "r"))


@query("b4_paired_difference", f"with {BLOCKS}, {REGIONAL}, d as (select replicate, week, region, max(r) filter (model = 'A') - max(r) filter (model = 'B') as d from whole group by 1, 2, 3), q as (select week, region, max(d) filter (replicate = 0) as value, quantile_cont(d, 0.025) filter (replicate > 0) as low, quantile_cont(d, 0.975) filter (replicate > 0) as high, avg((d > 1e-9)::int) filter (replicate > 0) as p_gt0 from d group by 1, 2) select week, region, round(value, 4) as value, round(low, 4) as low, round(high, 4) as high, round(p_gt0, 4) as p_gt0, low > 1e-9 or high < -1e-9 as significant from q")
def paired_difference(t: Tables) -> DataFrame:
    """One model minus the other on the same replicates."""
    return rounded(resample.paired_difference(_replicates(t), "A", "B", ["week", "region"], "r"))


PERSISTED = "m as (select * from m0 union all select 'persistence', m0.lead_day, m0.init_date, i.o1, i.o2, m0.o1, m0.o2 from m0 join (select model from m0 group by 1 order by count(distinct init_date) desc, model limit 1) using (model) join rmm_obs i on i.valid_date = m0.init_date)"
BIVB = f"m as (select f.model, f.lead_day, f.init_date, avg(rmm1) as f1, avg(rmm2) as f2, any_value(o1) as o1, any_value(o2) as o2 from rmm f join rmm_obs b on b.valid_date = f.init_date + f.lead_day group by 1, 2, 3), blocked as (select *, init_date::varchar as block from m), {_drawn(3)}, s as (select block, model, lead_day, sum(f1 * o1 + f2 * o2) as fo, sum(f1 * f1 + f2 * f2) as ff, sum(o1 * o1 + o2 * o2) as oo from blocked group by 1, 2, 3), acc as (select replicate, model, lead_day, sum(weight * fo) / sqrt(sum(weight * ff) * sum(weight * oo)) as acc from s join bw using (block) group by 1, 2, 3), keys as (select * from (select distinct replicate from bw), (select distinct model, lead_day from s)), whole as (select * from keys left join acc using (replicate, model, lead_day))"


def _acc_replicates(t: Tables, persistence: bool = False) -> DataFrame:
    f1, f2, o1, o2 = (F.col(c) for c in ("f1", "f2", "o1", "o2"))
    m = indices.trajectory(t.rmm, t.rmm_obs)
    if persistence:
        m = indices.with_persistence(m, t.rmm_obs)
    m = m.withColumn("block", F.col("init_date").cast("string"))
    s = m.groupBy("block", "model", "lead_day").agg(F.sum(f1 * o1 + f2 * o2).alias("fo"), F.sum(f1 * f1 + f2 * f2).alias("ff"), F.sum(o1 * o1 + o2 * o2).alias("oo"))
    rep = resample.replicate_sums(s, resample.draws(m, R, seed=3), ["model", "lead_day"], ("fo", "ff", "oo"))
    return rep.select("replicate", "model", "lead_day", F.try_divide("fo", F.sqrt(F.col("ff") * F.col("oo"))).alias("acc"))


@query("b5_bivariate_bootstrap", f"with {BIVB} select model, lead_day, round(max(acc) filter (replicate = 0), 4) as value, round(quantile_cont(acc, 0.025) filter (replicate > 0), 4) as low, round(quantile_cont(acc, 0.975) filter (replicate > 0), 4) as high from whole group by 1, 2")
def bivariate_bootstrap(t: Tables) -> DataFrame:
    """Intervals of the bivariate ACC over draws of inits."""
    return rounded(resample.intervals(_acc_replicates(t), ["model", "lead_day"], "acc"))


SKILL_DAYS = "l as (select *, lag(lead_day) over (partition by replicate, model order by lead_day) as bl from whole), k as (select replicate, model, coalesce(min(case when acc < 0.05 then coalesce(bl, 0) end), max(lead_day))::double as day, max(lead_day) as top from l group by 1, 2), q as (select model, max(day) filter (replicate = 0) as value, quantile_cont(day, 0.025) filter (replicate > 0) as low, quantile_cont(day, 0.975) filter (replicate > 0) as high, max(top) as top from k group by 1) select model, value, round(low, 4) as low, round(high, 4) as high, high >= top as censored from q"


@query("b6_skill_day_interval", f"with {BIVB}, {SKILL_DAYS}")
def skill_day_interval(t: Tables) -> DataFrame:
    """The skill day's interval on the same draws of inits, and whether its end is the last lead."""
    return _skill_days(_acc_replicates(t))


def _skill_days(acc: DataFrame) -> DataFrame:
    days = scores.skill_day(acc, ["replicate", "model"], "before_drop", 0.05)
    top = acc.groupBy("model").agg(F.max("lead_day").alias("top"))
    out = resample.intervals(days, ["model"], "skill_day").join(top, "model")
    return rounded(out.select("model", "value", "low", "high", (F.col("high") >= F.col("top")).alias("censored")))


@query("b6_with_persistence", "with " + BIVB.replace("m as (", "m0 as (", 1).replace("), blocked as", f"), {PERSISTED}, blocked as", 1) + f", {SKILL_DAYS}")
def skill_days_with_persistence(t: Tables) -> DataFrame:
    """The state of the init day, kept, beside the models, on the inits of the model that has the most."""
    return _skill_days(_acc_replicates(t, persistence=True))


HASHED = "(('0x' || substr(md5(concat_ws('|', 5, r // 4, a, size)), 1 + 8 * (r % 4)::int, 8))::bigint + 0.5) / 4294967296.0::double"
CONS = f"pairs as (select f.model, f.lead_day, f.init_date, count(*) filter (sqrt(rmm1 ** 2 + rmm2 ** 2) >= 1) as a, count(*) as size from rmm f join rmm_obs b on b.valid_date = f.init_date + f.lead_day group by 1, 2, 3), grp as (select least(floor(a / size * 5)::int, 4) as bin, a, size, count(*) as cases from pairs group by 1, 2, 3), each_r as (select * from grp, range(1, {R + 1}) x(r)), {_binomial('red', 'each_r', 'cases', 'a::double / size', HASHED, 'bin, r')}, f as (select r as replicate, bin, sum(k) / sum(n) as freq from red group by 1, 2)"


@query("b7_consistency_band", f"with {CONS} select bin, round(quantile_cont(freq, 0.05), 4) as low, round(quantile_cont(freq, 0.95), 4) as high from f group by 1")
def consistency_band(t: Tables) -> DataFrame:
    """Where observed frequencies would lie if the probabilities were right. Cases of one probability are redrawn together."""
    m = t.rmm.withColumn("valid_date", F.date_add("init_date", F.col("lead_day"))).join(t.rmm_obs, "valid_date")
    active = F.count_if(F.sqrt(F.col("rmm1") * F.col("rmm1") + F.col("rmm2") * F.col("rmm2")) >= 1)
    pairs = m.groupBy("model", "lead_day", "init_date").agg(active.alias("a"), F.count(F.lit(1)).alias("n"))
    groups = pairs.groupBy(scores.event_bins(F.col("a") / F.col("n"), 5).alias("bin"), "a", "n").agg(F.count(F.lit(1)).alias("cases"))
    f = resample.redrawn_events(groups, ["bin"], R, seed=5).withColumn("freq", F.col("events") / F.col("cases"))
    return rounded(f.groupBy("bin").agg(F.percentile("freq", F.lit(0.05)).alias("low"), F.percentile("freq", F.lit(0.95)).alias("high")))


# Sinks and loaders


@query("s13_score_sink", "select model, 'weekly' as variant, lead_day, round(avg(mean), 4) as mean from cases group by 1, 3 union all select model, 'daily', lead_day, round(avg(obs), 4) from cases group by 1, 3")
def score_sink(t: Tables) -> DataFrame:
    """Two variants in one store; the first is written twice, and the second writing replaces it at once and leaves the other."""
    store = ScoreStore(t.spark, shared_path(t.spark, "scores"))
    for column, variant in (("obs", "weekly"), ("obs", "daily"), ("mean", "weekly")):
        store.publish(rounded(t.cases.groupBy("model", "lead_day").agg(F.avg(column).alias("mean"))), variant, ["model"])
    return store.read().select("model", "variant", "lead_day", "mean")
