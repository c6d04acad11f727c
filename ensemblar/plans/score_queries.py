"""Queries of scores (A1-A43) and of what they rest on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ensemble as ens
from ..functions.maths import normal_cdf, normal_pdf
from ..operators import align, climate, cube, masks, scores
from ..operators.align import ensemble_cases
from ..shared import shared_path
from ..sources import bucketed
from ..sources.sinks import ScoreStore
from .registry import Tables, query, rounded, uniform_sql

CASE = ["model", "init_date", "lead_day", "cell"]
CRPS = "(list_avg(list_transform(xs, lambda x: abs(x - obs))) - case when n > 1 then list_sum(list_transform(xs, lambda x, i: (2 * i - n - 1) * x)) / (n * (n - 1)) else 0 end)"
VAR = "(case when n > 1 then list_sum(list_transform(xs, lambda x: (x - mean) * (x - mean))) / (n - 1) when n = 1 then 0 end)"
RANKS = f"ranked as (select *, (len(list_filter(xs, lambda x: x < obs)) + floor({uniform_sql('0, init_date, lead_day, cell')} * (len(list_filter(xs, lambda x: x = obs)) + 1)))::int as rank from cases where n = n_all and n > 0)"
COUNTS = f"with {RANKS}, frame as (select distinct model, n, unnest(range(n + 1))::int as rank from ranked), counts as (select f.model, f.n, f.rank, count(r.rank) as count from frame f left join ranked r on r.model = f.model and r.n = f.n and r.rank = f.rank group by 1, 2, 3)"
ERF = "(1 / (1 + 0.3275911 * abs(y) / sqrt(2.0)))"
CDF = f"(case when y >= 0 then (1 + e) / 2 else (1 - e) / 2 end)"
ACC = "sum({w} * f * o) / nullif(sqrt(sum({w} * f * f) * sum({w} * o * o)), 0)"


def _located(t: Tables, df: DataFrame) -> DataFrame:
    return df.join(F.broadcast(t.cells), "cell")  # 24 rows


def _wide(t: Tables) -> DataFrame:
    """Ensemble-mean pairs f, o with their place."""
    return _located(t, t.cases.select(*CASE, F.col("mean").alias("f"), F.col("obs").alias("o")))


WIDE = "wide as (select c.model, init_date, lead_day, c.cell, mean as f, obs as o, lat, lon, ilat, ilon, cos(radians(lat)) as w from cases c join cells using (cell))"


@query("a5_crps_by_lead", f"select model, lead_day, round(avg(case when n = n_all then {CRPS} end), 4) as crps, round(sqrt(avg({VAR})), 4) as spread, round(sqrt(avg((mean - obs) ** 2)), 4) as error, round(sqrt(avg({VAR}) / avg((mean - obs) ** 2)), 4) as ssr, count(*) as n_cases from cases group by 1, 2")
def crps_by_lead(t: Tables) -> DataFrame:
    """Fair CRPS, spread, error and their ratio by lead."""
    return rounded(scores.spread_skill(t.cases, ["model", "lead_day"]))


@query("a7_ssr_finite_ensemble", f"select model, round(sqrt(avg({VAR} * (n + 1) / n) / avg((mean - obs) ** 2)), 4) as ssr from cases group by 1")
def ssr_finite(t: Tables) -> DataFrame:
    """The ratio with variances widened by (M + 1) / M."""
    return rounded(scores.spread_skill(t.cases, ["model"], finite=True).select("model", "ssr"))


@query("a1_ensemble_stats", "select model, init_date, lead_day, cell, round(avg(value), 4) as mean, round(case when count(value) = 1 then 0 else stddev_samp(value) end, 4) as spread, round(min(value), 4) as low, round(max(value), 4) as high, count(value) as n from fc group by 1, 2, 3, 4")
def ensemble_stats(t: Tables) -> DataFrame:
    """A1: member statistics of each case."""
    return rounded(scores.ensemble_stats(t.fc, CASE))


@query("a2_crps_fair", f"select model, init_date, lead_day, cell, round({CRPS}, 4) as crps from cases where n = n_all and n > 0")
def crps_fair(t: Tables) -> DataFrame:
    """CRPS of each case in order-statistic form."""
    return rounded(scores.whole_cases(t.cases).select(*CASE, ens.crps(F.col("xs"), F.col("obs")).alias("crps")))


@query("w11_crps_by_window", f"select model, init_date, lead_day, cell, round({CRPS}, 4) as crps from cases where n = n_all and n > 0")
def crps_window(t: Tables) -> DataFrame:
    """The same score from ranks in a window over members."""
    w = Window.partitionBy(*CASE)
    m = t.fc.join(t.cases.where("n = n_all and n > 0").select(*CASE, "obs"), CASE)
    m = m.withColumns({"_k": F.row_number().over(w.orderBy("value")), "_n": F.count("value").over(w)})
    n = F.max("_n")
    return rounded(m.groupBy(*CASE).agg((F.avg(F.abs(F.col("value") - F.col("obs"))) - F.when(n > 1, F.try_divide(F.sum((2 * F.col("_k") - F.col("_n") - 1) * F.col("value")), n * (n - 1))).otherwise(0.0)).alias("crps")))


@query("a3_crps_pairwise", "select model, lead_day, round(avg(list_avg(list_transform(xs, lambda x: abs(x - obs))) - case when n > 1 then list_sum(list_transform(xs, lambda x: list_sum(list_transform(xs, lambda z: abs(x - z))))) / (2 * n * (n - 1)) else 0 end), 4) as crps from cases where n = n_all and n > 0 group by 1, 2")
def crps_pairwise(t: Tables) -> DataFrame:
    """A3: the pairwise form, by lead."""
    return rounded(scores.whole_cases(t.cases).groupBy("model", "lead_day").agg(F.avg(ens.crps_pairwise(F.col("xs"), F.col("obs"))).alias("crps")))


@query("a4_crps_biased_weighted", "with c as (select model, init_date, lead_day, cos(radians(lat)) as w, list_avg(list_transform(xs, lambda x: abs(x - obs))) - case when n > 1 then list_sum(list_transform(xs, lambda x, i: (2 * i - n - 1) * x)) / (n * n) else 0 end as crps from cases join cells using (cell) where n > 0), i as (select model, init_date, lead_day, sum(w * crps) / sum(w) as crps from c group by 1, 2, 3) select model, lead_day, round(avg(crps), 4) as crps from i group by 1, 2")
def crps_biased(t: Tables) -> DataFrame:
    """A4, F2: the n-squared form, cos-lat mean by field, mean over inits."""
    c = _located(t, t.cases.where("n > 0")).withColumn("c", ens.crps(F.col("xs"), F.col("obs"), fair=False))
    fields = c.groupBy("model", "init_date", "lead_day").agg(scores.weighted_mean(F.col("c"), F.cos(F.radians("lat"))).alias("c"))
    return rounded(fields.groupBy("model", "lead_day").agg(F.avg("c").alias("crps")))


@query("a8_rank_histogram", COUNTS + " select model, n, rank, count from counts")
def rank_histogram(t: Tables) -> DataFrame:
    """Counts of the truth's rank, empty ranks included."""
    return scores.rank_counts(t.cases, ["model"], ["init_date", "lead_day", "cell"])


@query("a9_rank_diagnostics", COUNTS + ", f as (select *, sum(count) over (partition by model, n) as total, count(*) over (partition by model, n) as k from counts) select model, n, round(sum(abs(count / total - 1 / k)), 4) as ri, round(sum((count - total / k) ** 2 / (total / k)) / nullif(any_value(k) - 1, 0), 4) as delta, round((sum(count * rank) / any_value(total) - (any_value(k) - 1) / 2) / nullif((any_value(k) - 1) / 2, 0), 4) as bias from f group by 1, 2")
def rank_diagnostics(t: Tables) -> DataFrame:
    """Reliability index, chi square ratio and bias of the histogram."""
    return rounded(scores.rank_diagnostics(scores.rank_counts(t.cases, ["model"], ["init_date", "lead_day", "cell"]), ["model", "n"]))


@query("a10_pit", f"with p as (select model, (len(list_filter(xs, lambda x: x < obs)) + {uniform_sql('0, init_date, lead_day, cell')} * (len(list_filter(xs, lambda x: x = obs)) + 1)) / (n + 1) as u from cases where n = n_all and n > 0) select model, least(floor(u * 10)::int, 9) as bin, count(*) as count from p group by 1, 2")
def pit(t: Tables) -> DataFrame:
    """A10: randomised PIT of ragged ensembles in ten bins."""
    return scores.pit(t.cases, ["model"], ["init_date", "lead_day", "cell"], 10)


@query("a42_rank_frequency", COUNTS + " select model, n, round((rank + 0.5) / (n + 1), 4) as place, round(count / sum(count) over (partition by model, n), 4) as frequency from counts")
def rank_frequency(t: Tables) -> DataFrame:
    """Frequencies on a common axis."""
    return rounded(scores.rank_frequency(scores.rank_counts(t.cases, ["model"], ["init_date", "lead_day", "cell"]), ["model"]))


@query("a11_rmse_by_lead", f"with {WIDE}, r as (select model, init_date, lead_day, sqrt(sum(w * (f - o) ** 2) / sum(case when f is not null and o is not null then w end)) as rmse from wide group by 1, 2, 3) select model, lead_day, round(avg(rmse), 4) as rmse, round(stddev_pop(rmse), 4) as rmse_sd, count(rmse) as n_fields from r group by 1, 2")
def rmse_by_lead(t: Tables) -> DataFrame:
    """Area-weighted RMSE of each field, mean and deviation over inits."""
    return rounded(scores.rmse_by_lead(_wide(t), "f", "o", ["model", "init_date", "lead_day"], ["model", "lead_day"]))


@query("a12_rmse_map", f"with {WIDE} select model, lead_day, cell, round(sqrt(avg((f - o) ** 2)), 4) as rmse, count(f - o) as n_valid from wide group by 1, 2, 3")
def rmse_map(t: Tables) -> DataFrame:
    """RMSE of each cell and lead."""
    return rounded(scores.rmse_map(_wide(t), "f", "o", ["model", "lead_day", "cell"]))


@query("a13_member_rmse", "with e as (select f.model, f.lead_day, f.number, f.value - o.value as e from fc f join obs o on o.valid_date = f.init_date + f.lead_day and o.cell = f.cell) select model, lead_day, number, round(sqrt(avg(e * e)), 4) as rmse from e group by grouping sets ((model, lead_day, number), (model, lead_day))")
def member_rmse(t: Tables) -> DataFrame:
    """Unweighted RMSE by member and over all members, in one pass."""
    truth = t.obs.withColumnRenamed("value", "o")
    e = t.fc.withColumn("valid_date", F.date_add("init_date", F.col("lead_day"))).join(truth, ["valid_date", "cell"]).withColumn("e", F.col("value") - F.col("o"))
    return rounded(e.groupingSets([["model", "lead_day", "number"], ["model", "lead_day"]], "model", "lead_day", "number").agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse")))


@query("a14_regional_acc", f"with clim as (select dayofyear(valid_date) - 1 as doy, cell, avg(value) as clim from obs group by 1, 2), {WIDE}, a as (select x.model, init_date, lead_day, lat, w, f - clim as f, o - clim as o from wide x join clim c on c.cell = x.cell and c.doy = dayofyear(init_date + lead_day) - 1), r as (select *, unnest(case when abs(lat) <= 20 then ['global', 'tropics'] when lat > 0 then ['global', 'NH'] else ['global', 'SH'] end) as region from a), s as (select model, lead_day, init_date, region, {ACC.format(w='w')} as acc from r group by 1, 2, 3, 4) select model, lead_day, region, round(avg(acc), 4) as acc, count(acc) as n_inits from s group by 1, 2, 3")
def regional_acc(t: Tables) -> DataFrame:
    """Uncentred ACC of anomalies by region, mean over inits. A field's squares are over all cells that forecast or truth has."""
    clim = climate.doy_climatology(t.obs, ["cell"])
    pairs = _wide(t).withColumn("valid_date", F.date_add("init_date", F.col("lead_day")))
    a = climate.anomalies(pairs, clim, ["cell"], ["f", "o"])
    regions = F.broadcast(masks.cell_region(t.cells).select("cell", "region"))
    each = a.join(regions, "cell").groupBy("model", "lead_day", "init_date", "region").agg(scores.acc(F.col("f"), F.col("o"), F.cos(F.radians("lat")), paired=False).alias("acc"))
    # fields of one cell have 1 or -1 but for the last bits, which would decide on means halfway between two roundings
    each = each.withColumn("acc", F.round("acc", 12))
    return rounded(each.groupBy("model", "lead_day", "region").agg(F.avg("acc").alias("acc"), F.count("acc").alias("n_inits")))


@query("a15_acc_backward", "with clim as (select dayofyear(valid_date) as d, cell, avg(value) as clim from obs group by 1, 2), u as (select 'backward' as direction, f.model, f.init_date, -f.lead_day as lead_day, f.init_date - f.lead_day as vd, f.cell, avg(f.value) as f, any_value(o.value) as o from fc f join obs o on o.valid_date = f.init_date - f.lead_day and o.cell = f.cell group by all union all select 'forward', model, init_date, lead_day, init_date + lead_day, cell, mean, obs from cases), a as (select direction, model, init_date, lead_day, cos(radians(lat)) as w, f - clim as f, o - clim as o, unnest(case when abs(lat) <= 20 then ['global', 'tropics'] when lat > 0 then ['global', 'NH'] else ['global', 'SH'] end) as region from u join cells using (cell) join clim c on c.cell = u.cell and c.d = dayofyear(vd)), m as (select direction, model, init_date, lead_day, region, sum(w * f * o) / sum(case when f * o is not null then w end) as fo, sum(w * f * f) / sum(case when f is not null then w end) as ff, sum(w * o * o) / sum(case when o is not null then w end) as oo, sqrt(sum(w * (f - o) ** 2) / sum(case when f - o is not null then w end)) as rmse from a group by 1, 2, 3, 4, 5) select direction, model, lead_day, region, round(avg(case when ff > 0 and oo > 0 then fo / sqrt(oo) / sqrt(ff) end), 4) as acc, round(avg(rmse), 4) as rmse from m group by 1, 2, 3, 4")
def acc_backward(t: Tables) -> DataFrame:
    """Area-weighted ACC and RMSE of anomalies by region, mean over inits, of forward forecasts and of backward ones, whose leads are negative."""
    truth = t.obs.withColumnRenamed("value", "o")
    back = t.fc.withColumn("valid_date", F.date_sub("init_date", F.col("lead_day"))).join(truth, ["valid_date", "cell"])
    back = back.groupBy("model", "init_date", (-F.col("lead_day")).alias("lead_day"), "valid_date", "cell").agg(F.avg("value").alias("f"), F.first("o").alias("o"))
    ahead = t.cases.select("model", "init_date", "lead_day", F.date_add("init_date", F.col("lead_day")).alias("valid_date"), "cell", F.col("mean").alias("f"), F.col("obs").alias("o"))
    both = back.withColumn("direction", F.lit("backward")).unionByName(ahead.withColumn("direction", F.lit("forward")))
    a = climate.anomalies(both, climate.doy_climatology(t.obs, ["cell"]), ["cell"], ["f", "o"])
    a = a.join(F.broadcast(masks.cell_region(t.cells).select("cell", "lat", "region")), "cell")
    f, o, w = F.col("f"), F.col("o"), F.cos(F.radians("lat"))
    each = a.groupBy("direction", "model", "init_date", "lead_day", "region").agg(scores.weighted_acc(f, o, w).alias("acc"), F.sqrt(scores.weighted_mean((f - o) * (f - o), w)).alias("rmse"))
    return rounded(each.groupBy("direction", "model", "lead_day", "region").agg(F.avg("acc").alias("acc"), F.avg("rmse").alias("rmse")))


@query("a16_scalar_rmse", f"with {WIDE} select model, round(sqrt(sum(w * (f - o) ** 2) / sum(case when f is not null and o is not null then w end)), 4) as rmse from wide group by 1")
def scalar_rmse(t: Tables) -> DataFrame:
    """One latitude-weighted RMSE."""
    e = F.col("f") - F.col("o")
    return rounded(_wide(t).groupBy("model").agg(F.sqrt(scores.weighted_mean(e * e, F.cos(F.radians("lat")))).alias("rmse")))


TCC = "tcc as (select model, week, cell, count(*) as n, case when count(*) > 1 and var_pop(fa) > 1e-14 and var_pop(oa) > 1e-14 then covar_pop(fa, oa) / sqrt(var_pop(fa) * var_pop(oa)) end as tcc from weekly where fa is not null and oa is not null group by 1, 2, 3)"


def _tcc(t: Tables) -> DataFrame:
    return t.weekly.where("fa is not null and oa is not null").groupBy("model", "week", "cell").agg(F.count(F.lit(1)).alias("n"), scores.pearson(F.col("fa"), F.col("oa"), 1e-14).alias("tcc"))


@query("a17_tcc", f"with {TCC} select model, week, cell, n, round(tcc, 4) as tcc from tcc")
def tcc(t: Tables) -> DataFrame:
    """Correlation over inits by week and cell, from guarded sums."""
    return rounded(_tcc(t))


@query("a18_tcc_region", f"with {TCC}, r as (select *, cos(radians(lat)) as w, unnest(case when abs(lat) <= 20 then ['global', 'tropics'] when lat > 0 then ['global', 'NH'] else ['global', 'SH'] end) as region from tcc join cells using (cell)) select model, week, region, round(sum(w * tcc) / sum(case when tcc is not null then w end), 4) as tcc from r group by 1, 2, 3")
def tcc_region(t: Tables) -> DataFrame:
    """Regional means of the map, weights over the cells that have a value."""
    regions = F.broadcast(masks.cell_region(t.cells).select("cell", "lat", "region"))
    return rounded(_tcc(t).join(regions, "cell").groupBy("model", "week", "region").agg(scores.weighted_mean(F.col("tcc"), F.cos(F.radians("lat"))).alias("tcc")))


@query("a43_tcc_difference", f"with {TCC} select b.model, a.week, a.cell, round(a.tcc - b.tcc, 4) as difference from tcc a join tcc b using (week, cell) where a.model = 'A' and b.model <> 'A'")
def tcc_difference(t: Tables) -> DataFrame:
    """The first model's map minus the others'."""
    return rounded(scores.difference_to(_tcc(t), "A", ["week", "cell"], "tcc"))


@query("a19_weekly_spatial_acc", f"with g as (select model, init_date, week, fa - avg(fa) over (partition by model, week, cell) as f, oa - avg(oa) over (partition by model, week, cell) as o, cos(radians(lat)) as w from weekly join cells using (cell)), s as (select model, init_date, week, {ACC.format(w='w')} as acc, sqrt(sum(w * (f - o) ** 2) / sum(w)) as rmse from g where f is not null and o is not null group by 1, 2, 3) select model, week, round(avg(acc), 4) as acc, round(avg(rmse), 4) as rmse from s group by 1, 2")
def weekly_spatial_acc(t: Tables) -> DataFrame:
    """Spatial ACC and RMSE of weekly anomalies, mean over inits."""
    g = _located(t, climate.remove_group_mean(t.weekly, ["model", "week", "cell"], ["fa", "oa"])).where("fa is not null and oa is not null")
    f, o, w = F.col("fa"), F.col("oa"), F.cos(F.radians("lat"))
    s = g.groupBy("model", "init_date", "week").agg(scores.acc(f, o, w).alias("acc"), F.sqrt(F.sum(w * (f - o) * (f - o)) / F.sum(w)).alias("rmse"))
    return rounded(s.groupBy("model", "week").agg(F.avg("acc").alias("acc"), F.avg("rmse").alias("rmse")))


EXCEED = "pairs as (select f.model, f.lead_day, f.init_date, avg((sqrt(rmm1 ** 2 + rmm2 ** 2) >= 1)::int) as p, any_value((sqrt(o1 ** 2 + o2 ** 2) >= 1)::int) as o from rmm f join rmm_obs b on b.valid_date = f.init_date + f.lead_day group by 1, 2, 3)"


def _exceed(t: Tables) -> DataFrame:
    m = t.rmm.withColumn("valid_date", F.date_add("init_date", F.col("lead_day"))).join(t.rmm_obs, "valid_date")
    size = lambda a, b: F.sqrt(F.col(a) * F.col(a) + F.col(b) * F.col(b))
    return m.groupBy("model", "lead_day", "init_date").agg(F.avg((size("rmm1", "rmm2") >= 1).cast("double")).alias("p"), F.first((size("o1", "o2") >= 1).cast("int")).alias("o"))


@query("a23_exceedance", f"with {EXCEED}, pooled as (select model, lead_day + d as lead_day, p, o from pairs, (select unnest([-2, -1, 0, 1, 2]) as d)) select model, lead_day, round(avg(p), 4) as p, round(avg(o), 4) as o, count(*) as n from pooled group by 1, 2")
def exceedance(t: Tables) -> DataFrame:
    """Share of members with amplitude of at least 1 and its outcome, pooled over leads within two days."""
    from ..operators.indices import lead_window

    return rounded(lead_window(_exceed(t), 2).groupBy("model", "lead_day").agg(F.avg("p").alias("p"), F.avg("o").alias("o"), F.count(F.lit(1)).alias("n")))


CURVE = f"with {EXCEED}, curve as (select model, least(floor(p * 10)::int, 9) as bin, count(*) as n, avg(p) as p_mean, avg(o) as o_freq from pairs group by 1, 2)"


@query("a21_reliability_curve", CURVE + " select model, bin, n, round(p_mean, 4) as p_mean, round(o_freq, 4) as o_freq, round(n / sum(n) over (partition by model), 4) as share from curve")
def reliability_curve(t: Tables) -> DataFrame:
    """Reliability in ten bins, the last closed on the right."""
    return rounded(scores.reliability_curve(_exceed(t), by=["model"]))


@query("a22_reliability_stats", CURVE + ", s as (select model, sum(n * (p_mean - o_freq) ** 2) / sum(n) as rel, sum(n * o_freq) / sum(n) as base, sum(n) filter (n >= 5) as w, sum(n * p_mean) filter (n >= 5) as wp, sum(n * o_freq) filter (n >= 5) as wo, sum(n * p_mean * p_mean) filter (n >= 5) as wpp, sum(n * p_mean * o_freq) filter (n >= 5) as wpo from curve group by 1), l as (select *, (w * wpo - wp * wo) / nullif(w * wpp - wp * wp, 0) as slope from s), b as (select model, avg((p - o) ** 2) as bs, avg(o) as base from pairs group by 1) select model, round(rel, 4) as rel, round(l.base, 4) as base, round(slope, 4) as slope, round((wo - slope * wp) / w, 4) as intercept, round(bs, 4) as bs, round(1 - bs / nullif(b.base * (1 - b.base), 0), 4) as bss from l join b using (model)")
def reliability_stats(t: Tables) -> DataFrame:
    """Reliability term, Brier score and skill, and the count-weighted line."""
    pairs = _exceed(t)
    stats = scores.reliability_stats(scores.reliability_curve(pairs, by=["model"]), ["model"], least=5)
    return rounded(stats.join(scores.brier(pairs, ["model"]).select("model", "bs", "bss"), "model"))


BIV = "pairs as (select f.model, f.lead_day, f.init_date, avg(rmm1) as f1, avg(rmm2) as f2, any_value(o1) as o1, any_value(o2) as o2 from rmm f join rmm_obs b on b.valid_date = f.init_date + f.lead_day group by 1, 2, 3), biv as (select model, lead_day, count(*) as n, case when count(*) > 1 then sum(f1 * o1 + f2 * o2) / nullif(sqrt(sum(f1 * f1 + f2 * f2) * sum(o1 * o1 + o2 * o2)), 0) end as acc, sqrt(avg((f1 - o1) ** 2 + (f2 - o2) ** 2)) as rmse from pairs group by 1, 2)"


def _biv(t: Tables) -> DataFrame:
    m = t.rmm.groupBy("model", "init_date", "lead_day").agg(F.avg("rmm1").alias("f1"), F.avg("rmm2").alias("f2"))
    return m.withColumn("valid_date", F.date_add("init_date", F.col("lead_day"))).join(t.rmm_obs, "valid_date")


@query("a24_bivariate_acc", f"with {BIV} select model, lead_day, n, round(acc, 4) as acc, round(rmse, 4) as rmse from biv")
def bivariate_acc(t: Tables) -> DataFrame:
    """Bivariate ACC and RMSE by lead."""
    return rounded(scores.bivariate(_biv(t), ["model", "lead_day"]))


A41 = f"with {BIV}, subset as (select 'all' as subset, init_date from pairs group by 2 union all select 'may-jul', init_date from pairs where month(init_date) between 5 and 7 group by 2 union all select 'common', init_date from pairs group by 2 having count(distinct model) = 2) select subset, model, lead_day, count(*) as n, round(case when count(*) > 1 then sum(f1 * o1 + f2 * o2) / nullif(sqrt(sum(f1 * f1 + f2 * f2) * sum(o1 * o1 + o2 * o2)), 0) end, 4) as acc, round(sqrt(avg((f1 - o1) ** 2 + (f2 - o2) ** 2)), 4) as rmse from pairs join subset using (init_date) group by 1, 2, 3"


@query("a41_subset_comparison", A41)
def subset_comparison(t: Tables) -> DataFrame:
    """The same score on all inits, on one season's and on those that both models have."""
    pairs = _biv(t)
    dates = pairs.select("init_date").distinct()
    subsets = dates.select(F.lit("all").alias("subset"), "init_date").unionByName(align.in_season(dates, "init_date", months=[5, 6, 7]).select(F.lit("may-jul").alias("subset"), "init_date"))
    subsets = subsets.unionByName(align.common_dates(pairs).select(F.lit("common").alias("subset"), "init_date"))
    return rounded(scores.subset_scores(pairs, subsets, scores.bivariate, ["model", "lead_day"]))


@query("a41_from_cube", A41)
def subsets_from_cube(t: Tables) -> DataFrame:
    """The same from stored sums by init and lead; subsets and their scores read the cube alone."""
    store = ScoreStore(t.spark, shared_path(t.spark, "cube"))
    store.publish(cube.score_cube(_biv(t), ["model", "init_date", "lead_day"], [("f1", "o1"), ("f2", "o2")]), "rmm", ["model"])
    held = store.read(["rmm"])
    sums = cube.subset_cube(held, cube.subsets_of(held, {"may-jul": [5, 6, 7]}, 2), ["model", "lead_day"])
    return rounded(cube.scores_of(sums).select("subset", "model", "lead_day", "n", "acc", "rmse"))


@query("d4_regional_cube", f"with {WIDE}, r as (select *, unnest(case when abs(lat) <= 20 then ['global', 'tropics'] when lat > 0 then ['global', 'NH'] else ['global', 'SH'] end) as region from wide where f is not null and o is not null), g as (select model, year(init_date)::int as year, region, ceil(lead_day / 7.0)::int as week, sum(w) as sw, sum(w * f) as sf, sum(w * o) as so, sum(w * f * f) as ff, sum(w * o * o) as oo, sum(w * f * o) as fo, sum(w * (f - o) ** 2) as ee, count(*) as n from r group by 1, 2, 3, 4) select model, year, region, week, n, round(case when n > 1 then fo / sqrt(ff * oo) end, 4) as acc, round(sqrt(ee / sw), 4) as rmse, round((sf - so) / sw, 4) as bias, round(case when n > 2 then (fo / sw - sf / sw * so / sw) / sqrt(ff / sw - (sf / sw) ** 2) / sqrt(oo / sw - (so / sw) ** 2) end, 3) as cor from g")
def regional_cube(t: Tables) -> DataFrame:
    """Sums by init, lead and region, stored, and merged to years and weeks."""
    pairs = _wide(t).join(F.broadcast(masks.cell_region(t.cells).select("cell", "region")), "cell")
    store = ScoreStore(t.spark, shared_path(t.spark, "cube"))
    store.publish(cube.score_cube(pairs, ["model", "init_date", "lead_day", "region"], [("f", "o")], F.cos(F.radians("lat"))), "field", ["model"])
    held = store.read(["field"]).withColumns({"year": F.year("init_date"), "week": F.ceil(F.col("lead_day") / 7).cast("int")})
    found = cube.scores_of(cube.merged(held, ["model", "year", "region", "week"]))
    return rounded(found.select("model", "year", "region", "week", "n", "acc", "rmse", "bias", F.round(F.when(F.col("n") > 2, F.col("cor")), 3).alias("cor")))


@query("j1_bucketed_truth", f"with c as (select model, lead_day, round(avg(case when n = n_all then {CRPS} end), 4) as crps, round(sqrt(avg((mean - obs) ** 2)), 4) as error from cases group by 1, 2), clim as (select dayofyear(valid_date) - 1 as doy, cell, avg(value) as clim from obs group by 1, 2), a as (select model, lead_day, sum((mean - clim) * (obs - clim)) / sqrt(sum((mean - clim) ** 2) * sum((obs - clim) ** 2)) as acc from cases k join clim c on c.cell = k.cell and c.doy = dayofyear(init_date + lead_day) - 1 where mean is not null group by 1, 2) select model, lead_day, crps, error, round(acc, 4) as acc from c left join a using (model, lead_day)")
def bucketed_truth(t: Tables) -> DataFrame:
    """Scores against truth and a climatology that are stored in buckets of what joins them, and are not shuffled again."""
    truth = bucketed.store_bucketed(t.obs, "ensemblar_truth", bucketed.TRUTH).hint("merge")
    clim = bucketed.store_bucketed(climate.doy_climatology(t.obs, ["cell"]), "ensemblar_climatology", bucketed.CLIMATOLOGY).hint("merge")
    cases = ensemble_cases(t.fc, truth, ["model", "init_date", "lead_day", "cell"])
    crps = scores.spread_skill(cases, ["model", "lead_day"]).select("model", "lead_day", "crps", "error")
    pairs = cases.withColumn("valid_date", F.date_add("init_date", F.col("lead_day")))
    gone = climate.anomalies(pairs, clim, ["cell"], ["mean", "obs"])
    acc = gone.groupBy("model", "lead_day").agg(scores.acc(F.col("mean"), F.col("obs")).alias("acc"))
    return rounded(crps.join(acc, ["model", "lead_day"], "left"))


NORMAL = f"nrm as (select *, o as y, 1 - (((((1.061405429 * {ERF} - 1.453152027) * {ERF}) + 1.421413741) * {ERF} - 0.284496736) * {ERF} + 0.254829592) * {ERF} * exp(-o * o / 2) as e from (select *, o as y from idx)), idx2 as (select *, y * (2 * {CDF} - 1) + 2 * exp(-y * y / 2) / sqrt(2 * pi()) - 1 / sqrt(pi()) as cref from nrm)"


@query("a26_index_scores", f"with m as (select f.model, f.lead_day, f.init_date, list_sort(list(rmm1)) as xs, count(*) as n, avg(rmm1) as f, any_value(b.o1) as obs, any_value(i.o1) as p0 from rmm f join rmm_obs b on b.valid_date = f.init_date + f.lead_day join rmm_obs i on i.valid_date = f.init_date group by 1, 2, 3), idx as (select model, lead_day, f, obs as o, p0, {CRPS} as crps from m), {NORMAL} select model, lead_day, round(sum(f * o) / nullif(sqrt(sum(f * f) * sum(o * o)), 0), 4) as acc, round(case when count(*) > 1 and var_pop(f) > 0 and var_pop(o) > 0 then covar_pop(f, o) / sqrt(var_pop(f) * var_pop(o)) end, 4) as cor, round(sqrt(avg((f - o) ** 2)), 4) as rmse, round(stddev_pop(f) / nullif(stddev_pop(o), 0), 4) as amp, round(avg(f - o), 4) as bias, round(1 - sum(crps) / nullif(sum(cref), 0), 4) as crpss, round(sum(p0 * o) / nullif(sqrt(sum(p0 * p0) * sum(o * o)), 0), 4) as pers_acc, round(case when count(*) > 1 and var_pop(p0) > 0 and var_pop(o) > 0 then covar_pop(p0, o) / sqrt(var_pop(p0) * var_pop(o)) end, 4) as pers_cor from idx2 group by 1, 2")
def index_scores(t: Tables) -> DataFrame:
    """Index scores by lead, against the normal climatology and against persistence of the init day."""
    m = t.rmm.groupBy("model", "lead_day", "init_date").agg(ens.members("rmm1").alias("xs"), F.avg("rmm1").alias("f"))
    m = m.withColumn("valid_date", F.date_add("init_date", F.col("lead_day"))).join(t.rmm_obs.select("valid_date", F.col("o1").alias("o")), "valid_date")
    m = m.join(t.rmm_obs.select(F.col("valid_date").alias("init_date"), F.col("o1").alias("p0")), "init_date")
    return rounded(scores.index_scores(m.withColumn("crps", ens.crps(F.col("xs"), F.col("o"))), ["model", "lead_day"]))


@query("f7_normal_crps", f"with idx as (select valid_date, o1 as o from rmm_obs), {NORMAL} select valid_date, round({CDF}, 4) as cdf, round(exp(-y * y / 2) / sqrt(2 * pi()), 4) as pdf, round(cref, 4) as crps from idx2")
def normal_crps(t: Tables) -> DataFrame:
    """The normal distribution as column expressions."""
    y = F.col("o1")
    return rounded(t.rmm_obs.select("valid_date", normal_cdf(y).alias("cdf"), normal_pdf(y).alias("pdf"), ens.crps_normal(y, normal_cdf(y), normal_pdf(y)).alias("crps")))


@query("a28_doy_climatology", "select dayofyear(valid_date)::int - 1 as doy, cell, round(avg(value), 4) as clim, count(value) as n from obs where year(valid_date) between 1995 and 1999 group by 1, 2")
def doy_climatology(t: Tables) -> DataFrame:
    """Day-of-year climatology of a range of years, with counts."""
    return rounded(climate.doy_climatology(t.obs, ["cell"], (1995, 1999)))


@query("a29_trend_climatology", "with s as (select dayofyear(valid_date)::int - 1 as doy, cell, avg(value) as ybar, avg(year(valid_date)) as xbar, avg(year(valid_date) * value) as xy, avg(year(valid_date) * year(valid_date)::double) as xx from obs group by 1, 2) select doy, cell, round(ybar, 4) as ybar, round(case when xx - xbar * xbar > 1e-9 then (xy - xbar * ybar) / (xx - xbar * xbar) end, 3) as slope, round(xbar, 4) as xbar from s")
def trend_climatology(t: Tables) -> DataFrame:
    """The line over years by day of year and cell."""
    c = climate.trend_climatology(t.obs, ["cell"])
    return c.select("doy", "cell", F.round("ybar", 4).alias("ybar"), F.round("slope", 3).alias("slope"), F.round("xbar", 4).alias("xbar"))


@query("f8_trend_anomaly", "with s as (select dayofyear(valid_date)::int - 1 as doy, cell, avg(value) as ybar, avg(year(valid_date)) as xbar, avg(year(valid_date) * value) as xy, avg(year(valid_date) * year(valid_date)::double) as xx from obs group by 1, 2), l as (select *, case when xx - xbar * xbar > 1e-9 then (xy - xbar * ybar) / (xx - xbar * xbar) end as slope from s) select o.cell, year(valid_date)::int as year, round(avg(abs(value - (ybar + slope * (year(valid_date) - xbar)))), 3) as mean_abs from obs o join l on l.cell = o.cell and l.doy = dayofyear(valid_date) - 1 group by 1, 2")
def trend_anomaly(t: Tables) -> DataFrame:
    """F8: distance from the trend climatology's value at each valid day."""
    from ..functions.dates import doy_index
    from ..functions.maths import trend_value

    c = climate.trend_climatology(t.obs, ["cell"])
    o = t.obs.withColumn("doy", doy_index(F.col("valid_date"))).join(c, ["doy", "cell"]).withColumn("year", F.year("valid_date"))
    far = F.abs(F.col("value") - trend_value(F.col("ybar"), F.col("slope"), F.col("xbar"), F.col("year")))
    return rounded(o.groupBy("cell", "year").agg(F.avg(far).alias("mean_abs")), 3)


@query("a30_daily_mean", "select event_type, cast(valid_time as date) as valid_date, round(avg(value), 4) as value, count(value) as n from ev6 group by 1, 2 having count(value) = 4")
def daily_mean(t: Tables) -> DataFrame:
    """Means of days whose four six-hour values are all there."""
    return rounded(align.daily_mean(t.ev6, ["event_type"], strict=4))


@query("a31_block_mean", "with s as (select event_type, ((epoch(valid_time) - epoch(min(valid_time) over (partition by event_type))) / 3600)::int + 6 as lead_h, value from ev6) select event_type, floor((lead_h - 6) / 24)::int as block, round(avg(value), 4) as value, count(value) as n from s group by 1, 2")
def block_mean(t: Tables) -> DataFrame:
    """Lead steps of six hours in blocks of a day."""
    first = F.min("valid_time").over(Window.partitionBy("event_type"))
    hours = ((F.unix_timestamp("valid_time") - F.unix_timestamp(first)) / 3600).cast("int") + 6
    return rounded(align.block_mean(t.ev6.withColumn("lead_h", hours), ["event_type"], "lead_h"))


@query("a32_weekly_means", "with w as (select model, cell, ceil(lead_day / 7.0)::int as w, case when count(value) = count(*) then avg(value) end as value from fc group by 1, 2, 3), s as (select model, cell, 'week' || w as week, value from w union all select model, cell, case when w in (3, 4) then 'week3-4' else 'week5-6' end, case when count(value) = 2 then avg(value) end from w where w > 2 group by 1, 2, 3) select model, cell, week, round(value, 4) as value from s")
def weekly_means(t: Tables) -> DataFrame:
    """Strict weekly means and the means of two weeks."""
    return rounded(align.weekly_means(t.fc, ["model", "cell"]))


LOYO = "pairs as (select *, year(init_date)::int as year from weekly), per as (select year, model, week, cell, sum(fa - oa) as s, count(fa - oa) as c from pairs group by 1, 2, 3, 4), bias as (select year, model, week, cell, (sum(s) over g - s) / nullif(sum(c) over g - c, 0) as bias from per window g as (partition by model, week, cell))"


@query("a33_loyo_bias", f"with {LOYO} select year, model, week, cell, round(bias, 4) as bias from bias")
def loyo_bias(t: Tables) -> DataFrame:
    """Leave-one-year-out bias as total minus own."""
    return rounded(climate.leave_one_year_out(t.weekly.withColumn("year", F.year("init_date")), ["model", "week", "cell"]))


@query("a33_bias_corrected_rmse", f"with {LOYO} select model, week, round(sqrt(avg((fa - coalesce(bias, 0) - oa) ** 2)), 4) as rmse from pairs join bias using (year, model, week, cell) group by 1, 2")
def bias_corrected(t: Tables) -> DataFrame:
    """Weekly RMSE after the correction; an undefined bias counts as 0."""
    done = climate.remove_bias(t.weekly.withColumn("year", F.year("init_date")), ["model", "week", "cell"], fill=True)
    e = F.col("fa") - F.col("oa")
    return rounded(done.groupBy("model", "week").agg(F.sqrt(F.avg(e * e)).alias("rmse")))


@query("a34_sample_mean_removal", "with m as (select model, week, cell, month(init_date) as mo, fa - avg(fa) over g as fa, oa - avg(oa) over g as oa from weekly window g as (partition by month(init_date), model, week, cell)) select model, week, round(sqrt(avg(fa * fa)), 4) as f_sd, round(sqrt(avg(oa * oa)), 4) as o_sd from m group by 1, 2")
def sample_mean_removal(t: Tables) -> DataFrame:
    """Anomalies from each init month's own mean."""
    done = climate.remove_group_mean(t.weekly.withColumn("mo", F.month("init_date")), ["mo", "model", "week", "cell"], ["fa", "oa"])
    return rounded(done.groupBy("model", "week").agg(F.sqrt(F.avg(F.col("fa") * F.col("fa"))).alias("f_sd"), F.sqrt(F.avg(F.col("oa") * F.col("oa"))).alias("o_sd")))


@query("a35_year_bias", "select model, year(init_date)::int as year, week, round(avg(fa - oa), 4) as bias, count(*) as n from weekly group by 1, 2, 3")
def year_bias(t: Tables) -> DataFrame:
    """Mean error by init year."""
    return rounded(climate.year_bias(t.weekly.withColumn("year", F.year("init_date")), ["model", "year", "week"]))


@query("a36_source_consistency", "with s as (select valid_date, value from daily union all select valid_date, value + case when day(valid_date) = 1 then 0.01 else 0.0005 end from daily) select valid_date, round(case when max(value) - min(value) <= 1e-3 then avg(value) end, 4) as value, round(max(value) - min(value), 4) as gap from s group by 1")
def source_consistency(t: Tables) -> DataFrame:
    """The mean of two sources where they agree."""
    other = t.daily.withColumn("value", F.col("value") + F.when(F.dayofmonth("valid_date") == 1, 0.01).otherwise(0.0005))
    return rounded(climate.agreeing_mean(t.daily.unionByName(other), "valid_date", "value"))


@query("a37_meridional_mean", "select valid_date, lon, round(avg(value), 4) as value from obs join cells using (cell) where lat between -15 and 15 group by 1, 2")
def meridional_mean(t: Tables) -> DataFrame:
    """Mean over a latitude band."""
    return rounded(climate.meridional_mean(_located(t, t.obs), -15, 15, ["valid_date", "lon"]))


@query("a38_proxy_fill", "with x as (select cell, valid_date, value from obs where valid_date < date '2000-01-01'), p as (select cell, valid_date, value * value as value from obs), s as (select x.cell, avg(x.value * p.value) / greatest(var_pop(p.value), 1e-30) as scale from x join p using (cell, valid_date) group by 1), l as (select cell, max(valid_date) as last from x group by 1), u as (select * from x union all select p.cell, p.valid_date, p.value * scale from p join s using (cell) join l using (cell) where p.valid_date > last) select cell, count(*) as n, round(avg(value), 3) as value from u group by 1")
def proxy_fill(t: Tables) -> DataFrame:
    """A series carried on by a scaled proxy."""
    x = t.obs.where("valid_date < date '2000-01-01'")
    filled = climate.fill_by_proxy(x, t.obs.withColumn("value", F.col("value") * F.col("value")), ["cell"], "valid_date")
    return rounded(filled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value")), 3)
