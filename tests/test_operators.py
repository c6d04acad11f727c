"""Edge cases, and the properties that the definitions imply."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ensemblar.functions import dates, ensemble, maths
from ensemblar.operators import align, climate, indices, masks, regrid, resample, scores
from ensemblar.schema import nan_to_null
from ensemblar.sources import readers, sinks

DAY = dt.date


def case(spark, *rows):
    return spark.createDataFrame(rows, "xs array<double>, obs double, n int, n_all int, k int")


def test_nan_becomes_null(spark):
    df = nan_to_null(spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "v double, k int"))
    assert df.agg(F.avg("v"), F.count("v")).first() == (2.0, 1)


def test_crps_forms_agree_and_single_member_has_no_spread(spark):
    rng = np.random.default_rng(0)
    rows = [(sorted(rng.normal(size=n).tolist()), float(rng.normal()), n, n, n) for n in (1, 2, 5, 20)]
    df = case(spark, *rows)
    for a, b, n, err in df.select(ensemble.crps(F.col("xs"), F.col("obs")), ensemble.crps_pairwise(F.col("xs"), F.col("obs")), "n", F.abs(F.col("xs")[0] - F.col("obs"))).collect():
        assert a == pytest.approx(b, abs=1e-12)
        if n == 1:
            assert a == pytest.approx(err)


def test_crps_without_member_or_truth_is_null(spark):
    df = case(spark, ([], 1.0, 0, 1, 0), ([1.0], None, 1, 1, 1))
    assert [r[0] for r in df.select(ensemble.crps(F.col("xs"), F.col("obs"))).collect()] == [None, None]


def test_all_ties_give_a_flat_histogram(spark):
    df = case(spark, *[([1.0] * 3, 1.0, 3, 3, k) for k in range(4000)])
    counts = {r["rank"]: r["count"] for r in scores.rank_counts(df, [], ["k"]).collect()}
    assert set(counts) == {0, 1, 2, 3} and max(abs(c - 1000) for c in counts.values()) < 150


def test_rank_counts_hold_empty_ranks_and_diagnostics_are_zero_when_flat(spark):
    df = case(spark, ([1.0, 2.0], 0.0, 2, 2, 1), ([1.0, 2.0], 1.5, 2, 2, 2), ([1.0, 2.0], 3.0, 2, 2, 3), ([1.0], 0.5, 1, 2, 4))
    counts = scores.rank_counts(df, [], ["k"])
    assert sorted((r["rank"], r["count"]) for r in counts.collect()) == [(0, 1), (1, 1), (2, 1)]
    assert scores.rank_diagnostics(counts, ["n"]).select("ri", "delta", "bias").first() == (0.0, 0.0, 0.0)


def test_pearson_ignores_shifts_and_is_null_for_constants(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 1.0), ("a", 4.0, 5.0), ("b", 1.0, 2.0), ("b", 1.0, 3.0)], "k string, f double, o double")
    got = dict(df.groupBy("k").agg(scores.pearson(F.col("f"), F.col("o"))).collect())
    moved = dict(df.groupBy("k").agg(scores.pearson(F.col("f") + 7, F.col("o") - 3)).collect())
    assert got["b"] is None and moved["a"] == pytest.approx(got["a"]) == pytest.approx(np.corrcoef([1, 2, 4], [2, 1, 5])[0, 1])


def test_weighted_mean_renormalises_over_what_is_there(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 9.0), (3.0, 1.0)], "x double, w double")
    assert df.agg(scores.weighted_mean(F.col("x"), F.col("w"))).first()[0] == 2.0


def test_bias_of_two_years_is_the_others_and_of_one_year_null(spark):
    df = spark.createDataFrame([(2000, 1, 5.0, 3.0), (2001, 1, 5.0, 4.0), (2000, 2, 1.0, 0.0)], "year int, cell int, fa double, oa double")
    got = {(r.year, r.cell): r.bias for r in climate.leave_one_year_out(df, ["cell"]).collect()}
    assert got == {(2000, 1): 1.0, (2001, 1): 2.0, (2000, 2): None}


def test_leap_days_and_winter_years(spark):
    days = [DAY(2000, 2, 29), DAY(2000, 3, 1), DAY(2001, 3, 1), DAY(2000, 12, 31)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    assert [r[0] for r in df.select(dates.doy_index(F.col("d"))).collect()] == [59, 60, 59, 365]
    assert [r[0] for r in df.select(dates.winter_year(F.col("d"))).collect()] == [2000, 2000, 2001, 2001]
    assert df.select(dates.block_key(F.col("d"), "season")).collect()[3][0] == "2000-0"
    assert df.select(dates.valid_date(F.col("d"), F.lit(1))).collect()[3][0] == DAY(2001, 1, 1)


def test_normal_cdf_is_close_to_erf(spark):
    df = spark.createDataFrame([(x / 4,) for x in range(-16, 17)], "y double")
    for y, c in df.select("y", maths.normal_cdf(F.col("y"))).collect():
        assert c == pytest.approx((1 + math.erf(y / math.sqrt(2))) / 2, abs=2e-7)


def test_uniform_is_as_published(spark):
    assert spark.range(1).select(maths.uniform(F.lit(1), F.lit(2))).first()[0] == 0.6966761716175824


def test_strict_weeks(spark):
    rows = [(d, None if d == 9 else float(d)) for d in range(0, 43)]
    got = dict(align.weekly_means(spark.createDataFrame([("k", *r) for r in rows], "k string, lead_day int, value double"), ["k"]).select("week", "value").collect())
    assert got["week1"] == 4.0 and got["week2"] is None and got["week3-4"] == (18 + 25) / 2 and got["week5-6"] == (32 + 39) / 2


def test_nearest_time_takes_the_earlier_of_two_and_heeds_tolerance(spark):
    stamp = lambda d: dt.datetime(2000, 1, d)
    left = spark.createDataFrame([(1, stamp(5)), (1, stamp(20)), (2, stamp(5))], "cell int, time timestamp")
    right = spark.createDataFrame([(1, stamp(3), 3.0), (1, stamp(7), 7.0)], "cell int, time timestamp, value double")
    got = {(r.cell, r.time.day): r.matched for r in align.nearest_time(left, right, ["cell"], "time", 5 * 86400).collect()}
    assert got == {(1, 5): 3.0, (1, 20): None, (2, 5): None}


def test_pairs_use_each_partner_once(spark):
    a = spark.createDataFrame([(DAY(2000, 1, d),) for d in (1, 2, 3)], "init_date date")
    b = spark.createDataFrame([(DAY(2000, 1, d),) for d in (2, 4)], "init_date date")
    got = sorted((r[0].day, r[1].day) for r in align.pair_inits(a, b, 2).collect())
    assert got == [(2, 2), (3, 4)]
    near = sorted((r[0].day, r[1].day) for r in align.nearest_init(a, b, 1).select("ref_date", "other_date").collect())
    assert near == [(1, 2), (2, 2), (3, 2)]


def test_weights_of_a_constant_field_and_wrap():
    for axis in (regrid.linear_axis([0.0, 90.0, 180.0, 270.0], [315.0, 359.5, 0.5], 360.0), regrid.linear_axis([-60.0, 0.0, 60.0], [-90.0, 10.0, 90.0]), regrid.nearest_axis([0.0, 10.0], [4.0, 6.0])):
        for j in {r[1] for r in axis}:
            assert sum(w for _, k, w in axis if k == j) == pytest.approx(1)
    assert {(i, w) for i, j, w in regrid.linear_axis([0.0, 90.0, 180.0, 270.0], [315.0], 360.0)} == {(3, 0.5), (0, 0.5)}
    lat, lon = regrid.conservative_axes([(-90, 0), (0, 90)], [(-30, 90)], [(0, 180), (180, 360)], [(90, 270)])
    assert sum(w for *_, w in lat) == pytest.approx(1) and [w for *_, w in lon] == [0.5, 0.5]


def test_regrid_is_null_where_a_source_is_missing(spark):
    lat, lon = regrid.linear_axis([0.0, 1.0], [0.5]), regrid.nearest_axis([0.0], [0.0])
    df = spark.createDataFrame([(1, 0, 0, 1.0), (1, 1, 0, 3.0), (2, 0, 0, 1.0), (2, 1, 0, None), (3, 0, 0, 1.0), (4, 5, 0, 1.0), (4, 0, 9, 1.0)], "t int, ilat int, ilon int, value double")
    assert dict(regrid.regrid(df, lat, lon, ["t"]).select("t", "value").collect()) == {1: 2.0, 2: None, 3: None}
    assert regrid.regrid(df, [], lon, ["t"]).count() == regrid.regrid(df.limit(0), lat, lon, ["t"]).count() == 0


@pytest.mark.parametrize("tile", [1, 3, 16])
def test_gather_and_dot_equals_the_sum_over_pairs(spark, tile):
    rng = np.random.default_rng(6)
    ys, xs = [-75.0 + 15 * k for k in range(11)], [30.0 * k for k in range(12)]
    bounds = lambda start, step, n: [(start + step * k, start + step * (k + 1)) for k in range(n)]
    axes = [
        (regrid.linear_axis(ys, [-90.0 + 7 * k for k in range(26)]), regrid.linear_axis(xs, [11.0 * k for k in range(33)], 360.0)),
        regrid.conservative_axes(bounds(-82.5, 15.0, 11), bounds(-60.0, 20.0, 6), bounds(0.0, 30.0, 12), bounds(45.0, 70.0, 3)),
        (regrid.nearest_axis(ys, [40.0, -40.0]), regrid.nearest_axis(xs, [100.0, 20.0], 360.0)),
    ]
    field = {(t, i, j): None if rng.random() < 0.02 else float(rng.normal()) for t in range(3) for i in range(11) for j in range(12) if rng.random() > 0.03}
    rows = [(f"t{t}", i, j, v) for (t, i, j), v in field.items()] + [("t0", 4, 4, 1.0), ("t3", 0, 0, 1.0)]
    df = spark.createDataFrame(rows, "t string, ilat int, ilon int, value double").repartition(3)
    for lat, lon in axes:
        want = {}
        for t, i, j, v in rows:
            for a, y, p in lat:
                for b, x, q in lon:
                    if a == i and b == j:
                        want.setdefault((t, y, x), []).append((p * q, v))
        got = {(r.t, r.jlat, r.jlon): r.value for r in regrid.regrid(df, lat, lon, ["t"], tile).collect()}
        assert got.keys() == want.keys()
        for key, terms in want.items():
            whole = round(sum(w for w, _ in terms), 9) == 1 and all(v is not None for _, v in terms)
            assert got[key] == (pytest.approx(sum(w * v for w, v in terms)) if whole else None)


def test_stored_truth_is_not_shuffled(spark):
    """In the plan no exchange stands between the scan of a bucketed table and the join above it."""
    from ensemblar.sources import bucketed

    days = [(DAY(2000, 1, 1 + k), c, float(k * c)) for k in range(20) for c in range(5)]
    truth = bucketed.store_bucketed(spark.createDataFrame(days, "valid_date date, cell int, value double"), "truth_for_test", bucketed.TRUTH)
    fc = spark.createDataFrame([("A", DAY(2000, 1, 1), lead, c, n, float(n)) for lead in range(1, 15) for c in range(5) for n in range(3)], "model string, init_date date, lead_day int, cell int, number int, value double")
    cases = align.ensemble_cases(fc, truth.hint("merge"), ["model", "init_date", "lead_day", "cell"])
    lines = cases._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-*|"))
    (at,) = [k for k, line in enumerate(lines) if "FileScan" in line and "Bucketed: true" in line]
    above, level = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < level:
            level = depth(line)
            above.append(line)
            if "Join" in line:
                break
    assert "SortMergeJoin" in above[-1] and not any("Exchange" in line for line in above)
    assert cases.count() == 70 and truth.count() == 100
    # a table of the same name is replaced
    again = bucketed.store_bucketed(spark.createDataFrame(days[:3], "valid_date date, cell int, value double"), "truth_for_test", bucketed.TRUTH, buckets=2)
    assert again.count() == 3
    spark.sql("drop table truth_for_test")


def test_cubes_merge_to_the_scores_of_their_pairs(spark):
    from ensemblar.operators import cube

    rng = np.random.default_rng(10)
    rows = [("AB"[k % 2], DAY(2000, 1 + k % 12, 1 + k % 7), 1 + k % 5, float(rng.normal()), None if k % 31 == 0 else float(rng.normal()), float(1 + k % 3)) for k in range(400)] + [("C", DAY(2001, 1, 1), 1, 1.0, 2.0, 1.0)]
    pairs = spark.createDataFrame(rows, "model string, init_date date, lead_day int, f double, o double, w double").repartition(3)
    held = cube.score_cube(pairs, ["model", "init_date", "lead_day"], [("f", "o")], F.col("w"))
    for by in (["model"], ["model", "lead_day"], []):
        got = {tuple(r[c] for c in by): r for r in cube.scores_of(cube.merged(held, by)).collect()}
        for key, r in got.items():
            kept = [x for x in rows if x[4] is not None and dict(zip(("model", "lead_day"), (x[0], x[2]))).items() >= dict(zip(by, key)).items()]
            f, o, w = (np.array([x[k] for x in kept]) for k in (3, 4, 5))
            assert r.n == len(kept) and r.rmse == pytest.approx(np.sqrt(np.average((f - o) ** 2, weights=w))) and r.bias == pytest.approx(np.average(f - o, weights=w))
            if len(kept) > 1:
                assert r.acc == pytest.approx((w * f * o).sum() / np.sqrt((w * f * f).sum() * (w * o * o).sum()))
                m = lambda x, w=w: np.average(x, weights=w)
                assert r["cor"] == pytest.approx(m((f - m(f)) * (o - m(o))) / np.sqrt(m((f - m(f)) ** 2) * m((o - m(o)) ** 2)))
            else:
                assert r.acc is None and r["cor"] is None
    named = cube.subsets_of(held, {"winter": [12, 1, 2]}, 2)
    both = {d for d in {x[1] for x in rows} if len({x[0] for x in rows if x[1] == d and x[4] is not None}) == 2}
    assert {r.init_date for r in named.where("subset = 'common'").collect()} == both
    assert {r.init_date.month for r in named.where("subset = 'winter'").collect()} == {12, 1, 2}
    n = {(r.subset, r.model): r.n for r in cube.subset_cube(held, named, ["model"]).collect()}
    assert n["all", "A"] + n["all", "B"] + n["all", "C"] == sum(x[4] is not None for x in rows)


def test_stencils_on_a_large_grid(spark):
    rng = np.random.default_rng(11)
    lsm = np.clip(np.add.outer(np.sin(np.arange(180) / 7), np.cos(np.arange(360) / 11)) / 2 + 0.6 + rng.normal(0, 0.05, (180, 360)), 0, 1)
    there = rng.random((180, 360)) > 0.01
    mask = spark.createDataFrame([(i, j, float(lsm[i, j])) for i, j in zip(*(x.tolist() for x in np.nonzero(there)), strict=True)], "ilat int, ilon int, lsm double")
    field = np.where(there, lsm, np.inf)
    around = np.minimum.reduce([np.roll(np.vstack([field[:1], field, field[-1:]])[a : a + 180], b, axis=1) for a in range(3) for b in (-1, 0, 1)])
    want = set(zip(*(x.tolist() for x in np.nonzero(there & (lsm >= 0.9) & (around >= 0.6))), strict=True))
    got = masks.land_interior(mask, 180, 360, 0.9, 0.6)
    assert 1000 < len(want) and set(map(tuple, got.collect())) == want
    assert set(map(tuple, masks.land_interior(mask, 180, 360, 0.9, 0.6, tile=1).collect())) == want
    # cells grow by the rows beside tiles only
    copies = masks.haloed(mask, "lsm").agg(F.sum(F.size("cells"))).first()[0]
    assert copies == mask.count() + sum(int(there[i].sum()) for i in range(180) if i % 32 in (0, 31))
    missing = rng.random((180, 360)) < 0.02
    values = mask.select("ilat", "ilon", "lsm").join(spark.createDataFrame([(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(missing)), strict=True)], "ilat int, ilon int").withColumn("gone", F.lit(True)), ["ilat", "ilon"], "left")
    values = values.select("ilat", "ilon", F.when(F.col("gone").isNull(), F.col("lsm")).alias("value"))
    grown = {(i + a, j + b) for i, j in zip(*(x.tolist() for x in np.nonzero(missing & there)), strict=True) for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))}
    found = masks.dilated_missing(values).collect()
    assert set(map(tuple, found)) == grown and len(found) == len(grown)
    assert masks.dilated_missing(values.limit(0)).count() == 0


def test_segments_equal_windows_over_whole_series(spark):
    from pyspark.sql import Window

    from ensemblar.operators import segments

    rng = np.random.default_rng(9)
    rows = [(k, int(t), None if rng.random() < 0.1 else float(rng.normal())) for k, n in ((1, 900), (2, 3), (None, 40)) for t in rng.choice(5000, n, replace=False)]
    df = spark.createDataFrame(rows, "k int, t int, value double").repartition(5)
    w = Window.partitionBy("k").orderBy("t")
    numbers = segments.numbered_rows(df, ["k"], ["t"]).select("k", "t", "_at")
    assert sorted(map(tuple, numbers.collect()), key=str) == sorted(map(tuple, df.select("k", "t", F.row_number().over(w) - 1).collect()), key=str)
    for before, after, size in ((6, 0, 50), (0, 6, 7), (3, 4, 1), (20, 20, 100_000)):
        means = {"m": F.avg("value"), "n": F.count("value")}
        got = segments.rolling(df, ["k"], ["t"], before, after, means, size)
        want = df.withColumns({name: c.over(w.rowsBetween(-before, after)) for name, c in means.items()})
        both = [sorted(((r.k, r.t, r.n, None if r.m is None else round(r.m, 9)) for r in x.collect()), key=str) for x in (got, want)]
        assert both[0] == both[1]
    got = segments.carried(df.withColumn("value", F.when(F.col("t") % 97 < 3, F.col("value"))), ["k"], ["t"], F.when(F.col("value").isNotNull(), F.struct("t", "value")), 20)
    held = {k: sorted((t, v) for a, t, v in rows if a == k and v is not None and t % 97 < 3) for k in (1, 2, None)}
    for r in got.collect():
        last, after = [x for x in held[r.k] if x[0] <= r.t][-1:], [x for x in held[r.k] if x[0] >= r.t][:1]
        assert [tuple(x) for x in (r._last, r._next) if x is not None] == [*last, *after]
    assert segments.rolling(df.limit(0), ["k"], ["t"], 2, 0, {"m": F.avg("value")}).count() == 0
    # no segment has more than its rows and those beside it
    most = segments.segmented(df, ["k"], ["t"], 6, 2, 50).groupBy("_key", "_segment").count().agg(F.max("count")).first()[0]
    assert most <= 58


def test_eof_is_the_leading_singular_vector(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12, 5)) @ np.diag([5, 2, 1, 1, 1])
    rows = [(t, c, float(x[t, c])) for t in range(12) for c in range(5)]
    eof, share = indices.snapshot_eof(spark.createDataFrame(rows, "t int, cell int, value double"), "t", ["cell"])
    got = np.array([r.loading for r in eof.orderBy("cell").collect()])
    _, s, v = np.linalg.svd(x, full_matrices=False)
    assert abs(got @ v[0]) == pytest.approx(1) and share[0] == pytest.approx(s[0] ** 2 / (s**2).sum())


def test_combined_eof_is_the_covariances_eigenvector(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 6)) @ np.diag([4, 3, 1, 1, 0.5, 0.5])
    rows = [(t, c, float(x[t, c])) for t in range(30) for c in range(6)] + [(99, 0, 1.0)]
    eof, share = indices.combined_eof(spark.createDataFrame(rows, "t int, f int, value double"), "t", "f")
    got = np.array([[r.pc1, r.pc2] for r in eof.orderBy("f").collect()])
    values, vectors = np.linalg.eigh(np.cov(x.T))
    for m in (0, 1):
        assert abs(got[:, m] @ vectors[:, -1 - m]) == pytest.approx(1) and share[m] == pytest.approx(values[-1 - m] / values.sum())


@pytest.mark.parametrize("most_gram", [400, 10])
def test_patterns_over_many_times_equal_a_decomposition(spark, most_gram):
    rng = np.random.default_rng(3)
    times, cells = (2000, 120) if most_gram == 400 else (60, 40)
    x = rng.normal(size=(times, cells)) @ np.diag(1 + 3 / (1 + np.arange(cells))) + np.outer(np.sin(np.arange(times) / 9), rng.normal(size=cells))
    x[rng.random(x.shape) < 0.02] = 0  # those are left out
    at = np.nonzero(x)
    df = spark.createDataFrame(list(zip(at[0].tolist(), at[1].tolist(), x[at].tolist(), strict=True)) + [(0, 0, None)], "t int, cell int, value double")
    eof, shares = indices.snapshot_eof(df, "t", ["cell"], modes=3, most_gram=most_gram)
    _, s, v = np.linalg.svd(x, full_matrices=False)
    for m in range(3):
        got = np.array([r.loading for r in eof.where(f"mode = {m + 1}").orderBy("cell").collect()])
        assert abs(got @ v[m]) == pytest.approx(1, abs=1e-7) and np.linalg.norm(got) == pytest.approx(1) and shares[m] == pytest.approx(s[m] ** 2 / (s**2).sum())


def test_gram_needs_no_join_of_cells(spark):
    from ensemblar.operators import packed

    rng = np.random.default_rng(4)
    x = rng.normal(size=(7, 50))
    df = spark.createDataFrame([(t, c, float(x[t, c])) for t in range(7) for c in range(50)], "t int, cell int, value double").repartition(3)
    got = {(r.t, r.s): r.g for r in indices.gram(df, "t", ["cell"]).collect()}
    assert got == {(a, b): pytest.approx((x @ x.T)[a, b]) for a in range(7) for b in range(a, 7)}
    plan = packed.pack(df, ["cell"], "t", list(range(7)))._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join" in line]
    assert len(joins) == 1 and "BroadcastHashJoin [t#" in joins[0]
    with pytest.raises(ValueError):
        indices.gram(df, "t", ["cell"], most_times=6)
    # fewer cells than vectors that are iterated, and a rank below that
    low = spark.createDataFrame([(t, c, float(np.cos(t) * (c + 1))) for t in range(30) for c in range(3)], "t int, cell int, value double")
    eof, shares = indices.snapshot_eof(low, "t", ["cell"], modes=1, most_gram=5)
    assert shares[0] == pytest.approx(1) and eof.count() == 3


def test_table_sink_and_station_names(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5)], "a int, b double")
    sinks.write_table(df, str(tmp_path / "c"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()] == [("1", "2.5")]
    spark.createDataFrame([(1.0, 2.0, 3.0)], "latitude double, longitude double, rain double").write.parquet(str(tmp_path / "y1"))
    spark.createDataFrame([(1.0, 2.0, 4.0)], "lat double, lon double, rain double").write.parquet(str(tmp_path / "y2"))
    rows = readers.load_forecast("stations", spark, {2023: str(tmp_path / "y1"), 2024: str(tmp_path / "y2")}).collect()
    assert sorted((r.lat, r.lon, r.rain, r.year) for r in rows) == [(1.0, 2.0, 3.0, 2023), (1.0, 2.0, 4.0, 2024)]


def test_hindcast_years_without_a_leap_day_go(spark):
    df = spark.createDataFrame([(DAY(2024, 2, 29), [2020, 2021])], "base_date date, hindcast_years array<int>")
    assert [r.init_date for r in readers.fan_out(df).collect()] == [DAY(2020, 2, 29)]


def test_flat_files(spark, tmp_path):
    spark.createDataFrame([(1.0,)], "value double").coalesce(1).write.parquet(str(tmp_path / "w"))
    part = next((tmp_path / "w").glob("part*.parquet"))
    (tmp_path / "f").mkdir()
    part.rename(tmp_path / "f" / "x_2020010100_ens_7.parquet")
    (row,) = readers.load_forecast("flat_files", spark, str(tmp_path / "f")).collect()
    assert row.number == 7 and row.init_time == dt.datetime(2020, 1, 1)


def test_forecast_files_are_listed_before_they_are_read(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual, Not

    from ensemblar.sources import forecast_files

    frame = lambda v: spark.createDataFrame([(7, v, None), (8, float("nan"), "x")], "cell int, value double, note string")
    root = tmp_path / "flat"
    root.mkdir()
    for day, member in ((1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (3, 0)):
        frame(day + member / 10).coalesce(1).write.parquet(str(tmp_path / f"w{day}{member}"))
        next((tmp_path / f"w{day}{member}").glob("part*.parquet")).rename(root / f"run_202001{day:02}06_ens_{member}.parquet")
    (root / "run_2020010406_ens_0.parquet").write_text("not a table")  # nobody reads it
    (root / "notes.txt").write_text("no forecast")
    load = lambda **o: readers.load_forecast("forecast_files", spark, str(root), layout="flat_files", **o)
    jan = lambda day: F.lit(f"2020-01-{day:02}").cast("date")
    df = load()
    assert {c: t for c, t in df.dtypes} == {"cell": "int", "value": "double", "note": "string", "init_date": "date", "hour": "int", "number": "int"}
    kept = df.where((F.col("init_date") <= jan(2)) & F.col("number").isin(0, 2) & (F.col("hour") == 6))
    assert sorted((r.init_date.day, r.number, r.cell, r.value) for r in kept.where("cell = 7").collect()) == [(1, 0, 7, 1.0), (1, 2, 7, 1.2), (2, 0, 7, 2.0)]
    assert kept.rdd.getNumPartitions() == 2 and all(r.value is None for r in kept.where("cell = 8").collect())
    assert load(files_per_task="1").where(F.col("init_date") < jan(3)).rdd.getNumPartitions() == 5
    assert df.where((F.col("init_date") == jan(3)) & (F.col("number") != 0)).count() == 0
    assert df.where(F.col("init_date") == jan(9)).count() == 0
    with pytest.raises(Exception, match="Parquet|parquet|magic"):
        df.where(F.col("init_date") >= jan(4)).collect()
    # a schema of one's own, and a column that files lack
    own = spark.read.format("forecast_files").option("layout", "flat_files").schema("number int, more double, cell long").load(str(root)).where("number = 1")
    assert sorted((r.number, r.more, r.cell) for r in own.where("cell = 7").collect()) == [(1, None, 7), (1, None, 7)]
    for bad in ({"layout": "none"}, {"layout": "flat_files", "codec": "none"}):
        with pytest.raises(Exception, match="unknown"):
            spark.read.format("forecast_files").options(**bad).load(str(root)).count()
    files = forecast_files.listed(str(root), "flat_files")
    reader = forecast_files.ForecastReader(str(root), files, "parquet", own.schema, 64)
    given = [EqualTo(("value",), 1.0), GreaterThan(("number",), 0), Not(In(("number",), (2,))), IsNotNull(("init_date",)), LessThanOrEqual(("init_date",), dt.date(2020, 1, 2))]
    assert list(reader.pushFilters(given)) == given[:1]
    assert [[f.keys["number"] for f in p.files] for p in reader.partitions()] == [[1], [1]]


@pytest.mark.parametrize("codec", ["csv", "feather"])
def test_other_codecs_and_layouts(spark, tmp_path, codec):
    import pyarrow as pa
    import pyarrow.csv as pc
    import pyarrow.feather as pf

    table = pa.table({"cell": [1, 2], "value": [0.5, 1.5], "number": [99, 99]})
    for lead in (1, 2, 3):
        folder = tmp_path / "init_date=2021-03-01" / "number=4"
        folder.mkdir(parents=True, exist_ok=True)
        (pc.write_csv if codec == "csv" else pf.write_feather)(table, str(folder / f"lead_day={lead}.bin"))
    df = readers.load_forecast("forecast_files", spark, f"file://{tmp_path}", layout="nested", codec=codec, most_members=5).where("lead_day > 1")
    assert sorted((r.init_date, r.number, r.lead_day, r.cell, r.value) for r in df.collect()) == [(dt.date(2021, 3, 1), 4, k, c, c - 0.5) for k in (2, 3) for c in (1, 2)]
    assert df.where("number >= 5").count() == 0


def test_replicates_are_resamples(spark):
    """Every replicate against the rows drawn one by one: a correlation for each cell, then the region's weighted mean."""
    rng = np.random.default_rng(0)
    data = [(f"b{k % 4}", c, float(rng.normal()), float(rng.normal())) for k in range(40) for c in range(3)]
    data += [("b1", 3, 2.0, 1.0), ("b1", 3, 2.0, 3.0)]  # no variance
    df = spark.createDataFrame(data, "block string, cell int, fa double, oa double").withColumn("model", F.lit("A"))
    w = resample.draws(df, 5)
    drawn = {(r.replicate, r.block): r.weight for r in resample.weights(w).collect()}
    cells = spark.createDataFrame([(0, "all", 1.0), (1, "all", 0.5), (2, "all", 2.0), (3, "all", 9.0), (1, "one", 0.5), (3, "none", 1.0)], "cell int, region string, weight double")
    sums = resample.pair_sums(df, ["block", "model", "cell"], "fa", "oa")
    got = {(r.region, r.replicate): r.r for r in resample.replicate_regional_correlation(sums, w, ["model"], cells).collect()}
    assert len(got) == 18
    for k in range(6):
        each = {}
        for c in range(3):
            pairs = [(f, o) for b, cell, f, o in data if cell == c for _ in range(drawn.get((k, b), 0))]
            each[c] = np.corrcoef(np.array(pairs).T)[0, 1]
        assert got["all", k] == pytest.approx((each[0] + 0.5 * each[1] + 2 * each[2]) / 3.5)
        assert got["one", k] == pytest.approx(each[1]) and got["none", k] is None
    whole = resample.replicate_sums(sums, w, ["model", "cell"], ("n", "fo")).where("replicate = 0 and cell = 2").first()
    assert whole.n == 40 and whole.fo == pytest.approx(sum(f * o for _, c, f, o in data if c == 2))


def test_draws_are_multinomial_and_the_same_everywhere(spark):
    for blocks in (1, 2, 5, 12, 64, 100):
        counts = resample.draw_counts(9, 0, 1200, blocks).astype(int)
        assert (counts.sum(1) == blocks).all() and (counts[0] == 1).all()
        # any part of the replicates by itself
        assert (resample.draw_counts(9, 130, 193, blocks) == counts[130:194]).all()
        if blocks > 1:
            each = counts[1:]
            assert abs(each.mean(0) - 1).max() < 5 / np.sqrt(1200) and each.var() == pytest.approx(1 - 1 / blocks, rel=0.1)
            c = np.cov(each.T)
            assert c[0, blocks - 1] == pytest.approx(-1 / blocks, abs=0.15)
    df = spark.createDataFrame([(f"b{k:03}",) for k in range(40)] * 2 + [(None,)], "block string")
    got = [sorted(map(tuple, resample.weights(resample.draws(d, 90, seed=4)).collect())) for d in (df.coalesce(1), df.repartition(7))]
    assert got[0] == got[1] and sum(w for _, _, w in got[0]) == 91 * 40
    assert resample.weights(resample.draws(df.limit(0), 5)).count() == 0


def test_binomials_by_inversion():
    rng = np.random.default_rng(5)
    for n, p in ((1, 0.5), (7, 0.3), (40, 0.9), (3000, 0.02)):
        u = (np.arange(20_000) + 0.5) / 20_000
        got = resample.binomials(np.full(u.shape, n), p, u)
        assert (np.diff(got) >= 0).all() and got.mean() == pytest.approx(n * p, rel=2e-3) and got.var() == pytest.approx(n * p * (1 - p), rel=1e-2)
        exact = np.cumsum([np.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p)) for k in range(n + 1)])
        assert (got == np.searchsorted(exact, u).clip(max=n)).mean() > 0.9999
    mixed = rng.integers(0, 50, (30, 4))
    u = rng.random((30, 4))
    got = resample.binomials(mixed, 0.25, u)
    assert all(got[i, j] == resample.binomials(mixed[i : i + 1, j], 0.25, u[i : i + 1, j])[0] for i in range(30) for j in range(4)) and (got <= mixed).all()


def test_redrawn_events_have_the_exact_distribution(spark):
    groups = spark.createDataFrame([("x", 1, 4, 30), ("x", 3, 4, 10), ("y", 0, 5, 7), ("y", 5, 5, 3)], "bin string, a int, n int, cases int").repartition(3)
    got = resample.redrawn_events(groups, ["bin"], 4000, seed=2).toPandas()
    x, y = got[got.bin == "x"], got[got.bin == "y"]
    assert len(x) == len(y) == 4000 and (x.cases == 40).all() and (y.events == 3).all() and (y.cases == 10).all()
    assert x.events.mean() == pytest.approx(15, abs=0.2) and x.events.var() == pytest.approx(7.5, rel=0.1)


def test_skill_day_rules(spark):
    good = [("never", k, 0.9) for k in (1, 2, 3)] + [("low", k, 0.1) for k in (1, 2, 3)] + [("mid", 1, 0.8), ("mid", 2, 0.4), ("mid", 3, 0.6)]
    df = spark.createDataFrame(good, "k string, lead_day int, acc double")
    got = {rule: dict(scores.skill_day(df, ["k"], rule).collect()) for rule in ("before_drop", "first_below", "first_below_0", "last_above", "crossing")}
    assert got["before_drop"] == {"never": 3.0, "low": 0.0, "mid": 1.0}
    assert got["first_below"] == {"never": None, "low": 1.0, "mid": 2.0}
    assert got["first_below_0"] == {"never": None, "low": 0.0, "mid": 1.0}
    assert got["last_above"] == {"never": 3.0, "low": None, "mid": 3.0}
    assert got["crossing"] == {"never": 3.0, "low": 0.0, "mid": pytest.approx(1.75)}


def test_masks(spark):
    grid = spark.createDataFrame([(a, b, None if (a, b) == (0, 0) else 1.0) for a in range(3) for b in range(4)], "ilat int, ilon int, value double")
    assert {(0, 0), (1, 0), (0, 1), (-1, 0), (0, -1)} == {tuple(r) for r in masks.dilated_missing(grid).collect()}
    land = grid.select("ilat", "ilon", F.when((F.col("ilat") == 2) & (F.col("ilon") == 2), 0.2).otherwise(1.0).alias("lsm"))
    inner = {tuple(r) for r in masks.land_interior(land, 3, 4).collect()}
    assert (0, 0) in inner and (1, 1) not in inner and (2, 0) in inner and (2, 3) not in inner


def test_complete_runs_never_mix(spark):
    rows = [("new", 1, n) for n in (0, 1)] + [("old", 1, n) for n in (0, 1, 2)] + [("new", 2, n) for n in (0, 1, 2)]
    df = spark.createDataFrame(rows, "run string, init_date int, number int")
    assert {(r.run, r.init_date) for r in readers.complete_runs(df, 3).collect()} == {("old", 1), ("new", 2)}


def test_scores_are_replaced_at_once(spark, tmp_path):
    store = sinks.ScoreStore(spark, str(tmp_path / "s"))
    frame = lambda *rows: spark.createDataFrame(rows, "model string, crps double")
    seen = lambda: sorted((r.variant, r.model, r.crps) for r in store.read().collect())
    with pytest.raises(ValueError):
        store.read()
    assert store.publish(frame(("A", 1.0), ("B", 2.0)), "daily", ["model"]) == 1
    assert store.publish(frame(("A", 3.0)), "land / sea=1", ["model"]) == 2
    former = [("daily", "A", 1.0), ("daily", "B", 2.0), ("land / sea=1", "A", 3.0)]
    assert seen() == former and store.variants() == ["daily", "land / sea=1"]
    # a job that ends between write and commit, and one that fails within its write
    left = store.write(frame(("A", 9.0)), "daily", ["model"])
    with pytest.raises(Exception):  # noqa: B017
        store.publish(frame(("A", 1.0)).withColumn("crps", F.raise_error(F.lit("stopped")).cast("double")), "daily", ["model"])
    assert seen() == former and store.manifest()[0] == 2
    # a reader that began before a commit ends with what it began with
    before = store.read(["daily"])
    assert store.publish(frame(("C", 4.0)), "daily", ["model"]) == 3
    assert sorted(r.model for r in before.collect()) == ["A", "B"]
    assert seen() == [("daily", "C", 4.0), ("land / sea=1", "A", 3.0)]
    # two runs that count from the same moment on; one variant goes
    assert store.commit({"daily": left, "land / sea=1": None}) == 4 and seen() == [("daily", "A", 9.0)]
    for k in range(3):
        store.publish(frame(("D", float(k))), "daily", ["model"])
    assert store.vacuum() >= 3 and seen() == [("daily", "D", 2.0)]
    assert store.read(["daily"]).count() == 1
    with pytest.raises(ValueError):
        store.read(["weekly"])


def test_commits_that_meet_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    stores = [sinks.ScoreStore(spark, str(tmp_path / "s")) for _ in range(6)]
    with ThreadPoolExecutor(6) as pool:
        versions = list(pool.map(lambda k: [stores[k].commit({f"v{k}-{n}": "x"}) for n in range(5)], range(6)))
    assert sorted(v for vs in versions for v in vs) == list(range(1, 31)) and len(stores[0].variants()) == 30


def test_loaders(spark, tmp_path):
    rows = [(DAY(2000, 1, 1), s, m, float(s + m)) for s in (3, 8) for m in (0, 1)]
    spark.createDataFrame(rows, "init_date date, seed int, member int, value double").write.partitionBy("init_date", "seed").parquet(str(tmp_path / "f"))
    assert sorted(r.number for r in readers.load_forecast("seed_dirs", spark, str(tmp_path / "f"), most_members=3).collect()) == [0, 1, 2]
    with pytest.raises(ValueError, match="unknown format"):
        readers.load_forecast("grib", spark)


def test_big_variable_map_is_refused(spark):
    with pytest.raises(ValueError, match="more than"):
        align.scale_units(spark.range(1).withColumn("value", F.lit(1.0)), spark.range(5).withColumn("s", F.lit(1.0)), "s", ["id"], most_rows=3)


def test_fields_lose_the_mean_error_of_other_years(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows, truth = [], []
    for year in (2001, 2002, 2003):
        for day in (1, 2):
            for cell in (0, 1):
                value = None if (year, cell) == (2003, 1) else float(rng.normal())
                truth.append((f"{year}-01-0{day}", cell, value))
                rows += [(f"{year}-01-0{day}", cell, n, float(rng.normal())) for n in (0, 1)]
    fc = spark.createDataFrame(rows, "init_date string, cell int, number int, value double").withColumn("init_date", F.col("init_date").cast("date"))
    obs = {(d, c): v for d, c, v in truth}
    mean = {}
    for d, c, _, v in rows:
        mean.setdefault((d, c), []).append(v)
    cases = spark.createDataFrame([(d, c, float(np.mean(v)), obs[d, c]) for (d, c), v in mean.items()], "init_date string, cell int, mean double, obs double").withColumn("init_date", F.col("init_date").cast("date"))
    got = {(str(r.init_date), r.cell, r.number): r.value for r in climate.correct_fields(fc, cases, ["cell"]).collect()}
    assert len(got) == len(rows)
    for d, c, n, v in rows:
        errors = [np.mean(m) - obs[e, k] for (e, k), m in mean.items() if k == c and e[:4] != d[:4] and obs[e, k] is not None]
        assert abs(got[d, c, n] - (v - np.mean(errors))) < 1e-9


def test_weighted_acc_takes_each_mean_over_its_own_cells(spark):
    import numpy as np

    f, o, w = [1.0, 2.0, -1.0, None], [2.0, None, -3.0, 4.0], [1.0, 0.5, 0.7, 0.2]
    df = spark.createDataFrame(list(zip(f, o, w, strict=True)), "f double, o double, w double")
    got = df.agg(scores.weighted_acc(F.col("f"), F.col("o"), F.col("w")).alias("x")).first().x
    mean = lambda x: np.average([a for a in x if a is not None], weights=[b for a, b in zip(x, w, strict=True) if a is not None])
    both = [None if a is None or b is None else a * b for a, b in zip(f, o, strict=True)]
    square = lambda x: [None if a is None else a * a for a in x]
    assert abs(got - mean(both) / np.sqrt(mean(square(o))) / np.sqrt(mean(square(f)))) < 1e-12


def test_every_region_holds_its_cells(spark):
    from ensemblar.operators import masks

    cells = spark.createDataFrame([(i * 4 + j, i, j, -75.0 + 30 * i, 90.0 * j) for i in range(6) for j in range(4)], "cell int, ilat int, ilon int, lat double, lon double")
    share = {(i, j): 1.0 if i >= 2 else 0.0 for i in range(6) for j in range(4)}
    mask = spark.createDataFrame([(i, j, v) for (i, j), v in share.items()], "ilat int, ilon int, lsm double")
    got = {}
    for r in masks.all_regions(cells, mask, 6, 4).collect():
        got.setdefault(r.region, []).append(r.cell)
    assert {k: len(v) for k, v in got.items()} == {"global": 24, "tropics": 8, "NH": 8, "SH": 8, "extratropics": 16, "land": 16, "ocean": 8, "land_interior": 12}
    assert all(len(set(v)) == len(v) for v in got.values())


def test_loaders_turn_nan_into_null(spark, tmp_path):
    spark.createDataFrame([(1, float("nan")), (2, 3.0)], "lead_day int, value double").write.parquet(str(tmp_path / "n"))
    got = readers.load_forecast("nested", spark, str(tmp_path / "n")).collect()
    assert {r.lead_day: r.value for r in got} == {1: None, 2: 3.0}


def test_a_second_run_of_a_stream_takes_new_files_only(spark, tmp_path):
    import datetime

    from ensemblar.streaming import accumulate

    day = datetime.date(2020, 1, 1)
    schema = "model string, init_date date, lead_day int, cell int, number int, value double"
    truth = spark.createDataFrame([(day + datetime.timedelta(k), 0, 1.5) for k in range(9)], "valid_date date, cell int, value double")
    keys = ["model", "init_date", "lead_day", "cell"]

    def run(rows):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = accumulate.forecast_stream(spark, str(tmp_path / "in"), schema)
        accumulate.run_available(stream, str(tmp_path / "c"), str(tmp_path / "out"), lambda df: accumulate.rank_counts(df, truth, keys, ["model"]))
        return sum(r["count"] for r in accumulate.summed(spark, str(tmp_path / "out"), ["model", "n", "rank"]).collect())

    member = lambda k: [("A", day + datetime.timedelta(k), 1, 0, n, float(n)) for n in range(3)]
    assert run(member(0) + member(1)) == 2
    assert run([]) == 2
    assert run(member(2)) == 3


def test_inits_in_pieces_are_ranked_once_and_whole(spark, tmp_path):
    import datetime
    import os

    from ensemblar.streaming import accumulate

    day = datetime.date(2020, 1, 1)
    schema = "model string, init_date date, lead_day int, cell int, number int, value double, rows int"
    truth = spark.createDataFrame([(day + datetime.timedelta(k), c, 2.5) for k in range(30) for c in range(2)], "valid_date date, cell int, value double")
    keys = ["model", "init_date", "lead_day", "cell"]
    row = lambda k, lead, c, n: ("A", day + datetime.timedelta(k), lead, c, n, float(n) + 0.1 * lead, 12)
    init = lambda k: [row(k, lead, c, n) for lead in (1, 2) for c in (0, 1) for n in range(3)]
    began = 1_700_000_000

    def run(rows, days):
        """One file, ``days`` after the first, and what has been counted then: (rank, count)."""
        name = f"{days}-{os.urandom(4).hex()}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
        (tmp_path / "in").mkdir(exist_ok=True)
        part = next((tmp_path / name).glob("part*.parquet"))
        part.rename(tmp_path / "in" / f"{name}.parquet")
        os.utime(tmp_path / "in" / f"{name}.parquet", (began + days * 86_400,) * 2)
        held = accumulate.whole_inits(accumulate.forecast_stream(spark, str(tmp_path / "in"), schema), ["model", "init_date"], ["lead_day", "cell", "number"], "rows", wait_days=3)
        accumulate.run_available(held, str(tmp_path / "c"), str(tmp_path / "out"), lambda df: df)
        seen = sinks.ScoreStore(spark, str(tmp_path / "out")).read().drop("variant")
        assert seen.count() == seen.select(*keys, "number").distinct().count()
        ranks = accumulate.rank_counts(seen, truth, keys, ["model"]).where("n = 3").agg(F.sum("count")).first()[0]
        return ranks or 0, seen.where("not whole").count()

    first, second, third = init(0), init(1), init(2)
    assert run(first[:5] + second[7:], 0) == (0, 0)
    assert run(second[:7] + first[9:], 0) == (4, 0)  # the second init is whole
    assert run(second + first[:3], 1) == (4, 0)  # a file that comes again
    assert run(first[3:10], 1) == (8, 0)  # and overlaps: the first is whole
    assert run(third[:4], 2) == (8, 0)
    # nothing more of the third; the timer ends its wait when a much later file has come
    assert run(init(3), 40) == (13, 4)  # one of its cases has all three members
    assert run(third[4:], 41)[1] == 4
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_first_inits_and_gaps_by_key(spark):
    import datetime

    from ensemblar.operators import align

    day = lambda k: datetime.date(2020, 1, k)
    df = spark.createDataFrame([("A", day(k), n) for k in (1, 2, 5) for n in (0, 1)] + [("B", day(9), 0)], "model string, init_date date, number int")
    assert sorted((r.model, r.init_date.day, r.number) for r in align.first_inits(df, 2, ["model"]).collect()) == [("A", 1, 0), ("A", 1, 1), ("A", 2, 0), ("A", 2, 1), ("B", 9, 0)]
    assert [(r.model, r.gap_start.day) for r in align.gaps(df, "init_date", ["model"]).collect()] == [("A", 3)]
    assert [r.gap_start.day for r in align.gaps(df, "init_date").orderBy("gap_start").collect()] == [3, 6]
