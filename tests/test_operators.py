"""Hand values for single operators."""
import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from squallframe.functions import composites as X
from squallframe.functions import scalar as S
from squallframe.functions import stats
from squallframe.functions import thermo as T
from squallframe.operators import cleaning as C
from squallframe.operators import joins as J
from squallframe.operators import learn as L
from squallframe.operators import mapping as M
from squallframe.operators import profile as P
from squallframe.operators import resample as R
from squallframe.operators import sequence as E
from squallframe.operators import skill as K
from squallframe.operators import space as O
from squallframe.operators import trends as N


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def ts(text):
    return dt.datetime.fromisoformat(text)


def test_mass_weighted_mean(spark):
    rows = [("a", 1, 1000.0, 0.0, 1.0), ("a", 2, 900.0, 900.0, 3.0), ("a", 3, 800.0, 2000.0, 5.0)]
    up = P.prepare(spark.createDataFrame(rows, "c string, lev int, p double, z double, v double"), ["c"], ["v"])
    got = up.groupBy("c").agg(
        P.mass_mean("v", P.between_heights(0.0, 5000.0)).alias("all"), P.mass_mean("v", P.between_heights(800.0, 1000.0)).alias("one"),
        P.mass_mean("v", P.between_heights(9000.0, 9900.0)).alias("none"),
    ).first()
    assert (got["all"], got["one"], got["none"]) == (pytest.approx(3.0), 3.0, None)


def test_interpolation_rules(spark):
    rows = [("a", 1, 1000.0, 10.0, 20.0), ("a", 2, 900.0, 1000.0, 10.0), ("a", 3, 800.0, 2000.0, 6.0)]
    up = P.prepare(spark.createDataFrame(rows, "c string, lev int, p double, z double, v double"), ["c"], ["v"])
    got = up.groupBy("c").agg(
        P.at_height("v", 0.0).alias("low"), P.at_height("v", 1000.0).alias("exact"), P.at_height("v", 1500.0).alias("mid"),
        P.at_height("v", 9000.0).alias("out"), P.at_height("v", 9000.0, clamp_top=True).alias("top"), P.at_pressure("v", 850.0).alias("p"),
        P.height_of("v", 8.0).alias("h"),
    ).first()
    assert got.asDict() == {"c": "a", "low": 20.0, "exact": 10.0, "mid": 8.0, "out": None, "top": 6.0, "p": 8.0, "h": 1500.0}


def test_surface_row_ties_put_the_last_index_first(spark):
    lv = spark.createDataFrame([("a", 1, 950.0), ("a", 2, 900.0)], "c string, lev int, p double")
    sfc = spark.createDataFrame([("a", 950.0)], "c string, p double")
    rows = P.insert_surface(lv, sfc, ["c"]).select("lev", F.row_number().over(P.column_window(["c"], "lev")).alias("k"))
    assert [r["lev"] for r in sorted(rows.collect(), key=lambda r: r["k"])] == [1, 0, 2]


def test_sweep_scores_and_strict_rule(spark):
    df = spark.createDataFrame([("p", 1.0, 0), ("p", 2.0, 0), ("p", 3.0, 1), ("p", 4.0, 1)], "param string, value double, event int")
    c = {r["threshold"]: r for r in K.threshold_counts(df, ["param"], "value", "event", 4, top=1.0).collect()}
    assert {t: (r["hits_gt"], r["fa_gt"], r["hits_lt"], r["fa_lt"]) for t, r in c.items()} == {
        1.0: (2, 1, 0, 0), 2.0: (2, 0, 0, 1), 3.0: (1, 0, 0, 2), 4.0: (0, 0, 1, 2)
    }
    best = K.best_thresholds(df, ["param"], "value", "event", "pss", 4).first()
    assert best["score"] == 1.0 and 2.0 <= best["threshold"] < 3.0


def test_sweep_of_a_constant_and_without_events(spark):
    flat = spark.createDataFrame([("p", 5.0, 0), ("p", 5.0, 1)], "param string, value double, event int")
    assert {(r["hits_gt"], r["hits_lt"]) for r in K.threshold_counts(flat, ["param"], "value", "event", 5).collect()} == {(0, 0)}
    none = spark.createDataFrame([("p", 1.0, 0), ("p", 2.0, 0)], "param string, value double, event int")
    assert K.best_thresholds(none, ["param"], "value", "event", "hss").first()["score"] == -1.0


def test_hss_stays_in_range(spark):
    rows = [(h, 20 - h, f, 30 - f) for h in range(0, 21, 5) for f in range(0, 31, 5)]
    df = spark.createDataFrame(rows, "h int, m int, f int, c int").select(K.hss("h", "m", "f", "c").alias("s"))
    assert all(r["s"] is None or -1 <= r["s"] <= 1 for r in df.collect())


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0), (2.0, 1), (3.0, 1)], "value double, event int")
    assert K.auc(df, []).first()["auc"] == pytest.approx(0.875)


def test_hourly_spikes(spark):
    rows = [("s", ts("2020-01-01 00:00"), 10.0), ("s", ts("2020-01-01 01:00"), 45.0), ("s", ts("2020-01-01 02:00"), 12.0)]
    rows += [("t", ts("2020-01-01 00:00"), 10.0), ("t", ts("2020-01-01 01:00"), 45.0), ("t", ts("2020-01-01 02:00"), 25.0)]
    out = E.fix_hourly_spikes(spark.createDataFrame(rows, "k string, time timestamp, v double"), ["k"], "time", "v")
    assert {(r["k"], r["time"].hour): r["v"] for r in out.collect()}[("s", 1)] == 11.0
    assert {(r["k"], r["time"].hour): r["v"] for r in out.collect()}[("t", 1)] == 45.0


def test_spatial_spike_uses_the_median_without_wrap(spark):
    rows = [(0, i, j, 10.0 + i) for i in range(3) for j in range(3)]
    rows[4] = (0, 1, 1, 50.0)
    out = E.fix_spatial_spikes(spark.createDataFrame(rows, "t int, i int, j int, v double"), ["t"], "i", "j", "v")
    got = {(r["i"], r["j"]): r["v"] for r in out.collect()}
    assert got[(1, 1)] == 11.0 and got[(0, 0)] == 10.0


def test_ambiguous_local_time_takes_the_next_offset(spark):
    rows = [("s", ts("2018-03-31 12:00")), ("s", ts("2018-04-01 02:30")), ("s", ts("2018-04-02 12:00"))]
    df = spark.createDataFrame(rows, "stn string, local timestamp")
    out = E.to_utc(df, ["stn"], ["local"], "local", F.lit("Australia/Sydney"), "utc")
    got = {r["local"]: r["utc"] for r in out.collect()}
    assert got[ts("2018-03-31 12:00")] == ts("2018-03-31 01:00")
    assert got[ts("2018-04-01 02:30")] == ts("2018-03-31 16:30")


def test_rounding_of_half_hours_is_even(spark):
    df = spark.createDataFrame([(ts("2020-01-01 00:30"),), (ts("2020-01-01 01:30"),)], "t timestamp")
    assert [r[0].hour for r in df.select(S.round_time("t", 3600)).collect()] == [0, 2]


def test_gev_return_level(spark):
    level = M.gev_return_level(F.lit(0.1), F.lit(20.0), F.lit(3.0), F.lit(20.0))
    assert one(spark, level) == pytest.approx(20 + 30 * (1 - (-math.log(0.95)) ** 0.1), rel=1e-12)
    assert one(spark, level) == pytest.approx(27.709, abs=1e-3)
    assert one(spark, M.gev_return_level(F.lit(0.1), F.lit(20.0), F.lit(3.0), F.lit(1.0))) is None


def test_return_levels_grow_with_the_period(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (21, 25, 19, 30, 27, 22, 24, 28, 26, 23)], "k string, v double")
    fit = M.gev_by_l_moments(df, ["k"], "v").withColumn("T", F.explode(F.array(*[F.lit(float(t)) for t in (2, 5, 10, 50)])))
    levels = [r["x"] for r in sorted(fit.select("T", M.gev_return_level("c", "loc", "scale", "T").alias("x")).collect())]
    assert levels == sorted(levels) and len(set(levels)) == 4


def test_weibull_fit_recovers_a_large_sample(spark):
    n, c, loc, scale = 4000, 1.8, 10.0, 4.0
    rows = [("a", loc + scale * (-math.log(1 - (i + 0.5) / n)) ** (1 / c)) for i in range(n)]
    r = M.weibull_by_l_moments(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").first()
    assert (r["c"], r["loc"], r["scale"]) == (pytest.approx(c, rel=0.02), pytest.approx(loc, rel=0.02), pytest.approx(scale, rel=0.02))


def test_gamma_and_student(spark):
    for x in (0.7, 1.0, 2.5, 5.0):
        assert one(spark, stats.gamma(F.lit(x))) == pytest.approx(math.gamma(x), rel=1e-12)
    # two-sided tails: t(1) has a closed form, t = 2.228 at 10 degrees is the 5 % point
    df = spark.createDataFrame([(1.0, 1.0), (2.2281388519649385, 10.0), (0.0, 7.0), (None, 3.0)], "t double, d double")
    got = [r["p"] for r in df.select(stats.student_two_sided("t", "d").alias("p")).collect()]
    assert got[0] == pytest.approx(0.5, abs=1e-10) and got[1] == pytest.approx(0.05, abs=1e-9)
    assert got[2] == pytest.approx(1.0) and got[3] is None


def test_regrid_of_a_plane_is_exact_and_edges_are_absent(spark):
    src = spark.createDataFrame([(float(y), float(x), 2.0 * y + 3.0 * x) for y in range(3) for x in range(3)], "lat double, lon double, v double")
    tgt = spark.createDataFrame([(0.5, 0.25), (1.0, 2.0), (1.7, 1.1), (2.5, 1.0)], "lat double, lon double")
    out = O.regrid(src, O.bilinear_weights(src, tgt), [], "v").collect()
    assert {(r["lat"], r["lon"]) for r in out} == {(0.5, 0.25), (1.0, 2.0), (1.7, 1.1)}
    assert all(r["v"] == pytest.approx(2 * r["lat"] + 3 * r["lon"]) for r in out)
    holed = src.withColumn("v", F.when((F.col("lat") == 1) & (F.col("lon") == 1), None).otherwise(F.col("v")))
    got = {(r["lat"], r["lon"]): r["v"] for r in O.regrid(holed, O.bilinear_weights(src, tgt), [], "v").collect()}
    assert got[(0.5, 0.25)] is None and got[(1.0, 2.0)] == 8.0


def test_derivative_of_a_plane_is_constant(spark):
    rows = [(0, i, j, float(i), float(j), 2.0 * i + 3.0 * j) for i in range(3) for j in range(4)]
    df = spark.createDataFrame(rows, "t int, i int, j int, y double, x double, f double")
    got = P.derivative(P.derivative(df, ["t", "i"], "j", "x", ["f"], "dx"), ["t", "j"], "i", "y", ["f"], "dy").collect()
    assert all(r["f_dx"] == pytest.approx(3.0) and r["f_dy"] == pytest.approx(2.0) for r in got)


def test_point_in_square(spark):
    edges = O.polygon_edges(spark, {1: [(0, 0), (1, 0), (1, 1), (0, 1)]})
    cells = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.5, 1.5), (3, -0.1, 0.5), (4, 0.99, 0.01)], "id int, lat double, lon double")
    assert {r["id"]: r["region_id"] for r in O.tag_regions(cells, edges, ["id"]).collect()} == {1: 1, 4: 1}


def test_near_pairs_match_brute_force(spark):
    a = [(i, -40.0 + 3.7 * i, 110.0 + 5.1 * i) for i in range(10)] + [(90, 10.0, 179.9)]
    b = [(i, -41.0 + 0.9 * (i % 40), 109.0 + 1.3 * (i // 4)) for i in range(160)] + [(900, 10.2, -179.8)]
    da, db = spark.createDataFrame(a, "a int, lat double, lon double"), spark.createDataFrame(b, "b int, lat double, lon double")

    def km(p, q):
        y1, x1, y2, x2 = map(math.radians, (p[1], p[2], q[1], q[2]))
        h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
        return 2 * 6373.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    for limit in (50.0, 300.0):
        want = {(p[0], q[0]) for p in a for q in b if km(p, q) < limit}
        assert {(r["a"], r["b"]) for r in J.near_pairs(da, db, limit).collect()} == want
        assert (90, 900) in want


def test_nearest_cell_takes_the_first_on_ties(spark):
    st = spark.createDataFrame([("x", 0.5, 0.5), ("far", 70.0, -100.0)], "s string, lat double, lon double")
    grid = spark.createDataFrame([(i, j, float(i), float(j)) for i in range(3) for j in range(3)], "i int, j int, lat double, lon double")
    got = {r["s"]: (r["i"], r["j"]) for r in J.nearest_cells(st, grid, "s").collect()}
    assert got == {"x": (0, 0), "far": (2, 0)}


def test_range_check_fails_the_job(spark):
    df = spark.createDataFrame([(5.0,), (500.0,)], "z double")
    with pytest.raises(Exception, match="outside"):
        df.select(C.checked_range("z", 0.0, 100.0)).collect()


def test_nan_gust_is_no_event(spark):
    df = spark.createDataFrame([(float("nan"), 5), (30.0, 5), (None, 5)], "wind_gust double, lightning int")
    clean = df.withColumn("wind_gust", S.nan_to_null("wind_gust"))
    assert [r[0] for r in clean.select(C.event_label()).collect()] == [0, 1, 0]


def test_composites_clamp(spark):
    v = lambda *x: [F.lit(float(i)) for i in x]
    assert one(spark, X.scp(*v(2000, 100, 9))) == 0.0 and one(spark, X.scp(*v(2000, 100, 40))) == pytest.approx(4.0)
    assert one(spark, X.stp_cin(*v(1500, 900, 150, 31, 40))) == pytest.approx(1.5)
    assert one(spark, X.windex(*v(1000, 1, 1, 30))) == 0.0
    assert one(spark, X.wmpi(*v(1000, 1, 1, 30))) is None
    assert one(spark, X.dcp(*v(980, 2000, 20, 16), "ms")) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        S.in_box("lat", "lon", "nowhere")


def test_thermodynamics(spark):
    assert one(spark, T.dewpoint_from_rh(F.lit(20.0), F.lit(100.0))) == pytest.approx(20.0)
    assert one(spark, T.dewpoint_from_rh(F.lit(20.0), F.lit(0.0))) == -85.0
    assert one(spark, T.barometric_height(F.lit(0.0), F.lit(288.15), F.lit(101325.0), T.barometric_pa(F.lit(101325.0), F.lit(288.15), F.lit(1500.0)))) == pytest.approx(1500.0)
    assert one(spark, T.temperature_from_theta_k(T.theta_k(F.lit(290.0), F.lit(85000.0)), F.lit(85000.0))) == pytest.approx(290.0)
    assert one(spark, T.vapour_from_mixing_pa(T.mixing_ratio_pa(F.lit(1500.0), F.lit(90000.0)), F.lit(90000.0))) == pytest.approx(1500.0)
    assert one(spark, T.vapour_pressure_pa(F.lit(-10.0), ice=True)) < one(spark, T.vapour_pressure_pa(F.lit(-10.0)))
    assert one(spark, T.moist_lapse_per_pa(F.lit(280.0), F.lit(85000.0))) < 0
    assert 300 < one(spark, T.theta_e_holton_k(F.lit(290.0), F.lit(90000.0), F.lit(1200.0))) < 360
    assert one(spark, T.theta_v_k(F.lit(290.0), F.lit(90000.0), F.lit(1200.0))) > one(spark, T.theta_k(F.lit(290.0), F.lit(90000.0)))


def test_scoring_many_models_is_one_small_plan(spark):
    rows = [(i, float(i % 7), None if i % 11 == 0 else float(i % 5), int(i % 3 == 0)) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, a double, b double, e int")
    splits = [F.col("id") % 4 != k for k in range(4)]
    models = [L.Model(("a",), (0.3,), -0.5), *[L.Model(("a", "b"), (0.1, 0.2 * k), -0.4) for k in range(3)]]
    got = {(r["fit"], r["i"]): tuple(r)[2:] for r in L.probability_counts(df, "e", models, splits).collect()}
    long = L._tests(df, "e", [({"fit": k}, splits[k], m) for k, m in enumerate(models)])
    want = K.threshold_counts(long, ["fit"], "value", "event", L.PROB_STEPS, limits=(0.0, 1.0)).collect()
    assert got == {(r["fit"], r["i"]): tuple(r)[2:] for r in want}
    size = lambda sets: len(L.cross_validate_sets(df, sets, "e", splits)._jdf.queryExecution().analyzed().toString())
    assert size([["a"], ["b"], ["a", "b"]]) < 1.5 * size([["a"]])


def test_cutoffs_hold_the_exact_share(spark, monkeypatch):
    monkeypatch.setattr(L, "CUT_BINS", 8)
    df = spark.range(200).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("e"))
    for s, train in enumerate(L.stratified_splits(df, "id", "e", 3)):
        kept = {r["e"]: r["count"] for r in df.where(train).groupBy("e").count().collect()}
        assert kept == {1: 53, 0: 106}, s


def test_welch_of_equal_values_in_partitions(spark):
    # partial variances of 49 ones each used to merge to more than zero, so that t was 0 and p 1 in place of null
    ones = spark.range(0, 49 * 6, 1, 6).select(F.lit("k").alias("k"), F.lit(1.0).alias("n"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("side"))
    skewed = spark.range(0, 49 * 6, 1, 6).select(F.lit("m").alias("k"), F.lit(1.0).alias("n"), F.lit("a").alias("side"))
    both = ones.unionByName(skewed).unionByName(skewed.withColumn("side", F.lit("b")))
    assert [(r["t"], r["dof"], r["p"]) for r in N.welch(both, ["k"], "n", "side").collect()] == [(None, None, None)] * 2


def test_welch_needs_two_rows_a_side(spark):
    df = spark.createDataFrame([("x", "a", 1.0), ("x", "b", 2.0), ("x", "b", 4.0)], "k string, side string, n double")
    r = N.welch(df, ["k"], "n", "side").first()
    assert r["change"] == 2.0 and r["p"] is None


def test_bootstrap_is_reproducible_and_null_without_data(spark):
    rows = [("x", "a" if i < 20 else "b", i, float(i % 7)) for i in range(40)] + [("y", "a", i, 1.0) for i in range(5)] + [("z", s, i, float(i)) for s in "ab" for i in range(5)]
    df = spark.createDataFrame(rows, "k string, half string, o int, v double")
    a, b = ({r["k"]: r["p"] for r in N.bootstrap_mean_test(d, ["k"], "half", "o", "v", 50).collect()} for d in (df, df.repartition(7)))
    assert a == b and a["y"] is None and a["z"] == pytest.approx(1.0, abs=1.0)


def test_logistic_fit_separates_and_reproduces(spark):
    rows = [(i, float(i % 10), float((i * 7) % 13), 1 if (i % 10) + (i * 7) % 13 / 13 > 6.5 else 0) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double, e int")
    m = L.balanced_fit(df, ["a", "b"], "e")
    assert m.coefs[0] > 0 and m == L.balanced_fit(df, ["a", "b"], "e")
    assert L.full_sample_hss(df, m, "e")[0] > 0.8
    train = L.stratified_splits(df, "id", "e", 2)[0]
    n = {r["e"]: r["n"] for r in df.where(train).groupBy("e").agg(F.count("id").alias("n")).collect()}
    total = {r["e"]: r["n"] for r in df.groupBy("e").agg(F.count("id").alias("n")).collect()}
    assert n == {k: math.floor(v * 0.8) for k, v in total.items()}
    found = {r["predictors"]: r["hss"] for r in L.subset_search(df, "id", ["a", "b"], "e", [train], [1, 2]).collect()}
    assert set(found) == {"a", "b", "a b"} and found["a b"] >= found["b"]
    both = L.balanced_fits(df, "e", [(None, ["a", "b"]), (train, ["b"])])
    assert both[0] == m and both[1].predictors == ("b",)


def test_dependent_predictors_are_named_and_other_failures_raise(spark, monkeypatch):
    rows = [(i, float(i % 10), float(2 * (i % 10)), float((i * 7919) % 101), 1 if i % 10 > 6 or i % 37 == 0 else 0) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, twice double, noise double, e int")
    steps = L.forward_selection(df, "id", ["a", "twice", "noise"], "e", alpha=1.0, max_steps=2)
    assert len({s["predictor"] for s in steps} & {"a", "twice"}) == 1 and set(steps[1]["singular"]) <= {"a", "twice"} and steps[1]["singular"]

    def lost(*args):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(L, "p_values", lost)
    with pytest.raises(RuntimeError, match="executor lost"):
        L.forward_selection(df, "id", ["a", "noise"], "e")


def test_fits_that_do_not_converge_raise(spark):
    df = spark.createDataFrame([(float(i), i % 2) for i in range(20)], "a double, e int")
    with pytest.raises(RuntimeError, match="converge"):
        L.balanced_fits(df, "e", [(None, ["a"])], max_iter=1)


def test_draws_reach_positions_above_32_bits(spark):
    from squallframe.functions.draws import lot, pick

    big = 1 << 40
    draws = spark.range(20_000).select("id", pick(lot("x", "id"), 0, F.lit(big)).alias("a"), pick(lot("x", F.lit(1)), F.col("id"), F.lit(big)).alias("b"))
    for c in "ab":  # over series, and within one
        got = draws.agg(F.max(c).alias("hi"), F.avg(c).alias("mean"), F.stddev(c).alias("std"), F.countDistinct(F.floor(F.col(c) * 1000 / big)).alias("cells")).first()
        assert got["hi"] > 0.99 * big and abs(got["mean"] / big - 0.5) < 0.01 and abs(got["std"] / big - 12**-0.5) < 0.01 and got["cells"] == 1000
    pair = draws.agg(F.corr("a", "b").alias("r"), F.corr("id", "b").alias("s")).first()
    assert abs(pair["r"]) < 0.03 and abs(pair["s"]) < 0.03
    few = [r["count"] for r in spark.range(70_000).select(pick(lot("y", F.lit(3)), F.col("id"), F.lit(7)).alias("p")).groupBy("p").count().collect()]
    assert len(few) == 7 and all(abs(n - 10_000) < 450 for n in few)


def test_hss_forward_selection_stops(spark):
    rows = [(i, float(i % 10), float((i * 7919) % 101), 1 if i % 10 > 6 or i % 37 == 0 else 0) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, noise double, e int")
    steps = L.forward_selection(df, "id", ["a", "noise"], "e", "hss", n_rep=20)
    assert [s["predictor"] for s in steps] == ["a"]


def test_resample_counts_follow_the_ratio(spark):
    df = spark.createDataFrame([(i, 1 if i < 10 else 0) for i in range(100)], "id long, e int")
    groups = K.exceedance_groups(df, "e", {"odd": F.col("id") % 2 == 1, "late": F.when(F.col("id") > 5, F.col("id") > 50)})
    rows = K.resample_groups(groups, "e", 300, 5).collect()
    total = {}
    for r in rows:
        total[(r["rep"], r["e"])] = total.get((r["rep"], r["e"]), 0) + r["times"]
    assert total == {(r, e): (5 if e else 50) for r in range(300) for e in (0, 1)}
    share = sum(r["times"] for r in rows if r["e"] == 0 and r["late"] == 1) / (300 * 50)
    assert abs(share - 49 / 90) < 0.02 and any(r["late"] is None for r in rows)


def test_right_closed_intervals(spark):
    rows = [("s", ts(f"2020-01-01 {h:02d}:00"), 1.0) for h in range(0, 13)]
    out = R.interval_sums(spark.createDataFrame(rows, "k string, time timestamp, v double"), ["k"], "time", "v", 6)
    assert {r["time"].hour: r["v"] for r in out.collect()} == {6: 6.0, 12: 6.0}


def test_scaling_folds_and_elimination(spark):
    rows = [(i, float(i % 10), float(100 + (i * 31) % 17), 1 if i % 10 > 5 else 0) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, e int")
    mm = L.scaled(df, ["a", "b"]).agg(F.min("a").alias("lo"), F.max("b").alias("hi")).first()
    assert (mm["lo"], mm["hi"]) == (0.0, 1.0)
    rb = L.scaled(df, ["b"], "robust").agg(F.median("b").alias("m")).first()
    assert rb["m"] == pytest.approx(0.0)
    assert [r["removed"] for r in L.recursive_elimination(df, ["a", "b"], "e")] == ["b"]
    folds = L.fold_auc(df, "id", ["a"], "e", 3).collect()
    assert len(folds) == 3 and all(r["auc"] > 0.95 for r in folds)


def test_index_correlation_p_values(spark):
    series = spark.createDataFrame([("c", y, float(y * y)) for y in range(2000, 2010)], "cell string, year int, v double")
    index = spark.createDataFrame([(y, float(x)) for y, x in zip(range(2000, 2010), [1, 3, 2, 5, 4, 7, 6, 9, 8, 10])], "year int, idx double")
    r = N.index_correlation(series, index, ["cell"], ["year"], "v", "idx").first()
    rho = 1 - 6 * 8 / (10 * 99)
    t = rho * math.sqrt(8 / (1 - rho * rho))
    assert r["rho"] == pytest.approx(rho)
    assert r["p"] == pytest.approx(float(stats.student_two_sided_values(*map(lambda x: __import__("numpy").array([x]), (t, 8.0)))[0]))


def test_contrast_between_active_and_inactive_days(spark):
    rows = [("c", 1, 1, 0), ("c", 1, 1, 0), ("c", 0, 1, 0), ("c", 0, 0, 1), ("c", 1, 0, 1), ("c", 0, 0, 1), ("c", 1, 0, 0)]
    r = N.class_contrast(spark.createDataFrame(rows, "k string, f int, act int, inact int"), ["k"], "f", "act", "inact").first()
    assert r["rate_a"] == pytest.approx(2 / 3) and r["relative"] == pytest.approx(1.0) and 0 < r["p"] < 1
