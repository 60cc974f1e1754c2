"""Queries that once ran a smaller job than the one they name."""
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from squallframe.functions.draws import picks
from squallframe.operators import learn as L
from squallframe.operators import trends as N
from squallframe.plans import learn as PL

FOLDER = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")


def asked(monkeypatch, spark, module, function, name):
    """The arguments with which a query calls an operator."""

    class Called(Exception):
        pass

    def note(*args, **more):
        raise Called(args, more)

    monkeypatch.setattr(module, function, note)
    with pytest.raises(Called) as call:
        entry.queries()[name](spark, FOLDER)
    return call.value.args


def test_flag_test_counts_the_draws_of_yes_rows(spark):
    flags = {("x", "a"): [1, 0, 0, None, 0, 1, 0], ("x", "b"): [1, 0, 0, 1, 1], ("y", "a"): [0, 0, 0], ("y", "b"): [0, 0], ("z", "a"): [1, 0]}
    df = spark.createDataFrame([(k, h, f) for (k, h), fs in flags.items() for f in fs], "k string, half string, f int")
    got = {r["k"]: r["p"] for r in N.bootstrap_flag_test(df, ["k"], "half", F.col("f") == 1, 500).collect()}
    starts = {(h, i): spark.range(1).select(N.lot(f"n2-{h}", F.lit(i))).first()[0] for h in "ab" for i in (0, 499)}
    many = {h: [r[0] for r in spark.range(500).select(N.lot(f"n2-{h}", F.col("id").cast("int"))).collect()] for h in "ab"}
    assert all(many[h][i] == s for (h, i), s in starts.items())

    def means(h, values):
        n, yes = len(values), sum(v or 0 for v in values)
        return np.array([(picks(s, np.arange(n), n) < yes).mean() - yes / n for s in many[h]]), yes / n

    for key in "xy":
        (a, mean_a), (b, mean_b) = means("a", flags[key, "a"]), means("b", flags[key, "b"])
        diff, shifted = round(mean_b - mean_a, 9), np.round(b - a, 9)
        assert got[key] == pytest.approx(2 * min((shifted >= diff).mean(), (shifted <= diff).mean()))
    assert 0 < got["x"] < 1 and got["y"] == 2 and got["z"] is None


@tables
def test_trend_table_draws_every_replicate(spark, monkeypatch):
    args, _ = asked(monkeypatch, spark, N, "trend_table", "station_trend_table")
    assert args[7] == 1000 and args[9] == 10000


@tables
def test_trend_table_has_a_p_of_strong_days(spark):
    rows = entry.queries()["station_trend_table"](spark, FOLDER).collect()
    some = [r["strong_p"] for r in rows if r["strong_p"] is not None]
    assert some and all(abs(p * 5000 - round(p * 5000)) < 1e-6 for p in some) and any(abs(p * 500 - round(p * 500)) > 1e-6 for p in some)


@tables
def test_subset_search_averages_all_splits(spark, monkeypatch):
    args, _ = asked(monkeypatch, spark, L, "stratified_splits", "predictor_subset_search")
    assert args[3] == PL.SPLITS == 16


LARGER = "/root/testdata/sf0.01"  # the smallest tables have a variant without events


def twin_rows(text):
    import duckdb

    con = duckdb.connect()
    for t in ("events", "lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{LARGER}/{t}.parquet')")
    return con.execute(text).fetchall()


def test_draws_of_a_tree_are_a_resample():
    """Whoever asks for whichever places sees the same draws, and counts are multinomial."""
    from squallframe.operators import skill as K

    places = [0, 3, 10, 11, 40, 100]
    below = K.draws_below("t", 100, places, 4000)
    assert (below[0] == 0).all() and (below[-1] == 100).all() and (np.diff(below, axis=0) >= 0).all()
    for i, p in enumerate(places):
        assert (K.draws_below("t", 100, [p], 4000)[0] == below[i]).all()
        share = p / 100
        assert below[i].mean() == pytest.approx(100 * share, abs=0.5) and below[i].std() == pytest.approx(np.sqrt(100 * share * (1 - share)), abs=0.3)
    # counts of two stretches that don't meet are correlated as those of one resample
    a, b = below[1], below[3] - below[2]
    assert np.cov(a, b)[0, 1] == pytest.approx(-100 * 0.03 * 0.01, abs=0.1)


@pytest.mark.parametrize("stretch", [3, 4096])
def test_auc_bounds_equal_plain_resampling(spark, monkeypatch, stretch):
    """Ties, several events on one value, and a null; in distribution, with values in one block and in many."""
    from squallframe.operators import skill as K

    monkeypatch.setattr(K, "STRETCH", stretch)
    rows = [(v, float(i % 4), e) for i, (v, e) in enumerate([(1.0, 0), (2.0, 1), (2.0, 0), (3.0, 1), (None, 1), (0.5, 0), (2.5, 0), (2.6, 0), (2.0, 1), (9.0, 0)] * 6)]
    df = spark.createDataFrame(rows, "a double, b double, e int")
    got = {r["param"]: (r["lower"], r["upper"]) for r in K.bootstrap_auc(df, ["a", "b"], "e", 4000, 0.1, 0.9).collect()}
    rng = np.random.default_rng(0)
    for c, name in ((0, "a"), (1, "b")):
        have = np.array([(r[c], r[2]) for r in rows if r[c] is not None])
        areas = []
        for _ in range(4000):
            took = have[rng.integers(0, len(have), len(have))]
            yes, no = took[took[:, 1] == 1, 0], took[took[:, 1] == 0, 0]
            areas.append(((yes[:, None] > no) + (yes[:, None] == no) / 2).mean())
        assert got[name] == pytest.approx(np.quantile(areas, [0.1, 0.9]), abs=0.012)


def test_auc_needs_both_classes(spark):
    from squallframe.operators import skill as K

    df = spark.createDataFrame([(1.0, 0), (2.0, 0)], "a double, e int")
    assert [tuple(r) for r in K.bootstrap_auc(df, ["a"], "e", 20).collect()] == [("a", None, None)]
    assert K.bootstrap_auc(df.limit(0), ["a"], "e", 20).count() == 0


@tables
def test_auc_bounds_draw_a_thousand_replicates(spark, monkeypatch):
    from squallframe.operators import skill as K

    args, _ = asked(monkeypatch, spark, K, "bootstrap_auc", "bootstrap_auc_bounds")
    assert args[3] == 1000


def test_many_fits_equal_fits_one_by_one(spark):
    from squallframe.operators import learn as L

    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 3)) * [1, 5, 0.2] + [0, 3, 0]
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.0, -0.4, 3.0] + 1)))).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), int(e)) for i, (r, e) in enumerate(zip(x, y))], "id int, a double, b double, c double, e int").repartition(5)
    odd, asked_ = F.col("id") % 2 == 1, [("a",), ("a", "b"), ("c", "b", "a")]
    fits = L.balanced_fits(df, "e", [(t, p) for t in (None, odd) for p in asked_])
    for m, (part, names) in zip(fits, [(t, p) for t in (np.ones(400, bool), np.arange(400) % 2 == 1) for p in asked_]):
        own, e = np.column_stack([x[part][:, ["abc".index(p)]] for p in names]), y[part]
        w = np.where(e == 1, len(e) / (2 * e.sum()), len(e) / (2 * (len(e) - e.sum())))
        p = 1 / (1 + np.exp(-(own @ np.array(m.coefs) + m.intercept)))
        slope = np.column_stack([np.ones(len(e)), own]).T @ (w * (p - e)) + np.array([0.0, *m.coefs])
        assert np.abs(slope).max() < 1e-7  # the gradient of the penalised likelihood vanishes


@tables
@pytest.mark.parametrize("name, modes", [("ranked_skill_table", ["floor", "ceil"]), ("proximity_definition_comparison", ["floor", "floor2", "ceil"])])
def test_sweeps_go_over_a_thousand_thresholds(spark, name, modes):
    from squallframe.plans.registry import sql
    from squallframe.plans.skill import events_cte, long_cte, sweep_ctes

    want = {}
    for m in modes:
        body = f"{events_cte(m)}, {long_cte('is_sta')}, {sweep_ctes('pss')} SELECT param, ROUND(score, 6), ROUND(threshold, 6) FROM best"
        want[m] = {p: (s, t) for p, s, t in twin_rows(sql("v_obs v_points", body))}
    for r in entry.queries()[name](spark, LARGER).collect():
        p = r["param"]
        if name == "ranked_skill_table":
            assert r["threshold"] == pytest.approx(want["floor"][p][1], abs=2e-6)
            assert r["score"] == pytest.approx(want["ceil" if p == "umean06" else "floor"][p][0], abs=2e-6)
        else:
            assert [r[f"score_{m}"] for m in modes] == pytest.approx([want[m][p][0] for m in modes], abs=2e-6)


@tables
def test_elimination_asks_for_the_folds(spark, monkeypatch):
    rounds = [{"round": 1, "removed": "s06", "coef": 0.25, "predictors": "s06 dcape", "auc": 0.75, "best": False}, {"round": 2, "removed": None, "coef": None, "predictors": "dcape", "auc": 0.8, "best": True}]
    monkeypatch.setattr(PL, "clip_to_percentiles", lambda rows, params: rows)
    monkeypatch.setattr(L, "recursive_elimination", lambda *args, unique=None, **more: rounds if unique == "event_id" else [])
    assert [r.asDict() for r in entry.queries()["recursive_elimination"](spark, FOLDER).collect()] == rounds
