"""The registry of named diagnostics: resolution, one shuffle, and columns computed by hand."""
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from squallframe.functions import composites as X
from squallframe.operators import diagnostics as D

NAMES = "col long, lev int, p double, z double, ta double, dp double, ua double, va double, parcel_sb double, parcel_ml double, parcel_mu double, parcel_down double"


def column(col, n, rng):
    z = np.concatenate([[0.0], np.cumsum(rng.uniform(300, 1500, n - 1))])
    p = 1000 * np.exp(-z / 8000)
    ta = 28 - 0.0068 * z + rng.uniform(-1, 1, n)
    dp = ta - rng.uniform(1, 12, n)
    u, v = rng.uniform(-20, 40, n), rng.uniform(-20, 20, n)
    lifted = ta + np.linspace(-2, 4, n)
    return [(col, i + 1, *map(float, x)) for i, x in enumerate(zip(p, z, ta, dp, u, v, lifted, lifted, lifted + 0.5, ta - 2))]


@pytest.fixture(scope="module")
def columns():
    rng = np.random.default_rng(5)
    return {c: column(c, n, rng) for c, n in enumerate([18, 12, 9, 3, 1])}


@pytest.fixture(scope="module")
def levels(spark, columns):
    rows = [r for c in columns.values() for r in c]
    rng = np.random.default_rng(1)
    return spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], NAMES).withColumn("name", F.lit("clash"))


def at(rows, k, h):
    z, x = np.array([r[3] for r in rows]), np.array([r[k] for r in rows])
    return x[0] if z[0] >= h else np.interp(h, z, x) if z[-1] >= h else None


def test_named_values_by_hand(levels, columns):
    names = ["max_shear", "mmp", "lr38", "mu_cape", "mu_cin", "s06", "t_totals", "melting", "lcl", "dcape"]
    got = {r["col"]: r for r in D.diagnose(levels, ["col"], names).collect()}
    assert set(got) == set(columns)
    for c, rows in columns.items():
        r = got[c]
        shears = [np.hypot(at(rows, 6, t) - at(rows, 6, b), at(rows, 7, t) - at(rows, 7, b)) for b in D.SHEAR_LOWS for t in D.SHEAR_TOPS if at(rows, 6, t) is not None and at(rows, 6, b) is not None]
        assert r["max_shear"] == (pytest.approx(max(shears)) if shears else None)
        z, ta = np.array([x[3] for x in rows]), np.array([x[4] for x in rows])
        b = 9.81 * (np.array([x[10] for x in rows]) - ta) / (ta + 273.15)
        area = lambda y: ((y[1:] + y[:-1]) / 2 * np.diff(z))
        assert r["mu_cape"] == pytest.approx(area(np.maximum(b, 0)).sum())
        free = z[b > 0].min() if (b > 0).any() else -1
        assert r["mu_cin"] == pytest.approx(abs(area(np.minimum(b, 0))[z[1:] <= free].sum()))
        assert r["dcape"] == pytest.approx(area(9.81 * 2 / (ta + 273.15)).sum())
        assert r["lcl"] == pytest.approx(125 * (rows[0][4] - rows[0][5]))
        deep = at(rows, 6, 6000)
        assert (r["s06"] is None) == (deep is None)
        if r["mmp"] is not None and r["mu_cape"] >= 100:
            assert 0 < r["mmp"] < 1


def test_a_short_list_takes_only_what_it_needs(levels):
    plan = D.resolve(["s06", "t_totals", "lr_freezing"])
    assert [d.name for d in plan["level"]] == [] and [d.name for d in plan["mark"]] == ["melting_at"]
    assert {d.name for d in plan["column"]} == {"s06", "ta850", "dp850", "ta500", "lr_freezing"} and [d.name for d in plan["index"]] == ["t_totals"]
    assert D.inputs(["s06"]) == ["p", "z", "ua", "va"]
    only = D.diagnose(levels, ["col"], ["s06"])
    plan = only._jdf.queryExecution().optimizedPlan().toString()
    read = re.findall(r"Project \[col#\d+L?, lev#\d+, ([^\]]*)\]", plan)[-1]
    assert only.columns == ["col", "s06"] and re.sub(r"#\d+", "", read) == "p, z, ua, va"


@pytest.mark.parametrize("names", [D.FULL, D.REDUCED, ("s06", "mmp", "q_melting")])
def test_any_list_takes_one_shuffle(spark, levels, names, tmp_path):
    levels.write.parquet(str(tmp_path / "levels"))
    plan = D.diagnose(spark.read.parquet(str(tmp_path / "levels")), ["col"], names)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_all_names_have_values_somewhere(levels):
    got = D.diagnose(levels, ["col"], D.FULL).collect()
    assert len(D.FULL) >= 100 and len(got) == 5
    empty = [n for n in D.FULL if all(r[n] is None for r in got)]
    assert empty == []
    assert D.diagnose(levels.limit(0), ["col"], D.REDUCED).count() == 0


def test_wrong_names_and_circles(monkeypatch):
    with pytest.raises(KeyError, match="needed by"):
        monkeypatch.setitem(D.REGISTRY, "odd", D.Diagnostic("odd", "index", ("nowhere",), lambda: F.lit(1)))
        D.resolve(["odd"])
    monkeypatch.setitem(D.REGISTRY, "a", D.Diagnostic("a", "index", ("b",), lambda: F.lit(1)))
    monkeypatch.setitem(D.REGISTRY, "b", D.Diagnostic("b", "index", ("a",), lambda: F.lit(1)))
    with pytest.raises(ValueError, match="a -> b -> a"):
        D.resolve(["a"])
    monkeypatch.setitem(D.REGISTRY, "early", D.Diagnostic("early", "column", ("mmp",), lambda: F.lit(1)))
    with pytest.raises(ValueError, match="earlier stage"):
        D.resolve(["early"])
    with pytest.raises(ValueError, match="twice"):
        D.register("index", "mmp", "s06", lambda: F.lit(1))


def test_levels_and_marks_are_no_results(levels):
    with pytest.raises(ValueError, match="not a value"):
        D.diagnose(levels, ["col"], ["te"])


def test_equal_wind_directions_are_told_apart_as_the_c_library_does(spark):
    # the same direction at both levels but for the last bit of an arc tangent
    rng = np.random.default_rng(3)
    u, v, k = rng.uniform(-15, 15, 4000), rng.uniform(-15, 15, 4000), rng.uniform(0.5, 2.0, 4000)
    rows = [(i, 5.0, 40.0, float(a), float(b), float(a * c), float(b * c)) for i, (a, b, c) in enumerate(zip(u, v, k))]
    df = spark.createDataFrame(rows, "i int, dp850 double, t_totals double, u850 double, v850 double, u500 double, v500 double")
    got = {r["i"]: r for r in df.select("*", X.sweat("dp850", "t_totals", "u850", "v850", "u500", "v500").alias("s")).collect()}
    for i, _, _, u8, v8, u5, v5 in rows:
        d8, d5 = math.degrees(math.atan2(v8, u8)), math.degrees(math.atan2(v5, u5))
        s8, s5 = math.hypot(u8, v8), math.hypot(u5, v5)
        off = 130 <= d8 <= 250 or 210 <= d5 <= 310 or d5 - d8 > 0 or (s8 >= 7.71 and s5 >= 7.71)
        want = 60.0 + 2 * 1.944 * s8 + 1.944 * s5 + (0.0 if off else max(0.0, 125 * (math.sin(math.radians(d5 - d8)) + 0.2)))
        assert got[i]["s"] == pytest.approx(want, abs=1e-6)


def test_power_next_to_a_rounding_tie(spark):
    one = spark.createDataFrame([(1681.9888961463098, 15.94351139352795), (1.0, None)], "cape double, s06 double")
    assert [r[0] for r in one.select(X.cape_shear("cape", "s06")).collect()] == [171450.34569449996, None]
