"""Two-level ordering: the same answers as plain windows, with bins of a few rows."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from squallframe.operators import mapping as M
from squallframe.operators import ordered as O
from squallframe.operators import sequence as E


@pytest.fixture(autouse=True)
def tiny_bins(monkeypatch):
    monkeypatch.setattr(O, "ROWS_PER_BIN", 3)


def sample(n=200, seed=1):
    rnd = random.Random(seed)
    # one key holds most rows, values are heavy-tailed and tied
    return [("hot" if rnd.random() < 0.8 else f"k{i % 3}", float(int(rnd.paretovariate(1.2) * 10)) / 2, i) for i in range(n)]


def test_running_counts_match_a_sort(spark):
    rows = sample()
    df = spark.createDataFrame(rows, "k string, v double, id long")
    got = {(r["k"], r["v"]): (r["n_le"], r["n_lt"], r["n_total"]) for r in O.running_counts(O.value_counts(df, ["k"], "v"), ["k"], "v").collect()}
    for k in {r[0] for r in rows}:
        vals = [r[1] for r in rows if r[0] == k]
        for v in set(vals):
            assert got[(k, v)] == (sum(x <= v for x in vals), sum(x < v for x in vals), len(vals))


@pytest.mark.parametrize("keys", [["k"], []])
def test_quantiles_match_numpy(spark, keys):
    rows = sample()
    df = spark.createDataFrame(rows, "k string, v double, id long")
    out = O.quantiles(df, keys, "v", {"a": 0.0, "b": 0.33, "c": 0.9995, "d": 1.0}).collect()
    for r in out:
        vals = [x[1] for x in rows if not keys or x[0] == r["k"]]
        for name, p in (("a", 0), ("b", 33), ("c", 99.95), ("d", 100)):
            assert r[name] == pytest.approx(np.percentile(vals, p))


def test_row_numbers(spark):
    rows = sample(50)
    df = spark.createDataFrame(rows, "k string, v double, id long")
    got = {r["id"]: r["pos"] for r in O.row_numbers(df, ["k"], "id", "pos").collect()}
    for k in {r[0] for r in rows}:
        ids = sorted(r[2] for r in rows if r[0] == k)
        assert [got[i] for i in ids] == list(range(1, len(ids) + 1))


def test_neighbours_across_buckets(spark):
    rows = [("a", i, float(i * i)) for i in range(40)] + [("b", 3, 9.0), ("b", 77, 1.0)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    out = O.neighbours(df, ["k"], ["t"], F.floor(F.col("t") / 7), ["v"], 3, 2).collect()
    assert len(out) == len(rows)
    for k in ("a", "b"):
        series = sorted((r[1], r[2]) for r in rows if r[0] == k)
        at = {t: i for i, (t, _) in enumerate(series)}
        for r in (x for x in out if x["k"] == k):
            i = at[r["t"]]
            for d in (1, 2, 3):
                assert r[f"v_prev{d}"] == (series[i - d][1] if i - d >= 0 else None)
            for d in (1, 2):
                assert r[f"v_next{d}"] == (series[i + d][1] if i + d < len(series) else None)


def test_lookup_matches_numpy_interp(spark):
    rnd = random.Random(3)
    knots = sorted({round(rnd.expovariate(0.2), 3) for _ in range(60)})
    curve = [("a", x, math.sin(x)) for x in knots] + [("b", 1.0, 5.0)]
    asks = [("a", rnd.uniform(-2, 40)) for _ in range(80)] + [("a", knots[7])] * 3 + [("b", 0.0), ("b", 9.0), ("c", 1.0)]
    q = spark.createDataFrame([(i, k, x) for i, (k, x) in enumerate(asks)], "id int, k string, x double")
    c = spark.createDataFrame(curve, "k string, xp double, fp double")
    got = {r["id"]: r["f"] for r in O.interp_lookup(q, c, ["k"], "x", "xp", "fp", "f").collect()}
    assert len(got) == len(asks)
    for i, (k, x) in enumerate(asks):
        pts = [(p, f) for kk, p, f in curve if kk == k]
        want = np.interp(x, [p for p, _ in pts], [f for _, f in pts]) if pts else None
        assert got[i] == (pytest.approx(want) if pts else None)


def test_quantile_map_of_a_sample_onto_itself_is_the_identity(spark):
    vals = [float(v) for v in random.Random(5).sample(range(1000), 60)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    out = M.quantile_map(df, df, df, [], [], "v", keep_zero=False)
    assert all(r["mapped"] == pytest.approx(r["v"]) for r in out.collect())


def test_quantile_map_ties_zero_and_bounds(spark):
    ref = spark.createDataFrame([(0.0,), (0.0,), (1.0,), (2.0,)], "v double")
    obs = spark.createDataFrame([(0.0,), (1.0,), (1.0,), (3.0,)], "v double")
    ask = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (-5.0,), (9.0,)], "v double")
    got = {r["v"]: r["mapped"] for r in M.quantile_map(ask, ref, obs, [], [], "v").collect()}
    # P(0) = 0.5 is the first tied rank of 1 in the observations, but zero stays zero
    assert got[0.0] == 0.0
    assert got[1.0] == pytest.approx(2.0)  # P = 0.75, halfway from (0.5, 1) to (1, 3)
    assert got[2.0] == 3.0 and got[9.0] == 3.0 and got[-5.0] == 0.0


def test_ecdf_permutation_invariance(spark):
    rows = sample(80)
    a = spark.createDataFrame(rows, "k string, v double, id long")
    b = spark.createDataFrame(rows[::-1], "k string, v double, id long")
    key = lambda r: (r["k"], r["v"], r["p"])
    assert sorted(map(key, E.ecdf(a, ["k"], "v").collect())) == sorted(map(key, E.ecdf(b, ["k"], "v").collect()))
