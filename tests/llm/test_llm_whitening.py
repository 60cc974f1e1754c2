"""Whitening against numpy's eigenvectors and exact integers."""
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from squallframe.llm import whitening

SF = "/root/testdata/sf0.01"
ROWS = "vec_id long, embedding array<float>"


def ints(v):
    return np.floor(1024 * np.array(v, float)).astype(int) + 100_000


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(1, 30), st.integers(0, 10**6), st.sampled_from([1, 1e-3, 1e6]))
def test_leading_pairs_are_those_of_the_whole_matrix(d, n, seed, stretch):
    a = np.random.default_rng(seed).standard_normal((n, d)) * np.where(np.arange(d) % 3, 1, stretch)
    v = a.T @ a / n
    values, vectors = whitening.leading(v, 8)
    own = np.linalg.eigvalsh(v)[::-1]
    assert np.abs(values - own[: len(values)]).max(initial=0) <= 1e-13 * own[0]
    assert (own[len(values) : 8] <= 1e-10 * own[0]).all()
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max(initial=0) < 1e-12
    assert np.abs(v @ vectors - vectors * values).max(initial=0) < 1e-12 * own[0]


@pytest.mark.parametrize("diagonal", [[5.0] * 20, [3.0, 3, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1], [1e9, *np.linspace(1, 2, 50)], [1.0, 1e-20, 0]])
def test_repeated_far_and_vanishing_values(diagonal):
    values, _ = whitening.leading(np.diag(diagonal), 8)
    wanted = [x for x in sorted(diagonal, reverse=True)[:8] if x > 1e-12 * max(diagonal)]
    assert np.allclose(values, wanted, rtol=1e-9 if max(diagonal) < 1e9 else 1e-6)


def test_counts_above_a_shift():
    a = np.random.default_rng(3).standard_normal((30, 30))
    inertia, values = whitening.Inertia(a + a.T), np.linalg.eigvalsh(a + a.T)
    assert all(inertia.above(s) == (values > s).sum() for s in np.linspace(-20, 20, 101))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**53), 2**53), min_size=2, max_size=2), min_size=1, max_size=20))
def test_sums_are_exact(rows):
    y = np.array(rows, np.int64)
    exact = y.astype(object).T @ y.astype(object)
    assert (whitening.whole(whitening.products(y)) == exact).all()


def test_the_query_against_plain_algebra(spark):
    got = {(r["vec_id"], r["component"]): r for r in entry.queries()["op11_whiten_embeddings"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.stack([ints(r["embedding"]) for r in rows])
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 8 * n
    for c in range(8):
        mine = np.array([got[r["vec_id"], c + 1]["whitened"] for r in rows])
        plain = centred @ vectors[:, c] / np.sqrt(values[c])
        assert min(np.abs(mine - plain).max(), np.abs(mine + plain).max()) < 1e-9
        first = got[rows[0]["vec_id"], c + 1]
        assert abs(first["explained"] - values[c] / values.sum()) < 1e-10 and first["identity_error"] < 1e-9 and first["n"] == n
    assert all(got[r["vec_id"], 1]["deviation"] == sum(int(v) ** 2 for v in n * row - sums) for r, row in zip(rows, x))


def test_odd_rows(table):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 3), float(i % 5), 0.5]) for i in range(20)]
    odd = [(50, None), (51, [1.0, None, 2.0]), (52, [nan, 1.0, 1.0]), (53, [1.0, inf, 1.0]), (None, [1.0, 2.0, 3.0]), (3, [0.0, 3.0, 0.5]), (60, []), (61, [1.0]), (62, [1.0])]
    made = table(good + odd, ROWS, "n string, dim string, whitened string, key int, explained int")
    got = whitening.whiten(made, "vec_id", "embedding").collect()
    by_length = {1: [r for r in got if r["key"] in (61, 62)], 0: [r for r in got if r["key"] == 60]}
    full = [r for r in got if r not in by_length[1] and r not in by_length[0]]
    assert len(full) == 22 and {r["n"] for r in full} == {22} and sum(r["key"] is None for r in full) == 1
    assert {len(r["whitened"]) for r in full} == {3} and all(r["identity_error"] < 1e-10 for r in full)
    assert [(r["n"], r["whitened"], r["deviation"], r["identity_error"]) for r in by_length[1]] == [(2, [], 0, None)] * 2
    assert [(r["n"], int(r["deviation"])) for r in by_length[0]] == [(1, 0)]
    assert whitening.whiten(made.limit(0), "vec_id", "embedding").count() == 0


def test_huge_entries_and_long_vectors(table):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.standard_normal(300)]) for i in range(40)] + [(99, [1e30, -1e30, *[0.0] * 298])]
    got = whitening.whiten(table(rows, ROWS, "n string"), "vec_id", "embedding", k=3).collect()
    x = np.array([[min(max(int(np.floor(np.float64(np.float32(c)) * 1024)), -(2**53)), 2**53) + 100_000 for c in v] for _, v in rows], dtype=object)
    sums, n = x.sum(axis=0), len(x)
    assert {r["key"]: int(r["deviation"]) for r in got} == {k: sum((n * a - s) ** 2 for a, s in zip(row, sums)) for (k, _), row in zip(rows, x)}
    assert all(len(r["whitened"]) == len(r["explained"]) for r in got)


def test_rows_over_many_tasks_give_the_same(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    fits = [whitening.fit(rows.selectExpr("embedding as vec").repartition(p), 4)[64] for p in (1, 13)]
    assert (fits[0].components == fits[1].components).all() and fits[0].n == fits[1].n == 500
