"""Hard negatives against all pairs; bounds against exact products."""
import collections

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from squallframe.llm import negatives

COLUMNS = "vec_id long, embedding array<float>, label int"
CLASH = "point long, first string, seeker int, list string, h string, cut string, ids int, mean int"


def plain(rows, positives=5, count=10, every=10):
    own = sorted({(i, lab, tuple(int(np.floor(256 * np.float64(np.float32(x)))) for x in v)) for i, v, lab in rows if i is not None and v and lab is not None and all(x is not None and np.isfinite(x) for x in v)})
    out = []
    for a, lab, q in own:
        if a % every:
            continue
        scored = sorted((-sum(map(int.__mul__, q, p)), i, other) for i, other, p in own if i != a and len(p) == len(q))
        for s, i, _ in [x for x in scored if x[2] == lab][:positives]:
            hard = [x for x in scored if x[2] != lab and -30 * s <= -100 * x[0] <= -90 * s][:count]
            out += [(a, i, r + 1, j, -s, -t) for r, (t, j, _) in enumerate(hard)]
    return sorted(out)


def mined(df, every=10, **more):
    got = negatives.mine(df, "vec_id", "embedding", "label", F.col("vec_id") % every == 0, **more)
    return sorted(tuple(r) for r in got.collect())


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 40), st.integers(1, 6), st.integers(0, 10**6))
def test_bounds_hold_at_every_level(dim, n, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-300, 300, (n, dim)) * rng.integers(0, 2, (n, 1))
    whole = x @ x.T
    s = negatives.summarise(x.astype(float))
    for level in (s, s.coarser(), s.coarser().coarser()):
        low, high = level.bounds(level)
        assert (low <= whole).all() and (whole <= high).all()
    if dim <= negatives.SEGMENTS:
        low, high = s.bounds(s)
        assert (high - low < 1.01).all()


def test_structured_vectors_are_decided_by_their_summaries():
    rng = np.random.default_rng(2)
    x = (np.repeat(rng.integers(-60, 60, (400, 8)), 8, axis=1) + rng.integers(-3, 4, (400, 64))).astype(float)
    s = negatives.summarise(x)
    everything = [{"list": 0, "lo": -(2**62), "hi": 2**62, "bar": -(2**62)}]
    low, high = s.rows([0]).bounds(s)
    left = negatives.undecided(low[0], high[0], np.ones(400, bool), everything, 5)
    best = np.argsort(-(x @ x[0]), kind="stable")[:5]
    assert left[best].all() and left.sum() < 60


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.standard_normal(6)], int(rng.integers(0, 3))) for i in range(150)]
    rows += [(i, [0.5, 0.25, 0.0, 0.0, 0.5, 0.5], 1) for i in range(150, 230)]  # a hot vector, anchors among its copies
    rows += [(i, [0.5, 0.25, 0.0, 0.0, 0.5, 0.5], 2) for i in range(230, 245)]
    rows += [(i, [0.4, 0.2, 0.0, 0.0, 0.4, 0.4], 0) for i in range(245, 275)]  # ties
    nan, inf = float("nan"), float("inf")
    rows += [(300, None, 1), (310, [nan] * 6, 1), (320, [inf] * 6, 1), (330, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (340, [1.0] * 6, None), (None, [1.0] * 6, 1)]
    rows += [(350, [0.0] * 6, 1), (360, [1.0, 2.0], 1), (361, [1.0, 1.0], 1), (362, [0.5, 0.6], 2), (370, [], 1), (380, [1.0] * 6, 9), (10, rows[10][1], rows[10][2])]
    return rows


def test_all_pairs(table, vectors):
    made = table(vectors, COLUMNS, CLASH)
    got = mined(made)
    assert got == plain(vectors) and len(got) > 300
    assert mined(made.limit(0)) == []


def test_rounds_blocks_and_groups_change_nothing(table, vectors, monkeypatch):
    for name, value in {"FIRST": 20, "GROWTH": 3, "POINTS": 16, "SEEKERS": 3, "TILE": 2, "ANCHORS": 2}.items():
        monkeypatch.setattr(negatives, name, value)
    assert mined(table(vectors, COLUMNS, CLASH)) == plain(vectors)


def test_large_entries_stay_whole(table):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in 3e5 * rng.standard_normal(5)], i % 2) for i in range(40)]
    assert mined(table(rows, COLUMNS, CLASH)) == plain(rows)
    huge = mined(table([*rows, (50, [1e30, 0.0, 0.0, 0.0, 0.0], 0)], COLUMNS, CLASH))
    assert huge and all(abs(r[4]) < 2**62 for r in huge)


def test_few_rows(table):
    counts = collections.Counter(r[:2] for r in mined(table([(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.0], 2), (3, [0.95, 0.0], 2)], COLUMNS, CLASH)))
    assert counts == {(0, 1): 1}  # one of the other label is too near
