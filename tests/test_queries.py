"""Registered queries against their SQL twins on the smallest tables: a cross-section; tools/check.py runs all."""
import math
import re
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from squallframe.plans import load_all

FOLDER = "/root/testdata/sf0.001"
TABLES = ["events", "lineitem", "orders"]
PICK = [
    "best_gust_threshold", "quality_flag_nulling", "incomplete_month_flag", "daily_gust_scan", "utc_conversion", "sudden_gust_detection",
    "nearest_land_cell", "radius_reduction", "storm_report_attachment", "sorted_curve_lookup", "period_exceedance_frequency",
    "conditional_probability_grid", "column_diagnostics", "tornado_parameters", "bootstrap_skill_bounds", "conditional_threshold_search",
    "quantile_map_pooled", "empirical_return_levels", "grid_exceedance_trend", "climate_index_permutation_test", "bilinear_regrid",
    "region_tagging", "stratified_splits", "kernel_density",
]


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", PICK)
def test_matches_the_sql_twin(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(tuple(str(canon(r[c])) for c in cols) for r in df.collect())
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == sorted(tuple(str(canon(r[k])) for k in order) for r in cur.fetchall())


def test_registry_is_complete():
    reg = load_all()
    found, twins = set(entry.queries()), set(entry.oracle_sql())
    assert set(reg) <= found and twins <= found
    # what is registered beside them comes with the optional subpackage alone
    assert all(name == "pipeline" or re.match(r"op\d+_", name) for name in found - set(reg))
    assert all(e.covers for e in reg.values())


def test_the_rest_stands_without_the_optional_parts(tmp_path):
    root = Path(entry.__file__).parent
    copied = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__")
    shutil.copytree(root, tmp_path / "rest", ignore=copied)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op1') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "rest", capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(len(load_all())), "False"]


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["param", "threshold", "score"]
