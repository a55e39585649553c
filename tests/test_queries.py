"""Registered queries against their oracle SQL on the smallest tables, and the entry point's contract."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from strandflow.plans import registry

DATA = "/root/testdata/sf0.001"
SOME = [
    "fork_geometry", "division_filter", "division_candidates", "gap_census", "mutual_policy", "bridge_census", "strict_bridge_policy", "apply_repairs", "component_cleanup", "components", "submission_rows",
    "radius_join", "mutual_nn", "motion_residuals", "column_stats", "mutual_continuation_v2", "local_maxima", "edge_accounting", "fold_stability", "gate_grid_recall", "semantic_digest", "ranking_auc", "pareto_frontier", "gap_contest_features", "gate_replacements", "gate_fold_outliers", "selector_retained", "gt_division_census", "locked_reproduction",
]


def plain(df):
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        out[c] = [repr(round(float(v), 5) + 0.0) if isinstance(v, (float, np.floating)) else str(int(v)) if isinstance(v, (bool, int, np.bool_, np.integer)) else str(v) for v in out[c]]
    return sorted(map(tuple, out.values.tolist()))


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), con.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0
    assert plain(got) == plain(want)


def test_duplicate_whole_frames(spark):
    from strandflow.plans.audits import whole_frames

    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{DATA}/lineitem.parquet'")
    got, want = registry.QUERIES["duplicate_whole_frames"](spark, DATA).toPandas(), con.execute(registry.ORACLES["duplicate_whole_frames"]).df()
    assert plain(got) == plain(want)
    frames = {("a", 1): [(1, 2, 3), (4, 5, 60)], ("b", 7): [(4, 5, 60), (1, 2, 3)], ("a", 2): [(1, 2, 3), (4, 5, 61)], ("a", 3): [(1, 4, 3), (4, 5, 60)], ("b", 8): [(9, 9, 90)], ("b", 9): [(9, 9, 90)]}
    rows = [(d, t, float(z), float(y), float(x)) for (d, t), nodes in frames.items() for z, y, x in nodes]
    digest = {(r.dataset, r.t): r.digest for r in whole_frames(spark.createDataFrame(rows, "dataset string, t int, z double, y double, x double")).collect()}
    assert {(f, g) for f in digest for g in digest if f < g and digest[f] == digest[g]} == {(("a", 1), ("b", 7)), (("b", 8), ("b", 9))}


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "dataset"
    assert df.count() == 5


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(registry.QUERIES) > 100
    assert os.path.isdir(DATA)


def test_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    run = subprocess.run([sys.executable, "-c", code], cwd=Path(entry.__file__).parent, capture_output=True, text=True, check=False)
    assert run.returncode == 0, run.stderr
