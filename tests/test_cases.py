"""The fork that a case's lost link would restore, beside the annotated one, and what stands in the way."""

from types import SimpleNamespace

import duckdb
import pytest
from test_queries import DATA, plain

from strandflow.plans import cases, registry


def test_forks_of_cases(spark):
    at = "dataset string, node_id long, uz double, uy double, ux double"
    place = {1: (0, 0, 0), 2: (0, 5, 0), 3: (0, -5, 0), 11: (0, 0, 0), 12: (0, 5, 0), 13: (0, 5, 1), 21: (0, 0, 0), 22: (0, 5, 0), 23: (0, -5, 0), 31: (0, 0, 0), 32: (0, 1, 0)}
    found = {**place, 13: (0, -4, 0), 2: (0, 4, 0)}  # the detection of 13 is elsewhere; that of 23 is missing
    table = lambda rows: spark.createDataFrame([("a", k, *map(float, p)) for k, p in rows.items()], at)
    links = [(1, 2), (1, 3), (11, 12), (11, 13), (21, 22), (21, 23), (31, 32)]
    s = SimpleNamespace(
        nodes=table({k + 100: p for k, p in found.items() if k != 23}), gt_nodes=table(place), gt_edges=spark.createDataFrame([("a", *x) for x in links], "dataset string, source_id long, target_id long"),
        matches=spark.createDataFrame([("a", k, k + 100) for k in place if k != 23], "dataset string, gt_id long, node_id long"),
    )
    rows = spark.createDataFrame([("a", 1, 2), ("a", 11, 13), ("a", 21, 22), ("a", 31, 32)], "dataset string, source_id long, target_id long")
    got = {r.source_id: r for r in cases.with_forks(rows, s).collect()}
    shape = lambda r, k: [round(r[f"{k}_{c}"], 6) for c in cases.SHAPE]
    assert shape(got[1], "restored") == [9, 180, 5, round(1 / 9, 6)] and shape(got[1], "annotated") == [10, 180, 5, 0]
    assert shape(got[11], "annotated")[0] == 1 and shape(got[21], "restored") == [-99] * 4 == shape(got[31], "annotated")
    assert {k: (r.blocker, r.association_only_and_annotation_passes) for k, r in got.items()} == {1: ("association_only", True), 11: ("association_only", False), 21: ("daughter_not_found", False), 31: ("", False)}


@pytest.mark.parametrize("name", ["association_cases", "association_case_summary"])
def test_cases_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{DATA}/lineitem.parquet'")
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), con.execute(registry.ORACLES[name]).df()
    assert len(got) > 0 and plain(got) == plain(want)
    assert name != "association_cases" or {"restored_sep", "annotated_sep", "blocker"} <= set(got.columns)
