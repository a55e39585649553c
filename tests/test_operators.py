"""Operators on hand-made graphs and against plain loops."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow.operators import greedy, metrics, policies, spatial, topology
from strandflow.sources import submission


def nodes(spark, rows):
    return spark.createDataFrame([("d", i, t, float(z), float(y), float(x), True) for i, t, z, y, x in rows], "dataset string, node_id long, t int, uz double, uy double, ux double, high_conf boolean")


def edges(spark, rows):
    return spark.createDataFrame([("d", a * 1000 + b, a, b, float(p)) for a, b, p in rows], "dataset string, edge_id long, source_id long, target_id long, edge_prob double")


def pairs(df, a="source_id", b="target_id"):
    return {(r[a], r[b]) for r in df.collect()}


def test_division_filter(spark):
    n = nodes(spark, [(1, 1, 0, 0, 0), (2, 2, 0, 0, 4), (3, 2, 0, 0, -4), (11, 1, 0, 50, 0), (12, 2, 0, 50, 0), (13, 2, 0, 50, 4)])
    good = edges(spark, [(1, 2, 0.9), (1, 3, 0.85), (11, 12, 0.9), (11, 13, 0.9)])
    # the second fork has an arm without length: its angle is NaN, which must fail
    assert pairs(policies.division_filter(n, good)) == {(1, 2), (1, 3), (11, 12)}
    weak = edges(spark, [(1, 2, 0.9), (1, 3, 0.7)])
    assert pairs(policies.division_filter(n, weak)) == {(1, 2)}
    three = edges(spark, [(1, 2, 0.9), (1, 3, 0.1), (1, 12, 0.1)])
    assert len(pairs(policies.division_filter(n, three))) == 3


def test_filter_is_idempotent(spark):
    rng = random.Random(1)
    n = nodes(spark, [(i, 1 + i // 20, rng.uniform(0, 20), rng.uniform(0, 20), rng.uniform(0, 20)) for i in range(60)])
    e = edges(spark, [(i, 20 + j, rng.random()) for i in range(20) for j in rng.sample(range(20), 2)])
    once = policies.division_filter(n, e)
    assert pairs(policies.division_filter(n, once)) == pairs(once)


def test_cleanup_keeps_pairs_at_the_limit(spark):
    n = nodes(spark, [(1, 1, 0, 0, 0), (2, 2, 0, 0, 3.5), (3, 1, 0, 20, 0), (4, 2, 0, 20, 3.6), (5, 1, 0, 40, 0)])
    left = policies.component_cleanup(n, edges(spark, [(1, 2, 1), (3, 4, 1)]))
    assert {r.node_id for r in left.collect()} == {1, 2}


def test_gap_and_bridge(spark):
    rows = [(1, 1, 0, 0, 0), (2, 2, 0, 0, 2), (3, 3, 0, 0, 4), (4, 4, 0, 0, 6), (21, 1, 0, 60, 0), (22, 2, 0, 60, 2), (23, 3, 0, 60, 4)]
    n = nodes(spark, rows)
    e = edges(spark, [(1, 2, 0.9), (3, 4, 0.9)])
    census = policies.gap_census(n, e)
    assert {r.type for r in census.where("b_id in (2, 3)").collect()} == {"LEFT_MISSING", "RIGHT_MISSING"}
    assert pairs(policies.mutual_policy(census)) == {(2, 3)} == pairs(policies.mutual_policy(policies.gap_census(n, e, residual=5.0)))
    b = policies.strict_bridges(policies.bridge_census(n, e)).collect()
    assert [(r.a_id, r.b_id, r.c_id) for r in b] == [(21, 22, 23)]
    reasons = policies.repair_reasons(spark.createDataFrame([("d", 2, 3), ("d", 1, 2), ("d", 1, 99), ("d", 3, 22)], "dataset string, source_id long, target_id long"), n, e)
    assert {(r.source_id, r.target_id): r.reason for r in reasons.collect()} == {(2, 3): "added", (1, 2): "existing_edge", (1, 99): "missing_endpoint", (3, 22): "degree_conflict"}


def test_components_and_predecessors(spark):
    n = nodes(spark, [(i, i, 0, 0, 0) for i in range(1, 12)])
    e = edges(spark, [(i, i + 1, 1) for i in range(1, 11) if i != 6])
    c = {r.node_id: r.component for r in topology.components(n, e).collect()}
    assert c == {i: 1 if i <= 6 else 7 for i in range(1, 12)}
    p = {r.node_id: (r.prev_id, r.prev2_id) for r in topology.predecessors(e, n).collect()}
    assert p[3] == (2, 1) and p[8] == (7, None) and 7 not in p


def test_components_of_long_tracks_and_merges(spark):
    n = nodes(spark, [(i, i, 0, 0, 0) for i in range(1, 101)] + [(201, 1, 0, 9, 0), (202, 1, 0, 9, 5), (203, 2, 0, 9, 2), (204, 3, 0, 9, 2)])
    track = [(i, i + 1, 1) for i in range(1, 100)]
    c = {r.node_id: r.component for r in topology.components(n, edges(spark, track)).collect()}
    assert {c[i] for i in range(1, 101)} == {1} and c[204] == 204
    merge = edges(spark, [*track, (201, 203, 1), (202, 203, 1), (203, 204, 1)])
    c = {r.node_id: r.component for r in topology.components(n, merge).collect()}
    assert {c[i] for i in range(1, 101)} == {1} and {c[i] for i in range(201, 205)} == {201}
    low = n.withColumn("high_conf", F.lit(False))
    assert policies.confidence_pruning(low, edges(spark, track)).count() == 100


def test_repairs_in_order(spark):
    n = nodes(spark, [(1, 1, 0, 0, 0), (2, 1, 0, 0, 2), (3, 2, 0, 0, 1), (4, 2, 0, 0, 3), (5, 3, 0, 0, 1), (6, 3, 0, 0, 5), (7, 4, 0, 0, 5)]).withColumns({"z": F.col("uz"), "y": F.col("uy"), "x": F.col("ux")})
    none = edges(spark, [(6, 7, 1)])
    p = spark.createDataFrame([("d", 1, 3), ("d", 2, 3), ("d", 2, 4), ("d", 1, 99), ("d", 6, 7), ("d", 6, 5)], "dataset string, source_id long, target_id long")
    assert {(r.source_id, r.target_id): r.reason for r in policies.repair_reasons(p, n, none).collect()} == {(1, 3): "added", (2, 3): "degree_conflict", (2, 4): "added", (1, 99): "missing_endpoint", (6, 7): "existing_edge", (6, 5): "degree_conflict"}
    b = spark.createDataFrame([("d", 2, 1, 3, 5), ("d", 2, 1, 4, 6), ("d", 3, 3, 5, 7), ("d", 3, 4, 6, 7)], "dataset string, t int, a_id long, b_id long, c_id long")
    got = {(r.a_id, r.b_id, r.c_id): r.reason for r in policies.bridge_reasons(b, n, none).collect()}
    assert got == {(1, 3, 5): "added", (1, 4, 6): "degree_conflict", (3, 5, 7): "existing_edge", (4, 6, 7): "existing_edge"}
    (r,) = policies.added_edges(p.where("source_id = 2 AND target_id = 4"), n).collect()
    assert r.edge_prob == 0 and r.edge_dist == 0.25


def test_a_long_chain_of_rivals(spark):
    rows = [("x", k, f"s{k}", f"s{k + 1}") for k in range(100)]
    got = greedy.ordered_greedy(spark.createDataFrame(rows, "dataset string, ord long, a string, b string"), ["dataset"], ["ord"], ["a", "b"])
    assert {r.ord for r in got.collect()} == set(range(0, 100, 2))


def test_rings_equal_whole_frames(spark):
    rng = random.Random(8)
    a = nodes(spark, [(i, 1 + i % 3, *(rng.uniform(0, 60) for _ in range(3))) for i in range(90)] + [(500, 1, 900, 900, 900)]).drop("high_conf")
    b = a.select("dataset", "t", F.col("node_id").alias("other_id"), *[(F.col(u) + 0.5).alias(u) for u in ("uz", "uy", "ux")])
    query = ["dataset", "node_id"]
    near = spatial.knn(a, b, ["dataset", "t"], query, "other_id", 4, radius=6.0)
    every = spatial.nearest(spatial.frame_pairs(a, b, ["dataset", "t"]), query, "other_id", 4)
    key = lambda df: {(r.node_id, r.other_id, r.rk) for r in df.collect()}
    assert key(near) == key(every)


def test_division_accounting(spark):
    """A right fork, a fork where the annotation goes on without dividing, one that nothing judges, and a missed division; the second daughter of the first is shown by a child."""
    gt = edges(spark, [(1, 2, 1), (1, 3, 1), (3, 4, 1), (11, 12, 1), (31, 32, 1), (31, 33, 1)])
    pred = edges(spark, [(101, 102, 1), (101, 103, 1), (103, 104, 1), (111, 112, 1), (111, 113, 1), (121, 122, 1), (121, 123, 1)])
    m = spark.createDataFrame([("d", 1, a, b) for a, b in [(1, 101), (2, 102), (4, 104), (11, 111), (12, 112), (31, 131)]], "dataset string, t int, gt_id long, node_id long")
    counts, verdict = metrics.division_accounting(pred, gt, m)
    assert {r.source_id: r.verdict for r in verdict.collect()} == {101: "tp", 111: "fp", 121: "not_evaluated"}
    assert [(r.tp, r.fp, r.fn) for r in counts.collect()] == [(1, 1, 1)]


def test_assignments_equal_all_permutations():
    import pandas as pd

    rng = random.Random(4)
    for _ in range(40):
        pairs_ = [(i, 10 + j, round(rng.uniform(0, 7), 3)) for i in range(3) for j in range(3) if rng.random() < 0.7]
        got = metrics.solve(pd.DataFrame(pairs_, columns=["gt_id", "node_id", "dist"])) if pairs_ else pd.DataFrame({"dist": []})
        cost = {(i, j): c for i, j, c in pairs_}
        best = min(sum(cost.get((i, j), metrics.UNMATCHED) for i, j in enumerate(p)) for p in itertools.permutations([10, 11, 12, 20, 21, 22], 3))
        assert abs(got.dist.sum() + metrics.UNMATCHED * (3 - len(got)) - best) < 1e-6


def test_manifest_columns(spark, tmp_path):
    header = "dataset,prefix,fold,n_frames,estimated_nodes,estimated_per_frame,sparse_gt_nodes,sparse_gt_edges,sparse_gt_per_frame,sparse_fraction,annotated_frames,n_divisions,has_division,density_bin,is_downloadable_test_overlap"
    (tmp_path / "m.csv").write_text(header + "\nd_1,d,3,76,25755,338.9,52,50,0.68,0.002,52,7,1,2,True\n")
    (r,) = submission.read_manifest(spark, str(tmp_path / "m.csv")).collect()
    assert (r.sparse_gt_nodes, r.sparse_fraction, r.n_divisions, r.density_bin, r.is_downloadable_test_overlap) == (52, 0.002, 7, 2, True)
    (tmp_path / "short.csv").write_text("dataset,prefix\nd_1,d\n")
    with pytest.raises(ValueError, match="not the columns"):
        submission.read_manifest(spark, str(tmp_path / "short.csv"))


def test_grid_join_equals_all_pairs(spark):
    rng = random.Random(3)
    a = nodes(spark, [(i, 1, rng.uniform(-20, 20), rng.uniform(-20, 20), rng.uniform(-20, 20)) for i in range(80)]).drop("high_conf")
    b = a.select("dataset", "t", F.col("node_id").alias("other_id"), *[(F.col(u) + 0.5).alias(u) for u in ("uz", "uy", "ux")])
    near = spatial.within(a, b, ["dataset", "t"], 6.0)
    every = spatial.frame_pairs(a, b, ["dataset", "t"]).where("dist <= 6")
    assert pairs(near, "node_id", "other_id") == pairs(every, "node_id", "other_id")


def test_ordered_greedy_equals_a_loop(spark):
    rng = random.Random(5)
    rows = [(d, k, f"s{rng.randrange(9)}", f"t{rng.randrange(9)}") for d in ("x", "y") for k in range(40)]
    got = greedy.ordered_greedy(spark.createDataFrame(rows, "dataset string, ord long, a string, b string"), ["dataset"], ["ord"], ["a", "b"])
    want, used = set(), set()
    for d, k, a, b in sorted(rows, key=lambda r: (r[0], r[1])):
        if (d, a) not in used and (d, b) not in used:
            used |= {(d, a), (d, b)}
            want.add((d, k))
    assert pairs(got, "dataset", "ord") == want


def test_assignment_is_cheapest():
    rng = np.random.default_rng(0)
    for _ in range(30):
        cost = rng.random((4, 6))
        to = metrics.assign(cost)
        assert len(set(to)) == 4
        best = min(cost[range(4), list(p)].sum() for p in itertools.permutations(range(6), 4))
        assert abs(cost[range(4), to].sum() - best) < 1e-9


def test_matching_prefers_the_least_total(spark):
    g = nodes(spark, [(1, 1, 0, 0, 0), (2, 1, 0, 0, 3), (3, 1, 0, 90, 0)])
    n = nodes(spark, [(11, 1, 0, 0, 2), (12, 1, 0, 0, 6.9), (13, 1, 0, 97.1, 0)])
    assert pairs(metrics.match_nodes(g, n), "gt_id", "node_id") == {(1, 11), (2, 12)}


def test_graph_and_csv_round_trip(spark, tmp_path):
    n = nodes(spark, [(1, 1, 0.5, 1, 2), (2, 2, 1.5, 1, 2)]).withColumnsRenamed({"uz": "z", "uy": "y", "ux": "x"})
    e = edges(spark, [(1, 2, 1)])
    submission.write_graph(n, e, str(tmp_path / "g"))
    n2, e2 = submission.read_graph(spark, str(tmp_path / "g"), ["node_id", "t", "nothing"])
    assert n2.columns == ["node_id", "t"] and e2.count() == 1
    rows = submission.rows(n, e)
    submission.write_submission(rows, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True, schema=rows.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert [r.z for r in submission.split(back)[0].orderBy("node_id").collect()] == [0, 2]


def test_fold_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"split": 0, "train": ["x"], "test": ["y"]}]')
    (tmp_path / "b.json").write_text('{"folds": [{"split": 0, "train": ["x"], "test": ["y"]}]}')
    assert submission.read_folds(spark, str(tmp_path / "a.json")).collect() == submission.read_folds(spark, str(tmp_path / "b.json")).collect()
