"""Settings scored as changes against each setting alone; ranks, quantiles and grouped logistic models against plain versions; new queries against their SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow.operators import logistic, ranks, settings
from strandflow.operators import metrics as M
from strandflow.plans import registry
from test_queries import DATA, plain

NEW = [
    "continuation_grid", "repair_grid", "rewire_scores", "bridge_grid", "bridge_outcomes", "bridge_insertion", "fold_rank_ensemble", "division_shapes", "pair_ceiling_by_budget", "mnn_coherence",
    "local_motion", "restored_forks", "gate_counterfactual", "temporal_contrast", "annotation_density", "component_confidence_quartiles", "edge_prob_quantiles", "gap_scores",
    "time_steps", "isolated_match_rate", "division_rule_recall", "component_motion",
]


@pytest.mark.parametrize("name", NEW)
def test_new_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), con.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def random_study(seed):
    """Annotated tracks with divisions, detections around them, links with errors, and changes of three settings."""
    rng = np.random.default_rng(seed)
    gt, gt_edges, nodes, edges, added, removed, new = [], [], [], [], [], [], []
    for d in ("x_1", "y_2"):
        before, number = [], 0
        for t in range(1, 6):
            now = []
            if t == 1:
                parents = [None] * 5
            else:
                parents = [p for p in before for _ in range(2 if rng.random() < 0.25 else 1)]
            for p in parents:
                number += 1
                at = rng.uniform(0, 25, 3) if p is None else p[1] + rng.normal(0, 3, 3)
                now.append((number, at))
                gt.append((d, t, number, *map(float, at)))
                if p is not None:
                    gt_edges.append((d, p[0], number))
            before = now
        seen = [(t, i, np.array(at)) for dd, t, i, *at in gt if dd == d and rng.random() < 0.85]
        for k, (t, _, at) in enumerate(seen):
            nodes.append((d, t, 1000 + k, *map(float, at + rng.normal(0, 2, 3))))
        mine = [n for n in nodes if n[0] == d]
        pairs = [(a[2], b[2]) for a in mine for b in mine if b[1] == a[1] + 1]
        chosen = [pairs[i] for i in rng.choice(len(pairs), min(len(pairs), 25), replace=False)]
        edges += [(d, *p) for p in chosen]
        free = [p for p in pairs if p not in chosen]
        for s in ("one", "two", "three"):
            added += [(s, d, *free[i]) for i in rng.choice(len(free), 4, replace=False)]
            removed += [(s, d, *chosen[i]) for i in rng.choice(len(chosen), 3, replace=False)]
            if s == "two":
                continue
            for k in range(3):
                t, _, at = seen[rng.integers(len(seen))]
                new.append((s, d, t, 5000 + k, *map(float, at + rng.normal(0, 1, 3))))
                near = [n[2] for n in mine if n[1] == t + 1]
                if near:
                    added.append((s, d, 5000 + k, int(rng.choice(near))))
    return gt, gt_edges, nodes, edges, added, removed, new


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_settings_equal_each_run_alone(spark, seed):
    gt, gt_edges, nodes, edges, added, removed, new = random_study(seed)
    point, link = "dataset string, t int, node_id long, uz double, uy double, ux double", "dataset string, source_id long, target_id long"
    gt, gt_edges, nodes, edges = (spark.createDataFrame(r, k).cache() for r, k in ((gt, point), (gt_edges, link), (nodes, point), (edges, link)))
    added, removed = (spark.createDataFrame(r, f"setting string, {link}") for r in (added, removed))
    new = spark.createDataFrame(new, f"setting string, {point}")

    def alone(nodes, edges):
        matches = M.match_nodes(gt, nodes).cache()
        sizes = nodes.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_nodes"), F.max(F.lit(60.0)).alias("estimated_nodes")).withColumn("fold", F.substring("dataset", 3, 1).cast("int"))
        return matches, M.dataset_metrics(M.edge_accounting(edges, gt_edges, matches), M.division_accounting(edges, gt_edges, matches)[0], matches, gt, sizes).cache()

    matches, records = alone(nodes, edges)
    base, changes = settings.Baseline(nodes, edges, gt, gt_edges, matches, records), settings.Changes(added, removed, new)
    shown = ["dataset", "n_nodes", "matched", *settings.COUNTS, "edge_jaccard", "adjusted", "node_recall"]
    got = settings.records(base, changes, ["one", "two", "three", "none"]).select("setting", *shown).toPandas().set_index(["setting", "dataset"]).sort_index()
    for s in ("one", "two", "three", "none"):
        mine = edges.join(removed.where(F.col("setting") == s).drop("setting"), ["dataset", "source_id", "target_id"], "left_anti").unionByName(added.where(F.col("setting") == s).drop("setting"))
        want = alone(nodes.unionByName(new.where(F.col("setting") == s).drop("setting")), mine)[1].select(*shown).toPandas().set_index("dataset").sort_index()
        np.testing.assert_allclose(got.loc[s].to_numpy(float), want.to_numpy(float), atol=1e-12)
    before = records.select(*shown).toPandas().set_index("dataset").sort_index()
    assert (got.loc["none"].to_numpy(float) == before.to_numpy(float)).all()
    assert (got.loc["one"].to_numpy(float) != before.to_numpy(float)).any()


def test_ranks_and_quantiles(spark):
    rng = np.random.default_rng(2)
    values = {g: rng.integers(0, 50, n).astype(float) for g, n in (("a", 1000), ("b", 7), ("c", 1))}
    df = spark.createDataFrame([(g, float(v)) for g, x in values.items() for v in x] + [("a", None), ("d", None)], "g string, v double").repartition(4)
    levels = {"q0": 0.0, "q3": 0.3, "q5": 0.5, "q9": 0.95, "q1": 1.0}
    for r in ranks.quantiles(df, ["g"], "v", levels).collect():
        np.testing.assert_allclose([r[n] for n in levels], np.quantile(values[r.g], list(levels.values())))
    pos = ranks.numbered(df.where("v is not null").withColumn("i", F.monotonically_increasing_id()), ["g"], [F.desc("v"), "i"]).toPandas()
    for g, x in values.items():
        part = pos[pos.g == g].sort_values("pos")
        assert part.pos.tolist() == list(range(len(x)))
        assert (part["of"] == len(x)).all()
        assert part.v.tolist() == sorted(x, reverse=True)
    labelled = df.where("g = 'a' and v is not null").withColumn("y", (F.rand(3) < 0.4).cast("int")).cache()
    pdf = labelled.toPandas()
    p, n = pdf.v[pdf.y == 1].to_numpy(), pdf.v[pdf.y == 0].to_numpy()
    want = ((p[:, None] > n).sum() + (p[:, None] == n).sum() / 2) / (len(p) * len(n))
    assert ranks.auc(labelled, ["g"], "v", "y").first().auc == pytest.approx(want)


def test_logistic_models_of_families_and_folds(spark):
    rng = np.random.default_rng(6)
    rows = []
    for fam, slope in (("a", 1.5), ("b", -0.7)):
        x = rng.normal(3, 2, (400, 2))
        y = (rng.random(400) < 1 / (1 + np.exp(-(slope * (x[:, 0] - 3) - x[:, 1] + 1)))).astype(int)
        rows += [(fam, i % 4, int(y[i]), float(x[i, 0]), float(x[i, 1]), 1.0) for i in range(400)]
    names = ["u", "v", "same"]
    df = spark.createDataFrame(rows, "fam string, fold int, y int, u double, v double, same double").repartition(3)
    got = {(r.fam, r.fold): np.array(r.beta) for r in logistic.fit(df, names, "fam", "fold", "y").collect()}
    assert len(got) == 8
    for (fam, fold), beta in got.items():
        part = np.array([r[2:] for r in rows if r[0] == fam and r[1] != fold])
        y, x = part[:, 0], part[:, 1:]
        dev = x.std(axis=0)
        x = np.hstack([np.ones((len(x), 1)), (x - x.mean(axis=0)) / np.where(dev > 1e-12, dev, 1)])
        w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
        b = np.zeros(4)
        for _ in range(20_000):  # plain gradient descent
            b -= 0.02 / len(y) * 50 * (x.T @ (w * (1 / (1 + np.exp(-x @ b)) - y)) + np.array([0, *b[1:]])) / 50 * 10
        np.testing.assert_allclose(beta, b, atol=1e-4)
    scored = logistic.scored(df, logistic.fit(df, names, "fam", "fold", "y"), names, "fam", "fold")
    assert scored.count() == len(rows)
    assert ranks.auc(scored, ["fam"], "score", "y").agg(F.min("auc")).first()[0] > 0.7


def test_candidate_ceiling_grows_with_the_budget(spark):
    rows = registry.QUERIES["pair_ceiling_by_budget"](spark, DATA).toPandas().sort_values(["fold", "budget"])
    for _, part in rows.groupby("fold"):
        assert part.covered.is_monotonic_increasing
