"""How many rows the grid joins and ranks of gaps and peaks copy and deal out, and that pairs are those of loops."""

import math
import random

import pytest
from test_contests import study

from strandflow.operators import detection, spatial
from strandflow.plans import contests, gaps


@pytest.fixture
def fixed(spark):
    """Plans as they are planned, whose nodes keep their counts."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_nodes(df):
    todo, out = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def exploded(df):
    """The pairs, and the most rows that an explode made of the probes."""
    rows = df.collect()
    made = [n.metrics().apply("numOutputRows").value() for n in plan_nodes(df) if n.nodeName().startswith("Generate")]
    return rows, max(made)


def exchanges(df):
    return sum(n.nodeName() == "Exchange" for n in plan_nodes(df))


def graph(spark, seed):
    nodes, edges = study(seed)
    n = spark.createDataFrame([("a", i, t, *p) for i, (t, p) in nodes.items()], "dataset string, node_id long, t int, uz double, uy double, ux double")
    return n, spark.createDataFrame([("a", *e) for e in edges], "dataset string, source_id long, target_id long")


def test_within_copies_probes_to_few_cells(fixed):
    rng = random.Random(5)
    place = lambda: [rng.uniform(-90, 90) for _ in range(3)]
    a, b = {i: place() for i in range(1500)}, {i: place() for i in range(600)}
    side = lambda rows, k: fixed.createDataFrame([(1, i, *p) for i, p in rows.items()], f"t int, {k} long, uz double, uy double, ux double")
    got, made = exploded(spatial.within(side(a, "i"), side(b, "j"), ["t"], 8.0))
    assert {(r.i, r.j) for r in got} == {(i, j) for i in a for j in b if math.dist(a[i], b[j]) <= 8}
    assert made < 5 * len(a)  # eight each before
    got, made = exploded(spatial.within(side(a, "i"), side(b, "j"), ["t"], 8.0, 8.0))
    assert len(got) == sum(math.dist(p, q) <= 8 for p in a.values() for q in b.values()) and made < 3 * len(a)


def test_gaps_reach_only_frames_of_targets(spark):
    n, e = graph(spark, 3)
    s = spark.createDataFrame([("a", 1, 2), ("a", 2, 9), ("b", 3, 1)], "dataset string, source_id long, at int")
    k = spark.createDataFrame([("a", 12), ("a", 4), ("b", 30)], "dataset string, t int")
    got = sorted((r.source_id, r.dt) for r in gaps.spans(s, k).collect())
    assert got == [(1, dt) for dt in range(3, 11)] + [(2, 3)] + [(3, dt) for dt in range(3, 14)]
    assert gaps.proposals(n, e).count() > 0


def test_ranks_of_gaps_are_dealt_once_for_each_end(fixed):
    p = fixed.createDataFrame([("a", 1, 2, 3, None, None, 1.0, 2.0, 1, 1, 0.5, None)], "dataset string, source_id long, target_id long, dt int, incumbent long, incumbent_residual double, forward double, backward double, rf int, rb int, per_frame double, improvement double")
    assert exchanges(gaps.features(gaps.shortlist(p))) <= 3  # nine before
    c = fixed.createDataFrame([("a", 1, 2, 3, True, False, 1.0, None, 0.5, None, 1, 0.1, 0.2, 0.3, 0.4, 0.5)], "dataset string, source_id long, target_id long, dt int, so boolean, oc boolean, si double, ti double, sg double, tg double, cuts int, sp double, tp double, sym double, mx double, gm double")
    assert exchanges(contests.features(c)) <= 3


def peaks(seed):
    rng = random.Random(seed)
    return {tuple(rng.randrange(m) for m in (20, 60, 60)): rng.randrange(880, 1000) / 1000 for _ in range(1500)}


@pytest.mark.parametrize("half", [(2, 4, 4), (3, 6, 6), (0, 1, 2)])
def test_boxes(fixed, half):
    p = peaks(7)
    near = lambda u, v: all(abs(a - b) <= h for a, b, h in zip(u, v, half, strict=True))
    df = fixed.createDataFrame([("a", 1, *k, v) for k, v in p.items()], "dataset string, t int, z int, y int, x int, prob double")
    got, made = exploded(detection.box_pairs(df, half))
    assert sorted((r.z, r.y, r.x, r.oz, r.oy, r.ox) for r in got) == sorted((*u, *v) for u in p for v in p if near(u, v))
    assert made < 4.5 * len(p)  # 27 each before
    top = {(r.z, r.y, r.x) for r in detection.local_maxima(df, 0.95, half).collect()}
    assert top == {u for u in p if p[u] > 0.95 and not any(near(u, v) and p[v] > p[u] for v in p)}


@pytest.mark.parametrize("seed", [1, 2])
def test_census_looks_for_both_sides_at_once(spark, monkeypatch, seed):
    from strandflow.operators import policies

    calls, knn = [], spatial.knn
    monkeypatch.setattr(spatial, "knn", lambda *a, **k: calls.append(a) or knn(*a, **k))
    n, e = graph(spark, seed)
    got = {(r.type, r.b_id): (r.a_id, r.c_id, round(r.residual, 6), round(r.margin, 6)) for r in policies.gap_census(n, e).collect()}
    assert len(calls) == 1  # two before, each over all nodes

    nodes, edges = study(seed)
    out, into = {}, {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        into.setdefault(b, []).append(a)
    first, last = min(t for t, _ in nodes.values()), max(t for t, _ in nodes.values())
    want = {}
    for b, (t, p) in nodes.items():
        for kind, link, none, shift, free, stop in (("LEFT_MISSING", out, into, -1, out, first), ("RIGHT_MISSING", into, out, 1, into, last)):
            if b in none or len(link.get(b, [])) != 1 or t == stop:
                continue
            m = link[b][0]
            aim = [2 * x - y for x, y in zip(p, nodes[m][1], strict=True)]
            near = sorted((math.dist(aim, q), k) for k, (u, q) in nodes.items() if u == t + shift and k not in free)
            if near:
                o = near[0][1]
                a, c = (o, m) if kind == "LEFT_MISSING" else (m, o)
                want[kind, b] = a, c, round(near[0][0], 6), round(near[1][0] - near[0][0], 6) if len(near) > 1 else math.inf
    assert got == want and len(got) > 10
