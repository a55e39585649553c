"""Contested proposals over fifteen frames, against loops over all pairs."""

import math
import random
from collections import defaultdict

import pytest

from strandflow.plans import contests


def study(seed):
    """Tracks of random lengths in fifteen frames, some cut, some forked."""
    rng = random.Random(seed)
    nodes, edges, i = {}, [], 0
    for _ in range(26):
        a = rng.randint(0, 8)
        pos, v = [rng.uniform(0, 30) for _ in range(3)], [rng.uniform(-2, 2) for _ in range(3)]
        last = None
        for t in range(a, rng.randint(a + 3, 15)):
            i += 1
            nodes[i] = (t, tuple(pos))
            if last and rng.random() > 0.15:
                edges.append((last, i))
            if last and rng.random() < 0.05:  # a second child
                nodes[i + 1000] = (t, tuple(p + 1 for p in pos))
                edges.append((last, i + 1000))
            last = i
            pos = [p + w + rng.uniform(-0.7, 0.7) for p, w in zip(pos, v, strict=True)]
    return nodes, edges


def loops(nodes, edges):
    kids, parent = defaultdict(list), {}
    for a, b in edges:
        kids[a].append(b)
        parent[b] = a
    at = lambda k: nodes[k][1]
    bent = lambda m, a, b: math.dist([2 * x for x in at(m)], [x + y for x, y in zip(at(a), at(b), strict=True)])
    rows = []
    for s in nodes:
        if s not in parent or len(kids[s]) > 1:
            continue
        for k in nodes:
            dt = nodes[k][0] - nodes[s][0]
            if not 3 <= dt <= 13 or not kids[k]:
                continue
            p, d = parent[s], min(kids[k])
            f = math.dist([x + (x - y) * dt for x, y in zip(at(s), at(p), strict=True)], at(k))
            b = math.dist([x - (y - x) * dt for x, y in zip(at(k), at(d), strict=True)], at(s))
            if f <= 20 and b <= 20:
                r = {"s": s, "k": k, "delta_t": dt, "f": f, "b": b, "gap_size": dt - 1, "source_pf": f / dt, "target_pf": b / dt}
                r["source_incumbent"] = bent(s, p, kids[s][0]) if kids[s] else None
                r["target_incumbent"] = bent(k, d, parent[k]) if k in parent else None
                rows.append(r)

    def ranked(key, end, other, name, within=()):
        groups = defaultdict(list)
        for r in rows:
            groups[tuple(r[c] for c in (end, *within))].append(r)
        for members in groups.values():
            for n, r in enumerate(sorted(members, key=lambda r: (round(r[key], 9), r[other])), 1):
                r[name] = n
        return groups

    for group in ranked("f", "s", "k", "rf", ["delta_t"]).values():
        for r in group:
            r["bf"] = min(x["f"] for x in group)
    for group in ranked("b", "k", "s", "rb", ["delta_t"]).values():
        for r in group:
            r["bb"] = min(x["b"] for x in group)
    keep = []
    for r in rows:
        r["source_gain"] = None if r["source_incumbent"] is None else r["source_incumbent"] - r["source_pf"]
        r["target_gain"] = None if r["target_incumbent"] is None else r["target_incumbent"] - r["target_pf"]
        need = [x for x in (r["source_gain"], r["target_gain"]) if x is not None]
        r["source_occupied"], r["target_occupied"], r["cuts"] = int(r["source_gain"] is not None), int(r["target_gain"] is not None), len(need)
        r["max_required"], r["min_required"], r["mean_required"] = (max(need), min(need), sum(need) / len(need)) if need else (None, None, None)
        r["dominates"] = int(all(x > 0 for x in need))
        r["min_pf"], r["max_pf"], r["sym_pf"] = min(r["source_pf"], r["target_pf"]), max(r["source_pf"], r["target_pf"]), (r["source_pf"] + r["target_pf"]) / 2
        r["gmean_ratio"] = math.sqrt(r["f"] / max(r["bf"], contests.LEAST) * r["b"] / max(r["bb"], contests.LEAST))
        if min(r["rf"], r["rb"]) <= 3 and max(r["rf"], r["rb"]) <= 8 and (not need or any(x > 0 for x in need)):
            keep.append(r)
    rows = keep
    for key, name in (("sym_pf", "sym"), ("max_pf", "mx"), ("gmean_ratio", "gm")):
        ranked(key, "s", "k", f"s_{name}")
        ranked(key, "k", "s", f"t_{name}")
    rows = [r for r in rows if min(r["s_gm"], r["t_gm"]) <= (20 if r["cuts"] <= 1 else 8)]
    for r in rows:
        r["source_rank"], r["target_rank"] = r["s_gm"], r["t_gm"]
        r["best_rank"], r["worst_rank"], r["rank_sum"] = min(r["s_gm"], r["t_gm"]), max(r["s_gm"], r["t_gm"]), r["s_gm"] + r["t_gm"]
        r["rank_asymmetry"] = abs(math.log1p(r["s_gm"]) - math.log1p(r["t_gm"]))
        r["source_rivals"], r["target_rivals"] = sum(x["s"] == r["s"] for x in rows), sum(x["k"] == r["k"] for x in rows)
        r["source_rank_share"], r["target_rank_share"] = r["s_gm"] / r["source_rivals"], r["t_gm"] / r["target_rivals"]
        r["best_rank_share"] = min(r["source_rank_share"], r["target_rank_share"])
        r["sym_best_rank"], r["max_best_rank"] = min(r["s_sym"], r["t_sym"]), min(r["s_mx"], r["t_mx"])
    return {(r["s"], r["k"]): r for r in rows}


@pytest.fixture(scope="module")
def both(spark):
    made = {f"d{k}": study(k) for k in (3, 4)}
    n = spark.createDataFrame([(d, i, t, *p) for d, (nodes, _) in made.items() for i, (t, p) in nodes.items()], "dataset string, node_id long, t int, uz double, uy double, ux double")
    e = spark.createDataFrame([(d, a * 10_000 + b, a, b, 1.0) for d, (_, edges) in made.items() for a, b in edges], "dataset string, edge_id long, source_id long, target_id long, edge_prob double")
    f = contests.save(contests.features(contests.proposals(n, e)))
    return f, {(d, *k): r for d, (nodes, edges) in made.items() for k, r in loops(nodes, edges).items()}


def test_features(both):
    f, want = both
    got = {(r.dataset, r.source_id, r.target_id): r for r in f.collect()}
    assert set(got) == set(want)
    for key, r in want.items():
        for k in contests.FEATURES:
            a = got[key][f"f_{k}"]
            assert (a is None) == (r[k] is None) and (a is None or math.isclose(a, r[k], abs_tol=1e-6, rel_tol=1e-9)), (key, k)
    assert {r["delta_t"] for r in want.values()} >= set(range(3, 11))  # also gaps that the given tables are too short for
    assert {r["cuts"] for r in want.values()} == {0, 1, 2} and {r["dominates"] for r in want.values()} == {0, 1}
    assert len(contests.FEATURES) == 32


def test_actions(both):
    f, want = both
    got = {(r.dataset, r.source_id, r.target_id) for r in contests.actions(f).collect()}
    used, taken = set(), set()
    for key, r in sorted(want.items(), key=lambda x: (x[0][0], round(x[1]["sym_pf"], 9), x[0])):
        ends = {(key[0], key[1]), (key[0], key[2])}
        if r["s_gm"] <= 1 and r["t_gm"] <= 5 and r["dominates"] and not used & ends:
            used |= ends
            taken.add(key)
    assert got == taken and len(taken) > 5


def test_empty(spark):
    n = spark.createDataFrame([], "dataset string, node_id long, t int, uz double, uy double, ux double")
    e = spark.createDataFrame([], "dataset string, edge_id long, source_id long, target_id long, edge_prob double")
    f = contests.save(contests.features(contests.proposals(n, e)))
    assert f.count() == 0 and contests.actions(f).count() == 0


