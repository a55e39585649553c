"""Choice of gates and folds that stand apart, against plain loops."""

import itertools
import random
from fractions import Fraction

import pytest

from strandflow.plans import gates


def inside(f, gate):
    sep, angle, arm, balance = f
    return sep >= gate[0] and angle == angle and angle >= gate[1] and arm <= gate[2] and balance <= gate[3]


def fork(rng):
    return rng.uniform(3, 9), float("nan") if rng.random() < 0.1 else rng.uniform(50, 180), rng.uniform(4, 12), rng.choice([0.1, 0.45, 0.55])


@pytest.mark.parametrize("seed", [1, 2])
def test_gates_against_a_loop(spark, seed):
    rng = random.Random(seed)
    truth = [(rng.randrange(3), fork(rng)) for _ in range(80)]
    seen = [fork(rng) for _ in range(40)] + [(6.5, 130.0, 7.0, 0.1)] * 30  # many pass the frozen gate: others may accept three times as many
    columns = "sep double, angle double, arm double, balance double"
    folds = gates.save(gates.by_fold(spark.createDataFrame([(fold, *f) for fold, f in truth], f"fold int, {columns}")))
    accepted = gates.gated(spark.createDataFrame(seen, columns)).where("inside").groupBy(*gates.GRID).count().withColumnRenamed("count", "accepted")
    got = {tuple(r[k] for k in gates.GRID): r for r in gates.judged_gates(folds, gates.save(accepted)).collect()}
    grid = list(itertools.product(*gates.GRID.values()))
    assert set(got) == set(grid)
    frozen = tuple(gates.FROZEN.values())
    recall = lambda gate, fold=None: Fraction(sum(inside(f, gate) for x, f in truth if fold in (None, x)), sum(fold in (None, x) for x, _ in truth))
    cost = {gate: sum(inside(f, gate) for f in seen) for gate in grid}
    eligible = [
        gate for gate in grid
        if gate != frozen and recall(gate) >= recall(frozen) + Fraction(15, 100) and min(recall(gate, x) for x in range(3)) >= recall(frozen) and 0 < cost[gate] <= 3 * cost[frozen]
    ]
    best = {}
    for gate in sorted(eligible, key=lambda x: (cost[x], x)):
        best.setdefault(recall(gate), gate)
    assert {gate for gate, r in got.items() if r.eligible} == set(eligible) and len(eligible) > 3
    assert {gate for gate, r in got.items() if r.chosen} == set(best.values()) and len(best) < len(eligible)
    assert all(r.accepted == cost[gate] and r.passed == recall(gate) * len(truth) for gate, r in got.items())


def test_fold_outliers(spark):
    mark = lambda rows: {r.fold: r.outlier for r in gates.outliers(spark.createDataFrame(rows, "fold int, n long, k long")).collect()}
    assert mark([(0, 10, 5), (1, 10, 9), (2, 10, 8)]) == {0: True, 1: False, 2: False}
    assert mark([(0, 10, 7), (1, 10, 8), (2, 10, 9)]) == {0: False, 1: False, 2: False}  # exactly ten per cent apart isn't more
    assert mark([(0, 100, 99), (1, 10, 5), (2, 10, 5)]) == {0: True, 1: False, 2: False}
    assert mark([(3, 10, 5)]) == {3: False}
    assert mark([]) == {}


def test_no_annotated_divisions(spark):
    none = spark.createDataFrame([], "fold int, sep double, angle double, arm double, balance double")
    accepted = gates.gated(none.drop("fold")).groupBy(*gates.GRID).count().withColumnRenamed("count", "accepted")
    assert gates.judged_gates(gates.by_fold(none), accepted).count() == 0
