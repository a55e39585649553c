"""Ordered greedy selection with capacities: candidates in a total order are accepted while all their resources have room."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.sources.shared import save


def ordered_greedy(cands: DataFrame, keys: list[str], order: list[str], resources: list[str], rounds: int = 6) -> DataFrame:
    """The accepted candidates, as a loop in ascending order (unique within keys) would accept them, each resource serving one.

    cands has keys, order columns (numbers or strings) and columns named in resources; a candidate takes every resource that it names.
    Rounds: a candidate that is first in order among the undecided at each of its resources is accepted, those that share a
    resource with an accepted one are dropped. Most candidates have few rivals, so few rounds decide nearly all; what long chains of rivals leave
    then is settled by the loop itself, one key at a time.
    """
    id_ = [*keys, *order]
    left = save(cands.withColumn("_r", F.array_distinct(F.array(*[F.col(r).cast("string") for r in resources]))))
    taken = None
    for _ in range(rounds):
        each = left.select(*id_, F.explode("_r").alias("res"))
        w = Window.partitionBy(*keys, "res").orderBy(*order)
        first = each.withColumn("k", F.row_number().over(w)).groupBy(*id_).agg(F.max("k").alias("k")).where("k = 1").select(*id_)
        accepted = save(left.join(first, id_, "left_semi"))
        used = accepted.select(*keys, F.explode("_r").alias("res")).distinct()
        blocked = each.join(used, [*keys, "res"], "left_semi").select(*id_).distinct()
        left = save(left.join(blocked, id_, "left_anti"))
        taken = accepted if taken is None else taken.unionByName(accepted)
        if left.isEmpty():
            return taken.drop("_r")

    def loop(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        used, keep = set(), []
        for r in pdf["_r"]:
            keep.append(used.isdisjoint(r))
            if keep[-1]:
                used.update(r)
        return pdf[keep]

    return taken.unionByName(left.groupBy(*keys).applyInPandas(loop, left.schema)).drop("_r")
