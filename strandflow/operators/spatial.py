"""Distance joins and nearest neighbours within datasets and frames.

The building block is a grid join: cells are some times as wide as the radius, the probe side is sent to the cells that its ball touches (eight at
most; 3.4 on average where cells are four times as wide, 2 where they are eight times), the other side stays in one, and an equi-join on (keys, cell) with an exact distance test follows. The cell is part of the shuffle key, so dense
frames spread. Nearest neighbours without a known radius go through growing rings: only queries that a ring leaves open see the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.functions import geometry as g
from strandflow.sources.shared import save


def within(a: DataFrame, b: DataFrame, keys: list[str], radius: float, wide: float = 4.0) -> DataFrame:
    """Pairs with dist <= radius; both sides have keys and uz, uy, ux, and otherwise different columns. Wide cells (radii, two at least) copy less of a and compare more."""
    cell = lambda x: F.floor(x / F.lit(wide * radius))
    reach = radius * (1 + 1e-9)
    pa = a.select(*[c for c in a.columns if c not in g.AXES], *[F.col(x).alias(f"_a{x}") for x in g.AXES])
    for i, x in enumerate(g.AXES):
        pa = pa.withColumn(f"_c{i}", F.explode(F.sequence(cell(F.col(f"_a{x}") - reach), cell(F.col(f"_a{x}") + reach))))
    pb = b.select(*[c for c in b.columns if c not in g.AXES], *[F.col(x).alias(f"_b{x}") for x in g.AXES], *[cell(F.col(x)).alias(f"_c{i}") for i, x in enumerate(g.AXES)])
    j = pa.join(pb, [*keys, "_c0", "_c1", "_c2"])
    dist = g.norm(tuple(F.col(f"_a{x}") - F.col(f"_b{x}") for x in g.AXES))
    j = j.withColumn("dist", dist).where(F.col("dist") <= radius)
    return j.drop("_c0", "_c1", "_c2", *[f"_{s}{x}" for s in "ab" for x in g.AXES])


def frame_pairs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs of equal keys with their distance: for frames, whose size is bounded by the volume, when no radius is known."""
    pa = a.select(*[c for c in a.columns if c not in g.AXES], *[F.col(x).alias(f"_a{x}") for x in g.AXES])
    pb = b.select(*[c for c in b.columns if c not in g.AXES], *[F.col(x).alias(f"_b{x}") for x in g.AXES])
    dist = g.norm(tuple(F.col(f"_a{x}") - F.col(f"_b{x}") for x in g.AXES))
    return pa.join(pb, keys).withColumn("dist", dist).drop(*[f"_{s}{x}" for s in "ab" for x in g.AXES])


def knn(a: DataFrame, b: DataFrame, keys: list[str], query: list[str], other: str, k: int, radius: float = 16.0, rings: int = 2) -> DataFrame:
    """The k nearest of b for each row of a (named by query), ties by id, with their rank rk.

    A query with k neighbours within a ring's radius is settled by it. Those that no ring settles (thin regions, frames of fewer than k) meet their whole frame.
    """
    left, found = a, None
    for i in range(rings):
        near = nearest(within(left, b, keys, radius * 2**i), query, other, k)
        near = save(near.withColumn("_n", F.max("rk").over(Window.partitionBy(*query))).where(F.col("_n") == k).drop("_n"))
        found = near if found is None else found.unionByName(near)
        left = save(left.join(near.where("rk = 1").select(*query), query, "left_anti"))
    return found.unionByName(nearest(frame_pairs(left, b, keys), query, other, k))


def nearest(pairs: DataFrame, query: list[str], other: str, k: int) -> DataFrame:
    """The k nearest per query, ties by id, with their rank rk."""
    w = Window.partitionBy(*query).orderBy("dist", other)
    return pairs.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def mutual(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs that are each other's nearest (ties by id)."""
    wa = Window.partitionBy("dataset", a).orderBy("dist", b)
    wb = Window.partitionBy("dataset", b).orderBy("dist", a)
    return pairs.withColumn("_ra", F.row_number().over(wa)).withColumn("_rb", F.row_number().over(wb)).where("_ra = 1 AND _rb = 1").drop("_ra", "_rb")
