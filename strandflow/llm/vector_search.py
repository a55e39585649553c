"""Exact top-k search by inner product over a vector-approximation file.

Vectors are integers: floor(SCALE * x) of each component. Equal vectors are one class first, with as many of their smallest ids as can be
asked for, so copies cost nothing. Every dimension is cut into CELLS cells at quantiles of all rows; the approximation file holds one byte a component,
in blocks. The scan deals (block of queries, share of the file) to tasks: a matrix product of the cells' middles and one of their widths bound
each score from both sides, and only vectors whose upper bound reaches the least of the k best lower bounds remain. Then exact vectors are read in the order of
their upper bounds, first a few for each query; what cannot reach the k-th exact score by then is never read.

Cases: vectors that are null, or hold a null or non-finite component, and rows with a null id take no part. Shorter vectors count as padded with zeros. Rows that
repeat an id and vector count once; all rows of the query's own id are left out. Ties go to the smaller id. An empty table gives an empty result;
other columns are ignored. A component of 2^28 or more (after scaling) raises an error, as scores might not fit a long.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.llm.common import save, split_by_keys

SCALE = 256
CELLS = 256  # a byte
BLOCK = 1024  # vectors of a block of the file
SHARE = 8  # blocks that a task scans for a block of queries
QUERIES = 4096  # queries of a block
STRIPE = 256  # queries whose bounds are in memory at once


def whole(embedding: Column) -> Column:
    """The integer components; null where the vector takes no part."""
    ok = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    large = F.raise_error(F.lit("a component is too large: scores might not fit a long"))
    cut = F.transform(embedding, lambda x: F.when(F.abs(x.cast("double") * SCALE) < 2**28, F.floor(x.cast("double") * SCALE).cast("int")).otherwise(large.cast("int")))
    return F.when(ok, cut)


def classes_of(vectors: DataFrame, k: int) -> DataFrame:
    """class_id, v, ids (the k + 1 smallest) of each distinct vector (vec_id, v). Each task passes on k + 1 rows of a vector at most."""
    order = Window.partitionBy("v").orderBy("vec_id")
    least = vectors.withColumn("r", F.dense_rank().over(order)).where(F.col("r") <= k + 1)
    return save(least.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).select(F.monotonically_increasing_id().alias("class_id"), "v", "ids"))


def cell_bounds(classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest value of each dimension's cells: (dimensions, CELLS) each. Quantile sketches over all rows, one row a dimension."""
    shares = F.array(*[F.lit(i / CELLS) for i in range(1, CELLS)])
    rows = classes.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.percentile_approx("x", shares, 10_000).alias("q"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("d").collect()
    edges = np.array([[min(r.lo, 0), *sorted(np.clip(r.q, min(r.lo, 0), None)), max(r.hi, 0) + 1] for r in rows], np.int64).reshape(-1, CELLS + 1)
    return edges[:, :-1], np.maximum(edges[:, 1:] - 1, edges[:, :-1])


def padded(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _approximate(low: np.ndarray):
    def run(batches):
        """Blocks of the file: class ids and the cells of their vectors, a byte a component."""
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                v = padded(part.column("v").to_pylist(), len(low))
                cells = np.stack([np.searchsorted(low[d, 1:], v[:, d], "right") for d in range(len(low))], axis=1) if len(low) else v
                yield pa.RecordBatch.from_arrays([pa.array([part.column("class_id").to_numpy().tobytes()]), pa.array([cells.astype(np.uint8).tobytes()])], names=["ids", "cells"])

    return run


class Scan:
    """Bounds of one block of queries over the blocks of a share; the candidates that remain are those whose upper bound reaches the k best lower bounds."""

    def __init__(self, queries: list[dict], low: np.ndarray, high: np.ndarray, k: int):
        self.ids = np.array([q["class_id"] for q in queries], np.int64)
        self.q = padded([q["v"] for q in queries], len(low)).astype(np.float64)
        self.low, self.high, self.k = low.astype(np.float64), high.astype(np.float64), k
        # bounds are exact below 2^53; beyond that the products' rounding is added
        reach = np.abs(self.q) @ (2 * np.maximum(np.abs(low), np.abs(high)).max(axis=1, initial=0))
        self.slack = np.where(reach < 2.0**52, 0.0, reach * 2.0**-40)
        self.best = np.full((len(self.ids), k), -np.inf)
        self.found: list[tuple[np.ndarray, ...]] = []

    def block(self, ids: np.ndarray, cells: np.ndarray) -> None:
        at = np.arange(len(self.low))
        lo, hi = self.low[at, cells], self.high[at, cells]
        middle, width = (lo + hi).T, (hi - lo).T
        for i in range(0, len(self.ids), STRIPE):
            q = self.q[i : i + STRIPE]
            score, spread = q @ middle, np.abs(q) @ width + self.slack[i : i + STRIPE, None]
            below, above = score - spread, score + spread
            best = np.concatenate([self.best[i : i + STRIPE], below], axis=1)
            self.best[i : i + STRIPE] = np.partition(best, -self.k, axis=1)[:, -self.k :]
            a, b = np.nonzero(above >= self.best[i : i + STRIPE].min(axis=1)[:, None])
            self.found.append((a + i, ids[b], below[a, b], above[a, b]))

    def result(self) -> tuple[np.ndarray, ...]:
        if not self.found:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64, np.float64))
        row, ids, below, above = (np.concatenate(x) for x in zip(*self.found, strict=True))
        keep = above >= self.best.min(axis=1)[row]
        return self.ids[row[keep]], ids[keep], below[keep], above[keep]


def _scan(low: np.ndarray, high: np.ndarray, k: int):
    def run(batches):
        """Rows sorted by (part, share, kind): a block of queries, then the blocks of the file that it meets here."""
        import pyarrow as pa

        def out(scan):
            return pa.RecordBatch.from_arrays([pa.array(x) for x in scan.result()], names=["query", "class_id", "below", "above"])

        scan = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["queries"] is not None:
                    if scan is not None:
                        yield out(scan)
                    scan = Scan(row["queries"], low, high, k)
                else:
                    ids = np.frombuffer(row["ids"], np.int64)
                    scan.block(ids, np.frombuffer(row["cells"], np.uint8).reshape(len(ids), len(low)))
        if scan is not None:
            yield out(scan)

    return run


def candidates(classes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query, class_id, above (twice the upper bound), place by it: the vectors that may be among the k best of a query (class_id, v in asked)."""
    low, high = cell_bounds(classes)
    file = save(classes.select("class_id", "v").mapInArrow(_approximate(low), "ids binary, cells binary"))
    parts, shares = -(-asked.count() // QUERIES), -(-file.count() // SHARE)
    blocks = file.select(F.explode(F.sequence(F.lit(0), F.lit(max(parts, 1) - 1))).alias("part"), F.pmod(F.xxhash64("ids"), F.lit(max(shares, 1))).cast("int").alias("share"), "ids", "cells")
    queries = asked.groupBy(F.pmod(F.xxhash64("class_id"), F.lit(max(parts, 1))).cast("int").alias("part")).agg(F.collect_list(F.struct("class_id", "v")).alias("queries"))
    queries = queries.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(max(shares, 1) - 1))))
    rows = queries.unionByName(blocks.join(queries.select("part").distinct(), "part", "left_semi"), allowMissingColumns=True)
    ordered = rows.repartition("part", "share").sortWithinPartitions("part", "share", F.col("queries").isNull()).select("queries", "ids", "cells")
    found = ordered.mapInArrow(_scan(low, high, k), "query long, class_id long, below double, above double")
    by_query = Window.partitionBy("query")
    found = found.withColumn("r", F.row_number().over(by_query.orderBy(F.desc("below"))))
    found = found.withColumn("least", F.max(F.when(F.col("r") == k, F.col("below"))).over(by_query)).where("least is null or above >= least")
    return save(found.select("query", "class_id", "above", F.row_number().over(by_query.orderBy(F.desc("above"), "class_id")).alias("place")))


def scored(pairs: DataFrame, classes: DataFrame, asked: DataFrame) -> DataFrame:
    """query, class_id, ids, score of pairs (query, class_id): only the vectors named are shuffled."""
    inside, _ = split_by_keys(classes, pairs.select("class_id").distinct(), ["class_id"])
    met = pairs.join(inside, "class_id").join(asked.select(F.col("class_id").alias("query"), F.col("v").alias("q")), "query")
    product = F.zip_with("q", "v", lambda a, b: F.coalesce(a.cast("long") * b.cast("long"), F.lit(0).cast("long")))
    return save(met.select("query", "class_id", "ids", F.aggregate(product, F.lit(0).cast("long"), lambda x, y: x + y).alias("score")))


def top_k(vectors: DataFrame, queries: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows (vec_id, embedding) but its own for each row that queries picks."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole(F.col("embedding")).alias("v")).where("vec_id is not null and v is not null")
    classes = classes_of(rows, k)
    named = save(rows.where(queries).distinct().join(classes.drop("ids"), "v").select(F.col("vec_id").alias("query_id"), F.col("class_id").alias("query")))
    asked = save(classes.select("class_id", "v").join(named.select(F.col("query").alias("class_id")).distinct(), "class_id", "left_semi"))
    found = candidates(classes, asked, k + 1)
    early = scored(found.where(F.col("place") <= 2 * (k + 1)).select("query", "class_id"), classes, asked)
    by_score = Window.partitionBy("query").orderBy(F.desc("score"))
    sure = early.select("query", "score", F.row_number().over(by_score).alias("r")).where(F.col("r") == k + 1).select("query", F.col("score").alias("sure"))
    late = found.where(F.col("place") > 2 * (k + 1)).join(sure, "query", "left").where("sure is null or above >= 2 * sure").select("query", "class_id")
    every = early.unionByName(scored(save(late), classes, asked)).select("query", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    every = every.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    out = named.join(every, "query").where("query_id <> vec_id").select("query_id", rank.alias("rank"), "vec_id", "score")
    return out.where(F.col("rank") <= k)
