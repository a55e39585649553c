"""A Merkle manifest of a dataset with a witness for each row, grown by aligned append.

Each row is a leaf, each source a tree of runs of ARITY nodes, and the roots of the sources form one tree more. Rows are numbered within
their source by a distributed sort (range partitions, counts per partition, offsets) and dealt out in aligned blocks of BLOCK leaves.
Inside a block `OpenTree` appends leaf after leaf: each holds a partial witness, the siblings known so far, in the subtrees that are still
open; when a run is complete, the witnesses of all leaves below each of its nodes are extended by that node's siblings and the run's
digest is appended one level up. The roots of the blocks are then further appends to the same kind of tree, in blocks of their own, until one is left;
on the way back each block's witness extends those of its nodes. A block is bounded, so that no source, however hot, meets in one task.

`extended` appends rows to a stored manifest: full blocks stay as they are, only the open one of each source is taken up again.

Cases: a null field counts as `-`. Rows with a null doc_id come first in their source, ties go by leaf; repeated rows are leaves of their own. A null
source is a source of its own, before all others. Empty and very long texts are hashed whole. An empty table has no leaves and no root. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.llm.common import id_bucket, save

ARITY = 16
BLOCK = ARITY**2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<at:int,siblings:string>>"


def digest(parts: str) -> str:
    return hashlib.sha256(parts.encode()).hexdigest()


class OpenTree:
    """Appends digests in order to a tree of the given number of levels; paths holds each one's witness, (place in the run, siblings) by level."""

    def __init__(self, levels: int):
        self.levels, self.paths = levels, []
        self.open: list[list[tuple[str, range]]] = [[] for _ in range(levels + 1)]

    def append(self, leaf: str) -> None:
        self.paths.append([])
        self._add(0, leaf, range(len(self.paths) - 1, len(self.paths)))

    def _add(self, level: int, node: str, below: range) -> None:
        self.open[level].append((node, below))
        if level < self.levels and len(self.open[level]) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        every = [node for node, _ in run]
        for at, (_, below) in enumerate(run):
            siblings = "".join(every[:at] + every[at + 1 :])
            for leaf in below:
                self.paths[leaf].append({"at": at, "siblings": siblings})
        self._add(level + 1, digest("".join(every)), range(run[0][1].start, run[-1][1].stop))

    def close(self) -> str:
        """The root; runs that are still open are complete as they are."""
        for level in range(self.levels):
            if self.open[level]:
                self._complete(level)
        return self.open[self.levels][0][0]


def appended(block: int, nodes: list[str]) -> OpenTree:
    """The tree of a block. A first block that isn't full is all of its tree, so it ends at a single node; others end at the block's level."""
    levels, size = 0, 1
    while size < (len(nodes) if block == 0 else BLOCK):
        levels, size = levels + 1, size * ARITY
    tree = OpenTree(levels)
    for node in nodes:
        tree.append(node)
    return tree


def leaf_digest(fields: dict[str, Column]) -> Column:
    """SHA-256 of the fields, each `-` or its UTF-8 byte count, a colon and its value."""
    shown = [fields[name].cast("string") for name in FIELDS]
    return F.sha2(F.concat(*[F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in shown]), 256)


def leaves(docs: DataFrame, changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """tree (the source, so spelled that null sorts first), doc_id, node (leaf digest), claim (digest with the changed fields where asked, else null)."""
    fields = {c: F.col(c) for c in FIELDS}
    claim = F.when(where, leaf_digest(fields | changed)) if changed else F.lit(None).cast("string")
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(fields).alias("node"), claim.alias("claim"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows (a table in files) with pos, their place among the rows of their tree by order.

    Range partitions are sorted each on its own; a count per partition and tree gives where each goes on. Only these counts meet by tree.
    """
    part, at = F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")
    laid = save(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).select("*", part, at))
    counts = laid.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("tree", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return laid.join(shift, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def blocked(nodes: DataFrame) -> DataFrame:
    """tree, block, nodes (at most BLOCK, by pos) of rows (tree, pos, node and more)."""
    kept = F.struct("pos", *[c for c in nodes.columns if c not in ("tree", "pos")])
    return nodes.groupBy("tree", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(kept)).alias("nodes"))


def _roots(batches):
    import pyarrow as pa

    for batch in batches:
        roots = [appended(b, [n["node"] for n in nodes]).close() for b, nodes in zip(batch.column("block").to_pylist(), batch.column("nodes").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("block"), pa.array(roots, pa.string())], names=["tree", "pos", "node"])


def layers(blocks: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of leaves, of block roots, of their block roots and so on, up to one block a tree; and the roots (tree, node) of all trees."""
    out = [save(blocks)]
    while True:
        roots = save(out[-1].mapInArrow(_roots, "tree string, pos long, node string"))
        if roots.where("pos > 0").isEmpty():
            return out, roots.select("tree", "node")
        out.append(save(blocked(roots)))


def _witnesses(carried: list[str]):
    def run(batches):
        """For each node of each block its witness, extended by the block's, and what the row and the block carry along."""
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                tree = appended(row["block"], [n["node"] for n in row["nodes"]])
                tree.close()
                n = len(row["nodes"])
                columns = [pa.array([row["tree"]] * n, pa.string()), pa.array([p + row["above"] for p in tree.paths], pa.list_(pa.struct([("at", pa.int32()), ("siblings", pa.string())])))]
                columns += [pa.array([row[c]] * n, pa.string()) for c in ("subroot", "root")]
                columns += [pa.array([v[c] for v in row["nodes"]], pa.int64() if c in ("pos", "doc_id") else pa.string()) for c in carried]
                yield pa.RecordBatch.from_arrays(columns, names=["tree", "witness", "subroot", "root", *carried])

    return run


def descended(built: list[DataFrame], above: DataFrame) -> DataFrame:
    """Witnesses of the lowest layer's nodes: above (tree, above, subroot, root) is that of each tree's root."""
    for i, blocks in enumerate(reversed(built)):
        carried = [f.name for f in blocks.schema["nodes"].dataType.elementType]
        kind = f"tree string, witness {STEP}, subroot string, root string, " + ", ".join(f"{c} {'long' if c in ('pos', 'doc_id') else 'string'}" for c in carried)
        met = blocks.join(above, "tree" if i == 0 else ["tree", "block"])
        found = met.mapInArrow(_witnesses(carried), kind)
        above = found.select("tree", F.col("pos").alias("block"), F.col("witness").alias("above"), "subroot", "root")
        if i < len(built) - 1:
            above = save(above)
    return found


def witnesses(blocks: DataFrame) -> DataFrame:
    """tree, doc_id, node (leaf), claim, witness, subroot, root of each leaf in blocks (of `blocked`)."""
    built, subroots = layers(blocks)
    tops, root = layers(blocked(numbered(save(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node")), "name")))
    nothing = F.array().cast(STEP).alias("above")
    sources = descended(tops, root.select("tree", nothing, F.col("node").alias("subroot"), F.col("node").alias("root")))
    sources = save(sources.select(F.col("name").alias("tree"), F.col("witness").alias("above"), F.col("node").alias("subroot"), "root"))
    return descended(built, sources)


def folded(leaf: Column, witness: Column) -> Column:
    """The root that a leaf and its witness give."""

    def step(node: Column, x: Column) -> Column:
        left = F.substring(x["siblings"], F.lit(1), x["at"] * 64)
        return F.sha2(F.concat(left, node, F.substring(x["siblings"], x["at"] * 64 + 1, F.length(x["siblings"]))), 256)

    return F.aggregate(witness, leaf, step)


def built(docs: DataFrame) -> DataFrame:
    """The stored form of a manifest: aligned blocks of leaves (tree, block, nodes)."""
    return save(blocked(numbered(save(leaves(docs)), "doc_id", "node")))


def extended(blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """A stored manifest with docs appended, each source's after those it has. Full blocks are not opened."""
    sizes = blocks.groupBy("tree").agg(F.sum(F.size("nodes")).alias("had"))
    new = numbered(save(leaves(docs)), "doc_id", "node").join(sizes, "tree", "left").withColumn("pos", F.col("pos") + F.coalesce("had", F.lit(0))).drop("had")
    new = save(new)
    full = F.size("nodes") == BLOCK
    again = blocks.where(~full).select("tree", F.explode("nodes").alias("n")).select("tree", "n.*")
    return save(blocks.where(full).unionByName(blocked(again.unionByName(new))))


def manifest_report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 of every row, and what folding a claim gives: rows whose doc_id has a crc32 that 5 divides claim
    a text with A-Z lower-cased, all others what they are."""
    tampered = {"text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")}
    rows = numbered(save(leaves(docs, tampered, id_bucket(5) == 0)), "doc_id", "node")
    found = witnesses(blocked(rows))
    proof = F.sha2(F.concat_ws("", F.transform("witness", lambda x: x["siblings"])), 256)
    out = found.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("claim", "node"), F.col("witness")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
