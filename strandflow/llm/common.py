"""Shared helpers: tables in the shared checkpoint folder, ids and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share.

    Where the session names none, a local session (tests) gets a temporary folder; on a cluster that is an error, as executors
    couldn't read each other's folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="strandflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def save(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_text(docs: DataFrame) -> DataFrame:
    """doc_id and text, null text as empty; other columns (whatever their names) are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def id_bucket(n: int) -> Column:
    """crc32 of the decimal doc_id modulo n: the fixed split into learning and held-out rows."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node in edges (a, b), by alternating stars.

    A large star links each node's greater neighbours to its least neighbour, a small star its lesser ones;
    chains and hubs both shrink in a logarithmic number of rounds. Both are a minimum per node plus an
    equi-join on the node, which adaptive execution splits where one node is hot. Each round is written to
    the shared folder; the driver sees only two sums that tell whether anything changed.
    """
    spark = edges.sparkSession
    e = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(
                F.array(
                    F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                    F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                )
            ).alias("e")
        ).select("e.a", "e.b").where("a <> b").distinct()
        seen = Observation()
        e = save(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")))
        if (now := seen.get) == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def map_texts(docs: DataFrame, work, schema: str) -> DataFrame:
    """doc_id with what work makes of the texts, in Arrow batches.

    work(texts) gets at most half a million characters of texts (or one longer text) and returns (rows, columns): columns by name in
    schema's order, and the number of the text that each value belongs to (None: one value per text).
    """
    from strandflow.llm import arrays

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in arrays.blocks(texts):
                rows, columns = work(texts[lo:hi])
                ids = batch.column("doc_id").slice(lo, hi - lo)
                if rows is not None:
                    ids = ids.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(v) for v in columns.values()]], names=["doc_id", *columns])

    return with_text(docs).mapInArrow(run, f"doc_id long, {schema}")


def hot_keys(counted: DataFrame, count: str) -> Column:
    """Which rows of counted (one per key, with its number of rows) stand for a hot key: one with more than a thousandth of all
    rows, and more than 100. There are fewer than a thousand such keys at any size, so they may be broadcast."""
    total = counted.agg(F.sum(count)).first()[0] or 0
    return F.col(count) > max(100, total // 1000)


def skew_join(rows: DataFrame, lookup: DataFrame, keys: list[str], count: str, how: str = "left") -> DataFrame:
    """Join (left or inner) of rows to a lookup of one narrow row per key, when one key may hold a large part of the rows.

    lookup has the number of rows of each key in column count. Hot keys are broadcast, so their rows stay where they are; the
    others, at most a thousandth of the rows each, meet in a shuffle.
    """
    hot = hot_keys(lookup, count)
    marked = rows.join(F.broadcast(lookup.where(hot).withColumn("__hot", F.lit(True))), keys, "left")
    met = marked.where("__hot").drop("__hot")
    rest = marked.where("__hot is null").select(*rows.columns).join(lookup.where(~hot).hint("merge"), keys, how)
    return met.unionByName(rest.select(*met.columns))


def dealt_join(rows: DataFrame, lookup: DataFrame, key: str, per: int = 512) -> DataFrame:
    """Inner join of rows (with a doc_id) to a lookup of one wide row per key: at most about per rows of a key meet in one place.

    The rows of each key are counted; a key of n rows is cut into n / per shares by the hash of the doc_id, and its lookup row goes to each.
    """
    counts = save(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")))
    shares = F.floor(F.col("__n") / per)
    dealt = skew_join(rows, counts, [key], "__n", "inner").withColumn("__share", F.pmod(F.xxhash64("doc_id"), shares + 1)).drop("__n")
    spread = lookup.join(counts.hint("merge"), key).withColumn("__share", F.explode(F.sequence(F.lit(0).cast("long"), shares))).drop("__n")
    return dealt.join(spread.hint("merge"), [key, "__share"]).drop("__share")


def fresh(df: DataFrame, name: str) -> str:
    """The name, or a longer one that df doesn't have."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def split_by_keys(rows: DataFrame, keys: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that may have one of the keys, and rows that certainly have none: the latter need no shuffle.

    keys (columns by these names, none null) are hashed into a bitmap of at most 2^26 bits (8 MB), which is all that is broadcast;
    with ever more keys it tells fewer rows apart, and stays right. An exact join must follow on the first part.
    """
    n = keys.count()
    bits = 1 << min(26, max(15, (16 * n).bit_length()))
    at = F.pmod(F.xxhash64(*[F.col(c) for c in columns]), F.lit(bits))
    maps = (
        keys.select((at + 1).alias("p"))
        .groupBy(F.bitmap_bucket_number("p").alias("__bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__bits"))
    )
    here, bucket, word = (fresh(rows, x) for x in ("__at", "__bucket", "__bits"))
    maps = rows.sparkSession.createDataFrame(maps.collect(), f"{bucket} long, {word} binary")  # at most 2048 rows of 4 KB
    slot = F.col(here) % 32768
    byte = F.conv(F.hex(F.substring(F.col(word), (slot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte.cast("int"), (slot % 8).cast("int")) == 1, F.lit(False))
    marked = rows.withColumn(here, at).join(F.broadcast(maps), F.bitmap_bucket_number(F.col(here) + 1) == F.col(bucket), "left")
    return marked.where(hit).select(*rows.columns), marked.where(~hit).select(*rows.columns)


def split_by_ids(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """split_by_keys by doc_id; rows with a null doc_id are in the second part."""
    key = fresh(rows, "__id")
    named = rows.withColumn(key, F.col("doc_id").cast("long"))
    ids = ids.where("doc_id is not null").select(F.col("doc_id").cast("long").alias(key))
    inside, outside = split_by_keys(named.where(F.col(key).isNotNull()), ids, [key])
    return inside.select(*rows.columns), outside.select(*rows.columns).unionByName(rows.where("doc_id is null"))
