"""Exact deduplication by a stateful stream over content digests.

A stream of (digest, doc_id, locator) rows, in several micro-batches, feeds keyed state that never expires and lives on disk (RocksDB
state store, change log in the state folder). The state of a digest holds the stable identifier that stays, the number of rows and
the locator of the content: file and row in it. Digests that were hit more than once are then checked on full bytes: the locator names one
reference text per digest, and every other row of the digest meets it, dealt over shares of a bounded number of rows. Texts of digests without a hit
are not shuffled. Should one digest ever stand for several texts, those rows are decided by text instead.

With a state_dir the state is kept: a later call adds its rows to what was seen before. A call is known by its rows (digests and doc_ids, in any
order) or by the name it is given: one that failed and is repeated goes on from its last whole micro-batch, and a repeated call counts nothing twice.

Cases: null text counts as empty, and empty texts equal each other. Null doc_ids never win over others; a group of only
null ids has a null keep_id. Repeated rows (same id, same text) are both counted in group_size and both marked as the
row that stays. Very long texts are digested whole; only those with a hit travel. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import save, shared_dir, skew_join, split_by_keys

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_MB = "128"  # native memory of all state stores of an executor
BATCHES = 4
SHARE = 256  # rows that one copy of a reference text is compared with
PLACE = ["file", "row"]


def located(docs: DataFrame) -> DataFrame:
    """doc_id, text and place (file, row) of each row; rows that don't come straight from Parquet files are written first."""
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    own = [F.col("doc_id").cast("long").alias("doc_id"), text]
    if "_metadata" not in docs.columns:
        try:
            return docs.select(*own, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        except AnalysisException:
            pass
    return located(save(docs.select(*own)))


def digest_stream_state(root: str, digests: DataFrame, files: int) -> DataFrame:
    """Run the (digest, doc_id, file, row) rows in root/digests that weren't seen yet through the keyed state; (digest, keep_id, group_size, file, row).

    Each micro-batch upserts its changed keys into a folder named by its batch id, so a
    batch that is replayed after a failure overwrites itself; counts and ids only grow, so the greatest are the latest.
    """
    spark = digests.sparkSession
    out = f"{root}/state_rows"

    def upsert(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    keyed = (
        spark.readStream.schema(digests.schema)
        .option("maxFilesPerTrigger", files)
        .option("recursiveFileLookup", "true")  # a folder per call
        .parquet(f"{root}/digests")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", *PLACE)).alias("content"))
    )
    settings = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        # a store is closed when its task has committed: one per state partition would hold disk and memory otherwise
        "spark.sql.streaming.stateStore.unloadOnCommit": "true",
        # all stores of an executor share one cache and write buffer: native memory doesn't grow with the state partitions
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": STATE_MB,
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        query = (
            keyed.writeStream.outputMode("update")
            .foreachBatch(upsert)
            .option("checkpointLocation", f"{root}/stream")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    rows = spark.read.schema("digest string, group_size long, content struct<doc_id:long,file:string,row:long>").parquet(f"{out}/batch=*")
    latest = rows.groupBy("digest").agg(F.max(F.struct("group_size", "content")).alias("s"))
    return latest.select("digest", "s.group_size", F.col("s.content.doc_id").alias("keep_id"), "s.content.file", "s.content.row")


def unlike_digests(texts: DataFrame, digests: DataFrame, hit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The hit digests that stand for several texts, and the rows (digest, doc_id, text, file, row) of hit digests."""
    spark = texts.sparkSession
    reference = hit.select("digest", "group_size", F.col("file").alias("at_file"), F.col("row").alias("at_row"))
    rows = save(skew_join(digests, reference, ["digest"], "group_size", "inner").drop("doc_id"))
    inside, _ = split_by_keys(texts, rows, PLACE)
    met = save(inside.join(rows.hint("merge"), PLACE))
    first = met.where("file = at_file AND row = at_row").select("digest", "group_size", F.col("text").alias("reference"))
    away = rows.select("digest", "group_size", "at_file", "at_row").distinct().join(first.select("digest"), "digest", "left_anti")
    files = [r.at_file for r in away.select("at_file").distinct().collect()]  # files that earlier calls read
    if files:
        old = spark.read.parquet(*files).select(F.col("_metadata.file_path").alias("at_file"), F.col("_metadata.row_index").alias("at_row"), F.coalesce("text", F.lit("")).alias("reference"))
        old, _ = split_by_keys(old, away, ["at_file", "at_row"])
        first = first.unionByName(old.join(away.hint("merge"), ["at_file", "at_row"]).select("digest", "group_size", "reference"))
    shares = F.floor(F.col("group_size") / SHARE)
    dealt = met.select("digest", "text", F.pmod(F.xxhash64(*PLACE), shares + 1).alias("share"))
    spread = first.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), shares))).drop("group_size")
    unlike = dealt.join(spread.hint("merge"), ["digest", "share"]).where("text <> reference").select("digest").distinct()
    return save(unlike), met.select("digest", "doc_id", "text", *PLACE)


def hand_over(keys: DataFrame, root: str, call: str) -> None:
    """Write a call's rows to a folder of root/digests, unless a call of that name has them there already: a file written anew would be streamed anew."""
    path = f"{root}/digests/call={call}"
    try:
        there = keys.sparkSession.read.schema(keys.schema).parquet(path).count()
    except AnalysisException:
        there = -1
    if there != keys.count():  # none of a write that didn't end was streamed
        keys.write.mode("overwrite").parquet(path)


def exact_dedup(docs: DataFrame, state_dir: str | None = None, short=lambda sha: sha, call: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (one row per input row); the largest doc_id of equal texts stays.

    With a state_dir, copies in earlier calls count too; give calls a name where different ones may bring the very same
    rows. short makes the digest of the SHA-256 (tests shorten it).
    """
    spark = docs.sparkSession
    texts = located(docs)
    sha: Column = F.sha2(F.col("text"), 256)
    digests = save(texts.select(short(sha).alias("digest"), "doc_id", *PLACE, sha.alias("text_sha256")))
    if digests.isEmpty():
        return spark.createDataFrame([], "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string")
    root = state_dir or shared_dir(spark)
    keys = digests.select("digest", "doc_id", *PLACE)
    if state_dir is None:
        keys.write.parquet(f"{root}/digests/call=0")
    else:
        if call is None:
            n, total = keys.agg(F.count(F.lit(1)), F.sum(F.xxhash64("digest", "doc_id").cast("decimal(38,0)"))).first()
            call = f"rows-{n}-{total}"
        hand_over(keys, root, call)
    state = save(digest_stream_state(root, keys, -(-len(digests.inputFiles()) // BATCHES)))
    hit = state.where("group_size > 1")
    unlike, met = unlike_digests(texts, keys, hit)
    answer = skew_join(digests, hit.select("digest", "keep_id", "group_size"), ["digest"], "group_size").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        "text_sha256", "digest",
    )
    if not unlike.isEmpty():  # one digest for several texts: those rows are decided by the whole text
        odd = met.join(unlike, "digest", "left_semi")
        by_text = odd.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        answer = answer.join(unlike, "digest", "left_anti").unionByName(odd.join(by_text, ["digest", "text"]).select("doc_id", "keep_id", "group_size", sha.alias("text_sha256"), "digest"))
    return answer.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
