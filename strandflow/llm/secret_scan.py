"""Secret scanning with multipart credential linking.

Base spans of three kinds are found per document: assignments (assign), cloud access identifiers (access) and long hex
runs (hex). Weak parts, long mixed-case tokens (weak) and host names or addresses (endpoint), mean nothing alone. An
interval join within a scope of SCOPE code points links them: a weak secret is reported only beside an access identifier,
an endpoint only where an access identifier and a secret (not a weak one that isn't reported) both stand within its scope.

Positions are code points, end exclusive, and come from lengths alone: the pieces between matches (split) and the matches
themselves are laid end to end. Everything is built-in column functions.

Cases: null and empty texts have no spans; repeated rows each get their result; an empty table gives an empty result;
other columns are ignored; a null doc_id is carried through. Equal starts are listed by kind, then end. Very long texts are scanned in time proportional
to their length; only weak parts beside an access identifier are held against each base span of their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import fresh, save, split_by_ids, with_text

#: The patterns of the base kinds, in the order in which equal starts are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Weak parts.
WEAK = r"[A-Za-z0-9+/=_]{24,}"
ENDPOINT = r"(?:https?://[A-Za-z0-9._:/-]+|(?:[A-Za-z0-9-]+\.)+(?:com|net|org|io)\b)"
KINDS = ["assign", "access", "hex", "weak", "endpoint"]
SCOPE = 256
CHUNK = 64
PIECE = 4096
SPAN = "array<struct<start:int,kind:int,end:int>>"


def chunks(array: Column) -> Column:
    """0-based numbers of the chunks of CHUNK elements of an array; what runs over all elements does so chunk by chunk, so no long array is copied per element."""
    return F.when(F.size(array) > 0, F.sequence(F.lit(0), F.floor((F.size(array) - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))


def chunk(array: Column, i: Column) -> Column:
    return F.slice(array, i * CHUNK + 1, F.lit(CHUNK))


def with_spans(df: DataFrame, name: str, pattern: str, value_group: int = 0, least: int = 0, where: Column | None = None) -> DataFrame:
    """Adds name: spans (start, kind, end) of the leftmost non-overlapping matches in text whose value has at least so many characters."""
    text, kind = F.col("text"), KINDS.index(name)
    hits = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length).alias("len"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)), F.length).alias("val"),
    )
    found = text.rlike(pattern) if where is None else where & text.rlike(pattern)
    df = df.withColumn("__hits", F.when(found, hits).otherwise(F.array().cast("array<struct<gap:int,len:int,val:int>>")))
    h = F.col("__hits")
    size = lambda v: v["gap"] + F.coalesce(v["len"], F.lit(0))
    df = df.withColumn("__sums", F.transform(chunks(h), lambda i: F.aggregate(chunk(h, i), F.lit(0), lambda acc, v: acc + size(v))))
    sums = F.col("__sums")
    df = df.withColumn("__at", F.transform(sums, lambda _, i: F.aggregate(F.slice(sums, F.lit(1), i), F.lit(0), lambda acc, v: acc + v)))

    def step(acc, v):
        start = acc["at"] + v["gap"]
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + v["len"]).alias("end")))
        return F.struct((acc["at"] + size(v)).alias("at"), F.when(v["val"] >= least, F.concat(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    walked = F.transform(
        F.col("__at"), lambda at, i: F.aggregate(chunk(h, i), F.struct(at.alias("at"), F.array().cast(SPAN).alias("found")), step, lambda acc: acc["found"])
    )
    return df.withColumn(name, F.flatten(walked)).drop("__hits", "__sums", "__at")


def linked_parts(scan: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(row_key, linked): weak parts and endpoints whose complementary parts stand within the scope.

    A weak part needs an access identifier. An endpoint needs an access identifier and a secret, which is an assignment, a hex run or a weak part
    that is itself linked. The interval join is an equi-join on (row, bucket) with buckets as wide as the scope: parts are first reduced to the least
    and greatest position per bucket, so each candidate meets at most three rows, never all parts of a long document.
    """
    part = scan.where((F.size("access") > 0) & ((F.size("weak") > 0) | (F.size("endpoint") > 0))).select(
        "row_key", F.explode(F.concat("assign", "access", "hex", "weak", "endpoint")).alias("p")
    ).select("row_key", "p.*", F.floor(F.col("p.start") / scope).alias("bucket"))

    def beside(candidates: DataFrame, others: DataFrame) -> DataFrame:
        """The candidates that have one of the others within the scope."""
        ends = others.groupBy("row_key", "bucket").agg(F.min("start").alias("first"), F.max("start").alias("last"))
        near = ends.select("row_key", "first", "last", F.explode(F.array(*[F.col("bucket") + d for d in (-1, 0, 1)])).alias("bucket"))
        gap = F.least(F.abs(F.col("first") - F.col("start")), F.abs(F.col("last") - F.col("start")))
        return candidates.join(near, ["row_key", "bucket"]).where(gap <= scope).select(*candidates.columns).distinct()

    access = part.where("kind = 1")
    weak = beside(part.where("kind = 3"), access)
    endpoint = beside(beside(part.where("kind = 4"), access), part.where("kind in (0, 2)").unionByName(weak))
    return weak.unionByName(endpoint).groupBy("row_key").agg(F.collect_list(F.struct("start", "kind", "end")).cast(SPAN).alias("linked"))


def secret_scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, row_key, base and spans (arrays of start, kind, end in code points) for every input row."""
    df = with_text(docs).withColumn("row_key", row_key())
    df = with_spans(with_spans(with_spans(df, "assign", ASSIGN, 2, 6), "access", ACCESS), "hex", HEX)
    some = F.size("access") > 0
    df = with_spans(with_spans(df, "weak", WEAK, where=some), "endpoint", ENDPOINT, where=some)
    inside = lambda s, other: F.exists(other, lambda o: (s["start"] < o["end"]) & (o["start"] < s["end"]))
    free = lambda name: F.filter(name, lambda s: ~inside(s, F.concat("assign", "access", "hex"))).alias(name)
    scan = save(df.select("doc_id", "row_key", "assign", "access", "hex", free("weak"), free("endpoint")))
    linked = linked_parts(scan, scope)
    candidate = (F.size("access") > 0) & ((F.size("weak") > 0) | (F.size("endpoint") > 0))
    few, plain = scan.where(candidate), scan.where(~candidate)
    cols = lambda df, more: df.select("doc_id", "row_key", "assign", "access", "hex", F.array_sort(F.concat("assign", "access", "hex")).alias("base"), F.array_sort(F.concat("assign", "access", "hex", more)).alias("spans"))
    return cols(plain, F.array().cast(SPAN)).unionByName(cols(few.join(linked, "row_key", "left"), F.coalesce("linked", F.array().cast(SPAN))))


def listed(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    return secret_scan(docs).select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def row_key() -> Column:
    """The row_key of a row of documents."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.sha2(F.to_json(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("xxhash64(text)"), F.length(text).alias("length(text)"))), 256)


def with_redacted(df: DataFrame, found: str, mark: str = "[secret]") -> DataFrame:
    """text with each span of found (sorted, may overlap) replaced by a mark. Text is taken from pieces of PIECE characters, so no place is counted from the start."""
    spans, n = F.col(found), F.length("text")
    piece_, ends_, at_, gaps_ = (fresh(df, x) for x in ("__piece", "__ends", "__at", "__gaps"))
    df = df.withColumn(piece_, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))
    df = df.withColumn(ends_, F.transform(chunks(spans), lambda i: F.aggregate(chunk(spans, i), F.lit(0), lambda acc, s: F.greatest(acc, s["end"]))))
    ends = F.col(ends_)
    df = df.withColumn(at_, F.transform(ends, lambda _, i: F.aggregate(F.slice(ends, F.lit(1), i), F.lit(0), lambda acc, v: F.greatest(acc, v))))

    def step(acc, s):
        gap = F.array(F.struct(acc["at"].alias("a"), s["start"].alias("b")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["gaps"], gap)).otherwise(acc["gaps"]).alias("gaps"))

    walk = lambda at, i: F.aggregate(chunk(spans, i), F.struct(at.alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("gaps")), step, lambda acc: acc["gaps"])
    rest = F.array(F.struct(F.array_max(ends).alias("a"), n.alias("b")))
    df = df.withColumn(gaps_, F.concat(F.flatten(F.transform(at_, walk)), rest))
    piece = F.col(piece_)

    def cut(g):
        i, j = (F.floor(x / PIECE).cast("int") for x in (g["a"], g["b"] - 1))
        first, last = F.get(piece, i), F.get(piece, j)
        several = F.concat(F.substring(first, g["a"] % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(piece, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(last, F.lit(1), (g["b"] - 1) % PIECE + 1))
        return F.when(g["b"] <= g["a"], "").when(i == j, F.substring(first, g["a"] % PIECE + 1, g["b"] - g["a"])).otherwise(several)

    return df.withColumn("text", F.array_join(F.transform(gaps_, cut), mark)).drop(piece_, ends_, at_, gaps_)


def redact(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """All rows and columns of docs, text with its secrets replaced and n_chars to match."""
    key, spans = fresh(docs, "__key"), fresh(docs, "__spans")
    found = save(secret_scan(docs, scope).where(F.size("spans") > 0).select("doc_id", F.col("row_key").alias(key), F.col("spans").alias(spans)).dropDuplicates([key]))
    inside, outside = split_by_ids(docs, found.where("doc_id is not null").select("doc_id").distinct())
    nameless, outside = outside.where("doc_id is null"), outside.where("doc_id is not null")
    both = inside.unionByName(nameless).withColumn(key, row_key()).join(found.drop("doc_id").hint("merge"), key, "left")
    out = with_redacted(both.where(F.col(spans).isNotNull()), spans)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns).unionByName(both.where(F.col(spans).isNull()).select(*docs.columns)).unionByName(outside)
