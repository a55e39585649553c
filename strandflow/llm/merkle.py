"""Document fingerprints: a Merkle tree over sections, paragraphs and leaves.

A paragraph is a line. Its leaves end where its content says so (CUT): after the end of a sentence, after a word that ends in one of some letters or a digit, or, in
text without blanks, after certain pairs of letters; so an edit moves no cut but those beside it. A section begins with each paragraph whose hash
begins with 0 or 1, eight paragraphs on average, so inserted paragraphs move no other section. Each inner node hashes its children's
hashes in order: equal roots mean equal texts (up to SHA-256 collisions), and an edit changes only the nodes on its branch.

Two trees are compared downwards: sections that are equal from both ends are passed over as a whole, then paragraphs of the first and last
differing section; what is left are the differing branches (differing() tells their paragraphs). Likeness weighs leaves by size: twice the characters of the leaves that both
have, each as often as both have it, by the characters of both (a leaf's end counts as one). Leaves in another order are alike; a repeated one counts each time.
Everything is built-in column functions.

Cases: null and empty texts have one empty leaf, so they are equal to each other. The order is by doc_id, null before all; of repeated doc_ids (and nulls) by text.
A single row is its own next document. A very long text is one row, worked on in time proportional to its length (times the logarithm of its leaves). An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.llm.common import split_by_keys, with_text

#: A leaf: at least a character, up to and with the first place where its content cuts it.
CUT = r"(?s).+?(?:[.!?;:]\x20+|[gky0-9]\x20+|[a-c0-3][x-z7-9]|\z)"
TASK = 64 << 20  # bytes of text a task
COARSE = 64


def with_tree(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the tree of a text column: name_p (hash and leaves of each paragraph) and name_s (hash and number of paragraphs of each section)."""
    leaf = lambda p: F.when(p == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(p, F.lit(CUT), F.lit(0)))
    hashed = F.transform(F.split(text, "\n", -1), lambda p: F.transform(leaf(p), lambda s: F.struct(F.sha2(s, 256).alias("h"), (F.length(s) + 1).alias("n"))))
    df = df.withColumn(f"{name}_p", F.transform(hashed, lambda v: F.struct(F.sha2(F.concat_ws(",", v["h"]), 256).alias("h"), v.alias("leaves"))))
    p = F.col(f"{name}_p")
    begins = F.filter(F.sequence(F.lit(1), F.size(p)), lambda i: (i == 1) | F.get(p, i - 1)["h"].substr(1, 1).isin("0", "1"))
    df = df.withColumn(f"{name}_b", begins)
    b = F.col(f"{name}_b")
    section = lambda i, k: F.slice(p, i, F.coalesce(F.get(b, k + 1), F.size(p) + 1) - i)
    df = df.withColumn(f"{name}_s", F.transform(F.transform(b, section), lambda v: F.struct(F.sha2(F.concat_ws(",", v["h"]), 256).alias("h"), F.size(v).alias("n"))))
    return df.drop(f"{name}_b")


def root(name: str) -> Column:
    return F.sha2(F.concat_ws(",", F.col(f"{name}_s.h")), 256)


def leading(a: Column, b: Column) -> Column:
    """How many elements of two arrays are equal from the start."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(a)).cast("int")


def differing(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Adds out_head and out_tail: how many paragraphs of two trees are equal from the start and from the end; the edits lie between."""
    for side, turn in (("head", lambda x: x), ("tail", F.reverse)):
        sa, sb, pa, pb = (turn(F.col(c)) for c in (f"{a}_s", f"{b}_s", f"{a}_p.h", f"{b}_p.h"))
        df = df.withColumn("__k", leading(sa["h"], sb["h"]))
        df = df.withColumn("__n", F.aggregate(F.slice(sa["n"], 1, F.col("__k")), F.lit(0), lambda x, y: x + y))
        part = lambda p, s: F.slice(p, F.col("__n") + 1, F.coalesce(F.get(s["n"], F.col("__k")), F.lit(0)))
        df = df.withColumn(f"{out}_{side}", F.col("__n") + leading(part(pa, sa), part(pb, sb)))  # noqa: B023
    most = F.least(F.size(f"{a}_p"), F.size(f"{b}_p")) - F.col(f"{out}_head")
    return df.withColumn(f"{out}_tail", F.least(f"{out}_tail", most)).drop("__k", "__n")


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Adds out: the likeness of two trees, 0 to 1."""
    df = differing(df, a, b, out)
    weight = lambda p: F.aggregate(F.flatten(p["leaves"]), F.lit(0).cast("long"), lambda x, y: x + y["n"])
    middle = lambda t: F.slice(F.col(f"{t}_p"), F.col(f"{out}_head") + 1, F.size(f"{t}_p") - F.col(f"{out}_head") - F.col(f"{out}_tail"))
    df = df.withColumns({"__x": middle(a), "__y": middle(b)})
    side = lambda m, k: F.transform(F.flatten(F.col(m)["leaves"]), lambda v: F.struct(v["h"].alias("h"), F.lit(k).alias("k"), v["n"].alias("n")))

    def step(acc, v):
        open_ = F.when(acc["h"] == v["h"], acc["c"]).otherwise(0)  # leaves of the first side that have no partner yet
        met = (v["k"] == 2) & (open_ > 0)
        return F.struct(v["h"].alias("h"), F.when(v["k"] == 1, open_ + 1).when(met, open_ - 1).otherwise(open_).alias("c"), (acc["m"] + F.when(met, v["n"]).otherwise(0)).alias("m"))

    both = F.sort_array(F.concat(side("__x", 1), side("__y", 2)))
    matched = F.aggregate(both, F.struct(F.lit("").alias("h"), F.lit(0).alias("c"), F.lit(0).cast("long").alias("m")), step, lambda acc: acc["m"])
    wa, wb = weight(F.col(f"{a}_p")), weight(F.col(f"{b}_p"))
    df = df.withColumns({"__m": matched, "__wa": wa, "__wb": wb, "__wx": weight(F.col("__x"))})
    value = 2.0 * (F.col("__wa") - F.col("__wx") + F.col("__m")) / (F.col("__wa") + F.col("__wb"))
    return df.withColumn(out, value).drop("__x", "__y", "__m", "__wa", "__wb", "__wx", f"{out}_head", f"{out}_tail")


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, root, and the tree: sections (hash, number of paragraphs) and paragraphs (hash, leaves with hash and size)."""
    t = with_tree(with_text(docs), "text", "a")
    return t.select("doc_id", root("a").alias("root"), F.col("a_s").alias("sections"), F.col("a_p").alias("paragraphs"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: each document beside the next one (last: the first).

    doc_ids are cut into ranges, by quantiles and evenly between these, as many as the bytes of text ask for. The first row of each range also goes
    to the range before it, so one shuffle by range puts every document beside its successor.
    """
    spark = docs.sparkSession
    t = with_text(docs)
    size = t.agg(F.sum(F.octet_length("text")).alias("b"), F.max("doc_id").alias("m")).first()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (size["b"] or 0) // TASK)
    fine = max(1, 4 * tasks // COARSE)
    cuts = t.agg(F.percentile_approx("doc_id", [i / COARSE for i in range(COARSE)], 10_000).alias("c")).first()["c"]  # COARSE numbers
    cuts = sorted({*(cuts or [0])})
    last = (size["m"] or 0) + 1
    k = F.size(F.filter(F.lit(cuts), lambda c: c <= F.col("doc_id")))
    low, high = F.get(F.lit(cuts), k - 1), F.get(F.lit([*cuts[1:], last]), k - 1)
    own = k * fine + F.floor((F.col("doc_id") - low) * F.lit(float(fine)) / (high - low))
    own = F.when(F.col("doc_id").isNull(), -1).when(k == 0, 0).otherwise(F.least(own, (k + 1) * fine - 1)).cast("long")
    t = t.withColumn("r", own)
    order = Window.orderBy("r")  # one row a range
    firsts = t.groupBy("r").agg(F.min("doc_id").alias("first"))
    firsts = firsts.select("r", "first", F.coalesce(F.lag("r").over(order), F.max("r").over(Window.partitionBy())).alias("before"))
    named = firsts.where("first is not null").select(F.col("first").alias("doc_id"), "before")
    inside, _ = split_by_keys(t.where("doc_id is not null"), named, ["doc_id"])
    ghosts = inside.join(named, "doc_id").select("doc_id", "text", F.col("before").alias("r"))
    nameless = t.where("doc_id is null").groupBy("r").agg(F.min("text").alias("text")).join(firsts, "r").select(F.col("first").alias("doc_id"), "text", F.col("before").alias("r"))
    dealt = t.withColumn("g", F.lit(0)).unionByName(ghosts.unionByName(nameless).withColumn("g", F.lit(1)))
    w = Window.partitionBy("r").orderBy("g", F.asc_nulls_first("doc_id"), "text")
    return dealt.repartition(tasks, "r").withColumn("next_text", F.lead("text").over(w)).where("g = 0").drop("g", "r")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document, of its edited text, and likenesses to the edited and to the next document; edit_from and edit_to are the
    paragraphs (0-based, end exclusive) of the document between which the edited text differs."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    t = with_next(docs).withColumns({"n_chars": n.cast("long"), "edited": edited})
    t = with_tree(with_tree(with_tree(t, "text", "a"), "edited", "b"), "next_text", "c")
    t = differing(with_likeness(with_likeness(t, "a", "b", "near_edited"), "a", "c", "near_next"), "a", "b", "e")
    return t.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        root("a").alias("fingerprint"),
        root("b").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        F.col("e_head").cast("long").alias("edit_from"),
        (F.size("a_p") - F.col("e_tail")).cast("long").alias("edit_to"),
    )
