"""Near-duplicate detection: MinHash signatures in an LSH forest.

Documents whose shingle sets are equal are one class first (hashes of the whole set), so a signature stands for a class.
The forest holds TREES sorted orders of the signatures, each starting at other hashes. Where a signature stands in an order, its
nearest neighbours are those with the longest common prefix: in a crowded region these agree to a great depth, in a thin one to a small
one, down to DEPTH hashes. Signatures that agree on DEPTH hashes of an order are a run; a run lies in one partition, but for runs of a large part
of all rows, which are cut by ranges of the key. Neighbours (WINDOW on each side) whose signatures agree nearly as far as the threshold asks
become candidates: first the likeliest partner of each class is confirmed on full shingle sets, then, after joining up what is linked, every
candidate between classes that are not connected yet.

Runs longer than the window could hide a link. Where the members of such runs are not all connected by then, overlapping runs become groups, and each set of a group is replaced by its
differences from the group's template (the shingles of most members): sets differ by as much as their differences do. Members near the template are linked without a search; most other links
show in MORE sorted orders of the differences. What is left in different components is compared by all pairs, block by block: pairs whose differences disagree in too many parities can't be links and go at once, all
others are confirmed exactly, so no link within a crowd is a matter of chance. That is quadratic in what a crowd has outside its largest component; a task holds two blocks of a few times the square root of the crowd.
Components are found by alternating stars. Nothing is collected but the names of the largest runs, fewer than a thousand; tables go to the shared folder.

Cases: null and empty texts and texts without words have an empty set and are linked with nothing. Rows with a null doc_id keep a null
component. Repeated rows are copies of each other. Rows with one doc_id but different texts are one node of the graph, and one
of the texts is compared. Very long texts are one set each, worked on in a block of their own. Ties in an order go by doc_id, and don't change links.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm import arrays
from strandflow.llm.common import connected_components, dealt_join, hot_keys, map_texts, save, skew_join, split_by_ids, split_by_keys, with_text

HASHES = 128
TREES = 16
DEPTH = 4
WINDOW = 5
SLACK = 0.18
MORE = 16
WHOLE = 1024
BLOCKS = 64
PARITIES = 1024
KEY = 4


def shingle_sets(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles (64-bit hashes, sorted) of all texts in a row and where each text's begin."""
    cp, starts = arrays.code_points(texts)
    cp = np.where((cp >= 65) & (cp <= 90), cp + 32, cp)
    s, e, doc = arrays.runs(~((cp == 32) | ((cp >= 9) & (cp <= 13))), starts)
    h = arrays.Hasher(cp)(s, e)
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    salt = [np.uint64(x | 1) for x in np.random.default_rng(7).integers(0, 1 << 63, words, np.uint64).tolist()]
    n = len(h) - words + 1
    parts, docs = [], []
    if n > 0:
        inside = doc[:n] == doc[words - 1 :]
        parts.append(arrays.mix(sum(h[j : n + j] * salt[j] for j in range(words)))[inside])
        docs.append(doc[:n][inside])
    for m in range(1, words):  # fewer words than a shingle: the whole sequence
        k = np.flatnonzero(count == m)
        if len(k):
            parts.append(arrays.mix(sum(h[first[k] + j] * salt[j] for j in range(m)) + np.uint64(m)))
            docs.append(k)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    value, owner = np.concatenate(parts), np.concatenate(docs)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(texts) + 1))


def multipliers() -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, k1 and k2 (128 bits that stand for the set), signature (HASHES 16-bit numbers)."""

    def work(texts: list[str]):
        value, begin = shingle_sets(texts, words)
        size = np.diff(begin)
        sig = np.zeros((len(texts), HASHES), ">u2")
        k1, k2 = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
        full = np.flatnonzero(size)
        if len(full):
            at = begin[full]
            for j, a in enumerate(multipliers()):
                sig[full, j] = (np.minimum.reduceat(value * a, at) >> np.uint64(20)) & np.uint64(0xFFFF)
            k1[full] = np.add.reduceat(arrays.mix(value + np.uint64(1)), at)
            k2[full] = np.bitwise_xor.reduceat(arrays.mix(value ^ np.uint64(0x5DEECE66D)), at)
        return None, {"n_shingles": size.astype(np.int64), "k1": k1.view(np.int64), "k2": k2.view(np.int64), "signature": [x.tobytes() for x in sig]}

    return map_texts(docs, work, "n_shingles long, k1 long, k2 long, signature binary")


def _keys(sig: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures as order t reads them: the first DEPTH hashes as one number, and the hashes that follow (a byte each)."""
    turned = np.roll(sig, -t * (HASHES // TREES), axis=1)
    return np.ascontiguousarray(turned[:, :DEPTH]).view(np.int64)[:, 0], (turned[:, DEPTH : DEPTH + 12] & 0xFF).astype(np.uint8)


def _signatures(batch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("signature").to_pylist()), ">u2").reshape(-1, HASHES)


def _heads(batches):
    """For each class and order: the run that it stands in."""
    import pyarrow as pa

    for batch in batches:
        sig = _signatures(batch)
        for t in range(TREES):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), t, np.int32)), pa.array(_keys(sig, t)[0]), batch.column("node")], names=["tree", "head", "node"])


def _forest(large: dict[int, np.ndarray], inside: bool):
    """For each class and order, in large runs or in all others: the order's number, its run, the sorted key and a sketch of one byte per hash."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sig = _signatures(batch)
            shown = pa.array([x.tobytes() for x in (sig & 0xFF).astype(np.uint8)])
            for t in range(TREES):
                head, tail = _keys(sig, t)
                mask = np.isin(head, large.get(t, np.zeros(0, np.int64))) == inside
                if mask.any():
                    key = np.hstack([head[mask, None].view(np.uint8).reshape(-1, 8), tail[mask]])
                    keep = pa.array(mask)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(key), t, np.int32)), pa.array(head[mask]), pa.array([k.tobytes() for k in key]), batch.column("node").filter(keep), shown.filter(keep)],
                        names=["tree", "head", "key", "node", "sketch"],
                    )

    return run


def _neighbours(least: int):
    def run(batches):
        """Pairs of neighbours in sorted order that agree on DEPTH hashes at least, and on enough of the whole signature."""
        import pyarrow as pa

        last = None
        for batch in batches:
            tree = batch.column("tree").to_numpy()
            node = batch.column("node").to_numpy()
            head = batch.column("head").to_numpy()
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, HASHES)
            now = (tree, node, head, sketch)
            if last is not None:
                now = tuple(np.concatenate([a, b]) for a, b in zip(last, now, strict=True))
            old = 0 if last is None else len(last[0])
            tree, node, head, sketch = now
            found = []
            for shift in range(1, WINDOW + 1):
                i = np.arange(max(old, shift), len(node))
                i = i[(head[i] == head[i - shift]) & (tree[i] == tree[i - shift])]
                if len(i):
                    same = (sketch[i] == sketch[i - shift]).sum(axis=1)
                    i, same = i[same >= least], same[same >= least]
                    found.append((np.minimum(node[i], node[i - shift]), np.maximum(node[i], node[i - shift]), same))
            last = tuple(x[-WINDOW:] for x in now)
            if found:
                a, b, same = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(same.astype(np.int32))], names=["a", "b", "same"])

    return run


def crowded_runs(classes: DataFrame) -> DataFrame:
    """(tree, head, n): the runs of more members than a window shows to each."""
    heads = classes.select("node", "signature").mapInArrow(_heads, "tree int, head long, node long")
    return heads.groupBy("tree", "head").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WINDOW + 1)


def candidates(classes: DataFrame, runs: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a, b, same) of classes (node, signature)."""
    large: dict[int, list] = {}
    for r in runs.where(hot_keys(runs, "n")).collect():  # fewer than a thousand
        large.setdefault(r.tree, []).append(r.head)
    large = {t: np.array(h, np.int64) for t, h in large.items()}
    kind, order = "tree int, head long, key binary, node long, sketch binary", ["tree", "key", "node"]
    rows = classes.select("node", "signature")
    ordered = rows.mapInArrow(_forest(large, False), kind).repartition("tree", "head").sortWithinPartitions(*order)
    least = int((threshold - SLACK) * HASHES)
    pairs = ordered.mapInArrow(_neighbours(least), "a long, b long, same int")
    if large:
        cut = rows.mapInArrow(_forest(large, True), kind).repartitionByRange(*order).sortWithinPartitions(*order)
        pairs = pairs.unionByName(cut.mapInArrow(_neighbours(least), "a long, b long, same int"))
    return pairs.groupBy("a", "b").agg(F.max("same").alias("same"))


def _sets(words: int):
    def work(texts: list[str]):
        value, begin = shingle_sets(texts, words)
        return None, {"shingles": [value[i:j].tobytes() for i, j in zip(begin[:-1], begin[1:], strict=True)]}

    return work


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on full sets."""

    def check(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    x = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").mapInArrow(check, "a long, b long")


def label(known: DataFrame, side: str) -> DataFrame:
    return known.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))


def joined_up(known: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) after further links (a, b)."""
    more = links.join(label(known, "a"), "a", "left").join(label(known, "b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    more = save(more)
    if more.isEmpty():
        return known
    second = connected_components(more)
    again = second.select(F.col("node").alias("component"), F.col("component").alias("c2"))
    linked = known.join(again, "component", "left").select("node", F.coalesce("c2", "component").alias("component"))
    return save(linked.unionByName(second.join(known, "node", "left_anti").select("node", "component")))


def crowd(classes: DataFrame, runs: DataFrame, known: DataFrame) -> DataFrame:
    """(g, node, component) of the members of crowded runs that are not all connected; runs that share members are one group g."""
    heads = classes.select("node", "signature").mapInArrow(_heads, "tree int, head long, node long")
    inside, _ = split_by_keys(heads, runs, ["tree", "head"])
    members = skew_join(inside, runs, ["tree", "head"], "n", "inner").join(known, "node", "left").select("tree", "head", "n", "node", F.coalesce("component", "node").alias("component"))
    members = save(members)
    some = members.groupBy("tree", "head").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("node").alias("first"), F.max("n").alias("n")).where("x < y").select("tree", "head", "n", "first")
    rows = save(skew_join(members.drop("n"), save(some), ["tree", "head"], "n", "inner").select("node", "component", "first").distinct())
    if rows.isEmpty():
        return rows.select(F.lit(0).cast("long").alias("g"), "node", "component")
    groups = connected_components(rows.select(F.col("first").alias("a"), F.col("node").alias("b")))
    return save(rows.select("node", "component").distinct().join(groups.withColumnRenamed("component", "g"), "node").select("g", "node", "component"))


def _long_sets(words: int):
    def work(texts: list[str]):
        import pyarrow as pa

        value, begin = shingle_sets(texts, words)
        return None, {"shingles": pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(value.view(np.int64)))}

    return work


def differences(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """g, node, component, size and d: what tells each set from the template of its group, the shingles of more than half of the members.

    d holds own shingles and those of the template that the set lacks, so two sets of a group differ by as many shingles as their d do.
    """
    members = save(sets.withColumnRenamed("doc_id", "node").join(groups, "node"))
    sizes = save(members.groupBy("g").agg(F.count(F.lit(1)).alias("n")))
    counts = members.select("g", F.explode("shingles").alias("e")).groupBy("g", "e").agg(F.count(F.lit(1)).alias("k"))
    template = save(skew_join(counts, sizes, ["g"], "n", "inner").where("2 * k > n").groupBy("g").agg(F.collect_list("e").alias("template")))
    rows = members.withColumn("doc_id", F.col("node"))  # what dealt_join spreads by
    met = dealt_join(rows, template, "g").unionByName(rows.join(template.select("g"), "g", "left_anti").withColumn("template", F.array().cast("array<bigint>")))
    d = F.concat(F.array_except("shingles", "template"), F.array_except("template", "shingles"))
    return save(met.select("g", "node", "component", F.size("shingles").cast("long").alias("size"), d.alias("d")))


def near_template(diffs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of each group's member nearest to the template with all whose differences and its own are few enough together.

    Two members are linked whatever they share if their excess adds up to nothing more; then both are so with the member of least excess.
    """
    excess = (100 + percent) * F.size("d") - (100 - percent) * F.col("size")
    rows = diffs.select("g", "node", excess.alias("x"))
    first = rows.groupBy("g").agg(F.min(F.struct("x", "node")).alias("m")).select("g", F.col("m.x").alias("mx"), F.col("m.node").alias("a"))
    return rows.join(F.broadcast(first) if first.count() < 10_000 else first, "g").where("x + mx <= 0 and node <> a").select("a", F.col("node").alias("b"))


def _parities(batches):
    """Adds PARITIES bits to each row: whether an odd number of its differences falls on a bit. Two sets differ by no fewer elements than bits."""
    import pyarrow as pa

    for batch in batches:
        d = batch.column("d")
        value, owner = d.flatten().to_numpy().view(np.uint64) % np.uint64(PARITIES), np.repeat(np.arange(len(d)), d.value_lengths().to_numpy())
        bits = np.zeros((len(d), PARITIES // 64), np.uint64)
        np.bitwise_xor.at(bits, (owner, (value >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (value & np.uint64(63)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in bits], pa.binary())], names=[*batch.schema.names, "parity"])


def _borders(percent: int):
    def run(batches):
        """Pairs (a, b) beside the borders between components in sorted order: each stretch of one component with the next WINDOW stretches of others.

        Pairs whose parities alone tell that they differ by too much are left out; no link is among them.
        """
        import pyarrow as pa

        last = None
        for batch in batches:
            parity = np.frombuffer(b"".join(batch.column("parity").to_pylist()), np.uint64).reshape(-1, PARITIES // 64)
            now = [*(batch.column(c).to_numpy() for c in ("o", "node", "component", "size")), parity]
            if last is not None:
                now = [np.concatenate([a, b]) for a, b in zip(last, now, strict=True)]
            o, node, comp, size, parity = now
            if not len(node):
                continue
            begin = np.flatnonzero(np.concatenate([[True], (comp[1:] != comp[:-1]) | (o[1:] != o[:-1])]))
            end = np.append(begin[1:], len(node)) - 1
            found = []
            for j in range(1, WINDOW + 1):
                x, y = end[:-j], begin[j:]
                ok = (o[x] == o[y]) & (comp[x] != comp[y])
                x, y = x[ok], y[ok]
                apart = np.bitwise_count(parity[x] ^ parity[y]).sum(axis=1, dtype=np.int64)
                ok = (100 + percent) * apart <= (100 - percent) * (size[x] + size[y])
                found.append((np.minimum(node[x[ok]], node[y[ok]]), np.maximum(node[x[ok]], node[y[ok]])))
            last = [v[np.concatenate([end[-WINDOW:-1], [len(node) - 1]])] for v in now] if len(begin) > WINDOW else now
            a, b = (np.concatenate(v) for v in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def beside(diffs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of different components of a group that stand side by side when the differences are sorted by their least hashes, in MORE orders, and may be links."""
    least = lambda o: F.slice(F.array_sort(F.transform("d", lambda e: F.xxhash64(e, o))), 1, KEY)
    kept = ["g", "node", "component", "size"]
    marked = diffs.where(F.size("d") > 0).select(*kept, "d").mapInArrow(_parities, "g long, node long, component long, size long, d array<bigint>, parity binary")
    rows = marked.select(*kept, "parity", "d", F.explode(F.sequence(F.lit(0), F.lit(MORE - 1))).alias("o")).select("o", *kept, "parity", least(F.col("o")).alias("key"))
    ordered = rows.repartitionByRange("g", "o", "key", "node").sortWithinPartitions("g", "o", "key", "node")
    return ordered.select(F.xxhash64("g", "o").alias("o"), "node", "component", "size", "parity").mapInArrow(_borders(percent), "a long, b long").distinct()


def linked(pairs: DataFrame, diffs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets differ by few enough shingles, exactly, told from their differences."""
    side = lambda k: diffs.select(F.col("node").alias(k), F.col("size").alias(f"s{k}"), F.col("d").alias(f"d{k}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    apart = F.size("da") + F.size("db") - 2 * F.size(F.array_intersect("da", "db"))
    return met.where((100 + percent) * apart <= (100 - percent) * (F.col("sa") + F.col("sb"))).select("a", "b")


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits each row of x disagrees with each of y."""
    out = np.zeros((len(x), len(y)), np.uint16)
    for w in range(x.shape[1]):
        out += np.bitwise_count(x[:, w, None] ^ y[None, :, w])
    return out


def _links(percent: int):
    def run(table):
        """Links (a, b) that join up the components of two blocks (of which one may be the other): a forest of all links between them."""
        import pyarrow as pa

        block, p, q = table.column("block").to_numpy(), table.column("p")[0].as_py(), table.column("q")[0].as_py()
        node, comp, size = (table.column(c).to_numpy() for c in ("node", "component", "size"))
        parity = np.frombuffer(b"".join(table.column("parity").to_pylist()), np.uint64).reshape(-1, PARITIES // 64)
        d = table.column("d").combine_chunks()
        value, begin = d.flatten().to_numpy(), np.concatenate([[0], np.cumsum(d.value_lengths().to_numpy())])
        root: dict[int, int] = {}

        def top(c: int) -> int:
            while c in root:
                c = root[c]
            return c

        xs, ys, found = np.flatnonzero(block == p), np.flatnonzero(block == q), []
        for at in range(0, len(xs), 128):
            x = xs[at : at + 128]
            near = (100 + percent) * _apart(parity[x], parity[ys]).astype(np.int64) <= (100 - percent) * (size[x][:, None] + size[ys][None, :])
            for i, j in zip(*np.nonzero(near & (comp[x][:, None] != comp[ys][None, :])), strict=True):
                i, j = int(x[i]), int(ys[j])
                a, b = top(int(comp[i])), top(int(comp[j]))
                if a == b:
                    continue
                u, v = value[begin[i] : begin[i + 1]], value[begin[j] : begin[j + 1]]
                if (100 + percent) * (len(u) + len(v) - 2 * len(np.intersect1d(u, v, assume_unique=True))) <= (100 - percent) * int(size[i] + size[j]):
                    root[max(a, b)] = min(a, b)
                    found.append((int(node[i]), int(node[j])))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def across(diffs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join up all members of a group between whose components there is a link, from all pairs of the members outside its largest component with all others.

    Members are dealt over blocks, about as many as the square root of a BLOCKS-th of them (one up to WHOLE members), and each pair of blocks is met by itself.
    """
    parts = diffs.groupBy("g", "component").agg(F.count(F.lit(1)).alias("k"))
    blocks = lambda n: F.ceil(F.sqrt(n / BLOCKS)).cast("int")
    stats = parts.groupBy("g").agg(F.sum("k").alias("n"), F.max(F.struct("k", "component")).alias("m"))
    few = F.col("n") <= WHOLE
    stats = save(stats.select("g", "n", F.when(~few, F.col("m.component")).alias("major"), F.when(few, 1).otherwise(blocks(F.col("n") - F.col("m.k"))).alias("minors"), F.when(few, 0).otherwise(blocks(F.col("m.k"))).alias("majors")))
    marked = diffs.select("g", "node", "component", "size", "d").mapInArrow(_parities, "g long, node long, component long, size long, d array<bigint>, parity binary")
    rows = skew_join(marked, stats, ["g"], "n", "inner")
    minor = ~F.col("component").eqNullSafe(F.col("major"))
    deal = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    rows = rows.withColumn("block", F.when(minor, deal(F.col("minors"))).otherwise(F.col("minors") + deal(F.greatest("majors", F.lit(1)))))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.when(minor, F.col("minors") + F.col("majors")).otherwise(F.col("minors")) - 1)))
    rows = rows.select("g", F.least("block", "o").alias("p"), F.greatest("block", "o").alias("q"), "block", "node", "component", "size", "d", "parity")
    return rows.groupBy("g", "p", "q").applyInArrow(_links(percent), "a long, b long")


def settled(docs_of, rest: DataFrame, known: DataFrame, words: int, percent: int) -> DataFrame:
    """known after the links within crowds (rest: g, node, component), which the forest may have missed.

    Within a group the differences from the template stand for the sets. Links near the template need no search; most others show in sorted orders of the
    differences, which leaves fewer components to all pairs of what is still apart.
    """
    nodes = rest.select(F.col("node").alias("doc_id"))
    diffs = differences(save(map_texts(docs_of(nodes), _long_sets(words), "shingles array<bigint>")), rest)
    known = joined_up(known, near_template(diffs, percent))
    for search in (lambda d: linked(save(beside(d, percent)), d, percent), lambda d: across(d, percent)):
        now = save(diffs.drop("component").join(label(known, "node"), "node", "left").withColumn("component", F.coalesce("cnode", "node")).drop("cnode"))
        open_groups = now.groupBy("g").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("g")
        now = save(now.join(open_groups, "g", "left_semi"))
        known = joined_up(known, save(search(now)))
    return known


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept, one row per input row."""
    sig = save(signatures(docs, words))
    key = ["k1", "k2", "n_shingles"]
    classes = save(
        sig.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature"), F.count(F.lit(1)).alias("rows"))
    )
    runs = save(crowded_runs(classes))
    pairs = save(candidates(classes, runs, percent / 100))

    def texts_of(nodes: DataFrame) -> DataFrame:
        inside, _ = split_by_ids(with_text(docs), nodes)
        return inside.join(nodes.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])

    ends = save(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    sets = save(map_texts(texts_of(ends), _sets(words), "shingles binary"))
    # the likeliest partner of each class first
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "same"))
    best = both.groupBy("a").agg(F.max(F.struct("same", (-F.col("b")).alias("o"))).alias("m")).select("a", (-F.col("m.o")).alias("b"))
    best = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    known = connected_components(save(confirmed(best, sets, percent)))
    open_pairs = (
        pairs.join(label(known, "a"), "a", "left").join(label(known, "b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
        .join(best, ["a", "b"], "left_anti")
    )
    known = joined_up(known, confirmed(open_pairs, sets, percent))
    rest = crowd(classes, runs, known)
    if not rest.isEmpty():
        known = settled(texts_of, rest, known, words, percent)
    merged = classes.join(known, "node", "left").where("rows > 1 or component is not null").select(*key, "rows", F.coalesce("component", "node").alias("component"))
    out = skew_join(sig.drop("signature"), save(merged), key, "rows")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
