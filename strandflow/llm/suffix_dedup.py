"""Removal of repeated passages, by blockwise sorting of suffixes with a difference cover.

Texts are UTF-8 bytes. A suffix counts to a depth of WIDTH bytes and within its document; where its first WIDTH bytes also
start at an earlier place (smaller doc_id, or earlier in the same document), these bytes go. Suffixes are told apart bucket by bucket.

1. Buckets. The least hash of GRAM bytes within a suffix's WIDTH bytes depends on these bytes alone, so equal
suffixes have the same one (their anchor). Neighbouring suffixes with one anchor form a unit. A unit whose anchor stands in no other unit (and once in it) repeats
nothing. Of units with equal anchor and content (two 64-bit hashes) all but the first are repeated as a whole. What is left are the different contents of
an anchor, at the borders of repeated passages: these are its bucket, and only their bytes travel.
2. A bucket is sorted by its suffixes' first COVER bytes and their offset from the anchor. Ties are settled by ranks: of a suffix's positions those of a
difference cover modulo COVER, counted from the anchor, are samples, so suffixes with one offset reach a sample after the same number of bytes. The samples
of a bucket are sorted once, by WIDTH - COVER bytes, into integer ranks; a tie is settled by the rank of the next sample and the last COVER bytes. Equal neighbours in that order
are equal suffixes: all but the first place go. Bytes are compared as such, and a bucket needs its own bytes and ranks only.
3. An anchor with more than CROWD contents (a passage in a large part of all documents) would be a bucket of any size. Its suffixes are dealt
out one by one by a record of three 64-bit hashes (first COVER bytes, sample, last COVER bytes), so they spread, and each block of texts decides its own first.

Counts per anchor and first places are partial aggregates; hot anchors and contents are broadcast (common.skew_join). A task holds a few megabytes of text, or one document.

Cases: null texts are empty; texts shorter than WIDTH lose nothing. Rows with a null doc_id are compared with nothing. Repeated rows of one doc_id and text are one
document and get the same result each; different texts under one doc_id are parts of one document, in order of text, and no match crosses from one to the next. Of equal
strings the first place stays. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from math import isqrt

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.llm import arrays
from strandflow.llm.common import save, skew_join, split_by_ids, split_by_keys, with_text

WIDTH = 100
GRAM = 40
COVER = 16
#: Contents of an anchor (some 130 bytes each) beyond which their suffixes are dealt out one by one: a bucket is at most a few megabytes.
CROWD = 20_000
UNIT = "anchor long, content long, doc_id long, start long, suffixes int, again boolean, several boolean"


def difference_cover(v: int = COVER) -> np.ndarray:
    """Residues modulo v = r * r of which every residue is a difference: 0..r-1 and the multiples of r."""
    r = isqrt(v)
    return np.unique(np.concatenate([np.arange(r), np.arange(0, v, r)]))


def _bytes(batch) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]


def _blocks(texts: list[bytes]):
    yield from arrays.blocks(texts)


class Block:
    """Texts laid end to end, the hashes of their spans, and their units."""

    def __init__(self, texts: list[bytes], bare: bool = False):
        data = np.frombuffer(b"".join(texts), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.span = arrays.Hasher(data)
        n = len(data) - WIDTH + 1
        self.first = self.end = self.owner = np.zeros(0, np.int64)
        self.anchor = np.zeros(0, np.uint64)
        if n <= 0 or bare:
            return
        at = np.arange(len(data) - GRAM + 1)
        low = self.span(at, at + GRAM)
        grams, reach = WIDTH - GRAM + 1, 1
        while 2 * reach <= grams:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        low = np.minimum(low[:n], low[grams - reach : grams - reach + n])
        change = np.zeros(n + 1, bool)
        change[0] = change[n] = True
        change[1:n] = low[1:] != low[:-1]
        size = np.diff(self.starts)
        inner = self.starts[:-1][size > 0]
        change[inner[inner < n]] = True
        lasts = self.starts[1:] - WIDTH + 1  # the first place in each text at which no suffix of full width starts
        lasts = lasts[(size >= WIDTH) & (lasts <= n)]
        change[lasts] = True
        cut = np.flatnonzero(change)
        first, end = cut[:-1], cut[1:]
        owner = np.searchsorted(self.starts, first, "right") - 1
        whole = first + WIDTH <= self.starts[owner + 1]
        self.first, self.end, self.owner = first[whole], end[whole], owner[whole]
        self.anchor = low[self.first]

    def several(self, first: np.ndarray, size: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Whether a unit's anchor stands at more than one place in it: then it may repeat itself."""
        grams = size + WIDTH - GRAM
        at = np.repeat(first, grams) + arrays.ragged(grams)
        hits = self.span(at, at + GRAM) == np.repeat(anchor, grams)
        return np.add.reduceat(hits, np.cumsum(grams) - grams, dtype=np.int64) > 1 if len(first) else np.zeros(0, bool)

    def contents(self) -> np.ndarray:
        return self.span(self.first, self.end + WIDTH - 1)


def _later(key: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of sorted rows, those that stand later than the first row of their key (rows at the same place do not)."""
    n = key.shape[1]
    if not n:
        return np.zeros(0, bool)
    new = np.ones(n, bool)
    new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return (doc != doc[first]) | (start != start[first])


def _units(batches):
    """Units (again: an equal one stands earlier in the same block; several: the anchor stands more than once in it)."""
    import pyarrow as pa

    for batch in batches:
        texts, ids, base = _bytes(batch), batch.column("doc_id").to_numpy(), batch.column("base").to_numpy()
        for lo, hi in _blocks(texts):
            b = Block(texts[lo:hi])
            doc = ids[lo:hi][b.owner]
            start = b.first - b.starts[b.owner] + base[lo:hi][b.owner]
            content = b.contents()
            several = b.several(b.first, b.end - b.first, b.anchor)
            order = np.lexsort((start, doc, content))
            again = np.zeros(len(order), bool)
            again[order] = _later(content[order][None], doc[order], start[order])
            yield pa.RecordBatch.from_arrays(
                [pa.array(b.anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(doc), pa.array(start), pa.array((b.end - b.first).astype(np.int32)), pa.array(again), pa.array(several)],
                names=["anchor", "content", "doc_id", "start", "suffixes", "again", "several"],
            )


def _offsets(block: Block, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of units: their places, the unit of each, and how far behind its start its anchor stands."""
    at = np.repeat(first, size) + arrays.ragged(size)
    places, least = _anchor_places(block, first)
    several = np.repeat(block.several(first, size, least), size)
    offset = np.repeat(places, size) - at
    offset[several] = _anchor_places(block, at[several])[0] - at[several]
    return at, np.repeat(np.arange(len(first)), size), offset


def _next_sample(at: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """The first place from each suffix on that is a sample: its distance from the anchor is in the difference cover."""
    residues = difference_cover()
    gap = np.array([min((d - o) % COVER for d in residues) for o in range(COVER)])
    return at + gap[(-offset) % COVER]


def _words(data: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """width bytes from each place on as big-endian words: in their order the bytes are in order."""
    whole = -(-width // 8) * 8
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(whole, np.uint8)]), whole)[at]
    rows[:, width:] = 0
    return list(rows.view(">u8").T.astype(np.uint64))


def sample_ranks(data: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """The rank of each place in the order of the WIDTH - COVER bytes that begin there; equal bytes, equal rank."""
    place, number = np.unique(sample, return_inverse=True)  # each sample is sorted once
    words = _words(data, place, WIDTH - COVER)
    order = np.lexsort(words[::-1])
    new = np.zeros(len(order), bool)
    for w in words:
        new[1:] |= w[order][1:] != w[order][:-1]
    rank = np.zeros(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank[number]


def _suffixes(block: Block, first: np.ndarray, size: np.ndarray):
    """All suffixes of units: their places, the unit of each, and their records (head, sample, tail)."""
    at, unit, offset = _offsets(block, first, size)
    sample = _next_sample(at, offset)
    known = np.zeros(len(block.span.sums), bool)
    known[sample] = True
    place = np.flatnonzero(known)  # each sample is named once
    number = np.cumsum(known) - 1
    name = block.span(place, np.minimum(place + WIDTH - COVER, len(block.span.sums) - 1))[number[sample]]
    return at, unit, np.stack([block.span(at, at + COVER), name, block.span(at + WIDTH - COVER, at + WIDTH)])


def _units_of(batch, lo: int, hi: int, block: Block):
    """First places, sizes and texts of the units listed for texts lo..hi of a batch (of other parts of the document too, which are left out)."""
    starts, sizes = batch.column("starts").slice(lo, hi - lo), batch.column("sizes").slice(lo, hi - lo)
    owner = np.repeat(np.arange(hi - lo), np.asarray(starts.value_lengths()))
    local = starts.flatten().to_numpy() - batch.column("base").to_numpy()[lo:hi][owner]
    sizes = sizes.flatten().to_numpy().astype(np.int64)
    own = (local >= 0) & (local < np.diff(block.starts)[owner])
    return local[own] + block.starts[owner[own]], sizes[own], owner[own]


def _unit_spans(batches):
    """The bytes of shared units with their anchor: (anchor, doc_id, start, span)."""
    import pyarrow as pa

    for batch in batches:
        texts, ids, base = _bytes(batch), batch.column("doc_id").to_numpy(), batch.column("base").to_numpy()
        for lo, hi in _blocks(texts):
            block = Block(texts[lo:hi], bare=True)
            first, size, owner = _units_of(batch, lo, hi, block)
            least = _anchor_places(block, first)[1]
            joined = b"".join(texts[lo:hi])
            spans = [joined[f : f + n + WIDTH - 1] for f, n in zip(first.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(least.view(np.int64)), pa.array(ids[lo:hi][owner]), pa.array(first - block.starts[owner] + base[lo:hi][owner]), pa.array(spans, pa.binary())],
                names=["anchor", "doc_id", "start", "span"],
            )


def sort_buckets(spans: list[bytes], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the units of whole buckets: unit, place in the document and whether an earlier suffix equals it, for each suffix."""
    block = Block(spans, bare=True)
    first, size = block.starts[:-1], np.diff(block.starts) - WIDTH + 1
    at, unit, offset = _offsets(block, first, size)
    place = start[unit] + at - first[unit]
    data = np.frombuffer(b"".join(spans), np.uint8)
    key = [offset.astype(np.uint64), *_words(data, at, COVER)]
    order = np.lexsort(key[::-1])
    new = np.ones(len(order) + 1, bool)
    new[1:-1] = np.any([k[order][1:] != k[order][:-1] for k in key], axis=0)
    run = np.zeros(len(order), np.int64)
    run[order] = np.cumsum(new[:-1])
    tied = np.zeros(len(order), bool)
    tied[order] = ~(new[:-1] & new[1:])
    tie = np.flatnonzero(tied)
    ranks = sample_ranks(data, _next_sample(at[tie], offset[tie]))
    key = [run[tie], ranks, *_words(data, at[tie] + WIDTH - COVER, COVER)]
    order = np.lexsort((place[tie], doc[unit[tie]], *key[::-1]))
    same = np.zeros(len(unit), bool)
    same[tie[order]] = _later(np.stack([k.astype(np.uint64)[order] for k in key]), doc[unit[tie]][order], place[tie][order])
    return unit, place, same


def _sort_blocks(batches):
    """From spans sorted by anchor: the runs of suffixes that an earlier one equals. A block holds whole buckets."""
    import pyarrow as pa

    held: tuple[list, list, list, list] | None = None

    def sort(_, doc, start, spans):
        doc = np.asarray(doc, np.int64)
        unit, place, same = sort_buckets(spans, doc, np.asarray(start, np.int64))
        edge = np.ones(len(same) + 1, bool)  # runs within a unit
        edge[1:-1] = (same[1:] != same[:-1]) | (unit[1:] != unit[:-1])
        cut = np.flatnonzero(edge)
        begin, length = cut[:-1], np.diff(cut)
        begin, length = begin[same[begin]], length[same[begin]]
        return pa.RecordBatch.from_arrays([pa.array(doc[unit[begin]]), pa.array(place[begin]), pa.array(length.astype(np.int32))], names=["doc_id", "start", "suffixes"])

    for batch in batches:
        rows = tuple(batch.column(c).to_pylist() for c in ("anchor", "doc_id", "start", "span"))
        if held is not None:
            rows = tuple(a + b for a, b in zip(held, rows, strict=True))
        if not rows[0]:
            continue
        cut = rows[0].index(rows[0][-1])  # the last anchor may go on in the next batch
        held = tuple(x[cut:] for x in rows)
        if cut:
            yield sort(*(x[:cut] for x in rows))
    if held is not None and held[0]:
        yield sort(*held)


def _suffix_records(batches):
    """A record (head, sample, tail, doc_id, start) for each suffix of crowded units; again: an earlier one of the block equals it."""
    import pyarrow as pa

    for batch in batches:
        texts, ids, base = _bytes(batch), batch.column("doc_id").to_numpy(), batch.column("base").to_numpy()
        for lo, hi in _blocks(texts):
            block = Block(texts[lo:hi], bare=True)
            first, size, owner = _units_of(batch, lo, hi, block)
            at, unit, record = _suffixes(block, first, size)
            own = owner[unit]
            doc, start = ids[lo:hi][own], at - block.starts[own] + base[lo:hi][own]
            order = np.lexsort((start, doc, record[2], record[1], record[0]))
            same = np.zeros(len(order), bool)
            same[order] = _later(record[:, order], doc[order], start[order])
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(x.view(np.int64)) for x in record], pa.array(doc), pa.array(start), pa.array(same)],
                names=["head", "sample", "tail", "doc_id", "start", "again"],
            )


def _anchor_places(block: Block, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the least GRAM within each suffix stands (the first such place), and its hash."""
    n = WIDTH - GRAM + 1
    out, least = np.zeros(len(at), np.int64), np.zeros(len(at), np.uint64)
    step = 1 << 14
    for i in range(0, len(at), step):
        grams = at[i : i + step, None] + np.arange(n)
        h = block.span(grams.ravel(), grams.ravel() + GRAM).reshape(grams.shape)
        k = np.argmin(h, axis=1)
        out[i : i + step], least[i : i + step] = at[i : i + step] + k, h[np.arange(len(k)), k]
    return out, least


def _sort_bucket(batches):
    """From records sorted by (head, sample, tail, doc_id, start): all but the first of equal suffixes."""
    import pyarrow as pa

    last = None
    for batch in batches:
        rows = [batch.column(c).to_numpy() for c in ("head", "sample", "tail", "doc_id", "start")]
        if not len(rows[0]):
            continue
        if last is not None:  # the first row of the key that the batch before ended with
            rows = [np.concatenate([a, b]) for a, b in zip(last, rows, strict=True)]
        key = np.stack(rows[:3])
        same = _later(key, *rows[3:])
        begin = int(np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))[-1])
        same = same[len(rows[0]) - len(batch) :] | batch.column("again").to_numpy(zero_copy_only=False)
        last = [x[begin : begin + 1].copy() for x in rows]
        mask = pa.array(same)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").filter(mask), batch.column("start").filter(mask)], names=["doc_id", "start"])


def _remove(batches):
    import pyarrow as pa

    for batch in batches:
        ids, starts, sizes, base = batch.column("doc_id"), batch.column("starts"), batch.column("sizes"), batch.column("base").to_pylist()
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for i, text in enumerate(_bytes(batch)):
            n = len(text)
            gone = np.zeros(n + 1, np.int64)
            if starts[i].is_valid:
                s = np.asarray(starts[i].as_py(), np.int64) - base[i]
                e = s + np.asarray(sizes[i].as_py(), np.int64) + WIDTH - 1
                own = (s >= 0) & (e <= n)
                np.add.at(gone, s[own], 1)
                np.add.at(gone, e[own], -1)
            covered = np.cumsum(gone)[:n] > 0
            n_bytes.append(n)
            n_removed.append(int(covered.sum()))
            n_spans.append(int((covered & ~np.concatenate([[False], covered[:-1]])).sum()) if n else 0)
            left = np.frombuffer(text, np.uint8)[~covered].tobytes() if n_removed[-1] else text
            kept.append(left)
        yield pa.RecordBatch.from_arrays([ids, pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def based(docs: DataFrame) -> DataFrame:
    """doc_id, text and base: where the text begins among the different texts of its doc_id (0 but for repeated ones)."""
    docs = docs.select("doc_id", "text")
    zero = F.lit(0).cast("long").alias("base")
    twice = save(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if twice.isEmpty():
        return docs.select("*", zero)
    inside, outside = split_by_ids(docs, twice)
    order = Window.partitionBy("doc_id").orderBy("text").rowsBetween(Window.unboundedPreceding, -1)
    parts = inside.join(twice, "doc_id", "left_semi").distinct().withColumn("base", F.coalesce(F.sum(F.octet_length("text")).over(order), F.lit(0)).cast("long"))
    return outside.unionByName(inside.join(twice, "doc_id", "left_anti")).select("*", zero).unionByName(inside.join(save(parts), ["doc_id", "text"]).select("doc_id", "text", "base"))


def repeated_suffixes(docs: DataFrame) -> DataFrame:
    """(doc_id, start, suffixes): runs of suffixes whose WIDTH bytes start earlier too. docs as from based()."""
    units = save(docs.mapInArrow(_units, UNIT))
    shared_anchors = units.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("several").alias("several")).where("n > 1 OR several").select("anchor")
    inside, _ = split_by_keys(units.where("not again"), save(shared_anchors), ["anchor"])
    shared = save(inside.drop("again"))
    firsts = save(
        shared.groupBy("anchor", "content").agg(
            F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("k"), F.max("several").alias("several"), F.max("suffixes").alias("suffixes")
        )
    )
    run = ["doc_id", "start", "suffixes"]
    met = skew_join(shared, firsts.where("k > 1").select("anchor", "content", "first", "k"), ["anchor", "content"], "k", "inner")
    found = [units.where("again").select(*run), met.where("doc_id <> first.doc_id OR start <> first.start").select(*run)]
    crowds = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("contents"), F.max("several").alias("several")).where("contents > 1 OR several").drop("several")
    left = save(skew_join(firsts.drop("several"), save(crowds), ["anchor"], "contents", "inner").select("first.doc_id", "first.start", "suffixes", (F.col("contents") > CROWD).alias("crowded")))

    def texts_of(rows: DataFrame) -> DataFrame:
        listed = rows.groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("suffixes").alias("sizes"))
        inside, _ = split_by_ids(docs, rows.select("doc_id"))
        return inside.join(listed.hint("merge"), "doc_id").select("doc_id", "text", "base", "starts", "sizes")

    spans = texts_of(left.where("not crowded")).mapInArrow(_unit_spans, "anchor long, doc_id long, start long, span binary")
    found.append(spans.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sort_blocks, "doc_id long, start long, suffixes int"))
    if not left.where("crowded").isEmpty():
        records = texts_of(left.where("crowded")).mapInArrow(_suffix_records, "head long, sample long, tail long, doc_id long, start long, again boolean")
        key = ["head", "sample", "tail"]
        share = F.when(F.col("again"), F.col("doc_id"))  # rows that are decided need not meet the others
        later = records.withColumn("share", share).repartition(*key, "share").drop("share").sortWithinPartitions(*key, "doc_id", "start").mapInArrow(_sort_bucket, "doc_id long, start long")
        found.append(later.withColumn("suffixes", F.lit(1)))
    return reduce(DataFrame.unionByName, found)


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and what is kept (binary)."""
    every = with_text(docs)
    t = based(every.where("doc_id is not null"))
    gone = save(repeated_suffixes(t))
    runs = gone.groupBy("doc_id").agg(F.collect_list(F.struct("start", "suffixes")).alias("g"))
    runs = runs.select("doc_id", F.col("g.start").alias("starts"), F.col("g.suffixes").alias("sizes"))
    inside, outside = split_by_ids(t, gone.select("doc_id").distinct())
    cut = inside.join(runs.hint("merge"), "doc_id", "left").select("doc_id", "text", "base", "starts", "sizes").mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    nothing = F.lit(0).cast("long")
    whole = outside.drop("base").unionByName(every.where("doc_id is null")).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), nothing.alias("n_removed"), nothing.alias("n_spans"), F.col("text").cast("binary").alias("kept")
    )
    return cut.unionByName(whole)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
