"""Phrase collocation mining with Rabin-Karp fingerprints.

Prefix polynomials over the words of a block of texts give the fingerprint of every n-gram in constant time. Passes over the texts go from short phrases
to longer ones: an n-gram is fingerprinted only if all shorter ones inside it may be frequent (a bitmap of at most 8 MB tells; what it lets
through too much is only counted). Each task adds up its fingerprints before the shuffle; there they are aggregated with a pointer (document and position) to an occurrence.

A fingerprint may stand for several phrases, so none is trusted: a last pass goes back to the texts, compares all occurrences of frequent fingerprints word by word, and
counts by text. Only these phrases are ever materialised. Phrases that fall below the threshold there are dropped, so counts are exact.

Scores are integers of at most 38 digits. Association is the least over all cuts of a phrase; a phrase that only occurs inside longer ones is left to these.

Cases: null and empty texts have no words; a null lang is `und`. Very long texts are one block each. Ties in a cut go to the shorter first part, in the report to
the phrase in byte order. Repeated rows count again. Empty tables give empty results. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.llm import arrays
from strandflow.llm.common import save

PIECE_ENDS = [ord(c) for c in ".,;:!?\n\x0b\x0c\r"]
GAPS = [0x20, 0x09]
PASSES = ((1,), (2,), (3,), (4, 5))
HELD = 1_000_000  # fingerprints that a task adds up before it hands them on
CHARS = 2_000_000  # characters of a block of texts


class Words:
    """The words of a block of texts, lower-cased (A-Z): where they start and end, their hashes, the piece each lies in and its text."""

    def __init__(self, texts: list[str], langs: list[str]):
        cp, starts = arrays.code_points(texts)
        self.cp = np.where((cp >= 65) & (cp <= 90), cp + 32, cp)
        cut = np.zeros(128, bool)
        cut[PIECE_ENDS] = True
        low = np.minimum(self.cp, 127)
        end, gap = cut[low], (self.cp == GAPS[0]) | (self.cp == GAPS[1])
        self.start, self.end, self.doc = arrays.runs(~(end | gap), starts)
        self.piece = np.cumsum(end)[self.start] if len(self.start) else self.start
        self.hash = arrays.Hasher(self.cp)(self.start, self.end)
        spans = arrays.Hasher(self.hash)
        self.lang = np.array([_lang_key(x) for x in langs], np.uint64)[self.doc]
        self.spans, self.begin = spans, starts

    def grams(self, n: int) -> np.ndarray:
        """The first words of all phrases of n words."""
        i = np.arange(max(0, len(self.start) - n + 1))
        j = i + n - 1
        return i[(self.piece[i] == self.piece[j]) & (self.doc[i] == self.doc[j])]

    def prints(self, first: np.ndarray, n: int) -> np.ndarray:
        return arrays.mix(self.spans(first, first + n) ^ self.lang[first])

    def offset(self, first: np.ndarray) -> np.ndarray:
        return self.start[first] - self.begin[self.doc[first]]


def _lang_key(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")


def _texts(batches):
    """Blocks of texts with their doc_ids (an Arrow column) and langs."""
    for batch in batches:
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        for lo, hi in arrays.blocks(texts, CHARS):
            yield Words(texts[lo:hi], langs[lo:hi]), batch.column("doc_id").slice(lo, hi - lo).to_pylist(), langs[lo:hi]


def in_bitmap(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    at = prints & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _summed(parts: list[tuple]) -> tuple:
    """prints, counts, doc_ids and offsets: equal prints added up, the pointer of the first kept."""
    prints, counts, docs, offsets = (np.concatenate(x) for x in zip(*parts, strict=True))
    value, first, inverse = np.unique(prints, return_index=True, return_inverse=True)
    return value, np.bincount(inverse, counts, len(value)).astype(np.int64), docs[first], offsets[first]


def _fingerprints(lengths: tuple[int, ...], known: int, bits: np.ndarray | None):
    def run(batches):
        import pyarrow as pa

        def out(parts):
            value, counts, docs, offsets = _summed(parts)
            null = docs == NULL
            return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(counts), pa.array(docs, mask=null), pa.array(offsets)], names=["print", "n", "doc_id", "offset"])

        parts, held = [], 0
        for words, ids, _ in _texts(batches):
            ids = np.array([NULL if x is None else x for x in ids], np.int64)
            likely = in_bitmap(bits, words.prints(np.arange(max(0, len(words.start) - known + 1)), known)) if known else None
            for n in lengths:
                first = words.grams(n)
                for j in range(n - known + 1 if known else 0):
                    first = first[likely[first + j]]
                parts.append((words.prints(first, n), np.ones(len(first), np.int64), ids[words.doc[first]], words.offset(first)))
                held += len(first)
            if held > HELD:
                parts = [_summed(parts)]
                held = len(parts[0][0])
                if 2 * held > HELD:
                    yield out(parts)
                    parts, held = [], 0
        if parts:
            yield out(parts)

    return run


NULL = np.iinfo(np.int64).min


def bitmap(prints: DataFrame) -> np.ndarray:
    """A bitmap of at most 2^26 bits in which each print (long) has its bit set."""
    n = prints.count()
    size = 1 << min(26, max(15, (16 * n).bit_length()))
    at = F.col("print").bitwiseAND(size - 1)
    maps = prints.select((at + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for r in maps.collect():  # at most 2048 rows of 4 KB
        at = (r.bucket - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def frequent(docs: DataFrame, lengths: tuple[int, ...], known: int, bits: np.ndarray | None, least: int) -> DataFrame:
    """print, n, doc_id, offset of fingerprints that occur at least so often; doc_id and offset point to one occurrence."""
    found = docs.mapInArrow(_fingerprints(lengths, known, bits), "print long, n long, doc_id long, offset long")
    return save(found.groupBy("print").agg(F.sum("n").alias("n"), F.first("doc_id").alias("doc_id"), F.first("offset").alias("offset")).where(F.col("n") >= least))


class Ledger:
    """Phrases of a task by fingerprint, as rows of word numbers, counted only after comparison with them; the numbers stand for words by their text."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.prints = np.zeros(0, np.uint64)
        self.words = np.zeros((0, 5), np.int32)
        self.counts, self.docs, self.offsets = (np.zeros(0, np.int64) for _ in range(3))
        self.langs: list[np.ndarray] = [np.zeros(0, object)]
        self.odd: dict[tuple, list] = {}  # phrases that share another one's fingerprint

    def numbered(self, words: Words, used: np.ndarray) -> np.ndarray:
        """Numbers of the words used; equal hashes are held against the text of their first word."""
        out = np.full(len(words.start), -1, np.int32)
        at = np.flatnonzero(used)
        _, first, inverse = np.unique(words.hash[at], return_index=True, return_inverse=True)
        model = at[first][inverse]
        length = words.end[at] - words.start[at]
        same = length == words.end[model] - words.start[model]
        step = arrays.ragged(length)
        other = np.minimum(np.repeat(words.start[model], length) + step, len(words.cp) - 1)
        unlike = words.cp[np.repeat(words.start[at], length) + step] != words.cp[other]
        same &= np.bincount(np.repeat(np.arange(len(at)), length), unlike, len(at)) == 0
        text = lambda i: words.cp[words.start[i] : words.end[i]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        number = lambda i: self.numbers.setdefault(text(i), len(self.numbers))
        out[at] = np.array([number(i) for i in at[first]], np.int32)[inverse] if len(at) else out[at]
        for i in at[~same]:
            out[i] = number(i)
        return out

    def add(self, words: Words, ids: np.ndarray, langs: np.ndarray, picked: list[tuple[np.ndarray, int]]) -> None:
        """Count the phrases picked: (first words, length)."""
        used = np.zeros(len(words.start) + 5, bool)
        for first, n in picked:
            for j in range(n):
                used[first + j] = True
        number = self.numbered(words, used[: len(words.start)])
        number = np.concatenate([number, np.full(5, -1, np.int32)])
        first = np.concatenate([f for f, _ in picked])
        n = np.repeat([n for _, n in picked], [len(f) for f, _ in picked])
        prints = np.concatenate([words.prints(f, n) for f, n in picked])
        rows = number[first[:, None] + np.arange(5)]
        rows[np.arange(5) >= n[:, None]] = -1
        lang = langs[words.doc[first]]
        value, head, inverse = np.unique(prints, return_index=True, return_inverse=True)
        where = np.searchsorted(self.prints, value)
        old = np.append(self.prints, np.uint64(0))[where] == value
        old &= where < len(self.prints)
        model, model_lang = rows[head], lang[head]
        model[old], model_lang[old] = self.words[where[old]], self.langs[0][where[old]]
        same = (rows == model[inverse]).all(axis=1) & (lang == model_lang[inverse])
        for i in np.flatnonzero(~same):
            at = self.odd.setdefault((lang[i], *rows[i]), [0, ids[words.doc[first[i]]], words.offset(first[i : i + 1])[0]])
            at[0] += 1
        counts = np.bincount(inverse[same], minlength=len(value)).astype(np.int64)
        self.counts[where[old]] += counts[old]
        new = ~old
        docs, offsets = ids[words.doc[first[head[new]]]], words.offset(first[head[new]])
        columns = [(self.prints, value[new]), (self.words, model[new]), (self.counts, counts[new]), (self.docs, docs), (self.offsets, offsets), (self.langs[0], model_lang[new])]
        order = np.argsort(np.concatenate(columns[0]), kind="stable")
        self.prints, self.words, self.counts, self.docs, self.offsets, self.langs[0] = (np.concatenate(c)[order] for c in columns)

    def batch(self):
        """lang, phrase, n_words, n, doc_id, offset of all phrases."""
        import pyarrow as pa

        text = np.array(list(self.numbers), object)
        rows = [*self.words.tolist(), *([*k[1:]] for k in self.odd)]
        docs = np.concatenate([self.docs, np.array([v[1] for v in self.odd.values()], np.int64)])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([*self.langs[0], *(k[0] for k in self.odd)], pa.string()), pa.array([" ".join(text[j] for j in r if j >= 0) for r in rows], pa.string()), pa.array([sum(j >= 0 for j in r) for r in rows], pa.int32()),
                pa.array([*self.counts, *(v[0] for v in self.odd.values())], pa.int64()), pa.array(docs, mask=docs == NULL), pa.array([*self.offsets, *(v[2] for v in self.odd.values())], pa.int64()),
            ],
            names=["lang", "phrase", "n_words", "n", "doc_id", "offset"],
        )


def _materialised(bits: dict[int, np.ndarray]):
    """Phrases whose fingerprint is likely frequent, counted by text; and a row without phrase for all words of a language."""

    def run(batches):
        import pyarrow as pa

        ledger, totals = Ledger(), {}
        for words, ids, langs in _texts(batches):
            ids, langs = np.array([NULL if x is None else x for x in ids], np.int64), np.array(langs, object)
            for d, n in zip(*np.unique(words.doc, return_counts=True), strict=True):
                totals[langs[d]] = totals.get(langs[d], 0) + int(n)
            picked = []
            for n, b in bits.items():
                first = words.grams(n)
                picked.append((first[in_bitmap(b, words.prints(first, n))], n))
            ledger.add(words, ids, langs, picked)
            if len(ledger.prints) + len(ledger.odd) > HELD // 2:
                yield ledger.batch()
                ledger = Ledger()
        yield ledger.batch()
        n = len(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.string()), pa.nulls(n, pa.string()), pa.array([0] * n, pa.int32()), pa.array(list(totals.values()), pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())],
            names=["lang", "phrase", "n_words", "n", "doc_id", "offset"],
        )

    return run


def phrases(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Exact counts of all phrases of 1 to 5 words that occur at least so often in a lang (lang, phrase, n_words, f, doc_id, offset), and words by lang (lang, words)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    bits, known, last = {}, 0, None
    for lengths in PASSES:
        last = bitmap(frequent(texts, lengths, known, last, least).select("print"))
        bits |= dict.fromkeys(lengths, last)
        known = lengths[0]
    found = texts.mapInArrow(_materialised(bits), "lang string, phrase string, n_words int, n long, doc_id long, offset long")
    pointer = [F.min("doc_id").alias("doc_id"), F.min_by("offset", "doc_id").alias("offset")]
    counted = save(found.groupBy("lang", "phrase", "n_words").agg(F.sum("n").alias("f"), *pointer).where((F.col("f") >= least) | F.col("phrase").isNull()))
    return counted.where("phrase is not null"), counted.where("phrase is null").select("lang", F.col("f").alias("words"))


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, share: int = 100) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, doc_id and offset of an occurrence: the top phrases of each lang.

    A candidate goes when a longer one that holds it occurs at least share times for each hundred of its own occurrences.
    """
    counts, totals = phrases(docs, least)
    candidates = counts.where("n_words > 1").select("lang", "phrase", F.split("phrase", " ").alias("w"), "n_words", F.col("f").alias("a"), "doc_id", "offset")
    cut = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    part: dict[str, Column] = {"left": F.array_join(F.slice("w", F.lit(1), F.col("k")), " "), "right": F.array_join(F.slice("w", F.col("k") + 1, F.col("n_words") - F.col("k")), " ")}
    for name, f in (("left", "l"), ("right", "r")):
        cut = cut.withColumn(name, part[name]).join(counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f)), ["lang", name])
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cut = cut.join(F.broadcast(totals.withColumnRenamed("words", "n")), "lang") if totals.count() < 10_000 else cut.join(totals.withColumnRenamed("words", "n"), "lang")
    cut = cut.withColumns({"_over": (F.lit(1000).cast("decimal(38,0)") * wide("a")).cast("decimal(38,0)") * wide("n"), "_under": wide("l") * wide("r")})
    cut = cut.withColumn("score", F.expr("_over div _under"))
    best = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("b")
    scores = cut.groupBy("lang", "phrase").agg(F.first("w").alias("w"), F.first("a").alias("a"), F.first("n").alias("n"), F.first("n_words").alias("n_words"), F.first("doc_id").alias("doc_id"), F.first("offset").alias("offset"), best)
    # a phrase inside a longer one with as many occurrences has as many as all between, so phrases one word longer tell
    inner = candidates.where("n_words > 2").select("lang", "a", F.explode(F.array(F.array_join(F.slice("w", F.lit(1), F.col("n_words") - 1), " "), F.array_join(F.slice("w", F.lit(2), F.col("n_words") - 1), " "))).alias("phrase"))
    inside = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = scores.join(inside, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {share} * a")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("b.score"), F.desc("a"), "phrase"))
    out = left.withColumn("rank", rank).where(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "b.l", "b.r", "n", "b.score", "doc_id", "offset")
