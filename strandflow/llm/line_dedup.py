"""Line deduplication by pairwise alignment.

Lines are told apart by 64-bit hashes. A run is the least number of consecutive lines, from a line on or back from one, that have LEAST
characters together; every line of a common block of LEAST characters lies in a run that both sides hold. Documents become partners through rare lines (shorter than LEAST,
in at most RARE places) and through runs, however frequent. Each holder of a line or run is paired with its earliest holder, so the holders give a star, not all pairs.
Each pair is aligned by patience diff (lines that stand once in both documents, in the longest order that both share, then the stretches between). Aligned blocks of LEAST characters
or more are deleted from the later document. A block may be broken: it goes on over one line that either side or both have for themselves, if that line has at most half the
characters of the aligned stretch before it and of the one after it; the line itself stays. What is left over is aligned again by runs, wherever they stand in the
earlier document (passages in another order, lines that are doubled). So a document loses the lines of every unbroken block that it shares with any earlier one, and those of broken
blocks that it shares with a partner in the same order; a broken block that stands in another order, or of which no line is rare and no run is whole, stays.
Documents are judged on the input, not on what is left of them.

Cases: null texts are empty; an empty text is one empty line. Rows with a null doc_id are compared with nothing. Repeated
rows of one doc_id are one document and get the same result each; of different texts under one doc_id one is compared. Of equal blocks the one
in the smallest doc_id stays. A very long text is one row of line hashes. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm import arrays
from strandflow.llm.common import dealt_join, save, skew_join, split_by_ids, with_text

LEAST = 40
RARE = 16
SHARE = 512  # pairs that one copy of an earlier document's lines is aligned with


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of (i, j), ordered by i, in which j increases."""
    tails, at, back = [], [], [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tails, j)
        back[n] = at[k - 1] if k else -1
        if k == len(tails):
            tails.append(j)
            at.append(n)
        else:
            tails[k], at[k] = j, n
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (i, j) of two sequences, ascending."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        once: dict[int, int] = {}
        for j in range(j0, j1):
            once[b[j]] = -1 if b[j] in once else j
        seen: dict[int, int] = {}
        for i in range(i0, i1):
            seen[a[i]] = -1 if a[i] in seen else i
        anchors = increasing([(i, once[x]) for x, i in seen.items() if i >= 0 and once.get(x, -1) >= 0])
        if anchors:
            for (p, q), (r, s) in zip([(i0 - 1, j0 - 1), *anchors], [*anchors, (i1, j1)], strict=True):
                todo.append((p + 1, r, q + 1, s))
            out += anchors
    return sorted(out)


def blocks(aligned: list[tuple[int, int]], a_chars: np.ndarray, b_chars: np.ndarray, least: int = LEAST) -> list[int]:
    """The places j of aligned blocks that have enough characters together, broken ones included."""
    stretches: list[list[int]] = []  # both sides go on by one: i, j of the first and of the last
    for i, j in aligned:
        if stretches and (i, j) == (stretches[-1][2] + 1, stretches[-1][3] + 1):
            stretches[-1][2:] = i, j
        else:
            stretches.append([i, j, i, j])
    size = [int(b_chars[s[1] : s[3] + 1].sum()) for s in stretches]
    out: list[int] = []
    first, together = 0, 0
    for k, s in enumerate(stretches):
        together += size[k]
        if k + 1 < len(stretches):
            n = stretches[k + 1]
            apart = max(n[0] - s[2], n[1] - s[3]) - 1
            left_out = max(int(a_chars[s[2] + 1 : n[0]].sum()), int(b_chars[s[3] + 1 : n[1]].sum()))
            if apart == 1 and 2 * left_out <= min(size[k], size[k + 1]):
                continue
        if together >= least:
            out += [j for x in stretches[first : k + 1] for j in range(x[1], x[3] + 1)]
        first, together = k + 1, 0
    return out


def short_runs(chars: np.ndarray, starts: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the shortest runs of lines, from each line on and back from each, with enough characters together in one document."""
    total = np.concatenate([[0], np.cumsum(chars, dtype=np.int64)])
    size = np.diff(starts)
    at = np.arange(len(chars))
    on = np.searchsorted(total, total[:-1] + least, "left")
    back = np.searchsorted(total, total[1:] - least, "right") - 1
    a, b = on <= np.repeat(starts[1:], size), back >= np.repeat(starts[:-1], size)
    both = np.unique(np.concatenate([np.stack([at[a], on[a]], 1), np.stack([back[b], at[b] + 1], 1)]), axis=0)
    return both[:, 0], both[:, 1]


def run_keys(lines: np.ndarray, chars: np.ndarray, starts: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of the runs of documents laid end to end."""
    s, e = short_runs(chars, starts, least)
    return arrays.Hasher(lines.view(np.uint64))(s, e), s, e


def alignment(a: np.ndarray, a_chars: np.ndarray, b: np.ndarray, b_chars: np.ndarray, least: int = LEAST) -> np.ndarray:
    """The places of b that stand in blocks of at least so many characters that a has too: by patience, then by runs for what is left."""
    gone = np.zeros(len(b), bool)
    gone[blocks(patience(a.tolist(), b.tolist()), a_chars, b_chars, least)] = True
    whole = np.array([0, len(b)])
    key, s, e = run_keys(b, b_chars, whole, least)
    total = np.concatenate([[0], np.cumsum(gone)])
    left = total[e] - total[s] < e - s  # runs of which a line is not aligned
    if left.any():
        moved = left & np.isin(key, run_keys(a, a_chars, np.array([0, len(a)]), least)[0])
        for i, j in zip(s[moved].tolist(), e[moved].tolist(), strict=True):
            gone[i:j] = True
    return np.flatnonzero(gone)


def _runs(least: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lines, chars = batch.column("lines"), batch.column("chars")
            starts = np.concatenate([[0], np.cumsum(lines.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)])
            line, size = lines.flatten().to_numpy(), chars.flatten().to_numpy()
            key, s, _ = run_keys(line, size, starts, least)
            single = np.flatnonzero((size > 0) & (size < least))
            doc = np.searchsorted(starts, np.concatenate([s, single]), "right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), pa.array(np.concatenate([key.view(np.int64), line[single]])), pa.array(np.arange(len(doc)) >= len(s))],
                names=["doc_id", "run", "single"],
            )

    return run


def _align(least: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            docs, gone = [], []
            for i, d in enumerate(batch.column("doc_id").to_pylist()):
                sides = [batch.column(c)[i].values.to_numpy() for c in ("a", "a_chars", "b", "b_chars")]
                if len(cut := alignment(*sides, least)):
                    docs.append(d)
                    gone.append(cut.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], names=["doc_id", "gone"])

    return run


def _delete(batches):
    import pyarrow as pa

    for batch in batches:
        n_lines, n_removed, kept = [], [], []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            lines = text.split("\n")
            keep = np.ones(len(lines), bool)
            if gone:
                places = np.asarray(gone, np.int64)
                keep[places[places < len(lines)]] = False
                text = "\n".join([x for x, k in zip(lines, keep.tolist(), strict=True) if k])
            n_lines.append(len(lines))
            n_removed.append(int((~keep).sum()))
            kept.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_removed", "kept_text"])


def removed_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, gone): the 0-based lines to delete, by document that loses any."""
    lines = F.split("text", "\n", -1)
    table = save(
        docs.where("doc_id is not null").select(
            "doc_id", F.transform(lines, lambda x: F.xxhash64(x)).alias("lines"), F.transform(lines, lambda x: F.length(x)).alias("chars")
        )
    )
    runs = save(table.mapInArrow(_runs(least), "doc_id long, run long, single boolean"))
    held = runs.groupBy("run", "single").agg(F.min("doc_id").alias("earliest"), F.max("doc_id").alias("latest"), F.count(F.lit(1)).alias("places"))
    held = held.where((F.col("latest") > F.col("earliest")) & (~F.col("single") | (F.col("places") <= RARE))).drop("latest")
    pairs = save(skew_join(runs, save(held), ["run", "single"], "places", "inner").where("doc_id > earliest").select("earliest", "doc_id").distinct())
    one = table.dropDuplicates(["doc_id"])
    a = one.select(F.col("doc_id").alias("earliest"), F.col("lines").alias("a"), F.col("chars").alias("a_chars"))
    b = one.select("doc_id", F.col("lines").alias("b"), F.col("chars").alias("b_chars"))
    sides = dealt_join(pairs, a, "earliest", SHARE).join(b, "doc_id")
    aligned = sides.select("doc_id", "a", "a_chars", "b", "b_chars").mapInArrow(_align(least), "doc_id long, gone array<int>")
    return aligned.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def line_dedup(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_text for every input row."""
    t = with_text(docs)
    gone = save(removed_lines(t, least))
    inside, outside = split_by_ids(t, gone.select("doc_id"))
    cut = inside.join(gone.hint("merge"), "doc_id", "left").select("doc_id", "text", "gone").mapInArrow(_delete, "doc_id long, n_lines long, n_removed long, kept_text string")
    whole = outside.select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), F.col("text").alias("kept_text"))
    return cut.unionByName(whole)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_chars, kept_sha256."""
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", F.length("kept_text").cast("long").alias("kept_chars"), F.sha2("kept_text", 256).alias("kept_sha256"))
