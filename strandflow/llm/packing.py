"""Packing documents into windows of WINDOW tokens by Karmarkar-Karp multiway differencing.

Each document's ids (with an end id) are cut into full windows and, of what is left, pieces of at most PIECE tokens.
Pieces are dealt by the hash of their place into groups of about GROUP windows' worth; within a group multiway differencing merges partial
partitions, those with the greatest spread first, laying the fullest windows of one on the emptiest of the other, so the
windows end nearly equal. The number of windows of a group starts at the least possible and rises while any window exceeds the capacity.
Groups are bounded by their number, which follows the total of tokens, so no task sees more with more data. The pieces are
written to the shared folder first: texts are tokenized once.

Cases: null and empty texts are one end id. Repeated rows are packed each. A null doc_id is carried through; as pieces are dealt by
their place in the written table, any number of rows with a null or repeated doc_id spreads over all groups. A very long text is many full
windows, which stand alone, and at most four pieces. Ties between windows or pieces of equal size go to the one first in (doc_id, start, ids_crc32).
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm import byte_bpe
from strandflow.llm.common import map_texts, save

WINDOW = 1024
PIECE = 256
GROUP = 96
END = 0
PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


def cut(docs: DataFrame, vocabulary: str, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """The pieces of every document: doc_id, start, length, ids_crc32, doc_tokens."""

    def pieces(texts: list[str]):
        ids, begin = byte_bpe.encode(texts, vocabulary)
        rows, start, length, crc, total = [], [], [], [], []
        for k in range(len(texts)):
            own = np.append(ids[begin[k] : begin[k + 1]], np.uint32(END)).astype("<u4")
            full = len(own) // window * window
            for a, b in [*((i, i + window) for i in range(0, full, window)), *((i, min(i + piece, len(own))) for i in range(full, len(own), piece))]:
                rows.append(k)
                start.append(a)
                length.append(b - a)
                crc.append(zlib.crc32(own[a:b].tobytes()))
                total.append(len(own))
        return np.array(rows, np.int64), {"start": np.array(start, np.int64), "length": np.array(length, np.int64), "ids_crc32": np.array(crc, np.int64), "doc_tokens": np.array(total, np.int64)}

    return map_texts(docs, pieces, PIECES)


def differencing(sizes: np.ndarray, k: int) -> list[list[int]]:
    """k lists of item numbers with nearly equal sums: multiway differencing."""
    n = len(sizes)
    left, right = list(range(n)), [-1] * n  # nodes: items first, then unions of two nodes
    heap = []
    for i in range(n):
        sums = np.zeros(k, np.int64)
        sums[0] = sizes[i]
        nodes = np.full(k, -1, np.int64)
        nodes[0] = i
        heap.append((-int(sizes[i]), i, sums, nodes))
    heapq.heapify(heap)
    turn = n
    while len(heap) > 1:
        _, _, s1, n1 = heapq.heappop(heap)
        _, _, s2, n2 = heapq.heappop(heap)
        s, other = s1 + s2[::-1], n2[::-1]
        nodes = np.where(n1 < 0, other, n1)
        both = np.flatnonzero((n1 >= 0) & (other >= 0))
        if len(both):
            nodes[both] = np.arange(len(left), len(left) + len(both))
            left.extend(n1[both].tolist())
            right.extend(other[both].tolist())
        order = np.argsort(-s, kind="stable")
        s, nodes = s[order], nodes[order]
        s = s - s[-1]  # only differences matter
        heapq.heappush(heap, (-int(s[0]), turn, s, nodes))
        turn += 1
    out = []
    for node in heap[0][3].tolist() if heap else []:
        stack, items = [node] if node >= 0 else [], []
        while stack:
            x = stack.pop()
            if x < n:
                items.append(x)
            else:
                stack += [left[x], right[x]]
        out.append(items)
    return out


def windows(sizes: np.ndarray, capacity: int = WINDOW) -> list[list[int]]:
    """Item numbers by window, no window over the capacity; items as large as a window stand alone."""
    full = np.flatnonzero(sizes >= capacity)
    rest = np.flatnonzero(sizes < capacity)
    out = [[int(i)] for i in full]
    k = -(-int(sizes[rest].sum()) // capacity)
    while len(rest):
        packed = differencing(sizes[rest], k)
        if max(int(sizes[rest[w]].sum()) for w in packed if w) <= capacity:
            return out + [[int(rest[i]) for i in w] for w in packed if w]
        k += 1
    return out


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset per piece."""
    cutting = save(cut(docs, vocabulary, window))
    loose = cutting.agg(F.sum(F.when(F.col("length") < window, F.col("length")))).first()[0] or 0
    groups = max(1, loose // (GROUP * window))

    def group(table):
        import pyarrow as pa

        order = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        sizes = order.column("length").to_numpy()
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        base = int(order.column("g")[0].as_py()) << 32
        for number, items in enumerate(windows(sizes, window)):
            at = 0
            for i in sorted(items):
                sequence[i], offset[i] = base + number, at
                at += int(sizes[i])
        return order.drop_columns(["g"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    place = F.xxhash64("doc_id", "start", "ids_crc32", F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    dealt = cutting.withColumn("g", F.pmod(place, F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(group, f"doc_id long, {PIECES}, sequence_id long, offset long")
