"""Toxicity scores: FTRL-proximal logistic regression over hashed words, word pairs and skip-grams.

Learning is online and in order, so it runs in one task, over a bounded sample of labelled rows (SAMPLE of them, by hash of the
doc_id, the same at any partitioning), about PASSES rows in all where few are labelled. L1 keeps most coordinates at zero; the
weights, at most 2^BITS of them, are the only thing that is broadcast besides the sample's ids. Scoring reads every whole text once.

Features of a text: distinct words (runs of letters and digits, lower case) and their first STEMS letters, pairs of neighbours
and pairs with one word between, hashed to 2^BITS coordinates.

Cases: null and empty texts have only the bias; labels that are null or other than 0/1 are not learned; several labels of one row
count as several rows. If no label can be learned every score is 0.5. Repeated rows each get their score; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm import arrays
from strandflow.llm.common import id_bucket, map_texts, with_text

BITS = 18
SAMPLE = 16_000
PASSES = 32_000
STEMS = (5,)
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.1


def features(texts: list[str], weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct coordinates of all texts in a row (0 is the bias, first of each text) and where each text's begin.

    With weights, only coordinates of nonzero weight are returned: they are dropped before the sort that makes them distinct.
    """
    cp, starts = arrays.code_points([t.lower() for t in texts])
    s, e, doc = arrays.runs(_word_class()[cp], starts)
    hasher = arrays.Hasher(cp)
    h = hasher(s, e)
    at = [_coordinate(h)]
    docs = [doc]
    for n in STEMS:
        long = e - s > n
        at.append(_coordinate(arrays.mix(hasher(s[long], s[long] + n) + np.uint64(n))))
        docs.append(doc[long])
    for gap, salt in ((1, 0x51ED27), (2, 0xA3C59AC3)):
        k = max(0, len(doc) - gap)
        same = doc[gap:] == doc[:k]
        at.append(_coordinate(arrays.mix(h[:k][same] * np.uint64(3) + h[gap:][same] + np.uint64(salt))))
        docs.append(doc[:k][same])
    if weights is not None:
        used = [weights[a] != 0 for a in at]
        at, docs = [a[u] for a, u in zip(at, used, strict=True)], [d[u] for d, u in zip(docs, used, strict=True)]
    bias = np.arange(len(texts), dtype=np.int64)
    key = np.unique((np.concatenate([*docs, bias]) << (BITS + 1)) | np.concatenate([*at, np.zeros(len(texts), np.int64)]))
    return key & ((1 << (BITS + 1)) - 1), np.searchsorted(key, bias_ends(len(texts)))


def bias_ends(n: int) -> np.ndarray:
    return np.arange(n + 1, dtype=np.int64) << (BITS + 1)


def _coordinate(h: np.ndarray) -> np.ndarray:
    return np.maximum((h >> np.uint64(64 - BITS)).astype(np.int64), 1)


_classes: list[np.ndarray] = []


def _word_class() -> np.ndarray:
    if not _classes:
        _classes.append(np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000))
    return _classes[0]


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights from the state; the first coordinate is the bias, which L1 leaves alone (else a text without words might score one half)."""
    l1 = np.full(len(z), L1)
    l1[0] = 0
    shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0)
    return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)


def ftrl(rows: list[tuple[np.ndarray, int]], z: np.ndarray, n: np.ndarray) -> None:
    """One pass of FTRL-proximal over rows (coordinates, label), in place."""
    for at, label in rows:
        zi, ni = z[at], n[at]
        w = _weights(zi, ni)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - label
        n[at] = ni + g * g
        z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w


def fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """FTRL-proximal over the sample: the coordinates of nonzero weight."""
    pdf = pdf.sort_values(["doc_id", "toxic"])
    texts, own = list(pdf.text), []
    for lo, hi in arrays.blocks(texts):
        at, begin = features(texts[lo:hi])
        own += [at[i:j].astype(np.int32) for i, j in zip(begin[:-1], begin[1:], strict=True)]
    rows = list(zip(own, pdf.toxic.tolist(), strict=True))
    del pdf, texts, own  # learning needs the coordinates only
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for k in range(max(2, min(20, PASSES // max(1, len(rows))))):
        ftrl([rows[i] for i in np.random.default_rng(k).permutation(len(rows))], z, n)
    w = _weights(z, n)
    at = np.flatnonzero(w)
    return pd.DataFrame({"i": at, "w": w[at]})


def train(docs: DataFrame, labels: DataFrame, learnable, sample: int = SAMPLE) -> np.ndarray:
    """Weights by coordinate (0: bias), all zero if there is nothing to learn from."""
    spark = docs.sparkSession
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").where(learnable)
    order = F.xxhash64("doc_id", F.lit("sample"))
    n = rows.count()
    # a share by hash keeps the top rows below from sorting everything; it is generous, so the sample is full
    rows = rows.where(F.pmod(order, F.lit(1_000_000)) < F.lit(int(min(1.0, 1.3 * sample / max(n, 1)) * 1_000_000) + 1))
    picked = F.broadcast(rows.orderBy(order, "doc_id", "toxic").limit(sample))  # at most sample rows of two numbers
    rows = with_text(docs).join(picked, "doc_id").select("doc_id", "toxic", "text").withColumn("part", F.lit(0))
    found = rows.groupBy("part").applyInPandas(fit, "i int, w double").toArrow()  # at most 2^BITS coordinates
    weights = np.zeros(1 << BITS)
    weights[found.column("i").to_numpy()] = found.column("w").to_numpy()
    return weights


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score of every row; the weights that are broadcast are sparse."""
    at = np.flatnonzero(weights)
    sent = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), weights[at].astype(np.float32)))

    def work(texts: list[str]):
        return None, {"score": probabilities(texts, sent.value)}

    return map_texts(docs, work, "score double")


def probabilities(texts: list[str], sparse: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    w = np.zeros(1 << BITS)
    w[sparse[0]] = sparse[1]
    at, begin = features(texts, w)
    return 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[at], begin[:-1]), -35, 35)))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; labels are learned only where crc32(doc_id) mod 5 is not 0."""
    weights = train(docs, labels, id_bucket(5) != 0)
    held = F.coalesce(id_bucket(5) == 0, F.lit(False))
    return score(docs, weights).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that are not scored toxic, all columns as they were; the score is worked out beside the row."""
    weights = train(docs, labels, id_bucket(5) != 0)
    at = np.flatnonzero(weights)
    sent = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), weights[at].astype(np.float32)))

    @F.pandas_udf("double")
    def toxic(texts: pd.Series) -> pd.Series:
        texts = list(texts)
        out = [probabilities(texts[lo:hi], sent.value) for lo, hi in arrays.blocks(texts)]
        return pd.Series(np.concatenate(out) if out else [], dtype=float)

    return docs.where(toxic(F.coalesce("text", F.lit(""))) < threshold)
