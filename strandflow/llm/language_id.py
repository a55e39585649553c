"""Language identification by cross-parsing entropy.

Per language a suffix automaton is built over a bounded sample of labelled rows (DOCS rows by hash of the doc_id; of a text longer than CHARS
characters PARTS excerpts that lie evenly over the whole of it, CHARS characters together; SAMPLE signs, and TOTAL of all languages together, bound the
tables, a language's share being taken alike from all its excerpts). A text is parsed from left to right into the longest phrases that occur in a language's sample: the automaton walks as
long as it can, and where it can't, a phrase ends. The number of phrases times the bits that name a place in the sample is the
length of the text in that language; the least one wins. Automata become full transition tables (a step that ends a phrase is marked),
so all texts of a block, cut into lanes of LANE signs that are joined up afterwards, walk in all languages side by side.

Letters are lower-cased; what is no letter becomes one blank. The most frequent letters have a sign each; any other is spelled as OTHER
and its number in DIGITS digits, so no two letters are the same and scripts stay apart. Cases: null texts and texts without a letter are `und` with score 0; if
no language can be learned all are. Ties go to the language first in order. Repeated rows each get their result; a null doc_id is
held out of learning and carried through; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.llm import arrays
from strandflow.llm.common import id_bucket, map_texts

DOCS = 12
CHARS = 4_000
PARTS = 16
LANE = 1024
LETTERS = 62  # of the most frequent ones; then what begins other letters, then the blank
OTHER, BLANK, SIGNS = 62, 63, 64
DIGITS = 4  # LETTERS ** 4 is more than there are code points
SAMPLE = DOCS * (CHARS + PARTS)
TOTAL = 400_000  # a sign makes at most two states of 256 bytes


def folded(texts: list[str], code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign codes of all texts in a row, runs of blanks as one, and where each text's begin."""
    low = [t.lower() for t in texts]
    cp, starts = arrays.code_points(low)
    sign = code[cp]
    keep = np.ones(len(sign), bool)
    keep[1:] = (sign[1:] != BLANK) | (sign[:-1] != BLANK)
    sign, cp, starts = sign[keep], cp[keep], np.concatenate([[0], np.cumsum(keep)])[starts]
    rare = np.flatnonzero(sign == OTHER)
    if not len(rare):
        return sign, starts
    size = np.where(sign == OTHER, 1 + DIGITS, 1)
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.repeat(sign, size)
    for k in range(DIGITS):
        out[at[rare] + 1 + k] = cp[rare] // LETTERS ** (DIGITS - 1 - k) % LETTERS
    return out, at[starts]


def sign_codes(samples: list[str]) -> np.ndarray:
    """The sign of each code point: the most frequent letters of the samples get their own."""
    cp = arrays.code_points([t.lower() for t in samples])[0]
    code = np.full(0x110000, BLANK, np.uint8)
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    code[letter] = OTHER
    value, count = np.unique(cp[letter[cp]], return_counts=True)
    top = value[np.lexsort((value, -count))][:LETTERS]
    code[top] = np.arange(len(top))
    return code


def automaton(signs: np.ndarray) -> np.ndarray:
    """The suffix automaton of a sequence as a table: 2 * (SIGNS * next state) + 1 if the step ends a phrase before it."""
    step, link, length = [{}], [-1], [0]
    last = 0
    for c in signs.tolist():
        cur = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    strange = len(step)  # where a sign leads that the sample lacks: it is a phrase of its own
    fresh = np.array([2 * SIGNS * step[0].get(c, strange) + 1 for c in range(SIGNS)], np.int32)
    table = np.tile(fresh, (len(step) + 1, 1))
    for state, out in enumerate(step):
        if out:
            table[state, list(out)] = [2 * SIGNS * to for to in out.values()]
    table[0] = fresh - 1  # only at the start of a lane, where no phrase has ended
    return table.reshape(-1)


def excerpts(text: Column) -> Column:
    """The text, or PARTS excerpts of it, from its beginning to its end at even distances, where it has more than CHARS characters."""
    size = CHARS // PARTS
    first = lambda k: F.floor(k * (F.length(text) - size) / F.lit(PARTS - 1)).cast("int") + 1
    parts = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda k: F.substring(text, first(k), F.lit(size)))
    return F.when(F.length(text) <= CHARS, text).otherwise(F.concat_ws(" ", parts))


def evenly(signs: np.ndarray, most: int) -> np.ndarray:
    """At most so many signs, in PARTS stretches that lie evenly over all of them."""
    if len(signs) <= most:
        return signs
    size = max(1, most // PARTS)
    first = np.linspace(0, len(signs) - size, most // size).astype(np.int64)
    return signs[(first[:, None] + np.arange(size)).reshape(-1)]


def learn(docs: DataFrame, learnable) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Languages, their bits per phrase, sign codes, one table for all, and where each language's part begins."""
    order = F.xxhash64("doc_id", F.lit("language"))
    rows = docs.where(F.col("lang").isNotNull() & learnable & F.col("text").rlike(r"\p{L}")).select(
        "lang", "text", F.col("doc_id").cast("long").alias("doc_id")
    )
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # a share by hash leaves some dozens of rows per language before they are ranked
    few = rows.join(F.broadcast(counts), "lang").where(F.pmod(order, F.lit(1 << 20)) < (F.lit(8.0 * DOCS * (1 << 20)) / F.col("n")))
    few = few.withColumn("text", excerpts(F.col("text")))
    picked = few.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct(order.alias("o"), "doc_id", "text"))), 1, DOCS).alias("s"))
    sample = picked.select("lang", F.concat_ws(" ", F.transform("s", lambda x: x["text"])).alias("text")).orderBy("lang").collect()
    if not sample:
        return None
    code = sign_codes([r["text"] for r in sample])
    shared = docs.sparkSession.sparkContext.broadcast(code)
    most = max(1, min(SAMPLE, TOTAL // len(sample)))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        signs = evenly(folded([pdf.text.iloc[0]], shared.value)[0], most)
        return pd.DataFrame({"lang": pdf.lang, "n": [len(signs)], "states": [automaton(signs).tobytes()]})

    spark = docs.sparkSession
    built = spark.createDataFrame([(r["lang"], r["text"]) for r in sample], "lang string, text string").groupBy("lang").applyInPandas(build, "lang string, n long, states binary").orderBy("lang").collect()
    tables, begin, at = [], [], 0
    for r in built:
        t = np.frombuffer(r["states"], np.int32)
        tables.append(t + 2 * at)
        begin.append(2 * at)
        at += len(t)
    return [r["lang"] for r in built], np.log2([max(2, r["n"]) for r in built]), code, np.concatenate(tables).astype(np.int32), np.array(begin, np.int32)


def phrases(signs: np.ndarray, starts: np.ndarray, table: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The number of phrases of each text in each language.

    Long texts are cut into lanes that walk side by side, each as if a phrase began at its start. Then the walk of each lane is carried on into the next one
    until both begin a phrase at the same place, from where they are the same; the few lanes where they never meet hand on their own end. So the
    phrases are those of one walk over the whole text.
    """
    size = np.diff(starts)
    lanes = -(-size // LANE)
    owner = np.repeat(np.arange(len(size)), lanes)
    out = np.zeros((len(begin), len(size)))
    if not len(owner):
        return out
    first = starts[:-1][owner] + LANE * arrays.ragged(lanes)
    length = np.minimum(LANE, starts[1:][owner] - first)
    order = np.argsort(-length, kind="stable")
    place = np.argsort(order, kind="stable")
    follows = np.where(np.append(owner[1:] == owner[:-1], False), np.append(place[1:], -1), -1)[order]
    first, length, owner = first[order], length[order], owner[order]
    grid = np.zeros((int(length[0]), len(owner)), np.uint8)
    step = arrays.ragged(length)
    lane = np.repeat(np.arange(len(owner)), length)
    grid[step, lane] = signs[first[lane] + step]
    alive = np.searchsorted(-length, -np.arange(len(grid)), "left")
    for lo in range(0, len(begin), 8):  # languages at a time
        some = begin[lo : lo + 8]
        value = np.repeat(some[:, None], len(owner), axis=1)
        begins = np.zeros((len(some), *grid.shape), bool)
        for t in range(len(grid)):
            n = alive[t]
            v = table[(value[:, :n] >> 1) + grid[t, :n]]
            value[:, :n] = v
            begins[:, t, :n] = v & 1
        begins[:, 0] = True
        k, at = np.nonzero(np.broadcast_to(follows >= 0, (len(some), len(owner))))
        v, at = value[k, at], follows[at]
        while len(at):
            t, late = 0, []
            while len(at):
                v = table[(v >> 1) + grid[t, at]]
                new = (v & 1).astype(bool)
                apart = ~(new & begins[k, t, at])
                begins[k, t, at] = new
                k, at, v, t = k[apart], at[apart], v[apart], t + 1
                over = length[at] == t
                if over.any():
                    value[k[over], at[over]] = v[over]
                    more = over & (follows[at] >= 0)
                    late.append((k[more], follows[at[more]], v[more]))
                    k, at, v = k[~over], at[~over], v[~over]
            k, at, v = (np.concatenate(x) for x in zip(*late, strict=True)) if late else (k, at, v)
        for i in range(len(some)):
            out[lo + i] = np.bincount(owner, begins[i].sum(axis=0), len(size))
    return out


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    held = F.coalesce(id_bucket(3) == 1, F.lit(False))
    model = learn(docs, id_bucket(3) != 1)
    if model is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: list[str]):
        langs, bits, code, table, begin = sent.value
        signs, starts = folded(texts, code)
        cost = phrases(signs, starts, table, begin) * bits[:, None]
        best = np.argmin(cost, axis=0)
        score = 1 / np.exp2(cost.min(axis=0) - cost).sum(axis=0)
        letters = np.concatenate([[0], np.cumsum(signs != BLANK)])
        some = letters[starts[1:]] > letters[starts[:-1]]
        return None, {"lang_pred": [langs[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)], "score": np.where(some, score, 0.0)}

    out = map_texts(docs, work, "lang_pred string, score double")
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
