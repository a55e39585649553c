"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is taken to symbols as the model says: blanks become the word mark, one mark goes in front. No piece holds a mark after
another sign, nor a sign that is no piece itself, so texts fall into words at these places, and each distinct word of a block is
merged once. All words are merged together in flat arrays. In each round every word's least pair rank is found; words without a
pair are taken out; in the others all leftmost non-overlapping pairs of that rank are merged at once. Where such a merge
would make a pair of the same or a lesser rank (which the library would take next), only the leftmost pair of the word is
merged. Signs that are no piece become their UTF-8 bytes. Decoding lays out the pieces' bytes and drops the mark in front.

Cases: null and empty texts have no ids. Repeated rows each get their result. A null doc_id is carried through. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from strandflow.llm import arrays
from strandflow.llm.common import map_texts

MARK = "▁"
NONE = np.int64(1) << 40


class Model:
    """The merge table of a model file: keys of pairs, their rank and the piece that they make."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(self.size)]
        plain = {p: i for i, p in enumerate(self.pieces) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        self.byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        value = {int(i): b for b, i in enumerate(self.byte)}
        self.bytes = [bytes([value[i]]) if i in value else p.encode() for i, p in enumerate(self.pieces)]
        self.sign = np.full(0x110000, -1, np.int32)
        for p, i in plain.items():
            if len(p) == 1:
                self.sign[ord(p)] = i
        order = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in plain.values()}, reverse=True))}
        table = [(plain[p[:c]] * self.size + plain[p[c:]], order[model.get_score(i)], i) for p, i in plain.items() for c in range(1, len(p)) if p[:c] in plain and p[c:] in plain]
        self.keys, self.ranks, self.made = (np.array(x, np.int64) for x in zip(*sorted(table), strict=True))

    def rank(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if the two don't make a piece) and the piece made."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.ranks[at], NONE), self.made[at]


@lru_cache(maxsize=1)
def model_of(path: str) -> Model:
    return Model(path)


def merge_words(model: Model, sym: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The final symbols of words given as flat arrays (word is ascending): symbols and the word of each."""
    out_sym, out_word = [], []
    if not len(sym):
        return sym, word
    pair = lambda i: (np.where(word[i] == word[np.minimum(i + 1, len(word) - 1)], sym[i], -1), sym[np.minimum(i + 1, len(sym) - 1)])
    every = np.arange(len(sym))
    rank, made = model.rank(*pair(every))
    rank[-1] = NONE
    while len(sym):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        size = np.diff(np.append(first, len(word)))
        least = np.minimum.reduceat(rank, first)
        live = least < NONE
        if not live.all():
            keep = np.repeat(live, size)
            out_sym.append(sym[~keep])
            out_word.append(word[~keep])
            sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
            least, size = least[live], size[live]
            if not len(sym):
                break
        best = np.repeat(least, size)
        at = np.flatnonzero(rank == best)
        # alternate ones of each run of overlapping pairs
        new_run = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (word[at[1:]] != word[at[:-1]])])
        begin = np.flatnonzero(new_run)
        in_run = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
        at = at[in_run % 2 == 0]
        owner = word[at]
        lead = np.concatenate([[True], owner[1:] != owner[:-1]])
        if not lead.all():  # several at once: only if no pair of the same or a lesser rank comes about
            group = np.cumsum(lead) - 1
            m, r = made[at], rank[at]
            before, after = np.maximum(at - 1, 0), np.minimum(at + 2, len(sym) - 1)
            low = np.full(len(at), NONE)
            lefts = np.where((at > 0) & (word[before] == owner), sym[before], -1)
            rights = np.where((at + 2 < len(sym)) & (word[after] == owner), sym[after], -1)
            for a, b in ((lefts, m), (m, rights), (m[:-1], m[1:])):
                x = model.rank(a, b)[0]
                low[: len(x)] = np.minimum(low[: len(x)], x)
            bad = np.zeros(group[-1] + 1, bool)
            np.logical_or.at(bad, group, low <= r)
            at = at[lead | ~bad[group]]
        sym[at] = made[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        moved = np.cumsum(keep) - 1
        at = moved[at]
        sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
        touched = np.zeros(len(sym), bool)
        touched[at] = touched[np.maximum(at - 1, 0)] = True
        again = np.flatnonzero(touched)
        rank[again], made[again] = model.rank(*pair(again))
        rank[-1] = NONE
    sym, word = np.concatenate(out_sym), np.concatenate(out_word)
    order = np.argsort(word, kind="stable")
    return sym[order], word[order]


def words_of(texts: list[str], model: Model):
    """Distinct words of texts: their pieces (lists of ids), the word at each place, and where each text's places begin."""
    marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
    cp, starts = arrays.code_points(marked)
    if not len(cp):
        return [], np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    sign = model.sign[cp]
    strange, mark = sign < 0, cp == ord(MARK)
    begin = strange.copy()
    begin[1:] |= strange[:-1] | (mark[1:] & ~mark[:-1])
    begin[starts[:-1][starts[:-1] < len(cp)]] = True
    s = np.flatnonzero(begin)
    e = np.append(s[1:], len(cp))
    _, first, word = np.unique(arrays.Hasher(cp)(s, e), return_index=True, return_inverse=True)
    s1, e1 = s[first], e[first]
    known = np.flatnonzero(~strange[s1])
    length = (e1 - s1)[known]
    sym, owner = merge_words(model, sign[np.repeat(s1[known], length) + arrays.ragged(length)].astype(np.int64), np.repeat(known, length), len(first))
    ids: list[list[int]] = [[]] * len(first)
    cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    flat = sym.tolist()
    for w, a, b in zip(owner[cuts].tolist(), cuts.tolist(), np.append(cuts[1:], len(sym)).tolist(), strict=True):
        ids[w] = flat[a:b]
    for w in np.flatnonzero(strange[s1]).tolist():
        ids[w] = model.byte[list(chr(cp[s1[w]]).encode("utf-8", "surrogatepass"))].tolist()
    return ids, word, np.searchsorted(s, starts)


def encode(texts: list[str], path: str) -> list[list[int]]:
    ids, word, begin = words_of(texts, model_of(path))
    return [[x for w in word[a:b].tolist() for x in ids[w]] for a, b in zip(begin[:-1], begin[1:], strict=True)]


def decode(ids: list[int], path: str) -> str:
    model = model_of(path)
    return b"".join(model.bytes[i] for i in ids).decode("utf-8", "replace").replace(MARK, " ")[1:]


def sentence_piece(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def work(texts: list[str]):
        model = model_of(path)
        ids, word, begin = words_of(texts, model)
        shown = [",".join(map(str, x)) for x in ids]
        back = [b"".join([model.bytes[i] for i in x]) for x in ids]
        count = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))[word])])
        listed, decoded = [], []
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            own = word[a:b].tolist()
            listed.append(hashlib.sha256(",".join([shown[w] for w in own]).encode()).hexdigest())
            text = b"".join([back[w] for w in own]).decode("utf-8", "replace").replace(MARK, " ")[1:]
            decoded.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
        return None, {"n_tokens": count[begin[1:]] - count[begin[:-1]], "ids_sha256": listed, "decoded_sha256": decoded}

    return map_texts(docs, work, "n_tokens long, ids_sha256 string, decoded_sha256 string")
