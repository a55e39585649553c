"""Byte-level BPE ids of many texts at once, for vocabularies in the tokenizers library's JSON form.

The word pattern of the vocabulary is worked out on code-point arrays, so that each distinct word of a block is merged once;
its ids are then laid out for every place where the word stands.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import regex

from strandflow.llm import arrays

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point in the word pattern."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[ord(every[m.start()]) : ord(every[m.end() - 1]) + 1] = kind
    out[0xD800:0xE000] = OTHER
    return out


def word_starts(cp: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the words of 's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|spaces not before a word|spaces begin."""
    n = len(cp)
    kind = classes()[cp]
    begin = np.zeros(n + 1, bool)
    begin[starts] = True
    text_border = begin.copy()
    begin[1:n] |= kind[1:] != kind[:-1]
    # a run of spaces before something else leaves its last space: a blank joins what follows, others stand alone
    last = np.flatnonzero((kind == SPACE) & begin[1:] & ~text_border[1:])
    begin[last] = True
    blank = last[cp[last] == 32]
    begin[blank + 1] = False
    # contractions, where an apostrophe begins a word and letters follow
    i = np.flatnonzero((cp == 39) & begin[:n] & begin[1:])
    i = i[(i + 1 < n)]
    i = i[(kind[i + 1] == LETTER) & ~text_border[i + 1]]
    one = cp[i + 1]
    border2 = np.ones(len(i), bool)
    ok = i + 2 < n
    border2[ok] = text_border[i[ok] + 2]
    two = np.where(border2, 0, cp[np.minimum(i + 2, n - 1)])
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for hit, length in ((short, 2), (long & ~short, 3)):
        at = i[hit]
        begin[at + 1] = False
        begin[at + length] = True
    return np.flatnonzero(begin[:n])


@lru_cache(maxsize=2)
def vocabulary_of(path: str):
    """Of a vocabulary file: the function from one word to its ids, and its added tokens (pattern, ids), which are cut out of a text first."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    to_byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
    added = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    ranks = {bytes(to_byte[c] for c in piece): i for piece, i in tokenizer.get_vocab().items() if piece not in added}
    merge = tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    # leftmost first, and the longest of those that begin at one place
    pattern = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
    return merge, pattern, added


def encode(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in a row (unsigned 32-bit) and where each text's begin, as the library gives them by default: an added token
    in a text (such as the end of text) is its own id, and what stands before and after it is worked on as a text of its own."""
    _, pattern, added = vocabulary_of(path)
    if pattern is None or not any(token in t for t in texts for token in added):
        return words(texts, path)
    parts, owner, after = [], [], []
    for k, t in enumerate(texts):
        cut = pattern.split(t)
        parts += cut[::2]
        owner += [k] * len(cut[::2])
        after += [added[x] for x in cut[1::2]] + [-1]
    ids, begin = words(parts, path)
    token = np.array(after, np.int64)
    size = np.diff(begin) + (token >= 0)
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(ends[-1], "<u4")
    inner = np.ones(len(out), bool)
    inner[ends[1:][token >= 0] - 1] = False
    out[inner] = ids
    out[~inner] = token[token >= 0]
    return out, ends[np.searchsorted(owner, np.arange(len(texts) + 1))]


def words(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """encode() for texts without added tokens."""
    cp, starts = arrays.code_points(texts)
    if not len(cp):
        return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
    s = word_starts(cp, starts)
    e = np.append(s[1:], len(cp))
    _, first, word = np.unique(arrays.Hasher(cp)(s, e), return_index=True, return_inverse=True)
    joined, merge = "".join(texts), vocabulary_of(path)[0]
    ids = [merge(joined[a:b]) for a, b in zip(s[first].tolist(), e[first].tolist(), strict=True)]
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter((x for y in ids for x in y), "<u4", lengths.sum())
    count = lengths[word]
    at = np.repeat((np.cumsum(lengths) - lengths)[word], count) + arrays.ragged(count)
    ends = np.concatenate([[0], np.cumsum(count)])
    return flat[at], ends[np.searchsorted(s, starts)]
