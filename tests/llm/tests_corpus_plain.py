"""Plain versions of operators for the tests."""

import re

from strandflow.llm import toxicity


def linked_sets(texts, words, percent):
    """Component by text number: all pairs that share a shingle, on plain sets."""
    sets, where, comp = [], {}, list(range(len(texts)))
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)})
        for x in sets[-1]:
            where.setdefault(x, []).append(i)

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, x in enumerate(sets):
        shared = {}
        for g in x:
            for j in where[g]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, both in shared.items():
            if 100 * both >= percent * (len(x) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    return [root(i) for i in range(len(texts))]


def plain_features(text):
    """Coordinates of a text, each worked out on its own."""
    import numpy as np

    from strandflow.llm import arrays

    words = re.findall(r"[^\W_]+", text.lower())
    cps = np.array([ord(c) for w in words for c in w], np.uint32)
    ends = np.cumsum([len(w) for w in words])
    h = arrays.Hasher(cps)
    key = lambda a, b: h(np.array([a]), np.array([b]))
    coordinate = lambda x: max(int(x[0]) >> (64 - toxicity.BITS), 1)
    out, spans = {0}, [(int(e) - len(w), int(e)) for w, e in zip(words, ends, strict=True)]
    for k, (a, b) in enumerate(spans):
        out.add(coordinate(key(a, b)))
        if b - a > 5:
            out.add(coordinate(arrays.mix(key(a, a + 5) + np.uint64(5))))
        for gap, salt in ((1, 0x51ED27), (2, 0xA3C59AC3)):
            if k + gap < len(spans):
                out.add(coordinate(arrays.mix(key(a, b) * np.uint64(3) + key(*spans[k + gap]) + np.uint64(salt))))
    return sorted(out)


def plain_ftrl(samples, passes):
    """FTRL-proximal, a coordinate at a time."""
    import numpy as np

    z, n = {}, {}

    def weight(i):
        l1 = toxicity.L1 if i else 0
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1)) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for k in range(passes):
        for j in np.random.default_rng(k).permutation(len(samples)):
            at, label = samples[j]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - label
            for i in at:
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / toxicity.ALPHA
                z[i], n[i] = z.get(i, 0.0) + g - sigma * w[i], n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z if weight(i)}
