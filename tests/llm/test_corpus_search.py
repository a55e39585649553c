"""Manifest, exact search and collocations against plain versions on small tables."""

import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from strandflow.llm import collocations, manifest, vector_search
from strandflow.llm.oracles import ORACLES
from strandflow.llm.queries import queries

DATA = "/root/testdata/sf0.001"
EXTRA = ["tree", "pos", "node", "claim", "block", "part", "at", "witness", "root", "print", "n", "phrase", "offset", "w", "k", "v", "query", "class_id", "ids", "f", "l", "r", "a"]
KIND = "doc_id long, text string, lang string, source string, n_chars long"


def extra(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(f"extra {c}") for c in EXTRA})


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes):
    """Root, and each leaf's siblings level by level."""
    proofs, below = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, held = [], []
        for i in range(0, len(nodes), 16):
            run = nodes[i : i + 16]
            for j in range(len(run)):
                for leaf in below[i + j]:
                    proofs[leaf].append((j, run[:j] + run[j + 1 :]))
            up.append(sha("".join(run)))
            held.append([x for b in below[i : i + 16] for x in b])
        nodes, below = up, held
    return nodes[0], proofs


def fold(leaf, proof):
    for j, siblings in proof:
        leaf = sha("".join(siblings[:j]) + leaf + "".join(siblings[j:]))
    return leaf


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[s] = plain_tree([plain_leaf(r) for r in by[s]])
    root, tops = plain_tree([trees[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for r, p in zip(by[s], trees[s][1], strict=True):
            proof = p + tops[k]
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            seen = (*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4])) if bad else r
            got = fold(plain_leaf(seen), proof)
            out.append((r[0], plain_leaf(r), trees[s][0], root, sha("".join(x for _, sib in proof for x in sib)), got, got == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16, "b": 17, None: 3, "": 2}, {"é": 300, "zz": 4097, "b": 256}])
def test_manifest(spark, sizes):
    rows, i = [(None, "a", None, None, "X Y"), (None, "a", None, 3, None), (7, "a", "en", 0, ""), (7, "a", "en", 0, ""), (8, "a", "en", 9, "É Word 日本 " * 9_000)], 10
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, s, "de", i, f"Text Number {i}"))
            i += 1
    df = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3]) for r in rows], KIND)
    got = sorted(map(tuple, manifest.manifest_report(extra(df)).collect()), key=str)
    assert got == plain_manifest(rows)
    assert {g[-1] for g in got} == {True, False} or len(got) < 10


def test_manifest_of_one_row_and_none(spark):
    df = spark.createDataFrame([(5, "A", "en", "s", 1)], KIND)
    row = manifest.manifest_report(df).first()
    assert row.leaf == row.subroot == row.root == plain_leaf((5, "s", "en", 1, "A"))
    assert row.proof_sha256 == sha("")
    assert manifest.manifest_report(df.limit(0)).count() == 0


def test_manifest_extended_equals_built(spark):
    rows = [(i, f"T{i}", "en", "ab"[i % 2] if i < 700 else "abc"[i % 3], i) for i in range(1200)]
    first, second, whole = (spark.createDataFrame(x, KIND) for x in (rows[:700], rows[700:], rows))
    want = manifest.witnesses(manifest.built(whole)).select("doc_id", "node", "witness", "subroot", "root").collect()
    got = manifest.witnesses(manifest.extended(manifest.built(first), second)).select("doc_id", "node", "witness", "subroot", "root").collect()
    assert sorted(got) == sorted(want)
    assert len({r.root for r in got}) == 1


def plain_top(rows, k, step):
    rows = list(dict.fromkeys((i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)))
    whole = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows]
    out = []
    for q, x in whole:
        if q % step == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), i) for i, y in whole if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def f32(rng, n, width, scale=0.2):
    return [[float(np.float32(x)) for x in rng.normal(0, scale, width)] for _ in range(n)]


@pytest.mark.parametrize("case", ["random", "copies", "clusters", "odd", "large"])
def test_search(spark, case, monkeypatch):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    monkeypatch.setattr(vector_search, "BLOCK", 64)
    monkeypatch.setattr(vector_search, "SHARE", 2)
    monkeypatch.setattr(vector_search, "QUERIES", 16)
    v = f32(rng, 900, 12)
    if case == "copies":
        v = [v[i % 7] if i % 3 else v[i] for i in range(900)]
    if case == "clusters":
        v = [[a + b / 50 for a, b in zip(v[i % 5], v[i], strict=True)] for i in range(900)]
    if case == "large":
        v = [[x * 1e5 for x in y] for y in v]
    v = [[float(np.float32(x)) for x in y] for y in v]
    rows = [(i - 20, y) for i, y in enumerate(v)]
    if case == "odd":
        rows += [(None, v[0]), (2000, None), (2001, [None] * 12), (2002, [float("nan")] * 12), (2003, [float("inf")] + v[0][1:]), (2004, []), (2005, v[0][:3]), (2006, v[1] + v[2]), (40, rows[60][1]), (40, rows[60][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vector_search.top_k(extra(df), F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, got.collect())) == plain_top(rows, 5, 20)
    assert vector_search.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = vector_search.top_k(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, few.collect())) == plain_top([r for r in rows if r[0] in (0, 1, 2)], 5, 20)


def plain_collocations(rows, least, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang, text = lang or "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    held = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = {(la, w[i:j]) for (la, w), a in held.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w) and held.get((la, w[i:j]), 10**9) <= a}
    out = []
    for (la, w), a in held.items():
        if (la, w) not in gone:
            s, k = min((Fraction(1000 * a * n[la], f[la, w[:k]] * f[la, w[k:]]).__floor__(), k) for k in range(1, len(w)))
            out.append((la, -s, -a, " ".join(w).encode(), f[la, w[:k]], f[la, w[k:]], n[la]))
    ranked = []
    for la in {x[0] for x in out}:
        ranked += [(la, r + 1, p.decode(), -a, left, right, m, -s) for r, (_, s, a, p, left, right, m) in enumerate(sorted(x for x in out if x[0] == la)[:top])]
    return sorted(ranked)


def texts(rng, n):
    words = ["red", "Blue", "sky", "é", "日本", "of", "the", "sea", "a", "q"]
    ends = [" ", " ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "!? "]
    return ["".join(words[int(abs(rng.normal(0, 3))) % 10] + ends[rng.integers(len(ends))] for _ in range(rng.integers(0, 60))) + "deep blue sea today. " * int(rng.integers(0, 2)) for _ in range(n)]


def test_collocations(spark):
    rng = np.random.default_rng(3)
    rows = [(t, ["en", "de", None, "und"][i % 4]) for i, t in enumerate(texts(rng, 300))]
    rows += [(None, "en"), ("", "en"), ("the sea " * 20_000, "fr"), ("?!", None)] + rows[:20]
    df = spark.createDataFrame([(i if i % 9 else None, t, la, "s", 1) for i, (t, la) in enumerate(rows)], KIND)
    found = collocations.collocations(extra(df.repartition(3)), least=8, top=40)
    got = found.collect()
    assert sorted(tuple(r)[:8] for r in got) == plain_collocations(rows, 8, 40)
    assert collocations.collocations(df.limit(0)).count() == 0


def test_ledger_tells_phrases_with_one_fingerprint_apart():
    """Where all fingerprints and word hashes are equal, the text alone must decide."""
    rng = np.random.default_rng(4)
    ledger, want, total = collocations.Ledger(), Counter(), 0
    for _ in range(3):
        some = texts(rng, 20)
        words = collocations.Words(some, ["en"] * len(some))
        words.hash = words.hash % np.uint64(3)
        words.prints = lambda first, n: np.full(len(first), n % 2, np.uint64)
        picked = [(words.grams(n), n) for n in (1, 2, 3)]
        ledger.add(words, np.arange(len(some)), np.array(["en"] * len(some), object), picked)
        for t in some:
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), t)):
                w = re.findall(r"[^\x20\x09]+", piece)
                for m in (1, 2, 3):
                    want.update(" ".join(w[i : i + m]) for i in range(len(w) - m + 1))
        total += len(some)
    got = Counter()
    for r in ledger.batch().to_pylist():
        got[r["phrase"]] += r["n"]
    assert got == want
    assert total == 60


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_corpus_sql(spark, name):
    from test_queries import plain

    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got, want = queries()[name](spark, DATA).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
    assert len(got) > 0 or name == "op13_collocations"
