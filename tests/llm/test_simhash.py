import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sitesift.llm import simhash
from sitesift.llm.components import components, contract


def plain(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(prints, bits=4):
    """Components by comparing all pairs."""
    f = sorted(set(prints))
    up = {x: x for x in f}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, a in enumerate(f):
        for b in f[i + 1:]:
            if (a ^ b).bit_count() <= bits:
                up[find(b)] = find(a)
    return {x: find(x) for x in f}


def test_fingerprint(monkeypatch):
    texts = ["", None, " \t", "One", "A b C d", "a  b\nc d e\x0bf G", "É é Ü x y", "x " * 3000, "a\xa0b c d e"]
    assert [simhash.fingerprint(t) for t in texts] == [plain(t) for t in texts]
    long = " ".join(f"w{i % 97}" for i in range(5000))
    monkeypatch.setattr(simhash, "CHUNK", 100)
    assert simhash.fingerprint(long) == plain(long)


def clustered(n, seed, spread):
    r = np.random.default_rng(seed)
    centres = r.integers(0, 2 ** 63, n // 20, dtype=np.uint64)
    out = centres[r.integers(0, len(centres), n)]
    for _ in range(spread):
        out ^= np.uint64(1) << r.integers(0, 64, n, dtype=np.uint64)
    return np.unique(out)


@pytest.mark.parametrize("crowd, cut", [(64, 4096), (4, 8)])
def test_components_of_all_pairs(spark, monkeypatch, crowd, cut):
    monkeypatch.setattr(simhash, "CROWDED", crowd)
    monkeypatch.setattr(simhash, "CROWD_CUT", cut)
    prints = np.unique(np.concatenate([clustered(600, 1, 3), clustered(300, 2, 1), clustered(200, 3, 5),
                                       np.uint64(7) ^ (np.uint64(1) << np.arange(40, dtype=np.uint64))]))
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(prints.view(np.int64))], "doc_id long, fingerprint long")
    got = {r.fp % 2 ** 64: r.component_id for r in simhash.classes(df).collect()}
    at = {int(x): i for i, x in enumerate(prints)}
    want, low = roots(at), {}
    for x, root in want.items():
        low[root] = min(low.get(root, 10 ** 9), at[x])
    assert got == {x: low[root] for x, root in want.items()}
    assert len(set(got.values())) < len(got)


def test_contract_and_components(spark):
    r = np.random.default_rng(4)
    a, b = r.integers(0, 3000, 2000), r.integers(0, 3000, 2000)
    chain = np.arange(5000, 5200)
    a, b = np.r_[a, chain[1:]], np.r_[b, chain[:-1]]
    up = {int(x): int(x) for x in np.r_[a, b]}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        lo, hi = sorted((find(x), find(y)))
        up[hi] = lo
    want = {x: find(x) for x in up if find(x) != x}
    node, root = contract(a, b)
    assert dict(zip(node.tolist(), root.tolist(), strict=True)) == want
    edges = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b, strict=True)], "a long, b long")
    assert {r.node: r.root for r in components(edges).collect()} == want
    assert components(edges.limit(0)).count() == 0


def test_edges(spark, edge_docs, no_docs):
    rows = simhash.near_duplicates(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    blank = {r.component_id for r in rows if r.doc_id in (2, 3, 5)}
    assert blank == {2} and all(len(r.fingerprint) == 16 for r in rows)
    assert {r.component_id for r in rows if r.fingerprint == "%016x" % plain("a b c")} == {1}
    assert simhash.near_duplicates(no_docs).count() == 0


def test_keep_one(spark, edge_docs, no_docs):
    docs = edge_docs.withColumn("fp", F.lit("mine")).withColumn("component_id", F.lit(0)).withColumn("u", F.lit(1))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(plain(r.text) for r in rows) == sorted({plain(r.text) for r in rows})
    assert {plain(r.text) for r in rows} == {plain(r.text) for r in edge_docs.collect()}
    assert [r.doc_id for r in rows if r.text == "a b c"] == [1] and [r.doc_id for r in rows if not (r.text or "").strip()] == [2]
    assert simhash.keep_one(no_docs).count() == 0
