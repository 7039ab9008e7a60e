import math
import random
import re
from collections import Counter

import numpy as np

from sitesift.llm import lexical

ITEMS = "item_id long, text string"
DOCS = "doc_id long, text string"
PATTERN = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def words(text):
    return PATTERN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    held = [(d, words(t)) for d, t in docs]
    held = [(d, w, Counter(w)) for d, w in held if w]
    n_docs, n_terms = len(held), sum(len(w) for _, w, _ in held)
    df = Counter(t for _, _, c in held for t in c)
    out = []
    for item, text in sorted(set(items), key=repr):
        scored = []
        for d, w, tf in held:
            m = 100 - 75 + (75 * len(w) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * tf[t]) // (1000 * tf[t] + 8 * m))
                    for t in words(text) if t in tf)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(r, n):
    vocabulary = [f"W{i}x" if i % 3 else f"é{i}" for i in range(60)]
    docs = [(i, " ".join(r.choices(vocabulary, k=r.randrange(1, 60)))) for i in range(n)]
    docs += [(1000 + i, docs[0][1]) for i in range(n // 2)]                   # a third equal: ties to smaller ids
    items = [(i, " ".join(r.choices(vocabulary[:25], k=r.randrange(1, 20)))) for i in range(30)]
    return docs, items


def test_against_brute_force(spark):
    docs, items = corpus(random.Random(1), 120)
    found = lexical.ranked(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, ITEMS), 10)
    assert got(found) == brute(docs, items, 10)


def test_many_blocks_and_groups_give_the_same(spark, monkeypatch):
    docs, items = corpus(random.Random(2), 60)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 6)
    monkeypatch.setattr(lexical, "GROUP", 2)
    monkeypatch.setattr(lexical, "BATCH_CELLS", 500)
    monkeypatch.setattr(lexical, "PAIRED", 7)
    found = lexical.ranked(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), 10)
    assert got(found) == brute(docs, items, 10)


def test_odd_rows(spark, edge_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    items = [(1, "A b c, a"), (1, "A b c, a"), (1, "other"), (None, "É ü 😀"), (2, None), (3, " .,"), (4, "x x x"),
             (5, "y" * 300_000), (6, "zzz")]
    asked = spark.createDataFrame([(i, t, 0, 0) for i, t in items], "item_id long, text string, term int, n int")
    known = [(i, t) for i, t in items if t is not None]
    assert got(lexical.ranked(edge_docs.withColumnRenamed("n_chars", "n"), asked, 3)) == brute(docs, known, 3)
    assert lexical.ranked(no_docs, asked).collect() == []
    assert lexical.ranked(edge_docs, asked.where("false")).collect() == []
    assert lexical.ranked(no_docs, asked.where("false")).collect() == []


def test_shared_parts_add_up_and_save_work():
    r = random.Random(4)
    base = [r.random() < 0.5 for _ in range(80)]
    holds = np.array([[b if r.random() < 0.8 else r.random() < 0.3 for b in base] for _ in range(64)])
    pairs, parts = lexical.mine(holds)
    made = [{i} for i in range(80)]
    for a, b in pairs:
        assert not made[a] & made[b]
        made.append(made[a] | made[b])
    for row, held in zip(holds, parts):
        assert sorted(x for p in held for x in made[p]) == np.nonzero(row)[0].tolist()
    assert len(pairs) + sum(len(p) for p in parts) < 0.6 * holds.sum()
    assert lexical.mine(holds) == (pairs, parts)
