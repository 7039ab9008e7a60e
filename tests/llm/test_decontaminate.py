import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitesift.llm import decontaminate as dc


@pytest.mark.parametrize("n", [5, 6, 9, 10, 13, 14, 15, 19, 20])
def test_masks_find_every_overlap(n):
    """Every choice of one word in five to replace leaves a seed."""
    items = dc.Items([(1, " ".join(f"w{i}" for i in range(n)))])
    for gone in itertools.combinations(range(n), n // 5):
        ids = np.array([-1 if i in gone else i for i in range(n)])
        assert any(len(dc.seeds(ids, m)[0]) for m in range(len(dc.MASKS))), gone
    assert items.overlaps(" ".join(f"w{i}" for i in range(n)), 0.8) == [(0, n, n, 0)]


def brute(text, items):
    words = dc.WORDS.findall((text or "").lower())
    out = {}
    for i, t in items:
        item = dc.WORDS.findall((t or "").lower())
        if not item:
            continue
        if len(item) < dc.SHORT:
            if words == item:
                out[i] = len(item)
            continue
        for s in range(-len(item), len(words)):
            same = sum(0 <= s + j < len(words) and words[s + j] == w for j, w in enumerate(item))
            if same >= dc.SIMILARITY * len(item):
                out[i] = max(same, out.get(i, 0))
    return out


def test_brute_force(spark, monkeypatch):
    r = random.Random(2)
    vocabulary = [f"v{i}" for i in range(30)]

    def some(n):
        return [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(n))) for i, n in enumerate([5, 7, 12, 20, 31, 1, 3])]
    items += [(7, None), (8, ""), (None, "Alpha, beta; gamma delta epsilon!"), (10, items[3][1]), (3, items[2][1])]
    texts = [None, "", "v1", items[5][1], items[6][1].upper(), "x ALPHA beta gamma-delta epsilon"]
    for k in range(120):
        words = [w for _, t in r.sample(items[:5], 2) for w in [*t.split(), *some(4)]]
        for _ in range(r.randint(0, 9)):
            words[r.randrange(len(words))] = r.choice(["zzz", *vocabulary])
        texts.append(" ".join(words[k % 3:]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("item_id", F.lit("x"))
    test = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t in enumerate(texts):
        for k, n in brute(t, list(enumerate(x for _, x in items))).items():
            want.add((d, items[k][0], n))
    got = [(x.doc_id, x.item_id, x.matched) for x in dc.overlaps(docs, test).collect()]
    assert set(got) == want and len(want) > 50
    clean = {x.doc_id for x in dc.clean(docs, test).collect()}
    assert clean == set(range(len(texts))) - {d for d, _, _ in want}
    monkeypatch.setattr(dc, "BLOCK_BYTES", 200)                     # many blocks of items
    assert {(x.doc_id, x.item_id, x.matched) for x in dc.overlaps(docs, test).collect()} == want
    assert {x.doc_id for x in dc.clean(docs, test).collect()} == clean


def test_edges(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert dc.clean(edge_docs, items).count() == edge_docs.count()
    assert dc.clean(edge_docs, items.limit(0)).count() == edge_docs.count()
    assert dc.overlaps(edge_docs, items.limit(0)).count() == 0
    assert dc.clean(no_docs, items).count() == 0 and dc.overlaps(no_docs, items).count() == 0
