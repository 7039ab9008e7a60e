import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitesift.llm import suffixes


def covered(rows, least):
    """{row index: spans} by looking up every window of ``least`` words."""
    where = defaultdict(set)
    for k, (_, w) in enumerate(rows):
        for i in range(len(w) - least + 1):
            where[tuple(w[i:i + least])].add(k)
    out = {}
    for k, (_, w) in enumerate(rows):
        spans = []
        for i in range(len(w) - least + 1):
            if len(where[tuple(w[i:i + least])]) > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], i + least)
                else:
                    spans.append((i, i + least))
        if spans:
            out[k] = spans
    return out


def corpus(words):
    r = random.Random(3)

    def some(n):
        return [r.choice(words) for _ in range(n)]
    passages = [some(n) for n in (49, 50, 51, 70, 130)]
    texts = []
    for _ in range(120):
        t = some(r.randint(0, 60))
        for p in r.sample(passages, 2):
            t += p[r.choice([0, 0, 1, 5]):] + some(r.randint(0, 30))
        texts.append(t)
    texts += [some(20) + passages[0] + some(9) for _ in range(6)] + [passages[4]] * 3 + [some(300) for _ in range(20)]
    texts += [["x"] * 200, ["a"] + ["x"] * 120 + ["b"], ["p", "q"] * 70, ["q", "p"] * 40]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("crowded", [32, 5])
def test_every_passage_is_found(spark, words, monkeypatch, crowded):
    monkeypatch.setattr(suffixes, "CROWDED", crowded)
    rows = corpus(words)
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in rows], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in suffixes.repeats(df).collect()}
    want = covered(rows, suffixes.LEAST)
    assert {d: [(x.start, x.end) for x in r.spans] for d, r in got.items()} == want
    # What is cut stands in a smaller document; nearly all that does is cut.
    first = {}
    for d, t in rows:
        for i in range(len(t) - suffixes.LEAST + 1):
            first.setdefault(tuple(t[i:i + suffixes.LEAST]), d)
    missed = total = 0
    for d, t in rows:
        cut = {i for x in (got[d].cut if d in got else ()) for i in range(x.start, x.end)}
        may = {j for i in range(len(t) - suffixes.LEAST + 1) if first[tuple(t[i:i + suffixes.LEAST])] != d
               for j in range(i, i + suffixes.LEAST)}
        if [t for _, t in rows].count(t) == 1:           # documents are compared by doc_id, then text hash
            assert cut <= may, d
        missed, total = missed + len(may - cut), total + len(may)
    assert missed <= 0.02 * total and total > 5000


def near_copies(words, share):
    """12 copies of a text with a share of the words replaced, beside one unlike them."""
    r = random.Random(11)
    rows = []
    for _ in range(25):
        text = [r.choice(words) for _ in range(400)]
        rows += [[w if r.random() > share else f"{w}x{r.random()}" for w in text] for _ in range(12)]
    return list(enumerate([*rows, [r.choice(words) for _ in range(200)]]))


@pytest.mark.parametrize("crowded", [32, 5])
def test_edited_near_copies_lose_no_word(spark, words, monkeypatch, crowded):
    monkeypatch.setattr(suffixes, "CROWDED", crowded)
    rows = near_copies(words, 0.015)
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in rows], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in suffixes.repeats(df).collect()}
    assert {d: [(x.start, x.end) for x in r.spans] for d, r in got.items()} == covered(rows, suffixes.LEAST)
    first, may = {}, {}
    for d, t in rows:
        for i in range(len(t) - suffixes.LEAST + 1):
            if first.setdefault(tuple(t[i:i + suffixes.LEAST]), d) != d:
                may.setdefault(d, set()).update(range(i, i + suffixes.LEAST))
    assert {d: {i for x in r.cut for i in range(x.start, x.end)} for d, r in got.items() if r.cut} == may


def test_a_longer_match_beside_neither_neighbour():
    # T, A (all of the right), B (20 on the left), C (15 on each side); neighbours of T in either order are A and B.
    right = [[*range(1, 31)], [*range(1, 31)], [5000] * 30, [*range(1, 16), *[4000] * 15]]
    left = [[*range(101, 131)], [9000] * 30, [*range(101, 121), *[6000] * 10], [*range(101, 116), *[7000] * 15]]
    n = len(left)
    i, start, end, _ = suffixes.compare(np.zeros(n, np.int64), np.arange(n), np.arange(n), np.full(n, 100, np.int32),
                                        np.array(left, np.uint32), np.array(right, np.uint32))
    assert min(start[i == 0]) == 85 and max(end[i == 0]) == 150


def test_edges(spark, edge_docs, no_docs):
    docs = edge_docs.withColumn("th", F.lit("mine")).withColumn("key", F.lit(1)).withColumn("at", F.lit(1))
    assert suffixes.repeats(docs).count() == 0            # only short texts and repeats within one document
    assert suffixes.repeats(no_docs).count() == 0
    twice = edge_docs.unionByName(edge_docs.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    rows = {r.doc_id: r for r in suffixes.repeats(twice).collect()}
    assert rows.keys() == {4, None} and not rows[4].cut and len(rows[None].cut) == 1
    assert [(x.start, x.end) for x in rows[4].spans] == [(0, 60_000)]


def test_words_in_chunks(monkeypatch):
    text = ("ab  cde\tf\n" * 50).encode()
    whole = suffixes.word_hashes(text)
    monkeypatch.setattr(suffixes, "CHUNK", 7)
    assert (suffixes.word_hashes(text) == whole).all() and len(whole) == 150


def test_many_spans_of_one_text_are_joined(spark):
    """40,000 passages of a text, some touching, some inside others, in time that grows with them."""
    spans = [(1, 10 * i, 10 * i + 5 + 5 * (i % 3 == 0) + 12 * (i % 7 == 0), i % 5 == 0) for i in range(40_000)]
    found = spark.createDataFrame(spans * 2, "th long, start int, end int, kept boolean").repartition(4)

    def joined(rows):
        out = []
        for a, b in sorted(rows):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out
    got, = suffixes.merged(found).collect()
    assert [tuple(x) for x in got.spans] == joined((a, b) for _, a, b, _ in spans)
    assert [tuple(x) for x in got.cut] == joined((a, b) for _, a, b, kept in spans if not kept)
