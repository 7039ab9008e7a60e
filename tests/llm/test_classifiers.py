import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitesift.llm import quality, toxicity
from tests.conftest import SF01


def auc(score, label):
    s, y = np.asarray(score), np.asarray(label)
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    for v in np.unique(s):
        rank[s == v] = rank[s == v].mean()
    return (rank[y == 1].mean() - ((y == 1).sum() - 1) / 2) / (y == 0).sum()


# The smaller tables label some 30 toxic documents, too few to know the words of four languages. Junk
# (quality 0) keeps the toxic label of the text it was made from, whose words are gone: it can't tell.
@pytest.mark.parametrize("module, label, least, sf", [(quality, "quality", 0.95, SF01),
                                                      (toxicity, "toxic", 0.95, "/root/testdata/sf0.1")])
def test_held_out_accuracy(spark, module, label, least, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = module.classify(docs, labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got["doc_id"]]).all()
    assert (got["predicted"] == (got["score"] >= module.THRESHOLD)).all()
    both = got.merge(labels.toPandas(), on="doc_id")
    both = both[both["held_out"] & ((both["quality"] == 1) | (label == "quality"))]
    assert auc(both["score"], both[label]) >= least


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_never_learns_from_held_out_rows(spark, module, label):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn(label, F.when(quality.held_out(F.col("doc_id")), 1 - F.col(label)).otherwise(F.col(label)))
    rows = [quality.learn_rows(docs, x, label, (50, 50), 10 ** 5) for x in (labels, flipped)]
    assert rows[0] == rows[1] and len(rows[0]) <= 100 and {y for _, y in rows[0]} == {0, 1}


@pytest.mark.parametrize("module", [quality, toxicity])
def test_edges(spark, edge_docs, no_docs, module):
    labels = spark.createDataFrame([(1, 1, 1), (4, 0, 0), (5, None, 1), (None, 1, 0), (1, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    docs = edge_docs.withColumn("score", F.lit("x")).withColumn("_y", F.lit(1))
    rows = module.classify(docs, labels).collect()
    assert len(rows) == edge_docs.count() and all(r.score is not None and 0 <= r.score <= 1 for r in rows)
    assert module.classify(no_docs, labels).count() == 0
    assert {r.score for r in module.classify(docs, labels.limit(0)).collect()} <= {0.0, 0.5}


def plain_average(text, value):
    """The features of a text one by one."""
    total, count = 0.0, 0
    for block, start, _ in quality.blocks([text]):
        for _, bucket in quality.features(block, start):
            total, count = total + value[bucket].sum(dtype=float), count + len(bucket)
    return total / max(count, 1)


def test_averages_do_not_depend_on_batches(monkeypatch):
    value = np.random.default_rng(1).normal(size=1 << quality.BUCKET_BITS)
    texts = [b"", None, b" a ", "é ü xx xx xx".encode(), b"one two  three\n" * 40, b"z" * 500, b"a"]
    whole = quality.averages(texts, value)
    assert np.allclose(whole, [plain_average(t, value) for t in texts])
    monkeypatch.setattr(quality, "BLOCK", 64)              # texts cut into pieces
    cut = quality.averages(texts, value)
    short = [0, 1, 2, 3, 6]                                # (these are not)
    assert np.allclose(whole[short], cut[short]) and np.isfinite(cut).all()


def test_repeated_word_pair_has_one_bucket():
    def pairs(text):
        return [bucket for block, start, _ in quality.blocks([text]) for _, bucket in quality.features(block, start)][-1]
    assert set(pairs(b"ab ab ab")) == set(pairs(b"cd cd")) and len(set(pairs(b"ab cd ab"))) == 2


def test_windows_cover_the_text():
    for text in (b"", b"One, two; THREE 4 five.", b"x" * 100, b"a " * 100, "été ño".encode()):
        joined = b"".join(w[len(toxicity.MARK):] for w in toxicity.windows(text))
        assert joined.replace(b" ", b"") == b"".join(text.translate(toxicity.TABLE).split())
        assert all(len(w) <= toxicity.WINDOW + 2 + len(toxicity.MARK) for w in toxicity.windows(text))


def test_toxic_words_are_told_apart():
    r = np.random.default_rng(0)
    words = [bytes(r.integers(97, 123, 6, dtype=np.uint8)) for _ in range(500)]

    def text(bad):
        out = [words[i] for i in r.integers(0, 500, 60)]
        for at in range(0, 60, 12) if bad else ():
            out[at] = [b"wretched", b"villain", b"nitwit"][at % 3]
        return b" ".join(out)
    model = toxicity.train([text(True) for _ in range(60)], [text(False) for _ in range(120)])
    toxic, ordinary, least, half = model
    score = [toxicity.excess(s, least) for s in toxicity.savings([text(i < 40) for i in range(80)], toxic, ordinary)]
    assert all(x >= half for x in score[:40]) and all(x < half for x in score[40:])
    assert toxicity.train([], [b"a"]) is None
