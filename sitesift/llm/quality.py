"""Quality classifier on supervised subword embeddings.

A document is the average of learned vectors of its hashed words, word pairs
and character n-grams; a softmax layer turns the average into a score. Vectors
and layer are trained together by stochastic gradient descent in numpy, on a
bounded sample of labelled documents (``SAMPLE`` per class, texts of at most
``SAMPLE_BYTES``; both are parameters). Since scoring is linear in the average,
the trained vectors are folded into one number per hash bucket (``1 <<
BUCKET_BITS`` floats), which is what the tasks receive.

At scale: scoring is one narrow pass over whole texts in Arrow batches; nothing
is shuffled. Hashing is vectorised over the bytes of many texts at once, in
blocks of at most ``BLOCK`` bytes, so memory is bounded for texts of any length
(a longer text is cut after white space, and its sums are added up; only word
pairs across a cut do not count). Training
sees the same number of rows whatever the input.

Features: words are runs of other than space and ASCII 9 to 13, taken with one
boundary byte on each side; n-grams of ``GRAMS`` bytes lie within that. A word
pair that repeats one word has a bucket of its own.

Defined cases: null text counts as empty; a text without words scores by the
softmax bias alone; without labels of both classes the score is 0.5 everywhere
(so nothing is rejected); a doc_id labelled several times counts each time; null
labels and ids are not learned from; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, SAMPLE_BYTES = 1000, 200_000
BUCKET_BITS = 18
GRAMS = (3, 4, 5)
DIM, EPOCHS, RATE = 16, 4, 0.3
BLOCK = 1 << 20
THRESHOLD = 0.3
SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
MULT, MIX = np.uint32(0x01000193), np.uint32(2654435761)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(15))
    return (h * MIX) >> np.uint32(32 - BUCKET_BITS)


def features(block: np.ndarray, start: np.ndarray):
    """Yield (position, bucket) arrays for the features of a byte block that
    begins and ends with white space; positions ascend within each array.
    ``start`` has the first position of each piece; no pair crosses pieces."""
    space = SPACES[block]
    raw = np.where(space, np.uint8(32), block).astype(np.uint32)
    for n in GRAMS:
        if len(raw) < n:
            continue
        m = len(raw) - n + 1
        h = np.full(m, n, np.uint32)
        inner = np.zeros(m, bool)
        for j in range(n):
            h = (h * MULT) ^ raw[j:j + m]
            if 0 < j < n - 1:
                inner |= space[j:j + m]
        at = np.flatnonzero(~inner)
        yield at, _bucket(h[at])
    begin = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if len(begin):
        end = np.flatnonzero(~space[:-1] & space[1:]) + 1
        where = np.arange(len(raw), dtype=np.uint32)
        word = np.zeros(len(raw), np.uint32)
        word[~space] = (raw[~space] + np.uint32(7)) * MIX
        place = where - np.repeat(begin, np.diff(np.r_[begin, len(raw)])).astype(np.uint32) if begin[0] == 0 else \
            where - np.r_[np.zeros(begin[0], np.uint32),
                          np.repeat(begin, np.diff(np.r_[begin, len(raw)])).astype(np.uint32)]
        spread = (place * np.uint32(0x9E3779B1) + np.uint32(1)) | np.uint32(1)
        words = np.add.reduceat(word * spread, begin, dtype=np.uint32)
        words ^= (end - begin).astype(np.uint32) * MULT
        yield begin, _bucket(words)
        pair = np.where(words[1:] == words[:-1], np.uint32(1), words[:-1] * MULT ^ words[1:])
        piece = np.searchsorted(start, begin, "right")
        same = piece[1:] == piece[:-1]
        yield begin[1:][same], _bucket((pair * MULT + np.uint32(3))[same])


def blocks(texts: list[bytes | None]):
    """Yield (byte block, first position of each piece, its document): texts
    joined by spaces; those longer than a block are cut after white space."""
    pieces, docs, size = [], [], 0
    for d, text in enumerate(texts):
        text = text or b""
        at = 0
        while True:
            cut = len(text)
            if cut - at > BLOCK:
                near = text.rfind(b" ", at, at + BLOCK)
                cut = near + 1 if near > at else at + BLOCK
            if size and size + cut - at > BLOCK:
                yield _join(pieces, docs)
                pieces, docs, size = [], [], 0
            pieces.append(text[at:cut])
            docs.append(d)
            size += cut - at + 1
            at = cut
            if at >= len(text):
                break
    if pieces:
        yield _join(pieces, docs)


def _join(pieces: list[bytes], docs: list[int]):
    block = np.frombuffer(b" " + b" ".join(pieces) + b" ", np.uint8)
    start = np.cumsum([0] + [len(p) + 1 for p in pieces[:-1]])
    return block, start, np.array(docs)


def averages(texts: list[bytes | None], value: np.ndarray) -> np.ndarray:
    """The average of ``value`` over the features of each text (0 if it has none)."""
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for block, start, docs in blocks(texts):
        for at, bucket in features(block, start):
            cut = np.searchsorted(at, np.r_[start, len(block)])
            sums = np.concatenate([[0.0], np.cumsum(value[bucket], dtype=np.float64)])
            np.add.at(total, docs, sums[cut[1:]] - sums[cut[:-1]])
            np.add.at(count, docs, np.diff(cut))
    return total / np.maximum(count, 1)


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    found = [bucket for block, start, _ in blocks([text]) for _, bucket in features(block, start)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0)
    bucket, n = np.unique(np.concatenate(found), return_counts=True)
    return bucket.astype(np.int64), n / n.sum()


def train(texts: list[bytes], labels: list[int], seed: int = 7) -> tuple[np.ndarray, float]:
    """(value per bucket, bias): the log-odds of label 1 are the average value plus the bias."""
    rng = np.random.default_rng(seed)
    size = 1 << BUCKET_BITS
    vectors = rng.normal(0, 1 / DIM, (size, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    seen, seen_layer = np.full(size, 1e-8, np.float32), np.full((DIM, 2), 1e-8, np.float32)
    bags = [bag(t) for t in texts]
    target = np.eye(2, dtype=np.float32)[np.asarray(labels)]
    layer += rng.normal(0, 0.1, layer.shape)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(bags)):
            bucket, share = bags[i]
            share = share.astype(np.float32)
            hidden = share @ vectors[bucket]
            out = hidden @ layer + bias
            p = np.exp(out - out.max())
            g = p / p.sum() - target[i]
            back = layer @ g
            step = np.outer(hidden, g)
            seen_layer += step ** 2
            layer -= rate * step / np.sqrt(seen_layer)
            bias -= 0.02 * rate * g
            seen[bucket] += (share ** 2) * float(back @ back) / DIM     # a rate for each bucket
            vectors[bucket] -= np.outer(rate * share / np.sqrt(seen[bucket]), back)
    away = layer[:, 1] - layer[:, 0]
    return (vectors @ away).astype(np.float32), float(bias[1] - bias[0])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn_rows(docs: DataFrame, labels: DataFrame, label: str, sample: tuple[int, int],
               sample_bytes: int) -> list:
    """(text as bytes, label) of at most ``sample[y]`` labelled training documents
    of class y, the smallest hashes of doc_id; held-out ids are never among them."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_y"))
    known = known.where(F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    picked = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample[y]) for y in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))                      # at most sum(sample) rows
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
            .join(ids, F.col("doc_id") == F.col("_id")).where(F.octet_length("text") <= sample_bytes)
            .orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sum(sample)).select("text", "_y").collect())
    return [(bytes(r["text"] or b""), r["_y"]) for r in rows]


def score(docs: DataFrame, model: tuple[np.ndarray, float], name: str = "score") -> DataFrame:
    """``docs`` with a double column ``name``, the probability of label 1."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(text: pd.Series) -> pd.Series:
        value, bias = shared.value
        odds = averages(text.tolist(), value) + bias
        return pd.Series(1 / (1 + np.exp(-np.clip(odds, -30, 30))))

    return docs.withColumn(name, probability(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE,
        sample_bytes: int = SAMPLE_BYTES) -> tuple[np.ndarray, float]:
    rows = learn_rows(docs, labels, label, (sample, sample), sample_bytes)
    if len({y for _, y in rows}) < 2:
        return np.zeros(1 << BUCKET_BITS, np.float32), 0.0
    return train([t for t, _ in rows], [y for _, y in rows])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts."""
    scored = score(docs, fit(docs, labels), "_quality")
    return scored.where(F.col("_quality") >= threshold).drop("_quality")
