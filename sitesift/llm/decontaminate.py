"""Benchmark decontamination by spaced-seed hashing.

Words (runs of letters, digits and underscores, lower-cased) become numbers.
Fixed masks slide over test items and documents; each keeps some of up to five
neighbouring words and ignores the rest, and equal hashes of the kept words
join a document position to a test position. Around every hit the item is laid
over the document word by word; substitutions are allowed as long as at least
``SIMILARITY`` of the item's words agree in place.

The masks find every such overlap: with at most one word in five replaced, some
four words in a row agree, or two pairs around one replaced word, or four of
five words at the ends of a short item.

At scale: the test items are hashed once and sent to the tasks in blocks of at
most ``BLOCK_BYTES`` of text, one pass over the documents a block; documents are
scanned whole where they lie and never shuffled, so passages that many
documents share cost each document its own scan only. Words foreign to the
block's items are one number that no seed keeps, so few positions are hashed.

Defined cases: null text counts as empty; empty items take no part; an item of
fewer than five words matches only a document made of just these words; equal
items are found each under its id; an item with null id or repeated id is an
item like others; the best overlap of an item is reported once per document
row; empty tables give an empty result; other columns pass through ``clean``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

SIMILARITY = 0.8
MASKS = ((0, 1, 2, 3), (0, 1, 3, 4), (0, 2, 3, 4), (0, 1, 2, 4))     # kept positions; span at most 5
SHORT = 5
BLOCK_BYTES = 16 << 20
CHUNK = 1 << 20                      # characters split into words at once
WORDS = re.compile(r"\w+")
PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def word_numbers(text: str | None, number: dict) -> np.ndarray:
    """The numbers of a text's words, -1 for words that ``number`` does not have."""
    text = text or ""
    out, at = [], 0
    while at < len(text):
        cut = min(at + CHUNK, len(text))
        while cut < len(text) and (text[cut].isalnum() or text[cut] == "_"):
            cut += 1
        out.append(np.array([number.get(w, -1) for w in WORDS.findall(text[at:cut].lower())], np.int64))
        at = cut
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def seeds(ids: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of mask ``m`` where all kept words have numbers."""
    mask = MASKS[m]
    n = len(ids) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ok = ids[mask[0]:mask[0] + n] >= 0
    for j in mask[1:]:
        ok &= ids[j:j + n] >= 0
    at = np.flatnonzero(ok)
    h = np.full(len(at), m + 1, np.uint64)
    for p, j in zip(PRIMES, mask, strict=True):
        h = (h ^ ids[at + j].astype(np.uint64)) * p
        h ^= h >> np.uint64(29)
    return at, h


class Items:
    """One block of test items, hashed."""

    def __init__(self, rows: list[tuple]):
        self.number: dict[str, int] = {}
        for _, text in rows:
            for w in WORDS.findall((text or "").lower()):
                self.number.setdefault(w, len(self.number))
        self.ids = [i for i, _ in rows]
        self.words = [word_numbers(t, self.number) for _, t in rows]
        self.short = {}
        found = []
        for i, ids in enumerate(self.words):
            if len(ids) >= SHORT:
                for m in range(len(MASKS)):
                    at, h = seeds(ids, m)
                    found.append((h, np.full(len(at), i), at))
            elif len(ids):
                self.short.setdefault(ids.tobytes(), []).append(i)
        h, item, at = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (
            np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.at = h[order], item[order], at[order]

    def overlaps(self, text: str | None, similarity: float) -> list[tuple]:
        """(item index, matching words, words of the item, first word in the text): the best overlap per item."""
        ids = word_numbers(text, self.number)
        out = {i: (len(ids), 0) for i in self.short.get(ids.tobytes(), ())} if len(ids) < SHORT else {}
        near = set()
        for m in range(len(MASKS)) if len(self.hash) else ():
            at, h = seeds(ids, m)
            lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
            hit = np.flatnonzero(hi > lo)
            for p, a, b in zip(at[hit].tolist(), lo[hit].tolist(), hi[hit].tolist(), strict=True):
                near.update(zip(self.item[a:b].tolist(), (p - self.at[a:b]).tolist(), strict=True))
        for i, start in near:
            item = self.words[i]
            lo, hi = max(start, 0), min(start + len(item), len(ids))
            same = int((ids[lo:hi] == item[lo - start:hi - start]).sum())
            if same >= similarity * len(item) and (same, -lo) > out.get(i, (0, 0)):
                out[i] = (same, -lo)
        return [(i, same, len(self.words[i]), -lo) for i, (same, lo) in sorted(out.items())]


def item_blocks(items: DataFrame) -> list:
    """Broadcast blocks of the test items (item_id, text), each of about ``BLOCK_BYTES`` at most."""
    spark = items.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-2 * size // BLOCK_BYTES) if size > BLOCK_BYTES else 1
    if n > 1:
        items = staged(items.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), "test-items")
    out = []
    for b in range(n):
        rows = (items if n == 1 else items.where(F.col("_block") == b)).orderBy("item_id", "text").collect()
        out.append(spark.sparkContext.broadcast(Items([(r["item_id"], r["text"]) for r in rows])))
    return out


def overlaps(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, matched (words in place), item_words, first_word, similarity
    for every document row and test item that overlap."""
    found = None
    for shared in item_blocks(items):
        def run(batches, shared=shared):
            test = shared.value
            for batch in batches:
                rows = [(d, test.ids[i], same, n, at, same / n) for d, t in zip(
                    batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
                    for i, same, n, at in test.overlaps(t, similarity)]
                kinds = [pa.int64()] * 5 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)],
                                                 names=["doc_id", "item_id", "matched", "item_words", "first_word",
                                                        "similarity"])
        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            run, "doc_id long, item_id long, matched long, item_words long, first_word long, similarity double")
        found = part if found is None else found.unionByName(part)
    return found


def clean(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that overlap no test item."""
    for shared in item_blocks(items):
        def run(batches, shared=shared):
            test = shared.value
            for batch in batches:
                keep = [not test.overlaps(t, similarity) for t in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))
        docs = docs.mapInArrow(run, docs.schema)
    return docs
