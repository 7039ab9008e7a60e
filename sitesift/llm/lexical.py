"""Ranked lexical search of many items at once, sharing what items have in common.

A document's score for an item is a sum over the item's terms, so items that
share terms share parts of the sum. The items of a block are mined for shared
term sets: the pair of parts that most items hold together becomes a new part,
again and again, until no pair is held by two items. The parts form a directed
graph, every part the sum of two smaller ones down to single terms, and an item
is the sum of the parts left to it. Over a batch of documents every part is one
column of partial sums, computed once from its two children and used by every
part and item above it.

At scale: items are dealt over blocks of about ``BLOCK_BYTES`` of text, and
``GROUP`` blocks share one pass over the documents' texts. That pass writes, per
document, its length and the counts of those of its words that the items use;
statistics are sums over it, and every block reads it once. Mining runs in one
task per block, and what is broadcast (a group's terms, a block's graph) is
bounded by the items' text in it. Tasks send their own best documents per item,
so an item that a third of all documents match is cut before the shuffle.

Defined cases: null text has no terms and takes no part; a document or item
without terms is no answer and has none; repeated rows and null doc_ids are
documents each (null ids last among ties); items with null text or no terms
give no rows; repeated item rows are answered once, rows that share an item_id
but not the text once each; null item_id is an item; empty tables give an
empty result; other columns are ignored. Words of any length and texts of any
length are whole.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import small_side, staged

# Terms: runs of ASCII letters and digits and of anything beyond ASCII (fixed by the contract).
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_BYTES = 1 << 20       # text of the items of a block, about (a longer item is a block's own)
BLOCK_ITEMS = 2_048         # items of a block, about
GROUP = 16                  # blocks that share a pass over the texts
PAIRED = 4_096              # parts whose pairs are counted at once, the most shared ones
BATCH_CELLS = 4 << 20       # partial sums of a batch of documents held at once


def terms(text: Column) -> Column:
    """The terms of a text in order, repeats included; A-Z alone are lower-cased."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), 0)


def parsed(items: DataFrame) -> DataFrame:
    """(item, item_id, block, term, times) of distinct items with terms; ``item`` numbers them."""
    asked = staged(items.select("item_id", "text", F.octet_length("text").alias("_size"))
                   .where(F.col("text").isNotNull()).distinct()
                   .withColumn("item", F.monotonically_increasing_id()), "lexical-items")
    n, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    blocks = max(-(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES), 1)
    return (asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
            .select("item", "item_id", "block", F.explode(terms(F.col("text"))).alias("term"))
            .groupBy("item", "item_id", "block", "term").agg(F.count(F.lit(1)).alias("times")))


def counter(shared):
    """Task function: (doc_id, n, terms, counts) of documents with terms; terms are numbers of the wanted ones."""
    find, fold = re.compile(TERM).findall, str.maketrans(UPPER, LOWER)

    def run(batches):
        wanted = shared.value
        for batch in batches:
            ids, length, at, which, count = [], [], [0], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                found = find(text.as_py() or "")
                if not found:
                    continue
                held: Counter = Counter()
                for term, n in Counter(found).items():
                    number = wanted.get(term.lower() if term.isascii() else term.translate(fold))
                    if number is not None:
                        held[number] += n
                ids.append(doc)
                length.append(len(found))
                which.extend(held.keys())
                count.extend(held.values())
                at.append(len(which))
            offsets = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(length, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(which, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(count, pa.int64()))], names=["doc_id", "n", "terms", "counts"])
    return run


def mine(holds: np.ndarray) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Shared parts of a block. ``holds``: items x places, true where the item
    has the place. Returns the pairs of parts that make part ``places + i``, and
    the parts that add up to every item. A round pairs every part with the one
    it shares most items with, most shared pairs first, no part twice."""
    pairs, parts = [], [[] for _ in range(len(holds))]
    number, made = np.arange(holds.shape[1]), holds.shape[1]
    while True:
        n = holds.sum(axis=0)
        active = np.argsort(-n, kind="stable")[:PAIRED]
        active = active[n[active] > 1]
        done = np.setdiff1d(np.arange(len(n)), active)
        for item, at in zip(*np.nonzero(holds[:, done]), strict=True):
            parts[item].append(int(number[done[at]]))
        holds, number = holds[:, active], number[active]
        if len(active) < 2:
            break
        counts = holds.astype(np.float32)
        together = np.triu(counts.T @ counts, 1)
        best = together.argmax(axis=1)
        most = together[np.arange(len(best)), best]
        used, left, right = np.zeros(len(best), bool), [], []
        for a in np.argsort(-most, kind="stable"):
            if most[a] < 2:
                break
            if not used[a] and not used[best[a]]:
                used[[a, best[a]]] = True
                left.append(a)
                right.append(best[a])
        if not left:
            break
        both = holds[:, left] & holds[:, right]
        holds[:, left] &= ~both
        holds[:, right] &= ~both
        pairs += [(int(number[a]), int(number[b])) for a, b in zip(left, right, strict=True)]
        holds = np.concatenate([holds, both], axis=1)
        number = np.concatenate([number, made + np.arange(len(left))])
        made += len(left)
    for item, at in zip(*np.nonzero(holds), strict=True):
        parts[item].append(int(number[at]))
    return pairs, parts


GRAPH = "block int, places array<int>, lefts array<int>, rights array<int>, items array<bigint>, parts array<array<int>>"


def graphs(batches):
    """Task function over (block, item, number, times) sorted by block: the graph of every block."""
    def graph(block, rows):
        item = np.concatenate([np.asarray(r.column("item")) for r in rows])
        number = np.concatenate([np.asarray(r.column("number")) for r in rows])
        times = np.concatenate([np.asarray(r.column("times")) for r in rows])
        # A term that an item has t times is its places 0 to t - 1, so items share as many as both have.
        row = np.repeat(np.arange(len(item)), times)
        place = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        items, at = np.unique(item[row], return_inverse=True)
        keys, key, freq = np.unique(np.stack([number[row], place]), axis=1, return_inverse=True, return_counts=True)
        key, shared = key.ravel(), np.argsort(-freq, kind="stable")[:(freq > 1).sum()]   # places that items share
        column = np.full(len(freq), -1)
        column[shared] = np.arange(len(shared))
        holds = np.zeros((len(items), len(shared)), bool)
        common = column[key] >= 0
        holds[at[common], column[key[common]]] = True
        pairs, parts = mine(holds)
        number_of = np.r_[shared, len(freq) + np.arange(len(pairs))].tolist()
        parts = [[number_of[p] for p in held] for held in parts]
        for i, k in zip(at[~common].tolist(), key[~common].tolist(), strict=True):
            parts[i].append(k)
        return {"block": block, "places": keys[0].tolist(), "lefts": [number_of[a] for a, _ in pairs],
                "rights": [number_of[b] for _, b in pairs], "items": items.tolist(), "parts": parts}

    block, rows = None, []
    for batch in batches:
        b = np.asarray(batch.column("block"))
        cut = np.r_[0, np.nonzero(np.diff(b))[0] + 1, len(b)]
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if hi > lo:
                if rows and b[lo] != block:
                    yield pa.RecordBatch.from_pylist([graph(block, rows)], schema=GRAPH_ARROW)
                    rows = []
                block = int(b[lo])
                rows.append(batch.slice(lo, hi - lo))
    if rows:
        yield pa.RecordBatch.from_pylist([graph(block, rows)], schema=GRAPH_ARROW)


GRAPH_ARROW = pa.schema([("block", pa.int32()), ("places", pa.list_(pa.int32())), ("lefts", pa.list_(pa.int32())),
                         ("rights", pa.list_(pa.int32())), ("items", pa.list_(pa.int64())),
                         ("parts", pa.list_(pa.list_(pa.int32())))])


def partial_sums(graph: dict, single: np.ndarray) -> np.ndarray:
    """Items x documents: every part of the graph computed once over the batch. ``single``: places x documents."""
    sums = np.zeros((len(single) + len(graph["lefts"]), single.shape[1]), np.int64)
    sums[:len(single)] = single
    for i, (a, b) in enumerate(zip(graph["lefts"], graph["rights"], strict=True)):
        np.add(sums[a], sums[b], out=sums[len(single) + i])
    return np.stack([sums[p].sum(axis=0) for p in graph["parts"]])


def best_of(item, score, null, doc, k):
    """The k best documents per item: higher score, then smaller doc_id, nulls last."""
    order = np.lexsort((doc, null, -score, item))
    item = item[order]
    keep = np.arange(len(item)) - np.searchsorted(item, item) < k
    return item[keep], score[order][keep], null[order][keep], doc[order][keep]


def scorer(shared, k: int):
    """Task function: (item, doc_id, score) of the task's k best documents per item."""
    def run(batches):
        graph, weights, total, length = shared.value
        places, items = np.asarray(graph["places"]), np.asarray(graph["items"])
        numbers, column = np.unique(places, return_inverse=True)
        rows = max(1, BATCH_CELLS // (len(places) + len(graph["lefts"]) + len(items)))
        best = tuple(np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64))
        kth = np.zeros(len(items), np.int64)
        for whole in batches:
            for lo in range(0, whole.num_rows, rows):
                batch = whole.slice(lo, rows)
                n = np.asarray(batch.column("n"))
                m = 100 - 75 + (75 * n * total) // length
                at = np.asarray(batch.column("terms").offsets)
                term = np.asarray(batch.column("terms").values)[at[0]:at[-1]]
                at = np.asarray(batch.column("counts").offsets)
                tf = np.asarray(batch.column("counts").values)[at[0]:at[-1]]
                doc = np.repeat(np.arange(len(n)), np.diff(at))
                where = np.minimum(np.searchsorted(numbers, term), len(numbers) - 1)
                held = numbers[where] == term
                term, tf, doc, where = term[held], tf[held], doc[held], where[held]
                value = np.zeros((len(numbers), len(n)), np.int64)
                value[where, doc] = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                score = partial_sums(graph, value[column])
                ids = batch.column("doc_id")
                null, ids = ~np.asarray(ids.is_valid()), np.asarray(ids.fill_null(0))
                item, col = np.nonzero((score >= kth[:, None]) & (score > 0))
                best = best_of(*(np.concatenate(z) for z in zip(best, (item, score[item, col], null[col], ids[col]),
                                                                strict=True)), k)
                last = np.nonzero(np.r_[np.diff(best[0]) != 0, True])[0] if len(best[0]) else np.zeros(0, int)
                full = last[last - np.searchsorted(best[0], best[0][last]) == k - 1]
                kth[best[0][full]] = best[1][full]
        item, score, null, doc = best
        yield pa.RecordBatch.from_arrays([pa.array(items[item]), pa.array(doc, mask=null), pa.array(score)],
                                         names=["item", "doc_id", "score"])
    return run


def ranked(documents: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item."""
    spark = documents.sparkSession
    asked = staged(parsed(items), "lexical-terms")
    names = asked.select("item", "item_id").distinct()
    path = scratch_path(spark, "lexical-best")
    made = "item long, doc_id long, score long"
    spark.createDataFrame([], made).write.parquet(f"{path}/part=-1")
    last = asked.agg(F.max("block")).first()[0]
    for first in range(0, 0 if last is None else last + 1, GROUP):
        group = asked.where(F.col("block").between(first, first + GROUP - 1))
        score_group(documents, group, k, path)
    found = spark.read.schema(made + ", part int").parquet(path)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .join(small_side(names, "lexical-names"), "item").select("item_id", "rank", "doc_id", "score"))


def score_group(documents: DataFrame, asked: DataFrame, k: int, path: str) -> None:
    """Write (item, doc_id, score) of the best documents of each task, for the items of a group of blocks."""
    spark = documents.sparkSession
    context = spark.sparkContext
    vocabulary = sorted(r["term"] for r in asked.select("term").distinct().collect())   # bounded by the group's text
    shared = context.broadcast({t: i for i, t in enumerate(vocabulary)})
    docs = staged(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
                  .mapInArrow(counter(shared), "doc_id long, n long, terms array<int>, counts array<bigint>"),
                  "lexical-documents")
    shared.unpersist()
    total, length = docs.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not total:
        return
    df = docs.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2.0 * total + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = np.zeros(len(vocabulary), np.int64)
    for row in df.select("t", weight.alias("w")).collect():
        weights[row["t"]] = row["w"]
    numbers = spark.createDataFrame(pa.table({"term": pa.array(vocabulary, pa.string()),
                                              "number": pa.array(range(len(vocabulary)), pa.int32())}))
    plans = staged(asked.join(numbers, "term").select("block", "item", "number", "times").repartition(GROUP, "block")
                   .sortWithinPartitions("block", "item", "number").mapInArrow(graphs, GRAPH), "lexical-graphs")
    for row in plans.select("block").orderBy("block").collect():
        graph = plans.where(F.col("block") == row["block"]).first().asDict()
        one = context.broadcast((graph, weights, total, length))
        (docs.mapInArrow(scorer(one, k), "item long, doc_id long, score long")
         .write.parquet(f"{path}/part={row['block']}"))
        one.unpersist()


# DuckDB SQL for the rows of the query.
SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
h AS (SELECT * FROM d WHERE len(t) > 0),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_terms FROM h),
i AS (SELECT item_id, term, count(*) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT row, doc_id, len(t) AS n, term, count(*) AS tf
      FROM (SELECT row, doc_id, t, unnest(t) AS term FROM h) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM f, c),
s AS (SELECT i.item_id, p.row, p.doc_id,
             sum(i.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 75 + ((75 * p.n * c.n_docs) // c.n_terms)))))
               ::BIGINT AS score
      FROM i JOIN p USING (term) JOIN w USING (term), c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
