"""Exact top-k inner-product search by distributed histogram selection.

Every pass scores all candidates against a block of queries. Each task counts
scores per query into 256 bins of the query's current interval, and keeps only
the bins from its own kth score upward (the global kth value cannot lie below
any task's kth score), so a task reports at most k bins a query. Summed over
all tasks, the counts locate the bin that holds the kth value; the next pass
splits that bin, until it is one integer wide. A last pass keeps scores at or
above the kth value, and ties go to smaller vec_id.

Scores are integers. They are computed by float64 matrix products, which are
exact while every partial sum is below 2**53 (checked from the norms); beyond
that int64 products are used, exact below 2**63.

At scale: candidates are read where they lie and never shuffled. Queries go out
in blocks of at most ``BLOCK`` rows, so what is broadcast has a fixed bound; each
task sends at most k bins and k rows a query. Vectors held by many rows cost no
more than others.

Defined cases: vectors that are null or hold null, NaN or infinite components
take no part, nor do rows with null vec_id; shorter vectors are padded with
zeros; a query's own row is every candidate with its vec_id; a vec_id that
repeats among candidates is a candidate each time; equal query rows are asked
once, query rows that differ in their vectors alone each get an answer; queries with fewer than k candidates return all; empty tables give an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

BINS = 256
BLOCK = 4096           # queries broadcast at once
TILE = 1024            # queries scored at once against one batch
EXACT = 2 ** 53


def quantize(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v array<bigint>): floor(scale * x) of every component."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return (vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad)
            .select(F.col("vec_id").cast("long").alias("vec_id"),
                    F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v")))


def matrix(column: pa.ChunkedArray | pa.Array, width: int, dtype) -> np.ndarray:
    """Rows of a list column as a matrix, padded with zeros or cut to ``width``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at, flat = np.asarray(column.offsets), np.asarray(column.values)
    size = np.diff(at)
    if len(size) and (size == width).all():
        return flat[at[0]:at[-1]].reshape(len(size), width).astype(dtype)
    out = np.zeros((len(size), width), dtype)
    row = np.repeat(np.arange(len(size)), size)
    col = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    keep = col < width
    out[row[keep], col[keep]] = flat[at[0]:at[-1]][keep]
    return out


def tiles(batch: pa.RecordBatch, ids: np.ndarray, q: np.ndarray):
    """(first query, vec_ids, scores, own) for tiles of queries against a batch."""
    vec = np.asarray(batch.column("vec_id"))
    c = matrix(batch.column("v"), q.shape[1], q.dtype).T
    for lo in range(0, len(ids), TILE):
        yield lo, vec, (q[lo:lo + TILE] @ c), ids[lo:lo + TILE, None] == vec[None, :]


def histograms(shared, k: int):
    """Task function: (query, bin, n) of the bins at or above the task's kth score."""
    def run(batches):
        ids, q, lo, span, step = shared.value
        counts = np.zeros((len(ids), BINS), np.int64)
        for batch in batches:
            for at, _, scores, own in tiles(batch, ids, q):
                n = len(scores)
                over = scores.astype(np.int64) - lo[at:at + n, None]
                ok = (over >= 0) & (over < span[at:at + n, None]) & ~own   # above it: counted before
                row, col = np.nonzero(ok)
                flat = row * BINS + over[row, col] // step[at + row]
                counts[at:at + n] += np.bincount(flat, minlength=n * BINS).reshape(n, BINS)
        above = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
        row, col = np.nonzero((counts > 0) & (above < k))
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)),
                                          pa.array(counts[row, col])], names=["q", "bin", "n"])
    return run


def winners(shared, k: int):
    """Task function: the task's k best (score, then smaller vec_id) at or above each kth value."""
    def run(batches):
        ids, q, kth = shared.value
        best: dict[int, list] = {}
        for batch in batches:
            for at, vec, scores, own in tiles(batch, ids, q):
                scores = scores.astype(np.int64)
                row, col = np.nonzero((scores >= kth[at:at + len(scores), None]) & ~own)
                order = np.lexsort((vec[col], -scores[row, col], row))
                row, col = row[order], col[order]
                first = np.searchsorted(row, row)
                keep = np.arange(len(row)) - first < k
                for r, i, s in zip((row[keep] + at).tolist(), vec[col[keep]].tolist(),
                                   scores[row[keep], col[keep]].tolist(), strict=True):
                    best.setdefault(r, []).append((-s, i))
                for r in set((row[keep] + at).tolist()):
                    best[r] = sorted(best[r])[:k]
        out = [(int(ids[r]), i, -s, r) for r, found in best.items() for s, i in found]
        yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], pa.int64()) for j in range(4)],
                                         names=["query_id", "vec_id", "score", "_q"])
    return run


def search_block(block: list, candidates: DataFrame, k: int, longest: float, width: int) -> DataFrame:
    spark = candidates.sparkSession
    ids = np.array([r["vec_id"] for r in block], np.int64)
    exact = np.zeros((len(block), width), np.int64)
    for i, r in enumerate(block):
        exact[i, :len(r["v"])] = r["v"][:width]
    norms = np.sqrt((exact.astype(float) ** 2).sum(axis=1))
    reach = np.floor(norms * longest).astype(np.int64) + 2 if norms.max() * longest < 2 ** 61 \
        else np.full(len(block), 2 ** 62)
    q = exact.astype(np.float64) if norms.max() * longest < EXACT else exact
    lo, span, need = -reach, 2 * reach + 1, np.full(len(block), k, np.int64)
    while (span > 1).any():
        step = -(-span // BINS)
        shared = spark.sparkContext.broadcast((ids, q, lo, span, step))
        found = (candidates.mapInArrow(histograms(shared, k), "q int, bin int, n long")
                 .groupBy("q", "bin").agg(F.sum("n").alias("n"))
                 .withColumn("above", F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin"))) - F.col("n"))
                 .where(F.col("above") < k)                                  # at most k bins a query
                 .select("q", "bin", "n", "above").toPandas())
        shared.unpersist()
        found = found[found["above"] < need[found["q"]]].sort_values(["q", "bin"]).drop_duplicates("q")
        kth_bin = np.zeros(len(block), np.int64)                             # too few candidates: the lowest bin
        at = found["q"].to_numpy()
        kth_bin[at], above = found["bin"], np.zeros(len(block), np.int64)
        above[at] = found["above"]
        need = need - above
        lo, span = lo + kth_bin * step, step
    shared = spark.sparkContext.broadcast((ids, q, lo))
    return candidates.mapInArrow(winners(shared, k), "query_id long, vec_id long, score long, _q long")


def exact_topk(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query by
    integer inner product, for (vec_id, v array<bigint>) tables."""
    spark = candidates.sparkSession
    candidates = staged(candidates.select("vec_id", "v"), "topk-candidates")
    asked = queries.select("vec_id", "v").distinct()
    n = asked.count()
    blocks = -(-n // (BLOCK // 2)) if n > BLOCK else 1
    asked = staged(asked.withColumn("_block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks))), "topk-queries")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    longest, width = candidates.agg(F.sqrt(F.max(square)), F.max(F.size("v"))).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not n or longest is None:
        return spark.createDataFrame([], schema)
    found = None
    for b in range(blocks):
        block = asked.where(F.col("_block") == b).orderBy("vec_id", "v").collect()   # at most about BLOCK rows
        if block:
            part = search_block(block, candidates, k, float(longest), int(width)).withColumn("_block", F.lit(b))
            part = staged(part, "topk-block") if blocks > 1 else part
            found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("_block", "_q").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


# DuckDB SQL for the rows of the query.
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
