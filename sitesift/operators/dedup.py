"""Stateful dedups as joins and aggregates (D1 visited URLs, D2 ETags).

"First arrival wins" is made deterministic: one row per key, the smallest
by an explicit order. It is a ``min(struct(...))`` aggregate, so it is
combined map-side: a hub URL linked from a third of all pages is reduced
in every task before the shuffle and never becomes one huge group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Candidate sets up to this many rows are probed against a large visited
# set by broadcasting the candidates (visited is scanned, not shuffled).
SMALL_SIDE_ROWS = 2_000_000


def first_per_key(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """One row per ``key``: the row with the smallest ``order`` tuple."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys and c not in order]
    w = F.min(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest])).alias("__w")
    return df.groupBy(*keys).agg(w).select(*keys, *[F.col(f"__w.{c}").alias(c) for c in order + rest]) \
        .select(*df.columns)


def anti_join_seen(cand: DataFrame, seen: DataFrame | None, key: str, cand_rows: int | None = None) -> DataFrame:
    """Rows of ``cand`` whose ``key`` is not in ``seen``.

    ``left_anti`` can only broadcast its right side (the growing seen set).
    When the candidates are known to be few (``cand_rows``), the seen rows
    that hit a candidate are found with the candidates broadcast, and only
    those hits are broadcast back for the anti join; with ``cand_rows``
    unknown, AQE makes that choice from runtime sizes. Pass
    ``cand_rows=-1`` for a plain anti join (both sides large).
    """
    if seen is None:
        return cand
    s = seen.select(key)
    if cand_rows is not None and 0 <= cand_rows <= SMALL_SIDE_ROWS:
        keys = cand.select(key).distinct()
        hits = s.join(F.broadcast(keys), key, "left_semi").distinct()
        return cand.join(F.broadcast(hits), key, "left_anti")
    if cand_rows is None:
        # size unknown until run time: the same two steps without hints, so
        # AQE broadcasts the candidates only if they turn out small
        hits = s.join(cand.select(key), key, "left_semi")
        return cand.join(hits, key, "left_anti")
    return cand.join(s, key, "left_anti")


def visited_dedup(cand: DataFrame, visited: DataFrame | None = None, key: str = "url",
                  order: list[str] | None = None, cand_rows: int | None = None) -> DataFrame:
    """Each URL admitted once; first arrival by (depth, referrer, pos)."""
    order = order or [c for c in ("depth", "referrer", "pos") if c in cand.columns]
    return anti_join_seen(first_per_key(cand, key, order), visited, key, cand_rows)


def etag_dedup(docs: DataFrame, seen: DataFrame | None = None, order: list[str] | None = None,
               cand_rows: int | None = None) -> DataFrame:
    """Documents with a non-empty ETag seen before are dropped; one per
    new ETag, the first by (depth, url). NULL or empty ETag passes."""
    order = order or [c for c in ("depth", "url") if c in docs.columns]
    no_tag = docs.where(F.col("etag").isNull() | (F.col("etag") == ""))
    tagged = docs.where(F.col("etag").isNotNull() & (F.col("etag") != ""))
    seen_e = None if seen is None else seen.select("etag")
    first = first_per_key(anti_join_seen(tagged, seen_e, "etag", cand_rows), "etag", order)
    return no_tag.unionByName(first)
