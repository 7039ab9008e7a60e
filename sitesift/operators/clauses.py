"""Queries of clauses (G1-G4): must, should and must_not, a field per clause, phrases.

queries: ``(query_id INT, clauses ARRAY<STRUCT<text STRING, field STRING, occur STRING>>,
mode, offset, limit)``. ``occur`` is must, should or must_not; null takes the query's mode
(and: must, or: should). ``field`` null or ``*`` means any field. The text is analysed like
the index: one term is a term, several are a phrase, found where all stand at their
distances in one field. A clause without terms (stop words only) is left out.

A document matches when all must clauses and no must_not clause match, and, without a must
clause, at least one should clause. Its score sums the BM25 parts of must and should clauses;
a phrase scores like a term that weighs what its terms weigh together and occurs as often as
the phrase.

    statistics of the batch's terms ⋈ places of terms in clauses -> weights by term and field [broadcast]
    postings of the single terms ⋈ weights                       -> clause hits
    postings of the phrases' terms ⋈ weights, groupBy(clause, doc, field): where all terms are,
        positions shifted by their place and intersected as arrays, at most one row per
        term of the phrase                                       -> clause hits
    groupBy(query_id, doc_id): masks of matched clauses, sum, excluded
        without an exchange: postings lie by doc_id, and are read once by either kind of clause
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import Analyzer
from .index import Index

MUST, SHOULD, MUST_NOT = "must", "should", "must_not"


def analysed(clauses: Column, mode: Column, analyzer: Analyzer) -> Column:
    """array<struct<occur, field, terms array<struct<at, term>>>> of the clauses that have terms."""
    default = F.when(F.lower(mode) == "or", SHOULD).otherwise(MUST)
    parts = F.transform(clauses, lambda c: F.struct(
        F.lower(F.coalesce(c["occur"], default)).alias("occur"), c["field"].alias("field"),
        analyzer.placed(c["text"]).alias("terms")))
    return F.filter(F.coalesce(parts, F.array()), lambda p: F.size(p["terms"]) > 0)


def shown_terms(parts: Column) -> Column:
    """The distinct terms of all clauses (those of must_not clauses stand in no hit)."""
    return F.array_distinct(F.flatten(F.transform(parts, lambda p: F.transform(p["terms"], lambda t: t["term"]))))


def _in_field() -> Column:
    return F.col("scope").isNull() | (F.col("scope") == "*") | (F.col("scope") == F.col("field"))


def phrase_starts(placed: Column) -> Column:
    """Where a phrase begins: positions of its terms, each moved back by its place, intersected."""
    moved = F.transform(placed, lambda x: F.transform(x["positions"], lambda p: p - x["at"]))
    return F.aggregate(F.slice(moved, F.lit(2), F.size(moved)), F.get(moved, F.lit(0)), lambda a, b: F.array_intersect(a, b))


def score_clauses(index: Index, q: DataFrame, n_terms: int, n_queries: int = 0) -> DataFrame:
    """(query_id, doc_id, score, matched) of every matching document; ``matched`` counts clauses."""
    from .search import BROADCAST_MAX_QUERY_TERMS, SCORE_DECIMALS, _maybe_broadcast, bm25, term_weight

    def small(df: DataFrame) -> DataFrame:
        return _maybe_broadcast(df, max(places, n_queries), BROADCAST_MAX_QUERY_TERMS)

    # One action over the (small) query table; a phrase may repeat a term.
    width, places = q.select(F.size("parts"), F.aggregate("parts", F.lit(0), lambda n, p: n + F.size(p["terms"])).alias("n")
                             ).agg(F.max("size(parts)"), F.sum("n")).first()
    width, places = int(width or 0), int(places or 0)
    clauses = q.select("query_id", F.posexplode("parts").alias("ci", "_p")).select(
        "query_id", "ci", "_p.occur", F.col("_p.field").alias("scope"), "_p.terms", F.size("_p.terms").alias("n"))
    placed = clauses.select("query_id", "ci", "occur", "scope", "n", F.inline("terms"))

    def terms_of(kind: DataFrame) -> DataFrame:
        return small(kind.select("term").distinct())

    # The batch's terms are weighed before they meet the postings, by the fields they are asked in.
    weights = index.weights_of(terms_of(placed), max(n_terms, places) <= BROADCAST_MAX_QUERY_TERMS)

    def asked(kind: DataFrame) -> DataFrame:
        return small(weights.join(small(kind), "term").where(_in_field()).select(
            "query_id", "ci", "occur", "n", "at", "term", "field", "avg_dl", term_weight().alias("weight")))

    def found(kind: DataFrame, *columns: str) -> DataFrame:
        post = index.by_document(index.postings_of(terms_of(kind)).select("term", "field", "doc_id", "dl", *columns))
        return post.join(asked(kind), ["term", "field"])

    # doc_id renamed to itself: a union keeps the names of its first side down to the scan, and the
    # documents' exchange would differ from the one below the weights, so that Spark could not reuse it.
    hits = found(placed.where("n = 1"), "tf").select(
        "query_id", "ci", "occur", F.col("doc_id").alias("doc_id"), bm25(F.col("weight"), F.col("tf"), F.col("dl")).alias("part"))
    whole = (found(placed.where("n > 1"), "positions")
             .groupBy("doc_id", "query_id", "ci", "field", "occur", "n", "dl", "avg_dl")
             .agg(F.collect_list(F.struct("at", "positions")).alias("placed"), F.sum("weight").alias("weight"))
             .where(F.size("placed") == F.col("n"))
             .withColumn("times", F.size(phrase_starts(F.col("placed")))).where("times > 0")
             .select("query_id", "ci", "occur", "doc_id", bm25(F.col("weight"), F.col("times"), F.col("dl")).alias("part")))

    def mask(occur: str, word: int) -> Column:
        here = (F.col("occur") == occur) & (F.floor(F.col("ci") / 64) == word)
        return F.bit_or(F.when(here, F.expr("shiftleft(CAST(1 AS BIGINT), ci % 64)")).otherwise(F.lit(0).cast("bigint")))

    words = range(max(1, (width + 63) // 64))
    per_doc = hits.unionByName(whole).groupBy("query_id", "doc_id").agg(
        F.sum(F.when(F.col("occur") != MUST_NOT, F.col("part")).otherwise(0.0)).alias("raw"),
        F.max((F.col("occur") == MUST_NOT)).alias("excluded"),
        *[mask(o, w).alias(f"{o}{w}") for o in (MUST, SHOULD) for w in words])
    must, should = (sum((F.bit_count(F.col(f"{o}{w}")) for w in words), F.lit(0)) for o in (MUST, SHOULD))
    needed = small(q.select("query_id", F.size(F.filter("parts", lambda p: p["occur"] == MUST)).alias("n_must")))
    return (per_doc.join(needed, "query_id")
            .where(~F.col("excluded") & (must == F.col("n_must")) & ((must > 0) | (should > 0)))
            .select("query_id", "doc_id", F.round("raw", SCORE_DECIMALS).alias("score"),
                    (must + should).cast("int").alias("matched")))
