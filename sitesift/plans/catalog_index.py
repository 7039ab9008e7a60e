"""Registered index and search queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import Analyzer, build_extract
from ..operators import index as ix
from ..operators import search as se
from ..session import scratch_path
from ..sources.index_store import read_index, write_block_maxima, write_index
from .tables import TEST_STOP_WORDS, benchmark_queries, clause_queries, documents_as_docs


def _index(spark: SparkSession, sf: str) -> ix.Index:
    return ix.Index.build(documents_as_docs(spark, sf))


def q_stored_documents(spark, sf) -> DataFrame:
    return ix.stored_documents(documents_as_docs(spark, sf))


def q_tokenize(spark, sf) -> DataFrame:
    return ix.field_tokens(ix.stored_documents(documents_as_docs(spark, sf))).select("doc_id", "field", "tokens", "dl")


def q_postings(spark, sf) -> DataFrame:
    return _index(spark, sf).postings.select("term", "field", "doc_id", "tf", "dl", "positions")


def q_term_statistics(spark, sf) -> DataFrame:
    return _index(spark, sf).term_stats


def q_field_statistics(spark, sf) -> DataFrame:
    return _index(spark, sf).field_stats


def q_indexed_count(spark, sf) -> DataFrame:
    return ix.indexed_count(ix.indexable(documents_as_docs(spark, sf)))


def q_match_all(spark, sf) -> DataFrame:
    q = benchmark_queries(spark, sf).where(F.col("mode") == "and")
    return se.matches(_index(spark, sf), q)


def q_match_any(spark, sf) -> DataFrame:
    q = benchmark_queries(spark, sf).where(F.col("mode") == "or")
    return se.matches(_index(spark, sf), q)


def q_field_scope(spark, sf) -> DataFrame:
    q = (benchmark_queries(spark, sf).where(F.col("mode") == "or")
         .withColumn("fields", F.array(F.lit("title"))))
    return se.matches(_index(spark, sf), q)


def q_score(spark, sf) -> DataFrame:
    return se.matches(_index(spark, sf), benchmark_queries(spark, sf)).select("query_id", "doc_id", "score")


def q_hitcount(spark, sf) -> DataFrame:
    return se.search_totals(_index(spark, sf), benchmark_queries(spark, sf))


def q_relative_score(spark, sf) -> DataFrame:
    return se.relative_scores(_index(spark, sf), benchmark_queries(spark, sf))


def q_topk_page(spark, sf) -> DataFrame:
    idx = _index(spark, sf)
    q = se.normalize_queries(benchmark_queries(spark, sf, limit=10, offset=10))
    n_terms, max_rank, n_results, max_q, _ = se._bounds(q)
    scored = se.score_matches(idx, q, n_terms, max_q)
    return se.top_k(scored, q, max_rank, n_results)


def q_fetch_stored(spark, sf) -> DataFrame:
    return se.search(_index(spark, sf), benchmark_queries(spark, sf)).select(
        "query_id", "rank", "doc_id", "title", "url")


def q_extract(spark, sf) -> DataFrame:
    return documents_as_docs(spark, sf).select("doc_id", build_extract("data").alias("extract"))


def q_highlight(spark, sf) -> DataFrame:
    return se.search(_index(spark, sf), benchmark_queries(spark, sf), se.SearchOptions(highlight=True))


def q_search(spark, sf) -> DataFrame:
    return se.search(_index(spark, sf), benchmark_queries(spark, sf))


def q_clauses_must(spark, sf) -> DataFrame:
    return se.matches(_index(spark, sf), clause_queries(spark, sf, "must"))


def q_clauses_any(spark, sf) -> DataFrame:
    return se.matches(_index(spark, sf), clause_queries(spark, sf, "any"))


def q_phrase(spark, sf) -> DataFrame:
    return se.matches(_index(spark, sf), clause_queries(spark, sf, "phrase"))


def q_phrase_search(spark, sf) -> DataFrame:
    return se.search(_index(spark, sf), clause_queries(spark, sf, "phrase"))


def q_stop_list(spark, sf) -> DataFrame:
    """Written with a stop list and opened again: queries go by the analyzer kept with the index."""
    path = scratch_path(spark, "stop-index")
    write_index(ix.Index.build(documents_as_docs(spark, sf), analyzer=Analyzer(stop_words=TEST_STOP_WORDS)), path)
    return se.matches(read_index(spark, path), benchmark_queries(spark, sf))


def q_search_page(spark, sf) -> DataFrame:
    """The page without totals, by block maxima of a written index."""
    path = scratch_path(spark, "page-index")
    write_index(ix.Index.build(documents_as_docs(spark, sf)), path)
    write_block_maxima(spark, path)
    return se.search_page(read_index(spark, path), benchmark_queries(spark, sf))


QUERIES = {
    "stored_documents": q_stored_documents,
    "tokenize": q_tokenize,
    "postings": q_postings,
    "term_statistics": q_term_statistics,
    "field_statistics": q_field_statistics,
    "indexed_count": q_indexed_count,
    "match_all": q_match_all,
    "match_any": q_match_any,
    "field_scope": q_field_scope,
    "score": q_score,
    "hitcount": q_hitcount,
    "relative_score": q_relative_score,
    "topk_page": q_topk_page,
    "fetch_stored": q_fetch_stored,
    "extract": q_extract,
    "highlight": q_highlight,
    "search": q_search,
    "clauses_must": q_clauses_must,
    "clauses_any": q_clauses_any,
    "phrase": q_phrase,
    "phrase_search": q_phrase_search,
    "stop_list": q_stop_list,
    "search_page": q_search_page,
}


def oracle() -> dict[str, str]:
    from . import oracle_index as o
    return {
        "stored_documents": o.sql_stored_documents(),
        "tokenize": o.sql_tokenize(),
        "postings": o.sql_postings(),
        "term_statistics": o.sql_term_statistics(),
        "field_statistics": o.sql_field_statistics(),
        "indexed_count": o.sql_indexed_count(),
        "match_all": o.sql_matches("and"),
        "match_any": o.sql_matches("or"),
        "field_scope": o.sql_matches("or", or_fields="['title']"),
        "score": o.sql_scores(),
        "hitcount": o.sql_totals(),
        "relative_score": o.sql_relative(),
        "topk_page": o.sql_topk(limit=10, offset=10),
        "fetch_stored": o.sql_fetch_stored(),
        "extract": o.sql_extract(),
        "highlight": o.sql_search(highlight=True),
        "search": o.sql_search(),
        "clauses_must": o.sql_clauses("must"),
        "clauses_any": o.sql_clauses("any"),
        "phrase": o.sql_clauses("phrase"),
        "phrase_search": o.sql_phrase_search(),
        "stop_list": o.sql_stop_list(TEST_STOP_WORDS),
        "search_page": o.sql_topk(),
    }
