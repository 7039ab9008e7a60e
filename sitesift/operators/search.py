"""Batched search (G1-G11): a table of queries in, ranked result rows out.

queries: ``(query_id INT, terms ARRAY<STRING>, mode STRING 'and'|'or',
fields ARRAY<STRING> (NULL or ['*'] = all), offset INT, limit INT)``.

Plan shape (one job):

    queries --explode--> (query_id, term)  [broadcast, size checked]
    postings of the batch's terms (their folders only, see index_store)
             ⋈ statistics -> BM25 part, once per posting, not per query
             ⋈ terms  -> per (query, term, field, doc)
    groupBy(query_id, doc_id)  -> score, matched terms (partial aggregates)
        without an exchange: postings lie by doc_id
    AND: matched = number of terms
    groupBy(query_id) -> hitcount, max score       (G5, G6)
    row_number() over (query_id order by score desc, doc_id) <= max rank
        -> WindowGroupLimit cuts every partition to the top before the
           exchange, so a query matching a third of the corpus never
           lands in one task
    top-k ⋈ docs (needed columns only) -> extract / highlight
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import Analyzer, build_extract, with_highlight
from .index import Index, index_partitions

# Fixed values of the engine: BM25 parameters and score rounding (pinned).
BM25_K1 = 1.2
BM25_B = 0.75
SCORE_DECIMALS = 6
DEFAULT_LIMIT = 10
DEFAULT_OFFSET = 0

# Row bounds under which a side is broadcast. Checked on the driver from an
# aggregate of the (small) query table, never guessed.
BROADCAST_MAX_QUERY_TERMS = 200_000
BROADCAST_MAX_RESULT_ROWS = 1_000_000


@dataclass(frozen=True)
class SearchOptions:
    highlight: bool = False
    pre_tag: str | None = None
    post_tag: str | None = None
    ellipsis: str | None = None
    excerpt_length: int | None = None
    num_excerpts: int | None = None


def normalize_queries(queries: DataFrame, analyzer: Analyzer = Analyzer()) -> DataFrame:
    """Defaults and analysed terms: each given term is tokenized like the index.
    Queries of clauses (see ``clauses``) get these as ``parts`` instead."""
    cols = set(queries.columns)
    q = queries
    if "mode" not in cols:
        q = q.withColumn("mode", F.lit("and"))
    if "fields" not in cols:
        q = q.withColumn("fields", F.lit(None).cast("array<string>"))
    if "offset" not in cols:
        q = q.withColumn("offset", F.lit(DEFAULT_OFFSET))
    if "limit" not in cols:
        q = q.withColumn("limit", F.lit(DEFAULT_LIMIT))
    extra = []
    if "clauses" in cols:
        from .clauses import analysed, shown_terms
        extra = [analysed(F.col("clauses"), F.col("mode"), analyzer).alias("parts")]
        qterms = shown_terms(extra[0])
    else:
        given = F.coalesce(F.col("terms"), F.array().cast("array<string>"))
        qterms = F.array_distinct(F.flatten(F.transform(given, lambda t: analyzer.terms(t))))
    return q.select(
        F.col("query_id").cast("int").alias("query_id"),
        qterms.alias("qterms"),
        F.lower(F.coalesce(F.col("mode"), F.lit("and"))).alias("mode"),
        F.col("fields"),
        F.coalesce(F.col("offset"), F.lit(DEFAULT_OFFSET)).cast("int").alias("offset"),
        F.coalesce(F.col("limit"), F.lit(DEFAULT_LIMIT)).cast("int").alias("limit"),
        *extra,
    )


def _bounds(q: DataFrame):
    """One small driver action on the query table: sizes that decide
    broadcasts, the top-k bound and the width of the matched-term masks."""
    r = q.agg(F.coalesce(F.sum(F.size("qterms")), F.lit(0)).alias("n_terms"),
              F.coalesce(F.max(F.col("offset").cast("bigint") + F.col("limit")), F.lit(0)).alias("max_rank"),
              F.coalesce(F.sum(F.col("limit")), F.lit(0)).alias("n_results"),
              F.coalesce(F.max(F.size("qterms")), F.lit(0)).alias("max_q"),
              F.count(F.lit(1)).alias("n_queries")).first()
    return int(r["n_terms"]), int(r["max_rank"]), int(r["n_results"]), int(r["max_q"]), int(r["n_queries"])


def _maybe_broadcast(df: DataFrame, rows: int, bound: int) -> DataFrame:
    return F.broadcast(df) if rows <= bound else df


def _in_scope() -> Column:
    return (F.col("fields").isNull() | (F.size("fields") == 0) | F.array_contains("fields", "*")
            | F.array_contains("fields", F.col("field")))


def term_weight() -> Column:
    return F.log(F.lit(1.0) + (F.col("n_docs") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))


def bm25(weight: Column, tf: Column, dl: Column) -> Column:
    """The score of a term (or phrase) with that weight in a field of ``dl`` terms."""
    norm = F.lit(BM25_K1) * (F.lit(1.0 - BM25_B) + F.lit(BM25_B) * dl / F.col("avg_dl"))
    return weight * tf * F.lit(BM25_K1 + 1.0) / (tf + norm)


def weighed(index: Index, rows: DataFrame, terms: DataFrame, n_terms: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (term, field, ...) with df, n_docs and avg_dl of their term and field,
    and the statistics of the batch's terms. Both are small by the same check as the
    query table (a few fields a term) and broadcast then; else Spark shuffles."""
    stats = index.weights_of(terms, n_terms <= BROADCAST_MAX_QUERY_TERMS)
    return rows.join(_maybe_broadcast(stats, n_terms, BROADCAST_MAX_QUERY_TERMS), ["term", "field"]), stats


def _mask_words(max_q: int) -> range:
    return range(max(1, (max_q + 63) // 64))


def matched_masks(max_q: int) -> list[Column]:
    """Aggregates that mark the terms met by their places ``ti`` in a query of at most ``max_q``."""
    return [F.bit_or(F.when(F.floor(F.col("ti") / 64) == w, F.expr("shiftleft(CAST(1 AS BIGINT), ti % 64)"))
                     .otherwise(F.lit(0).cast("bigint"))).alias(f"m{w}") for w in _mask_words(max_q)]


def matched_terms(max_q: int) -> Column:
    return sum((F.bit_count(F.col(f"m{w}")) for w in _mask_words(max_q)), F.lit(0))


def score_matches(index: Index, q: DataFrame, n_terms: int, max_q: int = 64, n_queries: int = 0) -> DataFrame:
    """(query_id, doc_id, score, matched) for every matching document.

    The terms of all queries are joined with the postings in one pass. Postings
    lie by ``doc_id``, so a row per posting and query is summed up in its task
    and never shuffled. The number of distinct matched terms, by which an AND
    query's documents are told from those that hold some of its terms, is
    counted with 64-bit masks over each term's position in the query
    (``bit_or``), a fixed-width aggregate that combines map-side.
    """
    if "parts" in q.columns:
        from .clauses import score_clauses
        return score_clauses(index, q, n_terms, n_queries)
    qt = q.select("query_id", "mode", "fields", F.posexplode("qterms").alias("ti", "term"))
    qt_b = _maybe_broadcast(qt, n_terms, BROADCAST_MAX_QUERY_TERMS)
    terms_b = _maybe_broadcast(qt.select("term").distinct(), n_terms, BROADCAST_MAX_QUERY_TERMS)

    # Only postings of the batch's terms are read, and each is scored once.
    # They lie by document from here on, so nothing below brings them to another task.
    post, _ = weighed(index, index.postings_of(terms_b), terms_b, n_terms)
    post = index.by_document(post.select("term", "field", "doc_id",
                                         bm25(term_weight(), F.col("tf"), F.col("dl")).alias("part")))

    hits = post.join(qt_b, "term").where(_in_scope())
    per_doc = hits.groupBy("query_id", "doc_id").agg(F.sum("part").alias("raw"), *matched_masks(max_q))
    matched = matched_terms(max_q)
    qm = _maybe_broadcast(q.select("query_id", "mode", F.size("qterms").alias("nq")),
                          max(n_terms, n_queries), BROADCAST_MAX_QUERY_TERMS)
    return (per_doc.join(qm, "query_id")
            .where((F.col("mode") == "or") | (matched == F.col("nq")))
            .select("query_id", "doc_id",
                    F.round("raw", SCORE_DECIMALS).alias("score"),
                    matched.cast("int").alias("matched")))


def hit_totals(scored: DataFrame, q: DataFrame) -> DataFrame:
    """G5 + G6: hitcount and best score per query; a query without hits gets 0."""
    tot = scored.groupBy("query_id").agg(F.count(F.lit(1)).alias("hitcount"),
                                         F.max("score").alias("max_score"))
    return (q.select("query_id").join(tot, "query_id", "left")
            .select("query_id", F.coalesce("hitcount", F.lit(0)).cast("bigint").alias("hitcount"),
                    F.coalesce("max_score", F.lit(0.0)).alias("max_score")))


def shared(index: Index, scored: DataFrame) -> DataFrame:
    """``scored`` behind an exchange of its own, for plans that read it twice: Spark reuses it.
    All columns are in its key, so that no reader's exchange lacks one and is another."""
    return scored.repartition(index_partitions(index.docs), F.xxhash64("query_id", "doc_id", "score"))


def top_k(scored: DataFrame, q: DataFrame, max_rank: int, n_results: int, n_queries: int = 0) -> DataFrame:
    """Rows ``offset <= rank < offset+limit`` of each query, rank 0-based.

    The literal bound on ``row_number`` lets Spark put a WindowGroupLimit
    before the shuffle on ``query_id``.
    """
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id").asc())
    ranked = (scored.withColumn("rn", F.row_number().over(w))
              .where(F.col("rn") <= F.lit(min(max(max_rank, 0), 2 ** 31 - 1))))
    page = _maybe_broadcast(q.select("query_id", "offset", "limit"), max(n_results, n_queries),
                            BROADCAST_MAX_RESULT_ROWS)
    return (ranked.join(page, "query_id")
            .where((F.col("rn") > F.col("offset")) & (F.col("rn") <= F.col("offset").cast("bigint") + F.col("limit")))
            .select("query_id", (F.col("rn") - 1).cast("int").alias("rank"), "doc_id", "score"))


# Blocks per query that are scored first, to learn what the page's last row scores at least.
FIRST_BLOCKS = 8


def top_scores(index: Index, q: DataFrame, max_rank: int, n_terms: int, max_q: int = 64, n_queries: int = 0) -> DataFrame:
    """G4 for a page alone: (query_id, doc_id, score) of a set that holds each query's ``max_rank``
    best, without scoring the rest. For an index with block maxima.

    What the terms of a query can score at most in a block of documents bounds all of its
    documents. The most promising blocks are scored first; with the ``max_rank``-th score
    found there, blocks below it are left out. Of a query that asks for all of its terms only
    blocks that hold them all are scored.
    """
    from ..sources.index_store import doc_block
    qt = q.select("query_id", "fields", F.posexplode("qterms").alias("ti", "term"))
    terms = _maybe_broadcast(qt.select("term").distinct(), n_terms, BROADCAST_MAX_QUERY_TERMS)
    # The fields a query asks for are part of the key by which its terms are joined: there are many
    # more rows per posting and query than postings, and none of them is made only to be left out.
    names = F.array(*[F.lit(r["field"]) for r in index.field_stats.select("field").collect()]).cast("array<string>")
    qt = _maybe_broadcast(qt.withColumn("field", F.explode(names)).where(_in_scope())
                          .select("query_id", "ti", "term", "field"), n_terms, BROADCAST_MAX_QUERY_TERMS)
    any_term = q.where(F.col("mode") == "or").select("query_id", "mode", F.lit(0).alias("nq")).distinct()
    all_terms = q.where(F.col("mode") != "or").select("query_id", "mode", F.size("qterms").alias("nq"))
    asked = _maybe_broadcast(any_term.unionByName(all_terms), max(n_terms, n_queries), BROADCAST_MAX_QUERY_TERMS)

    def complete(sums: DataFrame) -> DataFrame:
        """Without the documents or blocks that lack a term of a query that asks for all."""
        return sums.join(asked, "query_id").where((F.col("mode") == "or") | (matched_terms(max_q) == F.col("nq")))

    # Maxima and postings are brought together by block before they meet the queries: a row
    # per posting and query is never shuffled.
    n = index_partitions(index.docs)
    maxima, _ = weighed(index, index.maxima_of(terms), terms, n_terms)
    best = bm25(term_weight(), F.col("max_tf"), F.col("min_dl"))
    bounds = (maxima.select("term", "field", "block", best.alias("best")).repartition(n, "block")
              .join(qt, ["term", "field"])
              .groupBy("query_id", "block").agg(F.sum("best").alias("bound"), *matched_masks(max_q)))
    bounds = complete(bounds).select("query_id", "block", "bound")
    post, _ = weighed(index, index.postings_of(terms), terms, n_terms)
    post = post.select("term", "field", "doc_id", doc_block("doc_id", index.n_blocks).alias("block"),
                       bm25(term_weight(), F.col("tf"), F.col("dl")).alias("part")).repartition(n, "block")

    def scored(blocks: DataFrame) -> DataFrame:
        wanted = blocks.groupBy("block").agg(F.collect_set("query_id").alias("wanted")).hint("shuffle_hash")
        hits = (post.join(wanted, "block").join(qt, ["term", "field"])
                .where(F.array_contains("wanted", F.col("query_id"))))
        sums = hits.groupBy("query_id", "block", "doc_id").agg(F.sum("part").alias("raw"), *matched_masks(max_q))
        return (complete(sums).select("query_id", "doc_id", F.round("raw", SCORE_DECIMALS).alias("score")))

    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    first = bounds.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= FIRST_BLOCKS)
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    last = (scored(first)
            .withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= max_rank)
            .groupBy("query_id").agg(F.max("_n").alias("_n"), F.min("score").alias("least"))
            .where(F.col("_n") == max_rank).select("query_id", "least"))
    slack = 2 * 10.0 ** -SCORE_DECIMALS                # scores are rounded, bounds are not
    kept = (bounds.join(_maybe_broadcast(last, n_queries, BROADCAST_MAX_RESULT_ROWS), "query_id", "left")
            .where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - slack)))
    return scored(kept)


def search_page(index: Index, queries: DataFrame) -> DataFrame:
    """G7 without totals: (query_id, rank, doc_id, score) of each query's page, by block
    maxima where the index has them."""
    q = normalize_queries(queries, index.analyzer)
    n_terms, max_rank, n_results, max_q, n_queries = _bounds(q)
    if getattr(index, "blocks", None) is None or "parts" in q.columns:
        scored = score_matches(index, q, n_terms, max_q, n_queries).drop("matched")
    else:
        scored = top_scores(index, q, max_rank, n_terms, max_q, n_queries)
    return top_k(scored, q, max_rank, n_results, n_queries)


def search(index: Index, queries: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """Match -> score -> count -> page -> stored fields -> extract.

    Returns ``(query_id, rank, doc_id, score, relative_score, title, url,
    extract, hitcount)``; queries without hits give no rows (see
    :func:`search_totals` for their zero hitcount).
    """
    q = normalize_queries(queries, index.analyzer)
    n_terms, max_rank, n_results, max_q, n_queries = _bounds(q)
    scored = shared(index, score_matches(index, q, n_terms, max_q, n_queries).drop("matched"))
    totals = _maybe_broadcast(hit_totals(scored, q), n_queries, BROADCAST_MAX_RESULT_ROWS)
    page = top_k(scored, q, max_rank, n_results, n_queries)
    page_b = _maybe_broadcast(page.join(totals, "query_id"), n_results, BROADCAST_MAX_RESULT_ROWS)
    if "part" in index.docs.columns:
        # stored documents in hash folders: joining on the folder lets Spark
        # prune the scan to the folders of this page of hits (DPP)
        from ..sources.index_store import doc_part
        stored = index.docs.select("parts", "part", "doc_id", "title", "url", "data")
        wanted = page_b.withColumn("parts", F.explode(F.array(*[F.lit(p) for p in index.parts])))
        rows = (stored.join(wanted.withColumn("part", doc_part("doc_id", F.col("parts"))), ["parts", "part", "doc_id"])
                .drop("parts", "part"))
    else:
        stored = index.docs.select("doc_id", "title", "url", "data")
        rows = stored.join(page_b, "doc_id")
    rel = F.when(F.col("max_score") > 0, F.round(F.col("score") / F.col("max_score"), SCORE_DECIMALS))
    cols = ["query_id", "rank", "doc_id", "score", rel.alias("relative_score"), "title", "url"]
    if options.highlight:
        rows = rows.join(_maybe_broadcast(q.select("query_id", "qterms"), n_terms, BROADCAST_MAX_QUERY_TERMS),
                         "query_id")
        rows = with_highlight(rows, "data", "qterms", "extract", options.pre_tag, options.post_tag,
                              options.ellipsis, options.excerpt_length, options.num_excerpts)
        return rows.select(*cols, "extract", "hitcount")
    return rows.select(*cols, build_extract("data").alias("extract"), "hitcount")


def search_totals(index: Index, queries: DataFrame) -> DataFrame:
    """G5/G6 alone: ``(query_id, hitcount, max_score)`` for every query."""
    q = normalize_queries(queries, index.analyzer)
    n_terms, _, _, max_q, n_queries = _bounds(q)
    return hit_totals(score_matches(index, q, n_terms, max_q, n_queries), q)


def matches(index: Index, queries: DataFrame) -> DataFrame:
    """G1-G4 alone: ``(query_id, doc_id, score, matched)`` for every hit."""
    q = normalize_queries(queries, index.analyzer)
    n_terms, _, _, max_q, n_queries = _bounds(q)
    return score_matches(index, q, n_terms, max_q, n_queries)


def relative_scores(index: Index, queries: DataFrame) -> DataFrame:
    """G6 over the whole result: ``(query_id, doc_id, relative_score)``."""
    q = normalize_queries(queries, index.analyzer)
    n_terms, _, _, max_q, _ = _bounds(q)
    scored = shared(index, score_matches(index, q, n_terms, max_q).drop("matched"))
    best = scored.groupBy("query_id").agg(F.max("score").alias("max_score"))
    return (scored.join(best, "query_id")
            .select("query_id", "doc_id",
                    F.when(F.col("max_score") > 0, F.round(F.col("score") / F.col("max_score"), SCORE_DECIMALS))
                    .alias("relative_score")))


def query_table(spark, rows, mode: str = "and", fields=None, offset: int = DEFAULT_OFFSET,
                limit: int = DEFAULT_LIMIT) -> DataFrame:
    """A query table from ``(query_id, text)`` pairs: the text is analysed
    into terms like indexed text (no operator syntax is parsed; the mode,
    fields and paging are given as values)."""
    data = [(int(i), [t], mode, list(fields) if fields else None, int(offset), int(limit)) for i, t in rows]
    return spark.createDataFrame(data, "query_id int, terms array<string>, mode string, fields array<string>, "
                                       "offset int, limit int")
