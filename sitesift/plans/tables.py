"""Readers for the given test tables and the tables Spark derives from them.

Every derivation is a plain projection of a given table, so its size grows
with the table; nothing here is made-up or fixed-size input.
"""

from __future__ import annotations

import functools
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

# Fixed values of the test mapping: documents become index
# documents with url doc://<doc_id>, title = first line, data = whole text.
DOC_URL_PREFIX = "doc://"


# Tables whose rows carry whole pages: regex extraction over them is CPU-bound
# and narrow, so they are spread over the cluster when the file is one row group.
SPREAD_TABLES = ("pages",)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return spread(df) if name in SPREAD_TABLES else df


def documents_as_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.concat(F.lit(DOC_URL_PREFIX), F.col("doc_id").cast("string")).alias("url"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("data"),
    )


def benchmark_queries(spark: SparkSession, sf_dir: str, limit: int = 10, offset: int = 0) -> DataFrame:
    """Two queries per benchmark passage, each over the passage's whole text.

    ``2*item_id``: AND of all its words over all fields (documents that
    contain the passage's vocabulary); ``2*item_id+1``: OR of all its words
    on the ``data`` field (ranked retrieval of related documents).
    """
    b = read(spark, sf_dir, "benchmark")
    terms = F.array(F.col("text"))
    and_q = b.select((F.col("item_id") * 2).cast("int").alias("query_id"), terms.alias("terms"),
                     F.lit("and").alias("mode"), F.lit(None).cast("array<string>").alias("fields"),
                     F.lit(offset).alias("offset"), F.lit(limit).alias("limit"))
    or_q = b.select((F.col("item_id") * 2 + 1).cast("int").alias("query_id"), terms.alias("terms"),
                    F.lit("or").alias("mode"), F.array(F.lit("data")).alias("fields"),
                    F.lit(offset).alias("offset"), F.lit(limit).alias("limit"))
    return and_q.unionByName(or_q)


# Words that each clause query takes from a passage, by place (from 1): the term that must
# match, those that should, the one that must not stand in the title, and the phrases.
CLAUSE_WORDS = {"must": 1, "should": (2, 3, 4, 5), "must_not": 6}
PHRASE_WORDS = ((1, 3), (5, 2))     # (first word, how many)


def clause_queries(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """One query of clauses per benchmark passage.

    ``must``: its first word must stand in the data, the next four should anywhere, the
    sixth must not in the title. ``any``: no must; the second to fifth word should, two
    by field, the sixth must not stand in the data. ``phrase``: its first three words as
    a phrase must stand in the data, another two should stand together anywhere.
    """
    words = F.regexp_extract_all("text", F.lit(r"([^ \n]+)"), 1)

    def clause(text, field, occur):
        return F.struct(text.alias("text"), F.lit(field).cast("string").alias("field"), F.lit(occur).alias("occur"))

    def word(i):
        return F.get(words, F.lit(i - 1))

    def phrase(first, n):
        return F.array_join(F.slice(words, first, n), " ")

    must, should, must_not = (CLAUSE_WORDS[k] for k in ("must", "should", "must_not"))
    clauses = {
        "must": [clause(word(must), "data", "must"), *[clause(word(i), None, "should") for i in should],
                 clause(word(must_not), "title", "must_not")],
        "any": [*[clause(word(i), f, "should") for i, f in zip(should, ("title", "data", None, None))],
                clause(word(must_not), "data", "must_not")],
        "phrase": [clause(phrase(*PHRASE_WORDS[0]), "data", "must"), clause(phrase(*PHRASE_WORDS[1]), None, "should")],
    }[kind]
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("int").alias("query_id"),
                                                   F.array(*clauses).alias("clauses"))


# The stop list of the registered query: frequent words of the test documents' languages.
TEST_STOP_WORDS = ("the", "and", "of", "in", "on", "der", "die", "und", "le", "de", "la", "que")


# Fixed values of the derived fetch outcomes, by page_id modulo OUTCOMES: statuses that
# are no success (their captures have no body) and content types that are not the page's own.
OUTCOMES = 16
STATUS_BY_PAGE = {3: 500, 7: 403, 11: 404}
TYPE_BY_PAGE = {1: "application/pdf", 5: "application/msword", 9: "text/plain", 13: "application/xhtml+xml"}


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` with a fetch outcome derived from the page itself.

    status by ``page_id`` (STATUS_BY_PAGE), else 200 for a non-empty body and 404
    without one; a capture that is no success has a null body; content type by
    ``page_id`` (TYPE_BY_PAGE), else from the page's ``<meta charset>``; etag = md5
    of the body (exact copies share it, null without a body); a tracking URL
    (``utm_source=`` in its query) redirects to the same URL without query and fragment.
    """
    from ..functions.html import attribute_of_first
    outcome = F.pmod(F.col("page_id"), F.lit(OUTCOMES))

    def by_page(values, otherwise):
        return functools.reduce(lambda c, kv: F.when(outcome == kv[0], F.lit(kv[1])).otherwise(c),
                                values.items(), otherwise)

    status = by_page(STATUS_BY_PAGE, F.when(F.length("html") > 0, F.lit(200)).otherwise(F.lit(404)))
    charset = attribute_of_first("html", "meta", "charset")
    own_type = F.when(charset.isNotNull(), F.concat(F.lit("text/html; charset="), F.lower(charset))).otherwise(
        F.lit("text/html"))
    p = read(spark, sf_dir, "pages").withColumns({"status": status, "content_type": by_page(TYPE_BY_PAGE, own_type)})
    p = p.withColumn("html", F.when(F.col("status") == 200, F.col("html")))
    return p.select(
        "page_id", "url", "html", "status", "content_type", F.md5("html").alias("etag"),
        F.when(F.col("url").rlike(r"\?[^#]*utm_source="), F.regexp_replace("url", r"[?#].*$", ""))
        .alias("redirect_to"),
    )


# Fixed values of the derived link graph over documents: every document is a
# page at DOC_SITE/<doc_id> linking to two others by the rule below, where n
# is the number of documents; the first document of each source is a seed.
DOC_SITE = "http://docs.test/"
DOC_LINK_RULE = ((7, 3), (11, 5))   # dst = (a * doc_id + b) mod n


def doc_graph(spark: SparkSession, sf_dir: str):
    """(captures, edges, seeds) of the derived documents graph."""
    d = read(spark, sf_dir, "documents")
    n = d.count()
    url = F.concat(F.lit(DOC_SITE), F.col("doc_id").cast("string"))
    caps = d.select(F.col("doc_id").alias("page_id"), url.alias("url"), F.col("text").alias("html"),
                    F.lit(200).alias("status"), F.lit("text/html").alias("content_type"),
                    F.md5("text").alias("etag"), F.lit(None).cast("string").alias("redirect_to"))
    links = F.array(*[F.struct(F.lit(i).alias("pos"),
                               F.concat(F.lit(DOC_SITE), ((F.col("doc_id") * a + b) % F.lit(n)).cast("string"))
                               .alias("dst_url"))
                      for i, (a, b) in enumerate(DOC_LINK_RULE)])
    edges = d.select(url.alias("src_url"), F.inline(links)).select("src_url", "dst_url", "pos")
    seeds = d.groupBy("source").agg(F.min("doc_id").alias("doc_id")).select(
        F.concat(F.lit(DOC_SITE), F.col("doc_id").cast("string")).alias("url"))
    return caps, edges, seeds
