"""Registered source/sink queries (A4-A7) and streaming queries (H1, H2)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..operators.index import Index
from ..session import scratch_path
from ..sources.files import FILE_EXTENSION_MIME_TYPES, DEFAULT_MIME, extract_files, file_scan, mime_from_extension
from ..sources.index_store import read_index, rewrite_prefix, write_index
from ..streaming import crawl_stream as S
from . import oracle_index as OI
from . import sql_html as SH
from .catalog_crawl import PAGES_CRAWL, _pages_crawl_ctes
from .tables import DOC_URL_PREFIX, documents_as_docs, read

# Fixed parameters: public address that serves the indexed documents.
PUBLIC_PREFIX = "https://docs.example.org/doc/"


def q_file_scan(spark, sf):
    """A4 over a file tree derived from ``pages``: every page body is a ``.htm``
    file of its own (one line), listed, routed by extension and read back."""
    root = scratch_path(spark, "files")
    pages = read(spark, sf, "pages").where(F.col("html").isNotNull())
    # One value per row and per file, written as it is: no quoting, a separator that no page holds.
    # Tasks move their own files in place; the driver would rename all of them one after the other.
    (pages.select(F.regexp_replace("html", r"[\r\n]+", " ").alias("value"))
     .write.option("maxRecordsPerFile", 1).option("extension", "htm").option("sep", "\u0001").option("quote", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("mapreduce.fileoutputcommitter.algorithm.version", "2").csv(root))
    files = extract_files(file_scan(spark, root))
    return files.select(F.regexp_extract("url", r"\.([a-z]+)$", 1).alias("extension"), "extractor", "title")


def q_mime_from_extension(spark, sf):
    return read(spark, sf, "pages").select("page_id", mime_from_extension(
        F.regexp_replace("url", r"[?#].*$", "")).alias("content_type"))


def q_index_sink(spark, sf):
    """Index written in two runs (create, then append) and read back;
    statistics must equal a one-shot build."""
    path = scratch_path(spark, "index")
    docs = documents_as_docs(spark, sf)
    lang = read(spark, sf, "documents").select("doc_id", "lang")
    early = F.coalesce(F.col("lang").isin("en", "de"), F.lit(False))
    first = docs.join(lang.where(early), "doc_id", "left_semi")
    rest = docs.join(lang.where(~early), "doc_id", "left_semi")
    write_index(Index.build(first), path, create=True)
    write_index(Index.build(rest), path, create=False)
    return read_index(spark, path).term_stats


def q_rewrite_uri(spark, sf):
    return documents_as_docs(spark, sf).select("doc_id", rewrite_prefix("url", DOC_URL_PREFIX, PUBLIC_PREFIX)
                                               .alias("url"))


def q_stream_visited_dedup(spark, sf):
    """H1: page URLs streamed from the pages table, admitted once each."""
    schema = read(spark, sf, "pages").schema
    out, ckpt = S.stream_paths(scratch_path(spark, "stream-dedup"))
    stream = S.table_stream(spark, sf, "pages", schema)
    with S.rocksdb_state(spark):
        S.run_available(S.admitted_urls(stream, PAGES_CRAWL), out, ckpt)
    return spark.read.parquet(out).select("url")


def q_stream_etag_dedup(spark, sf):
    """D2 on a stream: documents arrive with the md5 of their text as tag, ordered by
    ``doc_id`` in a micro-batch; the first of each tag is admitted."""
    schema = read(spark, sf, "documents").schema
    out, ckpt = S.stream_paths(scratch_path(spark, "stream-etag"))
    stream = S.table_stream(spark, sf, "documents", schema)
    docs = stream.select(F.concat(F.lit(DOC_URL_PREFIX), F.col("doc_id").cast("string")).alias("url"),
                         F.md5("text").alias("etag"), "doc_id")
    with S.rocksdb_state(spark):
        S.run_available(S.admitted_tags(docs, "doc_id"), out, ckpt)
    return spark.read.parquet(out).select("url", "etag", F.col("arrival").alias("doc_id"))


def q_stream_index_append(spark, sf):
    """H2: documents streamed into the index batch by batch."""
    schema = read(spark, sf, "documents").schema
    root = scratch_path(spark, "stream-index")
    idx_path, ckpt = os.path.join(root, "index"), os.path.join(root, "checkpoint")
    stream = S.table_stream(spark, sf, "documents", schema)

    def to_docs(b):
        return b.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                        F.concat(F.lit(DOC_URL_PREFIX), F.col("doc_id").cast("string")).alias("url"),
                        F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("data"))

    S.run_index_stream(stream, idx_path, ckpt, to_docs)
    return read_index(spark, idx_path).postings


QUERIES = {
    "file_scan": q_file_scan,
    "mime_from_extension": q_mime_from_extension,
    "index_sink": q_index_sink,
    "rewrite_uri": q_rewrite_uri,
    "stream_visited_dedup": q_stream_visited_dedup,
    "stream_etag_dedup": q_stream_etag_dedup,
    "stream_index_append": q_stream_index_append,
}


def oracle() -> dict[str, str]:
    mime_cases = " ".join(f"WHEN {SH.q(k)} THEN {SH.q(v)}" for k, v in FILE_EXTENSION_MIME_TYPES.items())
    ext = r"lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\.([^./]+)$', 1))"
    return {
        "mime_from_extension": f"SELECT page_id, coalesce(CASE {ext} {mime_cases} END, '{DEFAULT_MIME}') "
                               f"AS content_type FROM pages",
        "file_scan": "SELECT 'htm' AS extension, 'html' AS extractor, "
                     + SH.extract_title(r"regexp_replace(html, '[\r\n]+', ' ', 'g')") + " AS title FROM pages "
                     "WHERE html IS NOT NULL",
        "index_sink": OI.sql_term_statistics(),
        "rewrite_uri": (f"SELECT CAST(doc_id AS BIGINT) AS doc_id, '{PUBLIC_PREFIX}' || CAST(doc_id AS VARCHAR) "
                        f"AS url FROM documents"),
        "stream_visited_dedup": f"WITH {_pages_crawl_ctes(PAGES_CRAWL)} SELECT url FROM lvl0",
        "stream_etag_dedup": (f"WITH d AS (SELECT doc_id, md5(text) AS etag, row_number() OVER (PARTITION BY md5(text) "
                              f"ORDER BY doc_id) AS rn FROM documents) SELECT '{DOC_URL_PREFIX}' || "
                              f"CAST(doc_id AS VARCHAR) AS url, etag, doc_id FROM d WHERE rn = 1 OR etag IS NULL"),
        "stream_index_append": OI.sql_postings(),
    }
