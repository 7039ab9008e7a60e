"""The reference's main run as one Spark plan: crawl a site from start URLs
over a table of captures, extract the kept documents, index them.

    http(s) seeds: crawl (D3)  ->  kept documents  ⋈ captures (page_id)   \
    file:// seeds: file_scan (A4), no links followed                        >  one set of documents
                ->  extract_documents by content type (E1, E11)  ->  needs_indexing (C10)
                ->  rewrite_uri hook (A7) ->  Index.build (F)  ->  write (A6)
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import Analyzer
from ..operators.extract import DEFAULT_CONTENT, DEFAULT_TITLE
from ..operators.extractors import UNSUPPORTED, Extractor, extract_documents, route
from ..operators.filters import CrawlConfig, needs_indexing
from ..operators.graph import CrawlResult, crawl
from ..operators.index import Index
from ..sources.index_store import write_index


def crawled_bodies(spark: SparkSession, result: CrawlResult, captures: DataFrame,
                   extractors: tuple[Extractor, ...] = ()) -> DataFrame:
    """``(page_id, url, content_type, body)`` of the kept documents that an extractor takes."""
    kept = result.kept(spark).where(route("content_type", extractors) != UNSUPPORTED).select("url", "page_id", "content_type")
    return kept.join(captures.select("page_id", F.col("html").alias("body")), "page_id")


def file_bodies(spark: SparkSession, roots: list[str], cfg: CrawlConfig | None,
                extractors: tuple[Extractor, ...] = ()) -> DataFrame:
    """``(url, content_type, body)`` of the listed files that an extractor takes."""
    from ..sources.files import file_scan
    files = file_scan(spark, roots, cfg).where(route("content_type", extractors) != UNSUPPORTED)
    return files.select("url", "content_type", F.decode("content", "UTF-8").alias("body"))


def as_documents(found: DataFrame, doc_id: Column, rewrite_uri: Callable[[Column], Column] | None) -> DataFrame:
    url = rewrite_uri(F.col("url")) if rewrite_uri else F.col("url")
    return needs_indexing(found).select(doc_id.alias("doc_id"), url.alias("url"), "title", F.col("content").alias("data"))


def crawled_documents(spark: SparkSession, result: CrawlResult, captures: DataFrame,
                      title=DEFAULT_TITLE, content=DEFAULT_CONTENT,
                      title_hook: Callable[[Column], Column] | None = None,
                      rewrite_uri: Callable[[Column], Column] | None = None,
                      extractors: tuple[Extractor, ...] = ()) -> DataFrame:
    """Index documents ``(doc_id, url, title, data)`` of a finished crawl."""
    bodies = crawled_bodies(spark, result, captures, extractors)
    found = extract_documents(bodies, extractors=extractors, keep=("page_id", "url"), title=title, content=content,
                              title_hook=title_hook)
    return as_documents(found, F.col("page_id"), rewrite_uri)


def file_roots(start_urls) -> tuple[object, list[str]]:
    """(start URLs that are crawled, file:// ones). The latter are folders or files that a
    configuration names, so their list is small."""
    if isinstance(start_urls, DataFrame):
        of_files = F.lower("url").startswith("file:")
        return start_urls.where(~of_files), sorted(r["url"] for r in start_urls.where(of_files).select("url").distinct().collect())
    urls = list(start_urls)
    return [u for u in urls if not u.lower().startswith("file:")], [u for u in urls if u.lower().startswith("file:")]


def build_site_index(spark: SparkSession, start_urls, captures: DataFrame, cfg: CrawlConfig,
                     index_path: str | None = None, create: bool = True, analyzer: Analyzer = Analyzer(),
                     file_cfg: CrawlConfig | None = None, title=DEFAULT_TITLE, content=DEFAULT_CONTENT,
                     title_hook: Callable[[Column], Column] | None = None,
                     rewrite_uri: Callable[[Column], Column] | None = None,
                     extractors: tuple[Extractor, ...] = ()):
    """Crawl, extract and index; writes the index when ``index_path`` is given.

    ``start_urls`` may mix http(s) and file:// URLs (A1). Files and folders are listed
    recursively, filtered by ``file_cfg`` (path patterns) and indexed beside the crawled
    pages; links in them are not followed. With files, every document's id is the hash
    of its URL, else the id of its capture. ``extractors`` take further content types.
    Returns ``(crawl_result, index)``; the former is None without a URL to crawl.
    """
    crawled, roots = file_roots(start_urls)
    is_table = isinstance(crawled, DataFrame)
    if not roots and not is_table and not crawled:
        raise ValueError("no start urls given")
    options = dict(extractors=extractors, title=title, content=content, title_hook=title_hook)
    result, docs = None, None
    if is_table or crawled:
        result = crawl(spark, crawled, captures, cfg)
        docs = crawled_documents(spark, result, captures, rewrite_uri=rewrite_uri, **options)
    if roots:
        files = extract_documents(file_bodies(spark, roots, file_cfg, extractors), **options)
        files = as_documents(files, F.lit(None).cast("bigint"), rewrite_uri)
        docs = hashed_doc_ids(files if docs is None else docs.unionByName(files))
    index = Index.build(docs, analyzer=analyzer)
    if index_path:
        write_index(index, index_path, create=create)
    return result, index


def hashed_doc_ids(docs: DataFrame, url_col: str = "url") -> DataFrame:
    """``doc_id = xxhash64(url)`` for sources without a key (file trees).

    Never a global ``row_number`` (one task). Collisions are checked with one
    aggregate: a repeated id for different URLs raises.
    """
    d = docs.withColumn("doc_id", F.xxhash64(url_col))
    clash = (d.groupBy("doc_id").agg(F.countDistinct(url_col).alias("n")).where(F.col("n") > 1)
             .limit(1).count())
    if clash:
        raise ValueError("doc_id hash collision between different URLs")
    return d


def build_file_index(spark: SparkSession, root: str, cfg: CrawlConfig | None = None, index_path: str | None = None,
                     create: bool = True, rewrite_uri: Callable[[Column], Column] | None = None,
                     extractors: tuple[Extractor, ...] = (), analyzer: Analyzer = Analyzer()) -> Index:
    """A file-tree run: list (A4), type by extension (A5), extract by type (E1,
    E11), keep documents with content (C10), rewrite URIs (A7), index (F)."""
    found = extract_documents(file_bodies(spark, [root], cfg, extractors), extractors=extractors)
    docs = hashed_doc_ids(as_documents(found, F.lit(None).cast("bigint"), rewrite_uri))
    index = Index.build(docs.select("doc_id", "url", "title", "data"), analyzer=analyzer)
    if index_path:
        write_index(index, index_path, create=create)
    return index
