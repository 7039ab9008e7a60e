"""Page sources (A1-A3): seeds, the captured-page table as the "fetcher",
and the fetch outcome route.

Fetching over the network is replaced by an equi-join of the frontier with
a table of captured pages keyed by normalised URL; a URL without a capture
is a fetch error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.html import content_route
from ..operators.dedup import first_per_key
from ..operators.filters import CrawlConfig, http_chain

CAPTURE_SCHEMA = ("page_id bigint, url string, html string, status int, content_type string, "
                  "etag string, redirect_to string")


def seed_frontier(spark: SparkSession, start_urls, cfg: CrawlConfig) -> DataFrame:
    """A1: start URLs -> depth-0 frontier rows ``(url, referrer, depth, pos)``.

    ``start_urls``: a list (must not be empty) or a DataFrame with a ``url``
    column. Only http(s)/file prefixes make a document; the seeds then pass
    the same chain as links (without referrer).
    """
    if isinstance(start_urls, DataFrame):
        df = start_urls.select(F.col("url").alias("href"))
    else:
        urls = list(start_urls)
        if not urls:
            raise ValueError("no start urls given")
        df = spark.createDataFrame([(u,) for u in urls], "href string")
    d = df.where(U.is_seed_url("href")).withColumn("depth", F.lit(0)).withColumn(
        "referrer", F.lit(None).cast("string"))
    d = http_chain(d, cfg, href="href", referrer="referrer", depth="depth")
    d = d.select("url", "referrer", "depth", F.lit(0).alias("pos"))
    return first_per_key(d, "url", ["depth", "referrer", "pos"])


def capture_index(captures: DataFrame, cfg: CrawlConfig) -> DataFrame:
    """A2 prep: one capture per normalised URL (lowest ``page_id``), with the
    redirect target already resolved and passed through the chain (D4).

    Columns: ``url, page_id, status, content_type, etag, redirect_url``.
    """
    c = captures.select("page_id", "url", "status", "content_type", "etag", "redirect_to",
                        U.normalize("url", cfg.index_document, cfg.remove_trailing_slash).alias("url_norm"))
    c = c.where(F.col("url_norm").isNotNull())
    c = first_per_key(c.select("url_norm", "page_id", "url", "status", "content_type", "etag", "redirect_to"),
                      "url_norm", ["page_id"])
    red = http_chain(c.where(F.col("redirect_to").isNotNull())
                     .select("url_norm", F.col("redirect_to").alias("href"), F.col("url_norm").alias("referrer")),
                     cfg, href="href", referrer="referrer", depth=None, out="redirect_url")
    red = red.select("url_norm", "redirect_url")
    return (c.join(red, "url_norm", "left")
            .select(F.col("url_norm").alias("url"), "page_id", "status", "content_type", "etag",
                    F.when(F.col("redirect_to").isNotNull() & (F.col("redirect_to") != F.col("url")),
                           F.coalesce("redirect_url", F.lit(""))).alias("redirect_url")))


def status_route(status, redirect_url, page_id) -> F.Column:
    """A3: ``redirect`` when the fetch ended elsewhere, ``success`` on 200,
    ``fetch_error`` without a capture, ``dropped`` for 404 and the rest."""
    s, r, p = (F.col(x) if isinstance(x, str) else x for x in (status, redirect_url, page_id))
    return (F.when(p.isNull(), F.lit("fetch_error"))
            .when(r.isNotNull(), F.lit("redirect"))
            .when(s == 200, F.lit("success"))
            .otherwise(F.lit("dropped")))


def fetch(frontier: DataFrame, cap_index: DataFrame, few: bool = False) -> DataFrame:
    """A2 + A3: frontier rows with their capture and route.

    A left join can only broadcast its right side (the big capture table),
    so the captures hit by this frontier are found first with a semi join
    (the frontier is broadcast by AQE when small at runtime) and the left
    join runs against those few rows.
    """
    hit = cap_index.join(frontier.select("url"), "url", "left_semi")
    return routed(frontier.join(hit, "url", "left"))


def routed(f: DataFrame) -> DataFrame:
    """A3: captures with their route and, of a success, their extractor."""
    return f.withColumn("route", status_route("status", "redirect_url", "page_id")).withColumn(
        "extractor", F.when(F.col("route") == "success", content_route("content_type")))
