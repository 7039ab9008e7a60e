"""Registered crawl queries: seeds, fetch, routes, BFS loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators.filters import CrawlConfig
from ..operators.graph import crawl
from ..sources.pages import capture_index, fetch, seed_frontier
from . import sql_html as SH
from . import sql_urls as SU
from .catalog_urls import chain_sql
from .tables import DOC_LINK_RULE, DOC_SITE, captures, doc_graph, read

# Fixed parameters: a crawl of the captured sites (spam hosts excluded),
# seeded with every captured URL, run to its fixpoint.
PAGES_CRAWL = CrawlConfig(include_hosts=None, exclude_documents=(r"spam-farm\.", r"cheap-pills\."))
DOCS_CRAWL = CrawlConfig(include_hosts=None)
DOCS_SHALLOW = CrawlConfig(include_hosts=None, max_depth=2)


def _seeds(spark, sf):
    return read(spark, sf, "pages").select("url")


def q_seed_frontier(spark, sf):
    return seed_frontier(spark, _seeds(spark, sf), PAGES_CRAWL).select("url", "depth")


def q_page_scan(spark, sf):
    lvl = seed_frontier(spark, _seeds(spark, sf), PAGES_CRAWL)
    return fetch(lvl, capture_index(captures(spark, sf), PAGES_CRAWL)).select(
        "url", "page_id", "status", "content_type", "etag", "redirect_url")


def q_status_route(spark, sf):
    lvl = seed_frontier(spark, _seeds(spark, sf), PAGES_CRAWL)
    return (fetch(lvl, capture_index(captures(spark, sf), PAGES_CRAWL))
            .groupBy("route").agg(F.count(F.lit(1)).alias("n")))


def _crawl_pages(spark, sf):
    return crawl(spark, _seeds(spark, sf), captures(spark, sf), PAGES_CRAWL)


def q_crawl_pages(spark, sf):
    return _crawl_pages(spark, sf).fetched(spark).select("url", "depth", "referrer", "page_id", "route")


def q_redirect_requeue(spark, sf):
    return (_crawl_pages(spark, sf).frontier(spark).where(F.col("pos") == -1)
            .select("url", "referrer", "depth"))


def _crawl_docs(spark, sf, cfg, use_etags):
    caps, edges, seeds = doc_graph(spark, sf)
    return crawl(spark, seeds, caps, cfg, edges=edges, use_etags=use_etags)


def q_crawl_index_pages(spark, sf):
    """The main run: crawl the captured sites, extract and index the kept pages."""
    from .site_index import crawled_documents
    caps = captures(spark, sf)
    return crawled_documents(spark, _crawl_pages(spark, sf), caps)


def q_crawl_frontier(spark, sf):
    return _crawl_docs(spark, sf, DOCS_CRAWL, False).frontier(spark).select("url", "referrer", "depth")


def q_depth_filter(spark, sf):
    return _crawl_docs(spark, sf, DOCS_SHALLOW, False).frontier(spark).select("url", "referrer", "depth")


def q_crawl_etag(spark, sf):
    """D3 with D2 inside the loop: exact copies (same md5) are fetched but
    neither indexed nor expanded. Checked against a brute-force BFS in tests."""
    return _crawl_docs(spark, sf, DOCS_CRAWL, True).kept(spark).select("url", "page_id", "depth")


QUERIES = {
    "seed_frontier": q_seed_frontier,
    "page_scan": q_page_scan,
    "status_route": q_status_route,
    "crawl_pages": q_crawl_pages,
    "redirect_requeue": q_redirect_requeue,
    "crawl_index_pages": q_crawl_index_pages,
    "crawl_frontier": q_crawl_frontier,
    "depth_filter": q_depth_filter,
    "crawl_etag": q_crawl_etag,
}


# ------------------------------------------------------------------ oracle
def _pages_crawl_ctes(cfg: CrawlConfig) -> str:
    seed_url, seed_where = chain_sql(cfg, "url", "CAST(NULL AS VARCHAR)")
    red_url, red_where = chain_sql(cfg, "redirect_to", "url_norm")
    link_url, link_where = chain_sql(cfg, "href", "src_url")
    norm = SU.normalize("url", cfg.index_document, cfg.remove_trailing_slash)
    return f"""{SH.captures_cte()},
cap0 AS (
  SELECT * FROM (SELECT *, {norm} AS url_norm,
                        row_number() OVER (PARTITION BY {norm} ORDER BY page_id) AS rn FROM captures)
  WHERE rn = 1 AND url_norm IS NOT NULL),
red AS (
  SELECT url_norm, r AS redirect_url FROM (
    SELECT url_norm, {red_url} AS r FROM cap0 WHERE redirect_to IS NOT NULL AND {red_where})
  WHERE {SU.chain_where('r', cfg)}),
cap AS (
  SELECT c.url_norm AS url, c.page_id, c.status, c.content_type, c.etag,
         CASE WHEN c.redirect_to IS NOT NULL AND c.redirect_to <> c.url THEN coalesce(red.redirect_url, '') END
           AS redirect_url
  FROM cap0 c LEFT JOIN red USING (url_norm)),
lvl0 AS (
  SELECT DISTINCT u AS url, CAST(NULL AS VARCHAR) AS referrer, 0 AS pos FROM (
    SELECT {seed_url} AS u FROM pages WHERE regexp_matches(url, {SH.q(U.SEED_SCHEMES)}) AND {seed_where})
  WHERE {SU.chain_where('u', cfg)}),
f0 AS (
  SELECT l.url, l.referrer, l.pos, 0 AS depth, cap.page_id, cap.status, cap.content_type, cap.etag,
         cap.redirect_url,
         CASE WHEN cap.page_id IS NULL THEN 'fetch_error' WHEN cap.redirect_url IS NOT NULL THEN 'redirect'
              WHEN cap.status = 200 THEN 'success' ELSE 'dropped' END AS route
  FROM lvl0 l LEFT JOIN cap USING (url)),
kept0 AS (
  SELECT url, page_id, content_type FROM f0 WHERE route = 'success' AND (etag IS NULL OR etag = '')
  UNION ALL
  SELECT url, page_id, content_type FROM (
    SELECT url, page_id, content_type, row_number() OVER (PARTITION BY etag ORDER BY url) AS rn
    FROM f0 WHERE route = 'success' AND etag <> '') WHERE rn = 1),
srcpages AS (
  SELECT * FROM (SELECT {norm} AS src_url, page_id, html,
                        row_number() OVER (PARTITION BY {norm} ORDER BY page_id) AS rn
                 FROM captures WHERE status = 200 AND {SH.content_route('content_type')} = 'html')
  WHERE rn = 1 AND src_url IS NOT NULL),
hrefs AS (
  SELECT src_url, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS href
  FROM (SELECT src_url, {SH.extract_links('html')} AS l FROM srcpages)),
edges AS (
  SELECT src_url, dst_url, pos FROM (
    SELECT src_url, pos, {link_url} AS dst_url FROM hrefs WHERE {link_where})
  WHERE {SU.chain_where('dst_url', cfg)}),
cand1 AS (
  SELECT e.dst_url AS url, e.src_url AS referrer, e.pos FROM kept0 k JOIN edges e ON e.src_url = k.url
  WHERE {SH.content_route('k.content_type')} = 'html'
  UNION ALL
  SELECT redirect_url, url, -1 FROM f0 WHERE route = 'redirect' AND redirect_url <> ''),
lvl1 AS (
  SELECT url, referrer, pos FROM (
    SELECT *, row_number() OVER (PARTITION BY url ORDER BY referrer, pos) AS rn FROM cand1)
  WHERE rn = 1 AND url NOT IN (SELECT url FROM lvl0)),
f1 AS (
  SELECT l.url, l.referrer, l.pos, 1 AS depth, cap.page_id, cap.etag, cap.content_type,
         CASE WHEN cap.page_id IS NULL THEN 'fetch_error' WHEN cap.redirect_url IS NOT NULL THEN 'redirect'
              WHEN cap.status = 200 THEN 'success' ELSE 'dropped' END AS route
  FROM lvl1 l LEFT JOIN cap USING (url)),
kept1 AS (
  SELECT url, page_id, content_type FROM f1 WHERE route = 'success' AND (etag IS NULL OR etag = '')
  UNION ALL
  SELECT url, page_id, content_type FROM (
    SELECT url, page_id, content_type, row_number() OVER (PARTITION BY etag ORDER BY url) AS rn
    FROM f1 WHERE route = 'success' AND etag <> ''
      AND etag NOT IN (SELECT etag FROM f0 k0 WHERE k0.url IN (SELECT url FROM kept0) AND etag IS NOT NULL))
  WHERE rn = 1)"""


def _doc_graph_ctes(max_depth: int | None) -> str:
    edges = " UNION ALL ".join(
        f"SELECT '{DOC_SITE}' || CAST(doc_id AS VARCHAR) AS src, "
        f"'{DOC_SITE}' || CAST(({a} * doc_id + {b}) % (SELECT n FROM cnt) AS VARCHAR) AS dst, {i} AS pos "
        f"FROM documents"
        for i, (a, b) in enumerate(DOC_LINK_RULE))
    bound = "(SELECT n FROM cnt)" if max_depth is None else str(max_depth)
    return f"""RECURSIVE cnt AS (SELECT count(*) AS n FROM documents),
nodes AS (SELECT '{DOC_SITE}' || CAST(doc_id AS VARCHAR) AS url FROM documents),
edges AS ({edges}),
seeds AS (SELECT DISTINCT '{DOC_SITE}' || CAST(min(doc_id) AS VARCHAR) AS url FROM documents GROUP BY source),
reach(url, depth) AS (
  SELECT url, 0 FROM seeds
  UNION
  SELECT e.dst, r.depth + 1 FROM reach r JOIN nodes nd ON nd.url = r.url JOIN edges e ON e.src = r.url
  WHERE r.depth < {bound}),
depths AS (SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM reach GROUP BY url),
parents AS (
  SELECT c.url, c.depth, e.src AS referrer,
         row_number() OVER (PARTITION BY c.url ORDER BY e.src, e.pos) AS rn
  FROM depths c JOIN edges e ON e.dst = c.url JOIN depths p ON p.url = e.src AND p.depth = c.depth - 1
  JOIN nodes nd ON nd.url = e.src)"""


def _doc_graph_sql(max_depth: int | None) -> str:
    return (f"WITH {_doc_graph_ctes(max_depth)} "
            f"SELECT url, CAST(NULL AS VARCHAR) AS referrer, depth FROM depths WHERE depth = 0 "
            f"UNION ALL SELECT url, referrer, depth FROM parents WHERE rn = 1 AND depth > 0")


def oracle() -> dict[str, str]:
    ctes = _pages_crawl_ctes(PAGES_CRAWL)
    return {
        "seed_frontier": f"WITH {ctes} SELECT url, 0 AS depth FROM lvl0",
        "page_scan": f"WITH {ctes} SELECT url, page_id, status, content_type, etag, redirect_url FROM f0",
        "status_route": f"WITH {ctes} SELECT route, count(*) AS n FROM f0 GROUP BY route",
        "crawl_pages": (f"WITH {ctes} SELECT url, depth, referrer, page_id, route FROM f0 "
                        f"UNION ALL SELECT url, depth, referrer, page_id, route FROM f1"),
        "redirect_requeue": f"WITH {ctes} SELECT url, referrer, 1 AS depth FROM lvl1 WHERE pos = -1",
        "crawl_index_pages": (
            f"WITH {ctes}, k AS (SELECT url, page_id, content_type FROM kept0 UNION ALL "
            f"SELECT url, page_id, content_type FROM kept1) "
            f"SELECT k.page_id AS doc_id, k.url, {SH.extract_title('c.html')} AS title, "
            f"{SH.extract_content('c.html')} AS data FROM k JOIN captures c USING (page_id) "
            f"WHERE {SH.content_route('k.content_type')} = 'html'"),
        "crawl_frontier": _doc_graph_sql(None),
        "depth_filter": _doc_graph_sql(DOCS_SHALLOW.max_depth),
    }
