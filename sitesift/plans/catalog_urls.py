"""Registered URL, filter and dedup queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U
from ..operators import filters as C
from ..operators.dedup import etag_dedup, first_per_key
from ..operators.graph import degree_counts, link_edges
from . import sql_html as SH
from . import sql_urls as SU
from .tables import captures, read

# Fixed parameters of the registered queries (illustrative site settings).
INDEX_DOCUMENT = "index.html"
INCLUDE_DOCUMENTS = (r"\.html$", r"/en/")
EXCLUDE_DOCUMENTS = (r"spam-farm\.", r"cheap-pills\.", r"utm_source=")
PATH_INCLUDE = (r"^/(en|de)/",)
PATH_EXCLUDE = (r"\.html$",)
# Site crawl over captured pages: every host passes, spam hosts excluded.
SITE = C.CrawlConfig(include_hosts=None, exclude_documents=EXCLUDE_DOCUMENTS)
DOC_HOST_URL = "http://docs.test/"
# A link's target is also written as the file of a local copy of the site.
WEB_PREFIX, FILE_PREFIX = r"^https?://", "file:///"


def _pages(spark, sf) -> DataFrame:
    return read(spark, sf, "pages")


def _hrefs(spark, sf) -> DataFrame:
    """(page_id, src_url, pos, href): every extracted link of every page."""
    p = _pages(spark, sf).select("page_id", U.strip_fragment("url").alias("src_url"),
                                 H.extract_links("html").alias("links"))
    return p.select("page_id", "src_url", F.posexplode("links").alias("pos", "href"))


HREFS_SQL = (f"hrefs AS (SELECT page_id, {SU.strip_fragment('url')} AS src_url, "
             f"generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS href "
             f"FROM (SELECT page_id, url, {SH.extract_links('html')} AS l FROM pages))")


def q_uri_split(spark, sf):
    s = U.split_uri("url")
    return _pages(spark, sf).select("page_id", s["scheme"].alias("scheme"), s["host"].alias("host"),
                                    s["port"].alias("port"), s["path"].alias("path"), s["query"].alias("query"),
                                    s["fragment"].alias("fragment"))


def q_drop_empty_and_file_children(spark, sf):
    return _hrefs(spark, sf).where(U.is_followable_href("href")).select("page_id", "pos", "href")


def q_resolve_relative_uri(spark, sf):
    return U.with_resolved(_hrefs(spark, sf), "href", "src_url", "url").select("page_id", "pos", "href", "url")


def q_strip_fragment(spark, sf):
    return _pages(spark, sf).select("page_id", U.strip_fragment("url").alias("url"))


def q_append_index_document(spark, sf):
    return _pages(spark, sf).select("page_id", U.normalize("url", INDEX_DOCUMENT).alias("url"))


def q_remove_trailing_slash(spark, sf):
    return _pages(spark, sf).select("page_id", U.normalize("url", None, True).alias("url"))


def _link_forms(spark, sf):
    """Every link as written, as resolved, and as the file that holds a copy of its target."""
    links = U.with_resolved(_hrefs(spark, sf), "href", "src_url", "url")
    forms = {"written": F.col("href"), "resolved": F.col("url"),
             "file": F.regexp_replace("url", WEB_PREFIX, FILE_PREFIX)}
    return links.select("page_id", "pos", F.inline(F.array(*[F.struct(F.lit(k).alias("form"), v.alias("link"))
                                                             for k, v in forms.items()])))


def q_scheme_filter_http(spark, sf):
    return _link_forms(spark, sf).where(C.scheme_http("link"))


def q_scheme_filter_file(spark, sf):
    return _link_forms(spark, sf).where(C.scheme_file("link"))


def q_hostname_filter(spark, sf):
    """Resolved links kept when their host is one of the captured sites
    (a semi join: the host set grows with the data, so it is not inlined)."""
    links = U.with_resolved(_hrefs(spark, sf), "href", "src_url", "url").select("page_id", "pos", "url")
    hosts = _pages(spark, sf).select(U.uri_host("url").alias("host"))
    return C.filter_hosts(links.withColumn("host", U.uri_host("url")), "host", hosts).select("page_id", "pos", "url")


def q_url_inclusion_filter(spark, sf):
    return _pages(spark, sf).where(C.url_included("url", INCLUDE_DOCUMENTS)).select("page_id", "url")


def q_url_exclusion_filter(spark, sf):
    return _pages(spark, sf).where(~C.url_excluded("url", EXCLUDE_DOCUMENTS)).select("page_id", "url")


def q_path_inclusion_filter(spark, sf):
    return _pages(spark, sf).where(C.path_included("url", PATH_INCLUDE)).select("page_id", "url")


def q_path_exclusion_filter(spark, sf):
    return _pages(spark, sf).where(~C.path_excluded("url", PATH_EXCLUDE)).select("page_id", "url")


def q_filter_chain(spark, sf):
    cfg = C.CrawlConfig(include_hosts=None, index_document=INDEX_DOCUMENT, exclude_documents=EXCLUDE_DOCUMENTS)
    return C.http_chain(_hrefs(spark, sf), cfg, href="href", referrer="src_url", depth=None).select(
        "page_id", "pos", "href", "url")


def q_needs_indexing(spark, sf):
    """Captures of which a title or a body was extracted: no bodies, and types that are
    not HTML, have neither."""
    from ..operators.extract import dispatch, extract_pages
    d = dispatch(captures(spark, sf))
    d = d.withColumn("html", F.when(F.col("extractor") == "html", F.col("html")))
    return C.needs_indexing(extract_pages(d, keep=("page_id",))).select("page_id")


def q_link_edges(spark, sf):
    p = _pages(spark, sf).select(U.normalize("url").alias("url"), H.extract_links("html").alias("links"))
    return link_edges(p, SITE)


def q_link_degrees(spark, sf):
    return degree_counts(q_link_edges(spark, sf))


def q_visited_dedup(spark, sf):
    e = q_filter_chain(spark, sf).select("url", "page_id", "pos")
    return first_per_key(e, "url", ["page_id", "pos"])


def q_etag_dedup(spark, sf):
    d = read(spark, sf, "documents").select(
        F.concat(F.lit(DOC_HOST_URL), F.col("doc_id").cast("string")).alias("url"),
        F.lit(0).alias("depth"), F.md5("text").alias("etag"))
    return etag_dedup(d).select("url", "etag")


QUERIES = {
    "uri_split": q_uri_split,
    "drop_empty_and_file_children": q_drop_empty_and_file_children,
    "resolve_relative_uri": q_resolve_relative_uri,
    "strip_fragment": q_strip_fragment,
    "append_index_document": q_append_index_document,
    "remove_trailing_slash": q_remove_trailing_slash,
    "scheme_filter_http": q_scheme_filter_http,
    "scheme_filter_file": q_scheme_filter_file,
    "hostname_filter": q_hostname_filter,
    "url_inclusion_filter": q_url_inclusion_filter,
    "url_exclusion_filter": q_url_exclusion_filter,
    "path_inclusion_filter": q_path_inclusion_filter,
    "path_exclusion_filter": q_path_exclusion_filter,
    "filter_chain": q_filter_chain,
    "needs_indexing": q_needs_indexing,
    "link_edges": q_link_edges,
    "link_degrees": q_link_degrees,
    "visited_dedup": q_visited_dedup,
    "etag_dedup": q_etag_dedup,
}


def chain_sql(cfg: C.CrawlConfig, href: str, ref: str) -> tuple[str, str]:
    """(url expression, where clause) of the stateless http chain."""
    url = SU.normalize(SU.resolve(href, ref), cfg.index_document, cfg.remove_trailing_slash)
    where = f"{SU.followable(href)} AND {SU.scheme_http(href)}"
    return url, where


def oracle() -> dict[str, str]:
    w = "WITH " + HREFS_SQL + " "
    forms = (w + f", resolved AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, href, "
             f"{SU.resolve('href', 'src_url')} AS url FROM hrefs), "
             f"forms AS (SELECT page_id, pos, 'written' AS form, href AS link FROM resolved "
             f"UNION ALL SELECT page_id, pos, 'resolved', url FROM resolved "
             f"UNION ALL SELECT page_id, pos, 'file', regexp_replace(url, '^https?://', 'file:///') FROM resolved) ")
    fc = C.CrawlConfig(include_hosts=None, index_document=INDEX_DOCUMENT, exclude_documents=EXCLUDE_DOCUMENTS)
    fc_url, fc_where = chain_sql(fc, "href", "src_url")
    chain = (w + f", c AS (SELECT page_id, pos, href, {fc_url} AS url FROM hrefs WHERE {fc_where}) "
             f"SELECT page_id, pos, href, url FROM c WHERE {SU.chain_where('url', fc)}")
    site_url, site_where = chain_sql(SITE, "href", "src_url")
    edges = (w + f", c AS (SELECT src_url, pos, {site_url} AS dst_url FROM hrefs WHERE {site_where}) "
             f"SELECT src_url, dst_url, CAST(pos AS INTEGER) AS pos FROM c WHERE {SU.chain_where('dst_url', SITE)}")
    split = {k: SU.part("url", k) for k in ("scheme", "path", "query", "fragment")}
    auth = SU.part("url", "authority")
    return {
        "uri_split": (f"SELECT page_id, {split['scheme']} AS scheme, {SU._auth(auth, 2)} AS host, "
                      f"CAST({SU._auth(auth, 3)} AS INTEGER) AS port, {split['path']} AS path, "
                      f"{split['query']} AS query, {split['fragment']} AS fragment FROM pages"),
        "drop_empty_and_file_children": w + f"SELECT page_id, CAST(pos AS INTEGER) AS pos, href FROM hrefs "
                                            f"WHERE {SU.followable('href')}",
        "resolve_relative_uri": w + f"SELECT page_id, CAST(pos AS INTEGER) AS pos, href, "
                                    f"{SU.resolve('href', 'src_url')} AS url FROM hrefs",
        "strip_fragment": f"SELECT page_id, {SU.strip_fragment('url')} AS url FROM pages",
        "append_index_document": f"SELECT page_id, {SU.normalize('url', INDEX_DOCUMENT)} AS url FROM pages",
        "remove_trailing_slash": f"SELECT page_id, {SU.normalize('url', None, True)} AS url FROM pages",
        "scheme_filter_http": forms + f"SELECT * FROM forms WHERE {SU.scheme_http('link')}",
        "scheme_filter_file": forms + f"SELECT * FROM forms WHERE {SU.scheme_file('link')}",
        "hostname_filter": w + f", l AS (SELECT page_id, pos, {SU.resolve('href', 'src_url')} AS url FROM hrefs) "
                               f"SELECT page_id, CAST(pos AS INTEGER) AS pos, url FROM l "
                               f"WHERE {SU.host('url')} IN (SELECT {SU.host('url')} FROM pages)",
        "url_inclusion_filter": f"SELECT page_id, url FROM pages WHERE {SU.any_match('url', INCLUDE_DOCUMENTS)}",
        "url_exclusion_filter": f"SELECT page_id, url FROM pages WHERE NOT {SU.any_match('url', EXCLUDE_DOCUMENTS)}",
        "path_inclusion_filter": f"SELECT page_id, url FROM pages WHERE "
                                 f"coalesce({SU.any_match(SU.part('url', 'path'), PATH_INCLUDE)}, FALSE)",
        "path_exclusion_filter": f"SELECT page_id, url FROM pages WHERE NOT "
                                 f"coalesce({SU.any_match(SU.part('url', 'path'), PATH_EXCLUDE)}, FALSE)",
        "filter_chain": chain.replace("SELECT page_id, pos, href, url FROM c",
                                      "SELECT page_id, CAST(pos AS INTEGER) AS pos, href, url FROM c"),
        "needs_indexing": (f"WITH {SH.captures_cte()} SELECT page_id FROM (SELECT page_id, "
                           f"{SH.extract_title('html')} AS t, {SH.extract_content('html')} AS c FROM captures "
                           f"WHERE {SH.content_route('content_type')} = 'html' AND html IS NOT NULL) "
                           f"WHERE t IS NOT NULL OR c IS NOT NULL"),
        "link_edges": edges,
        "link_degrees": (f"WITH e AS ({edges}), o AS (SELECT src_url AS url, count(*) AS out_degree FROM e GROUP BY 1), "
                         f"i AS (SELECT dst_url AS url, count(*) AS in_degree FROM e GROUP BY 1) "
                         f"SELECT coalesce(o.url, i.url) AS url, coalesce(out_degree, 0) AS out_degree, "
                         f"coalesce(in_degree, 0) AS in_degree FROM o FULL OUTER JOIN i ON o.url = i.url"),
        "visited_dedup": (f"WITH c AS ({chain}) SELECT url, page_id, CAST(pos AS INTEGER) AS pos FROM "
                          f"(SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id, pos) AS rn FROM c) "
                          f"WHERE rn = 1"),
        "etag_dedup": (f"WITH d AS (SELECT '{DOC_HOST_URL}' || CAST(doc_id AS VARCHAR) AS url, md5(text) AS etag "
                       f"FROM documents) SELECT url, etag FROM d WHERE etag IS NULL OR etag = '' "
                       f"UNION ALL SELECT min(url) AS url, etag FROM d WHERE etag <> '' GROUP BY etag"),
    }
