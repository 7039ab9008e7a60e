"""All registered queries and their DuckDB oracles, gathered by family."""

from __future__ import annotations

from . import catalog_crawl, catalog_html, catalog_index, catalog_sources, catalog_urls

FAMILIES = (catalog_index, catalog_html, catalog_urls, catalog_crawl, catalog_sources)


def queries():
    out = {}
    for m in FAMILIES:
        out.update(m.QUERIES)
    return out


def oracle_sql():
    out = {}
    for m in FAMILIES:
        out.update(m.oracle())
    return out
