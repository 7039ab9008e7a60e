"""Benchmark the headline queries and print one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every query is run to completion through the ``noop`` sink (no collect), so
the time covers the whole plan. Derived rates (pages/s, queries/s, s per
crawl level) are reported next to the per-query seconds.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from sitesift.session import get_spark, scratch_path  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(cpus, 2),
                      extra={"spark.driver.memory": "16g"})
    from sitesift.operators import search as se
    from sitesift.operators.extract import extract_pages
    from sitesift.operators.graph import crawl
    from sitesift.operators.index import Index
    from sitesift.plans import catalog_crawl as cc
    from sitesift.plans import catalog_urls as cu
    from sitesift.plans.tables import benchmark_queries, captures, doc_graph, documents_as_docs, read
    from sitesift.sources.index_store import read_index, write_index

    def run(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    timings: dict[str, float] = {}
    extra: dict[str, float] = {}

    def timed(name, fn):
        t = time.time()
        out = fn()
        timings[name] = round(time.time() - t, 3)
        return out

    # warm-up: JVM, codegen caches (not timed)
    run(read(spark, sf_dir, "pages").limit(10).select(F.length("html")))

    n_pages = read(spark, sf_dir, "pages").count()
    timed("extract_pages", lambda: run(extract_pages(read(spark, sf_dir, "pages"))))
    extra["extract_pages_per_sec"] = round(n_pages / max(timings["extract_pages"], 1e-9), 1)

    timed("filter_chain", lambda: run(cu.q_filter_chain(spark, sf_dir)))

    idx_path = scratch_path(spark, "bench-index")
    built = timed("index_build", lambda: write_index(Index.build(documents_as_docs(spark, sf_dir)), idx_path))
    extra["index_docs_per_sec"] = round(built.indexed_documents / max(timings["index_build"], 1e-9), 1)
    index = read_index(spark, idx_path)

    queries = benchmark_queries(spark, sf_dir)
    n_q = queries.count()
    timed("search", lambda: run(se.search(index, queries)))
    extra["search_queries_per_sec"] = round(n_q / max(timings["search"], 1e-9), 2)
    timed("search_page2", lambda: run(se.search(index, benchmark_queries(spark, sf_dir, offset=10))))
    timed("search_highlight", lambda: run(se.search(index, queries, se.SearchOptions(highlight=True))))

    res = timed("crawl_pages", lambda: crawl(spark, read(spark, sf_dir, "pages").select("url"),
                                             captures(spark, sf_dir), cc.PAGES_CRAWL))
    extra["crawl_pages_sec_per_level"] = round(timings["crawl_pages"] / max(res.levels, 1), 3)

    # multi-level loop on the link graph derived from documents, to its fixpoint
    caps, edges, seeds = doc_graph(spark, sf_dir)
    res = timed("crawl_docs", lambda: crawl(spark, seeds, caps, cc.DOCS_CRAWL, edges=edges))
    extra["crawl_docs_sec_per_level"] = round(timings["crawl_docs"] / max(res.levels, 1), 3)
    extra["crawl_docs_levels"] = res.levels

    total = round(sum(timings.values()), 3)
    print(json.dumps({"metric": "total_sec", "value": total, "unit": "sec", "queries": timings,
                      "rates": extra, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
                      "cpus": cpus}))


if __name__ == "__main__":
    main()
