import os
import tempfile

import pytest
from pyspark.sql import functions as F

from sitesift.functions.text import Analyzer
from sitesift.operators import search as se
from sitesift.operators.extract import AttributeSelector, Selector
from sitesift.operators.extractors import PLAIN_TEXT, Extractor, extract_documents, route
from sitesift.operators.filters import CrawlConfig
from sitesift.plans.site_index import build_file_index, build_site_index
from sitesift.session import scratch_path
from sitesift.sources.index_store import read_index

CAPTURES = "page_id long, url string, html string, status int, content_type string, etag string, redirect_to string"


def _page(title, body, *links):
    return (f'<html><head><meta name="DC.title" content="{title}!"><title>{title}</title></head><body><div id="nav">menu</div> '
            f'<div id="main">{body}</div> ' + "".join(f'<a href="{h}">x</a>' for h in links) + "</body></html>")


def _captures(spark):
    rows = [(1, "http://h/", _page("Start", "harbour tides", "a", "notes.txt", "paper.pdf", "http://other/"), 200, "text/html", "t1", None),
            (2, "http://h/a", _page("Second", "the river tides"), 200, "text/html; charset=utf-8", "t2", None),
            (3, "http://h/notes.txt", "\n Notes of the day \nneap tides & <b>", 200, "text/plain; charset=utf-8", "t3", None),
            (4, "http://h/paper.pdf", "%PDF tides", 200, "application/pdf", "t4", None),
            (5, "http://other/", _page("Other", "tides"), 200, "text/html", "t5", None)]
    return spark.createDataFrame(rows, CAPTURES)


def _tree():
    root = tempfile.mkdtemp(prefix="sitesift-site-")
    os.makedirs(os.path.join(root, "sub"))
    for name, body in [("x.html", _page("File", "spring tides", "http://h/a")), ("sub/y.txt", "Log\nebb tides"),
                       ("sub/skip.html", _page("Skip", "tides")), ("z.pdf", "%PDF")]:
        with open(os.path.join(root, name), "w") as f:
            f.write(body)
    return root


def _hits(spark, index, text):
    return {r["url"]: r["title"] for r in se.search(index, se.query_table(spark, [(1, text)])).collect()}


def test_crawl_extract_index_search(spark):
    """The main run, as README shows it: crawl, selectors, write, append, reopen, search."""
    path = scratch_path(spark, "test-site")
    cfg = CrawlConfig(include_hosts=["h"], exclude_documents=[r"\.pdf$"])
    result, _ = build_site_index(spark, ["http://h/"], _captures(spark), cfg, path, content=Selector("div", "id", "main"),
                                 title=AttributeSelector("meta", "content", "name", "DC.title"))
    assert {r["url"]: r["route"] for r in result.fetched(spark).collect()} == {
        "http://h/": "success", "http://h/a": "success", "http://h/notes.txt": "success"}
    index = read_index(spark, path)
    assert _hits(spark, index, "tides") == {"http://h/": "Start!", "http://h/a": "Second!"}
    assert _hits(spark, index, "menu") == {}
    build_file_index(spark, _tree(), index_path=path, create=False)
    assert len(_hits(spark, read_index(spark, path), "tides")) == 4
    with pytest.raises(ValueError, match="no start urls"):
        build_site_index(spark, [], _captures(spark), cfg)


def test_file_seeds_beside_crawled_ones(spark):
    root = _tree()
    seeds = ["http://h/", "file://" + root]
    cfg, files = CrawlConfig(include_hosts=["h"]), CrawlConfig(include_hosts=None, exclude_documents=[r"skip"])
    want = {"http://h/": "Start", "http://h/a": "Second", f"file://{root}/x.html": "File"}
    for start in (seeds, spark.createDataFrame([(u,) for u in seeds], "url string")):
        result, index = build_site_index(spark, start, _captures(spark), cfg, file_cfg=files)
        assert _hits(spark, index, "tides") == want
        assert result.frontier(spark).where(F.col("url").startswith("file:")).count() == 0
        assert index.docs.select("doc_id").distinct().count() == index.docs.count() == 3
    result, index = build_site_index(spark, [f"file://{root}/x.html"], _captures(spark), cfg)     # one file, no crawl
    assert result is None and _hits(spark, index, "tides") == {f"file://{root}/x.html": "File"}


def test_extractors_by_content_type(spark):
    root = _tree()
    pdf = Extractor("pages", r"^application/pdf", content=lambda b: F.regexp_replace(b, "^%PDF", ""))
    _, index = build_site_index(spark, ["http://h/", "file://" + root], _captures(spark), CrawlConfig(include_hosts=["h"]),
                                extractors=(PLAIN_TEXT, pdf), analyzer=Analyzer(stop_words=("of", "the")))
    assert _hits(spark, index, "tides") == {
        "http://h/": "Start", "http://h/a": "Second", "http://h/notes.txt": "Notes of the day", "http://h/paper.pdf": "",
        f"file://{root}/x.html": "File", f"file://{root}/sub/y.txt": "Log", f"file://{root}/sub/skip.html": "Skip"}
    text = {r["url"]: r["data"] for r in index.docs.collect()}
    assert text["http://h/notes.txt"] == "Notes of the day \nneap tides & <b>" and index.analyzer.stop_words == ("of", "the")


def test_routes_and_their_order(spark):
    df = spark.createDataFrame([(t, "<title>A</title><body>b</body>") for t in
                                ("text/html", "text/plain", "text/csv", "application/pdf", None)], "content_type string, body string")
    anything = Extractor("any", r"^text/", content=lambda b: F.lit("hook"))
    got = [r["r"] for r in df.select(route("content_type", (PLAIN_TEXT, anything)).alias("r")).collect()]
    assert got == ["any", "text", "any", "pdf", "unsupported"]
    rows = extract_documents(df, extractors=(PLAIN_TEXT,), keep=("content_type",)).collect()
    assert [(r["extractor"], r["title"], r["content"]) for r in rows] == [
        ("html", "A", "b"), ("text", "<title>A</title><body>b</body>", "<title>A</title><body>b</body>"),
        ("unsupported", None, None), ("pdf", None, None), ("unsupported", None, None)]
    with pytest.raises(ValueError, match="built-in"):
        Extractor("html", "x", content=lambda b: b)
