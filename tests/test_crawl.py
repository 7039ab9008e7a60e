import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitesift.operators.dedup import etag_dedup, first_per_key
from sitesift.operators.filters import CrawlConfig
from sitesift.operators.graph import crawl
from sitesift.plans import catalog_crawl as cc
from sitesift.plans.tables import DOC_LINK_RULE, DOC_SITE

from .conftest import SF001


def _page(*links):
    return "<html><body>" + "".join(f'<a href="{h}">x</a>' for h in links) + "</body></html>"


# The fixture crawl graph of FIXTURES.md: seed http://h/a, host filter h.
GRAPH = [
    (1, "http://h/a", _page("b", "c#x", "http://other/z"), 200, None, None),
    (2, "http://h/b", _page("d", "a"), 200, None, None),
    (3, "http://h/c", _page("d", "r"), 200, None, None),
    (4, "http://h/d", _page("e"), 200, "t1", None),
    (5, "http://h/r", "", 301, None, "http://h/s"),
    (6, "http://h/s", _page("f"), 200, "t1", None),
    (7, "http://h/e", _page(), 200, None, None),
    (8, "http://h/f", _page(), 200, None, None),
]


def _captures(spark):
    rows = [(pid, u, h, st, "text/html", et, rd) for pid, u, h, st, et, rd in GRAPH]
    return spark.createDataFrame(rows, "page_id long, url string, html string, status int, content_type string, "
                                       "etag string, redirect_to string")


def _kept(spark, max_depth=None):
    cfg = CrawlConfig(include_hosts=("h",), max_depth=max_depth)
    res = crawl(spark, ["http://h/a"], _captures(spark), cfg)
    return sorted((r.url, r.depth) for r in res.kept(spark).collect()), res


def test_fixture_graph(spark):
    kept, res = _kept(spark)
    assert kept == [("http://h/a", 0), ("http://h/b", 1), ("http://h/c", 1), ("http://h/d", 2), ("http://h/e", 3)]
    front = {r.url: (r.depth, r.referrer) for r in res.frontier(spark).collect()}
    assert front["http://h/s"] == (3, "http://h/r")       # redirect target is a child
    assert "http://h/f" not in front                       # s was an ETag copy: links not followed
    assert "http://other/z" not in front                   # host filter


def test_a_finished_crawl_leaves_no_tables(spark):
    _kept(spark)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("sitesift_crawl")]


def test_fixture_graph_max_depth(spark):
    kept, _ = _kept(spark, max_depth=1)
    assert [u for u, _ in kept] == ["http://h/a", "http://h/b", "http://h/c"]


def test_registered_page_crawl_runs_to_its_fixpoint(spark):
    rows = [(i, f"http://h/{i}", _page(str(i + 1)), 200, None, None) for i in range(4)]
    rows += [(4, "http://h/4", "", 301, None, "http://h/5"), (5, "http://h/5", "", 301, None, "http://h/6"),
             (6, "http://h/6", _page("http://spam-farm.x/y", "0"), 200, None, None)]
    caps = spark.createDataFrame([(p, u, h, st, "text/html", et, rd) for p, u, h, st, et, rd in rows],
                                 "page_id long, url string, html string, status int, content_type string, "
                                 "etag string, redirect_to string")
    res = crawl(spark, ["http://h/0"], caps, cc.PAGES_CRAWL)
    fetched = sorted((r.url, r.depth, r.route) for r in res.fetched(spark).collect())
    assert fetched == [(f"http://h/{i}", i, "redirect" if i in (4, 5) else "success") for i in range(7)]


def test_empty_start_urls_raise(spark):
    import pytest
    with pytest.raises(ValueError):
        crawl(spark, [], _captures(spark), CrawlConfig(include_hosts=None))


def test_etag_filter_sequence(spark):
    schema = "url string, depth int, etag string"
    b1 = spark.createDataFrame([("u0", 0, None), ("u1", 0, "abc1234"), ("u2", 0, "abc1234")], schema)
    k1 = etag_dedup(b1)
    assert sorted(r.url for r in k1.collect()) == ["u0", "u1"]
    b2 = spark.createDataFrame([("u3", 1, "abc1235"), ("u4", 1, "abc1235"), ("u5", 1, "abc1234")], schema)
    k2 = etag_dedup(b2, seen=k1)
    assert [r.url for r in k2.collect()] == ["u3"]


def test_first_per_key_is_idempotent(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "url string, depth int, ref string")
    once = first_per_key(df, "url", ["depth"])
    twice = first_per_key(once, "url", ["depth"])
    assert sorted(once.collect()) == sorted(twice.collect()) == [("a", 1, "y"), ("b", 5, "z")]


def _brute_force_etag_crawl(docs: pd.DataFrame):
    """Sequential BFS over the derived documents graph with the ETag filter."""
    n = len(docs)
    ids = set(docs.doc_id)
    etag = {r.doc_id: hashlib.md5(r.text.encode()).hexdigest() for r in docs.itertuples()}
    url = {i: f"{DOC_SITE}{i}" for i in ids}
    seeds = sorted({url[i] for i in docs.groupby("source").doc_id.min()})
    by_url = {u: i for i, u in url.items()}
    level, visited, seen, kept, d = seeds, set(seeds), set(), [], 0
    while level:
        parents = []
        for u in sorted(level):
            i = by_url.get(u)
            if i is None:
                continue
            if etag[i] in seen:
                continue
            seen.add(etag[i])
            kept.append((u, d))
            parents.append(i)
        cand = {}
        for i in parents:
            for pos, (a, b) in enumerate(DOC_LINK_RULE):
                dst = f"{DOC_SITE}{(a * i + b) % n}"
                key = (url[i], pos)
                if dst not in cand or key < cand[dst]:
                    cand[dst] = key
        level = [u for u in cand if u not in visited]
        visited.update(level)
        d += 1
    return sorted(kept)


def test_crawl_with_etags_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "source", "text").toPandas()
    want = _brute_force_etag_crawl(docs)
    got = sorted((r.url, r.depth) for r in cc.q_crawl_etag(spark, SF001).collect())
    assert got == want
    assert len(got) > 0


def test_crawl_resumes_after_interruption(spark):
    from sitesift.operators import graph as G
    from sitesift.session import scratch_path
    cfg = CrawlConfig(include_hosts=("h",))
    root = scratch_path(spark, "test-resume")
    calls = {"n": 0}
    real = G._write_counted

    def failing(df, path):          # the driver dies while writing level 2
        calls["n"] += 1
        if "depth=2" in path:
            raise RuntimeError("driver lost")
        return real(df, path)

    G._write_counted = failing
    try:
        with pytest.raises(RuntimeError):
            crawl(spark, ["http://h/a"], _captures(spark), cfg, root=root)
    finally:
        G._write_counted = real
    res = crawl(spark, ["http://h/a"], _captures(spark), cfg, root=root, resume=True)
    kept = sorted((r.url, r.depth) for r in res.kept(spark).collect())
    assert kept == [("http://h/a", 0), ("http://h/b", 1), ("http://h/c", 1), ("http://h/d", 2), ("http://h/e", 3)]


def test_levels_are_read_in_few_runs(spark, monkeypatch):
    """A chain of 20 pages with runs of three levels: every page once, few folders a level, and a
    crawl cut after level 12 that finds one of its runs unfinished gives the same result."""
    import os

    from sitesift.operators import graph as G
    from sitesift.session import scratch_path
    monkeypatch.setattr(G, "RUN_LEVELS", 3)
    n = 20
    rows = [(i, f"http://h/{i}", _page(str(i + 1), str(max(0, i - 4))), 200, "text/html", f"t{i % 17}", None)
            for i in range(n)]
    caps = spark.createDataFrame(rows, "page_id long, url string, html string, status int, content_type string, "
                                       "etag string, redirect_to string")
    cfg = CrawlConfig(include_hosts=("h",))
    read = []
    real = G.LevelRuns._keys
    monkeypatch.setattr(G.LevelRuns, "_keys", lambda self, parts: read.append(parts) or real(self, parts))
    real_write = G._write_counted

    def failing(df, path):
        if "depth=13" in path:
            raise RuntimeError("driver lost")
        return real_write(df, path)

    root = scratch_path(spark, "test-runs")
    monkeypatch.setattr(G, "_write_counted", failing)
    with pytest.raises(RuntimeError):
        crawl(spark, ["http://h/0"], caps, cfg, root=root)
    monkeypatch.setattr(G, "_write_counted", real_write)
    os.remove(os.path.join(root, "visited", "run=9-12", "_SUCCESS"))
    res = crawl(spark, ["http://h/0"], caps, cfg, root=root, resume=True)
    # pages 17 and on carry a tag that was seen: fetched, not kept, not followed
    assert sorted((r.url, r.depth) for r in res.kept(spark).collect()) == sorted((f"http://h/{i}", i) for i in range(17))
    assert res.fetched(spark).count() == 18 and res.levels == 18
    assert max(len(p) for p in read) <= 7 and any((0, 9) in p for p in read)
    assert [p for p in read if (9, 10) in p and (0, 9) in p]        # the unfinished run is read level by level


def test_fetch_routes(spark):
    rows = [(1, "http://h/a", _page("gone", "missing", "moved", "pdf"), 200, "text/html", None, None),
            (2, "http://h/gone", "", 404, "text/html", None, None),
            (3, "http://h/moved", "", 301, "text/html", None, "http://h/a"),
            (4, "http://h/pdf", "%PDF", 200, "application/pdf", None, None)]
    caps = spark.createDataFrame(rows, "page_id long, url string, html string, status int, content_type string, "
                                       "etag string, redirect_to string")
    res = crawl(spark, ["http://h/a"], caps, CrawlConfig(include_hosts=("h",)))
    routes = {r.url: (r.route, r.extractor, r.keep) for r in res.fetched(spark).collect()}
    assert routes == {
        "http://h/a": ("success", "html", True),
        "http://h/gone": ("dropped", None, False),
        "http://h/missing": ("fetch_error", None, False),
        "http://h/moved": ("redirect", None, False),
        "http://h/pdf": ("success", "pdf", True),
    }
    # the redirect target was already visited: nothing new at depth 2
    assert res.levels == 2


def test_small_levels_need_few_jobs_and_match_the_large_path(spark, monkeypatch):
    """A level is two writes of a few stages each; the path for large levels gives the same log."""
    from sitesift.operators import graph as G
    rows = [(i, f"http://h/{i}", _page(str(i + 1), str(i // 2)), 200, "text/html", ("", None, f"t{i % 5}")[i % 3], None)
            for i in range(9)]
    caps = spark.createDataFrame(rows, "page_id long, url string, html string, status int, content_type string, "
                                       "etag string, redirect_to string")
    sc, cfg, logs = spark.sparkContext, CrawlConfig(include_hosts=("h",)), {}
    for few in (10_000, 0):
        monkeypatch.setattr(G, "FEW_ROWS", few)
        sc.setJobGroup(f"crawl-{few}", "levels")
        res = crawl(spark, ["http://h/0", "http://h/4"], caps, cfg)
        jobs = len(sc.statusTracker().getJobIdsForGroup(f"crawl-{few}"))
        sc.setLocalProperty("spark.jobGroup.id", None)
        logs[few] = (sorted(map(str, res.fetched(spark).collect())), res.levels)
        assert few == 0 or jobs <= 15 * res.levels + 40
    assert logs[10_000] == logs[0] and logs[0][1] > 3


def test_walked_levels_need_a_lookup_each_and_match_the_other_paths(spark, monkeypatch):
    """Small levels take one lookup each, a few jobs; the paths by joins, and a crawl that changes
    from one to the other on its way, give the same log."""
    from sitesift.operators import graph as G
    n = 11
    rows = [(i, f"http://h/{i}", _page(str(i + 1), f"{i}/gone", str(i // 2), str(i + 1)), 200, "text/html",
             ("", None, f"t{i % 4}")[i % 3], None) for i in range(n)]
    rows += [(40, f"http://h/{n}", "", 301, "text/html", None, "http://h/moved"), (41, "http://h/moved", "", 301, "text/html", None, "::"),
             (42, "http://h/4/gone", "", 404, "text/html", None, None), (43, "http://h/3", _page("late"), 200, "text/html", "t9", None),
             (44, "http://h/5/gone", "%PDF", 200, "application/pdf", "t0", None)]
    caps = spark.createDataFrame(rows, "page_id long, url string, html string, status int, content_type string, "
                                       "etag string, redirect_to string")
    sc, cfg, logs = spark.sparkContext, CrawlConfig(include_hosts=("h",)), []
    for few, walked, keys in ((10_000, 200_000, 1_000), (10_000, 0, 1_000), (10_000, 200_000, 6), (0, 0, 1_000)):
        monkeypatch.setattr(G, "FEW_ROWS", few)
        monkeypatch.setattr(G, "WALK_ROWS", walked)
        monkeypatch.setattr(G, "SEEN_KEYS", keys)
        sc.setJobGroup(f"walk-{len(logs)}", "levels")
        res = crawl(spark, ["http://h/0"], caps, cfg)
        jobs = len(sc.statusTracker().getJobIdsForGroup(f"walk-{len(logs)}"))
        sc.setLocalProperty("spark.jobGroup.id", None)
        logs.append((sorted(map(str, res.fetched(spark).collect())), sorted(map(str, res.frontier(spark).collect())), res.levels))
        assert logs[0][2] >= 8 and (len(logs) > 1 or jobs <= 3 * res.levels + 40)
    assert all(x == logs[0] for x in logs)


def test_seen_keys_find_what_was_added():
    from sitesift.operators.graph import SeenKeys
    seen, keys = SeenKeys(), [f"http://h/{i}" for i in range(130_000)]
    for at in range(0, len(keys), 10_000):
        assert not seen.among(keys[at:at + 10_000])
        seen.add(keys[at:at + 10_000])
    assert len(seen) == len(keys) and len(seen.sorted) > 0 and len(seen.new) > 0
    assert seen.among(["http://h/0", "http://h/129999", "http://h/130000", ""]) == {"http://h/0", "http://h/129999"}
