from pyspark.sql import functions as F

from sitesift.functions import urls as U
from sitesift.operators import filters as C

REF = "http://test.host/dir/file.html"
CASES = [
    (REF, "another.html", "http://test.host/dir/another.html"),
    (REF, "../another.html", "http://test.host/another.html"),
    (REF, "/dir/another.html", "http://test.host/dir/another.html"),
    (REF, "http://test.host/dir/another.html", "http://test.host/dir/another.html"),
    (REF, "HTTP://test.host/dir/another.html", "HTTP://test.host/dir/another.html"),
    ("https://test.host/dir/", "another.html", "https://test.host/dir/another.html"),
    ("https://test.host/", "another.html", "https://test.host/another.html"),
    ("https://test.host", "another.html", "https://test.host/another.html"),
    # quirks kept (Q1, Q2) and the port rule (Q3)
    (REF, "?a=b", "http://test.host/dir/?a=b"),
    ("http://h/a/b/c", "../../x.html", "http://h/a/../x.html"),
    ("http://h/", "../x", "http://h/../x"),
    ("http://h:3000/a/", "b.html", "http://h:3000/a/b.html"),
    ("http://h:3000/a/", "//o/x", "//o:3000/x".replace("//o", "http://o")),
    ("http://h:80/a/", "b.html", "http://h/a/b.html"),
    ("http://h/a", "http://o:8080/x", "http://o:8080/x"),
    (None, "http://h/x#f", "http://h/x#f"),
]


def test_resolve_relative(spark):
    df = spark.createDataFrame(CASES, "ref string, href string, want string")
    rows = df.select("want", U.resolve_relative("href", "ref").alias("got")).collect()
    for r in rows:
        assert r.got == r.want, r


def test_invalid_urls_are_null(spark):
    df = spark.createDataFrame([("http://h/a b",), ("http://h/für",), ("http://h/%zz",), ("http://h/%20ok",)],
                               "u string")
    got = [r.v for r in df.select(U.is_valid_uri("u").alias("v")).collect()]
    assert got == [False, False, False, True]


def test_split_and_host(spark):
    df = spark.createDataFrame([("http://user@localhost:3000/p/a.html?x=1#frag",)], "u string")
    r = df.select(U.split_uri("u").alias("s")).first().s
    assert (r.scheme, r.userinfo, r.host, r.port, r.path, r.query, r.fragment) == (
        "http", "user", "localhost", 3000, "/p/a.html", "x=1", "frag")


def test_normalize(spark):
    df = spark.createDataFrame([("http://h/a/#x",), ("http://h/?q=1",), ("http://h/a.html#t",), ("http://h",)],
                               "u string")
    idx = [r.v for r in df.select(U.normalize("u", "index.html").alias("v")).collect()]
    assert idx == ["http://h/a/index.html", "http://h/index.html?q=1", "http://h/a.html", "http://h"]
    rts = [r.v for r in df.select(U.normalize("u", None, True).alias("v")).collect()]
    assert rts == ["http://h/a", "http://h?q=1", "http://h/a.html", "http://h"]


def _passes(spark, urls, pred):
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    return [r.url for r in df.where(pred).collect()]


def test_filter_chain_include_and_host(spark):
    urls = ["http://test.host/affe.htm", "http://test.host/affe.html", "http://test.host.com/affe.html"]
    pred = C.url_included("url", r".+html$") & C.host_in("url", "test.host")
    assert _passes(spark, urls, pred) == ["http://test.host/affe.html"]


def test_default_chain(spark):
    cfg = C.CrawlConfig()
    df = spark.createDataFrame([(u,) for u in ["http://www.example.com/affe.htm", "http://localhost:3000/affe.html",
                                               "http://localhost.com/affe.html"]], "href string")
    got = [r.url for r in C.http_chain(df, cfg, referrer=None, depth=None).collect()]
    assert got == ["http://localhost:3000/affe.html"]


def test_exclusion_patterns(spark):
    urls = ["http://test.host/affe.htm", "http://test.host/affe.html", "http://test.host/affe.aspx"]
    assert _passes(spark, urls, ~C.url_excluded("url", [r".*\.html$", r".*\.aspx"])) == ["http://test.host/affe.htm"]
    urls = ["http://test.host/dir1/affe.aspx", "http://test.host/dir2/dir1/affe.htm", "http://test.host/affe.htm",
            "http://test.host/dir2/affe.htm"]
    assert _passes(spark, urls, ~C.url_excluded("url", [r"http://[^/]+/dir1"])) == urls[1:]
    assert _passes(spark, urls, ~C.url_excluded("url", [r"/dir1"])) == urls[2:]


def test_hostname_filter(spark):
    urls = ["http://google.com/", "http://test.host/file.html", "http://localhost/file.html"]
    assert _passes(spark, urls, C.host_in("url", ["test.host", "localhost"])) == urls[1:]
    assert _passes(spark, urls, C.host_in("url", None)) == urls


def test_scheme_filters(spark):
    urls = ["mailto:a@b", "javascript:x()", "HTTPS://h/", "rel.html", "file:///x"]
    assert _passes(spark, urls, C.scheme_http("url")) == ["HTTPS://h/", "rel.html"]
    assert _passes(spark, urls, C.scheme_file("url")) == ["rel.html", "file:///x"]


def test_overlong_urls_and_ports_are_dropped_not_fatal(spark):
    long_ok, long_bad = "http://h/" + "a" * 1_000_000, "data:image/png;base64," + "é" * 1_000_000
    rows = [(long_ok,), (long_bad,), ("http://h:99999999999/a",), ("http://h/%zz",), ("http://h/%41%",), ("http://h:80/%41",)]
    df = spark.createDataFrame(rows, "u string").repartition(3)
    got = {r.u: (r.s.valid, r.s.port) for r in df.select("u", U.split_uri("u").alias("s")).collect()}
    assert [got[u][0] for u, in rows] == [True, False, False, False, False, True]
    assert got["http://h:80/%41"][1] == 80 and got["http://h:99999999999/a"][1] is None
