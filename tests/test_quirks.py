"""Reference behaviours kept on purpose and the ones we fix."""

from pyspark.sql import functions as F

from sitesift.functions import html as H
from sitesift.operators import filters as C


def _one(spark, col, value):
    return spark.createDataFrame([(value,)], "x string").select(col("x").alias("y")).first().y


def test_q13_title_keeps_comment_tail(spark):
    # the title gets no comment removal: the tag regex eats '<!-- a >' only
    assert _one(spark, H.extract_title, "<title>T <!-- a > b --></title>") == "T b -->"


def test_q11_q12_tags_without_space_and_uppercase_script(spark):
    assert _one(spark, H.strip_tags, "<p>a</p><p>b</p>") == "ab"
    assert _one(spark, H.strip_tags, "<SCRIPT>var x;</SCRIPT>t") == "var x;t"
    # <script> ... </style> pairs up (the pattern matches either closing tag)
    assert _one(spark, H.strip_tags, "a<script>x</style>b") == "ab"


def test_links_skip_comments_scripts_and_data_href(spark):
    html = ('<a data-href="/no">x</a><!-- <a href="/c"> --><script>"<a href=/s>"</script>'
            "<a class=k href=/ok>y</a><article href=/no2></article><a href='#top'>t</a>")
    assert _one(spark, H.extract_links, html) == ["/ok"]


def test_q5_q6_host_lists(spark):
    df = spark.createDataFrame([("http://test.host/a",), ("http://test.host.com/a",)], "url string")
    # a string is one host (not a substring test); None passes everything
    assert [r.url for r in df.where(C.host_in("url", "test.host")).collect()] == ["http://test.host/a"]
    assert df.where(C.host_in("url", None)).count() == 2


def test_long_host_list_uses_semi_join(spark):
    hosts = [f"h{i}.example" for i in range(C.INLINE_HOSTS_MAX + 5)] + ["test.host"]
    df = spark.createDataFrame([("a", "test.host"), ("b", "other")], "id string, __h string")
    assert [r.id for r in C.filter_hosts(df, "__h", hosts).collect()] == ["a"]


def test_unparseable_links_are_dropped(spark):
    cfg = C.CrawlConfig(include_hosts=None)
    df = spark.createDataFrame([("/für",), ("/a b",), ("/ok",), ("",), ("file:///etc",), ("mailto:x@y",)],
                               "href string").withColumn("referrer", F.lit("http://h/x"))
    got = [r.url for r in C.http_chain(df, cfg, depth=None).collect()]
    assert got == ["http://h/ok"]
