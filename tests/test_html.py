import random
import time

import pytest
from pyspark.sql import functions as F

from sitesift.functions import html as H
from sitesift.functions.select import first_inner
from sitesift.operators.extract import AttributeSelector, Selector, _inner_py, extract_pages

from .html_fixtures import CUSTOM, ENTITIES, FRAMESET, IMAGEMAP, SIMPLE

NBSP = " "


def _pages(spark, *htmls):
    return spark.createDataFrame([(i, f"http://test.host/{i}", h) for i, h in enumerate(htmls)],
                                 "page_id long, url string, html string")


def _one(spark, html, **kw):
    return extract_pages(_pages(spark, html), **kw).collect()[0]


def test_simple(spark):
    r = _one(spark, SIMPLE)
    assert r.title == "Harbour tides"
    assert r.content == "Tables all tables High waterfirst tide second tide"
    assert r.links == ["http://sea.test/tables.html"]


def test_entities(spark):
    r = _one(spark, ENTITIES)
    assert r.title == "Salt & pepper"
    assert r.links == ["http://shop.test/buy?i=1&n=2", "http://shop.test/buy?i=1&n=3"]
    assert r.content == f"Price < 5 can't{NBSP}say one two Crème brûlée straße ä ä"


def test_custom_selectors(spark):
    r = _one(spark, CUSTOM, title=Selector("h1", "class", "name"), content=Selector("div", "id", "main"))
    assert r.title == "Orchard at the hill"
    assert r.content == "within Pears ripen in autumn."
    assert r.links == ["http://fruit.test/before.html", "/within.html", "/after.html"]


def test_frameset_and_imagemap(spark):
    for page in (FRAMESET, IMAGEMAP):
        r = _one(spark, page)
        assert r.links == ["http://sea.test/left.html", "/right.html"]
        assert r.content == ""


def test_meta_title_and_postprocess(spark):
    sel = AttributeSelector("meta", "content", "name", "DC.title")
    assert _one(spark, CUSTOM, title=sel).title == "Orchard in the registry"
    r = _one(spark, CUSTOM, title=sel, title_hook=lambda t: H.title_postprocess(t, r"^(.*)in the registry$"))
    assert r.title == "Orchard"


def test_content_type_dispatch(spark):
    df = spark.createDataFrame([(c,) for c in ["text/html", "text/xml", "application/xml", "application/xhtml+xml",
                                                "application/pdf", "application/msword", "text/plain"]], "ct string")
    got = [r.e for r in df.select(H.content_route("ct").alias("e")).collect()]
    assert got == ["html"] * 4 + ["pdf", "doc", "unsupported"]


def test_decode_once_and_numeric(spark):
    df = spark.createDataFrame([("&amp;lt;b&amp;gt; &#8364; &#x41; &#00000065; &#0; &bogus; &amp",)], "s string")
    assert df.select(H.decode_entities("s").alias("d")).first().d == "&lt;b&gt; € A A &#0; &bogus; &amp"


def test_quirks_no_space_and_uppercase_script(spark):
    df = spark.createDataFrame([("<body><p>a</p><p>b</p><SCRIPT>x</SCRIPT></body>",)], "html string")
    assert df.select(H.extract_content("html").alias("c")).first().c == "abx"


def test_missing_title_and_unclosed_body(spark):
    r = _one(spark, "<html><body><p>text &amp; more")
    assert r.title == ""
    assert r.content == "text & more"


def test_nested_div_selector(spark):
    page = '<body><div id="x">a<div>b</div>c</div><div>z</div></body>'
    r = _one(spark, page, content=Selector("div", "id", "x"))
    assert r.content == "abc"


def test_attribute_title_is_decoded_and_trimmed(spark):
    page = '<html><head><meta name="DC.title" content=" A &amp; B "><title>x</title></head><body></body></html>'
    sel = AttributeSelector("meta", "content", "name", "DC.title")
    assert _one(spark, page, title=sel).title == "A & B"


def test_all_matches_selector_joins_and_never_falls_back(spark):
    page = "<html><body><p>one &amp;</p><div>skip</div><p class=x>two</p></body></html>"
    r = _one(spark, page, content=Selector("p", first=False))
    assert r.content == "one &two"
    r = _one(spark, page, content=Selector("h2", first=False))
    assert r.content == ""


def test_string_selector_joins_nested_elements(spark):
    page = '<body><div id="x">a<div>b</div>c</div><div id="x">d</div></body>'
    assert _one(spark, page, content=Selector("div", "id", "x", first=False)).content == "abcd"
    assert _one(spark, page, content=Selector("div", "id", "y", first=False)).content == ""


def test_elements_in_comments_and_scripts_are_none(spark):
    r = _one(spark, "<!-- <title>Old</title><body>no</body> --><title>New</title>"
                    "<script>var t='<title>S</title>';</script><body>yes</body>")
    assert r.title == "New" and r.content == "yes"


def test_attributes_are_taken_whole(spark):
    page = ('<a title="a > b" href="/x">1</a><a title="see href=/no" href="/y">2</a><a data-href="/no">3</a>'
            "<A\nHREF = '/z' >4</a><area alt=x href=/w/><a href>5</a>")
    assert _one(spark, page).links == ["/x", "/y", "/z", "/w/"]
    page = ('<meta name=DC.title.alternative content="no"><meta name="dc.title" content="no">'
            '<meta content="1 > 0" name=DC.title><title>t</title><h1 class="NAME">no</h1><h1 class="name">yes</h1>')
    assert _one(spark, page, title=AttributeSelector("meta", "content", "name", "DC.title")).title == "1 > 0"
    assert _one(spark, page, title=Selector("h1", "class", "name")).title == "yes"


def test_a_megabyte_of_openers_is_linear(spark):
    """Openers that nothing closes, alone or before a closer of another kind, and quotes that never end."""
    import time
    units = (("<script>", "-->"), ("<title>", "-->"), ("<a '", '">'), ("<script ", "</script>"), ("<title '", '"></title>'),
             ("<!--", ""), ("<style><p>", ""), ("<h1 class ", ">"), ("<a x='x=\"", ">"), ("<body '", '">'))
    for unit, end in units:
        df = _pages(spark, "<body>" + unit * (1_000_000 // len(unit)) + end).repartition(2)
        for f in (lambda: F.size(H.extract_links("html")), lambda: F.length(H.extract_title("html")),
                  lambda: F.length(H.extract_content("html")),
                  lambda: F.length(H.select_first_inner("html", "h1", "class", "x"))):
            began = time.time()
            df.select(f()).collect()
            assert time.time() - began < 5, unit


def test_openers_without_an_end_hide_nothing(spark):
    page = ("<title>T<!-- c --></title><script>x<title>no</title></script><!-- <a href=/no> --><a href='/1'>"
            "<h1 class=y>no</h1><h1 class=x>yes</h1><script>open<a href=/2><style><title>two</title><!-- <a href=/3>")
    r = _one(spark, page)
    assert r.title == "Ttwo" and r.links == ["/1", "/2", "/3"]
    assert _one(spark, page, title=Selector("h1", "class", "x")).title == "yes"
    assert _one(spark, "<a href=/1><a href='/2").links == ["/1"]            # a tag that never ends is none


PATHS = [Selector("div"), Selector("DIV", "id", "x"), Selector("div", classes=("lead", "big")),
         Selector("p", within=(Selector("div", "id", "x"),)),
         Selector("div", within=(Selector("section"), Selector("div", classes=("lead",)))),
         Selector("div", within=(Selector("div"),))]


def test_paths_equal_a_parser(spark):
    """The fold over tags against the standard library's parser, on random nested pages, some
    of them with tags that nothing closes, empty elements, comments and scripts."""
    r = random.Random(7)

    def element(depth):
        if depth == 0 or r.random() < 0.25:
            return r.choice(["text ", "a > b ", "<!-- <div id=x>no</div> -->", "<script>'</div><div>'</script>", "<br/>", "<div/>"])
        tag = r.choice(["div", "div", "DIV", "section", "p", "divider"])
        attrs = r.choice(["", "", ' id="x"', " id=x", " class='big lead'", ' class="lead"', ' title="a>b" id=\'x\'',
                          '\n class="big\n lead x"'])
        inside = "".join(element(depth - 1) for _ in range(r.randint(0, 3)))
        return f"<{tag}{attrs}>{inside}" + ("" if r.random() < 0.05 else f"</{tag}>") + ("</div>" if r.random() < 0.03 else "")
    pages = ["".join(element(5) for _ in range(3)) for _ in range(300)] + ["", "<div", "<div id=x", "</div>", None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string").repartition(8)
    for sel in PATHS:
        got = {x.i: x.t for x in df.select("i", first_inner("html", sel.steps()).alias("t")).collect()}
        want = {i: _inner_py(p, sel) for i, p in enumerate(pages)}
        assert got == want and sum(v is not None for v in want.values()) > 5, sel


def test_selectors_in_order_with_ancestors_and_classes(spark):
    page = ("<body><div class='lead'>out</div><div id=main><p class='lead big'>one <b>two</b></p><p class=lead>three</p></div>"
            "<h2>Sub</h2><title>T</title></body>")
    lead = Selector("p", classes=("lead",), within=(Selector("div", "id", "main"),))
    assert _one(spark, page, content=lead).content == "one two"
    assert _one(spark, page, content=Selector("p", first=False, classes=("lead",), within=lead.within)).content == "one twothree"
    assert _one(spark, page, content=(Selector("article"), Selector("div", classes=("lead",)), lead)).content == "out"
    assert _one(spark, page, title=(Selector("h1"), AttributeSelector("meta", "content"), Selector("h2"))).title == "Sub"
    assert _one(spark, page, title=(Selector("h1"), Selector("div", "id", "none"))).title == "T"
    plan = extract_pages(_pages(spark, page), title=lead, content=lead)._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


@pytest.mark.parametrize("unit", ["<div>", "<div></div>", "<div id='", "<!-- <div>", "</div>", "<div id=x><p>"])
def test_paths_in_linear_time(spark, unit):
    page = unit * ((1 << 20) // len(unit))
    df = _pages(spark, page).select(F.length(first_inner("html", PATHS[3].steps())).alias("n"))
    t0 = time.time()
    df.collect()
    assert time.time() - t0 < 10
