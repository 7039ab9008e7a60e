import time

import pytest
from pyspark.sql import functions as F

from sitesift.llm.maintext import extract, main_text

PROSE = "A long paragraph of prose, with several clauses, commas, and words enough to count as text."
OTHER = "Another paragraph follows the first, also long enough, and closes the article for good."


def page(body, head="<title>Site &mdash; page</title><style>p{}</style><script>var a='<p>x</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


ARTICLE = f"<h1>Head &amp; line</h1><p>{PROSE}</p><p>{OTHER}</p>"
WANT = f"Head & line\n\n{PROSE}\n\n{OTHER}"


@pytest.mark.parametrize("around", [
    "<nav><ul><li><a href=/>Home</a></li></ul></nav>{}<footer>&copy; us, all rights, always, reserved here</footer>",
    "<header><h1>Site name</h1><p>Tag line of the site, quite long, with commas, more, and more</p></header>{}",
    "<aside><p>Side words, many, of, them, long enough to score on their own, surely so</p></aside>{}",
    '<div class="sidebar-left"><p>Side words, many, of, them, long enough to score on their own</p></div>{}',
    '<div id="cookie-consent"><p>This site sets cookies, for reasons, and asks you, politely, to agree</p></div>{}',
    '<div class="ad">Buy things, now, cheap, and much more of them than you could ever need</div>{}',
    '<!-- a <p>comment</p> -->{}<form><label>Your mail, please, and your name, in full<input></label></form>',
    '{}<section id="comments"><h2>Comments</h2><p>A reader says, at length, that this is wrong, and why, and how</p></section>',
    '<div role="navigation"><p>Sections, of, the, site, listed, one, after, another, at length</p></div>{}',
    '<p hidden>Hidden words, many, of, them, which nobody sees, long, enough, to score</p>{}',
    "{}<script>document.write('<p>never, shown, at, all, whatever, happens, here, today</p>')",
    "<noscript><p>Please, enable, scripts, to see this page, in full, as it was meant</p></noscript>{}",
])
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<main>{}</main>", '<div class="post-content">{}</div>',
                                   "<div><div>{}</div></div>", "{}"])
def test_only_the_article(around, inner):
    assert main_text(page(around.format(inner.format(ARTICLE)))) == WANT


def test_blocks_and_characters():
    html = page(f"<article><p>{PROSE}</p><p>a&nbsp;b &lt;c&gt; &#233;&#x1F600; &amp;amp;<br>d\n\t e<b>f</b>g</p>"
                "<ul><li>one<li>two</ul><table><tr><td>x<td>y</table><p><b>open<p>next</article>")
    assert main_text(html) == "\n\n".join([PROSE, "a b <c> é😀 &amp; d efg", "one", "two", "x", "y", "open", "next"])


def test_link_lists_inside_go():
    html = page(f"<article><p>{PROSE}</p><ul><li><a href=a>More of it</a><li><a href=b>And more</a></ul><p>{OTHER}</p></article>")
    assert main_text(html) == f"{PROSE}\n\n{OTHER}"


LONG = PROSE + " " + "It goes on, with more of the same, for as long as it takes. " * 4


@pytest.mark.parametrize("inner", [
    "<article>{}{}{}</article>", "<main>{}{}{}</main>", "<div>{}{}{}</div>", "{}{}{}",
    "<main><div><article>{}</article></div><div><article>{}</article></div><div><article>{}</article></div></main>",
    "<div><div><section>{}{}</section></div></div><div>{}</div>"])
def test_long_articles_over_nested_sections(inner):
    parts = [[f"Part {k}, paragraph {i}. {LONG}".strip() for i in range(8)] for k in range(3)]
    html = ["<section><div>" + "".join(f"<p>{t}</p>" for t in part) + "</div></section>" for part in parts]
    nav = "<nav><a href=/>Home</a></nav><div><a href=a>One thing, and another</a> <a href=b>More, much more of it</a></div>"
    text = main_text(page(nav + inner.format(*html) + "<footer>us, all rights, always, reserved here</footer>"))
    assert text == "\n\n".join(t for part in parts for t in part)


@pytest.mark.parametrize("inner", ["<article>{}</article>", "<div>{}</div>", "{}"])
def test_the_lead_beside_a_long_body_stays(inner):
    body = [f"Paragraph {i}. {LONG}".strip() for i in range(20)]
    html = f"<div class=lead><p>{PROSE}</p></div><h2>Part</h2><div>" + "".join(f"<p>{t}</p>" for t in body) + "</div>"
    assert main_text(page(inner.format(html))) == "\n\n".join([PROSE, "Part", *body])


def test_short_articles_fall_back():
    assert main_text(page("<nav>menu</nav><article><h1>By</h1><p>So.</p></article><footer>f</footer>")) == "By\n\nSo."
    assert main_text("just text, no markup &amp; no page") == "just text, no markup & no page"
    assert main_text(page("<nav>menu</nav>")) == "" and main_text("") == "" and main_text(None) == ""


@pytest.mark.parametrize("html", ['<a "' * 100_000, "<div>" * 100_000 + "x", "<!--" * 100_000, "<script>" * 100_000,
                                  "<b>x</i>" * 50_000, "<p><b>" * 50_000, "<li><span>" * 30_000, "<" * 300_000,
                                  "&" * 300_000, '<p class="' + "a-" * 100_000 + '">x</p>', "<td>" * 50_000])
def test_long_broken_pages_are_linear(html):
    began = time.time()
    main_text(html)
    assert time.time() - began < 15


def test_query_form(spark):
    rows = [(1, "u", page(f"<article>{ARTICLE}</article>")), (2, None, None), (None, "u", ""), (1, "u", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("mine"))
    out = extract(df).collect()
    assert sorted((r.text, r.n_chars) for r in out) == sorted([(WANT, len(WANT)), ("", 0), ("", 0), ("x", 1)])
    assert extract(df.limit(0)).count() == 0


SENTENCES = "This is a sentence of the article, with commas, and more words to read. " * 4
LAID = "<h1>Headline</h1>" + f"<p>{SENTENCES}</p>" * 4
LAID_TEXT = "Headline\n\n" + "\n\n".join([SENTENCES.strip()] * 4)
READER_BOX = "<div class=comments>" + ("<article class=comment><p>" + "I am a reader and have, really, a lot to say. " * 8
                                    + "</p></article>") * 8 + "</div>"


def framed(body):
    return ("<html><head><title>x</title></head><body><nav><a href=/>Home</a> <a href=/a>About</a></nav>" + body
            + "<footer>Copyright, all rights reserved</footer></body></html>")


def test_a_layout_around_the_article_is_no_boilerplate():
    layouts = ["<form id=aspnetForm><div>{}</div></form>", "<fieldset>{}</fieldset>", "<div role=form>{}</div>",
               "<header>{}</header>", "<aside class=x><section>{}</section></aside>"]
    layouts += [f'<div class="{c}"><div>{{}}</div></div>' for c in (
        "right-sidebar", "layout-sidebar", "comments-open", "social-share-on", "menu-closed", "legal-content")]
    layouts += [f'<div id="{c}"><div>{{}}</div></div>' for c in ("print-area", "search-results")]
    layouts += [f'<form><div class="{c}"><div>{{}}</div></div></form>' for c in ("right-sidebar", "comments-open")]
    for layout in layouts:
        assert main_text(framed(layout.format(LAID))) == LAID_TEXT, layout
        assert main_text(framed(layout.format(f"<article>{LAID}</article>"))) == LAID_TEXT, layout


def test_boilerplate_longer_than_the_article_stays_out():
    advert = "<div class=sidebar><p>" + "Buy this thing now, it is great and cheap and new. " * 60 + "</p></div>"
    for page in (f"<div class=post>{LAID}</div>{READER_BOX}", f"<div class=post>{LAID}</div>{advert}",
                 f"<form><div class=right-sidebar><div class=post>{LAID}</div>{advert}{READER_BOX}</div></form>",
                 f"<main><article>{LAID}</article></main>{READER_BOX}{advert}"):
        assert main_text(framed(page)) == LAID_TEXT, page


def test_link_lists_of_an_article_and_xmp_stay():
    links = "<h2>Sources</h2><ul><li><a href=/1>First source</a></li><li><a href=/2>Second source</a></li></ul>"
    got = main_text(framed(f"<article>{LAID}{links}<xmp>a <b> &amp;</xmp></article>"))
    assert got == LAID_TEXT + "\n\nSources\n\nFirst source\n\nSecond source\n\na <b> &amp;"
    related = "<h2>Related stories</h2><ul><li><a href=/1>First story</a></li><li><a href=/2>Second story</a></li></ul>"
    assert main_text(framed(f"<article>{LAID}{related}</article>")) == LAID_TEXT
    assert main_text(framed(f"<div>{LAID}{related.replace('Related', 'Latest')}</div>")) == LAID_TEXT
