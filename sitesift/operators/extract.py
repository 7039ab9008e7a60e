"""Bulk content extraction (E1, E8, E11): a page table in, title/text/links out.

Everything is one narrow ``select`` (no shuffle) of native expressions. The first
element of a selector that nests, has ancestors or class tokens is found by a fold over
its tags (``functions/select.py``). Only all matches of such a selector, joined, are
taken by a Pandas UDF over the standard library's HTML parser; it is sent the page's
HTML and no other column.
"""

from __future__ import annotations

from dataclasses import dataclass
from html.parser import HTMLParser
from typing import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.common import let
from ..functions.select import first_inner

# Elements that may contain an element of the same name; selecting them by
# regex would stop at the first inner closing tag.
NESTABLE_TAGS = frozenset("div span section article ul ol li table tbody tr td th blockquote nav main "
                          "aside header footer form dl dd dt em strong b i u font small big q sub sup "
                          "fieldset figure details".split())


@dataclass(frozen=True)
class Selector:
    """``tag[attr=value]``: ``first`` picks the first match (and falls back to
    the default element when none matches, like a selector procedure);
    otherwise all matches are joined and a miss gives ``''``.

    ``classes``: tokens that the element's class must all hold. ``within``: selectors of
    elements around it, the outermost first, at any distance (``div#main p.lead`` is
    ``Selector("p", classes=("lead",), within=(Selector("div", "id", "main"),))``)."""
    tag: str
    attr: str | None = None
    value: str | None = None
    first: bool = True
    classes: tuple[str, ...] = ()
    within: tuple[Selector, ...] = ()

    def steps(self) -> list[tuple]:
        return [(s.tag, s.attr, s.value, s.classes) for s in (*self.within, self)]


@dataclass(frozen=True)
class AttributeSelector:
    """``tag[match_attr=match_value]/@attr`` - a string used as is."""
    tag: str
    attr: str
    match_attr: str | None = None
    match_value: str | None = None


DEFAULT_TITLE = Selector("title", first=False)
DEFAULT_CONTENT = Selector("body", first=False)


# ---------------------------------------------------------------- E8 (Python)
class _ElementFinder(HTMLParser):
    """Offsets of the inner HTML of the outermost elements that a path of steps selects
    (the first, or all), with nesting of the same tag counted per step."""

    def __init__(self, steps, first):
        super().__init__(convert_charrefs=False)
        self.steps = [(tag.lower(), attr, value, set(classes)) for tag, attr, value, classes in steps]
        self.depth = [0] * len(steps)
        self.first = first
        self.found = []
        self._lines = None

    def feed_text(self, text):
        starts, acc = [0], 0
        for line in text.split("\n"):
            acc += len(line) + 1
            starts.append(acc)
        self._lines = starts
        self.feed(text)
        self.close()

    def _offset(self):
        line, col = self.getpos()
        return self._lines[line - 1] + col

    def _matches(self, step, attrs):
        _, attr, value, classes = step
        have = dict(attrs)
        return ((attr is None or have.get(attr.lower()) == (value or ""))
                and classes <= set((have.get("class") or "").split()))

    def handle_starttag(self, tag, attrs):
        if self.first and self.found and not self.depth[-1]:
            return
        outer = [True, *(d > 0 for d in self.depth)]
        for j, step in enumerate(self.steps):
            if tag == step[0]:
                if self.depth[j]:
                    self.depth[j] += 1
                elif outer[j] and self._matches(step, attrs):
                    self.depth[j] = 1
                    if j == len(self.steps) - 1:
                        self.found.append([self._offset() + len(self.get_starttag_text() or ""), None])

    def handle_startendtag(self, tag, attrs):
        inside = self.depth[-1]
        depth = list(self.depth)
        self.handle_starttag(tag, attrs)
        self.depth = depth
        if not inside and self.found and self.found[-1][1] is None:
            self.found[-1][1] = self.found[-1][0]

    def handle_endtag(self, tag):
        inside = self.depth[-1]
        for j, step in enumerate(self.steps):
            if tag == step[0] and self.depth[j]:
                self.depth[j] -= 1
            if j and not self.depth[j - 1]:
                self.depth[j] = 0
        if inside and not self.depth[-1]:
            self.found[-1][1] = self._offset()


def _inner_py(text, sel: Selector):
    """Inner HTML of the first match, or of all matches joined; NULL when there is none."""
    if text is None:
        return None
    f = _ElementFinder(sel.steps(), sel.first)
    try:
        f.feed_text(text)
    except Exception:  # noqa: BLE001 - malformed markup: no element found
        return None
    return "".join(text[a:b] for a, b in f.found) if f.found else None


def _all_inner(html: Column, sel: Selector) -> Column:
    """Inner HTML of all that matches ``sel``, joined; NULL if nothing does."""
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([_inner_py(h, sel) for h in pages], dtype=object)

    return run(html)


# ----------------------------------------------------------------- selection
def _is_path(sel: Selector) -> bool:
    return bool(sel.tag.lower() in NESTABLE_TAGS or sel.classes or sel.within)


def _first_inner(html: Column, sel: Selector, to_end: bool) -> Column:
    """Inner HTML of the first match, NULL without one."""
    return first_inner(html, sel.steps()) if _is_path(sel) else H.select_first_inner(
        html, sel.tag, sel.attr, sel.value, to_end)


def _title_text(inner: Column) -> Column:
    return H.strip_edges(H.decode_entities(H.strip_tags(inner)))


def _picked_title(h: Column, sel: Selector | AttributeSelector) -> Column:
    """The title that one selector picks, NULL where the next one is asked."""
    if isinstance(sel, AttributeSelector):
        # the picked string is used as is, then decoded and trimmed like any title
        t = H.attribute_of_first(h, sel.tag, sel.attr, sel.match_attr, sel.match_value)
        return H.strip_edges(H.decode_entities(t))
    if sel.first:
        return let(_first_inner(h, sel, to_end=False), lambda x: F.when(x.isNotNull(), _title_text(x)))
    if _is_path(sel):
        return F.when(h.isNotNull(), F.coalesce(_title_text(_all_inner(h, sel)), F.lit("")))
    return H.extract_title(h, sel.tag, sel.attr, sel.value)


def _picked_content(h: Column, sel: Selector) -> Column:
    if sel.first:
        return let(_first_inner(h, sel, to_end=True), lambda x: F.when(x.isNotNull(), H.text_of(x)))
    if _is_path(sel):
        return F.when(h.isNotNull(), F.coalesce(H.text_of(_all_inner(h, sel)), F.lit("")))
    return H.extract_content(h) if sel == DEFAULT_CONTENT else H.text_of(H.select_all_inner(
        h, sel.tag, sel.attr, sel.value))


def _in_order(picked: list[Column], last: Selector | AttributeSelector, default: Column) -> Column:
    """The first that found its element, else the default; one that joins all matches always finds."""
    finds = isinstance(last, Selector) and not last.first
    return F.coalesce(*picked, *([] if finds else [default]))


def extract_pages(pages: DataFrame, html_col: str = "html", title: Selector | AttributeSelector | tuple = DEFAULT_TITLE,
                  content: Selector | tuple = DEFAULT_CONTENT,
                  title_hook: Callable[[Column], Column] | None = None, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``(keep..., title, content, links)``; ``html`` is not carried on.

    ``title``/``content`` are selectors (E8/E9), or several in the order in which they
    are tried: the first that finds its element is used, the default element after the
    last. ``title_hook`` is a Column -> Column post-processing of the picked title (E10).
    """
    keep = tuple(c for c in (keep if keep is not None else pages.columns) if c != html_col)
    h = F.col(html_col)
    titles = title if isinstance(title, tuple) else (title,)
    contents = content if isinstance(content, tuple) else (content,)
    t = _in_order([_picked_title(h, s) for s in titles], titles[-1], H.extract_title(h))
    c = _in_order([_picked_content(h, s) for s in contents], contents[-1], H.extract_content(h))
    if title_hook is not None:
        t = title_hook(t)
    return pages.select(*keep, t.alias("title"), c.alias("content"), H.extract_links(h).alias("links"))


def dispatch(df: DataFrame, content_type_col: str = "content_type") -> DataFrame:
    """Add ``extractor`` (html, pdf, doc or unsupported)."""
    return df.withColumn("extractor", H.content_route(content_type_col))
