"""Main text of web pages by tree scoring.

A page becomes a flat list of elements in page order. Elements that are
boilerplate by tag, role or class are set aside; but one that holds most of the
prose around it is a layout (a form around the page, a body of class
``right-sidebar``), not boilerplate, when little prose is left without it or the
headline or article stands in it. Every paragraph earns points
for its length and commas and passes them to its parent, grandparent and so on
with falling weight; a container's score is discounted by the share of its text
that is links. The article or main element around the best container is kept as
a whole; without one, the best container is kept with all on the way up to the
body that holds paragraphs and few links. Lists and boxes inside that are mostly links go.

At scale: one narrow pass in Arrow batches, page by page, linear in a page's
length (no regular expression backtracks over a page, no recursion).

Defined cases: null or empty html gives an empty text; pages without markup are
one block; unclosed comments, scripts and tags end with the page; pages whose
paragraphs earn no points fall back to their article or main element, then to
the whole body; an empty table gives an empty result; other columns pass through
``extract``, but for one named like an output column, which is replaced.
"""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())    # xmp is shown as it is
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre
section summary table tbody td tfoot th thead tr ul xmp""".split())
# Opening one of these ends the open elements named, up to the nearest of the bounds.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
        "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
        "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "option": ({"option"}, {"select"})}
NEVER_TEXT = frozenset("""head script style noscript template iframe svg canvas object embed noembed noframes button input
select textarea dialog title""".split())
ASIDE_TAGS = frozenset("nav aside footer form fieldset menu".split())
# Names of places for readers' comments; such a place is a layout only if nothing else has prose.
READERS = frozenset("comment comments commentlist discussion disqus feedback replies respond responses".split())
LEAST_PROSE = 140                    # characters: less is no article beside a layout
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
# Parts of class names and ids that mark boilerplate, and those that mark content.
BAD = frozenset("""ad ads adsense advert advertisement adverts adbox banner breadcrumb breadcrumbs comment comments
commentlist consent cookie cookies copyright discussion disqus feedback footer gdpr hidden legal login masthead menu menus
modal nav navbar navigation navi newsletter notice notices notification outbrain pager pagination paywall popup print promo
promos promoted recommended recommendations related replies respond responses rss search share sharing sidebar sidebars
signup skip social sponsor sponsored sponsors subscribe subscription taboola tagcloud teaser toolbar tooltip topbar
widget widgets""".split())
WEAK = frozenset("alert header head meta bar side tags warning".split())      # boilerplate unless content stands beside
GOOD = frozenset("article body content entry hentry main page post story text blog".split())
MODIFIERS = frozenset("has with no is without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl table".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd figcaption".split())
TAG_SCORE = {"article": 25, "main": 25, "div": 5, "section": 5, "pre": 3, "td": 3, "blockquote": 3, "ol": -3, "ul": -3,
             "dl": -3, "li": -3, "form": -3, "address": -3, "th": -5} | dict.fromkeys(HEADINGS, -5)
LEAST_PARAGRAPH = 25
OPENS = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
NAME = re.compile(r"[^\s/>]+")
QUOTED = re.compile(r"=\s*([\"'])")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """Elements in page order (tag, parent, verdict, names) and the page's text pieces."""

    def __init__(self, html: str):
        self.tag, self.parent, self.verdict, self.names = ["#page"], [0], [SHOWN], [()]
        self.pieces: list[tuple[int, str | None]] = []        # (element, text); None begins a block
        self.stack, self.open = [0], {}
        self.unclosed: set[str] = set()
        self.read(html)

    def tag_end(self, html: str, at: int) -> int:
        """Where the tag's ``>`` is, quoted values skipped; the page's end if nowhere."""
        while True:
            end = html.find(">", at)
            if end < 0:
                return len(html)
            quote = QUOTED.search(html, at, end)
            if not quote or quote[1] in self.unclosed:
                return end
            close = html.find(quote[1], quote.end())
            if close < 0:
                self.unclosed.add(quote[1])
                return end
            at = close + 1

    def read(self, html: str) -> None:
        at, raw_end = 0, {}
        while at < len(html):
            found = OPENS.search(html, at)
            if not found:
                break
            start = found.start()
            if start > at:
                self.text(html[at:start])
            if html.startswith("<!--", start):
                end = html.find("-->", start + 2)
                at = len(html) if end < 0 else end + 3
                continue
            if html[start + 1] in "!?":
                end = html.find(">", start)
                at = len(html) if end < 0 else end + 1
                continue
            closing = html[start + 1] == "/"
            name = NAME.match(html, start + 1 + closing)
            tag = name[0].lower()
            end = self.tag_end(html, name.end())
            at = end + 1
            if closing:
                self.close(tag)
                continue
            self.start(tag, html[name.end():end])
            if tag in RAW:
                if raw_end.get(tag) != -1:
                    stop = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(html, at)
                    raw_end[tag] = stop.start() if stop else -1
                stop = raw_end[tag] if raw_end[tag] != -1 else len(html)
                if tag == "xmp":
                    self.text(html[at:stop].replace("&", "&amp;"))
                at = stop
        if at < len(html):
            self.text(html[at:])

    def text(self, text: str) -> None:
        self.pieces.append((self.stack[-1], text))

    def pop(self) -> None:
        tag = self.tag[self.stack.pop()]
        self.open[tag] -= 1
        if tag in BLOCKS:
            self.pieces.append((self.stack[-1], None))

    def close(self, tag: str) -> None:
        if not self.open.get(tag):
            return
        inline = tag not in BLOCKS
        for i in range(len(self.stack) - 1, 0, -1):
            here = self.tag[self.stack[i]]
            if here == tag:
                while len(self.stack) > i:
                    self.pop()
                return
            if inline and here in BLOCKS:
                return

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS and self.open.get("p"):
            for i in range(len(self.stack) - 1, 0, -1):
                here = self.tag[self.stack[i]]
                if here == "p":
                    while len(self.stack) > i:
                        self.pop()
                    break
                if here in BLOCKS:
                    break
        if tag in ENDS:
            ended, bounds = ENDS[tag]
            last = None
            for i in range(len(self.stack) - 1, 0, -1):
                here = self.tag[self.stack[i]]
                if here in ended:
                    last = i
                if here in bounds or here in ("body", "article", "main") or (last is None and here not in BLOCKS
                                                                             and len(self.stack) - i > 32):
                    break
            while last is not None and len(self.stack) > last:
                self.pop()
        if tag == "br":
            self.text(" ")
        if tag in BLOCKS:
            self.pieces.append((self.stack[-1], None))
        if tag in VOID:
            return
        up = self.stack[-1]
        verdict, names = boilerplate(tag, attributes, self.open)
        self.tag.append(tag)
        self.parent.append(up)
        self.verdict.append(verdict)
        self.names.append(names)
        self.stack.append(len(self.tag) - 1)
        self.open[tag] = self.open.get(tag, 0) + 1


SHOWN, ASIDE, HIDDEN = range(3)


def boilerplate(tag: str, attributes: str, opened: dict) -> tuple[int, tuple]:
    """(whether the element is shown, boilerplate by its looks or never text; the parts of its class and id)."""
    names: list[str] = []
    aside = tag in ASIDE_TAGS or tag == "header" and not (opened.get("article") or opened.get("main"))
    if attributes.strip():
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                names += [p.lower() for p in PARTS.findall(value)]
            elif key == "role" and value.strip().lower() in DROPPED_ROLES:
                aside = True
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" \
                    or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
                return HIDDEN, ()
    if tag in NEVER_TEXT:
        return HIDDEN, tuple(names)
    if tag not in ("html", "body", "article", "main"):
        plain = [p for before, p in zip(["", *names], names, strict=False) if before not in MODIFIERS]
        aside |= any(p in BAD for p in plain) or any(p in WEAK for p in plain) and not any(p in GOOD for p in plain)
    return ASIDE if aside else SHOWN, tuple(names)


def set_aside(page: Page, prose: list[int]) -> list[bool]:
    """Which elements are left out. ``prose``: characters of each element's own text that are no links.

    Going down, an element that looks like boilerplate is a layout if it holds over half of the prose of the
    region (the page, or the layout around it) and either the prose of the region that stands in no such
    element is less than ``LEAST_PROSE`` (and it holds that much itself), or a headline, article or main
    element stands in it. A place for readers' comments needs the first."""
    n = len(page.tag)
    whole, clean, headed = list(prose), list(prose), [t in ("h1", "article", "main") for t in page.tag]
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        if page.verdict[i] == HIDDEN:
            continue
        whole[up] += whole[i]
        headed[up] = headed[up] or headed[i]
        clean[up] += clean[i] if page.verdict[i] == SHOWN else 0
    dropped, region = [False] * n, [0] * n
    for i in range(1, n):
        up = page.parent[i]
        r = region[i] = region[up]
        dropped[i] = dropped[up] or page.verdict[i] == HIDDEN
        if dropped[i] or page.verdict[i] == SHOWN:
            continue
        rest = clean[r] < LEAST_PROSE
        layout = rest and (headed[i] or whole[i] >= LEAST_PROSE) or headed[i] and not any(p in READERS for p in page.names[i])
        if layout and whole[i] * 2 > whole[r]:
            region[i] = i
        else:
            dropped[i] = True
    return dropped


def headed_lists(page: Page, pieces: list, length: list[int]) -> dict[int, tuple[int, bool]]:
    """Lists that a heading stands right before: (the heading, whether its words name boilerplate)."""
    block = [0] * len(page.tag)                        # the block that an element is or stands in
    for i in range(1, len(page.tag)):
        block[i] = i if page.tag[i] in BLOCKS else block[page.parent[i]]
    words: dict[int, list[str]] = {}
    for i, t in pieces:
        if t and page.tag[block[i]] in HEADINGS:
            words.setdefault(block[i], []).append(t)
    said = {i: "".join(t) for i, t in words.items()}
    out, before = {}, {}
    for i in range(1, len(page.tag)):
        up = page.parent[i]
        if page.tag[i] in LISTS and before.get(up, 0) in said:
            h = before[up]
            out[i] = h, any(p.lower() in BAD for p in PARTS.findall(said[h]))
        if length[i]:
            before[up] = i
    return out


def main_text(html: str | None) -> str:
    """The article's blocks, joined by blank lines."""
    if not html:
        return ""
    page = Page(html)
    n = len(page.tag)
    length, links, commas = [0] * n, [0] * n, [0] * n
    linked = [False] * n
    for i in range(1, n):
        linked[i] = linked[page.parent[i]] or page.tag[i] == "a"
    pieces = [(i, None if t is None else unescape(t) if "&" in t else t) for i, t in page.pieces]
    prose = [0] * n
    for i, t in pieces:
        if t and not linked[i]:
            prose[i] += len(" ".join(t.split()))
    dropped = set_aside(page, prose)
    pieces = [(i, t) for i, t in pieces if not dropped[i]]
    for i, t in pieces:
        if t:
            size = len(" ".join(t.split()))
            length[i] += size
            commas[i] += t.count(",") + t.count("、") + t.count("，")
            links[i] += size if linked[i] else 0
    own = list(length)
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        length[up] += length[i]
        links[up] += links[i]
        commas[up] += commas[i]
    score: dict[int, float] = {}
    earned = [False] * n
    for i in range(1, n):
        tag = page.tag[i]
        prose = tag in PARAGRAPHS or tag in ("div", "section", "article", "main", "body") and own[i] >= LEAST_PARAGRAPH
        size, seps = (length[i], commas[i]) if tag in PARAGRAPHS else (own[i], own[i] // 60)
        if dropped[i] or not prose or size < LEAST_PARAGRAPH:
            continue
        earned[i] = True
        points = 1 + seps + min(size / 100, 3)
        up, level = (page.parent[i] if tag in PARAGRAPHS else i), 0
        while up and level < 5:
            if up not in score:
                score[up] = TAG_SCORE.get(page.tag[up], 0) + (25 if any(p in GOOD for p in page.names[up]) else 0)
            score[up] += points / (1, 2, 6, 9, 12)[level]
            up, level = page.parent[up], level + 1
    ranked = {i: s * (1 - links[i] / max(1, length[i])) for i, s in score.items()}
    kept, path = set(), []
    if ranked:
        best = max(ranked, key=lambda i: (ranked[i], -i))
        bar = max(10, 0.2 * ranked[best])
        prose = list(earned)                           # elements that hold a paragraph of points
        for i in range(n - 1, 0, -1):
            prose[page.parent[i]] = prose[page.parent[i]] or prose[i]
        path = [best]
        while path[-1]:
            path.append(page.parent[path[-1]])
        tops = [i for i in path if page.tag[i] in ("article", "main") and not dropped[i]]
        # The article is kept as a whole, or main if it holds articles beside it.
        whole = next((i for i in tops if page.tag[i] == "main"), tops[0]) if tops else best
        kept.add(whole)
        beside: dict[int, list[int]] = {}
        for i in range(1, n):
            beside.setdefault(page.parent[i], []).append(i)
        for step in path[path.index(whole):-1]:
            siblings = [i for i in beside[page.parent[step]] if i != step and not dropped[i]]
            taken = []
            for i in siblings:
                dense = links[i] / max(1, length[i])
                paragraph = page.tag[i] == "p" and (length[i] > 80 and dense < 0.25 or 0 < length[i] <= 80 and dense == 0)
                scored = step == whole and ranked.get(i, 0) >= bar
                container = prose[i] and dense < 0.25 and (not tops or page.tag[i] in ("article", "main"))
                if scored or container or paragraph and (step == whole or not tops):
                    taken.append(i)
            last = max([step, *taken])
            kept.update(taken)
            if step == whole or taken:                 # with the headings before them
                kept.update(i for i in siblings if i < last and page.tag[i] in HEADINGS and not links[i])
    else:
        for wanted in ("article", "main", "body"):
            kept = {i for i in range(n) if page.tag[i] == wanted and not dropped[i] and length[i]}
            if kept:
                break
        kept = kept or {0}
    exempt = kept.union(path)
    article = any(page.tag[i] in ("article", "main") for i in kept)
    listed = headed_lists(page, pieces, length)
    removed = {h for i, (h, bad) in listed.items() if links[i] > 0.5 * length[i] and (bad or not article)}
    spared = {i for i, (_, bad) in listed.items() if article and not bad}
    inside, cleaned = [False] * n, [False] * n
    for i in range(n):
        up = page.parent[i]
        cleaned[i] = (i > 0 and cleaned[up]) or i in removed or page.tag[i] in LISTS | {"div", "section"} \
            and i not in exempt and i not in spared and links[i] > 0.5 * length[i]
        inside[i] = i in kept or (i > 0 and inside[up])
    blocks, line = [], []
    for i, t in pieces:
        if t is None:
            if line:
                blocks.append(" ".join("".join(line).split()))
                line = []
        elif inside[i] and not cleaned[i]:
            line.append(t)
    blocks.append(" ".join("".join(line).split()))
    return "\n\n".join(b for b in blocks if b)


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text``, the main text of ``html``, and long ``n_chars``, its code points."""
    @F.pandas_udf("string")
    def extracted(html: pd.Series) -> pd.Series:
        return html.map(main_text)

    return (pages.withColumn("text", extracted(F.coalesce(F.col("html"), F.lit(""))))
            .withColumn("n_chars", F.length("text").cast("long")))
