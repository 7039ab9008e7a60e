"""Extractors by content type (E1): an ordered registry of Column -> Column functions.

The first extractor whose pattern matches a document's content type takes it, whether it
was captured by a crawl or lies in a file tree; a document that none takes is not indexed.
HTML keeps its selectors (E8-E11); any other type is two functions of the body. All of it
stays one narrow pass: HTML is extracted where the route says so, the hooks are branches
of the same select.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from .extract import DEFAULT_CONTENT, DEFAULT_TITLE, extract_pages

HTML = "html"
UNSUPPORTED = "unsupported"


@dataclass(frozen=True)
class Extractor:
    """``content`` (and ``title``, else the document has none) of a body of that content type."""
    name: str
    pattern: str
    content: Callable[[Column], Column]
    title: Callable[[Column], Column] = lambda body: F.lit("")

    def __post_init__(self):
        if self.name in (HTML, UNSUPPORTED):
            raise ValueError(f"{self.name} is the name of a built-in route")


def first_line(body: Column) -> Column:
    return H.strip_edges(F.substring_index(F.regexp_replace(body, r"^[ \t\r\n]+", ""), "\n", 1))


# Plain text: the first line that is not blank is the title, all of it the content.
PLAIN_TEXT = Extractor("text", r"^text/plain\b", content=H.strip_edges, title=first_line)


def route(content_type, extractors: tuple[Extractor, ...] = ()) -> Column:
    """The name of the extractor that takes a content type. Given extractors come before the
    built-in ones, in their order; of the latter only HTML extracts anything."""
    ct = F.col(content_type) if isinstance(content_type, str) else content_type
    out = None
    for e in extractors:
        out = F.when(ct.rlike(e.pattern), e.name) if out is None else out.when(ct.rlike(e.pattern), e.name)
    return H.content_route(ct) if out is None else out.otherwise(H.content_route(ct))


def extract_documents(docs: DataFrame, body: str = "body", extractors: tuple[Extractor, ...] = (),
                      keep: tuple[str, ...] = ("url",), title=DEFAULT_TITLE, content=DEFAULT_CONTENT,
                      title_hook: Callable[[Column], Column] | None = None) -> DataFrame:
    """E1 + E11: ``(keep..., extractor, title, content)`` of documents (keep..., content_type, body).
    Types without an extractor give NULL title and content (C10 then leaves them out)."""
    routed = docs.select(*keep, F.col(body).alias("__body"), route("content_type", extractors).alias("extractor"))
    routed = routed.withColumn("__html", F.when(F.col("extractor") == HTML, F.col("__body")))
    found = extract_pages(routed, "__html", title=title, content=content, title_hook=title_hook,
                          keep=(*keep, "extractor", "__body", "__html"))
    t, c = (F.when(F.col("extractor") == HTML, F.col(x)) for x in ("title", "content"))
    for e in extractors:
        t = t.when(F.col("extractor") == e.name, e.title(F.col("__body")))
        c = c.when(F.col("extractor") == e.name, e.content(F.col("__body")))
    return found.select(*keep, "extractor", t.alias("title"), c.alias("content"))
