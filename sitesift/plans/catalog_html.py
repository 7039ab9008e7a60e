"""Registered content-extraction queries over ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import html as H
from ..operators.extract import Selector, dispatch, extract_pages
from . import sql_html as S
from .tables import captures, read

# Fixed parameters of the registered queries.
TITLE_TAIL = r"^(.*?)[.!?&]+$"   # E10 example hook: drop trailing punctuation
ARTICLE = Selector("article")    # E8: a nestable element -> parser stage
HEADLINE = Selector("h1")        # E8: a leaf element -> regex


def _pages(spark, sf) -> DataFrame:
    return read(spark, sf, "pages")


def q_extract_title(spark, sf):
    return _pages(spark, sf).select("page_id", H.extract_title("html").alias("title"))


def q_extract_content(spark, sf):
    return _pages(spark, sf).select("page_id", H.extract_content("html").alias("content"))


def q_extract_links(spark, sf):
    return _pages(spark, sf).select("page_id", H.extract_links("html").alias("links"))


def q_strip_comments(spark, sf):
    return _pages(spark, sf).select("page_id", H.strip_comments(H.body_inner("html")).alias("body"))


def q_strip_tags(spark, sf):
    return _pages(spark, sf).select("page_id", H.strip_tags(H.body_inner("html")).alias("text"))


def q_decode_entities(spark, sf):
    return _pages(spark, sf).select("page_id", H.decode_entities("html").alias("decoded"))


def q_extract_by_selector(spark, sf):
    return extract_pages(_pages(spark, sf), title=HEADLINE, content=ARTICLE, keep=("page_id",)).drop("links")


def q_meta_attribute_title(spark, sf):
    return _pages(spark, sf).select(
        "page_id", H.attribute_of_first("html", "meta", "charset").alias("charset"),
        H.attribute_of_first("html", "html", "lang").alias("lang"),
        H.attribute_of_first("html", "html", "lang", "lang", "fr").alias("french"))


def q_title_postprocess(spark, sf):
    return _pages(spark, sf).select(
        "page_id", H.title_postprocess(H.extract_title("html"), TITLE_TAIL).alias("title"))


def q_content_type_dispatch(spark, sf):
    return dispatch(captures(spark, sf)).select("page_id", "content_type", "extractor")


def q_extract_pages(spark, sf):
    return extract_pages(_pages(spark, sf))


QUERIES = {
    "content_type_dispatch": q_content_type_dispatch,
    "extract_title": q_extract_title,
    "extract_content": q_extract_content,
    "extract_links": q_extract_links,
    "strip_comments": q_strip_comments,
    "strip_tags": q_strip_tags,
    "decode_entities": q_decode_entities,
    "extract_by_selector": q_extract_by_selector,
    "meta_attribute_title": q_meta_attribute_title,
    "title_postprocess": q_title_postprocess,
    "extract_pages": q_extract_pages,
}


def oracle() -> dict[str, str]:
    art = S.select_first_inner("html", "article", to_end=True)
    h1 = S.select_first_inner("html", "h1")
    return {
        "content_type_dispatch": f"WITH {S.captures_cte()} SELECT page_id, content_type, "
                                 f"{S.content_route('content_type')} AS extractor FROM captures",
        "extract_title": f"SELECT page_id, {S.extract_title('html')} AS title FROM pages",
        "extract_content": f"SELECT page_id, {S.extract_content('html')} AS content FROM pages",
        "extract_links": f"SELECT page_id, {S.extract_links('html')} AS links FROM pages",
        "strip_comments": f"SELECT page_id, {S.strip_comments(S.body_inner('html'))} AS body FROM pages",
        "strip_tags": f"SELECT page_id, {S.strip_tags(S.body_inner('html'))} AS text FROM pages",
        "decode_entities": f"SELECT page_id, {S.decode_entities('html')} AS decoded FROM pages",
        "extract_by_selector": (
            f"SELECT page_id, CASE WHEN ({h1}) IS NOT NULL THEN "
            f"{S.strip_edges(S.decode_entities(S.strip_tags(h1)))} ELSE {S.extract_title('html')} END AS title, "
            f"CASE WHEN ({art}) IS NOT NULL THEN {S.text_of(art)} ELSE {S.extract_content('html')} END AS content "
            f"FROM pages"),
        "meta_attribute_title": f"SELECT page_id, {S.attribute_of_first('html', 'meta', 'charset')} AS charset, "
                                f"{S.attribute_of_first('html', 'html', 'lang')} AS lang, "
                                f"{S.attribute_of_first('html', 'html', 'lang', 'lang', 'fr')} AS french FROM pages",
        "title_postprocess": f"SELECT page_id, {S.title_postprocess(S.extract_title('html'), TITLE_TAIL)} AS title "
                             f"FROM pages",
        "extract_pages": f"SELECT page_id, url, {S.extract_title('html')} AS title, "
                         f"{S.extract_content('html')} AS content, {S.extract_links('html')} AS links FROM pages",
    }
