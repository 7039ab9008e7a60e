"""DuckDB SQL expression builders for the HTML functions (oracle side).

The patterns are written here on their own, for DuckDB's linear-time matcher
(RE2), so that they check those of the engine and do not repeat them.
"""

from __future__ import annotations

import html.entities
import re

# ---------------------------------------------------------------------------
# Fixed values (the behaviour both sides must show)
SPACE = r"[ \t\n\f\r]"
COMMENT = r"(?s)<!--.*?-->"
BLOCK = r"(?s)<(?:script|style).*?>.*?</(?:script|style).*?>"
TAG = r"(?s)<.+?>"
EDGES = r"^[ \t\n\f\r\x0B\x00]+|[ \t\n\f\r\x0B\x00]+$"
ENTITY = r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]{1,31});"
LINK_ENTITY = r"&(amp|quot|gt|lt|#[0-9]+|#x[0-9a-fA-F]+);"
NO_MARKUP = (r"(?is)<!--.*?-->|<script(?:[ \t\n\f\r][^>]*)?>.*?</script[ \t\n\f\r]*>"
             r"|<style(?:[ \t\n\f\r][^>]*)?>.*?</style[ \t\n\f\r]*>")
REST = r"(?:[ \t\n\f\r/](?:[^>\"']|\"[^\"]*\"|'[^']*')*)?>"
ATTRIBUTE = r"[ \t\n\f\r/\"']([^ \t\n\f\r=>/\"']+)[ \t\n\f\r]*=[ \t\n\f\r]*(\"[^\"]*\"|'[^']*'|[^ \t\n\f\r\"'>]+)"
LINKS = (("a", "href"), ("area", "href"), ("frame", "src"))
HTML_TYPES = r"^(text/(html|xml)|application/(xhtml\+xml|xml))"
# ---------------------------------------------------------------------------
NAMED = {k: chr(v) for k, v in html.entities.name2codepoint.items()} | {"apos": "'"}


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def replace_all(x: str, pat: str, rep: str = "") -> str:
    return f"regexp_replace({x}, {q(pat)}, {q(rep)}, 'g')"


def _map_literal(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in sorted(table.items())) + "}"


def _entity_text(b: str, table: dict[str, str]) -> str:
    digits = f"ltrim(ltrim({b}, '#xX'), '0')"
    num = (f"CASE WHEN NOT starts_with({b}, '#') THEN NULL WHEN length({digits}) > 7 THEN -1 WHEN {digits} = '' THEN 0 "
           f"WHEN starts_with({b}, '#x') OR starts_with({b}, '#X') "
           f"THEN CAST('0x' || {digits} AS BIGINT) ELSE CAST({digits} AS BIGINT) END")
    n = f"({num})"
    cp = (f"CASE WHEN {n} > 0 AND {n} <= 1114111 AND NOT ({n} BETWEEN 55296 AND 57343) "
          f"THEN chr(CAST({n} AS INTEGER)) END")
    decoded = (f"CASE WHEN starts_with({b}, '#') THEN {cp} "
               f"ELSE map_extract_value({_map_literal(table)}, {b}) END")
    return f"coalesce({decoded}, '&' || {b} || ';')"


def _decode_with(x: str, pattern: str, table: dict[str, str]) -> str:
    parts = f"string_split_regex({x}, {q(pattern)})"
    texts = f"list_transform(regexp_extract_all({x}, {q(pattern)}, 1), lambda b: {_entity_text('b', table)})"
    glued = (f"array_to_string(list_transform({parts}, lambda p, i: p || coalesce(({texts})[i], '')), '')")
    return f"CASE WHEN contains({x}, '&') THEN {glued} ELSE {x} END"


def decode_entities(x: str) -> str:
    return _decode_with(x, ENTITY, NAMED)


def unescape_link(x: str) -> str:
    return _decode_with(x, LINK_ENTITY, {k: NAMED[k] for k in ("amp", "quot", "gt", "lt")})


def strip_comments(x: str) -> str:
    return replace_all(x, COMMENT)


def strip_edges(x: str) -> str:
    return replace_all(x, EDGES)


def strip_tags(x: str) -> str:
    y = replace_all(x, BLOCK)
    y = replace_all(y, TAG)
    y = replace_all(y, SPACE + "+", " ")
    return strip_edges(y)


def markup(x: str) -> str:
    return replace_all(strip_comments(x), BLOCK)


def inner_pattern(tag: str, to_end: bool = False) -> str:
    end = r"|\z" if to_end else ""
    return rf"(?is)<{re.escape(tag)}{REST}(.*?)(?:</{tag}{SPACE}*>{end})"


def _elements(x: str, tag: str) -> str:
    p = q(NO_MARKUP + "|" + inner_pattern(tag).removeprefix("(?is)"))
    both = f"list_zip(regexp_extract_all({x}, {p}, 0), regexp_extract_all({x}, {p}, 1))"
    return f"list_filter({both}, lambda e: NOT regexp_matches(e[1], '(?i)^<(!--|script[^a-z]|style[^a-z])'))"


def select_all_inner(x: str, tag: str) -> str:
    return f"array_to_string(list_transform({_elements(x, tag)}, lambda e: e[2]), '')"


def select_first_inner(x: str, tag: str, to_end=False) -> str:
    if not to_end:
        return f"(({_elements(x, tag)})[1])[2]"
    p = q(inner_pattern(tag, to_end))
    return f"CASE WHEN regexp_matches({markup(x)}, {p}) THEN regexp_extract({markup(x)}, {p}, 1) END"


def extract_title(x: str, tag="title") -> str:
    return strip_edges(decode_entities(strip_tags(select_all_inner(x, tag))))


def body_inner(x: str) -> str:
    return f"regexp_extract({markup(x)}, {q(inner_pattern('body', to_end=True))}, 1)"


def text_of(inner: str) -> str:
    return decode_entities(strip_tags(strip_comments(inner)))


def extract_content(x: str) -> str:
    return text_of(body_inner(x))


def _unquote(v: str) -> str:
    return (f"CASE WHEN starts_with({v}, '\"') OR starts_with({v}, '''') "
            f"THEN substring({v}, 2, length({v}) - 2) ELSE {v} END")


def _tags(h: str, tag: str) -> str:
    return f"regexp_extract_all({h}, {q('(?i)<' + tag + REST)})"


def _attribute(t: str, attr: str) -> str:
    pairs = f"list_zip(regexp_extract_all({t}, {q(ATTRIBUTE)}, 1), regexp_extract_all({t}, {q(ATTRIBUTE)}, 2))"
    v = f"(list_filter({pairs}, lambda kv: lower(kv[1]) = {q(attr.lower())})[1])[2]"
    return _unquote(v)


def extract_links(x: str) -> str:
    h = replace_all(x, NO_MARKUP)
    vals = "list_concat(" + ", ".join(f"list_transform({_tags(h, t)}, lambda t: {_attribute('t', a)})"
                                      for t, a in LINKS) + ")"
    return (f"list_transform(list_filter({vals}, lambda v: v IS NOT NULL AND NOT starts_with(v, '#')), "
            f"lambda v: {unescape_link('v')})")


def attribute_of_first(x: str, tag: str, attr: str, match_attr: str | None = None, match_value: str = "") -> str:
    found = _tags(strip_comments(x), tag)
    if match_attr:
        found = f"list_filter({found}, lambda t: coalesce({_attribute('t', match_attr)} = {q(match_value)}, FALSE))"
    return _attribute(f"({found})[1]", attr)


def title_postprocess(t: str, pattern: str) -> str:
    return strip_edges(f"CASE WHEN regexp_matches({t}, {q(pattern)}) THEN regexp_extract({t}, {q(pattern)}, 1) "
                       f"ELSE {t} END")


def content_route(ct: str) -> str:
    return (f"CASE WHEN regexp_matches({ct}, {q(HTML_TYPES)}) THEN 'html' "
            f"WHEN regexp_matches({ct}, '^application/pdf') THEN 'pdf' "
            f"WHEN regexp_matches({ct}, '^application/msword') THEN 'doc' ELSE 'unsupported' END")


def captures_cte() -> str:
    charset = attribute_of_first("html", "meta", "charset")
    return f"""captures AS (
  SELECT page_id, url, CASE WHEN status = 200 THEN html END AS html, status, content_type,
         CASE WHEN status = 200 THEN md5(html) END AS etag,
         CASE WHEN regexp_matches(url, {q(r'\?[^#]*utm_source=')})
              THEN regexp_replace(url, {q(r'[?#].*$')}, '') END AS redirect_to
  FROM (SELECT page_id, url, html,
               CASE page_id % 16 WHEN 3 THEN 500 WHEN 7 THEN 403 WHEN 11 THEN 404
                    ELSE CASE WHEN length(html) > 0 THEN 200 ELSE 404 END END AS status,
               CASE page_id % 16 WHEN 1 THEN 'application/pdf' WHEN 5 THEN 'application/msword'
                    WHEN 9 THEN 'text/plain' WHEN 13 THEN 'application/xhtml+xml'
                    ELSE CASE WHEN ({charset}) IS NOT NULL THEN 'text/html; charset=' || lower({charset})
                              ELSE 'text/html' END END AS content_type
        FROM pages))"""
