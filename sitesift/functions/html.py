"""HTML Column functions (E1-E7, E9, E10): title, text and links in bulk.

Regex-based and native: every function is a Spark expression that runs in
whole-stage codegen, one pass per pattern over the page. The whitespace
class is spelled out (``[ \\t\\n\\f\\r]``) so that the JVM and other regex
engines agree on it.
"""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour for right results)
# Content-type patterns of the extractors, tried in this order.
CT_HTML = r"^(text/(html|xml)|application/(xhtml\+xml|xml))"
CT_PDF = r"^application/pdf"
CT_WORD = r"^application/msword"
# Tag attributes whose values are links: a@href, area@href, frame@src.
LINK_TAGS = (("a", "href"), ("area", "href"), ("frame", "src"))
# Characters decoded in link attribute values: amp, quot, gt, lt and numeric.
LINK_ENTITIES = {"amp": "&", "quot": '"', "gt": ">", "lt": "<"}
# Text stripping: comments, lower-case script and style blocks, any tag.
COMMENT = r"(?s)<!--.*?-->"
SCRIPT_STYLE = r"(?s)<(script|style).*?>.*?</(script|style).*?>"
ANY_TAG = r"(?s)<.+?>"
# ---------------------------------------------------------------------------

WS = r"[ \t\n\f\r]"
WS_RUN = WS + "+"
STRIP_EDGES = r"^[ \t\n\f\r\x0B\x00]+|[ \t\n\f\r\x0B\x00]+$"
# One entity: named, decimal or hexadecimal (leading zeros aside, up to 7 or 6
# digits), terminated by ';'.
ENTITY = r"&(#0*[0-9]{1,7}|#[xX]0*[0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
LINK_ENTITY = r"&(amp|quot|gt|lt|#0*[0-9]{1,7}|#x0*[0-9a-fA-F]{1,6});"
# The rest of a tag after its name, quoted values taken whole (possessive: the
# JVM's matcher neither backtracks nor recurses), and one attribute of it. A tag
# or value that never ends runs to the end of the page, so that no later tag is
# scanned for from within it again; such a tag is none.
TAG_REST = r"(?:[ \t\n\f\r/](?:[^>\"']++|\"[^\"]*+(?:\"|\z)|'[^']*+(?:'|\z))*+)?+(?:>|\z)"
ATTRIBUTE = r"[ \t\n\f\r/\"'][^ \t\n\f\r=>/\"']++[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:\"[^\"]*+\"|'[^']*+'|[^ \t\n\f\r\"'>]++)"
# Blocks whose content is not markup for an HTML parser (links are not looked for
# inside them): (what the opener begins with, opener, closer) by kind.
BLOCKS = {"comment": ("<!--", "<!--", "-->")} | {
    k: (f"<(?i:{k})[ \\t\\n\\f\\r>]", f"<(?i:{k})(?:{WS}[^>]*+)?>", f"</(?i:{k}){WS}*>") for k in ("script", "style")}
OPAQUE_BLOCKS = "(?s)" + "|".join(f"{o}.*?{c}" for _, o, c in BLOCKS.values())
# Put behind the "<" of an opener that nothing closes; a noncharacter, in no text.
MARK = "\ufdd0"


def named_entities() -> dict[str, str]:
    """HTML 4 named character entities plus XHTML's ``apos`` (name -> text).

    Built from the Python standard library's HTML 4 table rather than typed.
    """
    m = {k: chr(v) for k, v in html.entities.name2codepoint.items()}
    m["apos"] = "'"
    return m


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _codepoint_text(num: Column) -> Column:
    """Text of one code point; NULL when outside Unicode or a surrogate.

    ``chr`` wraps at 256, so the code point goes through UTF-32 bytes.
    """
    ok = (num > 0) & (num <= 0x10FFFF) & ~num.between(0xD800, 0xDFFF)
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(num), 8, "0")), "UTF-32"))


def _entity_text(body: Column, table: dict[str, str]) -> Column:
    """Decoded text of one entity body (the part between ``&`` and ``;``)."""
    lookup = F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv])
    is_hex = body.startswith("#x") | body.startswith("#X")
    digits = F.regexp_replace(body, "^#[xX]?0*", "")
    num = F.when(digits == "", F.lit("0")).when(is_hex, F.conv(digits, 16, 10)).when(
        body.startswith("#"), digits).cast("bigint")
    decoded = F.when(body.startswith("#"), _codepoint_text(num)).otherwise(F.try_element_at(lookup, body))
    return F.coalesce(decoded, F.concat(F.lit("&"), body, F.lit(";")))


def _decode_with(c: Column, pattern: str, table: dict[str, str]) -> Column:
    """Single-pass decode: text between entities and the decoded entities are
    interleaved again, so ``&amp;lt;`` becomes ``&lt;`` and not ``<``."""
    return let(c, lambda x: _decode_bound(x, pattern, table))


def _decode_bound(c: Column, pattern: str, table: dict[str, str]) -> Column:
    parts = F.split(c, pattern, -1)
    bodies = F.regexp_extract_all(c, F.lit(pattern), 1)
    texts = F.transform(bodies, lambda b: _entity_text(b, table))
    glued = F.zip_with(parts, F.concat(texts, F.array(F.lit(""))), lambda p, t: F.concat(p, t))
    return F.when(c.contains("&"), F.array_join(glued, "")).otherwise(c)


def decode_entities(c) -> Column:
    """Named and numeric character references decoded once."""
    return _decode_with(_col(c), ENTITY, named_entities())


def unescape_link(c) -> Column:
    """Link values: only amp, quot, gt, lt and numeric references."""
    return _decode_with(_col(c), LINK_ENTITY, LINK_ENTITIES)


def _from(x: Column, head: Column) -> Column:
    return F.substring(x, F.length(head) + 1, F.length(x))


def _until_last(x: Column, closer: str) -> Column:
    """``x`` up to and with the last match of ``closer``; empty when there is none."""
    return F.regexp_extract(x, rf"(?s)^(.*(?:{closer}))", 1)


def _disarm(x: Column, *kinds: tuple[str, str, str]) -> Column:
    """``x`` with a mark in the openers that nothing closes: those beyond the last ``>``
    before the last closer of their kind (a comment's opener needs no ``>``). A search
    for whole blocks then takes every opener it meets and never scans in vain."""
    def mark(x, begins, closer):
        def cut(y):
            open_ = F.regexp_extract(y, rf"(?s)^(.*){closer}", 1)
            free = open_ if closer == "-->" else let(open_, lambda o: _until_last(o, ">"))
            return let(free, lambda f: F.concat(
                f, F.regexp_replace(_from(y, f), "<(?=" + begins.removeprefix("<") + ")", "<" + MARK)))
        return let(x, lambda y: F.when(y.rlike(begins), cut(y)).otherwise(y))

    for begins, _, closer in kinds:
        x = mark(x, begins, closer)
    return x


def _armed(x: Column) -> Column:
    return F.replace(x, F.lit(MARK), F.lit(""))


def strip_comments(c) -> Column:
    """E5."""
    def cut(x):
        head = _until_last(x, "-->")
        return F.concat(F.regexp_replace(head, COMMENT, ""), _from(x, head))
    return let(_col(c), cut)


def strip_blocks(c) -> Column:
    """Script and style blocks removed (the first half of E6)."""
    kind = ("<(?:script|style)", "", "</(?:script|style)[^>]*>")
    return let(_disarm(_col(c), kind), lambda x: F.when(x.rlike("<(?:script|style)"), _armed(F.regexp_replace(
        x, SCRIPT_STYLE, ""))).otherwise(_armed(x)))


def strip_tags(c) -> Column:
    """script/style blocks, then every tag (no space put in), whitespace
    runs to one space, edges trimmed."""
    def cut(x):
        head = _until_last(x, ">")
        return F.concat(F.regexp_replace(head, ANY_TAG, ""), _from(x, head))
    x = F.regexp_replace(let(strip_blocks(c), cut), WS_RUN, " ")
    return F.regexp_replace(x, STRIP_EDGES, "")


def markup(html) -> Column:
    """The page without comments and script/style blocks, where elements are
    looked for: a title or body inside them is none."""
    return strip_blocks(strip_comments(html))


def strip_edges(c) -> Column:
    return F.regexp_replace(_col(c), STRIP_EDGES, "")


def _opening(tag: str) -> str:
    import re as _re
    return rf"<(?i:{_re.escape(tag)}){TAG_REST}"


def _closing(tag: str) -> str:
    import re as _re
    return rf"</(?i:{_re.escape(tag)}){WS}*>"


def _whole(opening_tag: Column) -> Column:
    return opening_tag.endswith(">")


def _elements(html, tag: str, attr: str | None, value: str | None) -> Column:
    """Inner HTML of every matching element that does not nest into itself (title, h1,
    p ...). Comments, script and style blocks are matched first, so that no element is
    found inside them, while a comment inside an element stays part of it."""
    element = rf"{_opening(tag)}.*?(?:{_closing(tag)}|\z)"
    blocks = [BLOCKS[k] for k in BLOCKS if k != tag.lower()]
    search = F.lit("(?s)" + "|".join([*(f"{o}.*?{c}" for _, o, c in blocks), element]))
    opening = _opening(tag)

    def found(e):
        return let(F.regexp_extract(e, "^" + opening, 0), lambda o: F.when(
            _whole(o) & e.rlike(rf"(?s)^.*{_closing(tag)}\z") & _has(o, attr, value),
            F.regexp_extract(_from(e, o), rf"(?s)^(.*){_closing(tag)}\z", 1)))

    begins = opening[:opening.index(")") + 1] + r"[ \t\n\f\r/>]"
    marked = _disarm(_col(html), *blocks, (begins, opening, _closing(tag)))
    whole = let(marked, lambda x: F.regexp_extract_all(x, search, F.lit(0)))
    inner = F.transform(F.filter(whole, lambda e: e.rlike("^" + opening)), found)
    return F.transform(F.filter(inner, lambda e: e.isNotNull()), _armed)


def _has(opening_tag: Column, attr: str | None, value: str | None) -> Column:
    if attr is None:
        return F.lit(True)
    return F.coalesce(_attribute(opening_tag, attr) == F.lit(value or ""), F.lit(False))


def select_all_inner(html, tag: str, attr: str | None = None, value: str | None = None) -> Column:
    """Inner HTML of all matching elements, joined (a string selector)."""
    return F.array_join(_elements(html, tag, attr, value), "")


def select_first_inner(html, tag: str, attr: str | None = None, value: str | None = None,
                       to_end: bool = False) -> Column:
    """Inner HTML of the first matching element, NULL when there is none. With ``to_end``
    (content, which loses its comments anyway) looked for in the markup, where an
    unclosed element runs to the end of the page."""
    if not to_end:
        return F.get(_elements(html, tag, attr, value), F.lit(0))
    opening, closing = _opening(tag), _closing(tag)

    def first(x):
        if attr is None:
            return let(F.regexp_extract(x, rf"(?s)({opening})", 1), lambda o: F.when(
                _whole(o), let(F.regexp_extract(x, rf"(?s){opening}(.*)", 1), lambda rest: _up_to(rest, closing))))
        each = F.regexp_extract_all(x, F.lit(rf"(?s){opening}.*?(?:{closing}|\z)"), F.lit(0))
        hit = F.get(F.filter(each, lambda e: let(F.regexp_extract(e, "^" + opening, 0),
                                                 lambda o: _whole(o) & _has(o, attr, value))), F.lit(0))
        return let(hit, lambda e: _up_to(_from(e, F.regexp_extract(e, "^" + opening, 0)), closing))
    return let(markup(html), first)


def _up_to(x: Column, closer: str) -> Column:
    return F.regexp_extract(x, rf"(?s)^(.*?)(?:{closer}|\z)", 1)


def extract_title(html, tag: str = "title", attr: str | None = None, value: str | None = None) -> Column:
    """E2 (and E8 for leaf tags): all matches joined, tags stripped, entities
    decoded, trimmed; ``''`` when there is no such element."""
    return strip_edges(decode_entities(strip_tags(select_all_inner(html, tag, attr, value))))


def body_inner(html) -> Column:
    """Inner HTML of ``<body>``; an unclosed body runs to the end of the page."""
    inner = select_first_inner(html, "body", to_end=True)
    return F.when(_col(html).isNotNull(), F.coalesce(inner, F.lit("")))


def extract_content(html) -> Column:
    """Body text: comments, scripts and tags removed, entities decoded."""
    return decode_entities(strip_tags(strip_comments(body_inner(html))))


def text_of(inner) -> Column:
    """Text of an already selected inner HTML (E5 -> E6 -> E7)."""
    return decode_entities(strip_tags(strip_comments(_col(inner))))


def _tags(html: Column, tag: str) -> Column:
    """All opening tags of one name, as written."""
    return F.filter(F.regexp_extract_all(html, F.lit(_opening(tag)), F.lit(0)), _whole)


def _attribute(tag: Column, attr: str) -> Column:
    """The value of the first attribute of that name, NULL when there is none."""
    def name(pair):
        return F.lower(F.regexp_replace(F.substring_index(F.substring(pair, 2, 1 << 30), "=", 1), WS_RUN, ""))

    def value(pair):
        return let(F.regexp_replace(_from(pair, F.substring_index(pair, "=", 1)), f"^={WS}*", ""), _unquote)

    def pick(t):
        return F.get(F.filter(F.regexp_extract_all(t, F.lit(ATTRIBUTE), F.lit(0)), lambda p: name(p) == attr.lower()), F.lit(0))
    return let(let(tag, pick), value)


def _unquote(v: Column) -> Column:
    return F.when(v.startswith('"') | v.startswith("'"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)


def extract_links(html) -> Column:
    """a@href, area@href, frame@src over the whole page, in that order;
    values starting with ``#`` dropped, the rest HTML-unescaped."""
    def from_clean(h):
        def values(tag, attr):
            return F.transform(_tags(h, tag), lambda t: _attribute(t, attr))
        vals = F.concat(*[values(t, a) for t, a in LINK_TAGS])
        return F.transform(F.filter(vals, lambda v: v.isNotNull() & ~v.startswith("#")), lambda v: unescape_link(_armed(v)))
    clean = let(_disarm(_col(html), *BLOCKS.values()), lambda x: F.regexp_replace(x, OPAQUE_BLOCKS, ""))
    return let(clean, from_clean)


def attribute_of_first(html, tag: str, attr: str, match_attr: str | None = None,
                       match_value: str | None = None) -> Column:
    """Value of ``attr`` on the first ``<tag>`` (optionally the first whose
    ``match_attr`` equals ``match_value``), used as is; NULL when absent."""
    found = _tags(strip_comments(html), tag)
    if match_attr is not None:
        found = F.filter(found, lambda t: F.coalesce(_attribute(t, match_attr) == F.lit(match_value or ""), F.lit(False)))
    return let(F.get(found, F.lit(0)), lambda t: _attribute(t, attr))


def title_postprocess(title, pattern: str) -> Column:
    """The regex's group 1 when it matches, else the title; trimmed."""
    return let(_col(title), lambda t: strip_edges(
        F.when(t.rlike(pattern), F.regexp_extract(t, pattern, 1)).otherwise(t)))


def content_route(content_type) -> Column:
    """Which extractor handles a content type (first pattern that matches)."""
    ct = _col(content_type)
    return (F.when(ct.rlike(CT_HTML), F.lit("html"))
            .when(ct.rlike(CT_PDF), F.lit("pdf"))
            .when(ct.rlike(CT_WORD), F.lit("doc"))
            .otherwise(F.lit("unsupported")))
