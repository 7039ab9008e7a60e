"""URL Column functions (B1-B6): split, validate, resolve and normalise.

All are regex/``when`` expressions over strings; a URL that does not parse
becomes NULL and is filtered out, as an unparseable link is silently
dropped by the reference.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour for right results)
# RFC 3986 appendix B split: scheme, authority, path, query (with '?'),
# fragment (without '#').
URI_SPLIT = r"(?s)^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(?:#(.*))?$"
# RFC 2396 characters (as the reference's URI parser accepts): unreserved,
# reserved and %HH escapes, with at most one '#'. Anything else (spaces,
# control and non-ASCII characters, <>"{}|\^`) makes the URL unparseable.
# Tested by single character classes, which the JVM matches without recursion.
URIC = r"[A-Za-z0-9\-_.!~*'();/?:@&=+$,\[\]%]"
URI_CHARACTERS = rf"^{URIC}*(?:#{URIC}*)?$"
BAD_ESCAPE = r"%(?![0-9A-Fa-f][0-9A-Fa-f])"
SCHEME_SYNTAX = r"^[A-Za-z][A-Za-z0-9+\-.]*$"
# Authority: optional userinfo, host (or [IPv6]), optional port.
AUTHORITY = r"^(?:([^@]*)@)?(\[[^\]]*\]|[^:]*)(?::([0-9]*))?$"
DEFAULT_PORTS = {"http": 80, "https": 443}
# Document.create: only these prefixes make a document.
SEED_SCHEMES = r"(?i)^(https?|file)://"
FILE_PREFIX = r"(?i)^file://"
# ---------------------------------------------------------------------------

_PARTS = {"scheme": 1, "authority": 2, "path": 3, "query": 4, "fragment": 5}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_valid_uri(url) -> Column:
    u = _col(url)
    sch = F.regexp_extract(u, URI_SPLIT, 1)
    port = F.regexp_extract(F.regexp_extract(u, URI_SPLIT, 2), AUTHORITY, 3)
    return (u.rlike(URI_CHARACTERS) & ~u.rlike(BAD_ESCAPE) & ((sch == "") | sch.rlike(SCHEME_SYNTAX))
            & ((port == "") | port.try_cast("int").isNotNull()))


def uri_part(url, part: str) -> Column:
    """B1: one part of the URL; NULL when the part is absent (or the URL is
    invalid). ``query`` is returned without its ``?``."""
    return split_uri(url)[part]


def _authority_part(auth: Column, idx: int) -> Column:
    """userinfo (1), host (2, '' kept) or port (3) of an authority string."""
    v = F.regexp_extract(auth, AUTHORITY, idx)
    return F.when(auth.isNotNull() & (v != ""), v) if idx != 2 else F.when(auth.isNotNull(), v)


def uri_host(url) -> Column:
    """Host: the authority without userinfo and port (``localhost:3000`` -> ``localhost``)."""
    return split_uri(url)["host"]


def uri_port(url) -> Column:
    """Explicit port as an int, NULL when none is written."""
    return split_uri(url)["port"]


def split_uri(url) -> Column:
    """B1 as one struct column (valid, scheme, userinfo, host, port, path,
    query, fragment); every part NULL when the URL is invalid."""
    return let(_col(url), lambda u: let(is_valid_uri(u), lambda valid: _split(u, valid)))


def _split(u: Column, valid: Column) -> Column:
    raw = {k: F.regexp_extract(u, URI_SPLIT, i) for k, i in _PARTS.items()}
    auth = F.when(u.rlike(r"^(?:[^:/?#]+:)?//"), raw["authority"])

    def ok(c):
        return F.when(valid, c)

    return F.struct(
        valid.alias("valid"),
        ok(F.when(u.rlike(r"^[^:/?#]+:"), raw["scheme"])).alias("scheme"),
        ok(_authority_part(auth, 1)).alias("userinfo"),
        ok(_authority_part(auth, 2)).alias("host"),
        ok(_authority_part(auth, 3).try_cast("int")).alias("port"),
        ok(raw["path"]).alias("path"),
        ok(F.when(u.rlike(r"^[^#]*\?"), F.substring(raw["query"], 2, 1 << 30))).alias("query"),
        ok(F.when(u.contains("#"), raw["fragment"])).alias("fragment"))


def _default_port(scheme: Column) -> Column:
    s = F.lower(scheme)
    expr = F.lit(None).cast("int")
    for k, v in DEFAULT_PORTS.items():
        expr = F.when(s == k, F.lit(v)).otherwise(expr)
    return expr


def resolve_parsed(u: Column, r: Column, c: Column, p: Column) -> Column:
    """B3 from already split child ``c`` and referrer ``p`` (see
    :func:`resolve_relative`); ``u``/``r`` are the original strings."""
    c_has_auth = c["host"].isNotNull()
    scheme = F.coalesce(c["scheme"], p["scheme"])
    host = F.when(c_has_auth, c["host"]).otherwise(p["host"])
    userinfo = F.when(c_has_auth, c["userinfo"])
    ref_port_inherited = F.when(
        c["scheme"].isNull() & c["port"].isNull() & p["port"].isNotNull()
        & (p["port"] != F.coalesce(_default_port(p["scheme"]), F.lit(-1))), p["port"])
    port = F.coalesce(c["port"], ref_port_inherited)
    # A child with its own scheme prints the port only when it is not that
    # scheme's default; a relative child prints any port it ends up with.
    show_port = port.isNotNull() & (c["scheme"].isNull()
                                    | (port != F.coalesce(_default_port(c["scheme"]), F.lit(-1))))
    path0 = c["path"]
    ref_path = F.when(F.coalesce(p["path"], F.lit("")) == "", F.lit("/")).otherwise(p["path"])
    ref_dir = F.regexp_extract(ref_path, r"(?s)^(.*/)", 1)
    joined = F.when(path0.startswith("/"), path0).otherwise(F.concat(ref_dir, path0))
    path = F.when(path0.startswith(".."),
                  F.regexp_replace(joined, r"(?s)^(.*?)/[^/]*/\.\.(.*)$", "$1$2")).otherwise(joined)
    out = F.concat(
        F.when(scheme.isNotNull(), F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
        F.when(host.isNotNull(), F.concat(
            F.lit("//"),
            F.when(userinfo.isNotNull(), F.concat(userinfo, F.lit("@"))).otherwise(F.lit("")),
            host,
            F.when(show_port, F.concat(F.lit(":"), port.cast("string"))).otherwise(F.lit("")))
        ).otherwise(F.lit("")),
        path,
        F.when(c["query"].isNotNull(), F.concat(F.lit("?"), c["query"])).otherwise(F.lit("")),
        F.when(c["fragment"].isNotNull(), F.concat(F.lit("#"), c["fragment"])).otherwise(F.lit("")),
    )
    return F.when(~c["valid"], F.lit(None).cast("string")).when(r.isNull(), u).otherwise(out)


def resolve_relative(url, referrer) -> Column:
    """The child URL made absolute against its referrer.

    Missing scheme and host come from the referrer; the referrer's port only
    when the child has neither scheme nor port and the referrer's port is not
    its scheme's default; a path not starting with ``/`` is put after the
    referrer's directory (an empty referrer path acting as ``/``); a link
    starting with ``..`` gets exactly one ``/x/..`` collapsed. No referrer:
    unchanged. Invalid child: NULL.

    For large tables prefer :func:`with_resolved`, which splits each URL once.
    """
    return let(_col(url), lambda u: let(_col(referrer), lambda r: let(
        split_uri(u), lambda c: let(split_uri(r), lambda p: resolve_parsed(u, r, c, p)))))


def with_resolved(df, href: str, referrer: str | None, out: str):
    """DataFrame form of B3."""
    r = F.col(referrer) if referrer else F.lit(None).cast("string")
    return df.withColumn(out, resolve_relative(F.col(href), r))


def strip_fragment(url) -> Column:
    """Fragment removed, query kept."""
    return F.regexp_replace(_col(url), r"(?s)#.*$", "")


_TRAILING = r"(?s)^([^?#]*)/(\?[^#]*)?$"
_EMPTY_AUTHORITY_END = r"^(?:[^:/?#]+:)?//(?:[?#]|$)"


def _ends_in_slash(u: Column) -> Column:
    """The path is non-empty and ends in ``/`` (the ``//`` of an empty
    authority is not a path)."""
    return u.rlike(_TRAILING) & ~u.rlike(_EMPTY_AUTHORITY_END)


def append_index_document(url, index_document: str) -> Column:
    """A path ending in ``/`` gets the index document; query re-attached."""
    u = _col(url)
    return F.when(_ends_in_slash(u),
                  F.concat(F.regexp_extract(u, _TRAILING, 1), F.lit("/" + index_document),
                           F.regexp_extract(u, _TRAILING, 2))).otherwise(u)


def remove_trailing_slash(url) -> Column:
    """The final ``/`` of the path removed (``/`` becomes empty)."""
    u = _col(url)
    return F.when(_ends_in_slash(u),
                  F.concat(F.regexp_extract(u, _TRAILING, 1), F.regexp_extract(u, _TRAILING, 2))).otherwise(u)


def normalize(url, index_document: str | None = None, remove_trailing: bool = False) -> Column:
    """B4-B6 in the reference's order: fragment, then index document, else
    (if configured) trailing slash."""
    u = strip_fragment(url)
    if index_document:
        return let(u, lambda x: append_index_document(x, index_document))
    if remove_trailing:
        return let(u, remove_trailing_slash)
    return u


def is_seed_url(url) -> Column:
    """A1: http(s) or file URL by case-insensitive prefix."""
    return _col(url).rlike(SEED_SCHEMES)


def is_followable_href(href) -> Column:
    """B2: non-empty and not a ``file://`` link (an http page never yields one)."""
    h = _col(href)
    return h.isNotNull() & (h != "") & ~h.rlike(FILE_PREFIX)
