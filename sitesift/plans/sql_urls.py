"""DuckDB SQL expression builders for URL functions and the chain (oracle)."""

from __future__ import annotations

from .sql_html import q


class U:
    """Fixed values of the URL rules, written for DuckDB's matcher."""
    URI_SPLIT = r"(?s)^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(?:#(.*))?$"
    ONE = r"(?:[A-Za-z0-9\-_.!~*'();/?:@&=+$,\[\]]|%[0-9A-Fa-f]{2})"
    VALID_URI = rf"^{ONE}*(?:#{ONE}*)?$"
    SCHEME_SYNTAX = r"^[A-Za-z][A-Za-z0-9+\-.]*$"
    FILE_PREFIX = r"(?i)^file://"
    AUTHORITY = r"^(?:([^@]*)@)?(\[[^\]]*\]|[^:]*)(?::([0-9]*))?$"

_PARTS = {"scheme": 1, "authority": 2, "path": 3, "query": 4, "fragment": 5}


def is_valid(u: str) -> str:
    sch = f"regexp_extract({u}, {q(U.URI_SPLIT)}, 1)"
    prt = f"regexp_extract(regexp_extract({u}, {q(U.URI_SPLIT)}, 2), {q(U.AUTHORITY)}, 3)"
    return (f"(regexp_matches({u}, {q(U.VALID_URI)}) AND ({sch} = '' OR "
            f"regexp_matches({sch}, {q(U.SCHEME_SYNTAX)})) AND (coalesce({prt}, '') = '' OR "
            f"TRY_CAST({prt} AS INTEGER) IS NOT NULL))")


def part(u: str, name: str) -> str:
    raw = f"regexp_extract({u}, {q(U.URI_SPLIT)}, {_PARTS[name]})"
    present = {
        "scheme": f"regexp_matches({u}, {q(r'^[^:/?#]+:')})",
        "authority": f"regexp_matches({u}, {q(r'^(?:[^:/?#]+:)?//')})",
        "path": "TRUE",
        "query": f"regexp_matches({u}, {q(r'^[^#]*\?')})",
        "fragment": f"contains({u}, '#')",
    }[name]
    if name == "query":
        raw = f"substring({raw}, 2)"
    return f"(CASE WHEN {is_valid(u)} AND {present} THEN {raw} END)"


def _auth(auth: str, idx: int) -> str:
    v = f"regexp_extract({auth}, {q(U.AUTHORITY)}, {idx})"
    if idx == 2:
        return f"(CASE WHEN {auth} IS NOT NULL THEN {v} END)"
    return f"(CASE WHEN {auth} IS NOT NULL AND {v} <> '' THEN {v} END)"


def host(u: str) -> str:
    return _auth(part(u, "authority"), 2)


def _default_port(s: str) -> str:
    return f"(CASE lower({s}) WHEN 'http' THEN 80 WHEN 'https' THEN 443 END)"


def resolve(u: str, r: str) -> str:
    """B3, same rules as :func:`sitesift.functions.urls.resolve_relative`."""
    c_s, c_a, c_p, c_q, c_f = (part(u, k) for k in ("scheme", "authority", "path", "query", "fragment"))
    p_s, p_a, p_p = (part(r, k) for k in ("scheme", "authority", "path"))
    c_host, c_user, c_port = _auth(c_a, 2), _auth(c_a, 1), f"TRY_CAST({_auth(c_a, 3)} AS INTEGER)"
    p_host, p_port = _auth(p_a, 2), f"TRY_CAST({_auth(p_a, 3)} AS INTEGER)"
    scheme = f"coalesce({c_s}, {p_s})"
    hst = f"(CASE WHEN {c_host} IS NOT NULL THEN {c_host} ELSE {p_host} END)"
    user = f"(CASE WHEN {c_host} IS NOT NULL THEN {c_user} END)"
    inh = (f"(CASE WHEN {c_s} IS NULL AND {c_port} IS NULL AND {p_port} IS NOT NULL AND "
           f"{p_port} <> coalesce({_default_port(p_s)}, -1) THEN {p_port} END)")
    port = f"coalesce({c_port}, {inh})"
    show = f"({port} IS NOT NULL AND ({c_s} IS NULL OR {port} <> coalesce({_default_port(c_s)}, -1)))"
    ref_path = f"(CASE WHEN coalesce({p_p}, '') = '' THEN '/' ELSE {p_p} END)"
    ref_dir = f"regexp_extract({ref_path}, {q(r'(?s)^(.*/)')}, 1)"
    joined = f"(CASE WHEN starts_with({c_p}, '/') THEN {c_p} ELSE {ref_dir} || {c_p} END)"
    path = (f"(CASE WHEN starts_with({c_p}, '..') THEN "
            f"regexp_replace({joined}, {q(r'(?s)^(.*?)/[^/]*/\.\.(.*)$')}, '\\1\\2') ELSE {joined} END)")
    out = (f"(CASE WHEN {scheme} IS NOT NULL THEN {scheme} || ':' ELSE '' END || "
           f"CASE WHEN {hst} IS NOT NULL THEN '//' || "
           f"CASE WHEN {user} IS NOT NULL THEN {user} || '@' ELSE '' END || {hst} || "
           f"CASE WHEN {show} THEN ':' || CAST({port} AS VARCHAR) ELSE '' END ELSE '' END || "
           f"{path} || CASE WHEN {c_q} IS NOT NULL THEN '?' || {c_q} ELSE '' END || "
           f"CASE WHEN {c_f} IS NOT NULL THEN '#' || {c_f} ELSE '' END)")
    return f"(CASE WHEN NOT {is_valid(u)} THEN NULL WHEN {r} IS NULL THEN {u} ELSE {out} END)"


def strip_fragment(u: str) -> str:
    return f"regexp_replace({u}, {q(r'(?s)#.*$')}, '')"


_TRAILING = r"(?s)^([^?#]*)/(\?[^#]*)?$"


def normalize(u: str, index_document: str | None = None, remove_trailing: bool = False) -> str:
    x = strip_fragment(u)
    cond = f"(regexp_matches({x}, {q(_TRAILING)}) AND ends_with({part(x, 'path')}, '/'))"
    g1 = f"regexp_extract({x}, {q(_TRAILING)}, 1)"
    g2 = f"regexp_extract({x}, {q(_TRAILING)}, 2)"
    if index_document:
        return f"(CASE WHEN {cond} THEN {g1} || {q('/' + index_document)} || {g2} ELSE {x} END)"
    if remove_trailing:
        return f"(CASE WHEN {cond} THEN {g1} || {g2} ELSE {x} END)"
    return x


def followable(h: str) -> str:
    return f"({h} IS NOT NULL AND {h} <> '' AND NOT regexp_matches({h}, {q(U.FILE_PREFIX)}))"


def scheme_http(h: str) -> str:
    s = part(h, "scheme")
    return f"({is_valid(h)} AND ({s} IS NULL OR regexp_matches({s}, '(?i)^https?$')))"


def scheme_file(h: str) -> str:
    s = part(h, "scheme")
    return f"({is_valid(h)} AND ({s} IS NULL OR regexp_matches({s}, '(?i)^file$')))"


def any_match(x: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {q(p)})" for p in patterns) + ")"


def chain_where(url: str, cfg) -> str:
    """C3-C5 on an already resolved and normalised URL column."""
    conds = [f"{url} IS NOT NULL"]
    hosts = cfg.hosts(cfg.include_hosts)
    if hosts:
        conds.append(f"{host(url)} IN ({', '.join(q(h) for h in hosts)})")
    if cfg.include_documents is not None:
        conds.append(f"coalesce({any_match(url, cfg.include_documents)}, FALSE)")
    if cfg.exclude_documents is not None:
        conds.append(f"NOT coalesce({any_match(url, cfg.exclude_documents)}, FALSE)")
    return " AND ".join(conds)
