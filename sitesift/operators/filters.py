"""URL predicates and the filter chain (C1-C10) as DataFrame -> DataFrame.

The stateless part of a chain is a conjunction of column predicates that
Catalyst fuses into one Filter inside one codegen stage; the stateful
visited filter (D1) is a join and lives in :mod:`.dedup`.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U

# Host lists up to this size are inlined as an IN list; longer lists are a
# broadcast semi join (the list is a driver-side config value, so its size
# is known).
INLINE_HOSTS_MAX = 1000


@dataclass(frozen=True)
class CrawlConfig:
    """Crawler settings (defaults as in the reference's configuration).

    ``include_hosts``: ``None`` or empty -> every host passes (the
    reference's nil case drops everything by accident; fixed here).
    """
    include_hosts: tuple[str, ...] | None = ("localhost",)
    include_documents: tuple[str, ...] | None = None
    exclude_documents: tuple[str, ...] | None = None
    index_document: str | None = None
    remove_trailing_slash: bool = False
    max_depth: int | None = None

    @staticmethod
    def hosts(v) -> tuple[str, ...] | None:
        if v is None:
            return None
        return (v,) if isinstance(v, str) else tuple(v)


def _patterns(p) -> tuple[str, ...] | None:
    if p is None:
        return None
    return (p,) if isinstance(p, str) else tuple(p)


def _any_match(c: Column, patterns) -> Column:
    return functools.reduce(lambda a, b: a | b, [c.rlike(p) for p in patterns])


# ------------------------------------------------------------ predicates
def scheme_http(url) -> Column:
    """Scheme absent, or http/https in any case."""
    s = U.uri_part(url, "scheme")
    return U.is_valid_uri(url) & (s.isNull() | s.rlike(r"(?i)^https?$"))


def scheme_file(url) -> Column:
    """Scheme absent or ``file``."""
    s = U.uri_part(url, "scheme")
    return U.is_valid_uri(url) & (s.isNull() | s.rlike(r"(?i)^file$"))


def host_in(url, hosts) -> Column:
    """Exact host membership; an empty or absent list passes all."""
    hs = CrawlConfig.hosts(hosts)
    if not hs:
        return F.lit(True)
    return U.uri_host(url).isin(list(hs))


def url_included(url, patterns) -> Column:
    """C4: any pattern found in the URL string; ``None`` disables."""
    ps = _patterns(patterns)
    return F.lit(True) if ps is None else F.coalesce(_any_match(F.col(url) if isinstance(url, str) else url, ps),
                                                     F.lit(False))


def url_excluded(url, patterns) -> Column:
    """C5 (negated by the caller): any pattern found in the URL string."""
    ps = _patterns(patterns)
    return F.lit(False) if ps is None else F.coalesce(_any_match(F.col(url) if isinstance(url, str) else url, ps),
                                                      F.lit(False))


def path_included(url, patterns) -> Column:
    """As C4 on the path of the URL."""
    ps = _patterns(patterns)
    return F.lit(True) if ps is None else F.coalesce(_any_match(U.uri_part(url, "path"), ps), F.lit(False))


def path_excluded(url, patterns) -> Column:
    """C7 (negated by the caller)."""
    ps = _patterns(patterns)
    return F.lit(False) if ps is None else F.coalesce(_any_match(U.uri_part(url, "path"), ps), F.lit(False))


def depth_ok(depth, max_depth: int | None) -> Column:
    """No limit, or depth <= max_depth (0 = start URLs only)."""
    d = F.col(depth) if isinstance(depth, str) else depth
    return F.lit(True) if max_depth is None else d <= F.lit(max_depth)


# ------------------------------------------------------------ DataFrame ops
def filter_hosts(df: DataFrame, host_col: str, hosts) -> DataFrame:
    """C3 on a DataFrame: IN list for short lists, broadcast semi join else
    (the list is a driver-side config value, so its size is known). ``hosts`` may
    also be a DataFrame with a ``host`` column, which may grow with the data: a
    semi join that Spark plans from its size."""
    if isinstance(hosts, DataFrame):
        return df.join(hosts.select(F.col("host").alias(host_col)).distinct(), host_col, "left_semi")
    hs = CrawlConfig.hosts(hosts)
    if not hs:
        return df
    if len(hs) <= INLINE_HOSTS_MAX:
        return df.where(F.col(host_col).isin(list(hs)))
    hdf = df.sparkSession.createDataFrame([(h,) for h in sorted(set(hs))], f"{host_col} string")
    return df.join(F.broadcast(hdf), host_col, "left_semi")


def http_chain(df: DataFrame, cfg: CrawlConfig, href: str = "href", referrer: str | None = "referrer",
               depth: str | None = "depth", out: str = "url",
               extra: tuple[Callable[[DataFrame], DataFrame], ...] = ()) -> DataFrame:
    """C9 for http crawls, stateless part, in the reference's order:
    B2 -> C1 -> B3 -> B4-B6 -> C8 -> C3 -> C4 -> C5 (-> user filters).

    ``out`` receives the resolved, normalised URL. Child and referrer are
    split once into struct columns that the scheme test, the resolution and
    the host test all read.
    """
    ref = F.col(referrer) if referrer else F.lit(None).cast("string")
    hs = CrawlConfig.hosts(cfg.include_hosts)
    inline_hosts = bool(hs) and len(hs) <= INLINE_HOSTS_MAX
    d = df.where(U.is_followable_href(href))
    if depth and cfg.max_depth is not None:
        d = d.where(depth_ok(depth, cfg.max_depth))

    def verdict(c, p):
        host = F.when(c["host"].isNotNull(), c["host"]).otherwise(p["host"])
        scheme_ok = c["valid"] & (c["scheme"].isNull() | c["scheme"].rlike(r"(?i)^https?$"))

        def on_url(u):
            keep = (scheme_ok & u.isNotNull() & url_included(u, cfg.include_documents)
                    & ~url_excluded(u, cfg.exclude_documents))
            if inline_hosts:
                keep = keep & host.isin(list(hs))
            return F.struct(u.alias(out), host.alias("__host"), keep.alias("__keep"))

        res = U.resolve_parsed(F.col(href), ref, c, p)
        return U.let(U.normalize(res, cfg.index_document, cfg.remove_trailing_slash), on_url)

    v = U.let(U.split_uri(href), lambda c: U.let(U.split_uri(ref), lambda p: verdict(c, p)))
    # A 0-or-1-element inline filters and projects in one Generate: a Filter
    # on the computed URL would be pushed below the projection and evaluate
    # the whole URL expression a second time.
    d = d.select("*", F.inline(F.filter(F.array(v), lambda s: s["__keep"])))
    if hs and not inline_hosts:
        d = filter_hosts(d, "__host", hs)
    d = d.drop("__host", "__keep")
    for f in extra:
        d = d.transform(f)
    return d


def file_chain(df: DataFrame, cfg: CrawlConfig, url: str = "url") -> DataFrame:
    """C9 for file crawls: scheme, then path include/exclude (no depth, no
    visited set: a listing has no duplicates)."""
    return df.where(scheme_file(url) & path_included(url, cfg.include_documents)
                    & ~path_excluded(url, cfg.exclude_documents))


def needs_indexing(df: DataFrame) -> DataFrame:
    """Content present and title or body non-NULL (empty counts)."""
    return df.where(F.col("title").isNotNull() | F.col("content").isNotNull())
