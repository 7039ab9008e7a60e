"""Link graph and crawl.

The crawl is a level-synchronous BFS over a precomputed edge table:

    edges   = chain(link_edges(pages))        # B, C3-C5 applied once
    level 0 = dedup(chain(seeds))
    repeat d: fetched = level_d ⋈ captures    # A2, A3
              kept    = etag verdict(fetched) # D2, first by url, seen ETags
              cand    = kept ⋈ edges(src) ∪ redirects, depth d+1
              level   = first_per_url(cand) ▷ visited  -> written as depth=d+1
    until level empty or d+1 > max_depth

Every level is written to Parquet under the session's checkpoint folder and
read back, so lineage never grows with the number of levels and a lost
executor recomputes one level at most. What was visited and which tags were seen
is also kept in runs: every ``RUN_LEVELS`` levels their keys are merged into one
folder, and as many of those into a larger one, so a level reads a number of
folders that grows with the logarithm of the depth. Only per-level row counts reach the
driver, and the rows of levels that are small (``Walk``): a long crawl has hundreds of
those, and planning and running the steps above for each takes far longer than their
rows. Such a level is looked up in one scan and its verdicts are made on the driver, by
the same rules; the same folders are written.
"""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.html import content_route, extract_links
from ..session import scratch_path
from ..sources.pages import capture_index, fetch, routed, seed_frontier
from .dedup import SMALL_SIDE_ROWS, anti_join_seen, first_per_key
from .filters import CrawlConfig, http_chain

# Levels per run and runs per larger run; rows per file of a run.
RUN_LEVELS = 8
ROWS_PER_RUN_FILE = 5_000_000

# Levels of at most this many rows are joined as broadcasts and marked in one task: a long
# crawl has hundreds of small levels, and each exchange costs more than their rows.
FEW_ROWS = 10_000
# Levels of FEW_ROWS at most that lead to at most this many rows are walked on the driver, while
# the URLs visited and the tags seen are at most SEEN_KEYS each (16 bytes on the driver).
WALK_ROWS = 200_000
SEEN_KEYS = 4_000_000
# Rows per file of the table in which a walk looks up its levels.
ROWS_PER_SITE_FILE = 100_000

FRONTIER_COLS = ["url", "referrer", "depth", "pos"]


def link_edges(pages: DataFrame, cfg: CrawlConfig, src: str = "url", links: str = "links") -> DataFrame:
    """D5 (+ the stateless chain): ``(src_url, dst_url, pos)`` per followable
    link of each page, resolved against the page URL and normalised."""
    e = pages.select(F.col(src).alias("src_url"), F.posexplode(links).alias("pos", "href"))
    e = http_chain(e, cfg, href="href", referrer="src_url", depth=None, out="dst_url")
    return e.select("src_url", "dst_url", "pos")


def html_edges(captures: DataFrame, cfg: CrawlConfig) -> DataFrame:
    """Edges of successfully fetched HTML captures, keyed by normalised URL
    (the same key the frontier uses)."""
    from ..functions.urls import normalize
    ok = captures.where((F.col("status") == 200) & (content_route("content_type") == "html"))
    pages = ok.select(normalize("url", cfg.index_document, cfg.remove_trailing_slash).alias("url"),
                      "page_id", extract_links("html").alias("links"))
    # several captures of one URL: the lowest page_id is the one fetched
    pages = first_per_key(pages.where(F.col("url").isNotNull()), "url", ["page_id"])
    return link_edges(pages, cfg)


def degree_counts(edges: DataFrame) -> DataFrame:
    """Out- and in-degree per URL (partial aggregates, skew-safe)."""
    out_d = edges.groupBy(F.col("src_url").alias("url")).agg(F.count(F.lit(1)).alias("out_degree"))
    in_d = edges.groupBy(F.col("dst_url").alias("url")).agg(F.count(F.lit(1)).alias("in_degree"))
    return (out_d.join(in_d, "url", "full")
            .select("url", F.coalesce("out_degree", F.lit(0)).alias("out_degree"),
                    F.coalesce("in_degree", F.lit(0)).alias("in_degree")))


@dataclass
class CrawlResult:
    root: str
    levels: int

    def _read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(os.path.join(self.root, name))

    def frontier(self, spark) -> DataFrame:
        """Every admitted URL with its BFS depth and first referrer."""
        return self._read(spark, "frontier")

    def fetched(self, spark) -> DataFrame:
        """Crawl log: admitted URLs with capture, route and ``keep`` flag."""
        return self._read(spark, "fetched")

    def kept(self, spark) -> DataFrame:
        """Successfully fetched documents that passed the ETag filter."""
        return self.fetched(spark).where(F.col("keep")).drop("keep")


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


# Rows per bucket of the crawl's static join tables; the bucket count is
# derived from the table's size.
ROWS_PER_BUCKET = 2_000_000


def _write_bucketed(spark: SparkSession, df: DataFrame, path: str, key: str) -> DataFrame:
    """Persist a table that every level joins on ``key``, bucketed by it.

    A large level then meets it in a sort-merge join that shuffles only the
    level; the static table is never re-shuffled. The table is staged as
    plain Parquet first (its row count observed during that write), then
    written with one file per bucket, the bucket count sized from the rows.
    It lives at ``path`` (under the checkpoint folder) and is registered
    under a unique name in the session catalog; if the catalog refuses, the
    staged files are used unbucketed.
    """
    stage = path + "_stage"
    rows = _write_counted(df, stage)
    n = max(1, -(-rows // ROWS_PER_BUCKET))
    name = _table_name(path)
    try:
        (spark.read.parquet(stage).repartition(n, key).write.mode("overwrite").bucketBy(n, key).sortBy(key)
         .option("path", path).format("parquet").saveAsTable(name))
        return spark.table(name)
    except AnalysisException:        # the catalog refuses tables: unbucketed files
        return spark.read.parquet(stage)


class Rows:
    """A few rows on the driver, written as one Parquet file without a Spark job: by the file
    system of the folder, whole once ``_SUCCESS`` is there, like those that Spark writes."""

    def __init__(self, spark: SparkSession, rows: list[tuple], schema: T.StructType):
        self.spark = spark
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
        arrow = to_arrow_schema(self.schema)
        columns = list(zip(*rows)) or [()] * len(arrow)
        self.table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def frame(self) -> DataFrame:
        return self.spark.createDataFrame(self.table, self.schema)

    def write(self, path: str) -> int:
        file = pa.BufferOutputStream()
        pq.write_table(self.table, file)
        at = self.spark._jvm.org.apache.hadoop.fs.Path
        p = at(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.delete(p, True)
        for name, content in (("part-00000.parquet", file.getvalue().to_pybytes()), ("_SUCCESS", b"")):
            out = fs.create(at(p, name), True)
            out.write(bytearray(content))
            out.close()
        return self.table.num_rows


def _write_counted(df: DataFrame | Rows, path: str) -> int:
    """Write and return the row count, observed during the write itself."""
    if isinstance(df, Rows):
        return df.write(path)
    obs = Observation()
    _write(df.observe(obs, F.count(F.lit(1)).alias("n")), path)
    return int(obs.get["n"])


def mark_kept(fetched: DataFrame, seen_etags: DataFrame | None) -> DataFrame:
    """D2 inside the loop, as a flag: a success is kept when its ETag is empty
    or new (not in ``seen_etags``) and it is the first of its ETag in this
    level by URL."""
    ok = F.col("route") == "success"
    tagged = fetched.where(ok & F.col("etag").isNotNull() & (F.col("etag") != "")).select("url", "etag")
    first = first_per_key(anti_join_seen(tagged, seen_etags, "etag"), "etag", ["url"])
    return (fetched.join(first.select("url", F.lit(True).alias("__first")), "url", "left")
            .withColumn("keep", ok & (F.col("etag").isNull() | (F.col("etag") == "")
                                      | F.coalesce("__first", F.lit(False))))
            .drop("__first"))


def _hits(seen: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """The keys of ``few`` that were seen: few again, as the crawl keeps a key once."""
    return F.broadcast(seen.join(F.broadcast(few.select(key)), key, "left_semi"))


def mark_few_kept(fetched: DataFrame, seen_etags: DataFrame | None) -> DataFrame:
    """:func:`mark_kept` for a level of few rows in one partition: no exchange."""
    ok = F.col("route") == "success"
    tagged = ok & F.col("etag").isNotNull() & (F.col("etag") != "")
    first = F.row_number().over(Window.partitionBy("etag", tagged).orderBy("url")) == 1
    if seen_etags is not None:
        hits = _hits(seen_etags, fetched.where(tagged), "etag").select("etag", F.lit(True).alias("__seen"))
        fetched = fetched.join(F.broadcast(hits), "etag", "left").select(*fetched.columns, "__seen")
        first = first & F.col("__seen").isNull()
    return (fetched.withColumn("__first", first)
            .withColumn("keep", ok & (F.col("etag").isNull() | (F.col("etag") == "") | F.col("__first")))
            .drop("__first", "__seen"))


def _done(spark: SparkSession, path: str) -> bool:
    """A folder written completely by Spark (its ``_SUCCESS`` marker exists)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


class LevelRuns:
    """Keys gathered over the levels of a crawl: ``column`` of the rows of
    ``<root>/<levels>/depth=<d>`` that satisfy ``where``.

    Levels are merged under ``<root>/<name>/run=<lo>-<hi>`` (levels lo to hi - 1) in
    sizes that are powers of RUN_LEVELS; a row is rewritten once per size. A run
    counts once its ``_SUCCESS`` marker is there, so a crawl that is resumed uses what
    was finished and reads single levels for the rest.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, levels: str, column: str, where=None):
        self.spark, self.root, self.name, self.levels, self.column, self.where = (
            spark, root, name, levels, column, where)
        self.written: set[tuple[int, int]] = set()
        self.schema: T.StructType | None = None          # of the levels, once known: no footers are read then

    def _run(self, lo: int, hi: int) -> str:
        return os.path.join(self.root, self.name, f"run={lo}-{hi}")

    def _has(self, lo: int, hi: int) -> bool:
        if (lo, hi) not in self.written and _done(self.spark, self._run(lo, hi)):
            self.written.add((lo, hi))
        return (lo, hi) in self.written

    def cover(self, lo: int, hi: int, below: int | None = None) -> list[tuple[int, int]]:
        """The finished runs and single levels that make up levels ``lo`` to ``hi - 1``;
        only runs smaller than ``below`` levels, if given."""
        out = []
        while lo < hi:
            size = grown = 1
            while lo % (grown := grown * RUN_LEVELS) == 0 and lo + grown <= hi and (below is None or grown < below):
                if self._has(lo, lo + grown):
                    size = grown
            out.append((lo, lo + size))
            lo += size
        return out

    def _keys(self, parts: list[tuple[int, int]]) -> DataFrame:
        single = [os.path.join(self.root, self.levels, f"depth={lo}") for lo, hi in parts if hi - lo == 1]
        runs = [self._run(lo, hi) for lo, hi in parts if hi - lo > 1]
        keys = None
        if runs:
            keys = self.spark.read.schema(f"{self.column} string").parquet(*runs)
        if single:
            rows = (self.spark.read if self.schema is None else self.spark.read.schema(self.schema)).parquet(*single)
            rows = rows.select(self.column) if self.where is None else rows.where(self.where).select(self.column)
            keys = rows if keys is None else keys.unionByName(rows)
        return keys

    def keys(self, levels: int) -> DataFrame | None:
        """The keys of levels 0 to ``levels - 1``."""
        parts = self.cover(0, levels)
        return self._keys(parts) if parts else None

    def merge(self, levels: int) -> None:
        """Write the runs that end with level ``levels - 1``."""
        size = RUN_LEVELS
        while levels % size == 0:
            lo = levels - size
            if not self._has(lo, levels):
                keys = self._keys(self.cover(lo, levels, below=size))
                _write(keys.coalesce(max(1, -(-keys.count() // ROWS_PER_RUN_FILE))), self._run(lo, levels))
                self.written.add((lo, levels))
            size *= RUN_LEVELS


class SeenKeys:
    """A set of strings, held as 128 bits of their SHA-256: the newest in a set, the rest sorted."""

    def __init__(self, digests: bytes = b""):
        self.sorted = np.sort(np.frombuffer(digests, "S16"))
        self.new: set[bytes] = set()

    @classmethod
    def of(cls, keys: DataFrame | None, column: str) -> "SeenKeys | None":
        """The keys of a table; None if they are more than SEEN_KEYS."""
        if keys is None:
            return cls()
        keys = keys.where(F.col(column).isNotNull())
        if keys.count() > SEEN_KEYS:
            return None
        digests = keys.select(F.unhex(F.substring(F.sha2(column, 256), 1, 32)).alias("k")).toArrow()["k"]
        return cls(b"".join(digests.to_pylist()))

    def __len__(self) -> int:
        return len(self.sorted) + len(self.new)

    @staticmethod
    def _digests(keys: list[str]) -> list[bytes]:
        return [hashlib.sha256(k.encode()).digest()[:16] for k in keys]

    def among(self, keys: list[str]) -> set[str]:
        """Those of ``keys`` that are in the set."""
        digests = self._digests(keys)
        found = {k for k, x in zip(keys, digests) if x in self.new}
        if len(self.sorted) and keys:
            asked = np.array(digests, "S16")
            at = np.minimum(np.searchsorted(self.sorted, asked), len(self.sorted) - 1)
            found.update(keys[i] for i in np.flatnonzero(self.sorted[at] == asked))
        return found

    def add(self, keys: list[str]) -> None:
        self.new.update(self._digests(keys))
        if len(self.new) > max(50_000, len(self.sorted) // 8):
            self.sorted = np.sort(np.concatenate([self.sorted, np.array(list(self.new), "S16")]))
            self.new = set()


def _site(spark: SparkSession, cap: DataFrame, edg: DataFrame, path: str) -> DataFrame:
    """Per captured URL its capture, route and links, in files over which a lookup is spread."""
    if not _done(spark, path):
        links = (edg.groupBy(F.col("src_url").alias("url"))
                 .agg(F.collect_list(F.struct("dst_url", "pos")).alias("links")))
        files = max(1, -(-cap.count() // ROWS_PER_SITE_FILE))
        _write(routed(cap).join(links, "url", "left").repartition(files, "url"), path)
    return spark.read.parquet(path)


def _nulls_first(*values) -> tuple:
    return tuple((v is not None, v) for v in values)


class Walk:
    """Small levels one after the other, each with one scan for the captures and links of its
    URLs. The level, the URLs visited and the tags seen are on the driver; what a level is
    follows :func:`fetch`, :func:`mark_kept` and the joins of :func:`crawl`."""

    def __init__(self, spark: SparkSession, site: DataFrame, level: DataFrame, visited: SeenKeys, tags: SeenKeys):
        self.spark, self.site, self.visited, self.tags = spark, site, visited, tags
        self.frontier_schema = level.schema
        self.level = [tuple(r) for r in level.collect()]          # url, referrer, pos
        self.captured = [f for f in site.schema.fields if f.name not in ("url", "links")]
        self.fetched_schema = T.StructType([*level.schema.fields, *self.captured, T.StructField("keep", T.BooleanType())])

    def fetch(self) -> Rows:
        """The level with captures, routes and ``keep``."""
        asked = Rows(self.spark, [(u,) for u, _, _ in self.level], T.StructType(self.frontier_schema.fields[:1]))
        found = {r["url"]: r for r in self.site.join(F.broadcast(asked.frame()), "url").toArrow().to_pylist()}
        missing = {f.name: None for f in self.captured} | {"route": "fetch_error", "links": None}
        rows = [(*row, found.get(row[0], missing)) for row in self.level]
        ok = sorted((r[0], r[3]["etag"]) for r in rows if r[3]["route"] == "success" and r[3]["etag"])
        seen = self.tags.among(list({etag for _, etag in ok}))
        first: dict[str, str] = {}
        for url, etag in ok:
            if etag not in seen:
                first.setdefault(etag, url)
        self.tags.add(list(first))
        self.links, fetched = [], []
        for url, referrer, pos, c in rows:
            keep = c["route"] == "success" and (not c["etag"] or first.get(c["etag"]) == url)
            fetched.append((url, referrer, pos, *[c[f.name] for f in self.captured], keep))
            if keep and c["extractor"] == "html":
                self.links += [(x["dst_url"], url, x["pos"]) for x in c["links"] or ()]
            if c["route"] == "redirect" and c["redirect_url"] != "":
                self.links.append((c["redirect_url"], url, -1))
        return Rows(self.spark, fetched, self.fetched_schema)

    def follow(self) -> Rows:
        """What the level leads to and was not visited, which is the next level."""
        first: dict[str | None, tuple] = {}
        for link in self.links:
            if link[0] not in first or _nulls_first(*link[1:]) < _nulls_first(*first[link[0]][1:]):
                first[link[0]] = link
        visited = self.visited.among([u for u in first if u is not None])
        self.level = [link for u, link in first.items() if u not in visited]
        self.visited.add([u for u, _, _ in self.level if u is not None])
        return Rows(self.spark, self.level, self.frontier_schema)


def _table_name(path: str) -> str:
    return "sitesift_" + os.path.basename(os.path.dirname(path)).replace("-", "_") + "_" + os.path.basename(path)


def _forget(spark: SparkSession, *paths: str) -> None:
    """Drop the catalog entries of a finished crawl's static tables; their files stay with it."""
    for path in paths:
        name = _table_name(path)
        if spark.catalog.tableExists(name):
            spark.sql(f"DROP TABLE {name}")


def _reopen(spark: SparkSession, path: str) -> DataFrame:
    """A static table of an interrupted crawl: the bucketed table when this
    session still knows it, else its staged Parquet files."""
    name = _table_name(path)
    if spark.catalog.tableExists(name):
        return spark.table(name)
    return spark.read.parquet(path + "_stage")


def crawl(spark: SparkSession, start_urls, captures: DataFrame, cfg: CrawlConfig,
          edges: DataFrame | None = None, use_etags: bool = True, root: str | None = None,
          resume: bool = False) -> CrawlResult:
    """D3 + D4: run the crawl to a fixpoint (or ``cfg.max_depth``).

    ``captures``: ``(page_id, url, html, status, content_type, etag,
    redirect_to)``. ``edges`` may be given precomputed (``src_url, dst_url,
    pos`` over normalised URLs); else they are extracted from the captures.
    Two writes per level: the fetch log (with the ETag verdict) and the
    next frontier; its size is observed while it is written. Levels of few
    rows are walked (:class:`Walk`), as long as the driver can hold what was seen.

    ``resume=True`` with the ``root`` of an interrupted crawl continues after
    the last completely written step (every step is a whole folder with a
    ``_SUCCESS`` marker, and rewriting a step is idempotent).
    """
    root = root or scratch_path(spark, "crawl")
    cap_path, edge_path = os.path.join(root, "captures"), os.path.join(root, "edges")

    def lvl(name, d):
        return os.path.join(root, name, f"depth={d}")

    # The loop reads back its own outputs every level; their schemas are
    # known, so no Parquet footers are read to infer them (that driver-side
    # work would grow with the number of files written so far).
    schemas: dict[str, T.StructType] = {}

    def read_back(name, d):
        sch = schemas.get(name)
        return (spark.read if sch is None else spark.read.schema(sch)).parquet(lvl(name, d))

    if resume and _done(spark, lvl("frontier", 0)):
        cap, edg = _reopen(spark, cap_path), _reopen(spark, edge_path)
        d = 0
        while _done(spark, lvl("frontier", d + 1)):
            d += 1
        n = spark.read.parquet(lvl("frontier", d)).count()
    else:
        if edges is None:
            edges = html_edges(captures, cfg)
        # the two static sides of every level's joins, bucketed by their join key
        cap = _write_bucketed(spark, capture_index(captures, cfg), cap_path, "url")
        edg = _write_bucketed(spark, edges, edge_path, "src_url")
        seeds = seed_frontier(spark, start_urls, cfg).select(*FRONTIER_COLS).drop("depth")
        n = _write_counted(seeds, lvl("frontier", 0))
        d = 0
    schemas["frontier"] = spark.read.parquet(lvl("frontier", 0)).schema
    # what a level can lead to at most, by its number of rows: links of the fullest page and a redirect
    most = 1 + (edg.groupBy("src_url").count().agg(F.max("count")).first()[0] or 0)
    if not use_etags:
        cap = cap.withColumn("etag", F.lit(None).cast("string"))
    visited = LevelRuns(spark, root, "visited", "frontier", "url")
    tags = LevelRuns(spark, root, "tags", "fetched", "etag",
                     F.col("keep") & F.col("etag").isNotNull() & (F.col("etag") != ""))
    visited.schema = schemas["frontier"]
    levels = d
    walk, walks = None, True
    while n > 0:
        levels = d + 1
        if walks and n <= FEW_ROWS and n * most <= WALK_ROWS:
            if walk is None:
                seen = [SeenKeys.of(visited.keys(d + 1), "url"), SeenKeys.of(tags.keys(d) if use_etags else None, "etag")]
                if walks := None not in seen:
                    walk = Walk(spark, _site(spark, cap, edg, os.path.join(root, "site")), read_back("frontier", d), *seen)
            elif max(len(walk.visited), len(walk.tags)) > SEEN_KEYS:
                walk, walks = None, False
        else:
            walk = None
        if walk:
            out = walk.fetch()
            schemas["fetched"] = tags.schema = out.schema
            if not _done(spark, lvl("fetched", d)):
                out.write(lvl("fetched", d))
            if cfg.max_depth is not None and d + 1 > cfg.max_depth:
                break
            visited.merge(d + 1)
            if use_etags:
                tags.merge(d + 1)
            d += 1
            n = _write_counted(walk.follow(), lvl("frontier", d))
            continue
        few = n <= FEW_ROWS and n * most <= SMALL_SIDE_ROWS
        if not _done(spark, lvl("fetched", d)):
            level = read_back("frontier", d).withColumn("depth", F.lit(d))
            if few:
                level = level.coalesce(1)
            out = fetch(level, cap, few)
            if not use_etags:
                out = out.withColumn("keep", F.col("route") == "success")
            else:
                out = (mark_few_kept if few else mark_kept)(out, tags.keys(d))
            out = out.drop("depth")
            _write(out, lvl("fetched", d))
            schemas["fetched"] = tags.schema = out.schema
        if cfg.max_depth is not None and d + 1 > cfg.max_depth:
            break
        visited.merge(d + 1)
        if use_etags:
            tags.merge(d + 1)
        fetched = read_back("fetched", d)
        # links are followed from kept html documents only; other types have none
        parents = fetched.where(F.col("keep") & (F.col("extractor") == "html")).select(F.col("url").alias("src_url"))
        children = ((F.broadcast(parents) if few else parents).join(edg, "src_url")
                    .select(F.col("dst_url").alias("url"), F.col("src_url").alias("referrer"), "pos"))
        redirects = (fetched.where((F.col("route") == "redirect") & (F.col("redirect_url") != ""))
                     .select(F.col("redirect_url").alias("url"), F.col("url").alias("referrer"),
                             F.lit(-1).alias("pos")))
        cand = first_per_key(children.unionByName(redirects), "url", ["referrer", "pos"])
        # semi then anti join: AQE broadcasts the candidates when they are
        # small at runtime, so the growing visited set is scanned, not shuffled
        before = visited.keys(d + 1)
        new = cand.join(_hits(before, cand, "url"), "url", "left_anti") if few else anti_join_seen(cand, before, "url")
        d += 1
        n = _write_counted(new.select("url", "referrer", "pos"), lvl("frontier", d))
    _forget(spark, cap_path, edge_path)
    return CrawlResult(root, levels)
