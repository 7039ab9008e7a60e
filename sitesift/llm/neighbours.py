"""Approximate nearest neighbours by inner product: inverted lists, scanned by
column blocks with early abandoning (adaptive dimension scan).

Vectors get one more component that puts all of them on one sphere, so the
largest inner product is the smallest distance, and are turned by a random
rotation. k-means over a bounded sample gives the lists. A list is scanned
column block by column block: after every block the distance over the columns
so far, scaled to all columns, is tested against the query's kth best distance,
and a candidate that is too far with a margin of ``EPS / sqrt(columns)`` is
abandoned. What is left after the last block is scored on the original vectors,
in double precision and in component order, so equal vectors score equally.

The number of lists a query probes is measured, not set: the exact neighbours
of ``CALIBRATION`` queries are found by a full scan, and the fewest lists that
hold ``TARGET`` of them are probed. Every row is indexed; nothing is capped.

At scale: equal vectors are one candidate with its k + 1 smallest vec_ids (a
query drops at most its own) and equal queries are asked once, so copies cost
nothing. Candidates are shuffled once, by units of bounded bytes: small lists
that lie near each other share a unit, a large list is dealt over many. A query
goes once to every unit it probes, and a task holds one unit and streams the
queries. Broadcast are the rotation, the centroids and a sample, all of bounded
size for a given width. The work grows with queries x rows x share of lists
probed, which is what the data's own clustering allows.

Defined cases: vectors that are null, zero or hold null, NaN or infinite
components take no part, nor do rows with null vec_id; shorter vectors are
padded with zeros; norms must be finite as doubles; equal rows count once; a
vec_id with several vectors is a candidate and a query with each, and none of
them is its own neighbour; fewer than k candidates are all returned; empty
tables give an empty result; other columns are ignored. Reruns agree.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .topk import matrix

LISTS = 1024                # lists at most
SMALL = 1024                # up to so many vectors are one list, scanned in full
SAMPLE = 16_384             # vectors k-means learns from, at most
BOUND = 4_096               # of these, vectors that give a first bound on the kth distance
SAMPLE_BYTES = 32 << 20     # and fewer where vectors are wide
UNIT_BYTES = 32 << 20       # vectors one task holds at a time
COLUMNS = 16                # columns of a block
EPS = 2.1                   # margin of the test, in standard errors of the distance over some columns
CALIBRATION = 256           # queries answered exactly to choose the number of lists
TARGET = 0.95               # share of their neighbours that the probed lists hold
TILE = 1024                 # candidates, and queries, compared at once
SEED = 11


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.col("embedding")
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return (vectors.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(~bad).where(F.exists(v, lambda e: e != 0))
            .select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")))


def rotation(width: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


class Space:
    """The rotated sphere: what the tasks need to place candidates and queries."""

    def __init__(self, width: int, radius: float):
        self.width, self.radius, self.turn = width, radius, rotation(width + 1)

    def candidates(self, x: np.ndarray) -> np.ndarray:
        lift = np.sqrt(np.maximum(self.radius ** 2 - (x ** 2).sum(axis=1), 0))
        return np.column_stack([x, lift]) @ self.turn

    def queries(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rotated, distance by which one unit of inner product is nearer)."""
        gain = self.radius / np.sqrt((x ** 2).sum(axis=1))
        return np.column_stack([x * gain[:, None], np.zeros(len(x))]) @ self.turn, 2 * gain

    def nearest(self, y: np.ndarray) -> np.ndarray:
        return np.argmin((self.centres ** 2).sum(axis=1) - 2 * (y @ self.centres.T), axis=1)

    def order(self, y: np.ndarray) -> np.ndarray:
        """Lists from the nearest on, per query."""
        return np.argsort((self.centres ** 2).sum(axis=1) - 2 * (y @ self.centres.T), axis=1, kind="stable")

    def fit(self, sample: np.ndarray, lists: int) -> None:
        """k-means over the rotated sample, from evenly spread members of it."""
        self.centres = sample[np.linspace(0, len(sample) - 1, lists).astype(int)]
        for _ in range(12 if lists > 1 else 1):
            at = self.nearest(sample)
            n = np.bincount(at, minlength=lists)
            total = np.zeros_like(self.centres)
            np.add.at(total, at, sample)
            self.centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], self.centres)

    def chain(self) -> list[int]:
        """Lists in an order that keeps near ones together."""
        left, out = set(range(1, len(self.centres))), [0]
        while left:
            rest = np.fromiter(left, int)
            gap = ((self.centres[rest] - self.centres[out[-1]]) ** 2).sum(axis=1)
            out.append(int(rest[gap.argmin()]))
            left.remove(out[-1])
        return out

    def deal(self, sizes: np.ndarray, rows: int) -> None:
        """Units of about ``rows`` candidates: the first of every list and how many it has."""
        self.first, self.parts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
        self.sizes, unit, filled = sizes, 0, 0
        for i in self.chain():
            if filled and filled + sizes[i] > rows:
                unit, filled = unit + 1, 0
            self.first[i], self.parts[i] = unit, max(1, -(-sizes[i] // rows))
            if self.parts[i] > 1:
                unit += int(self.parts[i])
            else:
                filled += sizes[i]
        self.units = unit + 1

    def limit(self, columns: int) -> float:
        """Share of the squared kth distance beyond which the first columns abandon a candidate."""
        whole = self.width + 1
        return 1.0 if columns >= whole else columns / whole * (1 + EPS / math.sqrt(columns)) ** 2


def first_per_row(row: np.ndarray, n: int) -> np.ndarray:
    """Which entries are among the first n of their row (rows sorted)."""
    return np.arange(len(row)) - np.searchsorted(row, row) < n


def sizes(shared):
    """Task function: (list, n) of the candidates."""
    def run(batches):
        space = shared.value
        total = np.zeros(len(space.centres), np.int64)
        for batch in batches:
            at = space.nearest(space.candidates(matrix(batch.column("v"), space.width, np.float64)))
            total += np.bincount(at, minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)],
                                         names=["list", "n"])
    return run


def exact(shared, k: int):
    """Task function: (q, score, id, list) of the best candidates of the calibration queries."""
    def run(batches):
        space, q, own = shared.value
        for batch in batches:
            x = matrix(batch.column("v"), space.width, np.float64)
            score = q @ x.T
            ids = batch.column("ids")
            at, flat = np.asarray(ids.offsets), np.asarray(ids.values)
            entry, row = flat[at[0]:at[-1]], np.repeat(np.arange(len(x)), np.diff(at))
            here = np.minimum(np.searchsorted(own[0], entry), len(own[0]) - 1)
            hit = own[0][here] == entry
            score[own[1][here[hit]], row[hit]] = -np.inf                 # the query's own class
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]
            row, col = np.repeat(np.arange(len(q)), best.shape[1]), best.ravel()
            keep = np.isfinite(score[row, col])
            row, col = row[keep], col[keep]
            lists = space.nearest(space.candidates(x))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row.astype(np.int32)), pa.array(score[row, col]), pa.array(flat[at[:-1]][col]),
                 pa.array(lists[col].astype(np.int32))], names=["q", "score", "id", "list"])
    return run


STREAM = ("unit int, kind int, list int, v {v}, ids array<bigint>, q bigint, own bigint, probes array<int>, "
          "bound double")


def place(shared, schema: pa.Schema):
    """Task function: candidates with their list and unit."""
    def run(batches):
        space = shared.value
        for batch in batches:
            at = space.nearest(space.candidates(matrix(batch.column("v"), space.width, np.float64)))
            unit = space.first[at] + np.asarray(batch.column("h")) % space.parts[at]
            n = batch.num_rows
            have = {"unit": pa.array(unit.astype(np.int32)), "kind": pa.array(np.zeros(n, np.int32)),
                    "list": pa.array(at.astype(np.int32)), "v": batch.column("v"), "ids": batch.column("ids")}
            yield pa.RecordBatch.from_arrays([have[f.name] if f.name in have else pa.nulls(n, f.type)
                                              for f in schema], schema=schema)
    return run


def probe(shared, schema: pa.Schema, k: int):
    """Task function: a row for every query and unit it probes, with the lists
    there and a first bound on the squared kth distance: that of the (k + 1)th
    best vector of the sample in the probed lists."""
    def run(batches):
        space, probes, sample, sample_list = shared.value
        lists = len(space.centres)
        for whole in batches:
            for lo in range(0, whole.num_rows, TILE):
                batch = whole.slice(lo, TILE)
                y, _ = space.queries(matrix(batch.column("v"), space.width, np.float64))
                order = space.order(y)
                short = space.sizes[order].cumsum(axis=1) - space.sizes[order] < k + 1   # too few candidates so far
                rank = np.empty_like(order)
                np.put_along_axis(rank, order, (short | (np.arange(lists) < probes)).astype(order.dtype), axis=1)
                asked = rank > 0                                        # queries x lists
                own = np.array([x is not None for x in batch.column("own").to_pylist()])
                bound = np.full(len(y), np.inf)
                if len(sample) > k:
                    gap = 2 * space.radius ** 2 - 2 * (y @ sample.T)
                    gap = np.where(asked[:, sample_list], gap, np.inf)
                    bound = np.where(own, np.inf, np.partition(gap, k, axis=1)[:, k])
                row, at = np.nonzero(asked)
                copies = space.parts[at]
                row, at = np.repeat(row, copies), np.repeat(at, copies)
                unit = space.first[at] + np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
                sort = np.lexsort((at, unit, row))
                row, at, unit = row[sort], at[sort], unit[sort]
                start = np.nonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(unit) != 0)])[0]
                rows = batch.take(pa.array(row[start]))
                n = len(start)
                have = {"unit": pa.array(unit[start].astype(np.int32)), "kind": pa.array(np.ones(n, np.int32)),
                        "v": rows.column("v"), "q": rows.column("q"), "own": rows.column("own"),
                        "probes": pa.ListArray.from_arrays(pa.array(np.r_[start, len(at)].astype(np.int32)),
                                                           pa.array(at.astype(np.int32))),
                        "bound": pa.array(bound[row[start]])}
                yield pa.RecordBatch.from_arrays([have[f.name].cast(f.type) if f.name in have else pa.nulls(n, f.type)
                                                  for f in schema], schema=schema)
    return run


class Unit:
    """The candidates of one unit, rotated, by list."""

    def __init__(self, space: Space, parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts)
        x = matrix(table.column("v"), space.width, np.float64)
        self.y, self.x = space.candidates(x), np.ascontiguousarray(x.T)
        self.ids = table.column("ids").combine_chunks()
        at, flat = np.asarray(self.ids.offsets), np.asarray(self.ids.values)
        self.lowest = flat[at[:-1]]
        self.single = np.diff(at) == 1
        lists = np.asarray(table.column("list"))                       # sorted
        cut = np.r_[0, np.nonzero(np.diff(lists))[0] + 1, len(lists)]
        self.ranges = [(int(lists[a]), int(a), int(b)) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def survivors(space: Space, y: np.ndarray, unit: Unit, lo: int, hi: int, kth: np.ndarray):
    """(query, candidate) pairs that no column block abandons."""
    c, blocks = unit.y[lo:hi], range(0, space.width + 1, COLUMNS)
    slack = 1e-9 * space.radius ** 2
    row = col = gap = None
    for at in blocks:
        a, b = y[:, at:at + COLUMNS], c[:, at:at + COLUMNS]
        if row is None:
            whole = (a ** 2).sum(axis=1)[:, None] + (b ** 2).sum(axis=1)[None, :] - 2 * (a @ b.T)
            row, col = np.nonzero(whole <= (kth * space.limit(at + COLUMNS) + slack)[:, None])
            gap = whole[row, col]
            continue
        gap = gap + ((a[row] - b[col]) ** 2).sum(axis=1)
        keep = gap <= kth[row] * space.limit(at + COLUMNS) + slack
        row, col, gap = row[keep], col[keep], gap[keep]
    return row, col + lo


def answer(space: Space, unit: Unit, part: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """(q, score, ids): the k + 1 best candidate classes of the unit per query."""
    x = matrix(part.column("v"), space.width, np.float64)
    y, gain = space.queries(x)
    kth = np.asarray(part.column("bound")).copy()
    own_col = part.column("own")
    has_own, own = np.asarray(own_col.is_valid()), np.asarray(own_col.fill_null(0))
    probes = part.column("probes")
    at, flat = np.asarray(probes.offsets), np.asarray(probes.values)
    lists, who = flat[at[0]:at[-1]], np.repeat(np.arange(len(x)), np.diff(at))
    best = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    for number, lo, hi in unit.ranges:
        asked = who[lists == number]
        if not len(asked):
            continue
        for a in range(lo, hi, TILE):
            row, col = survivors(space, y[asked], unit, a, min(a + TILE, hi), kth[asked])
            row = asked[row]
            keep = ~(has_own[row] & unit.single[col] & (unit.lowest[col] == own[row]))
            row, col = row[keep], col[keep]
            score = np.zeros(len(row))
            for d in range(space.width):
                score += x[row, d] * unit.x[d, col]
            row, score, col = (np.concatenate(z) for z in zip(best, (row, score, col), strict=True))
            sort = np.lexsort((unit.lowest[col], -score, row))
            row, score, col = row[sort], score[sort], col[sort]
            keep = first_per_row(row, k + 1)
            best = row, score, col = row[keep], score[keep], col[keep]
            last = np.nonzero(np.r_[np.diff(row) != 0, True])[0] if len(row) else np.zeros(0, int)
            full = last[last - np.searchsorted(row, row[last]) == k]
            found = 2 * space.radius ** 2 - gain[row[full]] * score[full]
            kth[row[full]] = np.minimum(kth[row[full]], found)
    row, score, col = best
    return pa.RecordBatch.from_arrays([part.column("q").take(pa.array(row)), pa.array(score),
                                       unit.ids.take(pa.array(col))], names=["q", "score", "ids"])


def scan(shared, k: int):
    """Task function over rows sorted by unit, candidates before queries: one
    unit's candidates are held, its queries stream past."""
    def run(batches):
        space = shared.value
        number, held, unit = None, [], None
        for batch in batches:
            u, kind = np.asarray(batch.column("unit")), np.asarray(batch.column("kind"))
            cut = np.r_[0, np.nonzero(np.diff(u) | np.diff(kind))[0] + 1, len(u)]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if u[lo] != number:
                    number, held, unit = u[lo], [], None
                if kind[lo] == 0:
                    held.append(batch.slice(lo, hi - lo))
                elif held:
                    unit = unit or Unit(space, held)
                    for a in range(lo, hi, TILE):
                        yield answer(space, unit, batch.slice(a, min(TILE, hi - a)), k)
    return run


def probes_needed(space: Space, classes: DataFrame, asks: DataFrame, k: int) -> int:
    """The fewest lists that hold ``TARGET`` of the exact neighbours of a sample of the queries."""
    spark = classes.sparkSession
    sample = asks.orderBy(F.xxhash64("v"), "v").limit(CALIBRATION).select("v", "lowest").collect()
    q = np.array([list(r["v"]) + [0.0] * (space.width - len(r["v"])) for r in sample], np.float64)[:, :space.width]
    ids = np.array([r["lowest"] for r in sample], np.int64)
    sort = np.argsort(ids, kind="stable")
    shared = spark.sparkContext.broadcast((space, q, (ids[sort], sort)))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    found = (classes.mapInArrow(exact(shared, k), "q int, score double, id bigint, list int")
             .withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).select("q", "list").toPandas())
    if not len(found):
        return 1
    order = space.order(space.queries(q)[0])
    rank = np.argsort(order, axis=1)[found["q"], found["list"]]
    held = np.bincount(rank, minlength=len(space.centres)).cumsum() / len(rank)
    return int(np.searchsorted(held, TARGET) + 1)


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query, for
    tables (vec_id, embedding array of float or double)."""
    spark = candidates.sparkSession
    rows = staged(usable(candidates).distinct(), "ann-rows")
    asked = usable(queries).distinct()
    several = rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("vec_id", F.lit(True).alias("_own"))
    asked = staged(asked.join(several, "vec_id", "left")
                   .select("vec_id", "v", F.when(F.col("_own"), F.col("vec_id")).alias("own")), "ann-asked")
    asks = staged(asked.groupBy("v", "own").agg(F.min("vec_id").alias("lowest"))
                  .withColumn("q", F.monotonically_increasing_id()), "ann-asks")
    held = rows.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id")))
    classes = staged(held.where(F.col("_n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
                     .withColumn("h", F.pmod(F.xxhash64("v"), F.lit(1 << 30))), "ann-classes")

    square = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    n, radius, width = classes.agg(F.count(F.lit(1)), F.sqrt(F.max(square)), F.max(F.size("v"))).first()
    if not n or not asks.take(1):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    space = Space(int(width), float(radius))
    bound = min(SAMPLE, max(SMALL, SAMPLE_BYTES // (8 * width)))
    sample = classes.orderBy("h", "v").limit(bound).select("v").toArrow().column("v")
    sample = space.candidates(matrix(sample, space.width, np.float64))
    lists = 1 if n <= SMALL else min(LISTS, 2 ** round(math.log2(math.sqrt(n) / 2)), len(sample))
    space.fit(sample, lists)

    shared = spark.sparkContext.broadcast(space)
    counted = classes.mapInArrow(sizes(shared), "list int, n bigint").groupBy("list").agg(F.sum("n").alias("n")).toPandas()
    per_list = np.zeros(lists, np.int64)
    per_list[counted["list"]] = counted["n"]
    each = max(SMALL, -(-n // (4 * spark.sparkContext.defaultParallelism)))
    space.deal(per_list, int(min(each, max(SMALL, UNIT_BYTES // (8 * width)))))
    probes = probes_needed(space, classes, asks, k) if lists > 1 else 1
    known = sample[:min(BOUND, n // 8)] if lists > 1 else sample[:0]

    kind = dict(classes.dtypes)["v"]
    stream = STREAM.format(v=kind)
    schema = spark.createDataFrame([], stream).toArrow().schema
    shared = spark.sparkContext.broadcast(space)
    guide = spark.sparkContext.broadcast((space, probes, known, space.nearest(known) if len(known) else []))
    placed = classes.mapInArrow(place(shared, schema), stream)
    sent = asks.select(F.col("v").cast(kind).alias("v"), "own", "q").mapInArrow(probe(guide, schema, k), stream)
    hits = (placed.unionByName(sent).repartition(space.units, "unit").sortWithinPartitions("unit", "kind", "list")
            .mapInArrow(scan(shared, k), "q bigint, score double, ids array<bigint>"))

    best = Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0])
    hits = staged(hits.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1).drop("_n"), "ann-hits")
    pair = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("i")))
    answers = hits.groupBy("q").agg(F.sort_array(F.flatten(F.collect_list(pair))).alias("all"))
    found = (asked.withColumnRenamed("vec_id", "query_id")
             .join(asks.select("v", "own", "q"), (asked["v"] == asks["v"]) & asked["own"].eqNullSafe(asks["own"]))
             .select("query_id", "q").join(answers, "q")
             .withColumn("all", F.slice(F.filter("all", lambda x: x["i"] != F.col("query_id")), 1, k)))
    return (found.select("query_id", F.posexplode("all").alias("_n", "_x"))
            .select("query_id", (F.col("_n") + 1).alias("rank"), F.col("_x.i").alias("vec_id"),
                    (-F.col("_x.s")).alias("score")))
