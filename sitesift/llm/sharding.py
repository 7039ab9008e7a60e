"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has 65,536 positions; each shard owns the arcs that end at its
virtual nodes. A key goes to the shard of its arc while that shard is under its
bound; keys that overflow continue clockwise to the next shard with room. With
load factor 1 the bounds add up to the number of rows, so counts differ by at
most one; with a larger factor fewer keys move.

DataFrame and SQL functions only. At scale: rows are counted per ring cell
(map-side combined), the walk around the ring folds over the arcs' counts (as
many as there are virtual nodes, whatever the input), and a row finds its shard
from its rank in its arc: the offset of its cell plus its rank within the cell.
Cells hold about ``ROWS_PER_CELL`` rows or fewer, so no task sorts a shard. Each
row is shuffled once, on its cell.

Defined cases: null text counts 0 bytes and checksum 0, as empty text does; a
null doc_id hashes as a value; rows equal in doc_id, checksum and size are
interchangeable and get different slots; an empty table gives an empty result;
other columns pass through, but for those named like an output column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged

RING_BITS = 16
VNODES = 64
ROWS_PER_CELL = 20_000
SHARDS = 24


def ring_hash(*cols: Column) -> Column:
    return F.xxhash64(F.lit("ring"), *cols)


def ring(spark: SparkSession, shards: int, vnodes: int = VNODES) -> DataFrame:
    """Ring position -> (arc, shard): the next virtual node clockwise. A fixed
    65,536 rows; of two virtual nodes at one position the lower shard stays."""
    size = 1 << RING_BITS
    nodes = (spark.range(shards * vnodes).select(
        F.pmod(F.xxhash64(F.lit("node"), F.col("id")), F.lit(size)).alias("node"), (F.col("id") % shards).alias("shard"))
        .groupBy("node").agg(F.min("shard").cast("int").alias("shard")))
    at = spark.range(size).join(F.broadcast(nodes), F.col("id") == F.col("node"), "left")
    here = F.when(F.col("node").isNotNull(), F.struct(F.col("node").alias("arc"), "shard"))
    onward = Window.orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.min(here).over(Window.partitionBy())
    return at.select(F.col("id").alias("_pos"),
                     F.coalesce(F.last(here, ignorenulls=True).over(onward), first).alias("_n")).select("_pos", "_n.*")


def segments(arcs: DataFrame, shards: int, capacity: list[int]) -> DataFrame:
    """(arc, shard, lo, n, slot_lo) from (arc, shard, rows): keys ranked lo to
    lo + n - 1 in their arc go to that shard. Home keys first; what overflows an
    arc walks clockwise over the shards that still have room."""
    cap = F.array(*[F.lit(int(c)).cast("long") for c in capacity])
    home = arcs.withColumn("_before", F.sum("rows").over(Window.partitionBy("shard").orderBy("arc")) - F.col("rows"))
    home = home.withColumn("kept", F.greatest(F.lit(0).cast("long"), F.least(
        F.col("rows"), F.element_at(cap, F.col("shard") + 1) - F.col("_before"))))
    packed = home.groupBy().agg(
        F.sort_array(F.collect_list(F.struct("arc", "shard", "rows", "kept"))).alias("ring"))
    used = "aggregate(filter(ring, a -> a.shard = s), 0L, (t, a) -> t + a.kept)"
    walked = packed.select("ring", F.expr(f"""
        transform({'array(' + ','.join(f'{int(c)}L' for c in capacity) + ')'}, (c, s) -> c - {used})""").alias("room"))
    walked = walked.selectExpr(f"""aggregate(
        filter(transform(ring, (a, i) -> named_struct('arc', a.arc, 'lo', a.kept, 'left', a.rows - a.kept, 'order',
            if(a.rows > a.kept, array_distinct(transform(concat(slice(ring, i + 2, size(ring)), slice(ring, 1, i + 1)),
                                                         b -> b.shard)), array()))),
               a -> a.left > 0),
        named_struct('room', room, 'out', CAST(array() AS array<struct<arc:bigint,shard:int,lo:bigint,n:bigint>>)),
        (acc, a) -> aggregate(
            filter(a.order, s -> acc.room[s] > 0),
            named_struct('room', acc.room, 'out', acc.out, 'left', a.left, 'lo', a.lo),
            (st, s) -> named_struct(
                'room', transform(st.room, (r, k) -> if(k = s, r - least(st.left, r), r)),
                'out', if(st.left > 0, concat(st.out, array(named_struct('arc', a.arc, 'shard', s, 'lo', st.lo,
                                                                          'n', least(st.left, st.room[s])))), st.out),
                'left', st.left - least(st.left, st.room[s]),
                'lo', st.lo + least(st.left, st.room[s])),
            st -> named_struct('room', st.room, 'out', st.out))).out AS out""")
    moved = walked.select(F.inline("out")).withColumn("moved", F.lit(1))
    kept = home.where("kept > 0").select("arc", "shard", F.lit(0).cast("long").alias("lo"), F.col("kept").alias("n"),
                                         F.lit(0).alias("moved"))
    both = kept.unionByName(moved)
    start = F.sum("n").over(Window.partitionBy("shard").orderBy("moved", "arc", "lo")) - F.col("n")
    return both.withColumn("slot_lo", start)


def capacities(rows: int, shards: int, load_factor: float = 1.0) -> list[int]:
    """Rows each shard may hold; at factor 1 they add up to ``rows``."""
    if load_factor > 1:
        return [math.ceil(rows * load_factor / shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def assign(rows: DataFrame, key: Column, shards: int = SHARDS, vnodes: int = VNODES,
           load_factor: float = 1.0) -> DataFrame:
    """``rows`` with int ``shard`` and long ``slot`` (gapless from 0 in each
    shard), placed by the 64-bit hash ``key``. ``rows`` is read twice: once to
    count its keys, once to place them."""
    spark = rows.sparkSession
    names = [c for c in rows.columns if c not in ("shard", "slot")]
    keyed = rows.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), key.alias("_key"))
    n = keyed.count()
    extra = max(0, math.ceil(math.log2(max(1, n / ROWS_PER_CELL) / (1 << RING_BITS)))) if n else 0
    at = F.broadcast(ring(spark, shards, vnodes))     # a fixed number of rows
    cell = F.shiftrightunsigned("_key", 64 - RING_BITS - extra)

    counted = (keyed.groupBy(cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_pos", F.shiftrightunsigned("_cell", extra)).join(at, "_pos"))
    cells = staged(counted.select("_cell", "_n", "arc", "shard"), "shard-cells")
    offset = F.sum("_n").over(Window.partitionBy("arc").orderBy("_cell")) - F.col("_n")
    offsets = cells.select(F.col("_cell"), F.col("arc").alias("_arc"), offset.alias("_offset"))

    arcs = at.select("arc", "shard").distinct().join(
        F.broadcast(cells.groupBy(F.col("arc").alias("_a")).agg(F.sum("_n").alias("_rows"))),
        F.col("arc") == F.col("_a"), "left").select("arc", "shard", F.coalesce("_rows", F.lit(0)).alias("rows"))
    parts = staged(segments(arcs, shards, capacities(n, shards, load_factor)), "shard-segments")
    parts = F.broadcast(parts.select(F.col("arc").alias("_arc"), "shard", F.col("lo").alias("_lo"),
                                     F.col("n").alias("_len"), "slot_lo"))  # at most arcs * shards rows

    rank = F.row_number().over(Window.partitionBy("_cell").orderBy("_key", "_row")) - 1
    ranked = (keyed.withColumn("_cell", cell).withColumn("_rank", rank).join(offsets, "_cell")
              .withColumn("_rank", F.col("_rank") + F.col("_offset")))
    inside = F.col("_rank") - F.col("_lo")
    return (ranked.join(parts, "_arc").where((inside >= 0) & (inside < F.col("_len")))
            .select("_row.*", "shard", (F.col("slot_lo") + inside).cast("long").alias("slot")))


def row_key() -> Column:
    return ring_hash(F.col("doc_id"), F.col("text_crc32"), F.col("size"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 8), text_crc32 of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
