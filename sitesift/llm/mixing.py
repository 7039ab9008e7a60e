"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key whose rate is its quality weight, so
that sorting a source by key is a weighted sample without replacement. A
source takes complete epochs of all its documents first; the rest of its
target is filled by the documents of smallest key, up to the document where
the prefix sum of sizes comes nearest to the target.

At scale: the prefix sum runs in two levels. Sizes are summed per
(source, key bucket) with map-side combine, which places the cut of every
source in one bucket; only that bucket's groups of equal rows are sorted.
Buckets are ranges of the key's logarithm, whose distribution has the same
spread whatever the weight: none holds over 1 % of a source's distinct rows,
and their number grows with the rows. Equal rows share a key and are counted,
not sorted; if a cut falls among them, as many as bring the source nearest to
its target are taken, by their place in the written table, again in two levels.
No text is shuffled.

Defined cases: null text has size 0 and weight 1; a null source is a source of
its own, sorted last; documents of size 0 are taken when their key lies before
the cut, and never beyond the epochs of a source that has none; a source without words has target 0 and takes nothing; rows that
repeat a doc_id (or hold null) draw different keys if their texts differ, and are
taken one by one if not; an empty table gives an empty result; other columns pass through ``mix`` unchanged,
but for one named like an output column, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_side, staged, word_count

SOURCE_WEIGHTS = (3, 1, 2)     # repeating, over sources by code point
SHARE = 1.5                    # of all sizes
MAX_EPOCHS = 2                 # a target stops at so many times its source's size
SEED = "mix"
LEAST_PER_UNIT, ROWS_PER_BUCKET = 64, 20_000      # buckets a unit of ln(key), of which the densest holds 0.37 of the rows
MIN_QUALITY = 0.1


def quality_weight(text: Column) -> Column:
    """Share of characters that are not ASCII capitals, digits or symbols,
    at least 0.1: prose draws smaller keys than shouting or markup."""
    n = F.length(text)
    kept = F.length(F.regexp_replace(text, r"[!-`{-~]+", ""))
    return F.when(n > 0, F.greatest(F.lit(MIN_QUALITY), kept / n)).otherwise(F.lit(1.0))


def sampling_key(doc_id: Column, text: Column, weight: Column, seed: str = SEED) -> Column:
    """-ln(u) / weight, u in (0, 1) from 52 bits of a hash of the id and the text."""
    shown = F.coalesce(doc_id.cast("string"), F.lit("null"))
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), shown, F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))
    bits = F.conv(F.substring(drawn, 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(2 ** 52)) / weight


def measure(docs: DataFrame, weight: Column | None = None, seed: str = SEED) -> DataFrame:
    """The columns the sampling needs: doc_id, source, size, key."""
    w = quality_weight(F.col("text")) if weight is None else weight
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       word_count(F.col("text")).alias("size"),
                       sampling_key(F.col("doc_id"), F.col("text"), w, seed).alias("key"))


def source_targets(sizes: DataFrame, weights=SOURCE_WEIGHTS, share: float = SHARE,
                   max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of (source, source_size): the budget is shared by weight, capped
    at ``max_epochs`` sizes, the excess reshared until no target is above its
    cap. Sorted by cap per weight the capped sources are a prefix, so the fixed
    point is one pass of prefix sums. One row per source."""
    everything = Window.partitionBy()
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    ranked = (ranked
              .withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                             (F.col("_rank") % len(weights) + 1).cast("int")))
              .withColumn("_cap", F.col("source_size") * float(max_epochs))
              .withColumn("_ratio", F.col("_cap") / F.col("_w"))
              .withColumn("_all", F.sum("source_size").over(everything)))
    order = Window.orderBy("_ratio", "_rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.col("_all") * share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
             / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    leveled = ranked.withColumn("_level", level).withColumn("_pos", F.row_number().over(order))
    first = F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_pos", "_level"))).over(everything)
    return leveled.withColumn("_first", first).select(
        "source", "source_size",
        F.when(F.col("_first").isNull() | (F.col("_pos") < F.col("_first._pos")), F.col("_cap"))
        .otherwise(F.col("_w") * F.col("_first._level")).alias("target"))


def cuts(rows: DataFrame, weights=SOURCE_WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS):
    """(one row per source with its target, epochs, cut and how many of the cut's equal
    rows are taken; buckets a unit) for measured ``rows``, which are read three times
    (pass a staged table)."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n"))
    sizes = staged(sizes, "mix-sizes")
    n = sizes.agg(F.sum("_n")).first()[0] or 0
    buckets = max(LEAST_PER_UNIT, int(0.37 * n) // ROWS_PER_BUCKET)
    targets = (source_targets(sizes.select("source", "source_size"), weights, share, max_epochs)
               .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                           .otherwise(0).cast("int"))
               .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    targets = small_side(targets, "mix-targets")

    by_bucket = (rows.groupBy("source", bucket_of(F.col("key"), buckets).alias("cut_bucket"))
                 .agg(F.sum("size").alias("_sum")))
    cum = F.sum("_sum").over(Window.partitionBy("source").orderBy("cut_bucket"))
    t = targets.select(F.col("source").alias("_source"), "rest")
    cut_bucket = (by_bucket.withColumn("_cum", cum).join(t, F.col("source").eqNullSafe(F.col("_source")))
                  .where((F.col("rest") > 0) & (F.col("_cum") > F.col("rest"))).groupBy("source")
                  .agg(F.min(F.struct("cut_bucket", (F.col("_cum") - F.col("_sum")).alias("base"))).alias("_b"))
                  .select(F.col("source").alias("_source"), "_b.*"))
    cut_bucket = small_side(cut_bucket, "mix-buckets")

    inside = (rows.join(cut_bucket, F.col("source").eqNullSafe(F.col("_source"))
                        & (bucket_of(F.col("key"), buckets) == F.col("cut_bucket")))
              .groupBy("source", "base", "key", "doc_id", "size").agg(F.count(F.lit(1)).alias("_rows"))
              .withColumn("_before", F.col("base") + F.coalesce(F.sum(F.col("_rows") * F.col("size")).over(
                  Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(
                      Window.unboundedPreceding, -1)), F.lit(0))))
    # A row is taken when its middle lies before the end; the first group of equal rows not taken whole is the cut.
    room = 2 * (F.col("rest") - F.col("_before"))
    some = F.when(F.col("size") == 0, F.when(room >= 0, F.col("_rows")).otherwise(0)).otherwise(
        F.greatest(F.lit(0), F.floor((room + F.col("size")) / (2 * F.col("size"))))).cast("long")
    cut = (inside.join(t, F.col("source").eqNullSafe(F.col("_source")))
           .withColumn("_some", some).where(F.col("_some") < F.col("_rows"))
           .groupBy("source").agg(F.min(F.struct(F.struct("key", "doc_id").alias("cut"), "_some")).alias("_c"))
           .select(F.col("source").alias("_cut_source"), "_c.cut", F.col("_c._some").alias("some")))
    out = (targets.join(cut_bucket, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
           .join(cut, F.col("source").eqNullSafe(F.col("_cut_source")), "left")
           .select("source", "source_size", "target", "epochs", "cut_bucket", "cut", F.coalesce("some", F.lit(0)).alias("some")))
    return small_side(out, "mix-cuts"), buckets


def bucket_of(key: Column, buckets: int) -> Column:
    return F.floor(F.log(key) * buckets)


def copied(rows: DataFrame, cut: DataFrame, buckets: int) -> DataFrame:
    """``rows`` (with doc_id, source, key) joined with their source's ``cut``, and ``copies``: its epochs, plus
    one before the cut. Where a cut falls among equal rows, as many of them as it says."""
    b = bucket_of(F.col("key"), buckets)
    place = F.struct("key", "doc_id")
    before = (b < F.col("cut_bucket")) | ((b == F.col("cut_bucket")) & (F.col("cut").isNull() | (place < F.col("cut"))))
    whole = rows.join(cut, F.col("source").eqNullSafe(F.col("_source")))
    taken = whole.withColumn("copies", F.col("epochs").cast("long") + F.coalesce(before, F.lit(False)).cast("long"))
    if not cut.where("some > 0").take(1):
        return taken
    split = F.coalesce((b == F.col("cut_bucket")) & (place == F.col("cut")) & (F.col("some") > 0), F.lit(False))
    equal = staged(whole.where(split).withColumn("_at", F.monotonically_increasing_id()), "mix-equal")
    # How many lie in each part of the written table, then places within the part that holds the last one.
    part = F.shiftright("_at", 33)
    per = (equal.groupBy("_source", "some", part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
           .withColumn("_before", F.sum("_n").over(Window.partitionBy("_source").orderBy("_part")) - F.col("_n")))
    last = (per.where((F.col("_before") < F.col("some")) & (F.col("_before") + F.col("_n") >= F.col("some")))
            .select(F.col("_source").alias("_s"), F.col("_part").alias("_p"), "_before"))
    last = small_side(last, "mix-parts")
    end = (equal.join(last, F.col("_source").eqNullSafe(F.col("_s")) & (part == F.col("_p")))
           .withColumn("_i", F.row_number().over(Window.partitionBy("_s").orderBy("_at")) + F.col("_before"))
           .where(F.col("_i") == F.col("some")).select("_s", F.col("_at").alias("_end")))
    equal = (equal.join(small_side(end, "mix-ends"), F.col("_source").eqNullSafe(F.col("_s")))
             .withColumn("copies", F.col("epochs").cast("long") + (F.col("_at") <= F.col("_end")).cast("long")))
    return taken.where(~split).unionByName(equal.select(*taken.columns))


def allocate(measured: DataFrame, weights=SOURCE_WEIGHTS, share: float = SHARE,
             max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken, source for every measured row."""
    rows = staged(measured, "mix-rows")
    cut, buckets = cuts(rows, weights, share, max_epochs)
    return (copied(rows, cut.withColumnRenamed("source", "_source"), buckets)
            .select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                    "copies", "source"))


def mix(docs: DataFrame, weight: Column | None = None, weights=SOURCE_WEIGHTS, share: float = SHARE,
        max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Every document as many times as the mix takes it, with the columns of
    ``docs``. The cuts come from a narrow staged table; the texts are scanned
    once more and never shuffled."""
    cut, buckets = cuts(staged(measure(docs, weight, seed), "mix-rows"), weights, share, max_epochs)
    w = quality_weight(F.col("text")) if weight is None else weight
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"),
                        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                        sampling_key(F.col("doc_id"), F.col("text"), w, seed).alias("key"))
    return (copied(whole, cut.withColumnRenamed("source", "_source"), buckets).where("copies > 0")
            .select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_i"))
            .select("_doc.*"))


# DuckDB SQL for the rows of the query.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         CASE WHEN length(text) > 0
              THEN greatest(0.1::DOUBLE, length(regexp_replace(text, '[!-`{-~]+', '', 'g'))::DOUBLE / length(text))
              ELSE 1.0::DOUBLE END AS w,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')), 1, 13))::BIGINT::DOUBLE AS h
  FROM documents),
k AS (SELECT *, -ln((h + 0.5) / 4503599627370496.0::DOUBLE) / w AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk, sum(source_size) OVER () AS total FROM s),
c AS (SELECT *, CASE rk % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS sw, source_size * 2.0::DOUBLE AS cap
      FROM r),
l AS (SELECT *, row_number() OVER o AS pos,
             (total::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(sw) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
      FROM c WINDOW o AS (ORDER BY cap / sw, rk)),
f AS (SELECT min(pos) AS p, min_by(lev, pos) AS lev FROM l WHERE cap / sw > l.lev),
t AS (SELECT source, source_size, CASE WHEN f.p IS NULL OR l.pos < f.p THEN cap ELSE sw * f.lev END AS target FROM l, f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::INT AS epochs FROM t),
q AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM k),
z AS (SELECT q.*, e.source_size, e.target,
             (epochs + CASE WHEN target > epochs * e.source_size AND cum * 2 - size <= (target - epochs * e.source_size) * 2 THEN 1 ELSE 0 END)
               ::BIGINT AS copies
      FROM q JOIN e ON q.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, source, copies, (size * copies)::BIGINT AS taken FROM z
"""
