"""Helpers shared by the operators: reading tables, cutting lineage with
written tables, and broadcasts behind a size check."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

# White space between words: space and the ASCII controls 9 to 13 (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"

# A side is broadcast only up to this many rows and this many bytes of strings.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs start
    from the files, so a lost executor recomputes one task, not the lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words as long; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small_side(df: DataFrame, name: str) -> DataFrame:
    """``df`` staged, with a broadcast hint when its measured size is under the
    bound; above it Spark shuffles, and AQE splits skewed keys."""
    out = staged(df, name)
    strings = [F.sum(F.octet_length(c)) for c, t in out.dtypes if t == "string"]
    n, size = out.agg(F.count(F.lit(1)), sum((F.coalesce(s, F.lit(0)) for s in strings), F.lit(0))).first()
    return F.broadcast(out) if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else out
