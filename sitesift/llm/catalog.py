"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, lexical, maintext, mixing, neighbours, pii, quality, repair, sharding, simhash, suffixes,
               topk, toxicity)
from .common import staged, table


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeats(table(spark, sf_dir, "documents"))

    def text(spans: str) -> F.Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["start"].cast("string"),
                                                                     x["end"].cast("string"))), ",")

    def words(spans: str) -> F.Column:
        return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])

    return found.select("doc_id", "n_words", words("spans").alias("repeated_words"), words("cut").alias("cut_words"),
                        text("spans").alias("spans"), text("cut").alias("cut"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.allocate(mixing.measure(table(spark, sf_dir, "documents")))


def op3_maintext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(table(spark, sf_dir, "pages")).select(
        F.col("page_id").cast("long").alias("page_id"), "url", "text", "n_chars")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantize(table(spark, sf_dir, "embeddings"))
    return topk.exact_topk(vectors.where("vec_id % 50 = 0"), vectors, k=5)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(sharding.sized(table(spark, sf_dir, "documents")), "shard-rows")
    out = sharding.assign(rows, sharding.row_key(), sharding.SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors.where("vec_id % 20 = 0"), vectors, k=20)


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_suffixes": op1_suffixes,
    "op2_mixing": op2_mixing,
    "op3_maintext": op3_maintext,
    "op4_topk": op4_topk,
    "op5_pii": op5_pii,
    "op6_sharding": op6_sharding,
    "op7_quality": op7_quality,
    "op8_decontaminate": op8_decontaminate,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
    "op11_neighbours": op11_neighbours,
    "op12_lexical": op12_lexical,
    "op13_repair": op13_repair,
}

ORACLE = {
    "op2_mixing": mixing.SQL,
    "op4_topk": topk.SQL,
    "op12_lexical": lexical.SQL,
    "op13_repair": repair.SQL,
}
