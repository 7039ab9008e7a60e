import math

import duckdb
from pyspark.sql import functions as F

from sitesift.llm import mixing
from tests.conftest import SF001


def filled(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Water filling by repeated resharing, as the contract words it."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and free:
        part = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        left = 0.0
        for s in list(free):
            target[s] += part[s]
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                free.discard(s)
    return target


def test_targets_epochs_and_nearness(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = mixing.allocate(mixing.measure(docs)).collect()
    assert len(rows) == docs.count()
    sizes, taken, biggest = {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        biggest[r.source] = max(biggest.get(r.source, 0), r["size"])
        assert r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
    want = filled(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= biggest[s] / 2 + 1e-6


def test_edges(spark, edge_docs, no_docs):
    rows = mixing.allocate(mixing.measure(edge_docs)).collect()
    assert len(rows) == edge_docs.count()
    again = mixing.allocate(mixing.measure(edge_docs)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert {r["size"] for r in rows if r.doc_id in (2, 3, 5)} == {0}
    assert mixing.allocate(mixing.measure(no_docs)).count() == 0


def test_mix_repeats_rows_as_allocated(spark, edge_docs, no_docs):
    docs = edge_docs.where("doc_id > 1").withColumn("copies", F.lit("mine")).withColumn("key", F.lit(1)).withColumn(
        "target", F.lit(None).cast("string"))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    want = {r.doc_id: r.copies for r in mixing.allocate(mixing.measure(docs)).collect() if r.copies}
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == want
    assert mixing.mix(no_docs).count() == 0


def test_hot_source_equals_sql(spark, tmp_path):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.expr("repeat('word ', cast(id % 17 as int))").alias("text"),
        F.expr("if(id % 3 = 0, 'hot', concat('s', id % 11))").alias("source"))
    path = str(tmp_path / "d.parquet")
    docs.write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    rel = con.sql(mixing.SQL)
    want = sorted(map(repr, (dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall())))
    cols = rel.columns
    got = sorted(repr({c: r[c] for c in cols}) for r in mixing.allocate(mixing.measure(spark.read.parquet(path))).collect())
    assert got == want


def nearness(rows):
    """{source: (target, taken, largest size)}"""
    out = {}
    for r in rows:
        target, taken, most = out.get(r.source, (r.target, 0, 0))
        out[r.source] = (target, taken + r.taken, max(most, r["size"]))
    return out


def test_equal_rows_are_taken_one_by_one(spark):
    """All rows equal, ids null: the taken words come within a document of the target, in both operators."""
    equal = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("four words of text").alias("text"),
                                     F.lit("s").alias("source")).repartition(7)
    more = spark.range(500).select((F.col("id") % 3).alias("doc_id"), F.lit("one two three").alias("text"),
                                   (F.col("id") % 2).cast("string").alias("source"))
    for docs in (equal, equal.unionByName(more), more):
        rows = mixing.allocate(mixing.measure(docs)).collect()
        for target, taken, most in nearness(rows).values():
            assert abs(taken - target) <= most / 2 + 1e-6
        assert mixing.mix(docs).count() == sum(r.copies for r in rows) and len(rows) == docs.count()


def test_one_id_with_many_texts(spark):
    docs = spark.range(1000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"),
                                    F.lit("s").alias("source"))
    (target, taken, _), = nearness(mixing.allocate(mixing.measure(docs)).collect()).values()
    assert abs(target - taken) <= 1


def test_no_bucket_holds_more_than_a_hundredth(spark):
    shouting = spark.range(200_000).select(F.col("id").alias("doc_id"), F.lit("ABC").alias("text"), F.lit("s").alias("source"))
    rows = mixing.measure(shouting)
    assert rows.select(mixing.quality_weight(F.lit("ABC"))).first()[0] == 0.1
    per = rows.groupBy(mixing.bucket_of(F.col("key"), mixing.LEAST_PER_UNIT).alias("b")).count()
    assert per.agg(F.max("count")).first()[0] < 2000
