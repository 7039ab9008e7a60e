import math

from pyspark.sql import functions as F

from sitesift.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, asked):
    """(query, rank, vec_id, score) by scoring every pair."""
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in {(i, tuple(v)) for i, v in good if asked(i)}:
        best = sorted((-sum(a * b for a, b in zip(v, c, strict=False)), i) for i, c in good if i != q)[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


def run(df, k=5, asked="vec_id % 3 = 0"):
    v = topk.quantize(df)
    return [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.exact_topk(v.where(asked), v, k).collect()]


def test_brute_force_with_ties_and_a_hot_vector(spark):
    rows = [(i, [((i * 7919 + j * 104729) % 201 - 100) / 64.0 for j in range(8)]) for i in range(200)]
    rows += [(1000 + i, [0.5] * 8) for i in range(150)]                      # one vector on many rows
    rows += [(5000, None), (5001, [1.0, None]), (5002, [float("nan")] * 8), (5003, [float("inf")] + [0.0] * 7),
             (None, [1.0] * 8), (3, [0.25] * 8), (5004, []), (5005, [2.0])]
    df = spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA).withColumn("score", F.lit("x"))
    got = run(df)
    assert set(got) == brute(rows, 5, lambda i: i % 3 == 0)


def test_few_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0], 1), (1, [-2.0], 1)], SCHEMA)
    assert run(df) == [(0, 1, 1, -512 * 256)]
    assert run(df.limit(0)) == []
    assert run(df.where("vec_id = 0")) == []


def test_blocks_give_the_same(spark, monkeypatch):
    df = spark.range(300).select(F.col("id").alias("vec_id"), F.array(
        *[(F.pmod(F.hash("id", F.lit(j)), F.lit(1000)) / 500.0 - 1).cast("float") for j in range(6)]).alias("embedding"))
    whole = sorted(run(df))
    monkeypatch.setattr(topk, "BLOCK", 40)
    assert sorted(run(df)) == whole and len(whole) == 500


def test_scores_beyond_float_precision(spark):
    big = 2.0 ** 20
    df = spark.createDataFrame([(0, [big, 1.0], 1), (1, [big, 0.0], 1), (2, [big, 1 / 256], 1)], SCHEMA)
    x = int(big) * 256
    assert run(df, 2) == [(0, 1, 2, x * x + 256), (0, 2, 1, x * x)]
