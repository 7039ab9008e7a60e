import zlib

from pyspark.sql import functions as F

from sitesift.llm import sharding


def walk(hashes, nodes, caps):
    """Bounded loads one key at a time: home keys in ring order, then what overflows walks clockwise."""
    ring = sorted(nodes.items())
    arcs = {}
    for h in sorted(hashes):
        arcs.setdefault(next((i for i, (node, _) in enumerate(ring) if node >= h >> 48), 0), []).append(h)
    room, out, over = list(caps), {}, []
    for i in sorted(arcs):
        for h in arcs[i]:
            if room[ring[i][1]]:
                room[ring[i][1]] -= 1
                out[h] = ring[i][1]
            else:
                over.append((i, h))
    for i, h in over:
        for step in range(1, len(ring) + 1):
            s = ring[(i + step) % len(ring)][1]
            if room[s]:
                room[s] -= 1
                out[h] = s
                break
    return out


def test_matches_a_walk_key_by_key(spark):
    rows = spark.range(700).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("h"))
    got = sharding.assign(rows, F.col("h"), 5, vnodes=6).collect()
    nodes = {r.arc: r.shard for r in sharding.ring(spark, 5, 6).collect()}
    want = walk([r.h % 2 ** 64 for r in got], nodes, sharding.capacities(700, 5))
    assert {r.h % 2 ** 64: r.shard for r in got} == want
    for k in range(5):
        slots = sorted(r.slot for r in got if r.shard == k)
        assert slots == list(range(140))


def test_overflow_goes_clockwise(spark):
    """With room for all elsewhere, each moved key goes to the next shard that still has room."""
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("h"))
    got = sharding.assign(rows, F.col("h"), 2, vnodes=3).collect()
    home = {r._pos: r.shard for r in sharding.ring(spark, 2, 3).collect()}
    load = [0, 0]
    moved = 0
    for r in got:
        load[r.shard] += 1
        moved += home[(r.h % 2 ** 64) >> 48] != r.shard
    assert load == [200, 200]
    own = sum(home[(r.h % 2 ** 64) >> 48] == 0 for r in got)
    assert moved == abs(own - 200)


def test_load_factor_bounds(spark):
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("h"))
    loose = sharding.assign(rows, F.col("h"), 4, vnodes=8, load_factor=1.1).groupBy("shard").count().collect()
    assert max(r["count"] for r in loose) <= 275 and sum(r["count"] for r in loose) == 1000


def test_edges(spark, edge_docs, no_docs):
    rows = sharding.sized(edge_docs)
    out = sharding.assign(rows, sharding.row_key(), 3).collect()
    assert len(out) == edge_docs.count()
    want = sorted((len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in edge_docs.collect())
    assert sorted((r["size"], r.text_crc32) for r in out) == want
    assert sharding.assign(sharding.sized(no_docs), sharding.row_key(), 3).count() == 0
    clash = edge_docs.withColumn("shard", F.lit("x")).withColumn("_rank", F.lit(1)).withColumn("arc", F.lit(2))
    again = sharding.assign(clash, F.xxhash64("doc_id", "text"), 3)
    assert again.columns == [*edge_docs.columns, "_rank", "arc", "shard", "slot"] and again.count() == edge_docs.count()
