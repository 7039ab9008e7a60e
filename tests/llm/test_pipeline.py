from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from sitesift.llm import mixing, quality
from tests.conftest import SF001
from tests.llm.test_decontaminate import brute
from tests.llm.test_simhash import plain, roots


def test_run_equals_the_stages_by_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    items = spark.read.parquet(f"{SF001}/benchmark.parquet")
    copies = docs.where("doc_id % 5 = 0").withColumn("doc_id", F.col("doc_id") + 10_000)
    leaks = docs.where("doc_id % 7 = 0").crossJoin(items.limit(1).select(F.col("text").alias("_t"))).withColumn(
        "text", F.concat_ws(" ", "text", "_t")).drop("_t").withColumn("doc_id", F.col("doc_id") + 20_000)
    docs.unionByName(copies).unionByName(leaks).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF001}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))

    good = {r.doc_id for r in quality.classify(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()
            if r.predicted}
    rows = {r.doc_id: r for r in docs.collect()}
    prints = {d: plain(rows[d].text) for d in good}
    root = roots(prints.values())
    first = {}
    for d in sorted(good):
        first.setdefault(root[prints[d]], d)
    tests = [(r.item_id, r.text) for r in items.collect()]
    clean = {d for d in first.values() if not brute(rows[d].text, tests)}
    assert len(clean) < len(first) < len(good) < len(rows)
    taken = {r.doc_id: r.copies for r in mixing.allocate(mixing.measure(docs.where(F.col("doc_id").isin(*clean)))).collect()}

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in out) == Counter({d: n for d, n in taken.items() if n})
    assert all(r.text == rows[r.doc_id].text and r.source == rows[r.doc_id].source for r in out)
    shards = Counter(r.shard for r in out)
    assert len(shards) == 24 and max(shards.values()) - min(shards.values()) <= 1
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(n)) for s, n in shards.items())


def test_stages_keep_columns_and_edges(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[1:-1]:
            out = stage(spark, docs, SF001)
            assert out.columns == docs.columns and out.count() <= 2 * docs.count()
        assert corpus_pipeline.STAGES[0][1](spark, docs, SF001).columns == docs.columns
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SF001)
        assert last.columns == [*docs.columns, "shard", "slot"] and last.count() == docs.count()


def test_stage_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "simhash near-dedup", "benchmark decontamination", "mixing sources to target weights",
        "sharding"]
