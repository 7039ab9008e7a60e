from pyspark.sql import functions as F

from sitesift.operators.filters import CrawlConfig, http_chain
from sitesift.plans import registry
from sitesift.session import scratch_path
from sitesift.streaming import crawl_stream as S

from .conftest import SF001


def test_stream_dedup_equals_batch(spark):
    pages = spark.read.parquet(f"{SF001}/pages.parquet").select("page_id", "url")
    src = scratch_path(spark, "test-stream-src")
    # three arrivals with repeats: all, then the first half again, then all again
    for i, part in enumerate([pages, pages.where("page_id % 2 = 0"), pages]):
        part.write.mode("overwrite").parquet(f"{src}/chunk={i}")
    cfg = CrawlConfig(include_hosts=None)
    out, ckpt = S.stream_paths(scratch_path(spark, "test-stream"))
    stream = (spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    S.run_available(S.admitted_urls(stream, cfg), out, ckpt)
    got = sorted(r.url for r in spark.read.parquet(out).collect())
    batch = http_chain(pages.select(F.col("url").alias("href"), F.lit(0).alias("depth"),
                                    F.lit(None).cast("string").alias("referrer")), cfg)
    want = sorted(r.url for r in batch.select("url").distinct().collect())
    assert got == want and len(got) == len(set(got))


def test_stream_dedup_within_watermark(spark):
    pages = (spark.read.parquet(f"{SF001}/pages.parquet").select("page_id", "url")
             .withColumn("ts", F.to_timestamp(F.lit("2026-01-01 00:00:00"))))
    src = scratch_path(spark, "test-stream-wm-src")
    pages.write.parquet(f"{src}/chunk=0")
    pages.write.parquet(f"{src}/chunk=1")
    cfg = CrawlConfig(include_hosts=None)
    out, ckpt = S.stream_paths(scratch_path(spark, "test-stream-wm"))
    stream = (spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    S.run_available(S.admitted_urls(stream, cfg, event_time="ts", delay="1 hour"), out, ckpt)
    got = [r.url for r in spark.read.parquet(out).collect()]
    assert len(got) == len(set(got)) > 0


def test_stream_etags_equal_a_sequential_replay(spark):
    """Four arrivals, one file a micro-batch; tags repeat inside and across them, some are missing."""
    tags = [None, "", "a", "b", "c", "d", "e"]
    src = scratch_path(spark, "test-stream-tags")
    batches, n = [], 0
    for b in range(4):
        rows = [(f"u{(n + i) * 7 % 200:03d}", tags[(n * 3 + i * 5 + b) % (4 + b)], (i * 11) % 10) for i in range(30)]
        n += len(rows)
        batches.append(rows)
        spark.createDataFrame(rows, "url string, etag string, at int").coalesce(1).write.parquet(f"{src}/chunk={b}")
    held, want = set(), []
    for rows in batches:                                    # the replay, page by page
        for url, etag, at in sorted(rows, key=lambda r: (r[2], r[0])):
            if not etag or etag not in held:
                want.append((url, etag, at))
                held.add(etag)
    before = spark.conf.get(S.STATE_PROVIDER, None)
    out, ckpt = S.stream_paths(scratch_path(spark, "test-stream-tags-out"))
    stream = (spark.readStream.schema("url string, etag string, at int").option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    with S.rocksdb_state(spark):
        assert spark.conf.get(S.STATE_PROVIDER) == S.ROCKSDB_PROVIDER
        S.run_available(S.admitted_tags(stream, "at"), out, ckpt)
    assert spark.conf.get(S.STATE_PROVIDER, None) == before
    got = [(r.url, r.etag, r.arrival) for r in spark.read.parquet(out).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(held) == 7


def test_registered_streams_read_tables_of_several_files(spark):
    """Large tables are folders of part files; each stream reads them all."""
    sf = scratch_path(spark, "test-stream-folders")
    (spark.createDataFrame([(1, "http://h/a", "<p>x</p>"), (2, "http://h/a", "y"), (3, "http://h/b", "z")],
                           "page_id long, url string, html string").repartition(3, "page_id").write.parquet(f"{sf}/pages.parquet"))
    (spark.createDataFrame([(1, "ebb\ntide"), (2, "ebb\ntide"), (3, "neap")], "doc_id long, text string")
     .repartition(3, "doc_id").write.parquet(f"{sf}/documents.parquet"))
    q = registry.queries()
    assert sorted(r.url for r in q["stream_visited_dedup"](spark, sf).collect()) == ["http://h/a", "http://h/b"]
    assert sorted(r.doc_id for r in q["stream_etag_dedup"](spark, sf).collect()) == [1, 3]
    data = q["stream_index_append"](spark, sf).where("field = 'data'")
    assert sorted((r.term, r.doc_id) for r in data.select("term", "doc_id").collect()) == [
        ("ebb", 1), ("ebb", 2), ("neap", 3), ("tide", 1), ("tide", 2)]
