"""Structured Streaming re-aims of the crawler's live queue (H1, H2).

H1: captured pages arrive continuously; every normalised URL is admitted
once (``dropDuplicates`` keeps the seen URLs in the state store; RocksDB
keeps that state off-heap and on disk, as it is unbounded like the
reference's visited set).

D2 on the stream: of the pages that carry one ETag, the first to arrive is kept.
The arrival order is the micro-batch, then the ``arrival`` column, then the URL;
the state of a tag is the URL that holds it.

H2: each micro-batch of documents is added to the open index as its own
batch directory (``batch=<batch_id>``), so a replayed micro-batch rewrites
the same files (idempotent) and statistics are re-summed on read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.filters import CrawlConfig, http_chain
from ..operators.index import Index
from ..sources.index_store import write_index

STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table_stream(spark: SparkSession, directory: str, table: str, schema,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """The files of the Parquet table ``<directory>/<table>.parquet`` as a stream. A table
    is one file, found in ``directory`` by its name, or a folder of part files."""
    path = os.path.join(directory, f"{table}.parquet")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return file_stream(spark, path, schema, max_files_per_trigger=max_files_per_trigger)
    return file_stream(spark, directory, schema, f"{table}.parquet", max_files_per_trigger)


def file_stream(spark: SparkSession, directory: str, schema, glob: str | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.format("parquet").schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(directory)


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; a query takes the setting
    with it when it starts, so the session has its own back afterwards."""
    before = spark.conf.get(STATE_PROVIDER, None)
    spark.conf.set(STATE_PROVIDER, ROCKSDB_PROVIDER)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_PROVIDER)
        else:
            spark.conf.set(STATE_PROVIDER, before)


def admitted_urls(stream: DataFrame, cfg: CrawlConfig, url_col: str = "url",
                  event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """H1 plan: seeds chain on each arriving URL, then one row per URL.

    Without ``event_time`` every URL ever seen stays in the state store (the
    reference's semantics). With it, state is bounded: a URL is admitted
    again once it is older than the watermark (``delay``), a documented
    divergence for unbounded streams.
    """
    extra = [F.col(event_time)] if event_time else []
    s = stream.select(F.col(url_col).alias("href"), F.lit(0).alias("depth"),
                      F.lit(None).cast("string").alias("referrer"), *extra)
    s = http_chain(s, cfg, href="href", referrer="referrer", depth="depth")
    if event_time:
        return (s.select("url", "depth", event_time).withWatermark(event_time, delay)
                .dropDuplicatesWithinWatermark(["url"]))
    return s.select("url", "depth").dropDuplicates(["url"])


def admitted_tags(stream: DataFrame, arrival: str) -> DataFrame:
    """D2 plan: ``url``, ``etag`` and ``arrival`` of the pages kept, one per non-empty
    ETag and every page without one.

    Only these three columns travel. A tag that is already held is dropped at once; of a
    new one the rows of the micro-batch are read chunk by chunk and only the first is
    held, so a tag that a third of the pages share takes one chunk of memory.
    """
    s = stream.select("url", "etag", F.col(arrival).alias("arrival"))
    untagged = F.coalesce(F.col("etag"), F.lit("")) == ""
    kinds = dict(s.dtypes)
    rows = ", ".join(f"{c} {kinds[c]}" for c in s.columns)

    def first(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            return
        best = None
        for chunk in chunks:
            both = chunk if best is None else pd.concat([best, chunk])
            best = both.sort_values(["arrival", "url"], kind="stable").head(1)
        state.update((best["url"].iloc[0],))
        yield best

    tagged = s.where(~untagged).groupBy("etag").applyInPandasWithState(
        first, rows, "first_url string", "append", GroupStateTimeout.NoTimeout)
    return s.where(untagged).unionByName(tagged)


def run_available(df: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Process everything available now into a Parquet sink and stop."""
    q = (df.writeStream.format("parquet").outputMode("append")
         .option("path", sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def index_appender(index_path: str, to_docs: Callable[[DataFrame], DataFrame]):
    """H2: a ``foreachBatch`` function adding each micro-batch to the index."""
    def each(batch_df: DataFrame, batch_id: int) -> None:
        docs = to_docs(batch_df).persist()
        try:
            if not docs.isEmpty():
                write_index(Index.build(docs), index_path, create=False, batch=int(batch_id))
        finally:
            docs.unpersist()
    return each


def run_index_stream(stream: DataFrame, index_path: str, checkpoint: str,
                     to_docs: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    q = (stream.writeStream.foreachBatch(index_appender(index_path, to_docs))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def stream_paths(root: str) -> tuple[str, str]:
    return os.path.join(root, "out"), os.path.join(root, "checkpoint")
