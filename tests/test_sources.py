import os
import tempfile

from pyspark.sql import functions as F

from sitesift.sources.files import extract_files, file_scan, mime_from_extension
from sitesift.sources.index_store import rewrite_prefix

from .html_fixtures import SIMPLE

from .conftest import SF001


def test_file_listing_and_mime(spark):
    root = tempfile.mkdtemp(prefix="sitesift-files-")
    os.makedirs(os.path.join(root, "sub"))
    for name in ["x.DOC", "x.html", "x.htm", "x.pdf", "x.txt", "x.png", "html", "_f.html", "sub/y.html"]:
        with open(os.path.join(root, name), "w") as f:
            f.write(SIMPLE if name.endswith("html") else "text")
    files = file_scan(spark, root)
    got = {os.path.basename(r.url): r.content_type for r in files.collect()}
    assert got == {"x.DOC": "application/msword", "x.html": "text/html", "x.htm": "text/html",
                   "x.pdf": "application/pdf", "x.txt": "text/plain", "y.html": "text/html"}
    assert all(r.url.startswith("file:///") for r in files.collect())
    ex = {os.path.basename(r.url): r for r in extract_files(files).collect()}
    assert ex["x.html"].title == "Harbour tides" and ex["x.html"].links is None
    assert ex["x.txt"].content is None          # listed but not indexed


def test_mime_default(spark):
    df = spark.createDataFrame([("a/b.Html",), ("a/b",), ("a.b/c",), ("a/b.odt",)], "p string")
    assert [r.m for r in df.select(mime_from_extension("p").alias("m")).collect()] == [
        "text/html", "application/octet-stream", "application/octet-stream", "application/octet-stream"]


def test_rewrite_prefix(spark):
    df = spark.createDataFrame([("file:///base/x.html",), ("http://h/y",)], "u string")
    got = [r.u for r in df.select(rewrite_prefix("u", "file:///base/", "http://www.h/virtual/").alias("u")).collect()]
    assert got == ["http://www.h/virtual/x.html", "http://h/y"]


def test_file_tree_index(spark):
    from sitesift.operators import search as se
    from sitesift.plans.site_index import build_file_index
    from sitesift.sources.index_store import rewrite_prefix
    from .html_fixtures import CUSTOM, ENTITIES
    root = tempfile.mkdtemp(prefix="sitesift-tree-")
    for name, body in [("a.html", SIMPLE), ("b.htm", ENTITIES), ("c.html", CUSTOM), ("notes.txt", "tide water")]:
        with open(os.path.join(root, name), "w") as f:
            f.write(body)
    idx = build_file_index(spark, root, rewrite_uri=lambda u: rewrite_prefix(u, "file://" + root + "/",
                                                                              "http://www.h/docs/"))
    docs = {r.url: r for r in idx.docs.collect()}
    assert sorted(docs) == ["http://www.h/docs/a.html", "http://www.h/docs/b.htm", "http://www.h/docs/c.html"]
    q = spark.createDataFrame([(1, ["tide", "water"], "and", None, 0, 10)],
                              "query_id int, terms array<string>, mode string, fields array<string>, "
                              "offset int, limit int")
    q = q.withColumn("terms", F.array(F.lit("tide"), F.lit("second")))
    assert [r.url for r in se.search(idx, q).collect()] == ["http://www.h/docs/a.html"]


def test_partitions_follow_the_size_of_what_is_read(spark):
    from sitesift.session import partitions_for
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    assert partitions_for(docs) == cores
    both = docs.join(docs.select("doc_id"), "doc_id").where("doc_id > 0")
    assert 20 * cores < partitions_for(both, target_bytes=4096) < 1000 * cores       # sums, no products
    unknown = docs.join(spark.createDataFrame([(1,)], "doc_id long"), "doc_id")
    assert partitions_for(unknown) == int(spark.conf.get("spark.sql.shuffle.partitions"))
