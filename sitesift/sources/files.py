"""File-tree source (A4, A5): list documents below a directory, MIME type by
extension, and extract the HTML ones.

The listing is Spark's ``binaryFile`` source with a glob filter, so files
with other extensions are pruned while listing and their bodies are never
read. Hidden names (``_x``, ``.x``) are skipped by Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import extract_pages
from ..operators.filters import CrawlConfig, file_chain

# Known file extensions and their MIME types.
FILE_EXTENSION_MIME_TYPES = {
    "doc": "application/msword",
    "html": "text/html",
    "htm": "text/html",
    "pdf": "application/pdf",
    "txt": "text/plain",
}
DEFAULT_MIME = "application/octet-stream"


def _any_case(ext: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" for c in ext)


LISTING_GLOB = "*.{" + ",".join(_any_case(e) for e in FILE_EXTENSION_MIME_TYPES) + "}"


def mime_from_extension(path) -> Column:
    """A5: lower-cased extension -> MIME type, default octet-stream."""
    p = F.col(path) if isinstance(path, str) else path
    m = F.create_map(*[F.lit(x) for kv in FILE_EXTENSION_MIME_TYPES.items() for x in kv])
    ext = F.lower(F.regexp_extract(p, r"\.([^./]+)$", 1))
    return F.coalesce(F.try_element_at(m, ext), F.lit(DEFAULT_MIME))


def file_url(path) -> Column:
    """Spark's ``file:/x`` paths as ``file:///x`` URLs."""
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(p, r"^file:/+", "file:///")


def file_scan(spark: SparkSession, root: str | list[str], cfg: CrawlConfig | None = None) -> DataFrame:
    """A4: ``(url, path, length, modificationTime, content_type, content)``
    for every listed file below ``root`` (recursively; a folder, a file or
    several), after the file chain (scheme, path include/exclude)."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
          .option("pathGlobFilter", LISTING_GLOB).load(root))
    df = df.select(file_url("path").alias("url"), "path", "length", "modificationTime",
                   mime_from_extension("path").alias("content_type"), "content")
    return file_chain(df, cfg or CrawlConfig(include_hosts=None), "url")


def extract_files(files: DataFrame) -> DataFrame:
    """E1 + E11 for files: HTML bodies are extracted (links are not followed
    inside files), other types give NULL content and are not indexed."""
    from ..functions.html import content_route
    d = files.withColumn("extractor", content_route("content_type"))
    html = extract_pages(d.where(F.col("extractor") == "html")
                         .select("url", "extractor", F.decode("content", "UTF-8").alias("html")),
                         keep=("url", "extractor"))
    other = d.where(F.col("extractor") != "html").select(
        "url", "extractor", F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("content"))
    return html.drop("links").unionByName(other).withColumn("links", F.lit(None).cast("array<string>"))
