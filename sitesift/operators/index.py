"""Inverted index build (F1-F6) as DataFrame -> DataFrame operators.

Input: ``docs(doc_id, url, title, data)``. Output tables:

* ``postings(term, field, doc_id, tf, dl, positions)`` - one row per term,
  field and document. ``dl`` (the field's length in tokens) is carried on
  each row so that scoring needs no join back to a length table.
* ``term_stats(term, field, df, cf)`` - document and collection frequency.
* ``field_stats(field, n_docs, total_len, avg_dl)`` - one row per field.

A hot term never becomes one row: postings stay one row per
(term, field, doc), and every count is a partial (map-side) aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import Analyzer
from ..session import partitions_for

# The stored and tokenised fields of every index document, in order.
INDEX_FIELDS = ("url", "title", "data")
# Compressed input bytes of documents whose postings are made in one task: as rows of one
# token each they take many times that, and are sorted in memory where positions are kept.
INDEX_INPUT_BYTES = 4 * 1024 * 1024


def index_partitions(docs: DataFrame) -> int:
    """Tasks over which the documents of an index are spread."""
    return partitions_for(docs, INDEX_INPUT_BYTES)


def stored_documents(df: DataFrame) -> DataFrame:
    """the stored fields kept for retrieval."""
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                     "url", "title", "data")


def field_tokens(docs: DataFrame, fields=INDEX_FIELDS, keys: tuple[str, ...] = (),
                 analyzer: Analyzer = Analyzer()) -> DataFrame:
    """(doc_id, keys..., field, tokens, dl) for every non-NULL field of every
    document. Narrow: a ``stack`` of the fields, no shuffle. ``tokens`` holds
    stop words too, in their places; ``dl`` counts the terms."""
    stack = ", ".join(f"'{f}', `{f}`" for f in fields)
    return (docs.select("doc_id", *keys, F.expr(f"stack({len(fields)}, {stack}) as (field, value)"))
            .where(F.col("value").isNotNull())
            .select("doc_id", *keys, "field", analyzer.tokens("value").alias("tokens"))
            .withColumn("dl", F.size(analyzer.only_kept(F.col("tokens"))).cast("bigint")))


def postings(docs: DataFrame, fields=INDEX_FIELDS, keys: tuple[str, ...] = (),
             analyzer: Analyzer = Analyzer()) -> DataFrame:
    """F2 + F3: tokenize every field and group positions per (term, field, doc).

    ``keys``: extra columns that depend on ``doc_id`` only (a storage
    partition) and are kept as grouping keys, so that input partitioned by
    them needs no further exchange.
    """
    toks = field_tokens(docs, fields, keys, analyzer)
    # Outer: for an inner one Spark tests the array first, by tokenizing the text once more for each test.
    exploded = (toks.select("doc_id", *keys, "field", "dl", F.posexplode_outer("tokens").alias("pos", "term"))
                .where(F.col("term").isNotNull()))
    if analyzer.stop_words:
        exploded = exploded.where(analyzer.kept(F.col("term")))
    # By document first: its rows come together, so that a sort compares hardly more than ``doc_id``.
    return (exploded.groupBy("doc_id", *keys, "field", "term")
            .agg(F.count(F.lit(1)).alias("tf"),
                 F.max("dl").alias("dl"),
                 F.sort_array(F.collect_list("pos")).alias("positions"))
            .select("term", "field", "doc_id", *keys, "tf", "dl", "positions"))


def term_statistics(post: DataFrame) -> DataFrame:
    """document frequency and collection frequency per (term, field)."""
    return post.groupBy("term", "field").agg(F.count(F.lit(1)).alias("df"),
                                             F.sum("tf").alias("cf"))


def field_statistics(docs: DataFrame, post: DataFrame | None = None, fields=INDEX_FIELDS,
                     analyzer: Analyzer = Analyzer()) -> DataFrame:
    """number of documents and mean length (in tokens) per field.

    A document whose field is NULL does not count for that field. With
    materialised postings the total length is their sum of ``tf`` (each
    token is in exactly one posting), so the text is not tokenized again and
    the document count needs only NULL tests. Without, the lengths come from
    one narrow tokenizing pass (no shuffle of postings).
    """
    if post is None:
        toks = field_tokens(docs, fields, analyzer=analyzer)
        return toks.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"),
                                         F.sum("dl").alias("total_len"),
                                         F.avg("dl").alias("avg_dl"))
    stack = ", ".join(f"'{f}', `{f}` IS NOT NULL" for f in fields)
    present = (docs.select(F.expr(f"stack({len(fields)}, {stack}) as (field, present)"))
               .where("present").groupBy("field").agg(F.count(F.lit(1)).alias("n_docs")))
    lengths = post.groupBy("field").agg(F.sum("tf").alias("total_len"))
    return (present.join(lengths, "field", "left")
            .select("field", "n_docs", F.coalesce("total_len", F.lit(0)).cast("bigint").alias("total_len"))
            .withColumn("avg_dl", F.col("total_len") / F.col("n_docs")))


def indexable(df: DataFrame) -> DataFrame:
    """Index only when title or body is present (empty strings count)."""
    return df.where(F.col("title").isNotNull() | F.col("data").isNotNull())


def indexed_count(docs: DataFrame) -> DataFrame:
    """number of documents added to the index."""
    return docs.agg(F.count(F.lit(1)).alias("indexed_documents"))


class Index:
    """The tables of one index, as lazily evaluated DataFrames."""

    def __init__(self, docs: DataFrame, postings: DataFrame, term_stats: DataFrame,
                 field_stats: DataFrame, fields: tuple[str, ...] | None = None, analyzer: Analyzer = Analyzer(),
                 by_doc: DataFrame | None = None):
        self.docs = docs
        self.postings = postings
        self.term_stats = term_stats
        self.field_stats = field_stats
        # set when the tables are derived from ``docs`` (lets a writer
        # re-plan the derivation around its own partitioning)
        self.fields = fields
        self.analyzer = analyzer
        # the documents of a derived index, spread by doc_id
        self.by_doc = by_doc

    def postings_of(self, terms: DataFrame) -> DataFrame:
        """The postings of a table of terms; the semi join is pushed below the
        postings aggregate when the index is built in the same plan."""
        return self.postings.join(terms, "term", "left_semi")

    def by_document(self, rows: DataFrame) -> DataFrame:
        """Rows of postings in tasks by ``doc_id``; they are already where :meth:`build` made them."""
        return rows if self.fields is not None else rows.repartition(index_partitions(self.docs), "doc_id")

    def stats_of(self, terms: DataFrame) -> DataFrame:
        return self.term_stats.join(terms, "term", "left_semi")

    def weights_of(self, terms: DataFrame, few: bool) -> DataFrame:
        """(term, field, df, n_docs, avg_dl) of a table of terms. ``few``: they may be broadcast.

        An index derived in the same plan tokenizes its texts once for both statistics:
        every field of a document also holds the empty term, which no text has, so
        that the rows of that term count the field's documents and their lengths."""
        if self.by_doc is None:
            return (self.stats_of(terms).select("term", "field", "df")
                    .join(F.broadcast(self.field_stats.select("field", "n_docs", "avg_dl")), "field"))
        own = F.col("term") == ""
        asked = terms.unionByName(terms.sparkSession.range(1).select(F.lit("").alias("term")))
        toks = field_tokens(self.by_doc, self.fields, analyzer=self.analyzer)
        per_doc = (toks.select("doc_id", "field", "dl", F.explode_outer(
                       F.concat(F.array(F.lit("")), self.analyzer.only_kept(F.col("tokens")))).alias("term"))
                   .join(F.broadcast(asked) if few else asked, "term", "left_semi")
                   .groupBy("term", "field", "doc_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("dl").alias("len")))
        per_term = per_doc.groupBy("term", "field").agg(
            F.count(F.lit(1)).alias("df"), F.sum("rows").alias("rows"), F.sum("len").alias("len"))
        field = Window.partitionBy("field")
        return (per_term.withColumns({"n_docs": F.max(F.when(own, F.col("rows"))).over(field),
                                      "total_len": F.max(F.when(own, F.col("len"))).over(field)})
                .where(~own).select("term", "field", "df", "n_docs", (F.col("total_len") / F.col("n_docs")).alias("avg_dl")))

    @classmethod
    def build(cls, docs: DataFrame, fields=INDEX_FIELDS, analyzer: Analyzer = Analyzer()) -> "Index":
        """The documents are spread by ``doc_id`` once, as text; grouping by term, field and
        document, and all that a search groups by document, then needs no further exchange."""
        d = stored_documents(docs)
        by_doc = d.repartition(index_partitions(d), "doc_id")
        p = postings(by_doc, fields, analyzer=analyzer)
        return cls(d, p, term_statistics(p), field_statistics(d, None, fields, analyzer), tuple(fields), analyzer, by_doc)
