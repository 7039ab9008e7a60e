import re

from pyspark.sql import functions as F

from sitesift.functions.text import Analyzer, build_extract, tokenize
from sitesift.operators import search as se
from sitesift.operators.index import Index
from sitesift.plans.tables import benchmark_queries, documents_as_docs
from sitesift.operators.search import matches, query_table
from sitesift.session import scratch_path
from sitesift.sources.index_store import read_index, write_index

from .conftest import SF001


def test_extract_lengths(spark):
    df = spark.createDataFrame([("a" * 200,), ("b" * 201,), ("c" * 202,), (None,)], "d string")
    got = [r.e for r in df.select(build_extract("d").alias("e")).collect()]
    assert [len(x) if x else x for x in got] == [200, 201, 201, None]


def test_tokenize_letters_and_digits(spark):
    df = spark.createDataFrame([("Heiß & Ümläut-42, x_y",)], "t string")
    assert df.select(tokenize("t").alias("k")).first().k == ["heiß", "ümläut", "42", "x", "y"]


def _index(spark):
    return Index.build(documents_as_docs(spark, SF001))


def test_pages_concatenate_to_full_ranking(spark):
    idx = _index(spark)
    q = benchmark_queries(spark, SF001).where(F.col("mode") == "or").where(F.col("query_id") < 12)
    full = {(r.query_id, r.rank): r.doc_id for r in se.search(idx, q.withColumn("limit", F.lit(9))).collect()}
    paged = {}
    for off in (0, 3, 6):
        page = q.withColumn("offset", F.lit(off)).withColumn("limit", F.lit(3))
        for r in se.search(idx, page).collect():
            paged[(r.query_id, r.rank)] = r.doc_id
            if off == 0 and r.rank == 0:
                assert r.relative_score == 1.0
    assert paged == full and len(full) > 0


def test_and_is_subset_of_or(spark):
    idx = _index(spark)
    q = benchmark_queries(spark, SF001)
    m = se.matches(idx, q).collect()
    nq = {r.query_id: len(set(r.t)) for r in
          se.normalize_queries(q).select("query_id", F.col("qterms").alias("t")).collect()}
    for r in m:
        if r.query_id % 2 == 0:      # AND queries match every term
            assert r.matched == nq[r.query_id]
        assert r.matched >= 1


def test_zero_hit_query_has_zero_hitcount(spark):
    idx = _index(spark)
    q = spark.createDataFrame([(1, ["zzqqxxnothere"], "and", None, 0, 10)],
                              "query_id int, terms array<string>, mode string, fields array<string>, "
                              "offset int, limit int")
    tot = se.search_totals(idx, q).collect()
    assert [(r.query_id, r.hitcount, r.max_score) for r in tot] == [(1, 0, 0.0)]
    assert se.search(idx, q).count() == 0


def test_written_index_answers_like_built_index(spark):
    idx = _index(spark)
    path = scratch_path(spark, "test-index")
    write_index(idx, path)
    stored = read_index(spark, path)
    q = benchmark_queries(spark, SF001)
    a = sorted(se.search(idx, q).select("query_id", "rank", "doc_id", "score").collect())
    b = sorted(se.search(stored, q).select("query_id", "rank", "doc_id", "score").collect())
    assert a == b and len(a) > 0


def test_append_equals_one_shot(spark):
    docs = documents_as_docs(spark, SF001)
    path = scratch_path(spark, "test-append")
    write_index(Index.build(docs.where("doc_id % 2 = 0")), path, create=True)
    write_index(Index.build(docs.where("doc_id % 2 = 1")), path, create=False)
    got = read_index(spark, path)
    one = Index.build(docs)
    assert sorted(got.term_stats.collect()) == sorted(one.term_stats.collect())
    fs = {r.field: (r.n_docs, round(r.avg_dl, 9)) for r in got.field_stats.collect()}
    fo = {r.field: (r.n_docs, round(r.avg_dl, 9)) for r in one.field_stats.collect()}
    assert fs == fo


def test_highlight_tags_terms(spark):
    idx = _index(spark)
    q = benchmark_queries(spark, SF001).where(F.col("query_id") == 1)
    rows = se.search(idx, q, se.SearchOptions(highlight=True)).collect()
    assert rows and all("<b>" in r.extract for r in rows)


def test_query_table_and_highlight_options(spark):
    idx = _index(spark)
    first = documents_as_docs(spark, SF001).where("doc_id = 0").first()
    word = first.data.split()[0].strip(".,;:!?").lower()
    q = se.query_table(spark, [(7, word.upper())], mode="or", fields=["data"], limit=3)
    rows = se.search(idx, q, se.SearchOptions(highlight=True, pre_tag="[", post_tag="]", ellipsis=" ... ",
                                              excerpt_length=30, num_excerpts=2)).collect()
    assert rows and rows[0].hitcount >= 1
    assert all("[" in r.extract and "<b>" not in r.extract for r in rows)
    assert all(r.extract.count(" ... ") <= 1 for r in rows)


def test_index_batch_reports_indexed_count(spark):
    docs = documents_as_docs(spark, SF001)
    path = scratch_path(spark, "test-count")
    res = write_index(Index.build(docs), path)
    assert res.batch == 0 and res.indexed_documents == docs.count()


def test_index_spreads_beyond_64_tasks_publishes_last_and_compacts(spark, tmp_path):
    import os
    from sitesift.sources.index_store import compact_index
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("u"), "id").alias("url"),
                                   F.lit("t").alias("title"), F.concat_ws(" ", F.lit("word"), "id").alias("data"))
    path = str(tmp_path / "index")
    write_index(Index.build(docs.where("doc_id % 3 > 0")), path, partitions=100)
    folders = os.listdir(f"{path}/docs/batch=0/parts=128")
    assert sum(f.startswith("part=") for f in folders) > 100
    write_index(Index.build(docs.where("doc_id % 3 = 0")), path, create=False, partitions=4)
    os.makedirs(f"{path}/docs/batch=7/parts=1/part=0")          # a writer that did not come to publish
    index = read_index(spark, path)
    q = se.query_table(spark, [(1, "word 33"), (2, "word 34")], mode="and")
    found = {(r.query_id, r.doc_id, r.url) for r in se.search(index, q).collect()}
    assert found == {(1, 33, "u33"), (2, 34, "u34")} and index.docs.count() == 600
    assert compact_index(spark, path, partitions=2).indexed_documents == 600
    assert {(r.query_id, r.doc_id, r.url) for r in se.search(read_index(spark, path), q).collect()} == found
    assert not any(os.path.exists(f"{path}/docs/batch={b}") for b in (0, 1))


def test_paging_beyond_int_and_empty_fields(spark):
    docs = spark.createDataFrame([(1, "u", "t", "foo bar")], "doc_id long, url string, title string, data string")
    q = spark.createDataFrame([(1, ["foo"], "or", [], 1, 2147483647), (2, ["foo"], "or", [], 0, 2147483647)],
                              "query_id int, terms array<string>, mode string, fields array<string>, "
                              "offset int, limit int")
    assert [r.query_id for r in se.search(Index.build(docs), q).collect()] == [2]


def test_matching_shuffles_documents_only(spark):
    """A row per posting, or per posting and query, is never shuffled: postings lie by document."""
    docs = spark.createDataFrame([(i, f"doc://{i}", f"t{i % 3}", f"ebb tide {i % 5} ebb") for i in range(30)],
                                 "doc_id long, url string, title string, data string")
    index = Index.build(docs)
    and_q, or_q = query_table(spark, [(1, "ebb 3")]), query_table(spark, [(2, "tide 4")], mode="or", fields=["data"])
    found = matches(index, and_q.unionByName(or_q))
    plan = found._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"hashpartitioning\(([^)]*)", plan) + re.findall(r"hashpartitioning\(([^)]*)", index.postings._jdf.queryExecution().executedPlan().toString())
    assert not [k for k in keys if "doc_id" in k and re.search("term|query_id", k)], plan
    got = {(r.query_id, r.doc_id) for r in found.collect()}
    assert got == {(1, i) for i in range(30) if i % 5 == 3} | {(2, i) for i in range(30)}
    times = {(r.doc_id, r.tf): r.positions for r in index.postings.where("term = 'ebb'").collect()}
    assert times == {(i, 2): [0, 3] for i in range(30)}


def test_texts_are_tokenized_once_for_postings_and_once_for_statistics(spark):
    docs = [(1, "u", "a b", "b c"), (2, None, None, "c c d"), (3, "u", "", None), (4, "u", "a the", "the a"),
            (1, "u", "a", "e"), (5, None, "x", "")]                                 # a doc_id may repeat
    df = spark.createDataFrame(docs, "doc_id long, url string, title string, data string")
    terms = spark.createDataFrame([(t,) for t in ("a", "c", "e", "the", "nowhere")], "term string")
    for analyzer in (Analyzer(), Analyzer(stop_words=("the",))):
        index = Index.build(df, analyzer=analyzer)
        want = index.stats_of(terms).join(index.field_stats, "field").select("term", "field", "df", "n_docs", "avg_dl")
        for few in (True, False):
            got = index.weights_of(terms, few)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
            assert got.count() == (4 if analyzer.stop_words else 6)
        for made in (index.postings, index.weights_of(terms, True)):
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert plan.count("regexp_extract_all(lower(value") == 1, plan
