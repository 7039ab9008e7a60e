import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sitesift.functions.text import STOP_WORDS_EN, Analyzer
from sitesift.operators import search as se
from sitesift.operators.index import Index
from sitesift.plans.tables import benchmark_queries, clause_queries, documents_as_docs
from sitesift.session import scratch_path
from sitesift.sources.index_store import read_index, write_block_maxima, write_index

from .conftest import SF001

DOCS = "doc_id long, url string, title string, data string"
CLAUSES = "query_id int, clauses array<struct<text:string,field:string,occur:string>>"


def random_docs(r, n):
    vocabulary = ["the", "quick", "brown", "fox", "jumps", "over", "lazy", "dog", "of", "night"]
    return [(i, f"u{i}", " ".join(r.choices(vocabulary, k=r.randrange(0, 4))) if r.random() < 0.9 else None,
             " ".join(r.choices(vocabulary, k=r.randrange(0, 15)))) for i in range(n)]


def brute(docs, clauses, stop=()):
    """{doc_id: (score, matched)} of one query by scanning every document."""
    fields = {f: {d[0]: d[j].split() for d in docs if d[j] is not None} for j, f in ((1, "url"), (2, "title"), (3, "data"))}
    kept = {f: {i: [(p, t) for p, t in enumerate(ts) if t not in stop] for i, ts in by.items()} for f, by in fields.items()}
    average = {f: sum(map(len, by.values())) / len(by) for f, by in kept.items()}
    asked = []
    for text, field, occur in clauses:
        terms = [(p, t) for p, t in enumerate(text.split()) if t not in stop]
        if terms:
            asked.append((terms, field, occur))
    out = {}
    for d in docs:
        score, must, should, banned = 0.0, 0, 0, False
        for terms, field, occur in asked:
            hit = False
            for f, by in kept.items():
                if d[0] not in by or (field not in (None, "*") and field != f):
                    continue
                at = {}
                for p, t in by[d[0]]:
                    at.setdefault(t, set()).add(p)
                starts = set.intersection(*({p - o for p in at.get(t, ())} for o, t in terms))
                if starts:
                    hit, n = True, len(by)
                    df = [sum(any(x == t for _, x in ts) for ts in by.values()) for _, t in terms]
                    weight = sum(math.log(1 + (n - x + 0.5) / (x + 0.5)) for x in df)
                    norm = 1.2 * (0.25 + 0.75 * len(by[d[0]]) / average[f])
                    score += 0 if occur == "must_not" else weight * len(starts) * 2.2 / (len(starts) + norm)
            must += hit and occur == "must"
            should += hit and occur == "should"
            banned |= hit and occur == "must_not"
        if not banned and must == sum(o == "must" for _, _, o in asked) and must + should:
            out[d[0]] = (score, must + should)
    return out


def check(index, spark, queries, docs, stop=()):
    df = spark.createDataFrame(list(enumerate(queries)), CLAUSES)
    got = {}
    for r in se.matches(index, df).collect():
        got.setdefault(r["query_id"], {})[r["doc_id"]] = (r["score"], r["matched"])
    for i, clauses in enumerate(queries):
        want = brute(docs, clauses, stop)
        assert set(got.get(i, {})) == set(want), clauses
        for d, (score, matched) in want.items():
            assert abs(got[i][d][0] - score) < 2e-6 and got[i][d][1] == matched


QUERIES = [
    [("fox", "data", "must")],
    [("fox", "title", "must"), ("dog", None, "must_not")],
    [("quick", "*", "should"), ("lazy", "title", "should"), ("night", "data", "must_not")],
    [("fox", None, "must_not")],
    [("quick brown", "data", "must"), ("dog", None, "should")],
    [("fox fox", None, "should"), ("lazy dog", None, "should")],
    [("fox the fox", "data", "must")],
    [("quick of", None, "must_not"), ("fox", None, "must")],
    [("nowhere", None, "must"), ("fox", None, "should")],
    [("fox nowhere", None, "should"), ("dog", None, "should")],
    [("", None, "must"), ("dog", "data", "should")],
    [],
]


def test_clauses_and_phrases_against_a_scan(spark):
    docs = random_docs(random.Random(1), 150)
    check(Index.build(spark.createDataFrame(docs, DOCS).repartition(3)), spark, QUERIES, docs)


def test_occur_defaults_to_the_mode_of_the_query(spark):
    docs = [(1, "u", "a b", ""), (2, "u", "a", ""), (3, "u", "c", "")]
    index = Index.build(spark.createDataFrame(docs, DOCS))
    both = [("a", None, None), ("b", None, None)]
    df = spark.createDataFrame([(1, both, "and"), (2, both, "or"), (3, None, "and")], CLAUSES + ", mode string")
    got = sorted((r["query_id"], r["doc_id"]) for r in se.matches(index, df).collect())
    assert got == [(1, 1), (2, 1), (2, 2)]


def test_many_clauses_need_more_than_one_mask(spark):
    docs = [(1, "u", None, " ".join(f"t{i}" for i in range(150))), (2, "u", None, " ".join(f"t{i}" for i in range(149)))]
    query = [(f"t{i}", "data", "must") for i in range(150)]
    got = se.matches(Index.build(spark.createDataFrame(docs, DOCS)), spark.createDataFrame([(7, query)], CLAUSES)).collect()
    assert [(r["doc_id"], r["matched"]) for r in got] == [(1, 150)]


def test_page_totals_and_highlight_of_clauses(spark):
    docs = random_docs(random.Random(3), 60)
    index = Index.build(spark.createDataFrame(docs, DOCS))
    df = spark.createDataFrame([(4, [("lazy dog", "data", "must")])], CLAUSES)
    want = brute(docs, [("lazy dog", "data", "must")])
    rows = se.search(index, df, se.SearchOptions(highlight=True)).collect()
    assert 0 < len(rows) == min(10, len(want)) and {r["hitcount"] for r in rows} == {len(want)}
    assert all("<b>lazy</b>" in r["extract"] for r in rows)
    assert se.search_totals(index, df).first()["hitcount"] == len(want)


def test_analyzer_is_kept_with_the_index(spark):
    docs = random_docs(random.Random(5), 120)
    path = scratch_path(spark, "test-analyzer")
    analyzer = Analyzer(stop_words=("THE", "of"))
    df = spark.createDataFrame(docs, DOCS)
    write_index(Index.build(df.where("doc_id < 60"), analyzer=analyzer), path)
    write_index(Index.build(df.where("doc_id >= 60"), analyzer=analyzer), path, create=False)
    index = read_index(spark, path)
    assert index.analyzer == Analyzer(stop_words=("of", "the"))
    assert index.postings.where("term in ('the', 'of')").count() == 0
    check(index, spark, QUERIES, docs, stop=("the", "of"))          # phrases hold across stop words
    plain = spark.createDataFrame([(1, ["the fox"], "and")], "query_id int, terms array<string>, mode string")
    assert se.matches(index, plain).count() == len(brute(docs, [("fox", None, "must")], ("the", "of")))
    with pytest.raises(ValueError, match="another analyzer"):
        write_index(Index.build(df), path, create=False)


def test_analyzers(spark):
    df = spark.createDataFrame([("Don't stop-me A1 now",)], "t string")

    def terms(a):
        return df.select(a.terms("t").alias("k")).first()["k"]
    assert terms(Analyzer("letter")) == ["don", "t", "stop", "me", "a", "now"]
    assert terms(Analyzer("whitespace", lower=False)) == ["Don't", "stop-me", "A1", "now"]
    assert terms(Analyzer(stop_words=(*STOP_WORDS_EN, "t"))) == ["don", "stop", "me", "a1", "now"]
    assert [(x["at"], x["term"]) for x in df.select(Analyzer(stop_words=("stop", "me")).placed("t").alias("k")).first()["k"]] \
        == [(0, "don"), (1, "t"), (4, "a1"), (5, "now")]
    with pytest.raises(ValueError, match="unknown analyzer"):
        Analyzer("stemmed")


def files_read(df):
    """Rows of ``df`` and how many files its scans of postings opened."""
    rows = df.collect()
    leaves = df._jdf.queryExecution().executedPlan().executedPlan().collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.size())]
    return rows, [s.metrics().get("numFiles").get().value() for s in scans if s.nodeName().startswith("Scan parquet")]


def test_a_batch_of_terms_reads_its_folders_only(spark):
    docs = documents_as_docs(spark, SF001)
    path = scratch_path(spark, "test-folders")
    write_index(Index.build(docs.where("doc_id % 2 = 0")), path, term_folders=128)
    write_index(Index.build(docs.where("doc_id % 2 = 1")), path, create=False, term_folders=256)   # batches may differ
    index = read_index(spark, path)
    few = [r["term"] for r in index.term_stats.select("term").distinct().orderBy(F.hash("term")).limit(10).collect()]
    terms = F.broadcast(spark.createDataFrame([(t,) for t in few], "term string"))
    found = index.postings_of(terms).select("term", "field", "doc_id", "tf")
    rows, read = files_read(found)
    whole = sum(spark.read.parquet(f"{path}/postings/batch={b}").select(F.input_file_name()).distinct().count() for b in (0, 1))
    assert sum(read) < whole / 10
    want = Index.build(docs).postings.where(F.col("term").isin(few)).select("term", "field", "doc_id", "tf")
    assert sorted(map(tuple, rows)) == sorted(map(tuple, want.collect())) and rows


def test_block_maxima_give_the_same_page_from_fewer_postings(spark):
    docs = documents_as_docs(spark, SF001)
    path = scratch_path(spark, "test-blocks")
    write_index(Index.build(docs), path)
    queries = benchmark_queries(spark, SF001, limit=3)
    assert read_index(spark, path).blocks is None
    assert write_block_maxima(spark, path, documents=2) > 50
    index = read_index(spark, path)
    page = sorted(map(tuple, se.search_page(index, queries).collect()))
    full = se.search(index, queries).select("query_id", "rank", "doc_id", "score")
    assert page == sorted(map(tuple, full.collect())) and page
    ranked = queries.where("mode = 'or'")
    q = se.normalize_queries(ranked, index.analyzer)
    n_terms, max_rank, _, max_q, n = se._bounds(q)
    scored = se.top_scores(index, q, max_rank, n_terms, max_q, n).count()
    assert scored < 0.5 * se.matches(index, ranked).count()
    write_index(Index.build(docs.where("doc_id < 20")), path, create=False)         # a later version has none
    assert read_index(spark, path).blocks is None


def test_a_page_by_block_maxima_scores_queries_of_all_terms_by_block_too(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"u{i}", f"t {i % 3}", " ".join(w for k, w in enumerate(("ash", "birch", "cedar", "elm"))
                                                                      if i % (k + 2) == 0) + f" oak {i}") for i in range(60)],
                                 "doc_id long, url string, title string, data string")
    path = scratch_path(spark, "test-and-blocks")
    write_index(Index.build(docs), path)
    write_block_maxima(spark, path, documents=3)
    index = read_index(spark, path)
    # two of all terms, one of them in a field, one with a term that is nowhere, one without terms, two of any, one of them in no field
    queries = spark.createDataFrame([(1, ["ash birch"], "and", None, 0, 4), (2, ["ash oak t"], "and", ["data", "data"], 0, 4),
                                     (3, ["cedar oak"], "and", ["data"], 1, 3), (4, ["ash absent"], "and", None, 0, 4),
                                     (5, [""], "and", None, 0, 4), (6, ["elm cedar"], "or", ["*"], 0, 5),
                                     (7, ["elm"], "or", ["body"], 0, 5)],
                                    "query_id int, terms array<string>, mode string, fields array<string>, offset int, limit int")
    want = sorted(map(tuple, se.search(index, queries).select("query_id", "rank", "doc_id", "score").collect()))
    monkeypatch.setattr(se, "score_matches", None)                  # not all documents by all terms
    assert sorted(map(tuple, se.search_page(index, queries).collect())) == want
    assert {r[0] for r in want} == {1, 3, 6}


@pytest.mark.parametrize("kind", ["must", "any", "phrase"])
def test_clauses_spread_the_documents_once_and_join_no_postings_with_postings(spark, kind):
    df = se.matches(Index.build(documents_as_docs(spark, SF001)), clause_queries(spark, SF001, kind))
    assert df.count() > 0 and df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(set(re.findall(r"Exchange hashpartitioning\(doc_id.*plan_id=(\d+)", plan))) == 1, plan     # reused ones name the first
    assert "Join [doc_id" not in plan
