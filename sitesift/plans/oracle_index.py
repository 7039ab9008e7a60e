"""DuckDB SQL for the index and search queries (F, G), written independently
of the Spark plans but over the same pinned constants."""

from __future__ import annotations

from ..functions.text import EXTRACT_LENGTH, EXTRACT_THRESHOLD, TOKEN_PATTERN
from ..operators.search import BM25_B, BM25_K1, SCORE_DECIMALS

DOCS_CTE = """docs AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, 'doc://' || CAST(doc_id AS VARCHAR) AS url,
         split_part(text, chr(10), 1) AS title, text AS data
  FROM documents)"""

FTOK_CTE = f"""fields AS (
  SELECT doc_id, 'url' AS field, url AS value FROM docs
  UNION ALL SELECT doc_id, 'title', title FROM docs
  UNION ALL SELECT doc_id, 'data', data FROM docs),
ftok AS (
  SELECT doc_id, field, regexp_extract_all(lower(value), '{TOKEN_PATTERN}', 1) AS tokens
  FROM fields WHERE value IS NOT NULL)"""

POSTINGS_CTE = """postings AS (
  SELECT term, field, doc_id, count(*) AS tf, max(dl) AS dl,
         list(CAST(pos AS INTEGER) ORDER BY pos) AS positions
  FROM (SELECT doc_id, field, CAST(len(tokens) AS BIGINT) AS dl,
               unnest(tokens) AS term, generate_subscripts(tokens, 1) - 1 AS pos
        FROM ftok)
  GROUP BY term, field, doc_id)"""

FSTATS_CTE = """fstats AS (
  SELECT field, count(*) AS n_docs, CAST(sum(len(tokens)) AS BIGINT) AS total_len,
         avg(len(tokens)) AS avg_dl
  FROM ftok GROUP BY field)"""

TSTATS_CTE = """tstats AS (
  SELECT term, field, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM postings GROUP BY term, field)"""


def queries_cte(limit: int = 10, offset: int = 0, and_fields: str = "NULL::VARCHAR[]",
                or_fields: str = "['data']") -> str:
    qterms = f"list_distinct(regexp_extract_all(lower(text), '{TOKEN_PATTERN}', 1))"
    return f"""q AS (
  SELECT CAST(item_id * 2 AS INTEGER) AS query_id, {qterms} AS qterms, 'and' AS mode,
         {and_fields} AS fields, {offset} AS qoffset, {limit} AS qlimit FROM benchmark
  UNION ALL
  SELECT CAST(item_id * 2 + 1 AS INTEGER), {qterms}, 'or', {or_fields}, {offset}, {limit} FROM benchmark)"""


SCORED_CTES = f"""qt AS (SELECT query_id, unnest(qterms) AS term, fields FROM q),
hits AS (
  SELECT qt.query_id, p.doc_id, p.term,
         ln(1 + (fs.n_docs - ts.df + 0.5) / (ts.df + 0.5)) * p.tf * {BM25_K1 + 1.0}
           / (p.tf + {BM25_K1} * ({1.0 - BM25_B} + {BM25_B} * p.dl / fs.avg_dl)) AS part
  FROM qt JOIN postings p ON p.term = qt.term
  JOIN tstats ts ON ts.term = p.term AND ts.field = p.field
  JOIN fstats fs ON fs.field = p.field
  WHERE qt.fields IS NULL OR list_contains(qt.fields, '*') OR list_contains(qt.fields, p.field)),
per_doc AS (
  SELECT query_id, doc_id, sum(part) AS raw, count(DISTINCT term) AS matched
  FROM hits GROUP BY query_id, doc_id),
scored AS (
  SELECT pd.query_id, pd.doc_id, round(pd.raw, {SCORE_DECIMALS}) AS score,
         CAST(pd.matched AS INTEGER) AS matched
  FROM per_doc pd JOIN q USING (query_id)
  WHERE q.mode = 'or' OR pd.matched = len(q.qterms)),
totals AS (
  SELECT q.query_id, CAST(coalesce(count(s.doc_id), 0) AS BIGINT) AS hitcount,
         coalesce(max(s.score), 0.0) AS max_score
  FROM q LEFT JOIN scored s USING (query_id) GROUP BY q.query_id),
ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn
  FROM scored s)"""

EXTRACT_SQL = (f"CASE WHEN length(d.data) > {EXTRACT_THRESHOLD} "
               f"THEN substring(d.data, 1, {EXTRACT_LENGTH}) ELSE d.data END")

RUN_PATTERN_SQL = r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"


def highlight_sql(data: str, terms: str, n: int = 50, k: int = 3, pre: str = "<b>", post: str = "</b>",
                  ell: str = "&hellip;") -> str:
    """G10 in DuckDB list lambdas (same fixed-size fragmenter)."""
    chunks = f"regexp_extract_all({data}, '(?s)(.{{1,{n}}})', 1)"
    runs = f"regexp_extract_all(f, '{RUN_PATTERN_SQL}', 1)"
    frags = (f"list_transform({chunks}, "
             f"lambda f, i: {{'neg_hits': -len(list_filter({runs}, lambda r: list_contains({terms}, lower(r)))), "
             f"'i': i - 1, "
             f"'text': array_to_string(list_transform({runs}, lambda r: CASE WHEN list_contains({terms}, lower(r)) "
             f"THEN '{pre}' || r || '{post}' ELSE r END), '')}})")
    hit = f"list_filter({frags}, lambda s: s.neg_hits < 0)"
    best = f"list_slice(list_sort({hit}), 1, {k})"
    ordered = f"list_sort(list_transform({best}, lambda s: {{'i': s.i, 'text': s.text}}))"
    joined = f"array_to_string(list_transform({ordered}, lambda s: s.text), '{ell}')"
    ext = (f"CASE WHEN length({data}) > {EXTRACT_THRESHOLD} THEN substring({data}, 1, {EXTRACT_LENGTH}) "
           f"ELSE {data} END")
    return f"CASE WHEN {data} IS NULL THEN NULL WHEN len({hit}) > 0 THEN {joined} ELSE {ext} END"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def sql_stored_documents() -> str:
    return _with(DOCS_CTE) + "SELECT doc_id, url, title, data FROM docs"


def sql_tokenize() -> str:
    return _with(DOCS_CTE, FTOK_CTE) + (
        "SELECT doc_id, field, tokens, CAST(len(tokens) AS BIGINT) AS dl FROM ftok")


def sql_postings() -> str:
    return _with(DOCS_CTE, FTOK_CTE, POSTINGS_CTE) + "SELECT term, field, doc_id, tf, dl, positions FROM postings"


def sql_term_statistics() -> str:
    return _with(DOCS_CTE, FTOK_CTE, POSTINGS_CTE, TSTATS_CTE) + "SELECT term, field, df, cf FROM tstats"


def sql_field_statistics() -> str:
    return _with(DOCS_CTE, FTOK_CTE, FSTATS_CTE) + "SELECT field, n_docs, total_len, avg_dl FROM fstats"


def _search_with(**kw) -> str:
    return _with(DOCS_CTE, FTOK_CTE, POSTINGS_CTE, FSTATS_CTE, TSTATS_CTE, queries_cte(**kw), SCORED_CTES)


def sql_matches(mode: str, **kw) -> str:
    return _search_with(**kw) + (
        f"SELECT s.query_id, s.doc_id, s.score, s.matched FROM scored s JOIN q USING (query_id) "
        f"WHERE q.mode = '{mode}'")


def sql_scores(**kw) -> str:
    return _search_with(**kw) + "SELECT query_id, doc_id, score FROM scored"


def sql_totals(**kw) -> str:
    return _search_with(**kw) + "SELECT query_id, hitcount, max_score FROM totals"


def sql_relative(**kw) -> str:
    return _search_with(**kw) + (
        f"SELECT s.query_id, s.doc_id, CASE WHEN t.max_score > 0 THEN round(s.score / t.max_score, "
        f"{SCORE_DECIMALS}) END AS relative_score FROM scored s JOIN totals t USING (query_id)")


def sql_topk(**kw) -> str:
    return _search_with(**kw) + (
        "SELECT r.query_id, CAST(r.rn - 1 AS INTEGER) AS rank, r.doc_id, r.score FROM ranked r "
        "JOIN q USING (query_id) WHERE r.rn > q.qoffset AND r.rn <= q.qoffset + q.qlimit")


def sql_search(highlight: bool = False, **kw) -> str:
    ext = highlight_sql("d.data", "q.qterms") if highlight else EXTRACT_SQL
    return _search_with(**kw) + f"""SELECT r.query_id, CAST(r.rn - 1 AS INTEGER) AS rank, r.doc_id, r.score,
  CASE WHEN t.max_score > 0 THEN round(r.score / t.max_score, {SCORE_DECIMALS}) END AS relative_score,
  d.title, d.url, {ext} AS extract, t.hitcount
FROM ranked r JOIN q USING (query_id) JOIN totals t USING (query_id) JOIN docs d USING (doc_id)
WHERE r.rn > q.qoffset AND r.rn <= q.qoffset + q.qlimit"""


def sql_fetch_stored(**kw) -> str:
    return _search_with(**kw) + """SELECT r.query_id, CAST(r.rn - 1 AS INTEGER) AS rank, r.doc_id, d.title, d.url
FROM ranked r JOIN q USING (query_id) JOIN docs d USING (doc_id)
WHERE r.rn > q.qoffset AND r.rn <= q.qoffset + q.qlimit"""


def sql_extract() -> str:
    return _with(DOCS_CTE) + f"SELECT d.doc_id, {EXTRACT_SQL} AS extract FROM docs d"


def sql_indexed_count() -> str:
    return _with(DOCS_CTE) + (
        "SELECT count(*) AS indexed_documents FROM docs WHERE title IS NOT NULL OR data IS NOT NULL")


def _clause_rows(kind: str) -> str:
    """(query_id, ci, occur, scope, terms) of the clauses that the derived queries hold."""
    def word(i, n=1):
        return f"array_to_string(list_slice(regexp_extract_all(text, '[^ \\n]+'), {i}, {i + n - 1}), ' ')"
    rows = {
        "must": [(word(1), "'data'", "must"), *[(word(i), "NULL", "should") for i in (2, 3, 4, 5)], (word(6), "'title'", "must_not")],
        "any": [(word(2), "'title'", "should"), (word(3), "'data'", "should"), (word(4), "NULL", "should"),
                (word(5), "NULL", "should"), (word(6), "'data'", "must_not")],
        "phrase": [(word(1, 3), "'data'", "must"), (word(5, 2), "NULL", "should")],
    }[kind]
    return " UNION ALL ".join(
        f"SELECT CAST(item_id AS INTEGER) AS query_id, {i} AS ci, '{occur}' AS occur, {field} AS scope, "
        f"regexp_extract_all(lower({text}), '{TOKEN_PATTERN}', 1) AS terms FROM benchmark"
        for i, (text, field, occur) in enumerate(rows))


def _clause_ctes(kind: str) -> str:
    return f"""cl AS ({_clause_rows(kind)}),
tok AS (SELECT query_id, ci, occur, scope, len(terms) AS n, unnest(terms) AS term,
               generate_subscripts(terms, 1) - 1 AS at FROM cl),
-- every place where a clause may begin, kept when all of its terms agree on it
st AS (
  SELECT query_id, ci, occur, n, doc_id, field, dl, start FROM (
    SELECT t.query_id, t.ci, t.occur, t.n, p.doc_id, p.field, p.dl, t.at, unnest(p.positions) - t.at AS start
    FROM tok t JOIN postings p USING (term) WHERE t.scope IS NULL OR t.scope = p.field)
  GROUP BY ALL HAVING count(*) = n),
wt AS (
  SELECT t.query_id, t.ci, ts.field, any_value(fs.avg_dl) AS avg_dl,
         sum(ln(1 + (fs.n_docs - ts.df + 0.5) / (ts.df + 0.5))) AS weight
  FROM tok t JOIN tstats ts USING (term) JOIN fstats fs ON fs.field = ts.field GROUP BY ALL),
pt AS (
  SELECT query_id, ci, occur, doc_id, weight * times * {BM25_K1 + 1.0}
           / (times + {BM25_K1} * ({1.0 - BM25_B} + {BM25_B} * dl / avg_dl)) AS part
  FROM (SELECT query_id, ci, occur, doc_id, field, dl, count(*) AS times FROM st GROUP BY ALL) JOIN wt USING (query_id, ci, field)),
bl AS (
  SELECT query_id, doc_id, sum(CASE WHEN occur = 'must_not' THEN 0 ELSE part END) AS raw,
         count(DISTINCT ci) FILTER (occur = 'must') AS must, count(DISTINCT ci) FILTER (occur = 'should') AS should,
         count(*) FILTER (occur = 'must_not') AS banned
  FROM pt GROUP BY query_id, doc_id),
scored AS (
  SELECT query_id, doc_id, round(raw, {SCORE_DECIMALS}) AS score, CAST(must + should AS INTEGER) AS matched
  FROM bl JOIN (SELECT query_id, count(*) FILTER (occur = 'must' AND len(terms) > 0) AS n_must FROM cl GROUP BY query_id) USING (query_id)
  WHERE banned = 0 AND must = n_must AND must + should > 0)"""


def sql_clauses(kind: str) -> str:
    return _with(DOCS_CTE, FTOK_CTE, POSTINGS_CTE, FSTATS_CTE, TSTATS_CTE, _clause_ctes(kind)) + (
        "SELECT query_id, doc_id, score, matched FROM scored")


def sql_phrase_search() -> str:
    return _with(DOCS_CTE, FTOK_CTE, POSTINGS_CTE, FSTATS_CTE, TSTATS_CTE, _clause_ctes("phrase")) + f"""SELECT
  r.query_id, CAST(r.rn - 1 AS INTEGER) AS rank, r.doc_id, r.score,
  CASE WHEN r.best > 0 THEN round(r.score / r.best, {SCORE_DECIMALS}) END AS relative_score,
  d.title, d.url, {EXTRACT_SQL} AS extract, r.hitcount
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn,
             max(score) OVER (PARTITION BY query_id) AS best, count(*) OVER (PARTITION BY query_id) AS hitcount
      FROM scored) r JOIN docs d USING (doc_id) WHERE r.rn <= 10"""


def sql_stop_list(words) -> str:
    stop = "[" + ", ".join(f"'{w}'" for w in words) + "]"
    kept = FTOK_CTE.replace(f"regexp_extract_all(lower(value), '{TOKEN_PATTERN}', 1)",
                            f"list_filter(regexp_extract_all(lower(value), '{TOKEN_PATTERN}', 1), "
                            f"lambda t: NOT list_contains({stop}, t))")
    asked = queries_cte().replace(f"regexp_extract_all(lower(text), '{TOKEN_PATTERN}', 1)",
                                  f"list_filter(regexp_extract_all(lower(text), '{TOKEN_PATTERN}', 1), "
                                  f"lambda t: NOT list_contains({stop}, t))")
    return _with(DOCS_CTE, kept, POSTINGS_CTE, FSTATS_CTE, TSTATS_CTE, asked, SCORED_CTES) + (
        "SELECT query_id, doc_id, score, matched FROM scored")
