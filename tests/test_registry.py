import os
import subprocess
import sys

import __spark_entry__ as E
from sitesift.plans import registry

from .conftest import SF001

# Queries without a SQL equivalent, each covered by a pytest against brute
# force (test_crawl).
ROWS_ONLY = {"crawl_etag"}

SURVEY_IDS = ("seed_frontier page_scan status_route file_scan mime_from_extension index_sink rewrite_uri "
              "uri_split drop_empty_and_file_children resolve_relative_uri strip_fragment append_index_document "
              "remove_trailing_slash scheme_filter_http scheme_filter_file hostname_filter url_inclusion_filter "
              "url_exclusion_filter path_inclusion_filter path_exclusion_filter depth_filter filter_chain "
              "needs_indexing visited_dedup etag_dedup crawl_frontier redirect_requeue link_edges "
              "content_type_dispatch extract_title extract_content extract_links strip_comments strip_tags "
              "decode_entities extract_by_selector meta_attribute_title title_postprocess extract_pages "
              "stored_documents tokenize postings term_statistics field_statistics indexed_count match_all "
              "match_any field_scope score hitcount relative_score topk_page fetch_stored extract highlight search "
              "stream_visited_dedup stream_index_append").split()


def test_every_survey_operator_is_registered_with_an_oracle():
    q, o = registry.queries(), registry.oracle_sql()
    assert set(q) <= set(E.queries()) and set(o) <= set(E.oracle_sql())
    assert set(SURVEY_IDS) <= set(q)
    assert set(o) <= set(q)
    assert set(q) - set(o) == ROWS_ONLY


def test_entry_schema(spark):
    df = E.entry(spark)
    assert [f.name for f in df.schema.fields] == ["query_id", "rank", "doc_id", "score", "relative_score", "title",
                                                   "url", "extract", "hitcount"]
    rows = df.collect()
    assert rows and all(r.rank >= 0 and 0 < r.relative_score <= 1.0 for r in rows)


def test_small_queries_run_at_smoke_scale(spark):
    q = E.queries()
    for name in ("extract_pages", "filter_chain", "postings", "status_route"):
        assert q[name](spark, SF001).count() > 0


def test_entry_imports_without_the_training_data_operators():
    code = """
import sys

class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "sitesift.llm"):
            raise ModuleNotFoundError(name, name=name)

sys.meta_path.insert(0, Gone())
import __spark_entry__ as E
from sitesift.plans import registry
assert set(E.queries()) == set(registry.queries()) and set(E.oracle_sql()) == set(registry.oracle_sql())
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
