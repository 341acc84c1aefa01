"""Registered queries against DuckDB on the smallest tables: one of each module here, all of them in the driver."""

import datetime
import decimal

import duckdb
import pytest

from loomgraph.plans import registry
from loomgraph.plans.views import TABLES

SMALL = "/root/testdata/sf0.001"
NAMES = """lst1_recent_documents lst5_related_documents lst15_companion fts0_sanitize fts1_keyword_search fts1_keyword_search_all_terms vec1_vector_search srch_hybrid knw1_knowledge_search
knw1g_edge_hits knn1_find_neighbors knn2_threshold_pairs lnk1_propose_edges heat1_scores heat1g_scores_created gph2_article_edges lnt2_contradictions lnt3_missing_links gap1_gaps viz2_cluster_colors
als2_index_aliases er1_match fam1_merge_families fam4_rewrite_edges mut1_insert_feed_items mut3_upsert_edges mut5_edited_documents mut7_delete_documents_orphans mut12_revise txt6_token_estimate
txt7_distinct_lines txt8_line_classes txt12_classified_lines txt21_payload txt28_grounded_merge evl5_novel_ratio evl7_surface evl8_case_scores evl21_policy_cases evl9_run_summary str1_polled_items str4_quarantine
fts1_phrase_search clu1_density_clusters er2_get_or_create bfs1_edges pr1_page_rank pip8_processed src6_feed_items src13_articles emb3_json_object str2_first_seen str5_latest_revision str7_tumbling_counts str7_session_counts
src2_files emb1_mock_vectors fts1_updated_index txt24_artifacts txt25_titles str3_triaged_after_poll str5_streamed_revisions str7_streamed_sessions""".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime):
        return str(v)
    return round(v, 9) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, duck, name):
    df = registry.queries()[name](spark, SMALL)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    r = duck.execute(registry.oracle_sql()[name])
    own = [c[0] for c in r.description]
    assert sorted(own) == names
    assert got == sorted((tuple(plain(x[own.index(c)]) for c in names) for x in r.fetchall()), key=repr)


def test_entry_points_import_without_the_rest():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "srch_hybrid" in e.queries()


def test_entry_points_need_no_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
