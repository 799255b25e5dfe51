"""Queries against their DuckDB twins over the smallest tables."""

import os

import duckdb
import pytest

from inkwell.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = [
    "bm25_top10", "hybrid_score", "rank_fusion", "topic_edges", "related_topics", "collocations", "fragment_free", "label_search", "changed_documents", "calendar_grid", "sentence_split", "sentence_ends", "title_and_index_lines", "block_types",
    "merged_paragraphs", "longest_sections", "reader_window", "meetings_near", "rolling_active", "streaks", "user_sessions", "stratified_split",
    "filter_report", "hard_negatives", "far_from_gold", "overlap_with_benchmark", "exact_counts", "revenue_by_nation",
    "feed_scan", "feed_meetings", "meetings_by_range", "online_meetings", "online_soonest", "subscriber_settings", "subscriber_upsert", "rare_first", "fresh_results", "merged_lists", "int8_nearest",
    "query_windows", "concept_peers", "concept_places", "topic_votes", "topics_of_turns", "label_keys", "split_by_share", "assigned_flaws", "sample_prompts", "memory_snapshot", "cross_pairs",
    "citation_hits", "open_threads", "reading_parts", "best_pages", "result_passages", "book_names", "titles_and_authors",
    "mined_concepts", "mined_phrases", "mined_edges", "meeting_asks", "ask_changes", "meeting_lines", "feed_near", "retrieved_scores", "starter_picks", "kinds_of_samples", "passages_of_samples",
    "manifests_read_back", "newest_packs", "best_of_sources", "query_graph", "second_chance", "saved_turns", "scale_or_all", "verified_quotes", "titles_for_pointers", "knn_cosine", "recall_by_kind", "block_factors", "kind_quotas",
]


def norm(v):
    if v is None or v != v:
        return ""
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", CHOSEN)
def test_rows_equal(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(norm(v) for v in r) for r in want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
