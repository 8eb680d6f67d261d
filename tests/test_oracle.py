"""A spread of registered queries against their SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as contract
from check import compare
from gradeloom.plans.views import TABLES

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "normalize_number", "parse_key_text", "classify_ink", "refine_classification", "check_manual_corners", "room_ranking", "indicator_scores", "roster_gaps",
    "review_state", "snapshot", "check_snapshot", "issues", "finalize", "adopt_numbers", "skip_remaining", "check_reviews", "check_annotations",
    "candidate_votes", "decide_identity", "knn", "truth_join", "recognizer_summary", "bootstrap_ci", "replay_annotations", "stratified_split",
    "overlap_join", "check_template", "ingest_sources", "quota", "stream_sessions", "fingerprint", "skip_remaining_edits", "skip_drift", "purge_exam",
    "replace_indicators", "quota_exact", "stream_quota", "stream_progress_rows", "dedupe_near", "next_review", "cluster_gaps", "longest_regular_run", "knn_hashed",
    "nearest_centroid", "snapshot_documents", "read_template", "auto_key", "template_diff", "check_holdout", "grade", "publish",
]


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    line = compare(spark, con, name, FOLDER, contract.queries(), contract.oracle_sql())
    assert line.startswith("ok"), line


def test_every_query_is_documented_with_ids():
    from gradeloom.plans.registry import IDS, QUERIES

    assert set(IDS) == set(QUERIES) and all(IDS.values())


def test_entry_has_rows(spark):
    assert contract.entry(spark).limit(5).count() == 5
