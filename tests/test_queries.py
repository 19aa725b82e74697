"""Registered queries against their SQL. One per area by default, all with TIDEGLASS_ALL=1."""

import os

import pytest

import __spark_entry__ as entry
from compare import difference, duck

SF_DIR = os.environ.get("TIDEGLASS_SF_DIR", "/root/testdata/sf0.001")
SAMPLE = [
    "join_evidence_drilldown", "signal_dpd_worsening", "utilization_ratio", "join_point_in_time", "correction_reversal",
    "join_policy_version_overlap", "pick_policy_precedence", "policy_eval_priority", "episode_lifecycle", "corr_hypothesis",
    "assess_human_review", "audit_hypothesis", "audit_assessment", "src_canonical_events", "sink_signal_insert_if_absent",
    "feature_roll", "feature_rating_notches", "win_peer_percentile", "graph_group_components", "signal_round_tripping",
    "text_candidate_spans", "ml_training_extract", "stream_dpd_signals", "stream_rolling_count",
    "policy_window_values", "signal_balance_drain", "trace_drawn_money",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="given tables are not here")
@pytest.mark.parametrize("name", sorted(entry.queries()) if os.environ.get("TIDEGLASS_ALL") else SAMPLE)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() >= 0
    else:
        assert difference(df, con, sql) is None


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="given tables are not here")
@pytest.mark.parametrize(
    "name",
    ["win_returned_payment_count_30d", "signal_dpd_worsening", "join_point_in_time", "utilization_ratio", "join_policy_version_overlap", "win_peer_percentile"],
)
def test_query_with_hot_keys(spark, con, name):
    spark.conf.set("spark.tideglass.hotRows", "15")
    try:
        assert difference(entry.queries()[name](spark, SF_DIR), con, entry.oracle_sql()[name]) is None
    finally:
        spark.conf.unset("spark.tideglass.hotRows")


def test_every_query_reads_given_tables():
    for name, sql in entry.oracle_sql().items():
        assert any(f" {t}" in sql for t in ("lineitem", "orders", "customer", "supplier", "events", "documents", "labels", "pages")), name
