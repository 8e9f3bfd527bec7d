"""Registered queries: contract, and agreement with their SQL twins on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
# the slow text jobs are covered by tests of their own and by tests/oracle.py
FAST = ["cheapest_per_source", "filter_price_outliers", "source_median_price", "source_status", "merge_source_status", "cached_fallback",
        "price_history", "evaluate_alerts", "toggle_alerts", "upsert_existing", "deactivate_missing", "catalog_metrics", "accept_reviews",
        "reject_reviews", "route_requests", "validate_records", "reject_or_partial", "read_feed_auto", "memory_features", "memory_choices",
        "variant_mismatches", "search_catalog", "match_by_identifier", "extract_listing_rows", "extract_structured_offers", "flatten_positions",
        "stream_min_price", "stream_observation_dedupe", "stream_price_alerts", "stream_stale_watch", "stream_subscriptions"]


@pytest.fixture(scope="module")
def duck():
    con = connect(SF)
    yield con
    con.close()


def test_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert set(FAST) <= set(oracles)
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", FAST)
def test_matches_sql(spark, duck, name):
    assert compare(spark, duck, name, entry.queries()[name], entry.oracle_sql()[name], SF) == []
