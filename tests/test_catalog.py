"""Every query has SQL; a cross-section is compared on the smallest data."""

import pytest

import __spark_entry__ as entry
from compare import difference, duck

SF = "/root/testdata/sf0.001"
CHECKED = (
    "curated_overview", "upsert_postings", "new_vs_existing", "master_postings", "backfill_headcount",
    "backfill_published", "dedupe_postings", "run_stats", "category_jobs", "keyword_match", "early_stop_prefix",
    "position_slice_large", "application_rownum", "batch_100", "route_category_tabs", "feed_b_filters",
    "location_resolve", "extract_cards", "traverse_pages", "is_noise", "clean_text_html", "stream_upsert",
)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_a_counterpart():
    assert set(entry.QUERIES) == set(entry.oracle_queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    assert difference(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) == ""
