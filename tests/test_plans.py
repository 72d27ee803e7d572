"""The physical plans keep the properties that large data needs."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as contract
from conftest import SMALL

# Queries whose plan is lazy as a whole, from each operator family.
LAZY = [
    "last_event", "dominant_category", "tag_state", "valid_unique", "valid_multi", "impute_registration",
    "unmatched_residue", "impute_modal_amount", "multi_valued_latest", "multi_values", "speed_anomaly",
    "anomaly_overlap", "transitions", "dominant_next_place", "dominant_prev_place_lane", "presence_flags",
    "active_day_ratio", "proximity", "label_on_day", "feature_table", "history_vector", "quality_funnel",
    "match_master", "similar_to_item", "popular_items", "mean_rating", "user_ones", "word_count", "degrees",
    "top_degrees", "graph_vertices",
]


def plan(spark, name, **settings):
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        return contract.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_python(spark, name):
    # Without automatic broadcasts, as for large tables.
    text = plan(spark, name, **{"spark.sql.autoBroadcastJoinThreshold": "-1"})
    assert not re.search(r"CartesianProduct|NestedLoop|EvalPython|InPandas|ExistingRDD", text)


@pytest.mark.parametrize("name", ["last_event", "feature_table", "proximity", "presence_flags", "active_day_ratio"])
def test_date_ranges_reach_the_scan(spark, name):
    text = plan(spark, name)
    assert re.search(r"PushedFilters: \[[^\]]*(Less|Greater)Than(OrEqual)?\(ts", text) or "DataFilters: [isnotnull(ts" in text


def test_feature_table_reads_three_columns_once_per_input(spark):
    text = plan(spark, "feature_table", **{"spark.sql.autoBroadcastJoinThreshold": "-1"})
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", text)
    assert len(scans) == 2
    for scan in scans:
        assert {c.split("#")[0] for c in scan.split(",")} == {"ts", "user_id", "event_type"}
    assert "SortAggregate" not in text


@pytest.mark.parametrize("name", ["last_event", "latest_row_per_key", "first_event", "proximity"])
def test_latest_rows_are_limited_before_the_shuffle(spark, name):
    text = plan(spark, name)
    assert re.search(r"WindowGroupLimit .*Partial", text)


def test_quality_funnel_is_one_combined_aggregation(spark):
    text = plan(spark, "quality_funnel")
    assert "Expand" not in text and "distinct" not in text


def test_presence_flags_need_one_shuffle(spark):
    assert plan(spark, "presence_flags").count("Exchange") == 1


def test_popular_items_do_not_shuffle_the_dimension(spark):
    text = plan(spark, "popular_items", **{"spark.sql.autoBroadcastJoinThreshold": "-1"})
    assert re.search(r"BroadcastHashJoin .*LeftSemi", text)


def counted(text):
    """Exchanges, those used again left out, and scans of a plan."""
    return len(re.findall(r"(?<!Reused)Exchange ", text)), text.count("FileScan")


@pytest.mark.parametrize(
    ("name", "exchanges", "scans"),
    [("impute_registration", 10, 5), ("impute_modal_amount", 11, 4), ("impute_modal_remaining", 11, 4), ("dominant_next_place", 8, 3)],
)
def test_shuffles_and_scans_stay_few(spark, name, exchanges, scans):
    text = plan(spark, name, **{"spark.sql.autoBroadcastJoinThreshold": "-1"})
    assert counted(text) <= (exchanges, scans) and counted(text)[1] <= scans
