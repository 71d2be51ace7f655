"""What the plans must and must not contain."""

import os
import re

import pytest
from tarnkit.models import draws as D
from tarnkit.operators import correlation, quantiles, reshape, summaries
from tarnkit.plans import all_queries
from tarnkit.plans.bindings import draws, samples
from tarnkit.sources.tables import read_table

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")
FITTED = {
    "impute_multiple", "imputation_quantiles", "holdout_forest", "forest_importance", "tuning_metrics",
    "detection_model_draws", "bootstrap_coefficients", "draws_contract", "impute_contract", "holdout_contract", "importance_contract",
    "tuning_contract",
}


def plan(df, run=False):
    if run:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(all_queries()) - FITTED))
def test_no_cross_product(spark, name):
    text = plan(all_queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_counts_are_shuffled_once(spark):
    lines = read_table(spark, FOLDER, "lineitem").select("l_returnflag", "l_quantity", "l_tax")
    plain = quantiles.group_quantiles(lines, ["l_returnflag"], "l_quantity", {"m": 0.5}, pieces=8)
    long = quantiles.group_quantiles(reshape.longer(lines, ["l_returnflag"]), ["l_returnflag", "name"], "value", {"m": 0.5}, pieces=8)
    assert "ReusedExchange" in plan(plain, run=True) and "ReusedExchange" in plan(long, run=True)


def test_row_windows_are_cut_into_pieces(spark):
    events = read_table(spark, FOLDER, "events").select("event_id", "event_type", "value")
    text = plan(summaries.cumulative(events, ["event_type"], "value", ["event_id"], "value", pieces=8))
    exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert any("_piece" in line for line in exchanges)
    assert "Exchange SinglePartition" not in text


def test_thresholds_need_no_sort_and_one_shuffle_of_points(spark):
    cells = draws(spark, FOLDER)
    text = plan(D.crossing_points(cells))
    after = text[: text.index("Expand") if "Expand" in text else None]
    assert "Window" not in text and text.count("Exchange") == plan(cells).count("Exchange") + 1
    assert "Sort " not in after


def test_scans_read_only_what_is_needed(spark):
    found = correlation.pair_grid(samples(spark, FOLDER), ["grab", "passive"])
    text = plan(found)
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in text
    filtered = plan(all_queries()["row_filters"](spark, FOLDER))
    assert "In(event_type" in filtered.split("PushedFilters: ")[1] and "props" not in filtered


def test_groups_of_moderate_size_get_a_plain_window(spark):
    events = read_table(spark, FOLDER, "events").select("event_id", "user_id", "value")
    text = plan(summaries.cumulative(events, ["user_id"], "value", ["event_id"], "value", pieces=8))
    assert text.count("Exchange hashpartitioning") == 1 and "_piece" not in text and "Union" not in text


def test_top_rows_are_not_shuffled(spark):
    lines = read_table(spark, FOLDER, "lineitem").select("l_suppkey", "l_quantity")
    text = plan(summaries.top_with_ties(lines, ["l_suppkey"], "l_quantity", 5))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_zscores_compute_their_constants_once(spark):
    text = plan(all_queries()["zscores"](spark, FOLDER), run=True)
    assert len(set(re.findall(r"Subquery subquery#(\d+)", text))) == 1


@pytest.mark.parametrize("name", ["holdout_forest", "imputation_quantiles"])
def test_completed_tables_are_joined_once(spark, name):
    text = plan(all_queries()[name](spark, FOLDER))
    assert "Join" not in text and "FileScan" not in text
