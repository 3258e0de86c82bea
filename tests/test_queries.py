"""Every registered query against its SQL text, on the smallest tables."""

import re

import pytest
from pyspark.sql import DataFrameWriter

import __spark_entry__ as entry_module
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() >= 0


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.fixture
def plans_of(spark, monkeypatch):
    """Physical plans of a query: of every table it writes on the way, and of its result."""
    seen = []
    write = DataFrameWriter.parquet

    def recorded(self, path, *args, **options):
        seen.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", recorded)

    def run(name):
        seen.clear()
        last = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        return [*seen, last]

    return run


@pytest.mark.parametrize("name", [
    "match_town", "match_closest", "match_closest_words", "match_closest_all_words", "match_unique_edit1", "match_method_compare", "weekly_report", "win_share",
    "win_batch_id", "join_spatial_intersects", "sp_clip", "sp_dissolve", "trend_interval", "ww_prepare",
])
def test_plans_have_no_cross_join(plans_of, name):
    for plan in plans_of(name):
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", [
    "fn_address", "fn_town_rules", "fn_race_eth", "agg_median_sd", "ww_prepare", "win_share", "win_batch_id", "join_spatial_intersects",
    "sp_clip", "match_unique_edit1",
])
def test_plans_stay_in_the_jvm(plans_of, name):
    for plan in plans_of(name):
        assert not re.search("Python|Pandas|MapInArrow", plan)


def test_numbering_writes_no_input_rows(plans_of):
    assert len(plans_of("win_batch_id")) == 1


def test_candidates_of_a_trend_ship_no_arrays(plans_of):
    fits = [p for p in plans_of("trend_derivative_ci") if "FlatMapGroupsInPandas" in p]
    assert any("resid_sd" in p and "covariance" not in p for p in fits)


def test_scan_reads_only_the_needed_columns(spark):
    plan = QUERIES["agg_count"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", plan)) == {"user_id:bigint,event_type:string"}


def test_filters_reach_the_scan(spark):
    plan = QUERIES["flt_predicates"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "PushedFilters: []" not in plan


def test_first_row_is_cut_before_the_shuffle(spark):
    plan = QUERIES["win_first_row"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


@pytest.mark.parametrize("name", ["win_group_mean", "win_share", "agg_median_sd", "agg_freq_pct", "win_batch_id"])
def test_no_window_over_everything(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange SinglePartition" not in plan.replace("ENSURE_REQUIREMENTS, [plan_id", "") or "Window" not in plan
