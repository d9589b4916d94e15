"""Physical plans: no cross products, no Python workers, pruned scans."""

import pytest

import __spark_entry__ as entry_points
from finloom.operators.summary import line_totals, variance_one_pass
from finloom.operators.summary_store import merged
from finloom.session import materialise
from finloom.sources.planning_tables import planning_tables

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["budget_summary", "budget_variance", "consolidate_budget", "allocate_costs", "recon_status", "join_ic_detail", "import_errors",
     "rolling_forecast", "active_budget", "hierarchy_rollup"],
)
def test_no_cross_products(spark, name):
    text = plan(entry_points.queries()[name](spark, FOLDER))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert node not in text


def test_variance_reads_two_budgets_in_one_scan(spark):
    lines = planning_tables(spark, FOLDER).budget_line_item
    text = plan(variance_one_pass(lines, 1, 2))
    assert text.count("FileScan parquet") == 1
    assert "PartitionFilters: [" in text and "header_id" in text.split("PartitionFilters: [")[1].split("]")[0]
    schema = text.split("ReadSchema: ")[1].split("\n")[0]
    assert "original_amount" not in schema and "final_amount" in schema


def test_summary_groups_ids_only(spark):
    text = plan(entry_points.queries()["budget_summary"](spark, FOLDER))
    grouping = text.split("HashAggregate(keys=[")[1].split("]")[0]
    assert "account_name" not in grouping and "budget_code" not in grouping


def test_staging_orders_only_what_it_needs(spark):
    tables = planning_tables(spark, FOLDER)
    text = tables._import_staging()._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [" in text
    for column in ("l_discount", "l_tax", "l_returnflag", "l_linestatus", "p_name"):
        assert column not in text.split("Relation ")[0]
    stored = plan(tables.import_staging.select("cost_center_code"))
    assert "Sort" not in stored and "Window" not in stored.split("BroadcastExchange")[0]


def test_error_lists_need_no_lambda(spark):
    for name in ("import_errors", "import_error_summary", "string_agg_ordered", "rejected_sample"):
        assert "lambda" not in entry_points.queries()[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()


def test_changed_lines_meet_stored_totals_in_one_shuffle(spark):
    lines = planning_tables(spark, FOLDER).budget_line_item
    totals = materialise(line_totals(lines), "totals")
    changed = lines.filter("header_id = 2")
    assert plan(merged(totals, changed, changed)).count("Exchange hashpartitioning") == 1
