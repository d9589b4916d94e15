"""Period close."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from finloom.plans import close
from finloom.plans.documents import items_of
from finloom.plans.reports import close_document, close_steps
from finloom.queries.allocation import ELIGIBLE, SOURCES
from finloom.queries.registry import query

PERIOD = 68  # August 2000, open like the months before it
RUN_TS = dt.datetime(2001, 6, 30)


@query(
    "close_validations",
    f"""
    select 'PRIOR_OPEN' as code, 'Prior periods must be closed before FINAL close' as message, 'ERROR' as severity, true as blocks_close
      where exists (select 1 from fiscal_period p, (select * from fiscal_period where fiscal_period_id = {PERIOD}) q
                     where p.fiscal_year = q.fiscal_year and p.fiscal_month < q.fiscal_month and not p.is_closed and not p.is_adjustment)
    union all
    select 'PENDING_JOURNALS', concat(count(*), ' pending journal(s) must be posted or rejected'), 'ERROR', true
      from journal where fiscal_period_id = {PERIOD} and status_code in ('DRAFT', 'SUBMITTED') having count(*) > 0
    """,
)
def close_validations(t):
    return close.close_validations(t.fiscal_period, t.journal, PERIOD, "FINAL")


@query(
    "active_budget",
    f"""select header_id, budget_code from budget_header where status_code in ('APPROVED', 'LOCKED')
           and {PERIOD} between start_period_id and end_period_id order by version_number desc, header_id limit 1""",
)
def active_budget(t):
    return close.active_budget(t.budget_header, t.fiscal_period, PERIOD).select("header_id", "budget_code")


@query(
    "lock_period",
    f"""
    select 'period' as kind, fiscal_period_id as id, cast(is_closed or fiscal_period_id = {PERIOD} as varchar) as state from fiscal_period
    union all
    select 'header', header_id, case when status_code = 'APPROVED' and {PERIOD} between start_period_id and end_period_id then 'LOCKED'
                                     else status_code end from budget_header
    """,
)
def lock_period(t):
    periods, headers = close.lock_period(t.fiscal_period, t.budget_header, PERIOD, RUN_TS)
    closed = periods.select(F.lit("period").alias("kind"), F.col("fiscal_period_id").alias("id"), F.col("is_closed").cast("string").alias("state"))
    locked = headers.select(F.lit("header").alias("kind"), F.col("header_id").alias("id"), F.col("status_code").alias("state"))
    return closed.unionByName(locked)


def _close(t, close_type="SOFT"):
    return close.close_period(
        t.budget_line_item, t.budget_header, t.gl_account, t.cost_center, t.cost_center_history, t.fiscal_period,
        t.allocation_rule, t.journal, PERIOD, "close-1", RUN_TS, close_type,
    )


_SOURCES = SOURCES.replace(
    "l.header_id = 1", f"l.header_id = 2 and l.fiscal_period_id = {PERIOD} and l.cost_center_id in (select cost_center_id from hierarchy)"
)
_STEPS = f"""
 with productive as materialized (select distinct s.rule_id from ({_SOURCES}) s join rule_target v on s.rule_id = v.rule_id and v.target_is_active)
 select 1 as step_number, 'Period Validation' as step_name, 'COMPLETED' as status,
        (select count(*) from (select 1 from journal where fiscal_period_id = {PERIOD} and status_code in ('DRAFT', 'SUBMITTED') having count(*) > 0) f) as rows_affected
 union all select 2, 'Create Snapshot', 'COMPLETED',
        (select count(*) from cost_center_history where valid_from <= timestamp '2001-06-30' and timestamp '2001-06-30' < valid_to and is_active)
 union all select 3, 'Budget Consolidation', 'COMPLETED',
        (select count(*) from budget_line_item where header_id = 2 and final_amount <> 0 and cost_center_id in (select cost_center_id from hierarchy))
 union all select 4, 'Cost Allocations', 'COMPLETED',
        (select count(*) from ({_SOURCES}) s join rule_target v on s.rule_id = v.rule_id and v.target_is_active
          where s.rule_id in (select rule_id from ({ELIGIBLE}) e))
 union all select 5, 'Intercompany Reconciliation', 'COMPLETED', 0
 union all select 6, 'Lock Period', 'COMPLETED',
        1 + (select count(*) from budget_header where status_code = 'APPROVED' and {PERIOD} between start_period_id and end_period_id)
"""


@query("close_period", f"select * from ({_STEPS}) q", inline=True)
def close_period(t):
    """Steps of a soft close with the active budget of the period."""
    return close_steps(t.spark, _close(t)).drop("message")


@query(
    "nested_report_close",
    f"""
    select * from (with steps as materialized ({_STEPS})
    select 'Step' as section, cast(step_number as varchar) as key, concat_ws('|', step_name, status, rows_affected) as value from steps
    union all
    select 'ValidationError', 'PENDING_JOURNALS', concat('WARNING|', count(*), ' pending journal(s) must be posted or rejected') from journal
     where fiscal_period_id = {PERIOD} and status_code in ('DRAFT', 'SUBMITTED') having count(*) > 0
    union all
    select 'Metrics', u.key, u.value from
      (select count(*) filter (status = 'COMPLETED') as done, count(*) filter (status = 'FAILED') as failed, count(*) filter (status = 'WARNING') as warned,
              sum(rows_affected) as n from steps) c,
      lateral (select * from (values ('CompletedSteps', cast(done as varchar)), ('FailedSteps', cast(failed as varchar)), ('WarningSteps', cast(warned as varchar)),
                                     ('TotalRowsProcessed', cast(n as varchar)), ('ConsolidatedBudgetID', '1000'), ('UnreconciledItems', '0'), ('TotalVariance', '0.0000')) v(key, value)) u) x
    """,
    inline=True,
)
def nested_report_close(t):
    """The whole XML report of a soft close, parsed back: findings, steps, metrics."""
    pieces = close_document(t.spark, _close(t), "close-1", PERIOD, "SOFT")
    steps = items_of(pieces, "Step", "_Sequence int, _Name string, _Status string, RowsAffected long")
    steps = steps.select(F.lit("Step").alias("section"), F.col("_Sequence").cast("string").alias("key"), F.concat_ws("|", "_Name", "_Status", F.col("RowsAffected").cast("string")).alias("value"))
    found = items_of(pieces, "ValidationError", "_Code string, _Severity string, Message string")
    found = found.select(F.lit("ValidationError").alias("section"), F.col("_Code").alias("key"), F.concat_ws("|", "_Severity", "Message").alias("value"))
    names = ["CompletedSteps", "FailedSteps", "WarningSteps", "TotalRowsProcessed", "ConsolidatedBudgetID", "UnreconciledItems", "TotalVariance"]
    metrics = items_of(pieces, "Metrics", ", ".join(f"{n} string" for n in names))
    metrics = metrics.select(F.lit("Metrics").alias("section"), F.inline(F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).alias("value")) for n in names])))
    return steps.unionByName(found).unionByName(metrics)
