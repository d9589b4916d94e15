"""Summary, variance and consolidation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from finloom.operators import summary, summary_store
from finloom.operators.consolidate import apply_eliminations, consolidate, elimination_pairs, final_amounts
from finloom.operators.sinks import append_lines, insert_ignore, new_lines
from finloom.plans.consolidation import consolidate_budget
from finloom.queries.organisation import AS_OF, exploded
from finloom.queries.registry import query
from finloom.schemas import LINE_KEY, NATURAL_KEY
from finloom.session import new_folder

_STAR = """
 from budget_line_item l join budget_header h on l.header_id = h.header_id join gl_account a on l.gl_account_id = a.gl_account_id
      join cost_center c on l.cost_center_id = c.cost_center_id join fiscal_period p on l.fiscal_period_id = p.fiscal_period_id
"""

_SUMMARY = f"""
 select l.header_id, h.budget_code, h.budget_name, h.budget_type, h.scenario_type, h.fiscal_year, l.fiscal_period_id,
        p.fiscal_quarter, p.fiscal_month, p.period_name, l.gl_account_id, a.account_number, a.account_name, a.account_type,
        l.cost_center_id, c.code as cost_center_code, c.name as cost_center_name, c.parent_id as parent_cost_center_id,
        sum(l.original_amount)::decimal(38,4) as total_original_amount,
        sum(l.adjusted_amount)::decimal(38,4) as total_adjusted_amount,
        sum(l.original_amount + l.adjusted_amount)::decimal(38,4) as total_final_amount,
        sum(coalesce(l.local_currency_amount, 0))::decimal(38,4) as total_local_currency,
        sum(coalesce(l.reporting_currency_amount, 0))::decimal(38,4) as total_reporting_currency,
        count(*) as line_item_count
 {_STAR} group by all
"""


@query(
    "join_star",
    f"""select l.line_id, h.budget_code, a.account_number, c.code as cost_center_code, p.period_name, l.final_amount {_STAR}""",
)
def star(t):
    joined = summary.join_star(t.budget_line_item, t.budget_header, t.gl_account, t.cost_center, t.fiscal_period)
    return joined.select("line_id", "budget_code", "account_number", "cost_center_code", "period_name", "final_amount")


def _summary(t):
    return summary.budget_summary(t.budget_line_item, t.budget_header, t.gl_account, t.cost_center, t.fiscal_period)


@query("budget_summary", _SUMMARY)
def budget_summary(t):
    return _summary(t)


def _served(t, path, version=None):
    totals = summary_store.stored_totals(t.spark, path, version)
    return summary.with_attributes(totals, t.budget_header, t.gl_account, t.cost_center, t.fiscal_period)


@query("summary_mv", _SUMMARY)
def summary_mv(t):
    """Stored summary of an earlier state of the lines, brought up to date by the lines changed since.

    Before, budget 1 lacked its lines of 1997 and every amount of budget 2 was a cent lower.
    """
    path = new_folder(t.spark, "summary-mv")
    lines = t.budget_line_item
    was_new = (F.col("header_id") == 1) & F.col("fiscal_period_id").between(25, 36)
    earlier = lines.filter("header_id = 2").withColumn("original_amount", (F.col("original_amount") - F.lit("0.01").cast("decimal(19,4)")).cast("decimal(19,4)"))
    summary_store.build(lines.filter((F.col("header_id") != 2) & ~was_new).unionByName(earlier), path)
    summary_store.apply_changes(t.spark, path, added=lines.filter(was_new))
    summary_store.apply_changes(t.spark, path, removed=earlier, added=lines.filter("header_id = 2"))
    return _served(t, path)


@query("summary_mv_removed", f"select * from ({_SUMMARY}) s where header_id <> 2")
def summary_mv_removed(t):
    """Stored summary after one budget lost all its lines."""
    path = new_folder(t.spark, "summary-mv")
    summary_store.build(t.budget_line_item, path)
    summary_store.apply_changes(t.spark, path, removed=t.budget_line_item.filter("header_id = 2"))
    return _served(t, path)


@query("summary_mv_version", _SUMMARY)
def summary_mv_version(t):
    """The first version, read after a later one was written and while a third one has data but no manifest."""
    path = new_folder(t.spark, "summary-mv")
    summary_store.build(t.budget_line_item, path)
    first = _served(t, path)
    summary_store.apply_changes(t.spark, path, removed=t.budget_line_item.filter("header_id <> 3"))
    summary_store.write_data(summary.line_totals(t.budget_line_item), path, 3)
    return first


_SIDES = """
 select coalesce(b.gl_account_id, c.gl_account_id) as gl_account_id, coalesce(b.cost_center_id, c.cost_center_id) as cost_center_id,
        coalesce(b.fiscal_period_id, c.fiscal_period_id) as fiscal_period_id,
        coalesce(b.amount, 0)::decimal(38,4) as budget_amount, coalesce(c.amount, 0)::decimal(38,4) as comparison_amount
   from (select gl_account_id, cost_center_id, fiscal_period_id, sum(final_amount) as amount from budget_line_item
          where header_id = 1 group by 1, 2, 3) b
   full join (select gl_account_id, cost_center_id, fiscal_period_id, sum(final_amount) as amount from budget_line_item
          where header_id = 2 group by 1, 2, 3) c
     on b.gl_account_id = c.gl_account_id and b.cost_center_id = c.cost_center_id and b.fiscal_period_id = c.fiscal_period_id
"""

_VARIANCE = f"""
 select *, case when variance_amount > 0 then 'FAVORABLE' when variance_amount < 0 then 'UNFAVORABLE' else 'ON_TARGET' end as variance_status,
        case when abs(pct) > {{threshold}} then 1 else 0 end as exceeds_threshold
   from (select *, (comparison_amount - budget_amount)::decimal(38,4) as variance_amount,
                case when budget_amount <> 0 then cast(comparison_amount - budget_amount as double) / cast(budget_amount as double) * 100 end as pct
           from ({_SIDES}) s) v
"""


def _variance(threshold: str) -> str:
    return _VARIANCE.format(threshold=threshold)


_KEYS = "gl_account_id, cost_center_id, fiscal_period_id"


@query(
    "join_full_variance",
    f"""select {_KEYS}, budget_amount, comparison_amount, variance_amount, round(pct, 6) as variance_pct, variance_status,
               exceeds_threshold from ({_variance('100')}) q""",
)
def join_full_variance(t):
    result = summary.variance_full_join(t.budget_line_item, 1, 2)
    return result.withColumn("variance_pct", F.round("variance_pct", 6))


@query(
    "budget_variance",
    f"""select q.gl_account_id, q.cost_center_id, q.fiscal_period_id, a.account_number, a.account_type, c.code as cost_center_code,
               p.fiscal_year, p.fiscal_month, p.period_name, q.budget_amount, q.comparison_amount, q.variance_amount,
               round(q.pct, 6) as variance_pct, q.variance_status, q.exceeds_threshold
          from ({_variance('100')}) q join gl_account a on q.gl_account_id = a.gl_account_id
               join cost_center c on q.cost_center_id = c.cost_center_id join fiscal_period p on q.fiscal_period_id = p.fiscal_period_id""",
)
def budget_variance(t):
    result = summary.budget_variance(t.budget_line_item, t.gl_account, t.cost_center, t.fiscal_period, 1, 2)
    return result.withColumn("variance_pct", F.round("variance_pct", 6)).drop("account_name", "cost_center_name")


@query(
    "optional_filters",
    f"""select q.gl_account_id, q.cost_center_id, q.fiscal_period_id, q.variance_amount, q.exceeds_threshold
          from ({_variance('50')}) q join gl_account a on q.gl_account_id = a.gl_account_id
               join fiscal_period p on q.fiscal_period_id = p.fiscal_period_id
         where p.fiscal_year = 1998 and a.account_type = 'X'""",
)
def optional_filters(t):
    result = summary.budget_variance(
        t.budget_line_item, t.gl_account, t.cost_center, t.fiscal_period, 1, 2, fiscal_year=1998, account_type="X", threshold_pct=50
    )
    return result.select("gl_account_id", "cost_center_id", "fiscal_period_id", "variance_amount", "exceeds_threshold")


@query(
    "classify",
    f"""select variance_status, exceeds_threshold, count(*) as n, sum(variance_amount)::decimal(38,4) as variance_amount
          from ({_variance('100')}) q group by 1, 2""",
)
def classify(t):
    return (
        summary.variance_one_pass(t.budget_line_item, 1, 2)
        .groupBy("variance_status", "exceeds_threshold")
        .agg(F.count("*").alias("n"), F.sum("variance_amount").cast("decimal(38,4)").alias("variance_amount"))
    )


_CONSOLIDATED = """
 select gl_account_id, cost_center_id, fiscal_period_id, sum(final_amount)::decimal(38,4) as consolidated_amount, count(*) as source_count
   from budget_line_item where header_id = 1 and cost_center_id in (select cost_center_id from hierarchy) group by 1, 2, 3
"""

_PAIRS = """
 select * from (
   select *, row_number() over (partition by abs(final_amount), island order by i) as pos from (
     select *, i - row_number() over (partition by abs(final_amount) order by i) as island from (
       select l.line_id as first_line_id, l.gl_account_id as first_gl, l.cost_center_id as first_cc, l.fiscal_period_id as first_period,
              l.final_amount, row_number() over o as i, lead(l.line_id) over o as second_line_id, lead(l.gl_account_id) over o as second_gl,
              lead(l.cost_center_id) over o as second_cc, lead(l.fiscal_period_id) over o as second_period,
              lead(l.final_amount) over o as next_amount
         from budget_line_item l join gl_account a on l.gl_account_id = a.gl_account_id
        where l.header_id = 1 and a.intercompany_flag
       window o as ({partition} order by l.gl_account_id, l.cost_center_id, l.fiscal_period_id, l.line_id)) w
      where final_amount <> 0 and next_amount = -final_amount) k) p
  where pos % 2 = 1
"""
_PAIRS_REFERENCE = _PAIRS.format(partition="")
# the dense index restarts per account, so accounts must not share islands
_PAIRS_CORRECTED = (
    _PAIRS.format(partition="partition by l.gl_account_id")
    .replace("partition by abs(final_amount), island", "partition by first_gl, abs(final_amount), island")
    .replace("row_number() over (partition by abs(final_amount) order by i) as island", "row_number() over (partition by first_gl, abs(final_amount) order by i) as island")
)


def _pairs(t, mode):
    return elimination_pairs(t.lines_of(1), t.gl_account, mode)


@query("eliminate_intercompany", f"select first_line_id, second_line_id, final_amount as amount from ({_PAIRS_CORRECTED}) p")
def eliminate(t):
    return _pairs(t, "corrected").select("first_line_id", "second_line_id", "amount")


@query("w_adjacent_pairs", f"select first_line_id, second_line_id, final_amount as amount from ({_PAIRS_REFERENCE}) p")
def adjacent_pairs(t):
    return _pairs(t, "reference").select("first_line_id", "second_line_id", "amount")


@query("consolidate", _CONSOLIDATED)
def consolidated(t):
    return consolidate(t.lines_of(1), exploded(t))


@query(
    "eliminate_intercompany_reference",
    f"""select c.gl_account_id, c.cost_center_id, c.fiscal_period_id, c.consolidated_amount,
               coalesce(e.amount, 0)::decimal(38,4) as elimination_amount,
               (c.consolidated_amount - coalesce(e.amount, 0))::decimal(38,4) as final_amount
          from ({_CONSOLIDATED}) c
          left join (select second_gl, second_cc, sum(final_amount) as amount from ({_PAIRS_REFERENCE}) p group by 1, 2) e
            on c.gl_account_id = e.second_gl and c.cost_center_id = e.second_cc
         where c.consolidated_amount <> 0 or coalesce(e.amount, 0) <> 0""",
)
def eliminate_reference(t):
    budget = t.lines_of(1)
    amounts = apply_eliminations(consolidate(budget, exploded(t)), _pairs(t, "reference"), "reference")
    return final_amounts(amounts).drop("source_count")


@query(
    "consolidate_budget",
    f"""select 900 as header_id, c.gl_account_id, c.cost_center_id, c.fiscal_period_id,
               (c.consolidated_amount - coalesce(e.amount, 0))::decimal(19,4) as original_amount, 'CONSOLIDATED' as spread_method,
               'run-1' as source_reference
          from ({_CONSOLIDATED}) c
          left join (select gl, cc, period, sum(amount) as amount from (
                       select first_gl as gl, first_cc as cc, first_period as period, final_amount as amount from ({_PAIRS_CORRECTED}) p
                       union all select second_gl, second_cc, second_period, -final_amount from ({_PAIRS_CORRECTED}) p) s group by 1, 2, 3) e
            on c.gl_account_id = e.gl and c.cost_center_id = e.cc and c.fiscal_period_id = e.period
         where c.consolidated_amount <> 0 or coalesce(e.amount, 0) <> 0""",
)
def consolidate_all(t):
    run = consolidate_budget(
        t.budget_line_item, t.budget_header, t.gl_account, t.cost_center, 1, 900, AS_OF, "run-1", dt.datetime(2001, 6, 30)
    )
    return run.lines.select(
        "header_id", "gl_account_id", "cost_center_id", "fiscal_period_id", "original_amount", "spread_method", "source_reference"
    )


@query(
    "sink_results",
    f"""select (select max(line_id) from budget_line_item) + row_number() over (order by gl_account_id, cost_center_id, fiscal_period_id) as line_id,
               900 as header_id, gl_account_id, cost_center_id, fiscal_period_id, consolidated_amount::decimal(19,4) as original_amount,
               0::decimal(19,4) as adjusted_amount, 'CONSOLIDATION_PROC' as source_system, false as is_allocated
          from ({_CONSOLIDATED}) c where consolidated_amount <> 0""",
)
def sink_results(t):
    """Consolidated lines without eliminations, appended with their ids to the stored table twice; the second append finds them there."""
    run = consolidate_budget(
        t.budget_line_item, t.budget_header, t.gl_account, t.cost_center, 1, 900, AS_OF, "run-1", dt.datetime(2001, 6, 30),
        include_eliminations=False,
    )
    path, schema = new_folder(t.spark, "results"), t.budget_line_item.schema
    append_lines(t.budget_line_item, path)
    candidates = run.lines.withColumn("_order", F.struct(*LINE_KEY))
    for _ in range(2):
        stored = t.spark.read.schema(schema).parquet(path)
        append_lines(new_lines(insert_ignore(candidates, stored, "_order"), stored, LINE_KEY), path)
    after = t.spark.read.schema(schema).parquet(path).filter("header_id = 900")
    return after.select("line_id", *NATURAL_KEY, "original_amount", "adjusted_amount", "source_system", "is_allocated")
