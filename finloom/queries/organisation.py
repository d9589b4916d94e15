"""Hierarchy, as-of reads, model columns and declared rules."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from finloom.functions.columns import effective_on, entity_of, with_header_columns, with_journal_line_columns, with_model_columns
from finloom.functions.ordering import lay_out, with_dense_index
from finloom.operators import quality
from finloom.operators.hierarchy import explode_hierarchy, hierarchy_path, hierarchy_rollup, processing_order
from finloom.queries.registry import query
from finloom.sources.tables import cost_centers_as_of

AS_OF = dt.date(2001, 6, 30)


@query(
    "model_columns",
    """select line_id, final_amount,
              sha256(concat_ws('|', gl_account_id, cost_center_id, fiscal_period_id, cast(final_amount as varchar))) as row_hash
         from budget_line_item""",
)
def model_columns(t):
    return with_model_columns(t.budget_line_item.drop("final_amount")).select("line_id", "final_amount", "row_hash")


@query(
    "model_columns_journal",
    """select l.journal_id, count(*) as line_count, sum(l.debit_amount - l.credit_amount)::decimal(38,4) as net_amount,
              sum(l.debit_amount) = sum(l.credit_amount) as is_balanced from journal_line l group by 1""",
)
def model_columns_journal(t):
    net = with_journal_line_columns(t.journal_line)
    return net.groupBy("journal_id").agg(
        F.count("*").alias("line_count"),
        F.sum("net_amount").cast("decimal(38,4)").alias("net_amount"),
        (F.sum("debit_amount") == F.sum("credit_amount")).alias("is_balanced"),
    )


@query("model_columns_header", "select header_id, status_code = 'LOCKED' as is_locked from budget_header")
def model_columns_header(t):
    return with_header_columns(t.budget_header).select("header_id", "is_locked")


@query(
    "validate_model",
    """
    select 'journal_line' as table_name, 'DEBIT_CREDIT' as rule, concat(journal_id, '|', line_number) as row_key, 1::bigint as violations
      from journal_line where debit_amount < 0 or credit_amount < 0 or (debit_amount > 0 and credit_amount > 0)
    union all
    select 'journal_line', 'PRIMARY_KEY', concat(journal_id, '|', line_number), count(*) from journal_line
     group by journal_id, line_number having count(*) > 1
    union all
    select 'allocation_rule', 'FK_DEPENDS_ON', cast(r.depends_on as varchar), count(*) from allocation_rule r
     where r.depends_on is not null and r.depends_on not in (select rule_id from allocation_rule) group by r.depends_on
    union all
    select 'journal', 'FK_FISCAL_PERIOD_ID', cast(j.fiscal_period_id as varchar), count(*) from journal j
     where j.fiscal_period_id not in (select fiscal_period_id from fiscal_period) group by j.fiscal_period_id
    union all
    select 'budget_line_item', 'FK_COST_CENTER_ID', cast(l.cost_center_id as varchar), count(*) from budget_line_item l
     where l.cost_center_id not in (select cost_center_id from cost_center) group by l.cost_center_id
    """,
)
def validate_model(t):
    return quality.validate_model(
        {
            "fiscal_period": t.fiscal_period,
            "cost_center": t.cost_center,
            "gl_account": t.gl_account,
            "budget_header": t.budget_header,
            "budget_line_item": t.budget_line_item,
            "allocation_rule": t.allocation_rule,
            "journal": t.journal,
            "journal_line": t.journal_line,
        }
    )


@query("entity_of", "select cost_center_id, split_part(code, '-', 1) as entity from cost_center")
def entity_of_centre(t):
    return t.cost_center.select("cost_center_id", entity_of(F.col("code")).alias("entity"))


@query(
    "distinct",
    """select distinct split_part(c.code, '-', 1) as entity from budget_line_item l
         join cost_center c on l.cost_center_id = c.cost_center_id where l.header_id = 1""",
)
def distinct_entities(t):
    from finloom.operators.reconcile import entities_of_budget

    budget = t.lines_of(1)
    return entities_of_budget(budget, t.cost_center).select(F.col("entity_code").alias("entity"))


@query(
    "effective_filter",
    """select cost_center_id, code from cost_center where is_active and effective_from <= date '2001-06-30'
          and (effective_to is null or effective_to >= date '2001-06-30')""",
)
def effective_filter(t):
    return t.cost_center.filter(F.col("is_active") & effective_on(AS_OF)).select("cost_center_id", "code")


@query(
    "src_asof",
    """select cost_center_id, code, name, weight from cost_center_history
        where valid_from <= timestamp '1998-06-30' and timestamp '1998-06-30' < valid_to and is_active""",
)
def src_asof(t):
    at = dt.datetime(1998, 6, 30)
    return cost_centers_as_of(t.cost_center_history, at).select("cost_center_id", "code", "name", "weight")


_EXPLODED = """
 select h.cost_center_id, h.code, h.level, h.path, h.sort_path,
        not exists (select 1 from cost_center c where c.parent_id = h.cost_center_id and c.is_active) as is_leaf,
        (select count(*) from hierarchy c where c.parent_id = h.cost_center_id)::int as child_count, h.cumulative_weight
   from hierarchy h
"""


def exploded(t, **options):
    return explode_hierarchy(t.cost_center, AS_OF, **options)


@query("explode_hierarchy", _EXPLODED)
def explode_all(t):
    return exploded(t).select(
        "cost_center_id", "code", "level", "path", "sort_path", "is_leaf", "child_count", "cumulative_weight"
    )


@query(
    "explode_hierarchy_root",
    """
    with recursive h as (
      select cost_center_id, parent_id, 0 as level, cast(weight as decimal(18,10)) as cumulative_weight from cost_center where cost_center_id = 11
      union all
      select c.cost_center_id, c.parent_id, h.level + 1, cast(h.cumulative_weight * c.weight as decimal(18,10))
        from cost_center c join h on c.parent_id = h.cost_center_id where h.level < 1)
    select cost_center_id, level, cumulative_weight from h
    """.replace("with recursive h as", "select * from (with recursive h as").rstrip()
    + ") x",
)
def explode_from_region(t):
    """One region, one level down, inactive centres included."""
    nodes = explode_hierarchy(t.cost_center, AS_OF, root=11, max_depth=1, include_inactive=True)
    return nodes.select("cost_center_id", "level", "cumulative_weight")


@query(
    "hierarchy_path",
    """
    select * from (with recursive h as (
      select cost_center_id, name as path from cost_center where parent_id is null
      union all select c.cost_center_id, concat(h.path, ' / ', c.name) from cost_center c join h on c.parent_id = h.cost_center_id)
    select * from h) x
    """,
)
def paths(t):
    return hierarchy_path(t.cost_center, " / ")


@query(
    "join_recursive",
    """select h.cost_center_id, unnest(h.path_ids) as ancestor_id from hierarchy h""",
)
def ancestor_closure(t):
    return exploded(t).select("cost_center_id", F.explode("path_ids").alias("ancestor_id"))


@query(
    "hierarchy_rollup",
    """
    select h.cost_center_id, h.level, coalesce(o.s, 0)::decimal(38,4) as own_amount, coalesce(r.s, 0)::decimal(38,4) as subtotal_amount
      from hierarchy h
      left join (select cost_center_id, sum(final_amount) as s from budget_line_item where header_id = 1 group by 1) o
        on h.cost_center_id = o.cost_center_id
      left join (select a.ancestor_id, sum(l.final_amount) as s
                   from (select cost_center_id, unnest(path_ids) as ancestor_id from hierarchy) a
                   join budget_line_item l on l.cost_center_id = a.cost_center_id and l.header_id = 1 group by 1) r
        on h.cost_center_id = r.ancestor_id
    """,
)
def rollup(t):
    budget = t.lines_of(1)
    return hierarchy_rollup(budget, exploded(t)).drop("parent_id")


@query(
    "w_process_order",
    "select cost_center_id, level, row_number() over (order by level desc, cost_center_id) as processing_order from hierarchy",
)
def process_order(t):
    nodes = exploded(t).select("cost_center_id", "level")
    return with_dense_index(lay_out(nodes, processing_order(nodes)), "processing_order").select(
        "cost_center_id", "level", "processing_order"
    )


@query(
    "scalar_sub",
    """select h.cost_center_id, (select count(*) from hierarchy c where c.parent_id = h.cost_center_id)::int as child_count
         from hierarchy h""",
)
def child_counts(t):
    return exploded(t).select("cost_center_id", "child_count")


