"""Allocation rules, factors and results."""

from __future__ import annotations

from pyspark.sql import functions as F

from finloom.operators import allocate
from finloom.operators.hierarchy import rule_closure
from finloom.queries.organisation import AS_OF
from finloom.queries.registry import query
from finloom.schemas import LINE_KEY
from finloom.sources.documents import rule_targets


def _budget(t):
    return t.lines_of(1)


@query(
    "src_xml_targets",
    "select rule_id, priority, target_id, target_code, target_pct, account_filter, exclude_pattern, has_conditions from rule_spec",
)
def src_xml_targets(t):
    return rule_targets(t.allocation_rule).select(
        "rule_id", "priority", "target_id", "target_code", "target_pct", "account_filter", "exclude_pattern", "has_conditions"
    )


@query(
    "join_or_target",
    "select rule_id, priority, target_id, target_code, joined_id, target_name, target_parent_id, target_is_active from rule_target",
)
def join_or_target(t):
    joined = allocate.target_centres(rule_targets(t.allocation_rule), t.cost_center)
    return joined.select(
        "rule_id", "priority", "target_id", "target_code", "joined_id", "target_name", "target_parent_id", "target_is_active"
    )


@query(
    "pattern_filter",
    """select r.rule_id, a.gl_account_id from allocation_rule r join gl_account a on a.account_number like r.account_pattern escape '\\'""",
)
def pattern_filter(t):
    rules = t.allocation_rule.filter(F.col("account_pattern").isNotNull())
    return allocate.pattern_matches(rules, "account_pattern", t.gl_account, "gl_account_id", "account_number")


@query(
    "pattern_filter_sets",
    """
    select r.cost_center_id as rule_id, c.cost_center_id from cost_center r join cost_center c on case
      when r.cost_center_id > 1000 then c.code like concat('%S', r.cost_center_id - 1000)
      when r.cost_center_id > 100 then regexp_full_match(c.code, concat('R[', substr(r.code, 2, 1), '-4]', substr(r.code, 3), '-S.*[^02468]'))
      when r.cost_center_id > 10 then regexp_full_match(c.code, '[^A]..*[0-2]') else true end
    """,
)
def pattern_filter_sets(t):
    """Centres matched by patterns made of every centre's code: a leading wildcard per supplier, sets per nation, no literal per region, null for the root."""
    rule, code = F.col("cost_center_id"), F.col("code")
    at_nation = F.concat(F.lit("R["), code.substr(2, 1), F.lit("-4]"), F.expr("substr(code, 3)"), F.lit("-S%[^02468]"))
    pattern = (
        F.when(rule > 1000, F.concat(F.lit("%S"), (rule - 1000).cast("string")))
        .when(rule > 100, at_nation)
        .when(rule > 10, F.lit("[^A]_%[0-2]"))
    )
    rules = t.cost_center.select(rule.alias("rule_id"), pattern.alias("pattern"))
    return allocate.pattern_matches(rules, "pattern", t.cost_center, "cost_center_id", "code")


@query(
    "rule_closure",
    """
    select rule_id, depends_on, max(level)::int as level from (
      with recursive d as (
        select rule_id, depends_on, 1 as level, [rule_id, depends_on] as path from allocation_rule
         where is_active and depends_on is not null and effective_from <= date '2001-06-30'
           and (effective_to is null or effective_to >= date '2001-06-30')
        union all
        select d.rule_id, r.depends_on, d.level + 1, list_append(d.path, r.depends_on) from d join allocation_rule r on d.depends_on = r.rule_id
         where r.is_active and r.depends_on is not null and r.effective_from <= date '2001-06-30'
           and (r.effective_to is null or r.effective_to >= date '2001-06-30')
           and d.level < 10 and not list_contains(d.path, r.depends_on))
      select * from d) x group by 1, 2
    """,
)
def closure(t):
    return rule_closure(t.allocation_rule, AS_OF)


SOURCES = """
 select r.rule_id, l.line_id, l.final_amount, l.gl_account_id, l.cost_center_id, l.fiscal_period_id, r.basis, r.rounding, r.sequence, r.depends_on
   from allocation_rule r, budget_line_item l join cost_center c on l.cost_center_id = c.cost_center_id
        join gl_account a on l.gl_account_id = a.gl_account_id
  where l.header_id = 1 and r.is_active and l.final_amount <> 0
    and (r.source_cost_center_id is null or r.source_cost_center_id = c.cost_center_id)
    and (r.cc_pattern is null or c.code like r.cc_pattern escape '\\')
    and (r.account_pattern is null or a.account_number like r.account_pattern escape '\\')
"""


@query("join_rule_source", f"select rule_id, line_id, sequence from ({SOURCES}) s")
def join_rule_source(t):
    rules = allocate.active_rules(t.allocation_rule)
    return allocate.rule_sources(_budget(t), rules, t.cost_center, t.gl_account).select("rule_id", "line_id", "sequence")


@query(
    "join_targets",
    f"""select s.rule_id, s.line_id, coalesce(v.target_id, v.joined_id) as target_id, v.priority from ({SOURCES}) s
          join rule_target v on s.rule_id = v.rule_id and v.target_is_active""",
)
def join_targets(t):
    rules = allocate.active_rules(t.allocation_rule)
    targets = (
        allocate.target_centres(rule_targets(rules), t.cost_center)
        .filter("target_is_active")
        .select("rule_id", F.coalesce("target_id", "joined_id").alias("target_id"), "priority")
    )
    sources = allocate.rule_sources(_budget(t), rules, t.cost_center, t.gl_account)
    return sources.join(targets, "rule_id").select("rule_id", "line_id", "target_id", "priority")


_FACTORED = """
 select q.*, case q.basis
   when 'EQUAL' then coalesce(cast(1.0::double / k.n as decimal(18,10)), 0)
   when 'HEADCOUNT' then coalesce(case when k.w <> 0 then cast(cast(w.weight as double) / cast(k.w as double) as decimal(18,10)) end, 0)
   when 'REVENUE' then coalesce(case when s.amount <> 0 then cast(cast(v.amount as double) / cast(s.amount as double) as decimal(18,10)) end, 0)
   when 'EXPENSE' then coalesce(case when s.amount <> 0 then cast(cast(v.amount as double) / cast(s.amount as double) as decimal(18,10)) end, 0)
   else 0 end::decimal(18,10) as factor
  from ({requests}) q
  left join child_stat k on q.source_id = k.parent_id
  left join cost_center w on q.target_id = w.cost_center_id and w.is_active
  left join driver_total s on q.source_id = s.source_id and q.fiscal_period_id = s.fiscal_period_id
   and s.account_type = case q.basis when 'REVENUE' then 'R' when 'EXPENSE' then 'X' end
  left join driver v on q.target_id = v.cost_center_id and q.fiscal_period_id = v.fiscal_period_id
   and v.account_type = case q.basis when 'REVENUE' then 'R' when 'EXPENSE' then 'X' end
"""

_REQUESTS = """
 select c.parent_id as source_id, c.cost_center_id as target_id, b.basis, p.fiscal_period_id
   from cost_center c, fiscal_period p, (select unnest(['REVENUE', 'EXPENSE', 'HEADCOUNT', 'EQUAL', 'OTHER']) as basis) b
  where c.parent_id is not null
"""


@query(
    "allocation_factor",
    f"select source_id, target_id, basis, fiscal_period_id, factor from ({_FACTORED.format(requests=_REQUESTS)}) f",
)
def allocation_factor(t):
    """Factor of every child under its parent, for all bases and all periods of the calendar."""
    months = t.fiscal_period.agg(F.collect_list("fiscal_period_id")).scalar()
    bases = F.array(*[F.lit(b) for b in ("REVENUE", "EXPENSE", "HEADCOUNT", "EQUAL", "OTHER")])
    requests = (
        t.cost_center.filter(F.col("parent_id").isNotNull())
        .select(F.col("parent_id").alias("source_id"), F.col("cost_center_id").alias("target_id"), F.explode(bases).alias("basis"))
        .withColumn("fiscal_period_id", F.explode(months))
    )
    return allocate.allocation_factor(requests, _budget(t), t.gl_account, t.cost_center)


_PRODUCTIVE = f"""
 select distinct s.rule_id from ({SOURCES}) s join rule_target v on s.rule_id = v.rule_id and v.target_is_active
"""
ELIGIBLE = f"""
 select * from (with recursive ok as (
   select rule_id from allocation_rule where is_active and depends_on is null
   union all
   select r.rule_id from allocation_rule r join ok on r.depends_on = ok.rule_id
    where r.is_active and ok.rule_id in (select rule_id from productive))
  select rule_id from ok) x
"""
_RESULTS = f"""
 with productive as materialized ({_PRODUCTIVE}), eligible as materialized ({ELIGIBLE}),
 request as (
   select s.rule_id, s.line_id, s.final_amount, s.gl_account_id, s.cost_center_id as source_id, s.fiscal_period_id, s.basis, s.rounding, s.sequence,
          coalesce(v.target_id, v.joined_id) as target_id, v.target_pct, v.priority
     from ({SOURCES}) s join eligible e on s.rule_id = e.rule_id join rule_target v on s.rule_id = v.rule_id and v.target_is_active)
 select line_id as source_line_id, target_id as target_cost_center_id, gl_account_id as target_gl_account_id,
        case rounding when 'UP' then ceil(final_amount::decimal(19,4) * coalesce(target_pct, factor) * 100) / 100
                      when 'DOWN' then floor(final_amount::decimal(19,4) * coalesce(target_pct, factor) * 100) / 100
                      else round(final_amount::decimal(19,4) * factor, 2) end::decimal(19,4) as amount,
        rule_id, sequence, priority, fiscal_period_id
   from ({_FACTORED.format(requests='select * from request')}) f
"""


def _results(t):
    return allocate.allocation_results(_budget(t), t.allocation_rule, t.cost_center, t.gl_account)


@query("allocate_costs", f"select source_line_id, target_cost_center_id, target_gl_account_id, amount, rule_id, sequence, priority from ({_RESULTS}) r", inline=True)
def allocate_costs(t):
    return _results(t).select(
        "source_line_id", "target_cost_center_id", "target_gl_account_id", "amount", "rule_id", "sequence", "priority"
    )


@query(
    "rule_totals",
    f"select rule_id, sum(amount)::decimal(38,4) as total_allocated, count(*) as target_count from ({_RESULTS}) r group by 1",
    inline=True,
)
def rule_totals(t):
    return allocate.rule_totals(_results(t))


@query(
    "mark_allocated",
    f"""select l.line_id, l.line_id in (select source_line_id from ({_RESULTS}) r) as is_allocated from budget_line_item l where l.header_id = 1""",
    inline=True,
)
def mark_allocated(t):
    return allocate.mark_allocated(_budget(t), _results(t)).select("line_id", "is_allocated")


@query(
    "allocated_lines",
    f"""select (select max(line_id) from budget_line_item) + row_number() over (order by allocation_source_line_id, gl_account_id, cost_center_id, fiscal_period_id) as line_id,
               gl_account_id, cost_center_id, fiscal_period_id, original_amount, original_amount::decimal(20,4) as final_amount,
               allocation_source_line_id, true as is_allocated from (
          select target_gl_account_id as gl_account_id, target_cost_center_id as cost_center_id, fiscal_period_id, amount as original_amount,
                 source_line_id as allocation_source_line_id,
                 row_number() over (partition by target_gl_account_id, target_cost_center_id, fiscal_period_id
                                    order by sequence, rule_id, source_line_id, priority, target_cost_center_id) as n from ({_RESULTS}) r) k
         where n = 1 and not exists (select 1 from budget_line_item l where l.header_id = 1 and l.gl_account_id = k.gl_account_id
               and l.cost_center_id = k.cost_center_id and l.fiscal_period_id = k.fiscal_period_id)""",
    inline=True,
)
def allocated_lines(t):
    """Lines an allocation inserts, with the ids they get."""
    run = allocate.allocate_costs(t.budget_line_item, 1, t.allocation_rule, t.cost_center, t.gl_account)
    return run.lines.select("line_id", *LINE_KEY, "original_amount", "final_amount", "allocation_source_line_id", "is_allocated")


@query(
    "allocation_ledger",
    f"""select r.rule_id, r.source_line_id, r.priority, r.target_cost_center_id, r.fiscal_period_id, r.amount, l.line_id as kept_line_id,
               case when l.line_id is not null then 'EXISTS' when row_number() over w = 1 then 'INSERT' else 'COLLISION' end as outcome,
               case when l.line_id is null then first_value(r.source_line_id) over w end as winner_line_id
          from ({_RESULTS}) r left join (select * from budget_line_item where header_id = 1) l on l.gl_account_id = r.target_gl_account_id
               and l.cost_center_id = r.target_cost_center_id and l.fiscal_period_id = r.fiscal_period_id
        window w as (partition by r.target_gl_account_id, r.target_cost_center_id, r.fiscal_period_id order by r.sequence, r.rule_id, r.source_line_id, r.priority)""",
    inline=True,
)
def allocation_ledger(t):
    """What becomes of every allocated amount: inserted, lost to another one on its key, or kept out by a line that is there."""
    ledger = allocate.allocation_ledger(_results(t), 1, _budget(t))
    return ledger.select(
        "rule_id", F.col("allocation_source_line_id").alias("source_line_id"), "priority", F.col("cost_center_id").alias("target_cost_center_id"),
        "fiscal_period_id", F.col("original_amount").alias("amount"), "kept_line_id", "outcome", "winner_line_id",
    )
