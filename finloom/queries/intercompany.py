"""Intercompany reconciliation and adjustment journals."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from finloom.functions.columns import entity_of
from finloom.functions.ordering import lay_out, with_dense_index
from finloom.operators import journals, reconcile
from finloom.plans.documents import items_of
from finloom.plans.reconciliation import reconcile_intercompany
from finloom.plans.reports import reconciliation_document, reconciliation_report, reconciliation_xml
from finloom.queries.registry import query
from finloom.sources.documents import entity_list

ON = dt.date(2001, 6, 30)
PAIR = "entity1, entity2, gl_account_id, partner_account_id"


def _budget(t):
    return t.lines_of(1)


def _pairs(t, **options):
    return reconcile.ic_pairs(_budget(t), t.gl_account, t.cost_center, **options)


def _matches(t):
    return reconcile.match_amounts(_budget(t), t.gl_account)


def _status(t):
    return reconcile.recon_status(_pairs(t), _matches(t))


def _pair_columns(df):
    return df.withColumn("variance_pct", F.round("variance_pct", 6))


_PAIR_SELECT = f"""{PAIR}, entity1_amount::decimal(38,4) as entity1_amount, entity2_amount::decimal(38,4) as entity2_amount,
   variance::decimal(38,4) as variance,
   case when entity1_amount <> 0 then round(cast(variance as double) / cast(abs(entity1_amount) as double), 6) end as variance_pct,
   is_within_tolerance,
   sha256(concat_ws('|', entity1, entity2, gl_account_id, cast(abs(round(entity1_amount, 0))::decimal(38,4) as varchar))) as match_hash"""


@query("ic_pairs", f"select {_PAIR_SELECT} from ic_pair")
def ic_pairs(t):
    return _pair_columns(_pairs(t))


@query("join_ic_partner", f"select {PAIR}, entity2_amount::decimal(38,4) as entity2_amount from ic_pair")
def join_ic_partner(t):
    return _pairs(t).select(*reconcile.PAIR_KEY, "entity2_amount")


@query(
    "ic_pairs_per_period",
    """
    select a.entity1, coalesce(b.entity, '') as entity2, a.gl_account_id, a.partner_account_id, a.fiscal_period_id,
           a.s::decimal(38,4) as entity1_amount, (-coalesce(b.s, 0))::decimal(38,4) as entity2_amount,
           (a.s + coalesce(b.s, 0))::decimal(38,4) as variance
      from (select entity as entity1, gl_account_id, partner_account_id, fiscal_period_id, sum(final_amount) as s from ic_line
             where intercompany_flag and partner_account_id is not null group by 1, 2, 3, 4) a
      left join (select entity, gl_account_id, fiscal_period_id, sum(final_amount) as s from ic_line group by 1, 2, 3) b
        on b.gl_account_id = a.partner_account_id and b.fiscal_period_id = a.fiscal_period_id
     where a.s <> 0 or coalesce(b.s, 0) <> 0
    """,
)
def ic_pairs_per_period(t):
    return _pairs(t, mode="per_period").select(
        *reconcile.PAIR_KEY, "fiscal_period_id", "entity1_amount", "entity2_amount", "variance"
    )


@query(
    "src_xml_entities",
    f"select {PAIR}, variance::decimal(38,4) as variance from ic_pair where entity1 in ('R1', 'R2')",
)
def src_xml_entities(t):
    """Pairs whose first entity is included by an XML list."""
    wanted = entity_list(
        t.spark,
        '<Entities><Entity Code="R1" Name="One"/><Entity Code="R2" Name="Two" Include="1"/><Entity Code="R3" Include="0"/></Entities>',
    )
    return _pairs(t, entities=wanted).select(*reconcile.PAIR_KEY, "variance")


_RANKED = "select *, row_number() over (partition by gl_account_id, final_amount order by line_id) as r from ic_line"
_PAIRED = f"""
 select k.gl_account_id, k.partner_account_id, a.line_id as source_line_id, b.line_id as target_line_id, b.final_amount as target_amount
   from ic_link k join ({_RANKED}) a on a.gl_account_id = k.gl_account_id
        join ({_RANKED}) b on b.gl_account_id = k.partner_account_id and b.final_amount = -a.final_amount and b.r = a.r
"""
_TARGETS = f"""
 select *, 'EXACT' as pairing from ({_PAIRED}) p
 union all
 select gl_account_id, partner_account_id, source_line_id, target_line_id, target_amount, 'NEAREST' from (
   select a.gl_account_id, b.gl_account_id as partner_account_id, a.line_id as source_line_id, b.line_id as target_line_id, b.final_amount as target_amount,
          row_number() over (partition by a.line_id, b.gl_account_id order by abs(a.final_amount + b.final_amount), b.final_amount, b.line_id) as nth
     from ic_link k join ic_line a on a.gl_account_id = k.gl_account_id join ic_line b on b.gl_account_id = k.partner_account_id
    where (a.line_id, k.partner_account_id) not in (select source_line_id, partner_account_id from ({_PAIRED}) p)
      and (b.line_id, k.gl_account_id) not in (select target_line_id, gl_account_id from ({_PAIRED}) p)) n where nth = 1
"""


@query(
    "join_ic_detail",
    f"""
    select d.*, t.target_line_id, t.target_amount, t.pairing from (
      select gl_account_id, partner_account_id, source_line_id, source_amount, count(*) filter (match_type = 'EXACT') as exact_n,
             count(*) filter (match_type = 'TOLERANCE') as tolerance_n, count(*) filter (match_type = 'PARTIAL') as partial_n,
             count(target_line_id) as partner_lines,
             coalesce(min(abs(source_amount + target_amount)), abs(source_amount))::decimal(21,4) as smallest_difference,
             min_by(match_type, abs(source_amount + coalesce(target_amount, 0))) as match_type
        from ic_match group by 1, 2, 3, 4) d
      left join ({_TARGETS}) t on d.source_line_id = t.source_line_id and d.partner_account_id = t.partner_account_id
    """,
)
def join_ic_detail(t):
    """Match counts, best match and paired target line of every source line."""
    budget = _budget(t)
    detail = reconcile.match_lines(budget, _matches(t), reconcile.match_targets(budget, t.gl_account))
    difference = F.abs(F.col("source_amount") + F.coalesce("nearest_amount", F.lit(0))).cast("decimal(21,4)")
    return detail.select(
        "gl_account_id", "partner_account_id", "source_line_id", "source_amount", "exact_n", "tolerance_n", "partial_n",
        "partner_lines", difference.alias("smallest_difference"), "match_type", "target_line_id", "target_amount", "pairing",
    )


@query(
    "ic_match_types",
    "select gl_account_id, partner_account_id, match_type, count(*) as match_count from ic_match group by 1, 2, 3",
)
def ic_match_types(t):
    return reconcile.match_types(_matches(t))


@query("recon_status", f"select {PAIR}, variance::decimal(38,4) as variance, is_within_tolerance, status from recon")
def recon_status(t):
    return _status(t).select(*reconcile.PAIR_KEY, "variance", "is_within_tolerance", "status")


@query(
    "recon_stats",
    """
    select count(*) as total_pairs, count(*) filter (status = 'RECONCILED') as reconciled,
           count(*) filter (status = 'UNRECONCILED') as unreconciled, sum(abs(variance))::decimal(38,4) as total_variance,
           coalesce(sum(abs(variance)) filter (not is_within_tolerance), 0)::decimal(38,4) as out_of_tolerance_variance,
           coalesce(sum(abs(variance)) filter (status = 'UNRECONCILED'), 0)::decimal(38,4) as unreconciled_variance from recon
    """,
)
def recon_stats(t):
    return reconcile.recon_stats(_status(t))


@query(
    "recon_entity_stats",
    """
    select e.entity as entity_code, count(r.gl_account_id) as pair_count, sum(abs(r.variance))::decimal(38,4) as total_variance
      from (select distinct entity from ic_line) e left join recon r on r.entity1 = e.entity or r.entity2 = e.entity group by 1
    """,
)
def recon_entity_stats(t):
    listed = reconcile.entities_of_budget(_budget(t), t.cost_center)
    return reconcile.entity_stats(_status(t), listed).drop("entity_name")


_ADJUST = """
 select row_number() over (order by r.entity1, r.entity2, r.gl_account_id, r.partner_account_id)::int as line_number, r.gl_account_id,
        (select min(c.cost_center_id) from cost_center c where split_part(c.code, '-', 1) = r.entity1) as cost_center_id,
        greatest(r.variance, 0)::decimal(19,4) as debit_amount, greatest(-r.variance, 0)::decimal(19,4) as credit_amount,
        concat('IC Adjustment: ', r.entity1, ' <-> ', r.entity2) as description
   from recon r where r.status = 'UNRECONCILED' and abs(r.variance) > 0.01
"""


@query("journal_adjustments", _ADJUST)
def journal_adjustments(t):
    return journals.adjustment_lines(_status(t), t.cost_center, 1).drop("journal_id")


@query(
    "journal_adjustments_header",
    """select 'ICR-20010630-recon-1' as journal_number, 'ELIMINATION' as journal_type,
              (select min(fiscal_period_id) from fiscal_period where date '2001-06-30' between period_start and period_end) as fiscal_period_id,
              'DRAFT' as status_code""",
)
def journal_adjustments_header(t):
    journal = journals.adjustment_journal(t.fiscal_period, 1, 1, "recon-1", ON)
    return journal.select("journal_number", "journal_type", "fiscal_period_id", "status_code")


@query(
    "w_line_no",
    f"select {PAIR}, row_number() over (order by {PAIR}) as line_number from ic_pair",
)
def w_line_no(t):
    pairs = _pairs(t).select(*reconcile.PAIR_KEY)
    return with_dense_index(lay_out(pairs, reconcile.PAIR_KEY), "line_number").select(*reconcile.PAIR_KEY, "line_number")


@query(
    "report_order",
    f"""select {PAIR}, row_number() over (order by case status when 'UNRECONCILED' then 1 when 'PARTIAL_MATCH' then 2 else 3 end,
               abs(variance) desc, {PAIR}) as position from recon""",
)
def report_order(t):
    ordered = lay_out(_status(t), reconcile.report_order())
    return with_dense_index(ordered, "position").select(*reconcile.PAIR_KEY, "position")


@query(
    "first_match",
    """select split_part(code, '-', 1) as entity, min(cost_center_id) as cost_center_id from cost_center group by 1""",
)
def first_match(t):
    return t.cost_center.groupBy(entity_of(F.col("code")).alias("entity")).agg(F.min("cost_center_id").alias("cost_center_id"))


def _run(t):
    return reconcile_intercompany(
        _budget(t), t.gl_account, t.cost_center, t.fiscal_period, 1, "recon-1", ON, create_adjustments=True
    )


@query("reconcile_intercompany", f"select {PAIR}, status from recon")
def reconcile_all(t):
    return _run(t).status.select(*reconcile.PAIR_KEY, "status")


@query(
    "nested_report",
    f"""
    select r.entity1, r.entity2, r.gl_account_id, r.partner_account_id, r.status, string_agg(concat(m.match_type, '=', m.n), ',' order by m.match_type) as matches
      from recon r left join (select gl_account_id, partner_account_id, match_type, count(*) as n from ic_match group by 1, 2, 3) m
        on r.gl_account_id = m.gl_account_id and r.partner_account_id = m.partner_account_id group by all
    """,
)
def nested_report(t):
    """The JSON report, read back to compare its nested match types."""
    run = _run(t)
    report = reconciliation_report(run.status, run.match_types, t.gl_account)
    nested = F.from_json("document", "status string, matches array<struct<match_type:string,match_count:bigint>>")
    listed = F.transform(nested["matches"], lambda m: F.concat(m["match_type"], F.lit("="), m["match_count"].cast("string")))
    return report.select(*reconcile.PAIR_KEY, nested["status"].alias("status"), F.array_join(listed, ",").alias("matches"))


@query("nested_report_xml", f"select {PAIR}, status from recon")
def nested_report_xml(t):
    """The XML report, read back for its status attribute."""
    run = _run(t)
    report = reconciliation_xml(run.status, run.match_types, t.gl_account)
    return report.select(*reconcile.PAIR_KEY, F.expr("xpath_string(document, '/Pair/@Status')").alias("status"))


_ORDER = f"case status when 'UNRECONCILED' then 1 when 'PARTIAL_MATCH' then 2 else 3 end, abs(variance) desc, {PAIR}"


def _document(t):
    run = reconcile_intercompany(_budget(t), t.gl_account, t.cost_center, t.fiscal_period, 1, "recon-1", ON, with_targets=True)
    return reconciliation_document(run, t.gl_account, "recon-1", ON, 1)


@query(
    "nested_report_reconciliation",
    f"""
    select r.pair_id, r.entity1, r.entity2, r.status, r.partner_account_id, a.account_number, r.entity1_amount::decimal(38,4) as amount1, r.entity2_amount::decimal(38,4) as amount2,
           r.variance::decimal(38,4) as variance, r.is_within_tolerance, m.matches
      from (select *, row_number() over (order by {_ORDER}) as pair_id from recon) r join gl_account a on r.gl_account_id = a.gl_account_id
      left join (select gl_account_id, partner_account_id, string_agg(concat(match_type, '=', n), ',' order by match_type) as matches
                   from (select gl_account_id, partner_account_id, match_type, count(*) as n from ic_match group by 1, 2, 3) c group by 1, 2) m
        on r.gl_account_id = m.gl_account_id and r.partner_account_id = m.partner_account_id
    """,
)
def nested_report_reconciliation(t):
    """The pairs of the whole XML report, parsed back, with the places they have in it."""
    schema = """_ID long, _Entity1 string, _Entity2 string, _Status string, _Partner int, Account string, Amount1 decimal(38,4), Amount2 decimal(38,4),
                Variance decimal(38,4), WithinTolerance boolean, Match array<struct<_Type:string,Count:bigint>>"""
    items = items_of(_document(t), "Pair", schema)
    listed = F.array_join(F.transform("Match", lambda m: F.concat(m["_Type"], F.lit("="), m["Count"].cast("string"))), ",")
    return items.select(
        F.col("_ID").alias("pair_id"), F.coalesce("_Entity1", F.lit("")).alias("entity1"), F.coalesce("_Entity2", F.lit("")).alias("entity2"),
        F.col("_Status").alias("status"), F.col("_Partner").alias("partner_account_id"), F.col("Account").alias("account_number"),
        F.col("Amount1").alias("amount1"), F.col("Amount2").alias("amount2"), F.col("Variance").alias("variance"),
        F.col("WithinTolerance").alias("is_within_tolerance"), listed.alias("matches"),
    )


@query(
    "nested_report_matched_lines",
    f"""select a.line_id as source_line_id, k.gl_account_id, k.partner_account_id, t.target_line_id
          from ic_link k join ic_line a on a.gl_account_id = k.gl_account_id
          left join ({_TARGETS}) t on t.source_line_id = a.line_id and t.partner_account_id = k.partner_account_id""",
)
def nested_report_matched_lines(t):
    """The matched lines of the whole XML report, parsed back."""
    items = items_of(_document(t), "MatchedLine", "_Account int, _Partner int, SourceID long, TargetID long")
    return items.select(F.col("SourceID").alias("source_line_id"), F.col("_Account").alias("gl_account_id"), F.col("_Partner").alias("partner_account_id"), F.col("TargetID").alias("target_line_id"))


@query(
    "join_range_period",
    """select j.journal_id, min(p.fiscal_period_id) as fiscal_period_id from (select o_orderkey as journal_id, cast(o_orderdate as date) as d from orders) j
         join fiscal_period p on j.d between p.period_start and p.period_end group by 1""",
)
def join_range_period(t):
    """Period of each journal's posting date.

    Periods lie within one month, so the month is an equality key and only
    the day range is left to a filter.
    """
    month = F.trunc("posting_date", "month")
    periods = t.fiscal_period.select("fiscal_period_id", "period_start", "period_end", F.trunc("period_start", "month").alias("month"))
    return (
        t.journal.select("journal_id", "posting_date", month.alias("month"))
        .join(periods, "month")
        .filter(F.col("posting_date").between(F.col("period_start"), F.col("period_end")))
        .groupBy("journal_id")
        .agg(F.min("fiscal_period_id").alias("fiscal_period_id"))
    )
