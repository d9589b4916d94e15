"""DuckDB text of the planning tables, as common table expressions.

``model_sql(body)`` puts in front of ``body`` only the tables it needs.
"""

from __future__ import annotations

import re

_TABLES: dict[str, str] = {}

_TABLES["cost_center"] = """
 select 1 as cost_center_id, 'ALL' as code, 'All entities' as name, cast(null as int) as parent_id,
        cast('1.0' as decimal(5,4)) as weight, true as is_active, date '1995-01-01' as effective_from,
        cast(null as date) as effective_to
 union all select 10 + r_regionkey, concat('R', r_regionkey), r_name, 1, cast('0.5' as decimal(5,4)), true,
        date '1995-01-01', null from region
 union all select 100 + n_nationkey, concat('R', n_regionkey, '-N', n_nationkey), n_name, 10 + n_regionkey,
        cast('0.25' as decimal(5,4)), true, date '1995-01-01', null from nation
 union all select cast(1000 + s_suppkey as int), concat('R', n_regionkey, '-N', n_nationkey, '-S', s_suppkey), s_name,
        100 + n_nationkey, cast(concat('0.', s_suppkey % 9 + 1) as decimal(5,4)), s_suppkey % 17 <> 3,
        date '1995-01-01', case when s_suppkey % 23 = 5 then date '1999-12-31' end
   from supplier join nation on s_nationkey = n_nationkey
"""

_TABLES["cost_center_history"] = """
 select *, case when cost_center_id > 1000 and cost_center_id % 7 = 0 then timestamp '1999-01-01'
                else timestamp '1995-01-01' end as valid_from, timestamp '9999-12-31' as valid_to from cost_center
 union all
 select cost_center_id, code, concat('Former ', name), parent_id, cast('0.1' as decimal(5,4)), is_active,
        effective_from, effective_to, timestamp '1995-01-01', timestamp '1999-01-01'
   from cost_center where cost_center_id > 1000 and cost_center_id % 7 = 0
"""

_TABLES["fiscal_period"] = """
 select cast(case when m = 13 then y + 1000 else (y - 1995) * 12 + m end as int) as fiscal_period_id,
        cast(y as int) as fiscal_year, cast(ceil(least(m, 12) / 3.0) as int) as fiscal_quarter, cast(m as int) as fiscal_month,
        concat('FY', y, '-P', lpad(cast(m as varchar), 2, '0')) as period_name,
        case when m = 13 then last_day(make_date(y, 12, 1)) else make_date(y, m, 1) end as period_start,
        last_day(make_date(y, least(m, 12), 1)) as period_end,
        case when m = 13 then y < 2002 else y < 2000 end as is_closed, m = 13 as is_adjustment
   from (select unnest(range(min(year(l_shipdate)), max(year(l_shipdate)) + 2)) as y from lineitem) a,
        (select unnest(range(1, 14)) as m) b
"""

_TABLES["gl_account"] = """
 select cast(substr(p_brand, 7) as int) as gl_account_id, concat('GL', lpad(substr(p_brand, 7), 3, '0')) as account_number,
        p_brand as account_name,
        case cast(substr(p_brand, 7) as int) % 5 when 0 then 'R' when 1 then 'X' when 2 then 'A' when 3 then 'L' else 'E' end
          as account_type,
        cast(substr(p_brand, 7) as int) % 8 <> 0 as is_budgetable, false as intercompany_flag,
        cast(null as int) as consolidation_account_id
   from (select distinct p_brand from part) b
 union all select 101, 'GL101', 'IC receivable', 'A', true, true, 102
 union all select 102, 'GL102', 'IC payable', 'L', true, true, 101
 union all select 103, 'GL103', 'IC suspense', 'A', true, true, 999
 union all select 104, 'GL104', 'Overhead', 'X', true, false, null
"""

_TABLES["all_line"] = """
 select case l_returnflag when 'A' then 1 when 'N' then 2 else 3 end as header_id,
        cast(substr(p_brand, 7) as int) as gl_account_id, cast(1000 + l_suppkey as int) as cost_center_id,
        cast((year(l_shipdate) - 1995) * 12 + month(l_shipdate) as int) as fiscal_period_id,
        sum(cast(l_extendedprice as decimal(19,4))) as original_amount, -sum(cast(l_quantity as decimal(19,4))) as adjusted_amount
   from lineitem join part on l_partkey = p_partkey group by 1, 2, 3, 4
 union all
 select 1, g.gl, cast(1000 + s_suppkey as int), p.period,
        cast(case when s_suppkey % 5 = 0 and p.period % 7 = 0 then 0
                  else (1000 + s_suppkey) * (case when p.period % 2 = 0 then 1 else -1 end) * g.sgn end as decimal(19,4))
        + case when g.gl = 102 and n_regionkey = 1 and s_suppkey % 4 = 1 then cast('3' as decimal(19,4))
               when g.gl = 102 and n_regionkey = 2 then cast('0.01' as decimal(19,4)) else cast('0' as decimal(19,4)) end,
        cast(0 as decimal(19,4))
   from supplier join nation on s_nationkey = n_nationkey,
        (select unnest(range(1, 13)) as period) p,
        (select 101 as gl, 1 as sgn union all select 102, -1 union all select 103, 1) g
 union all
 select 1, 104, cast(100 + c_nationkey as int), cast((year(o_orderdate) - 1995) * 12 + month(o_orderdate) as int),
        sum(cast(o_totalprice as decimal(19,4))), cast(0 as decimal(19,4))
   from orders join customer on o_custkey = c_custkey group by 1, 2, 3, 4
"""

_TABLES["budget_line_item"] = """
 select ((cast(header_id as bigint) * 1000 + gl_account_id) * 10000000000 + cost_center_id) * 1000 + fiscal_period_id as line_id,
        header_id, gl_account_id, cost_center_id, cast(fiscal_period_id as int) as fiscal_period_id,
        cast(original_amount as decimal(19,4)) as original_amount, cast(adjusted_amount as decimal(19,4)) as adjusted_amount,
        cast(original_amount + adjusted_amount as decimal(20,4)) as final_amount,
        case when gl_account_id % 3 = 0 then cast(original_amount as decimal(19,4)) end as local_currency_amount,
        case when fiscal_period_id % 2 = 0 then cast(original_amount as decimal(19,4)) end as reporting_currency_amount
   from all_line
"""

_TABLES["budget_header"] = """
 select header_id, case header_id when 1 then 'BASE' when 2 then 'COMP' else 'DRFT' end as budget_code,
        case header_id when 1 then 'Base plan' when 2 then 'Comparison plan' else 'Draft plan' end as budget_name,
        'ANNUAL' as budget_type,
        case header_id when 1 then 'BASE' when 2 then 'OPTIMISTIC' else 'STRETCH' end as scenario_type,
        case header_id when 1 then 'APPROVED' when 2 then 'LOCKED' else 'DRAFT' end as status_code,
        header_id as version_number, 2000 as fiscal_year,
        min(fiscal_period_id) as start_period_id, max(fiscal_period_id) as end_period_id
   from budget_line_item group by header_id
"""

_TABLES["import_staging"] = """
 select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
          l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) as row_id,
        case when l_orderkey % 53 = 0 then concat('BAD', l_partkey)
             else concat('GL', lpad(substr(p_brand, 7), 3, '0')) end as account_number,
        concat('R', n_regionkey, '-N', n_nationkey, '-S', s_suppkey) as cost_center_code,
        cast(year(l_shipdate) as int) as fiscal_year, cast(month(l_shipdate) as int) as fiscal_month,
        case when l_linenumber = 7 and l_orderkey % 11 = 0 then null else cast(l_extendedprice as decimal(19,4)) end
          as original_amount,
        -cast(l_quantity as decimal(19,4)) as adjusted_amount
   from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
        join nation on s_nationkey = n_nationkey
"""

_TABLES["resolved"] = """
 select s.*, a.gl_account_id, c.cost_center_id, p.fiscal_period_id, a.is_budgetable, c.is_active, p.is_closed
   from import_staging s left join gl_account a on s.account_number = a.account_number
        left join cost_center c on s.cost_center_code = c.code
        left join fiscal_period p on s.fiscal_year = p.fiscal_year and s.fiscal_month = p.fiscal_month
"""

_TABLES["journal"] = """
 select o_orderkey as journal_id, concat('J', o_orderkey) as journal_number, 1 as header_id,
        cast((year(o_orderdate) - 1995) * 12 + month(o_orderdate) as int) as fiscal_period_id,
        case o_orderstatus when 'O' then 'DRAFT' when 'P' then 'SUBMITTED' else 'POSTED' end as status_code from orders
"""

_TABLES["journal_line"] = """
 select l_orderkey as journal_id, l_linenumber as line_number, cast(substr(p_brand, 7) as int) as gl_account_id,
        cast(1000 + l_suppkey as int) as cost_center_id,
        case when l_linenumber % 2 = 1 then cast(l_extendedprice as decimal(19,4)) else 0 end as debit_amount,
        case when l_linenumber % 2 = 0 or l_orderkey % 101 = 0 then cast(l_extendedprice as decimal(19,4)) else 0 end
          as credit_amount
   from lineitem join part on l_partkey = p_partkey
"""

_TABLES["allocation_rule"] = """
 select cast(1000 + s_suppkey as int) as rule_id, concat('SUP_', s_suppkey) as rule_code,
        cast(1000 + s_suppkey as int) as source_cost_center_id, cast(null as varchar) as cc_pattern,
        case s_suppkey % 3 when 1 then 'GL0__' when 2 then 'GL01%' end as account_pattern,
        case s_suppkey % 4 when 0 then 'REVENUE' when 1 then 'EXPENSE' when 2 then 'HEADCOUNT' else 'CUSTOM' end as basis,
        case s_suppkey % 5 when 0 then 'UP' when 1 then 'DOWN' else 'NEAREST' end as rounding,
        cast(10 + s_suppkey % 3 * 10 as int) as sequence,
        cast(case when s_suppkey % 16 = 12 then 1001 + s_suppkey when s_suppkey % 10 = 4 then 900000 + s_suppkey
                  when s_suppkey % 4 <> 0 then 999 + s_suppkey end as int) as depends_on,
        date '1995-01-01' as effective_from,
        case when s_suppkey % 11 = 7 then date '1998-12-31' end as effective_to, s_suppkey % 13 <> 5 as is_active
   from supplier join nation on s_nationkey = n_nationkey
 union all
 select 10 + r_regionkey, concat('REG_', r_regionkey), null, concat('R', r_regionkey, '-N%'),
        case when r_regionkey % 2 = 0 then 'GL104' else 'GL_04' end,
        case when r_regionkey % 2 = 0 then 'EQUAL' else 'HEADCOUNT' end, 'NEAREST', 5, null, date '1995-01-01', null, true
   from region
"""

_TABLES["rule_spec"] = """
 select cast(1000 + s_suppkey as int) as rule_id, 1 as priority, 100 + n_nationkey as target_id,
        cast(null as varchar) as target_code, cast('0.25' as decimal(8,6)) as target_pct, cast(null as varchar) as account_filter,
        cast(null as varchar) as exclude_pattern, false as has_conditions
   from supplier join nation on s_nationkey = n_nationkey
 union all
 select cast(1000 + s_suppkey as int), 2, null, concat('R', n_regionkey, '-N', n_nationkey, '-S', s_suppkey), null,
        case when s_suppkey % 6 = 1 then 'GL0%' end, case when s_suppkey % 6 <> 1 then 'GL9%' end, s_suppkey % 6 = 1
   from supplier join nation on s_nationkey = n_nationkey
 union all select 10 + r_regionkey, 1, 10 + r_regionkey, null, null, null, null, false from region
 union all select 10 + r_regionkey, 2, null, concat('R', r_regionkey), cast('0.125' as decimal(8,6)), null, null, false from region
 union all select 10 + r_regionkey, 3, null, 'NOWHERE', null, null, null, false from region
"""

_TABLES["rule_target"] = """
 select s.*, c.cost_center_id as joined_id, c.name as target_name, c.parent_id as target_parent_id, c.is_active as target_is_active
   from rule_spec s left join cost_center c on c.cost_center_id = s.target_id or c.code = s.target_code
"""

_TABLES["hierarchy"] = """
 select * from (
  with recursive h as (
   select cost_center_id, code, name, parent_id, 0 as level, name as path, lpad(cast(cost_center_id as varchar), 10, '0') as sort_path,
          cast(weight as decimal(18,10)) as cumulative_weight, [cost_center_id] as path_ids
     from cost_center where parent_id is null
   union all
   select c.cost_center_id, c.code, c.name, c.parent_id, h.level + 1, concat(h.path, ' > ', c.name),
          concat(h.sort_path, '/', lpad(cast(c.cost_center_id as varchar), 10, '0')),
          cast(h.cumulative_weight * c.weight as decimal(18,10)), list_append(h.path_ids, c.cost_center_id)
     from cost_center c join h on c.parent_id = h.cost_center_id
    where h.level < 10 and c.is_active and c.effective_from <= date '2001-06-30'
      and (c.effective_to is null or c.effective_to >= date '2001-06-30'))
  select * from h) x
"""

_TABLES["driver"] = """
 select l.cost_center_id, l.fiscal_period_id, a.account_type, sum(l.final_amount) as amount
   from budget_line_item l join gl_account a on l.gl_account_id = a.gl_account_id
  where l.header_id = 1 and a.account_type in ('R', 'X') group by 1, 2, 3
"""

_TABLES["driver_total"] = """
 select source_id, fiscal_period_id, account_type, cast(sum(amount) as decimal(19,4)) as amount from (
   select d.cost_center_id as source_id, d.fiscal_period_id, d.account_type, d.amount
     from driver d join cost_center c on d.cost_center_id = c.cost_center_id
   union all
   select c.parent_id, d.fiscal_period_id, d.account_type, d.amount
     from driver d join cost_center c on d.cost_center_id = c.cost_center_id where c.parent_id is not null) u
  group by 1, 2, 3
"""

_TABLES["child_stat"] = """
 select parent_id, count(*) as n, cast(sum(weight) as decimal(19,4)) as w from cost_center
  where is_active and parent_id is not null group by 1
"""

_TABLES["ic_line"] = """
 select l.line_id, l.gl_account_id, l.cost_center_id, l.fiscal_period_id, l.final_amount,
        split_part(c.code, '-', 1) as entity, a.intercompany_flag, a.consolidation_account_id as partner_account_id
   from budget_line_item l join gl_account a on l.gl_account_id = a.gl_account_id
        join cost_center c on l.cost_center_id = c.cost_center_id where l.header_id = 1
"""

_TABLES["ic_pair"] = """
 select *, entity1_amount - entity2_amount as variance,
        case when abs(entity1_amount - entity2_amount) <= 0.01 then true
             when abs(entity1_amount) > 0 and abs(entity1_amount - entity2_amount) <= 0.001 * abs(entity1_amount) then true
             else false end as is_within_tolerance
   from (select a.entity as entity1, coalesce(b.entity, '') as entity2, a.gl_account_id, a.partner_account_id,
                sum(a.final_amount) as entity1_amount, -sum(coalesce(b.final_amount, 0)) as entity2_amount
           from ic_line a left join ic_line b on b.gl_account_id = a.partner_account_id
          where a.intercompany_flag and a.partner_account_id is not null
          group by 1, 2, 3, 4
         having sum(a.final_amount) <> 0 or sum(coalesce(b.final_amount, 0)) <> 0) q
"""

_TABLES["ic_link"] = """
 select gl_account_id, consolidation_account_id as partner_account_id from gl_account
  where intercompany_flag and consolidation_account_id is not null
"""

_TABLES["ic_match"] = """
 select k.gl_account_id, k.partner_account_id, a.line_id as source_line_id, b.line_id as target_line_id,
        a.final_amount as source_amount, b.final_amount as target_amount,
        case when a.final_amount = -b.final_amount then 'EXACT'
             when abs(a.final_amount + b.final_amount) <= 0.01 then 'TOLERANCE'
             when b.line_id is null then 'UNMATCHED_SOURCE' else 'PARTIAL' end as match_type
   from ic_link k join ic_line a on a.gl_account_id = k.gl_account_id
        left join ic_line b on b.gl_account_id = k.partner_account_id
"""

_TABLES["recon"] = """
 select p.*, case when p.is_within_tolerance then 'RECONCILED'
                  when m.exact_n > 0 then 'MATCHED' when m.partial_n > 0 then 'PARTIAL_MATCH' else 'UNRECONCILED' end as status
   from ic_pair p left join (
        select gl_account_id, partner_account_id, count(*) filter (match_type = 'EXACT') as exact_n,
               count(*) filter (match_type = 'PARTIAL') as partial_n from ic_match group by 1, 2) m
     on p.gl_account_id = m.gl_account_id and p.partner_account_id = m.partner_account_id
"""

_TABLES["history"] = """
 select l.gl_account_id, l.cost_center_id, l.fiscal_period_id, l.final_amount as actual,
        row_number() over s as seq, p.fiscal_month,
        cast(pow(cast(0.9 as double), 12 - row_number() over s) as decimal(18,6)) as weight_factor
   from budget_line_item l join fiscal_period p on l.fiscal_period_id = p.fiscal_period_id
  where l.header_id = 1 and p.fiscal_year >= 1999
 window s as (partition by l.gl_account_id, l.cost_center_id order by p.fiscal_year, p.fiscal_month)
"""

_TABLES["trend_raw"] = """
 select *, count(*) over (partition by gl_account_id, cost_center_id order by seq rows unbounded preceding) as n,
        sum(seq) over g as sum_x, sum(seq * seq) over g as sum_xx,
        cast(sum(actual) over g as double) as sum_y, cast(sum(seq * actual) over g as double) as sum_xy,
        cast(sum(actual) over (partition by gl_account_id, cost_center_id order by seq rows 11 preceding) as double)
          / count(*) over (partition by gl_account_id, cost_center_id order by seq rows 11 preceding) as ma12,
        lag(actual, 12) over (partition by gl_account_id, cost_center_id order by seq) as year_ago
   from history window g as (partition by gl_account_id, cost_center_id)
"""

_TABLES["trend"] = """
 select *, case when n > 1 and n * sum_xx - sum_x * sum_x <> 0
                then money((cast(n as double) * sum_xy - cast(sum_x as double) * sum_y) / cast(n * sum_xx - sum_x * sum_x as double))
                else 0 end as trend,
        case when year_ago is not null and year_ago <> 0
             then money(cast(actual - year_ago as double) / cast(year_ago as double)) else 0 end as cyclical
   from trend_raw
"""

_TABLES["baseline"] = """
 select gl_account_id, cost_center_id, max(seq) as last_seq,
        cast(sum(actual * weight_factor) as double) / cast(sum(weight_factor) as double) as weighted_avg,
        cast(sum(trend) as double) / count(*) as avg_trend, stddev_samp(cast(actual as double)) as std_dev
   from trend group by 1, 2
"""

_TABLES["future"] = """
 select * from (
   select fiscal_period_id, fiscal_year, fiscal_quarter, fiscal_month, period_name,
          row_number() over (order by fiscal_year, fiscal_month) as k
     from fiscal_period where not is_closed and fiscal_period_id > (select max(fiscal_period_id) from history)) f
  where k <= 12
"""

_DEPENDS = {
    name: [other for other in _TABLES if other != name and re.search(rf"\b{other}\b", text)]
    for name, text in _TABLES.items()
}


def _money(text: str) -> str:
    """Expand ``money(x)``: nearest four-decimal amount, halves away from zero."""
    out, start = "", 0
    for match in re.finditer(r"\bmoney\(", text):
        depth, end = 1, match.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        x = f"({text[match.end() : end - 1]})"
        out += text[start : match.start()]
        out += (
            f"cast(case when {x} < 0 then -1 else 1 end * cast(floor(abs({x}) * 10000.0::double + 0.5::double) as decimal(28,0))"
            " * cast('0.0001' as decimal(5,4)) as decimal(19,4))"
        )
        start = end
    return out + text[start:]


def model_sql(body: str, inline: bool = False) -> str:
    """``body`` behind the tables it names, in order of dependence.

    ``inline`` keeps DuckDB from storing the tables; sharing them makes some
    versions fail on the longest texts.
    """
    ordered: list[str] = []

    def need(name: str) -> None:
        if name not in ordered:
            for other in _DEPENDS[name]:
                need(other)
            ordered.append(name)

    for name in _TABLES:
        if re.search(rf"\b{name}\b", body):
            need(name)
    kept = "as not materialized" if inline else "as"
    ctes = ",\n".join(f"{name} {kept} ({_TABLES[name]})" for name in ordered)
    return _money(f"with {ctes}\n{body}" if ctes else body)
