"""Small literal frames."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from finloom import schemas as S

DAY = dt.date(2000, 1, 1)


def _rows(schema, defaults, rows):
    names = schema.fieldNames()
    return [tuple({**dict.fromkeys(names), **defaults, **row}[n] for n in names) for row in rows]


def cost_centers(spark, rows):
    """rows: (id, parent) or dicts."""
    dicts = []
    for row in rows:
        row = row if isinstance(row, dict) else {"cost_center_id": row[0], "parent_id": row[1]}
        key = row["cost_center_id"]
        weight = Decimal(str(row.pop("weight", "1")))
        dicts.append({"code": f"C{key}", "name": f"N{key}", **row, "weight": weight})
    return spark.createDataFrame(_rows(S.COST_CENTER, {"is_active": True, "effective_from": DAY}, dicts), S.COST_CENTER)


def accounts(spark, rows):
    dicts = [{"account_number": f"GL{r['gl_account_id']}", "account_name": "a", **r} for r in rows]
    defaults = {"account_type": "X", "is_budgetable": True, "intercompany_flag": False}
    return spark.createDataFrame(_rows(S.GL_ACCOUNT, defaults, dicts), S.GL_ACCOUNT)


def period(key, year, month, closed=False, adjustment=False):
    start = dt.date(year, min(month, 12), 1)
    end = (start.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1)
    return (key, year, (min(month, 12) + 2) // 3, month, f"P{year}-{month:02d}", end if adjustment else start, end, closed, adjustment)


def periods(spark, rows):
    return spark.createDataFrame([period(*r) for r in rows], S.FISCAL_PERIOD)


def headers(spark, rows):
    defaults = {
        "budget_code": "B", "budget_name": "Budget", "budget_type": "ANNUAL", "scenario_type": "BASE", "status_code": "APPROVED",
        "version_number": 1, "fiscal_year": 2000, "start_period_id": 1, "end_period_id": 99,
    }
    return spark.createDataFrame(_rows(S.BUDGET_HEADER, defaults, rows), S.BUDGET_HEADER)


def lines(spark, rows):
    """rows: (line_id, gl, cc, period, amount[, header])."""
    dicts = []
    for r in rows:
        amount = Decimal(str(r[4]))
        dicts.append(
            {
                "line_id": r[0], "gl_account_id": r[1], "cost_center_id": r[2], "fiscal_period_id": r[3],
                "original_amount": amount, "adjusted_amount": Decimal(0), "final_amount": amount,
                "header_id": r[5] if len(r) > 5 else 1, "is_allocated": False,
            }
        )
    return spark.createDataFrame(_rows(S.BUDGET_LINE_ITEM, {}, dicts), S.BUDGET_LINE_ITEM)


def rules(spark, rows):
    dicts = [{"rule_code": f"R{r['rule_id']}", "rule_name": "r", **r} for r in rows]
    defaults = {
        "rule_type": "DIRECT", "allocation_method": "CUSTOM", "rounding": "NEAREST", "sequence": 10, "effective_from": DAY,
        "is_active": True, "target_spec": "<AllocationTargets></AllocationTargets>",
    }
    return spark.createDataFrame(_rows(S.ALLOCATION_RULE, defaults, dicts), S.ALLOCATION_RULE)


def spec(*targets):
    inner = "".join("<Target " + " ".join(f'{k}="{v}"' for k, v in t.items()) + "/>" for t in targets)
    return f"<AllocationTargets>{inner}</AllocationTargets>"


def collect(df, *columns):
    columns = columns or df.columns
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())
