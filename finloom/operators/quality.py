"""Declared rules of the planning tables, checked as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Allowed codes.
ACCOUNT_TYPES = ["A", "L", "E", "R", "X"]
BALANCES = ["D", "C"]
HEADER_STATUSES = ["DRAFT", "SUBMITTED", "APPROVED", "REJECTED", "LOCKED", "ARCHIVED"]
RULE_TYPES = ["DIRECT", "STEP_DOWN", "RECIPROCAL", "ACTIVITY_BASED"]
ROUNDINGS = ["NEAREST", "UP", "DOWN", "NONE"]

# Longest text each column takes.
MAX_LENGTHS = {
    "fiscal_period": {"period_name": 50},
    "cost_center": {"code": 20, "name": 100},
    "gl_account": {"account_number": 20, "account_name": 150},
    "budget_header": {"budget_code": 30, "budget_name": 100, "budget_type": 20, "scenario_type": 20},
    "budget_line_item": {"unit_of_measure": 10, "spread_method": 10, "source_system": 30, "source_reference": 100},
    "allocation_rule": {"rule_code": 30, "rule_name": 100, "cc_pattern": 50, "account_pattern": 50, "basis": 30},
    "journal": {"journal_number": 30, "journal_type": 20, "description": 500},
    "journal_line": {"description": 255},
}

# Columns that must have a value.
REQUIRED = {
    "fiscal_period": ["fiscal_year", "fiscal_quarter", "fiscal_month", "period_name", "period_start", "period_end", "is_closed", "is_adjustment"],
    "cost_center": ["code", "name", "weight", "is_active", "effective_from"],
    "gl_account": ["account_number", "account_name", "account_type", "is_budgetable", "intercompany_flag"],
    "budget_header": ["budget_code", "budget_name", "budget_type", "scenario_type", "status_code", "version_number", "fiscal_year"],
    "budget_line_item": ["header_id", "gl_account_id", "cost_center_id", "fiscal_period_id", "original_amount", "adjusted_amount", "is_allocated"],
    "allocation_rule": ["rule_code", "rule_name", "rule_type", "allocation_method", "sequence", "effective_from", "is_active"],
    "journal": ["journal_number", "journal_type", "header_id", "fiscal_period_id", "posting_date", "status_code"],
    "journal_line": ["gl_account_id", "cost_center_id", "debit_amount", "credit_amount"],
}

PRIMARY_KEYS = {
    "fiscal_period": ["fiscal_period_id"],
    "cost_center": ["cost_center_id"],
    "gl_account": ["gl_account_id"],
    "budget_header": ["header_id"],
    "budget_line_item": ["line_id"],
    "allocation_rule": ["rule_id"],
    "journal": ["journal_id"],
    "journal_line": ["journal_id", "line_number"],
}

UNIQUE_KEYS = {
    "fiscal_period": [["fiscal_year", "fiscal_month"]],
    "cost_center": [["code"]],
    "gl_account": [["account_number"]],
    "budget_header": [["budget_code", "fiscal_year", "version_number"]],
    "budget_line_item": [["header_id", "gl_account_id", "cost_center_id", "fiscal_period_id"]],
    "allocation_rule": [["rule_code"]],
    "journal": [["journal_number"]],
    "journal_line": [],
}

# child table, child column, parent table, parent column
FOREIGN_KEYS = [
    ("cost_center", "parent_id", "cost_center", "cost_center_id"),
    ("gl_account", "parent_account_id", "gl_account", "gl_account_id"),
    ("budget_header", "start_period_id", "fiscal_period", "fiscal_period_id"),
    ("budget_header", "end_period_id", "fiscal_period", "fiscal_period_id"),
    ("budget_header", "base_header_id", "budget_header", "header_id"),
    ("budget_line_item", "header_id", "budget_header", "header_id"),
    ("budget_line_item", "gl_account_id", "gl_account", "gl_account_id"),
    ("budget_line_item", "cost_center_id", "cost_center", "cost_center_id"),
    ("budget_line_item", "fiscal_period_id", "fiscal_period", "fiscal_period_id"),
    ("budget_line_item", "allocation_source_line_id", "budget_line_item", "line_id"),
    ("allocation_rule", "source_cost_center_id", "cost_center", "cost_center_id"),
    ("allocation_rule", "depends_on", "allocation_rule", "rule_id"),
    ("journal", "header_id", "budget_header", "header_id"),
    ("journal", "fiscal_period_id", "fiscal_period", "fiscal_period_id"),
    ("journal", "reversal_period_id", "fiscal_period", "fiscal_period_id"),
    ("journal", "reversed_from_journal_id", "journal", "journal_id"),
    ("journal_line", "allocation_rule_id", "allocation_rule", "rule_id"),
    ("journal_line", "journal_id", "journal", "journal_id"),
    ("journal_line", "gl_account_id", "gl_account", "gl_account_id"),
    ("journal_line", "cost_center_id", "cost_center", "cost_center_id"),
]

# parents that grow with the business; the others are dimensions
LARGE_TABLES = ["budget_line_item", "journal"]


def checks() -> dict[str, dict[str, Column]]:
    """Condition that a violating row fulfils, per table and rule."""
    debit, credit = F.col("debit_amount"), F.col("credit_amount")
    return {
        "fiscal_period": {
            "QUARTER_RANGE": ~F.col("fiscal_quarter").between(1, 4),
            "MONTH_RANGE": ~F.col("fiscal_month").between(1, 13),
            "DATE_RANGE": F.col("period_end") < F.col("period_start"),
        },
        "cost_center": {"WEIGHT_RANGE": ~F.col("weight").between(0, 1)},
        "gl_account": {"ACCOUNT_TYPE": ~F.col("account_type").isin(ACCOUNT_TYPES)},
        "budget_header": {"STATUS": ~F.col("status_code").isin(HEADER_STATUSES)},
        "budget_line_item": {},
        "allocation_rule": {
            "RULE_TYPE": ~F.col("rule_type").isin(RULE_TYPES),
            "ROUNDING": ~F.col("rounding").isin(ROUNDINGS),
        },
        "journal": {},
        "journal_line": {"DEBIT_CREDIT": (debit < 0) | (credit < 0) | ((debit > 0) & (credit > 0))},
    }


def validate_model(tables: dict[str, DataFrame]) -> DataFrame:
    """Violations as rows (table_name, rule, row_key, violations).

    Row rules of a table run in one pass. A doubled key is reported once with
    the number of its rows.
    """
    found = [_row_rules(name, df) for name, df in tables.items()]
    for name, df in tables.items():
        found += [_doubled(name, df, key, "PRIMARY_KEY") for key in [PRIMARY_KEYS[name]]]
        found += [_doubled(name, df, key, "UNIQUE_" + "_".join(key).upper()) for key in UNIQUE_KEYS[name]]
    found += _orphans(tables)
    result = next(iter(found))
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def _key_text(columns: list[str]) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])


def _row_rules(name: str, df: DataFrame) -> DataFrame:
    rules = dict(checks()[name])
    if name == "gl_account" and "normal_balance" in df.columns:
        rules["NORMAL_BALANCE"] = ~F.col("normal_balance").isin(BALANCES)
    for column, longest in MAX_LENGTHS.get(name, {}).items():
        if column in df.columns:
            rules[f"LENGTH_{column.upper()}"] = F.length(column) > longest
    for column in REQUIRED[name]:
        if column in df.columns:
            rules[f"REQUIRED_{column.upper()}"] = F.col(column).isNull()
    names = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(broken, F.lit(rule)) for rule, broken in rules.items()]))
    return df.select(
        F.lit(name).alias("table_name"), F.explode(names).alias("rule"), _key_text(PRIMARY_KEYS[name]).alias("row_key"),
        F.lit(1).cast("long").alias("violations"),
    )


def _doubled(name: str, df: DataFrame, key: list[str], rule: str) -> DataFrame:
    return (
        df.groupBy(*key)
        .agg(F.count("*").alias("violations"))
        .filter("violations > 1")
        .select(F.lit(name).alias("table_name"), F.lit(rule).alias("rule"), _key_text(key).alias("row_key"), "violations")
    )


def _orphans(tables: dict[str, DataFrame]) -> list[DataFrame]:
    """Referencing values without a parent.

    One scan counts the values of all references of a table; only those counts
    meet the parents, dimensions in one join and large parents one by one.
    """
    present = [
        (child, column, parent, key)
        for child, column, parent, key in FOREIGN_KEYS
        if child in tables and parent in tables and column in tables[child].columns
    ]
    counted, parents, large = [], [], []
    for child in dict.fromkeys(fk[0] for fk in present):
        references = [fk for fk in present if fk[0] == child]
        values = F.array(
            *[F.struct(F.lit(column).alias("_column"), F.col(column).cast("long").alias("_value")) for _, column, _, _ in references]
        )
        counts = (
            tables[child]
            .select(F.inline(values))
            .filter(F.col("_value").isNotNull())
            .groupBy("_column", "_value")
            .agg(F.count("*").alias("violations"))
            .withColumn("table_name", F.lit(child))
        )
        big = [fk for fk in references if fk[2] in LARGE_TABLES]
        counted.append(counts.filter(~F.col("_column").isin([fk[1] for fk in big])) if big else counts)
        for _, column, parent, key in references:
            keys = tables[parent].select(F.col(key).cast("long").alias("_value"))
            if parent in LARGE_TABLES:
                large.append(counts.filter(F.col("_column") == column).join(keys, "_value", "left_anti"))
            else:
                parents.append(keys.select(F.lit(child).alias("table_name"), F.lit(column).alias("_column"), "_value"))

    def union(frames: list[DataFrame]) -> DataFrame:
        result = frames[0]
        for more in frames[1:]:
            result = result.unionByName(more)
        return result

    broken = list(large)
    if parents:
        broken.append(union(counted).join(union(parents), ["table_name", "_column", "_value"], "left_anti"))
    return [
        df.select(
            "table_name",
            F.concat(F.lit("FK_"), F.upper("_column")).alias("rule"),
            F.col("_value").cast("string").alias("row_key"),
            "violations",
        )
        for df in broken
    ]
