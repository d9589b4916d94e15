"""Row types of the planning model."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(19, 4)
FINAL = T.DecimalType(20, 4)
TOTAL = T.DecimalType(38, 4)
WEIGHT = T.DecimalType(5, 4)
RATE = T.DecimalType(8, 6)
FACTOR = T.DecimalType(18, 10)

NATURAL_KEY = ["header_id", "gl_account_id", "cost_center_id", "fiscal_period_id"]
LINE_KEY = NATURAL_KEY[1:]


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], f[2] if len(f) > 2 else True) for f in fields])


FISCAL_PERIOD = _struct(
    ("fiscal_period_id", T.IntegerType()),
    ("fiscal_year", T.IntegerType()),
    ("fiscal_quarter", T.IntegerType()),
    ("fiscal_month", T.IntegerType()),
    ("period_name", T.StringType()),
    ("period_start", T.DateType()),
    ("period_end", T.DateType()),
    ("is_closed", T.BooleanType()),
    ("is_adjustment", T.BooleanType()),
)

COST_CENTER = _struct(
    ("cost_center_id", T.IntegerType()),
    ("code", T.StringType()),
    ("name", T.StringType()),
    ("parent_id", T.IntegerType()),
    ("weight", WEIGHT),
    ("is_active", T.BooleanType()),
    ("effective_from", T.DateType()),
    ("effective_to", T.DateType()),
)

GL_ACCOUNT = _struct(
    ("gl_account_id", T.IntegerType()),
    ("account_number", T.StringType()),
    ("account_name", T.StringType()),
    ("account_type", T.StringType()),
    ("is_budgetable", T.BooleanType()),
    ("intercompany_flag", T.BooleanType()),
    ("consolidation_account_id", T.IntegerType()),
)

BUDGET_HEADER = _struct(
    ("header_id", T.IntegerType()),
    ("budget_code", T.StringType()),
    ("budget_name", T.StringType()),
    ("budget_type", T.StringType()),
    ("scenario_type", T.StringType()),
    ("status_code", T.StringType()),
    ("version_number", T.IntegerType()),
    ("fiscal_year", T.IntegerType()),
    ("start_period_id", T.IntegerType()),
    ("end_period_id", T.IntegerType()),
    ("base_header_id", T.IntegerType()),
    ("extended_properties", T.StringType()),
    ("locked_at", T.TimestampType()),
)

BUDGET_LINE_ITEM = _struct(
    ("line_id", T.LongType()),
    ("header_id", T.IntegerType()),
    ("gl_account_id", T.IntegerType()),
    ("cost_center_id", T.IntegerType()),
    ("fiscal_period_id", T.IntegerType()),
    ("original_amount", MONEY),
    ("adjusted_amount", MONEY),
    ("final_amount", FINAL),
    ("local_currency_amount", MONEY),
    ("reporting_currency_amount", MONEY),
    ("spread_method", T.StringType()),
    ("source_system", T.StringType()),
    ("source_reference", T.StringType()),
    ("is_allocated", T.BooleanType()),
    ("allocation_source_line_id", T.LongType()),
    ("allocation_pct", T.DecimalType(18, 6)),
)

ALLOCATION_RULE = _struct(
    ("rule_id", T.IntegerType()),
    ("rule_code", T.StringType()),
    ("rule_name", T.StringType()),
    ("rule_type", T.StringType()),
    ("allocation_method", T.StringType()),
    ("source_cost_center_id", T.IntegerType()),
    ("cc_pattern", T.StringType()),
    ("account_pattern", T.StringType()),
    ("target_spec", T.StringType()),
    ("basis", T.StringType()),
    ("rounding", T.StringType()),
    ("sequence", T.IntegerType()),
    ("depends_on", T.IntegerType()),
    ("effective_from", T.DateType()),
    ("effective_to", T.DateType()),
    ("is_active", T.BooleanType()),
)

JOURNAL = _struct(
    ("journal_id", T.LongType()),
    ("journal_number", T.StringType()),
    ("journal_type", T.StringType()),
    ("header_id", T.IntegerType()),
    ("fiscal_period_id", T.IntegerType()),
    ("posting_date", T.DateType()),
    ("description", T.StringType()),
    ("status_code", T.StringType()),
)

JOURNAL_LINE = _struct(
    ("journal_id", T.LongType()),
    ("line_number", T.IntegerType()),
    ("gl_account_id", T.IntegerType()),
    ("cost_center_id", T.IntegerType()),
    ("debit_amount", MONEY),
    ("credit_amount", MONEY),
    ("description", T.StringType()),
)

# Caller-supplied import rows whose ids are already known.
IMPORT_ROWSET = _struct(
    ("gl_account_id", T.IntegerType()),
    ("cost_center_id", T.IntegerType()),
    ("fiscal_period_id", T.IntegerType()),
    ("original_amount", MONEY),
    ("adjusted_amount", MONEY),
    ("spread_method", T.StringType()),
    ("notes", T.StringType()),
)

# Import rows that carry codes instead of ids (files, staging tables).
IMPORT_CODES = _struct(
    ("account_number", T.StringType()),
    ("cost_center_code", T.StringType()),
    ("fiscal_year", T.IntegerType()),
    ("fiscal_month", T.IntegerType()),
    ("original_amount", MONEY),
    ("adjusted_amount", MONEY),
    ("spread_method", T.StringType()),
    ("notes", T.StringType()),
)

ALLOCATION_RESULT = _struct(
    ("source_line_id", T.LongType()),
    ("target_cost_center_id", T.IntegerType()),
    ("target_gl_account_id", T.IntegerType()),
    ("amount", MONEY),
    ("pct", T.DecimalType(18, 6)),
    ("rule_id", T.IntegerType()),
    ("sequence", T.IntegerType()),
)

HIERARCHY_NODE = _struct(
    ("node_id", T.IntegerType()),
    ("parent_node_id", T.IntegerType()),
    ("node_level", T.IntegerType()),
    ("node_path", T.StringType()),
    ("sort_order", T.IntegerType()),
    ("is_leaf", T.BooleanType()),
    ("aggregation_weight", RATE),
)
