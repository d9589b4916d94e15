import hashlib
from decimal import Decimal

import builders as b

from finloom.functions.columns import with_model_columns
from finloom.operators import summary
from finloom.operators.quality import validate_model


def dims(spark):
    accounts = b.accounts(spark, [{"gl_account_id": 10, "account_type": "R"}, {"gl_account_id": 20}])
    centres = b.cost_centers(spark, [(1, None), (2, 1)])
    periods = b.periods(spark, [(1, 2000, 1), (2, 2001, 1)])
    return accounts, centres, periods


def test_variance_cases(spark):
    frame = b.lines(
        spark,
        [(1, 10, 1, 1, 100, 1), (2, 10, 1, 1, 250, 2), (3, 10, 2, 1, 50, 1), (4, 20, 1, 1, 7, 2), (5, 20, 2, 1, 3, 1), (6, 20, 2, 1, 3, 2),
         (7, 20, 2, 2, 5, 1), (8, 20, 2, 2, 4, 2), (9, 20, 2, 2, 99, 3)],
    )
    one = b.collect(summary.variance_one_pass(frame, 1, 2))
    assert one == b.collect(summary.variance_full_join(frame, 1, 2).select(summary.variance_one_pass(frame, 1, 2).columns))
    got = {r[:3]: r[5:] for r in one}
    assert got[10, 1, 1] == (150, 150.0, "FAVORABLE", 1)
    assert got[10, 2, 1] == (-50, -100.0, "UNFAVORABLE", 0)  # exactly the limit
    assert got[20, 1, 1] == (7, None, "FAVORABLE", 0)  # no base, no percentage
    assert got[20, 2, 1] == (0, 0.0, "ON_TARGET", 0)
    named = summary.budget_variance(frame, *dims(spark), 1, 2, fiscal_year=2001, cost_center_id=2, threshold_pct=10)
    assert b.collect(named, "gl_account_id", "period_name", "exceeds_threshold") == [(20, "P2001-01", 1)]
    assert b.collect(summary.budget_variance(frame, *dims(spark), 1, 2, account_type="R"), "cost_center_id") == [(1,), (2,)]


def test_summary(spark):
    frame = b.lines(spark, [(1, 10, 1, 1, 5), (2, 10, 1, 1, 6), (3, 10, 1, 1, 7, 2), (4, 99, 1, 1, 8)])
    headers = b.headers(spark, [{"header_id": 1}, {"header_id": 2, "budget_code": "C"}])
    accounts, centres, periods = dims(spark)
    result = summary.budget_summary(frame, headers, accounts, centres, periods)
    # account 99 is unknown and drops out
    assert b.collect(result, "header_id", "total_final_amount", "line_item_count") == [(1, 11, 2), (2, 7, 1)]


def test_model_columns(spark):
    row = with_model_columns(b.lines(spark, [(1, 10, 2, 3, "4.5")])).first()
    assert row["row_hash"] == hashlib.sha256(b"10|2|3|4.5000").hexdigest() and row["final_amount"] == Decimal("4.5")


def test_violations(spark):
    accounts = b.accounts(spark, [{"gl_account_id": 10, "account_type": "Q"}, {"gl_account_id": 11, "account_number": "GL10"}])
    centres = b.cost_centers(spark, [{"cost_center_id": 1, "parent_id": 5, "weight": "1.5"}, {"cost_center_id": 2, "parent_id": 1, "code": "x" * 21}])
    frame = b.lines(spark, [(1, 10, 1, 1, 5), (2, 10, 1, 1, 6), (3, 77, 1, 1, 6), (4, 77, 2, 1, 6)])
    rules = b.rules(spark, [{"rule_id": 1, "rounding": "HALF", "depends_on": 9}])
    tables = {
        "gl_account": accounts, "cost_center": centres, "budget_line_item": frame, "allocation_rule": rules,
        "fiscal_period": b.periods(spark, [(1, 2000, 1), (2, 2000, 14)]),
        "budget_header": b.headers(spark, [{"header_id": 1, "status_code": "OPEN", "end_period_id": 2}]),
    }
    assert b.collect(validate_model(tables)) == [
        ("allocation_rule", "FK_DEPENDS_ON", "9", 1),
        ("allocation_rule", "ROUNDING", "1", 1),
        ("budget_header", "STATUS", "1", 1),
        ("budget_line_item", "FK_GL_ACCOUNT_ID", "77", 2),
        ("budget_line_item", "UNIQUE_HEADER_ID_GL_ACCOUNT_ID_COST_CENTER_ID_FISCAL_PERIOD_ID", "1|10|1|1", 2),
        ("cost_center", "FK_PARENT_ID", "5", 1),
        ("cost_center", "LENGTH_CODE", "2", 1),
        ("cost_center", "WEIGHT_RANGE", "1", 1),
        ("fiscal_period", "MONTH_RANGE", "2", 1),
        ("gl_account", "ACCOUNT_TYPE", "10", 1),
        ("gl_account", "UNIQUE_ACCOUNT_NUMBER", "GL10", 2),
    ]


def test_required_values_lengths_and_references(spark):
    accounts = b.accounts(spark, [{"gl_account_id": 10}]).selectExpr("*", "99 AS parent_account_id")
    lines = b.lines(spark, [(1, 10, 1, 1, 5)]).selectExpr("* EXCEPT (source_system, adjusted_amount, is_allocated)", "repeat('s', 31) AS source_system", "CAST(NULL AS decimal(19,4)) AS adjusted_amount", "CAST(NULL AS boolean) AS is_allocated")
    journal = spark.createDataFrame([(1, "J1", "ADJUSTMENT", 1, 1, b.DAY, None, "DRAFT", 7, 8)], "journal_id long, journal_number string, journal_type string, header_id int, fiscal_period_id int, posting_date date, description string, status_code string, reversal_period_id int, reversed_from_journal_id long")
    tables = {
        "gl_account": accounts, "budget_line_item": lines, "journal": journal, "cost_center": b.cost_centers(spark, [(1, None)]),
        "fiscal_period": b.periods(spark, [(1, 2000, 1)]), "budget_header": b.headers(spark, [{"header_id": 1, "end_period_id": 1}]),
    }
    assert b.collect(validate_model(tables)) == [
        ("budget_line_item", "LENGTH_SOURCE_SYSTEM", "1", 1),
        ("budget_line_item", "REQUIRED_ADJUSTED_AMOUNT", "1", 1),
        ("budget_line_item", "REQUIRED_IS_ALLOCATED", "1", 1),
        ("gl_account", "FK_PARENT_ACCOUNT_ID", "99", 1),
        ("journal", "FK_REVERSAL_PERIOD_ID", "7", 1),
        ("journal", "FK_REVERSED_FROM_JOURNAL_ID", "8", 1),
    ]
