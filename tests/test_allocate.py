import datetime as dt
from decimal import Decimal

import builders as b
import pytest

from finloom.operators import allocate
from finloom.sources.documents import rule_targets

SELF_SPEC = [{"CostCenterID": 2}]


@pytest.fixture(scope="module")
def centres(spark):
    rows = [
        {"cost_center_id": 1, "parent_id": None, "code": "R1"},
        {"cost_center_id": 2, "parent_id": 1, "code": "R1-A", "weight": "0.25"},
        {"cost_center_id": 3, "parent_id": 1, "code": "R1-B", "weight": "0.75"},
        {"cost_center_id": 4, "parent_id": 1, "code": "R2-C", "weight": "0.5", "is_active": False},
        {"cost_center_id": 5, "parent_id": None, "code": "X_1"},
        {"cost_center_id": 6, "parent_id": None, "code": "XA1"},
    ]
    return b.cost_centers(spark, rows)


@pytest.fixture(scope="module")
def accounts(spark):
    return b.accounts(spark, [{"gl_account_id": 10, "account_type": "R"}, {"gl_account_id": 20, "account_type": "X"}])


def factors(spark, centres, accounts, frame, requests):
    asked = spark.createDataFrame(requests, "source_id int, target_id int, basis string, fiscal_period_id int")
    got = allocate.allocation_factor(asked, frame, accounts, centres).collect()
    return {(r["source_id"], r["target_id"], r["basis"], r["fiscal_period_id"]): r["factor"] for r in got}


def test_factors(spark, centres, accounts):
    frame = b.lines(spark, [(1, 10, 1, 1, 10), (2, 10, 2, 1, 30), (3, 10, 3, 1, 60), (4, 20, 2, 1, 5), (5, 10, 2, 2, 5), (6, 10, 1, 2, -5)])
    got = factors(
        spark, centres, accounts, frame,
        [(1, 2, "REVENUE", 1), (1, 2, "EXPENSE", 1), (1, 3, "EXPENSE", 1), (1, 2, "HEADCOUNT", 1), (1, 4, "HEADCOUNT", 1),
         (1, 2, "EQUAL", 1), (2, 3, "EQUAL", 1), (1, 2, "OTHER", 1), (1, 2, "REVENUE", 2), (2, 5, "REVENUE", 1), (1, 2, None, 1)],
    )
    assert got[1, 2, "REVENUE", 1] == Decimal("0.3")  # 30 of 10 + 30 + 60
    assert got[1, 2, "EXPENSE", 1] == 1
    assert got[1, 3, "EXPENSE", 1] == 0  # target has no value
    assert got[1, 2, "HEADCOUNT", 1] == Decimal("0.25")  # only active children count
    assert got[1, 4, "HEADCOUNT", 1] == 0  # inactive target
    assert got[1, 2, "EQUAL", 1] == Decimal("0.5")
    assert got[2, 3, "EQUAL", 1] == 0  # no children
    assert got[1, 2, "OTHER", 1] == 0
    assert got[1, 2, "REVENUE", 2] == 0  # the total cancels out
    assert got[2, 5, "REVENUE", 1] == 0
    assert got[1, 2, None, 1] is None


def sources(spark, centres, accounts, rule, frame=None):
    frame = frame if frame is not None else b.lines(spark, [(i, 10 if i < 10 else 20, i % 10, 1, 5) for i in (1, 2, 3, 5, 6, 12)])
    return [r[0] for r in b.collect(allocate.rule_sources(frame, b.rules(spark, [{"rule_id": 1, **rule}]), centres, accounts), "line_id")]


def test_patterns(spark, centres, accounts):
    assert sources(spark, centres, accounts, {"cc_pattern": "R1-%"}) == [2, 3, 12]
    assert sources(spark, centres, accounts, {"cc_pattern": r"X\_%"}) == [5]
    assert sources(spark, centres, accounts, {"cc_pattern": "X_1"}) == [5, 6]
    assert sources(spark, centres, accounts, {"cc_pattern": "%1"}) == [1, 5, 6]
    assert sources(spark, centres, accounts, {"account_pattern": "GL2_"}) == [12]
    assert sources(spark, centres, accounts, {"cc_pattern": "R1-%", "account_pattern": "GL1%"}) == [2, 3]
    assert sources(spark, centres, accounts, {"source_cost_center_id": 2, "cc_pattern": "R1-B"}) == []
    assert sources(spark, centres, accounts, {"source_cost_center_id": 2, "account_pattern": "GL20"}) == [12]
    assert sources(spark, centres, accounts, {}) == [1, 2, 3, 5, 6, 12]


def test_zero_and_allocated_lines_are_left_out(spark, centres, accounts):
    from pyspark.sql import functions as F

    frame = b.lines(spark, [(1, 10, 2, 1, 0), (2, 10, 2, 2, 5), (3, 10, 2, 3, 5)]).withColumn("is_allocated", F.col("line_id") == 3)
    assert sources(spark, centres, accounts, {}, frame) == [2]


def test_rule_list():
    assert allocate.parse_rule_ids(" 1, x,3 ,, -4") == [1, 3, -4]
    assert allocate.parse_rule_ids(None) is None


def test_targets_by_id_or_code(spark, centres):
    text = b.spec({"CostCenterID": 2, "CostCenterCode": "R1-B"}, {"CostCenterCode": "R1-A"}, {"CostCenterCode": "GONE"}, {"CostCenterID": 2, "CostCenterCode": "R1-A"})
    frame = allocate.target_centres(rule_targets(b.rules(spark, [{"rule_id": 1, "target_spec": text}])), centres)
    got = sorted((r["target_id"] or 0, r["target_code"] or "", r["joined_id"] or 0) for r in frame.collect())
    assert got == [(0, "GONE", 0), (0, "R1-A", 2), (2, "R1-A", 2), (2, "R1-B", 2), (2, "R1-B", 3)]


def test_xml_children(spark):
    text = (
        '<AllocationTargets><Target CostCenterID="1" Priority="3"><AccountFilter>GL%</AccountFilter>'
        "<Conditions><Condition>a</Condition><Condition>b</Condition></Conditions></Target>"
        '<Target CostCenterCode="Z" AllocationPercentage="0.5"/></AllocationTargets>'
    )
    rows = rule_targets(b.rules(spark, [{"rule_id": 1, "target_spec": text}, {"rule_id": 2}])).collect()
    assert [(r["target_id"], r["target_code"], r["target_pct"], r["priority"], r["account_filter"], r["has_conditions"]) for r in rows] == [
        (1, None, None, 3, "GL%", True),
        (None, "Z", Decimal("0.5"), None, None, False),
    ]
    assert rows[0]["conditions"] == ["a", "b"]


def results(spark, centres, accounts, rules, frame, **options):
    return allocate.allocation_results(frame, b.rules(spark, rules), centres, accounts, **options)


def test_rounding_modes(spark, centres, accounts):
    frame = b.lines(spark, [(1, 20, 1, 1, "100.01"), (2, 20, 1, 2, "-100.01")])
    pct = b.spec({"CostCenterID": 2, "AllocationPercentage": "0.333"})
    rules = [
        {"rule_id": i, "rounding": mode, "basis": "EQUAL", "target_spec": pct, "source_cost_center_id": 1}
        for i, mode in enumerate(("UP", "DOWN", "NEAREST", "NONE"))
    ]
    got = {(r["rule_id"], r["source_line_id"]): (r["amount"], r["pct"]) for r in results(spark, centres, accounts, rules, frame).collect()}
    third = Decimal("0.333")
    assert got[0, 1] == (Decimal("33.31"), third) and got[1, 1] == (Decimal("33.30"), third)  # 33.30333
    assert got[0, 2] == (Decimal("-33.30"), third) and got[1, 2] == (Decimal("-33.31"), third)
    # every other mode takes the driver's half, though the percentage is what is recorded
    assert got[2, 1] == (Decimal("50.01"), third) and got[3, 1] == got[2, 1]
    first = results(spark, centres, accounts, rules, frame, pct_first=True).filter("rule_id = 2 and source_line_id = 1").first()
    assert first["amount"] == Decimal("33.30")


def test_dependencies(spark, centres, accounts):
    frame = b.lines(spark, [(1, 20, 1, 1, 100)])
    target = b.spec({"CostCenterID": 2})
    base = {"source_cost_center_id": 1, "basis": "EQUAL", "target_spec": target}
    rules = [
        {"rule_id": 1, **base}, {"rule_id": 2, **base, "depends_on": 1}, {"rule_id": 3, **base, "depends_on": 2},
        {"rule_id": 4, **base, "depends_on": 99}, {"rule_id": 5, **base, "is_active": False},
        {"rule_id": 6, **base, "depends_on": 5}, {"rule_id": 7, **base, "depends_on": 8}, {"rule_id": 8, **base, "depends_on": 7},
        {"rule_id": 9, **base, "source_cost_center_id": 3}, {"rule_id": 10, **base, "depends_on": 9},
        {"rule_id": 11, **base, "target_spec": b.spec({"CostCenterCode": "R2-C"})}, {"rule_id": 12, **base, "depends_on": 11},
    ]
    got = [r[0] for r in b.collect(results(spark, centres, accounts, rules, frame), "rule_id")]
    # 4: absent parent, 6: inactive parent, 7-8: cycle, 10: parent without lines, 12: parent without active target
    assert got == [1, 2, 3]
    chosen = results(spark, centres, accounts, rules, frame, rule_ids=[2, 9])
    assert b.collect(chosen, "rule_id") == []


def test_chains_of_any_length(spark):
    rows = [{"rule_id": i, "depends_on": i - 1 if i > 1 else None} for i in range(1, 301)]
    rows += [{"rule_id": 400, "depends_on": 402}, {"rule_id": 401, "depends_on": 400}, {"rule_id": 402, "depends_on": 401}, {"rule_id": 403, "depends_on": 401}]
    rules = b.rules(spark, rows)
    got = [r[0] for r in b.collect(allocate.eligible_rules(rules, rules.select("rule_id")), "rule_id")]
    assert got == list(range(1, 301))  # and none of the cycle or behind it
    short = [r[0] for r in b.collect(allocate.eligible_rules(rules, rules.select("rule_id").filter("rule_id <> 290")), "rule_id")]
    assert short == list(range(1, 291))


def test_lines_without_a_flag_are_open(spark, centres, accounts):
    from pyspark.sql import functions as F

    frame = b.lines(spark, [(1, 10, 2, 1, 5)]).withColumn("is_allocated", F.lit(None).cast("boolean"))
    assert sources(spark, centres, accounts, {}, frame) == [1]


def test_dates_only_on_request(spark, centres, accounts):
    frame = b.lines(spark, [(1, 20, 1, 1, 100)])
    rules = [{"rule_id": 1, "basis": "EQUAL", "target_spec": b.spec({"CostCenterID": 2}), "effective_to": dt.date(2000, 2, 1)}]
    assert results(spark, centres, accounts, rules, frame).count() == 1
    assert results(spark, centres, accounts, rules, frame, enforce_dates_on=dt.date(2001, 1, 1)).count() == 0


def test_run_marks_sources_and_drops_collisions(spark, centres, accounts):
    frame = b.lines(spark, [(1, 20, 1, 1, 100), (2, 20, 3, 1, 8), (3, 20, 2, 2, 1)])
    rules = [
        {"rule_id": 1, "basis": "EQUAL", "source_cost_center_id": 1, "sequence": 20, "target_spec": b.spec({"CostCenterID": 2}, {"CostCenterCode": "R1-B"})},
        {"rule_id": 2, "rounding": "UP", "source_cost_center_id": 3, "sequence": 10, "target_spec": b.spec({"CostCenterCode": "R1-A", "AllocationPercentage": "0.5"})},
    ]
    run = allocate.allocate_costs(frame, 1, b.rules(spark, rules), centres, accounts)
    assert b.collect(run.results, "rule_id", "target_cost_center_id", "amount") == [(1, 2, 50), (1, 3, 50), (2, 2, 4)]
    # rule 2 comes first on centre 2; centre 3 already has a line
    assert b.collect(run.lines, "cost_center_id", "original_amount", "allocation_source_line_id") == [(2, 4, 2)]
    assert b.collect(run.ledger, "rule_id", "cost_center_id", "outcome", "winner_line_id", "kept_line_id") == [
        (1, 2, "COLLISION", 2, None), (1, 3, "EXISTS", None, 2), (2, 2, "INSERT", 2, None)]
    assert b.collect(allocate.ledger_totals(run.ledger)) == [("COLLISION", 1, 50), ("EXISTS", 1, 50), ("INSERT", 1, 4)]
    assert b.collect(run.marked, "line_id", "is_allocated") == [(1, True), (2, True), (3, False)]
    assert b.collect(run.totals) == [(1, 100, 2), (2, 4, 1)]
    again = allocate.allocation_results(run.marked, b.rules(spark, rules), centres, accounts)
    assert again.count() == 0


def test_equal_results_are_inserted_once(spark):
    row = (7, 2, 20, 5, None, 1, 10, 1, 1)
    schema = "source_line_id long, target_cost_center_id int, target_gl_account_id int, amount decimal(19,4), pct decimal(18,6), rule_id int, sequence int, priority int, fiscal_period_id int"
    found = spark.createDataFrame([(*row[:3], Decimal(5), *row[4:])] * 400 + [(8, 3, 20, Decimal(5), *row[4:])], schema).repartition(5)
    ledger = allocate.allocation_ledger(found, 1, b.lines(spark, []))
    assert b.collect(allocate.ledger_totals(ledger)) == [("COLLISION", 399, 1995), ("INSERT", 2, 10)]
    assert allocate.allocated_lines(ledger, b.lines(spark, [])).count() == 2
