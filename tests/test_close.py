import datetime as dt
import json
from decimal import ROUND_HALF_UP, Decimal

import builders as b
import pytest
from pyspark.sql import functions as F

from finloom.plans import close
from finloom.plans.consolidation import consolidate_budget
from finloom.plans.reports import close_report
from finloom.schemas import JOURNAL
from finloom.sources.tables import cost_centers_as_of

TS = dt.datetime(2001, 1, 15)


def journals(spark, rows=()):
    return spark.createDataFrame([(i, f"J{i}", "ADJUSTMENT", 1, p, TS.date(), None, s) for i, (p, s) in enumerate(rows)], JOURNAL)


def history(centres):
    since, until = (F.lit(t).cast("timestamp") for t in ("1990-01-01", "9999-12-31"))
    return centres.withColumn("valid_from", since).withColumn("valid_to", until)


@pytest.fixture
def world(spark):
    centres = b.cost_centers(spark, [{"cost_center_id": 1, "parent_id": None, "code": "A"}, {"cost_center_id": 2, "parent_id": 1, "code": "B"}])
    accounts = b.accounts(
        spark,
        [{"gl_account_id": 101, "intercompany_flag": True, "consolidation_account_id": 102}, {"gl_account_id": 102, "intercompany_flag": True, "consolidation_account_id": 101},
         {"gl_account_id": 103, "intercompany_flag": True, "consolidation_account_id": 999}, {"gl_account_id": 20}],
    )
    rule = {"rule_id": 1, "basis": "EQUAL", "source_cost_center_id": 1, "account_pattern": "GL20", "target_spec": b.spec({"CostCenterID": 2})}
    return {
        "lines": b.lines(spark, [(1, 101, 1, 2, 50), (2, 102, 2, 2, -50), (3, 20, 1, 2, 8), (4, 20, 1, 1, 9)]),
        "headers": b.headers(spark, [{"header_id": 1, "version_number": 1}, {"header_id": 2, "version_number": 9, "status_code": "DRAFT"}]),
        "accounts": accounts,
        "cost_centers": centres,
        "cost_center_history": history(centres),
        "periods": b.periods(spark, [(1, 2000, 1, True), (2, 2000, 2), (3, 2000, 3)]),
        "rules": b.rules(spark, [rule]),
        "journals": journals(spark),
    }


def codes(spark, periods, journal_rows, period, **options):
    found = close.close_validations(b.periods(spark, periods), journals(spark, journal_rows), period, **options)
    return b.collect(found, "code", "severity", "blocks_close")


def test_validations(spark):
    periods = [(1, 2000, 1), (2, 2000, 2, True), (3, 2000, 3), (13, 2000, 13, False, True), (20, 2001, 1)]
    assert codes(spark, periods, [], 99) == [("INVALID_PERIOD", "ERROR", True)]
    assert codes(spark, periods, [], 2) == [("ALREADY_CLOSED", "ERROR", True)]
    assert codes(spark, periods, [], 2, force=True) == []
    assert codes(spark, periods, [], 3) == []
    assert codes(spark, periods, [], 3, close_type="HARD") == [("PRIOR_OPEN", "ERROR", True)]
    # neither the former year nor an adjustment period counts as prior
    assert codes(spark, periods, [], 20, close_type="HARD") == []
    pending = [(3, "DRAFT"), (3, "SUBMITTED"), (3, "POSTED"), (1, "DRAFT")]
    assert codes(spark, periods, pending, 3) == [("PENDING_JOURNALS", "WARNING", False)]
    assert codes(spark, [(3, 2000, 3)], pending, 3, close_type="FINAL") == [("PENDING_JOURNALS", "ERROR", True)]
    text = close.close_validations(b.periods(spark, periods), journals(spark, pending), 3).first()["message"]
    assert text == "2 pending journal(s) must be posted or rejected"


def test_active_budget(spark):
    periods = b.periods(spark, [(5, 2000, 5)])
    rows = [
        {"header_id": 1, "version_number": 3}, {"header_id": 2, "version_number": 3, "status_code": "LOCKED"},
        {"header_id": 3, "version_number": 7, "status_code": "DRAFT"}, {"header_id": 4, "version_number": 8, "start_period_id": 6},
    ]
    assert close.active_budget(b.headers(spark, rows), periods, 5).first()["header_id"] == 1
    assert close.active_budget(b.headers(spark, rows), periods, 4).count() == 0


def test_consolidation_options_reach_the_close(spark, world):
    def amounts(**options):
        done = close.close_period(**world, fiscal_period_id=2, run_id="r", run_ts=TS, run_allocations=False, run_reconciliation=False, **options)
        lines = done.frames["consolidated_lines"]
        known = world["lines"].agg(F.max("line_id")).first()[0]
        ids = sorted(r["line_id"] for r in lines.collect())
        assert ids == list(range(known + 1, known + 1 + len(ids)))
        return sorted(r["original_amount"] for r in lines.collect())

    plain = amounts()
    assert amounts(rounding=-1) == sorted(x.quantize(Decimal('1E1'), ROUND_HALF_UP) for x in plain)
    assert amounts(include_zero=False) == [x for x in plain if x != 0]
    assert len(amounts(include_eliminations=False)) == len(plain)


def test_soft_close(spark, world):
    done = close.close_period(**world, fiscal_period_id=2, run_id="run-0001", run_ts=TS)
    assert done.status == "COMPLETED"
    assert [(s.name, s.status, s.rows) for s in done.steps] == [
        ("Period Validation", "COMPLETED", 0),
        ("Create Snapshot", "COMPLETED", 2),
        ("Budget Consolidation", "COMPLETED", 4),
        ("Cost Allocations", "COMPLETED", 1),
        ("Intercompany Reconciliation", "COMPLETED", 0),
        ("Lock Period", "COMPLETED", 2),
    ]
    assert b.collect(done.periods, "fiscal_period_id", "is_closed") == [(1, True), (2, True), (3, False)]
    assert b.collect(done.headers, "header_id", "status_code") == [(1, "LOCKED"), (2, "DRAFT")]
    assert done.headers.filter("header_id = 1").first()["locked_at"] == TS
    assert b.collect(done.frames["allocation_results"], "target_cost_center_id", "amount") == [(2, 8)]
    report = json.loads(close_report(spark, done, "run-0001", 2, "SOFT").first()["document"])
    assert report["summary"]["completed_steps"] == 6 and report["summary"]["consolidated_header_id"] == 1000


def with_open_pair(spark, world):
    return {**world, "lines": world["lines"].unionByName(b.lines(spark, [(9, 103, 1, 2, 77)]))}


def test_soft_close_warns_about_open_pairs(spark, world):
    done = close.close_period(**with_open_pair(spark, world), fiscal_period_id=2, run_id="run-0001", run_ts=TS)
    step = next(s for s in done.steps if s.name == "Intercompany Reconciliation")
    assert done.status == "COMPLETED" and (step.status, step.rows) == ("WARNING", 1)
    assert step.message == "1 unreconciled items, variance: 77.00"
    assert b.collect(done.frames["journal_lines"], "debit_amount") == [(77,)]


def test_final_close_fails_on_open_pairs(spark, world):
    done = close.close_period(**with_open_pair(spark, world), fiscal_period_id=2, run_id="run-0001", run_ts=TS, close_type="FINAL")
    assert done.status == "FAILED" and "journal" not in done.frames
    assert done.steps[-1].name == "ERROR_HANDLER"
    assert b.collect(done.periods.filter("fiscal_period_id = 2"), "is_closed") == [(False,)]


def test_blocked_close_does_nothing(spark, world):
    done = close.close_period(**world, fiscal_period_id=1, run_id="r", run_ts=TS)
    assert done.status == "VALIDATION_FAILED" and [s.name for s in done.steps] == ["Period Validation"]


def test_close_without_consolidation_uses_active_budget(spark, world):
    done = close.close_period(**world, fiscal_period_id=2, run_id="r", run_ts=TS, run_consolidation=False, run_reconciliation=False)
    assert [s.name for s in done.steps][2:] == ["Cost Allocations", "Lock Period"]
    assert done.frames["allocation_results"].count() == 1


def test_close_without_budget(spark, world):
    none = {**world, "headers": world["headers"].filter("header_id = 2")}
    done = close.close_period(**none, fiscal_period_id=2, run_id="r", run_ts=TS)
    assert [(s.name, s.status) for s in done.steps][2] == ("Budget Consolidation", "SKIPPED")


def test_consolidation_gate_and_header(spark, world):
    args = (world["lines"], world["headers"], world["accounts"], world["cost_centers"])
    with pytest.raises(ValueError, match="APPROVED or LOCKED"):
        consolidate_budget(*args, 2, 50, TS.date(), "r", TS)
    with pytest.raises(ValueError, match="not found: 7"):
        consolidate_budget(*args, 7, 50, TS.date(), "r", TS)
    header = consolidate_budget(*args, 1, 50, TS.date(), "r-1", TS).header.first()
    assert (header["header_id"], header["budget_code"], header["budget_name"]) == (50, "B_CONSOL_20010115", "Budget - Consolidated")
    assert (header["base_header_id"], header["status_code"], header["version_number"]) == (1, "DRAFT", 1)
    assert header["extended_properties"].startswith('<Root><ConsolidationRun RunID="r-1" SourceID="1"')


def test_as_of(spark):
    centres = b.cost_centers(spark, [(1, None)])
    old = centres.withColumn("name", F.lit("old")).withColumn("valid_from", F.lit("1990-01-01").cast("timestamp")).withColumn("valid_to", F.lit("2000-01-01").cast("timestamp"))
    new = centres.withColumn("valid_from", F.lit("2000-01-01").cast("timestamp")).withColumn("valid_to", F.lit("9999-12-31").cast("timestamp"))
    both = old.unionByName(new)
    assert cost_centers_as_of(both, dt.datetime(1999, 12, 31, 23, 59)).first()["name"] == "old"
    assert cost_centers_as_of(both, dt.datetime(2000, 1, 1)).first()["name"] == "N1"
    assert cost_centers_as_of(both, dt.datetime(1980, 1, 1)).count() == 0
