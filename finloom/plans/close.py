"""Period close: checks, snapshot, consolidation, allocation, reconciliation, lock."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finloom.operators.allocate import allocated_lines, allocation_ledger, allocation_results, mark_allocated
from finloom.operators.sinks import new_lines
from finloom.plans.consolidation import consolidate_budget
from finloom.plans.reconciliation import reconcile_intercompany
from finloom.schemas import LINE_KEY
from finloom.session import materialise
from finloom.sources.tables import cost_centers_as_of


def active_budget(headers: DataFrame, periods: DataFrame, fiscal_period_id: int) -> DataFrame:
    """The approved or locked budget of the highest version spanning the period; the lowest id breaks ties."""
    wanted = F.lit(fiscal_period_id)
    known = periods.filter(F.col("fiscal_period_id") == wanted).agg(F.count("*")).scalar() > 0
    return (
        headers.filter(F.col("status_code").isin("APPROVED", "LOCKED") & wanted.between(F.col("start_period_id"), F.col("end_period_id")))
        .filter(known)
        .orderBy(F.col("version_number").desc(), "header_id")
        .limit(1)
    )


def close_validations(
    periods: DataFrame, journals: DataFrame, fiscal_period_id: int, close_type: str = "SOFT", force: bool = False
) -> DataFrame:
    """Findings (code, message, severity, blocks_close) before a close; none means ready."""
    period = periods.filter(F.col("fiscal_period_id") == fiscal_period_id)
    final = close_type == "FINAL"

    def finding(df: DataFrame, code: str, message, severity: str = "ERROR", blocks: bool = True) -> DataFrame:
        text = F.lit(message) if isinstance(message, str) else message
        return df.select(
            F.lit(code).alias("code"), text.alias("message"), F.lit(severity).alias("severity"), F.lit(blocks).alias("blocks_close")
        )

    counted = period.agg(F.count("*").alias("n"))
    findings = finding(counted.filter("n = 0"), "INVALID_PERIOD", f"Fiscal period not found: {fiscal_period_id}")
    if not force:
        findings = findings.unionByName(
            finding(period.filter("is_closed"), "ALREADY_CLOSED", "Period is already closed. Use force=True to reprocess.")
        )
    if close_type in ("HARD", "FINAL"):
        this = period.select(F.col("fiscal_year").alias("_year"), F.col("fiscal_month").alias("_month"))
        earlier = (
            periods.filter(~F.col("is_closed") & ~F.col("is_adjustment"))
            .join(this, (F.col("fiscal_year") == F.col("_year")) & (F.col("fiscal_month") < F.col("_month")), "left_semi")
            .agg(F.count("*").alias("n"))
        )
        findings = findings.unionByName(
            finding(earlier.filter("n > 0"), "PRIOR_OPEN", f"Prior periods must be closed before {close_type} close")
        )
    pending = (
        journals.filter((F.col("fiscal_period_id") == fiscal_period_id) & F.col("status_code").isin("DRAFT", "SUBMITTED"))
        .join(period.select("fiscal_period_id"), "fiscal_period_id", "left_semi")
        .agg(F.count("*").alias("n"))
    )
    message = F.concat(F.col("n").cast("string"), F.lit(" pending journal(s) must be posted or rejected"))
    return findings.unionByName(
        finding(pending.filter("n > 0"), "PENDING_JOURNALS", message, "ERROR" if final else "WARNING", final)
    )


def lock_period(periods: DataFrame, headers: DataFrame, fiscal_period_id: int, run_ts: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """Periods with this one closed, and headers with the approved budgets spanning it locked."""
    closed = periods.withColumn("is_closed", F.col("is_closed") | (F.col("fiscal_period_id") == fiscal_period_id))
    spans = (F.col("status_code") == "APPROVED") & F.lit(fiscal_period_id).between(F.col("start_period_id"), F.col("end_period_id"))
    locked_at = F.lit(run_ts).cast(headers.schema["locked_at"].dataType)
    locked = headers.withColumn("locked_at", F.when(spans, locked_at).otherwise(F.col("locked_at"))).withColumn(
        "status_code", F.when(spans, "LOCKED").otherwise(F.col("status_code"))
    )
    return closed, locked


class Step(NamedTuple):
    name: str
    status: str
    rows: int | None
    message: str | None


class Close(NamedTuple):
    status: str
    validations: DataFrame
    steps: list[Step]
    periods: DataFrame
    headers: DataFrame
    frames: dict[str, DataFrame]
    metrics: dict[str, object]


class CloseBlocked(RuntimeError):
    """A step of a FINAL close failed."""


def close_period(
    lines: DataFrame,
    headers: DataFrame,
    accounts: DataFrame,
    cost_centers: DataFrame,
    cost_center_history: DataFrame,
    periods: DataFrame,
    rules: DataFrame,
    journals: DataFrame,
    fiscal_period_id: int,
    run_id: str,
    run_ts: dt.datetime,
    close_type: str = "SOFT",
    run_consolidation: bool = True,
    run_allocations: bool = True,
    run_reconciliation: bool = True,
    force: bool = False,
    new_header_id: int = 1000,
    journal_id: int = 1,
    elimination_mode: str = "corrected",
    max_depth: int = 10,
    include_eliminations: bool = True,
    include_zero: bool = True,
    rounding: int | None = None,
) -> Close:
    """Run the close. Only step counts and the findings come to the driver.

    ``include_eliminations``, ``include_zero`` and ``rounding`` are those of the consolidation.

    Cost centres below ``max_depth`` are not consolidated; the frame
    ``left_out_lines`` has the lines of all centres left out, ``marked_lines``
    the lines with the flags that the allocation sets.

    A failed step is recorded and the close goes on, except in a FINAL close,
    where it ends the close as FAILED.
    """
    steps: list[Step] = []
    frames: dict[str, DataFrame] = {}
    metrics: dict[str, object] = {"consolidated_header_id": None, "unreconciled": None, "total_variance": None}
    validations = close_validations(periods, journals, fiscal_period_id, close_type, force)
    findings = validations.collect()  # at most four rows
    blocked = any(f["blocks_close"] for f in findings)
    steps.append(Step("Period Validation", "FAILED" if blocked else "COMPLETED", len(findings), None))
    if blocked:
        return Close("VALIDATION_FAILED", validations, steps, periods, headers, frames, metrics)

    snapshot = cost_centers_as_of(cost_center_history, run_ts)
    frames["snapshot"] = snapshot
    steps.append(Step("Create Snapshot", "COMPLETED", snapshot.count(), None))

    chosen = active_budget(headers, periods, fiscal_period_id).select("header_id").first()
    budget_id = chosen["header_id"] if chosen else None
    budget_lines, budget_header_id = lines, budget_id

    def attempt(name: str, run) -> None:
        try:
            steps.append(run(name))
        except CloseBlocked:
            raise
        except Exception as error:
            steps.append(Step(name, "FAILED", None, str(error)))
            if close_type == "FINAL":
                raise CloseBlocked(str(error)) from error

    def consolidation(name: str) -> Step:
        nonlocal budget_lines, budget_header_id
        result = consolidate_budget(
            lines, headers, accounts, cost_centers, budget_id, new_header_id, run_ts.date(), run_id, run_ts,
            include_eliminations=include_eliminations, mode=elimination_mode, include_zero=include_zero, rounding=rounding, max_depth=max_depth,
        )
        frames["left_out_lines"] = result.left_out
        # stored, as the following steps read the lines several times
        with_ids = materialise(new_lines(result.lines, lines, LINE_KEY), "consolidated")
        frames["consolidated_header"], frames["consolidated_lines"] = result.header, with_ids
        budget_lines, budget_header_id = with_ids, new_header_id
        metrics["consolidated_header_id"] = new_header_id
        return Step(name, "COMPLETED", with_ids.count(), None)

    def allocation(name: str) -> Step:
        nonlocal budget_lines
        budget = budget_lines.filter(F.col("header_id") == budget_header_id)
        results = allocation_results(budget, rules, cost_centers, accounts, fiscal_period_id=fiscal_period_id)
        stored = materialise(results, "allocated")
        # the consolidated lines are not part of the table yet, their ids are taken all the same
        known = lines if budget_lines is lines else lines.unionByName(budget_lines)
        ledger = allocation_ledger(stored, budget_header_id, budget)
        added = allocated_lines(ledger, budget, known)
        frames["allocation_results"], frames["allocated_lines"], frames["allocation_ledger"] = stored, added, ledger
        frames["marked_lines"] = mark_allocated(budget, stored)
        # reconciliation also sees the allocated lines
        budget_lines = budget.unionByName(added)
        return Step(name, "COMPLETED", stored.count(), None)

    def reconciliation(name: str) -> Step:
        result = reconcile_intercompany(
            budget_lines, accounts, cost_centers, periods, budget_header_id, run_id, run_ts.date(),
            create_adjustments=close_type != "FINAL", journal_id=journal_id,
        )
        frames["recon_status"], frames["recon_match_types"] = result.status, result.match_types
        if result.journal is not None:
            frames["journal"], frames["journal_lines"] = result.journal, result.journal_lines
        row = result.stats.first()
        open_pairs = row["unreconciled"]
        metrics["unreconciled"], metrics["total_variance"] = open_pairs, row["unreconciled_variance"]
        if open_pairs == 0:
            return Step(name, "COMPLETED", 0, None)
        note = f"{open_pairs} unreconciled items, variance: {row['unreconciled_variance']:,.2f}"
        if close_type == "FINAL":
            steps.append(Step(name, "FAILED", open_pairs, note))
            raise RuntimeError("Cannot perform FINAL close with unreconciled intercompany balances")
        return Step(name, "WARNING", open_pairs, note)

    try:
        if run_consolidation:
            if budget_id is None:
                steps.append(Step("Budget Consolidation", "SKIPPED", None, "No active budget found for period"))
            else:
                attempt("Budget Consolidation", consolidation)
        if run_allocations and budget_header_id is not None:
            attempt("Cost Allocations", allocation)
        if run_reconciliation and budget_header_id is not None:
            attempt("Intercompany Reconciliation", reconciliation)
    except CloseBlocked as error:
        steps.append(Step("ERROR_HANDLER", "ERROR", None, str(error)))
        return Close("FAILED", validations, steps, periods, headers, frames, metrics)

    closed, locked = lock_period(periods, headers, fiscal_period_id, run_ts)
    newly_closed = periods.filter(F.col("fiscal_period_id") == fiscal_period_id).count()
    newly_locked = headers.filter(
        (F.col("status_code") == "APPROVED") & F.lit(fiscal_period_id).between(F.col("start_period_id"), F.col("end_period_id"))
    ).count()
    steps.append(Step("Lock Period", "COMPLETED", newly_closed + newly_locked, None))
    return Close("COMPLETED", validations, steps, closed, locked, frames, metrics)

