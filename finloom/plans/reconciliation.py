"""Intercompany reconciliation as one job."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finloom.operators.journals import adjustment_journal, adjustment_lines
from finloom.operators.reconcile import (
    entities_of_budget,
    entity_stats,
    ic_pairs,
    linked_lines,
    match_amounts,
    match_lines,
    match_targets,
    match_types,
    recon_stats,
    recon_status,
)
from finloom.session import materialise


class Reconciliation(NamedTuple):
    status: DataFrame
    matches: DataFrame
    lines: DataFrame
    match_types: DataFrame
    stats: DataFrame
    entity_stats: DataFrame
    journal: DataFrame | None
    journal_lines: DataFrame | None


def reconcile_intercompany(
    lines: DataFrame,
    accounts: DataFrame,
    cost_centers: DataFrame,
    periods: DataFrame,
    header_id: int,
    run_id: str,
    on: dt.date,
    entities: DataFrame | None = None,
    tolerance_amount: str = "0.01",
    tolerance_pct: str = "0.001",
    create_adjustments: bool = False,
    journal_id: int = 1,
    mode: str = "reference",
    with_targets: bool = False,
) -> Reconciliation:
    """Pairs with status, match counts, statistics and, on request, target lines and an adjustment journal."""
    budget = lines.filter(F.col("header_id") == header_id)
    # read by the pairs, the matches, the targets and the matched lines
    linked = materialise(linked_lines(budget, accounts), "linked-lines")
    pairs = ic_pairs(linked, accounts, cost_centers, entities, tolerance_amount, tolerance_pct, mode)
    # read by the status, the match types and the matched lines
    matches = materialise(match_amounts(linked, accounts, tolerance_amount), "matches")
    # read by the statistics, the journal and the report
    status = materialise(recon_status(pairs, matches), "recon-status")
    listed = entities if entities is not None else entities_of_budget(budget, cost_centers)
    journal = journal_lines = None
    if create_adjustments:
        journal = adjustment_journal(periods, header_id, journal_id, run_id, on)
        journal_lines = adjustment_lines(status, cost_centers, journal_id, tolerance_amount)
    detail = match_lines(linked, matches, match_targets(linked, accounts) if with_targets else None)
    return Reconciliation(
        status, matches, detail, match_types(matches), recon_stats(status), entity_stats(status, listed), journal, journal_lines
    )
