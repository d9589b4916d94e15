"""Budget consolidation as one job."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finloom.operators.consolidate import apply_eliminations, consolidate, elimination_pairs, final_amounts
from finloom.operators.hierarchy import explode_hierarchy
from finloom.schemas import FINAL, MONEY


class Consolidation(NamedTuple):
    header: DataFrame
    amounts: DataFrame
    lines: DataFrame
    left_out: DataFrame


def check_source(headers: DataFrame, header_id: int) -> None:
    """Only an existing approved or locked budget may be consolidated."""
    row = headers.filter(F.col("header_id") == header_id).select("status_code").first()
    if row is None:
        raise ValueError(f"Source budget header not found: {header_id}")
    if row["status_code"] not in ("APPROVED", "LOCKED"):
        raise ValueError("Source budget must be in APPROVED or LOCKED status for consolidation")


def consolidated_header(headers: DataFrame, header_id: int, new_header_id: int, run_id: str, run_ts: dt.datetime) -> DataFrame:
    """The new draft budget that takes the consolidated lines."""
    stamp = f'<ConsolidationRun RunID="{run_id}" SourceID="{header_id}" Timestamp="{run_ts.isoformat()}"/>'
    return headers.filter(F.col("header_id") == header_id).select(
        F.lit(new_header_id).alias("header_id"),
        F.concat("budget_code", F.lit(f"_CONSOL_{run_ts:%Y%m%d}")).alias("budget_code"),
        F.concat("budget_name", F.lit(" - Consolidated")).alias("budget_name"),
        F.lit("CONSOLIDATED").alias("budget_type"),
        "scenario_type",
        F.lit("DRAFT").alias("status_code"),
        F.lit(1).alias("version_number"),
        "fiscal_year",
        "start_period_id",
        "end_period_id",
        F.col("header_id").alias("base_header_id"),
        F.concat(F.lit(f"<Root>{stamp}"), F.coalesce("extended_properties", F.lit("")), F.lit("</Root>")).alias(
            "extended_properties"
        ),
        F.lit(None).cast("timestamp").alias("locked_at"),
    )


def consolidate_budget(
    lines: DataFrame,
    headers: DataFrame,
    accounts: DataFrame,
    cost_centers: DataFrame,
    header_id: int,
    new_header_id: int,
    as_of: dt.date,
    run_id: str,
    run_ts: dt.datetime,
    include_eliminations: bool = True,
    mode: str = "corrected",
    include_zero: bool = True,
    rounding: int | None = None,
    max_depth: int = 10,
) -> Consolidation:
    """Consolidated lines of one budget under a new header.

    Cost centres deeper than ``max_depth``, inactive or out of their dates are
    not consolidated; ``left_out`` has the budget's lines on them.
    """
    check_source(headers, header_id)
    budget = lines.filter(F.col("header_id") == header_id)
    nodes = explode_hierarchy(cost_centers, as_of, max_depth=max_depth)
    amounts = consolidate(budget, nodes)
    if include_eliminations:
        amounts = apply_eliminations(amounts, elimination_pairs(budget, accounts, mode), mode)
    else:
        amounts = amounts.withColumn("elimination_amount", F.lit(0).cast("decimal(38,4)"))
    amounts = final_amounts(amounts, include_zero, rounding)
    new_lines = amounts.select(
        F.lit(new_header_id).alias("header_id"),
        "gl_account_id",
        "cost_center_id",
        "fiscal_period_id",
        F.col("final_amount").cast(MONEY).alias("original_amount"),
        F.lit(0).cast(MONEY).alias("adjusted_amount"),
        F.col("final_amount").cast(FINAL).alias("final_amount"),
        F.lit("CONSOLIDATED").alias("spread_method"),
        F.lit("CONSOLIDATION_PROC").alias("source_system"),
        F.lit(run_id).alias("source_reference"),
        F.lit(False).alias("is_allocated"),
    )
    left_out = budget.join(nodes.select("cost_center_id"), "cost_center_id", "left_anti")
    return Consolidation(consolidated_header(headers, header_id, new_header_id, run_id, run_ts), amounts, new_lines, left_out)
