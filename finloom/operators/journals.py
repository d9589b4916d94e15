"""Adjustment journals from reconciliation results."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finloom.functions.columns import entity_of
from finloom.functions.ordering import lay_out, with_dense_index
from finloom.operators.reconcile import PAIR_KEY
from finloom.schemas import MONEY


def period_of(periods: DataFrame, day: dt.date) -> DataFrame:
    """One row: the lowest period id whose dates contain ``day``."""
    return periods.filter(F.lit(day).between(F.col("period_start"), F.col("period_end"))).agg(
        F.min("fiscal_period_id").alias("fiscal_period_id")
    )


def adjustment_journal(periods: DataFrame, header_id: int, journal_id: int, run_id: str, posting_date: dt.date) -> DataFrame:
    """The journal row of one reconciliation run."""
    number = f"ICR-{posting_date:%Y%m%d}-{run_id[:8]}"
    return period_of(periods, posting_date).select(
        F.lit(journal_id).cast("long").alias("journal_id"),
        F.lit(number).alias("journal_number"),
        F.lit("ELIMINATION").alias("journal_type"),
        F.lit(header_id).alias("header_id"),
        "fiscal_period_id",
        F.lit(posting_date).alias("posting_date"),
        F.lit("Auto-generated intercompany reconciliation adjustment").alias("description"),
        F.lit("DRAFT").alias("status_code"),
    )


def adjustment_lines(status: DataFrame, cost_centers: DataFrame, journal_id: int, tolerance_amount: str = "0.01") -> DataFrame:
    """Numbered debit or credit lines for unreconciled pairs above tolerance.

    The cost centre is the entity's lowest id.
    """
    open_pairs = status.filter(
        (F.col("status") == "UNRECONCILED") & (F.abs("variance") > F.lit(tolerance_amount).cast(MONEY))
    ).select(*PAIR_KEY, "variance")
    centre = cost_centers.groupBy(entity_of(F.col("code")).alias("entity1")).agg(F.min("cost_center_id").alias("cost_center_id"))
    numbered = with_dense_index(lay_out(open_pairs, PAIR_KEY), "line_number")
    zero = F.lit(0).cast("decimal(38,4)")
    return numbered.join(centre, "entity1", "left").select(
        F.lit(journal_id).cast("long").alias("journal_id"),
        F.col("line_number").cast("int").alias("line_number"),
        "gl_account_id",
        "cost_center_id",
        F.greatest(F.col("variance"), zero).cast(MONEY).alias("debit_amount"),
        F.greatest(-F.col("variance"), zero).cast(MONEY).alias("credit_amount"),
        F.concat(F.lit("IC Adjustment: "), "entity1", F.lit(" <-> "), "entity2").alias("description"),
    )
