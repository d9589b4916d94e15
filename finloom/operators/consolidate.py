"""Consolidation of one budget and intercompany elimination."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finloom.functions.scan import cancelling_neighbours
from finloom.schemas import LINE_KEY, TOTAL


def consolidate(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sum and count per account, cost centre and period on reachable cost centres."""
    return (
        lines.join(nodes.select("cost_center_id"), "cost_center_id", "left_semi")
        .groupBy(*LINE_KEY)
        .agg(F.sum("final_amount").cast(TOTAL).alias("consolidated_amount"), F.count("*").alias("source_count"))
    )


def elimination_pairs(lines: DataFrame, accounts: DataFrame, mode: str = "corrected", pieces: int | None = None) -> DataFrame:
    """Adjacent lines of opposite amount on intercompany accounts, paired greedily.

    Walking the lines in order, a line pairs with its successor when their
    amounts cancel, and both are then used up. ``reference`` walks across
    account boundaries, ``corrected`` does not. The lines are read once and
    their order once; ``pieces`` is the number of parts the order is cut into.
    """
    flagged = accounts.filter("intercompany_flag").select("gl_account_id")
    columns = ["gl_account_id", "cost_center_id", "fiscal_period_id", "line_id"]
    chosen = lines.join(flagged, "gl_account_id", "left_semi").select(*columns, "final_amount")
    within = ["gl_account_id"] if mode == "corrected" else []
    pairs = cancelling_neighbours(chosen, columns, "final_amount", within, pieces)
    named = {"line_id": "line_id", "gl_account_id": "gl_account_id", "cost_center_id": "cost_center_id", "fiscal_period_id": "period_id"}
    sides = [F.col(f"{side}.{c}").alias(f"{side}_{name}") for side in ("first", "second") for c, name in named.items()]
    return pairs.select(*sides, F.col("first.final_amount").alias("amount"))


def apply_eliminations(consolidated: DataFrame, pairs: DataFrame, mode: str = "corrected") -> DataFrame:
    """Add ``elimination_amount`` to consolidated rows.

    ``reference``: the first line's amount, on the second line's account and
    cost centre, in every period. ``corrected``: both lines' own amounts, each
    in its own account, cost centre and period, so that the pair disappears.
    """
    if mode == "reference":
        keys = ["gl_account_id", "cost_center_id"]
        effects = pairs.select(
            F.col("second_gl_account_id").alias("gl_account_id"),
            F.col("second_cost_center_id").alias("cost_center_id"),
            "amount",
        )
    else:
        keys = LINE_KEY
        sides = F.array(
            *[
                F.struct(
                    F.col(f"{side}_gl_account_id").alias("gl_account_id"),
                    F.col(f"{side}_cost_center_id").alias("cost_center_id"),
                    F.col(f"{side}_period_id").alias("fiscal_period_id"),
                    amount.alias("amount"),
                )
                for side, amount in (("first", F.col("amount")), ("second", -F.col("amount")))
            ]
        )
        effects = pairs.select(F.inline(sides))
    per_key = effects.groupBy(*keys).agg(F.sum("amount").cast(TOTAL).alias("elimination_amount"))
    return consolidated.join(per_key, keys, "left").withColumn(
        "elimination_amount", F.coalesce("elimination_amount", F.lit(0).cast(TOTAL))
    )


def final_amounts(eliminated: DataFrame, include_zero: bool = True, rounding: int | None = None) -> DataFrame:
    """Final = consolidated minus elimination; rows that are zero on both sides never appear."""
    final = F.col("consolidated_amount") - F.col("elimination_amount")
    if rounding is not None:
        final = F.round(final, rounding)
    result = eliminated.filter((F.col("consolidated_amount") != 0) | (F.col("elimination_amount") != 0)).withColumn(
        "final_amount", final.cast(TOTAL)
    )
    return result if include_zero else result.filter(F.col("final_amount") != 0)
