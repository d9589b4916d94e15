"""Column expressions of the planning model."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finloom.schemas import FINAL


def entity_of(code: Column) -> Column:
    """Entity = the code up to its first dash; empty when there is no code."""
    return F.substring_index(F.coalesce(code, F.lit("")), "-", 1)


def final_amount(original: Column, adjusted: Column) -> Column:
    return (original + adjusted).cast(FINAL)


def row_hash(account: Column, cost_center: Column, period: Column, amount: Column) -> Column:
    parts = [c.cast("string") for c in (account, cost_center, period, amount.cast(FINAL))]
    return F.sha2(F.concat_ws("|", *parts), 256)


def with_model_columns(lines: DataFrame) -> DataFrame:
    """Final amount and row hash of budget lines."""
    final = final_amount(F.col("original_amount"), F.col("adjusted_amount"))
    return lines.withColumn("final_amount", final).withColumn(
        "row_hash",
        row_hash(F.col("gl_account_id"), F.col("cost_center_id"), F.col("fiscal_period_id"), F.col("final_amount")),
    )


def with_header_columns(headers: DataFrame) -> DataFrame:
    return headers.withColumn("is_locked", F.col("locked_at").isNotNull())


def with_journal_line_columns(lines: DataFrame) -> DataFrame:
    return lines.withColumn("net_amount", F.col("debit_amount") - F.col("credit_amount"))


def effective_on(as_of: dt.date | Column) -> Column:
    """Effective-date window of a row that has effective_from / effective_to."""
    day = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return (F.col("effective_from") <= day) & (F.col("effective_to").isNull() | (F.col("effective_to") >= day))


#: Doubles from here on are no amounts: their four decimals would not fit.
TOO_LARGE = 9.0e14


def amount_misfit(value: Column) -> Column:
    """Why no amount can hold a double: null if one can, or if there is no value."""
    return F.when(F.isnan(value), "NOT_A_NUMBER").when(F.abs(value) >= F.lit(TOO_LARGE), "TOO_LARGE")


def money_if_fits(value: Column) -> Column:
    """Nearest 4-decimal amount, halves away from zero, same on every engine; null where ``amount_misfit`` gives a reason."""
    held = F.when(amount_misfit(value).isNull(), value)
    magnitude = F.floor(F.abs(held) * F.lit(10000.0) + F.lit(0.5)).cast("decimal(20,0)")
    scaled = (magnitude.cast("decimal(24,4)") / F.lit(10000).cast("decimal(5,0)")).cast("decimal(19,4)")
    return F.when(value < 0, -scaled).otherwise(scaled).cast("decimal(19,4)")


def money_from_double(value: Column) -> Column:
    """The amount of a double that must fit.

    A value that is no number or too large for an amount is an error: an
    amount never takes the place of another one silently.
    """
    told = F.raise_error(F.concat(F.lit("no amount can hold "), value.cast("string"))).cast("decimal(19,4)")
    return F.when(amount_misfit(value).isNull(), money_if_fits(value)).otherwise(told)


def variance_status(variance: Column) -> Column:
    return F.when(variance > 0, "FAVORABLE").when(variance < 0, "UNFAVORABLE").otherwise("ON_TARGET")


def close_step_status(unreconciled: Column, close_type: str) -> Column:
    ladder = F.when(unreconciled == 0, "COMPLETED")
    if close_type == "FINAL":
        ladder = ladder.when(unreconciled > 0, "FAILED")
    return ladder.otherwise("WARNING")


def keep_when_set(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters for the arguments that are set; an unset one adds no predicate."""
    for name, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df
