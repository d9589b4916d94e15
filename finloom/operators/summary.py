"""Budget summary and budget-versus-budget variance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finloom.functions.columns import keep_when_set, variance_status
from finloom.schemas import LINE_KEY, NATURAL_KEY, TOTAL


def join_star(
    lines: DataFrame, headers: DataFrame, accounts: DataFrame, cost_centers: DataFrame, periods: DataFrame
) -> DataFrame:
    """Budget lines with the attributes of all four dimensions."""
    return (
        lines.join(headers.drop("base_header_id", "extended_properties", "locked_at"), "header_id")
        .join(accounts, "gl_account_id")
        .join(
            cost_centers.select(
                "cost_center_id",
                F.col("code").alias("cost_center_code"),
                F.col("name").alias("cost_center_name"),
                F.col("parent_id").alias("parent_cost_center_id"),
            ),
            "cost_center_id",
        )
        .join(periods.withColumnRenamed("fiscal_year", "period_year"), "fiscal_period_id")
    )


SUMMARY_KEYS = [
    "header_id", "budget_code", "budget_name", "budget_type", "scenario_type", "fiscal_year",
    "fiscal_period_id", "fiscal_quarter", "fiscal_month", "period_name",
    "gl_account_id", "account_number", "account_name", "account_type",
    "cost_center_id", "cost_center_code", "cost_center_name", "parent_cost_center_id",
]


MEASURES = [
    "total_original_amount", "total_adjusted_amount", "total_final_amount", "total_local_currency", "total_reporting_currency", "line_item_count",
]


def line_measures() -> dict[str, Column]:
    """What one line adds to each measure."""
    amounts = [
        F.col("original_amount"), F.col("adjusted_amount"), F.col("original_amount") + F.col("adjusted_amount"),
        F.coalesce("local_currency_amount", F.lit(0)), F.coalesce("reporting_currency_amount", F.lit(0)), F.lit(1),
    ]
    return dict(zip(MEASURES, amounts))


def line_totals(lines: DataFrame) -> DataFrame:
    """Sums and number of lines per natural key."""
    return lines.groupBy(*NATURAL_KEY).agg(
        F.sum("original_amount").cast(TOTAL).alias("total_original_amount"),
        F.sum("adjusted_amount").cast(TOTAL).alias("total_adjusted_amount"),
        F.sum(F.col("original_amount") + F.col("adjusted_amount")).cast(TOTAL).alias("total_final_amount"),
        F.coalesce(F.sum("local_currency_amount"), F.lit(0)).cast(TOTAL).alias("total_local_currency"),
        F.coalesce(F.sum("reporting_currency_amount"), F.lit(0)).cast(TOTAL).alias("total_reporting_currency"),
        F.count("*").alias("line_item_count"),
    )


def with_attributes(totals: DataFrame, headers: DataFrame, accounts: DataFrame, cost_centers: DataFrame, periods: DataFrame) -> DataFrame:
    """Totals per natural key as rows of the summary."""
    return join_star(totals, headers, accounts, cost_centers, periods).select(*SUMMARY_KEYS, *MEASURES)


def budget_summary(
    lines: DataFrame, headers: DataFrame, accounts: DataFrame, cost_centers: DataFrame, periods: DataFrame
) -> DataFrame:
    """Sums per budget, account, cost centre and period.

    The attributes follow from the four ids, so the lines are grouped on the
    ids alone and meet the dimensions afterwards.
    """
    return with_attributes(line_totals(lines), headers, accounts, cost_centers, periods)


def _variance_columns(df: DataFrame, threshold_pct: float | None) -> DataFrame:
    base, comparison = F.col("budget_amount"), F.col("comparison_amount")
    pct = F.when(base != 0, (comparison - base).cast("double") / base.cast("double") * 100.0)
    limit = 100.0 if threshold_pct is None else float(threshold_pct)
    return (
        df.withColumn("variance_amount", (comparison - base).cast(TOTAL))
        .withColumn("variance_pct", pct)
        .withColumn("variance_status", variance_status(F.col("variance_amount")))
        .withColumn("exceeds_threshold", F.coalesce(F.abs("variance_pct") > limit, F.lit(False)).cast("int"))
    )


def variance_one_pass(lines: DataFrame, base_header: int, comparison_header: int, threshold_pct: float | None = None) -> DataFrame:
    """Both budgets in one scan and one aggregate; a side without lines is 0."""

    def side(header: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("header_id") == header, F.col("final_amount"))), F.lit(0)).cast(TOTAL)

    both = (
        lines.filter(F.col("header_id").isin(base_header, comparison_header))
        .groupBy(*LINE_KEY)
        .agg(side(base_header).alias("budget_amount"), side(comparison_header).alias("comparison_amount"))
    )
    return _variance_columns(both, threshold_pct)


def variance_full_join(lines: DataFrame, base_header: int, comparison_header: int, threshold_pct: float | None = None) -> DataFrame:
    """The same result as a full outer join of two aggregates."""

    def side(header: int, name: str) -> DataFrame:
        return lines.filter(F.col("header_id") == header).groupBy(*LINE_KEY).agg(F.sum("final_amount").cast(TOTAL).alias(name))

    joined = side(base_header, "budget_amount").join(side(comparison_header, "comparison_amount"), LINE_KEY, "full")
    zero = F.lit(0).cast(TOTAL)
    joined = joined.withColumn("budget_amount", F.coalesce("budget_amount", zero)).withColumn(
        "comparison_amount", F.coalesce("comparison_amount", zero)
    )
    return _variance_columns(joined, threshold_pct)


def budget_variance(
    lines: DataFrame,
    accounts: DataFrame,
    cost_centers: DataFrame,
    periods: DataFrame,
    base_header: int,
    comparison_header: int,
    fiscal_year: int | None = None,
    cost_center_id: int | None = None,
    account_type: str | None = None,
    threshold_pct: float | None = None,
) -> DataFrame:
    """Variance per account, cost centre and period with their attributes.

    The filters are applied to the lines and dimensions before the aggregate.
    """
    lines = keep_when_set(lines, cost_center_id=cost_center_id)
    periods = keep_when_set(periods, fiscal_year=fiscal_year)
    accounts = keep_when_set(accounts, account_type=account_type)
    if fiscal_year is not None:
        lines = lines.join(periods.select("fiscal_period_id"), "fiscal_period_id", "left_semi")
    if account_type is not None:
        lines = lines.join(accounts.select("gl_account_id"), "gl_account_id", "left_semi")
    return (
        variance_one_pass(lines, base_header, comparison_header, threshold_pct)
        .join(accounts.select("gl_account_id", "account_number", "account_name", "account_type"), "gl_account_id")
        .join(
            cost_centers.select(
                "cost_center_id", F.col("code").alias("cost_center_code"), F.col("name").alias("cost_center_name")
            ),
            "cost_center_id",
        )
        .join(periods.select("fiscal_period_id", "fiscal_year", "fiscal_month", "period_name"), "fiscal_period_id")
    )
