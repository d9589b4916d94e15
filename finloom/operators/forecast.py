"""Rolling forecast from budget history.

A series is one account and cost centre. Its history has at most one row per
fiscal period, because the natural key of budget lines is unique, so windows
over a series are bounded by the calendar.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finloom.functions.columns import amount_misfit, money_from_double, money_if_fits
from finloom.operators.sinks import new_lines
from finloom.schemas import MONEY, TOTAL
from finloom.sources.documents import factor_of_month

SERIES = ["gl_account_id", "cost_center_id"]
WEIGHT_TYPE = "decimal(18,6)"


def _series() -> Window:
    return Window.partitionBy(*SERIES)


def history(
    lines: DataFrame, periods: DataFrame, source_year: int, historical_periods: int = 12, seasonality: str | None = None
) -> DataFrame:
    """Lines from the year before ``source_year`` on, numbered, with decay weight and seasonal factor."""
    calendar = periods.filter(F.col("fiscal_year") >= source_year - 1).select("fiscal_period_id", "fiscal_year", "fiscal_month")
    seq = F.row_number().over(_series().orderBy("fiscal_year", "fiscal_month"))
    return (
        lines.select(*SERIES, "fiscal_period_id", F.col("final_amount").alias("actual"))
        .join(calendar, "fiscal_period_id")
        .withColumn("seq", seq)
        .withColumn("weight_factor", F.pow(F.lit(0.9), F.lit(historical_periods) - F.col("seq")).cast(WEIGHT_TYPE))
        .withColumn("seasonal_factor", F.coalesce(factor_of_month(F.col("fiscal_month"), seasonality), F.lit(1).cast("decimal(8,6)")))
    )


def moving_averages(hist: DataFrame) -> DataFrame:
    """Averages over the last 3, 6 and 12 rows of the series."""
    ordered = _series().orderBy("seq")
    for n in (3, 6, 12):
        frame = ordered.rowsBetween(1 - n, Window.currentRow)
        # the exact decimal sum, so that the average does not depend on the order of addition
        hist = hist.withColumn(f"ma{n}", F.sum("actual").over(frame).cast("double") / F.count("*").over(frame))
    return hist


def lags(hist: DataFrame) -> DataFrame:
    """Previous amount (0 before the first) and the amount twelve rows back."""
    ordered = _series().orderBy("seq")
    return hist.withColumn("previous", F.coalesce(F.lag("actual", 1).over(ordered), F.lit(0).cast("decimal(20,4)"))).withColumn(
        "year_ago", F.lag("actual", 12).over(ordered)
    )


def percentiles(hist: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Median and the interpolated percentiles at the confidence level and its complement."""
    by = ", ".join(SERIES)

    def at(level: str) -> Column:
        return F.expr(f"percentile_cont({level}) WITHIN GROUP (ORDER BY CAST(actual AS DOUBLE)) OVER (PARTITION BY {by})")

    return (
        hist.withColumn("median_amount", at("0.5"))
        .withColumn("upper_percentile", at(f"{confidence}"))
        .withColumn("lower_percentile", at(f"{1 - confidence:.6f}"))
    )


def regression_sums(hist: DataFrame) -> DataFrame:
    """Running row count with the whole series' regression sums."""
    whole = _series()
    running = whole.orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seq = F.col("seq").cast("long")
    return (
        hist.withColumn("n", F.count("*").over(running))
        .withColumn("sum_x", F.sum(seq).over(whole))
        .withColumn("sum_y", F.sum("actual").over(whole))
        .withColumn("sum_xy", F.sum(seq.cast("decimal(10,0)") * F.col("actual")).over(whole))
        .withColumn("sum_xx", F.sum(seq * seq).over(whole))
    )


def trend_components(hist: DataFrame, confidence: float = 0.95, trend: str = "reference") -> DataFrame:
    """Trend, cyclical part, residual and percentile bounds of each history row.

    The ``reference`` slope combines the running count with whole-series sums;
    ``regr_slope`` is the least-squares slope of the whole series on every row.
    """
    full = percentiles(lags(moving_averages(regression_sums(hist))), confidence)
    n, x, xx = F.col("n"), F.col("sum_x"), F.col("sum_xx")
    if trend == "regr_slope":
        n = F.count("*").over(_series())
    below = n * xx - x * x
    above = n.cast("double") * F.col("sum_xy").cast("double") - x.cast("double") * F.col("sum_y").cast("double")
    slope = F.when((n > 1) & (below != 0), money_from_double(above / F.nullif(below, F.lit(0)).cast("double")))
    change = (F.col("actual") - F.col("year_ago")).cast("double") / F.nullif(F.col("year_ago"), F.lit(0)).cast("double")
    return (
        full.withColumn("trend", F.coalesce(slope, F.lit(0).cast(MONEY)))
        .withColumn("cyclical", F.coalesce(money_from_double(change), F.lit(0).cast(MONEY)))
        .withColumn("residual", money_from_double(F.col("actual").cast("double") - F.col("ma12")))
        .withColumn("lower_bound", money_from_double(F.col("lower_percentile")))
        .withColumn("upper_bound", money_from_double(F.col("upper_percentile")))
    )


def forecast_baseline(trends: DataFrame) -> DataFrame:
    """Last sequence, weighted average, mean trend and sample deviation per series."""
    weighted = F.sum(F.col("actual") * F.col("weight_factor")).cast("double") / F.nullif(F.sum("weight_factor"), F.lit(0)).cast("double")
    return trends.groupBy(*SERIES).agg(
        F.max("seq").alias("last_seq"),
        weighted.alias("weighted_avg"),
        (F.sum("trend").cast("double") / F.count("*")).alias("avg_trend"),
        F.stddev_samp(F.col("actual").cast("double")).alias("std_dev"),
    )


def future_periods(hist: DataFrame, periods: DataFrame, forecast_periods: int = 12) -> DataFrame:
    """Open periods after the last one of the history, numbered in calendar order."""
    last = hist.agg(F.max("fiscal_period_id").alias("last"))
    # numbered over the open part of the calendar, a table of a few hundred rows
    numbered = (
        periods.filter(~F.col("is_closed"))
        .filter(F.col("fiscal_period_id") > last.scalar())
        .withColumn("future_seq", F.row_number().over(Window.orderBy("fiscal_year", "fiscal_month")))
    )
    return numbered.filter(F.col("future_seq") <= forecast_periods)


def forecast_rows(
    baseline: DataFrame,
    future: DataFrame,
    method: str = "WEIGHTED_AVERAGE",
    growth_rate: float | None = None,
    seasonality: str | None = None,
) -> DataFrame:
    """One row per series and future period.

    The periods enter as one constant array, so no join is needed to spread
    the series over them.
    """
    steps = F.array_sort(
        F.collect_list(F.struct("future_seq", "fiscal_period_id", "fiscal_year", "fiscal_quarter", "fiscal_month", "period_name"))
    )
    horizon = future.agg(steps.alias("horizon")).scalar()
    spread = baseline.withColumn("_p", F.explode(horizon)).select("*", "_p.*").drop("_p")

    average, trend, k = F.col("weighted_avg"), F.col("avg_trend"), F.col("future_seq")
    factor = factor_of_month(F.col("fiscal_month"), seasonality)
    season = F.coalesce(factor, F.lit(1)).cast("double")

    def growth(default: Column | float) -> Column:
        return F.lit(float(growth_rate)) if growth_rate is not None else (default if isinstance(default, Column) else F.lit(default))

    amount = {
        "WEIGHTED_AVERAGE": average * season * F.pow(F.lit(1.0) + growth(trend), k),
        "LINEAR_TREND": average + trend * (F.col("last_seq") + k),
        "EXPONENTIAL": average * F.pow(F.lit(1.0) + growth(0.02), k),
        "SEASONAL": average * factor.cast("double") * (F.lit(1.0) + growth(0.0) * k / F.lit(12.0)),
    }.get(method, average)
    if method == "WEIGHTED_AVERAGE":
        width = F.lit(1.96) * F.col("std_dev") * F.sqrt(k)
        lower, upper = average - width, average + width
    else:
        lower, upper = average * F.lit(0.8), average * F.lit(1.2)
    return spread.select(
        *SERIES,
        "fiscal_period_id",
        "fiscal_year",
        "fiscal_quarter",
        "fiscal_month",
        "period_name",
        "future_seq",
        (F.col("last_seq") + k).alias("seq"),
        F.coalesce(factor, F.lit(1)).cast("decimal(8,6)").alias("seasonal_factor"),
        amount.alias("forecast_amount"),
        lower.alias("lower_bound"),
        upper.alias("upper_bound"),
    )


class Forecast(NamedTuple):
    """``detail`` keeps doubles; ``misfits`` lists the values of it that no amount can hold."""

    trends: DataFrame
    detail: DataFrame
    misfits: DataFrame


def rolling_forecast(
    lines: DataFrame,
    headers: DataFrame,
    periods: DataFrame,
    header_id: int,
    historical_periods: int = 12,
    forecast_periods: int = 12,
    method: str = "WEIGHTED_AVERAGE",
    seasonality: str | None = None,
    growth_rate: float | None = None,
    confidence: float = 0.95,
    trend: str = "reference",
) -> Forecast:
    """History with its components, the forecast detail of one budget, and what of it no amount can hold.

    With the default arguments a series grows by its own mean trend, an amount
    and not a rate, so later periods often leave the range of amounts. Such
    values stay out of lines and totals and are listed with their reason.
    """
    header = headers.filter(F.col("header_id") == header_id).select("fiscal_year").first()
    if header is None:
        raise ValueError("Base budget header not found")
    budget = lines.filter(F.col("header_id") == header_id)
    hist = history(budget, periods, header["fiscal_year"], historical_periods, seasonality)
    trends = trend_components(hist, confidence, trend)
    recent = periods.filter(F.col("fiscal_year") >= header["fiscal_year"] - 1).select("fiscal_period_id")
    used = budget.select("fiscal_period_id").join(recent, "fiscal_period_id", "left_semi")
    future = future_periods(used, periods, forecast_periods)
    detail = forecast_rows(forecast_baseline(trends), future, method, growth_rate, seasonality)
    return Forecast(trends, detail, forecast_misfits(detail))


VALUES = ["forecast_amount", "lower_bound", "upper_bound"]


def forecast_misfits(detail: DataFrame) -> DataFrame:
    """One row per value of the detail that no amount can hold: series, period, column, value and reason."""
    value = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value"), amount_misfit(F.col(c)).alias("reason")) for c in VALUES]))
    return detail.select(*SERIES, "fiscal_period_id", "future_seq", value.alias("_v")).select("*", "_v.*").drop("_v").filter("reason IS NOT NULL")


def forecast_lines(detail: DataFrame, header_id: int, method: str, lines: DataFrame | None = None) -> DataFrame:
    """Forecast rows as budget lines; rows without an amount, or with a value that no amount can hold, are left out.

    With ``lines``, the table they go to, they are complete new lines with ids.
    """
    rows = _forecast_lines(detail, header_id, method)
    return rows if lines is None else new_lines(rows, lines, [*SERIES, "fiscal_period_id"])


def _forecast_lines(detail: DataFrame, header_id: int, method: str) -> DataFrame:
    amount = money_if_fits(F.col("forecast_amount"))
    return detail.filter(amount.isNotNull()).select(
        F.lit(header_id).alias("header_id"),
        *SERIES,
        "fiscal_period_id",
        amount.alias("original_amount"),
        F.lit(0).cast(MONEY).alias("adjusted_amount"),
        F.lit(method).alias("spread_method"),
        F.lit("ROLLING_FORECAST").alias("source_system"),
    )


def _money_total(name: str) -> Column:
    return F.sum(money_if_fits(F.col(name))).cast(TOTAL)


def forecast_summary(detail: DataFrame, accounts: DataFrame) -> DataFrame:
    """Totals by account type, year and quarter; ``left_out`` counts the values that no amount can hold."""
    misfits = [F.count(amount_misfit(F.col(c))) for c in VALUES]
    by_account = detail.groupBy("gl_account_id", "fiscal_year", "fiscal_quarter").agg(
        *[_money_total(c).alias(c) for c in VALUES], (misfits[0] + misfits[1] + misfits[2]).alias("left_out")
    )
    return (
        by_account.join(accounts.select("gl_account_id", "account_type"), "gl_account_id")
        .groupBy("account_type", "fiscal_year", "fiscal_quarter")
        .agg(
            F.sum("forecast_amount").cast(TOTAL).alias("total_forecast"),
            F.sum("lower_bound").cast(TOTAL).alias("total_lower_bound"),
            F.sum("upper_bound").cast(TOTAL).alias("total_upper_bound"),
            F.sum("left_out").alias("left_out"),
        )
    )


def forecast_pivot(detail: DataFrame, future: DataFrame, accounts: DataFrame, cost_centers: DataFrame) -> DataFrame:
    """One column per future period name, sorted by name; values that no amount can hold are left out."""
    names = sorted({row["period_name"] for row in future.select("period_name").collect()})  # at most one per forecast period
    wide = detail.groupBy(*SERIES).pivot("period_name", names).agg(_money_total("forecast_amount"))
    return (
        wide.join(accounts.select("gl_account_id", "account_number", "account_name"), "gl_account_id")
        .join(
            cost_centers.select(
                "cost_center_id", F.col("code").alias("cost_center_code"), F.col("name").alias("cost_center_name")
            ),
            "cost_center_id",
        )
        .select("account_number", "account_name", "cost_center_code", "cost_center_name", *[F.col(f"`{n}`") for n in names])
    )


def forecast_accuracy(result: Forecast, method: str, historical_periods: int, forecast_periods: int) -> DataFrame:
    """One row of data-point counts, mean absolute residual and deviation of the history."""
    points = result.detail.agg(F.count("*").alias("n")).scalar()
    return result.trends.agg(
        F.count("*").alias("actual_data_points"),
        F.avg(F.abs("residual")).cast("double").alias("mean_absolute_residual"),
        F.stddev_samp(F.col("actual").cast("double")).alias("historical_std_dev"),
    ).select(
        F.lit(method).alias("forecast_method"),
        F.lit(historical_periods).alias("historical_periods"),
        F.lit(forecast_periods).alias("forecast_periods"),
        "actual_data_points",
        points.alias("forecast_data_points"),
        "mean_absolute_residual",
        "historical_std_dev",
    )
