"""Forecast windows, methods and outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from finloom.functions.columns import money_from_double
from finloom.operators import forecast
from finloom.queries.registry import query
from finloom.sources.documents import factor_of_month

KEYS = "gl_account_id, cost_center_id, fiscal_period_id"
KEY = ["gl_account_id", "cost_center_id", "fiscal_period_id"]
FACTORS = "[0.8, 0.9, 1.1, 1.2, 1.0, 0.95, 1.05, 1.3, 0.7, 1.0, 1.15, 0.85]"
_FACTOR = "([0.8, 0.9, 1.1, 1.2, 1.0, 0.95, 1.05, 1.3, 0.7, 1.0, 1.15, 0.85])[p.fiscal_month]"


def _history(t):
    return forecast.history(t.lines_of(1), t.fiscal_period, 2000)


@query(
    "src_json_factors",
    f"""select l.line_id, ({_FACTOR})::decimal(8,6) as factor, (l.final_amount * ({_FACTOR})::decimal(8,6))::decimal(38,10) as seasonal_amount
          from budget_line_item l join fiscal_period p on l.fiscal_period_id = p.fiscal_period_id""",
)
def src_json_factors(t):
    months = t.fiscal_period.select("fiscal_period_id", factor_of_month(F.col("fiscal_month"), FACTORS).alias("factor"))
    return t.budget_line_item.join(months, "fiscal_period_id").select(
        "line_id", "factor", (F.col("final_amount") * F.col("factor")).cast("decimal(38,10)").alias("seasonal_amount")
    )


@query("w_seq", f"select {KEYS}, seq from history")
def w_seq(t):
    return _history(t).select(*KEY, "seq")


@query("w_decay", f"select {KEYS}, weight_factor from history")
def w_decay(t):
    return _history(t).select(*KEY, "weight_factor")


def _ma(n: int) -> str:
    return (
        f"money(cast(sum(actual) over (partition by gl_account_id, cost_center_id order by seq rows {n - 1} preceding) as double)"
        f" / count(*) over (partition by gl_account_id, cost_center_id order by seq rows {n - 1} preceding)) as ma{n}"
    )


@query("w_ma", f"select {KEYS}, {_ma(3)}, {_ma(6)}, {_ma(12)} from history")
def w_ma(t):
    averages = forecast.moving_averages(_history(t))
    return averages.select(*KEY, *[money_from_double(F.col(f"ma{n}")).alias(f"ma{n}") for n in (3, 6, 12)])


@query("w_running_n", f"select {KEYS}, n from trend_raw")
def w_running_n(t):
    return forecast.regression_sums(_history(t)).select(*KEY, "n")


@query(
    "w_regression",
    f"""select {KEYS}, n, sum_x::bigint as sum_x, sum_xx::bigint as sum_xx, sum_y, sum_xy, trend::decimal(19,4) as trend from trend""",
)
def w_regression(t):
    sums = forecast.trend_components(_history(t))
    return sums.select(
        *KEY, "n", "sum_x", "sum_xx", F.col("sum_y").cast("double"), F.col("sum_xy").cast("double"), "trend"
    )


@query(
    "w_regression_slope",
    """select gl_account_id, cost_center_id, case when n > 1 then money((cast(n as double) * sxy - cast(sx as double) * sy) / cast(n * sxx - sx * sx as double))
              else 0 end::decimal(19,4) as slope
         from (select gl_account_id, cost_center_id, count(*) as n, sum(seq) as sx, sum(seq * seq) as sxx, cast(sum(actual) as double) as sy,
                      cast(sum(seq * actual) as double) as sxy from history group by 1, 2) s""",
)
def w_regression_slope(t):
    """Least-squares slope mode, one value per series."""
    trends = forecast.trend_components(_history(t), trend="regr_slope")
    return trends.groupBy("gl_account_id", "cost_center_id").agg(F.max("trend").alias("slope"))


@query(
    "w_lag",
    f"""select {KEYS}, lag(actual, 1, 0::decimal(20,4)) over (partition by gl_account_id, cost_center_id order by seq) as previous, year_ago,
               cyclical::decimal(19,4) as cyclical from trend""",
)
def w_lag(t):
    return forecast.trend_components(_history(t)).select(*KEY, "previous", "year_ago", "cyclical")


@query(
    "w_percentile",
    f"""select {KEYS}, round(quantile_cont(cast(actual as double), 0.5) over g, 4) as median_amount,
               round(quantile_cont(cast(actual as double), 0.95) over g, 4) as upper_percentile,
               round(quantile_cont(cast(actual as double), 0.05) over g, 4) as lower_percentile
          from history window g as (partition by gl_account_id, cost_center_id)""",
)
def w_percentile(t):
    result = forecast.percentiles(_history(t))
    return result.select(*KEY, *[F.round(c, 4).alias(c) for c in ("median_amount", "upper_percentile", "lower_percentile")])


@query("w_future_seq", "select fiscal_period_id, k as future_seq from future")
def w_future_seq(t):
    return forecast.future_periods(_history(t), t.fiscal_period).select("fiscal_period_id", "future_seq")


@query(
    "forecast_baseline",
    """select gl_account_id, cost_center_id, last_seq, money(weighted_avg) as weighted_avg, money(avg_trend) as avg_trend,
              round(std_dev, 2) as std_dev from baseline""",
)
def forecast_baseline(t):
    base = forecast.forecast_baseline(forecast.trend_components(_history(t)))
    return base.select(
        "gl_account_id", "cost_center_id", "last_seq", money_from_double(F.col("weighted_avg")).alias("weighted_avg"),
        money_from_double(F.col("avg_trend")).alias("avg_trend"), F.round("std_dev", 2).alias("std_dev"),
    )


def _run(t, method="WEIGHTED_AVERAGE", growth_rate=None, seasonality=None):
    return forecast.rolling_forecast(
        t.budget_line_item, t.budget_header, t.fiscal_period, 1, method=method, growth_rate=growth_rate, seasonality=seasonality
    )


_FACTOR_OF = _FACTOR + "::decimal(8,6)"
_WIDE = "weighted_avg - 1.96::double * std_dev * sqrt(k)", "weighted_avg + 1.96::double * std_dev * sqrt(k)"
_BAND = "weighted_avg * 0.8::double", "weighted_avg * 1.2::double"


def _detail(amount: str, bounds: tuple[str, str]) -> str:
    return f"""
     select gl_account_id, cost_center_id, fiscal_period_id, fiscal_year, fiscal_quarter, period_name, k::int as future_seq, (last_seq + k)::int as seq,
            {amount} as forecast_amount, {bounds[0]} as lower_bound, {bounds[1]} as upper_bound
       from (select b.*, p.*, ({_FACTOR_OF}) as s from baseline b, future p) q
    """


_WEIGHTED = _detail("weighted_avg * coalesce(cast(s as double), 1.0::double) * pow(1.0::double + 0.01::double, k)", _WIDE)
_LINEAR = _detail("weighted_avg + avg_trend * (last_seq + k)", _BAND)
_EXPONENTIAL = _detail("weighted_avg * pow(1.0::double + 0.02::double, k)", _BAND)
_SEASONAL = _detail("weighted_avg * cast(s as double) * (1.0::double + 0.01::double * k / 12.0::double)", _BAND)


def _shown(detail: str) -> str:
    return f"""select {KEYS}, future_seq, seq, money(forecast_amount) as forecast_amount, round(lower_bound, 1) as lower_bound,
                      round(upper_bound, 1) as upper_bound from ({detail}) d"""


def _rounded(run):
    return run.detail.select(
        *KEY, "future_seq", "seq", money_from_double(F.col("forecast_amount")).alias("forecast_amount"),
        *[F.round(c, 1).alias(c) for c in ("lower_bound", "upper_bound")],
    )


@query("rolling_forecast", _shown(_WEIGHTED))
def rolling_forecast(t):
    return _rounded(_run(t, growth_rate=0.01, seasonality=FACTORS))


_DEFAULT = _detail("weighted_avg * pow(1.0::double + avg_trend, k)", _WIDE)


def _reason(value: str) -> str:
    return f"case when isnan({value}) then 'NOT_A_NUMBER' when abs({value}) >= 9e14::double then 'TOO_LARGE' end"


def _size(value: str) -> str:
    """Sign and logarithm of a value: engines agree on them however large it is."""
    return f"round(sign({value}) * ln(abs({value}) + 1.0::double), 6)"


@query(
    "rolling_forecast_default",
    f"""select {KEYS}, future_seq, {_size('forecast_amount')} as size, {_reason('forecast_amount')} as reason,
               forecast_amount is not null and {_reason('forecast_amount')} is null as has_line from ({_DEFAULT}) d""",
)
def rolling_forecast_default(t):
    """The forecast with default arguments: every detail row, whether an amount can hold it, and whether it becomes a line."""
    run = _run(t)
    lines = forecast.forecast_lines(run.detail, 901, "WEIGHTED_AVERAGE").select(*KEY, F.lit(True).alias("_line"))
    reasons = run.misfits.filter("column_name = 'forecast_amount'").select(*KEY, "reason")
    rows = run.detail.join(lines, KEY, "left").join(reasons, KEY, "left")
    return rows.select(*KEY, "future_seq", F.expr(_size("forecast_amount").replace("::double", "D")).alias("size"), "reason", F.col("_line").isNotNull().alias("has_line"))


@query(
    "forecast_summary_default",
    f"""select a.account_type, d.fiscal_year, d.fiscal_quarter, count(*) filter ({_reason('d.forecast_amount')} is not null)
               + count(*) filter ({_reason('d.lower_bound')} is not null) + count(*) filter ({_reason('d.upper_bound')} is not null) as left_out
          from ({_DEFAULT}) d join gl_account a on d.gl_account_id = a.gl_account_id group by 1, 2, 3""",
)
def forecast_summary_default(t):
    """How many values each total of the default forecast leaves out."""
    return forecast.forecast_summary(_run(t).detail, t.gl_account).select("account_type", "fiscal_year", "fiscal_quarter", "left_out")


@query("rolling_forecast_linear", _shown(_LINEAR))
def rolling_forecast_linear(t):
    return _rounded(_run(t, "LINEAR_TREND"))


@query("rolling_forecast_exponential", _shown(_EXPONENTIAL))
def rolling_forecast_exponential(t):
    return _rounded(_run(t, "EXPONENTIAL"))


@query("rolling_forecast_seasonal", _shown(_SEASONAL))
def rolling_forecast_seasonal(t):
    return _rounded(_run(t, "SEASONAL", growth_rate=0.01, seasonality=FACTORS))


@query(
    "forecast_lines",
    f"""select (select max(line_id) from budget_line_item) + row_number() over (order by gl_account_id, cost_center_id, fiscal_period_id) as line_id,
               {KEYS}, money(forecast_amount) as original_amount, false as is_allocated from ({_SEASONAL}) d where forecast_amount is not null""",
)
def forecast_lines(t):
    run = _run(t, "SEASONAL", growth_rate=0.01, seasonality=FACTORS)
    return forecast.forecast_lines(run.detail, 901, "SEASONAL", t.budget_line_item).select("line_id", *KEY, "original_amount", "is_allocated")


@query("join_cross_horizon", f"select {KEYS}, future_seq from ({_EXPONENTIAL}) d")
def join_cross_horizon(t):
    return _run(t, "EXPONENTIAL").detail.select(*KEY, "future_seq")


@query(
    "forecast_summary",
    f"""select a.account_type, d.fiscal_year, d.fiscal_quarter, sum(money(d.forecast_amount))::decimal(38,4) as total_forecast,
               sum(money(d.lower_bound))::decimal(38,4) as total_lower_bound, sum(money(d.upper_bound))::decimal(38,4) as total_upper_bound,
               0 as left_out
          from ({_EXPONENTIAL}) d join gl_account a on d.gl_account_id = a.gl_account_id group by 1, 2, 3""",
)
def forecast_summary(t):
    return forecast.forecast_summary(_run(t, "EXPONENTIAL").detail, t.gl_account)


_FUTURE_NAMES = ["FY2001-P12", *[f"FY2002-P{m:02d}" for m in range(1, 12)]]
_PIVOT = ", ".join(
    f"sum(money(d.forecast_amount)) filter (d.period_name = '{n}')::decimal(38,4) as \"{n}\"" for n in _FUTURE_NAMES
)


@query(
    "forecast_pivot",
    f"""select a.account_number, a.account_name, c.code as cost_center_code, c.name as cost_center_name, {_PIVOT}
          from ({_EXPONENTIAL}) d join gl_account a on d.gl_account_id = a.gl_account_id
               join cost_center c on d.cost_center_id = c.cost_center_id group by 1, 2, 3, 4""",
)
def forecast_pivot(t):
    run = _run(t, "EXPONENTIAL")
    future = forecast.future_periods(_history(t), t.fiscal_period)
    return forecast.forecast_pivot(run.detail, future, t.gl_account, t.cost_center)


@query(
    "forecast_accuracy",
    f"""select 'EXPONENTIAL' as forecast_method, 12 as historical_periods, 12 as forecast_periods, (select count(*) from trend) as actual_data_points,
               (select count(*) from ({_EXPONENTIAL}) d) as forecast_data_points,
               round((select avg(abs(cast(actual as double) - ma12)) from trend), 2) as mean_absolute_residual,
               round((select stddev_samp(cast(actual as double)) from trend), 2) as historical_std_dev""",
)
def forecast_accuracy(t):
    result = forecast.forecast_accuracy(_run(t, "EXPONENTIAL"), "EXPONENTIAL", 12, 12)
    return result.withColumn("mean_absolute_residual", F.round("mean_absolute_residual", 2)).withColumn(
        "historical_std_dev", F.round("historical_std_dev", 2)
    )
