import statistics
from decimal import Decimal

import builders as b
import pytest
from pyspark.sql import functions as F

from finloom.operators import forecast
from finloom.sources.documents import seasonal_factors


@pytest.fixture(scope="module")
def calendar(spark):
    rows = [(m, 2000, m, True) for m in range(1, 13)] + [(12 + m, 2001, m, m < 3) for m in range(1, 13)] + [(113, 2001, 13, False, True)]
    return b.periods(spark, rows)


@pytest.fixture(scope="module")
def header(spark):
    return b.headers(spark, [{"header_id": 1, "fiscal_year": 2001}])


def run(spark, header, calendar, frame, **options):
    return forecast.rolling_forecast(frame, header, calendar, 1, **options)


def test_single_point(spark, header, calendar):
    result = run(spark, header, calendar, b.lines(spark, [(1, 10, 1, 14, 50)]), growth_rate=0.0)
    first = result.detail.filter("future_seq = 1").first()
    assert first["forecast_amount"] == 50 and first["lower_bound"] is None  # no deviation of one value
    assert first["fiscal_period_id"] == 15 and first["seq"] == 2


def test_components(spark, header, calendar):
    amounts = [10, 12, 11, 14, 13, 16, 15, 18, 17, 20, 19, 22, 21]
    frame = b.lines(spark, [(i, 10, 1, i + 1, a) for i, a in enumerate(amounts)])
    rows = {r["seq"]: r for r in run(spark, header, calendar, frame).trends.collect()}
    assert rows[1]["previous"] == 0 and rows[2]["previous"] == 10
    assert rows[12]["year_ago"] is None and rows[13]["year_ago"] == 10
    assert rows[13]["cyclical"] == Decimal("1.1000") and rows[12]["cyclical"] == 0
    assert rows[3]["ma3"] == 11 and rows[13]["residual"] == Decimal(21) - Decimal(str(round(sum(amounts[1:]) / 12, 4)))
    assert rows[1]["weight_factor"] == Decimal("0.313811")  # 0.9 ** 11
    assert rows[13]["weight_factor"] == Decimal("1.111111")  # one row beyond the twelve
    n, x, y = 13, list(range(1, 14)), amounts
    slope = (n * sum(i * j for i, j in zip(x, y)) - sum(x) * sum(y)) / (n * sum(i * i for i in x) - sum(x) ** 2)
    assert float(rows[13]["trend"]) == pytest.approx(slope, abs=1e-4)
    # before the last row the count runs while the sums do not
    assert rows[1]["trend"] == 0
    running = (5 * sum(i * j for i, j in zip(x, y)) - sum(x) * sum(y)) / (5 * sum(i * i for i in x) - sum(x) ** 2)
    assert float(rows[5]["trend"]) == pytest.approx(running, abs=1e-4)
    same = run(spark, header, calendar, frame, trend="regr_slope").trends.select("trend").distinct().collect()
    assert [float(r["trend"]) for r in same] == [pytest.approx(slope, abs=1e-4)]
    assert rows[7]["median_amount"] == statistics.median(amounts)


def test_methods(spark, header, calendar):
    frame = b.lines(spark, [(i, 10, 1, i, 100) for i in range(1, 14)])
    factors = "[1.0, 1.0, 2.0]"

    def amounts(method, **options):
        rows = run(spark, header, calendar, frame, method=method, **options).detail.orderBy("future_seq").collect()
        return [r["forecast_amount"] for r in rows]

    assert amounts("OTHER", forecast_periods=2) == pytest.approx([100, 100])
    assert amounts("EXPONENTIAL", forecast_periods=2) == pytest.approx([102, 104.04])
    assert amounts("EXPONENTIAL", forecast_periods=1, growth_rate=0.1) == pytest.approx([110])
    assert amounts("WEIGHTED_AVERAGE", forecast_periods=2, growth_rate=0.1, seasonality=factors) == pytest.approx([220, 121])
    seasonal = amounts("SEASONAL", forecast_periods=2, growth_rate=1.2, seasonality=factors)
    assert seasonal[0] == pytest.approx(100 * 2 * 1.1) and seasonal[1] is None
    detail = run(spark, header, calendar, frame, method="SEASONAL", forecast_periods=2, seasonality=factors).detail
    assert b.collect(forecast.forecast_lines(detail, 7, "SEASONAL"), "header_id", "fiscal_period_id", "original_amount") == [(7, 15, 200)]
    linear = run(spark, header, calendar, b.lines(spark, [(i, 10, 1, i, 10 * i) for i in range(1, 3)]), method="LINEAR_TREND", trend="regr_slope")
    first = linear.detail.filter("future_seq = 1").first()
    average = (10 * 0.9**11 + 20 * 0.9**10) / (0.9**11 + 0.9**10)
    assert first["forecast_amount"] == pytest.approx(average + 10 * 3, abs=1e-3)
    assert first["lower_bound"] == pytest.approx(average * 0.8, abs=1e-3)


def test_future_skips_closed_and_includes_month_13(spark, header, calendar):
    frame = b.lines(spark, [(i, 10, 1, i, 100) for i in range(1, 14)])
    detail = run(spark, header, calendar, frame, method="SEASONAL", forecast_periods=20).detail.orderBy("future_seq").collect()
    assert [r["fiscal_month"] for r in detail] == [*range(3, 13), 13]
    # the default factors cover twelve months only
    assert detail[-1]["forecast_amount"] is None and detail[0]["forecast_amount"] == pytest.approx(100)


def test_history_starts_a_year_early(spark, calendar):
    late = b.headers(spark, [{"header_id": 1, "fiscal_year": 2002}])
    frame = b.lines(spark, [(1, 10, 1, 12, 7), (2, 10, 1, 13, 9)])
    assert [r["actual"] for r in run(spark, late, calendar, frame).trends.collect()] == [9]


def test_no_future_and_no_header(spark, header, calendar):
    frame = b.lines(spark, [(1, 10, 1, 113, 5)])
    assert run(spark, header, calendar, frame).detail.count() == 0
    with pytest.raises(ValueError, match="not found"):
        forecast.rolling_forecast(frame, header, calendar, 2)


def test_outputs(spark, header, calendar):
    centres = b.cost_centers(spark, [(1, None), (2, 1)])
    accounts = b.accounts(spark, [{"gl_account_id": 10, "account_type": "R"}, {"gl_account_id": 20, "account_type": "R"}])
    frame = b.lines(spark, [(1, 10, 1, 14, 10), (2, 20, 2, 14, 20)])
    result = run(spark, header, calendar, frame, method="OTHER", forecast_periods=3)
    future = forecast.future_periods(frame.select("fiscal_period_id"), calendar, 3)
    wide = forecast.forecast_pivot(result.detail, future, accounts, centres)
    assert wide.columns[4:] == ["P2001-03", "P2001-04", "P2001-05"]
    assert b.collect(wide, "cost_center_code", "P2001-04") == [("C1", 10), ("C2", 20)]
    summary = b.collect(forecast.forecast_summary(result.detail, accounts), "fiscal_quarter", "total_forecast", "total_upper_bound")
    assert summary == [(1, 30, 36), (2, 60, 72)]
    accuracy = forecast.forecast_accuracy(result, "OTHER", 12, 3).first()
    assert (accuracy["actual_data_points"], accuracy["forecast_data_points"], accuracy["mean_absolute_residual"]) == (2, 6, 0.0)


def test_amounts_never_saturate(spark):
    from finloom.functions.columns import money_from_double

    def money(x):
        return spark.createDataFrame([(x,)], "x double").select(money_from_double(F.col("x")).alias("m")).first()["m"]

    assert money(2.00005) == Decimal("2.0001") and money(-2.00005) == Decimal("-2.0001") and money(None) is None
    for x in (9.5e14, 1e20, -1e30, float("nan"), float("inf")):
        with pytest.raises(Exception, match="no amount can hold"):
            money(x)


def test_factors(spark):
    assert b.collect(seasonal_factors(spark, "[0.5, 1.25]")) == [(1, Decimal("0.5")), (2, Decimal("1.25"))]
    assert b.collect(seasonal_factors(spark, None)) == [(m, 1) for m in range(1, 13)]


def test_values_that_no_amount_can_hold(spark):
    from finloom.operators import forecast

    values = [(1, 1.5, -1e15, 2.0), (2, float("nan"), 1.0, float("inf")), (3, None, None, 8.9e14), (4, -9e14, 0.0, 0.0)]
    rows = [(10, 1, i, 2000, 1, i, "P", i, i, None, *v) for i, *v in values]
    detail = spark.createDataFrame(rows, "gl_account_id int, cost_center_id int, fiscal_period_id int, fiscal_year int, fiscal_quarter int, fiscal_month int, period_name string, future_seq int, seq int, seasonal_factor decimal(8,6), forecast_amount double, lower_bound double, upper_bound double")
    misfits = b.collect(forecast.forecast_misfits(detail), "fiscal_period_id", "column_name", "reason")
    assert misfits == [(1, "lower_bound", "TOO_LARGE"), (2, "forecast_amount", "NOT_A_NUMBER"), (2, "upper_bound", "TOO_LARGE"), (4, "forecast_amount", "TOO_LARGE")]
    table = b.lines(spark, [(70, 1, 1, 1, 5)])
    lines = forecast.forecast_lines(detail, 9, "LINEAR_TREND", table)
    assert b.collect(lines, "line_id", "header_id", "fiscal_period_id", "original_amount", "is_allocated") == [(71, 9, 1, Decimal("1.5"), False)]
    total = forecast.forecast_summary(detail, b.accounts(spark, [{"gl_account_id": 10}])).first()
    assert (total.total_forecast, total.total_lower_bound, total.total_upper_bound, total.left_out) == (Decimal("1.5"), 1, Decimal("890000000000002"), 4)
