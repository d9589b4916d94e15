"""Dense ids over ranges against a plain sort."""

import random
from decimal import Decimal

import builders as b
import pytest
from pyspark.sql import functions as F

from finloom.functions.identity import largest_id, order_ranges, with_new_ids
from finloom.operators.sinks import new_lines, upsert
from finloom.schemas import BUDGET_LINE_ITEM

RNG = random.Random(9)
ORDERS = {
    "dense": [(i, 0) for i in range(900)],
    "far apart": [(i << 33, 0) for i in range(40)] + [((i << 33) + 5, 0) for i in range(40)] + [(2**62, 1), (-(2**61), 2)],
    "one value in the first column": [(7, i) for i in range(900)],
    "a third in one value": [(7, i) for i in range(300)] + [(RNG.randrange(10**12), 10**6 + i) for i in range(600)],
    "one row": [(5, 5)],
}


@pytest.mark.parametrize("name", ORDERS)
def test_ids_follow_the_order(many_pieces, name):
    rows = ORDERS[name][:]
    RNG.shuffle(rows)
    frame = many_pieces.createDataFrame(rows, "a long, b int").repartition(5)
    got = with_new_ids(frame, ["a", "b"], 1000, rows_per_range=50)
    assert got.columns == ["a", "b", "line_id"]
    assert sorted(got.collect()) == [(*r, 1001 + i) for i, r in enumerate(sorted(rows))]


@pytest.mark.parametrize("name", ORDERS)
def test_ranges_are_bounded_and_complete(spark, name):
    cells = order_ranges(spark.createDataFrame(ORDERS[name], "a long, b long"), ["a", "b"], rows_per_range=50)
    assert sum(c.rows for c in cells) == len(ORDERS[name]) and max(c.rows for c in cells) <= 50
    assert [c.bound for c in cells] == sorted(c.bound for c in cells) and cells[0].bound == ()


def test_no_rows_and_rows_that_agree(spark):
    assert with_new_ids(spark.createDataFrame([], "a long"), ["a"], 7).schema["line_id"].dataType.simpleString() == "bigint"
    same = with_new_ids(spark.createDataFrame([(1,)] * 60, "a long"), ["a"], 7, rows_per_range=10)
    assert sorted(r["line_id"] for r in same.collect()) == list(range(8, 68))
    assert largest_id(b.lines(spark, [])) == 0


def test_new_lines_have_ids_and_defaults(spark):
    table = b.lines(spark, [(41, 1, 1, 1, 5), (40, 1, 1, 2, 5, 2)])
    rows = spark.createDataFrame([(3, 1, 9, 9, 2, Decimal("4.50")), (3, 1, 9, 9, 1, None)], "header_id int, gl_account_id int, cost_center_id int, fiscal_period_id int, n int, original_amount decimal(19,4)")
    got = new_lines(rows, table, ["n"])
    assert got.schema.fieldNames() == BUDGET_LINE_ITEM.fieldNames()
    assert b.collect(got, "line_id", "original_amount", "adjusted_amount", "final_amount", "is_allocated", "source_system") == [
        (42, 0, 0, 0, False, None), (43, Decimal("4.5"), 0, Decimal("4.5"), False, None)]


def test_upsert_gives_ids_in_order_of_the_rows(spark):
    table = b.lines(spark, [(1, 10, 1, 1, 5), (2, 10, 1, 2, 6), (9, 10, 1, 1, 70, 2)])
    fresh = b.lines(spark, [(8, 10, 1, 2, 60), (7, 10, 1, 4, 40), (6, 10, 1, 3, 1), (9, 10, 1, 3, 90)]).withColumn("row_id", F.col("line_id")).drop("line_id")
    got = upsert(fresh, table.filter("header_id = 1"), "row_id", table)
    assert got.columns == table.columns
    assert b.collect(got, "line_id", "fiscal_period_id", "final_amount", "is_allocated") == [(1, 1, 5, False), (2, 2, 60, False), (10, 4, 40, False), (11, 3, 90, False)]
