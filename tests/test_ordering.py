import random
from decimal import Decimal

import builders as b
import pytest
from pyspark.sql import functions as F

from finloom.functions.ordering import (
    PIECE,
    lay_out,
    with_dense_index,
    with_last_known,
    with_neighbours,
    with_next_known,
    with_running_total,
)
from finloom.operators.consolidate import apply_eliminations, consolidate, elimination_pairs, final_amounts
from finloom.operators.hierarchy import explode_hierarchy


@pytest.fixture
def placed(many_pieces):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([None, i * 2]) if i % 50 > 30 else None, i % 7) for i in range(500)]
    rnd.shuffle(rows)
    frame = many_pieces.createDataFrame(rows, "k long, v long, w long")
    out = lay_out(frame, ["k"])
    assert out.select(PIECE).distinct().count() > 3
    return out, sorted(rows)


def test_dense_index_and_total(placed):
    frame, rows = placed
    got = b.collect(with_running_total(with_dense_index(frame, "i"), "w", "t"), "k", "i", "t")
    total, want = 0, []
    for i, (k, _, w) in enumerate(rows):
        total += w
        want.append((k, i + 1, total))
    assert got == want


def test_known_values_cross_pieces(placed):
    frame, rows = placed
    got = with_next_known(with_last_known(frame, F.col("v"), "p"), F.col("v"), "n").select("k", "p", "n").collect()
    got = {r["k"]: (r["p"], r["n"]) for r in got}
    values = [r[1] for r in rows]
    for i, (k, _, _) in enumerate(rows):
        before = next((v for v in reversed(values[: i + 1]) if v is not None), None)
        after = next((v for v in values[i:] if v is not None), None)
        assert got[k] == (before, after)


def test_neighbours_cross_pieces(placed):
    frame, rows = placed
    got = with_neighbours(frame, ["k"]).select("k", F.col("_before.k").alias("b"), F.col("_after.k").alias("a")).collect()
    assert all(r["b"] == (r["k"] - 1 if r["k"] else None) and r["a"] == (r["k"] + 1 if r["k"] < 499 else None) for r in got)


def walk(amounts, groups=None):
    """Sequential greedy pairing: a line and its successor when they cancel."""
    pairs, i = [], 0
    while i < len(amounts) - 1:
        same = groups is None or groups[i] == groups[i + 1]
        if amounts[i] != 0 and same and amounts[i + 1] == -amounts[i]:
            pairs.append((i, i + 1))
            i += 2
        else:
            i += 1
    return pairs


def pairs_of(spark, amounts, accounts, mode, pieces=None):
    flagged = b.accounts(spark, [{"gl_account_id": a, "intercompany_flag": True} for a in set(accounts)])
    frame = b.lines(spark, [(i, accounts[i], 1, i, amounts[i]) for i in range(len(amounts))])
    return b.collect(elimination_pairs(frame, flagged, mode, pieces), "first_line_id", "second_line_id")


@pytest.mark.parametrize(
    "amounts, want",
    [([5, -5, 5], [(0, 1)]), ([5, -5, -5, 5], [(0, 1), (2, 3)]), ([0, 5, -5], [(1, 2)]), ([0, 0], []), ([5], []), ([5, -5, 5, -5, 5], [(0, 1), (2, 3)])],
)
def test_small_walks(spark, amounts, want):
    assert pairs_of(spark, amounts, [101] * len(amounts), "reference") == want


def test_account_boundary(spark):
    amounts, accounts = [5, -5, 5, -5], [101, 102, 102, 102]
    assert pairs_of(spark, amounts, accounts, "reference") == [(0, 1), (2, 3)]
    assert pairs_of(spark, amounts, accounts, "corrected") == [(1, 2)]


@pytest.mark.parametrize("seed", range(3))
def test_random_walks_over_pieces(many_pieces, seed):
    rnd = random.Random(seed)
    # long alternating stretches, as when one amount fills most of the account
    amounts, sign = [], 1
    while len(amounts) < 600:
        if rnd.random() < 0.03:
            amounts.append(rnd.choice([0, 7, -7, 3]))
        amounts.append(5 * sign)
        sign = -sign if rnd.random() < 0.95 else sign
    accounts = sorted(rnd.choice([101, 101, 101, 102]) for _ in amounts)
    for pieces in (1, 4, 32):
        assert pairs_of(many_pieces, amounts, accounts, "reference", pieces) == walk(amounts)
        assert pairs_of(many_pieces, amounts, accounts, "corrected", pieces) == walk(amounts, accounts)


def test_small_batches_and_pieces_of_one_row(many_pieces):
    """State is carried over Arrow batches and over pieces shorter than a pair."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = many_pieces.conf.get(key)
    amounts = [5, -5, 5, None, 5, -5, -5, 5, 0, 0, "0.0001", "-0.0001", "123456789012345.6789", "-123456789012345.6789", 5, -5, 5, -5, 5]
    plain = [Decimal(x) if x is not None else Decimal("1e9") + i for i, x in enumerate(amounts)]
    try:
        many_pieces.conf.set(key, "2")
        for pieces in (1, 3, 19):
            flagged = b.accounts(many_pieces, [{"gl_account_id": 101, "intercompany_flag": True}])
            frame = b.lines(many_pieces, [(i, 101, 1, i, x or 0) for i, x in enumerate(amounts)])
            frame = frame.withColumn("final_amount", F.when(F.col("line_id") != 3, F.col("final_amount")))
            assert b.collect(elimination_pairs(frame, flagged, "corrected", pieces), "first_line_id", "second_line_id") == walk(plain)
    finally:
        many_pieces.conf.set(key, before)


def test_no_intercompany_lines(spark):
    flagged = b.accounts(spark, [{"gl_account_id": 101, "intercompany_flag": True}])
    assert elimination_pairs(b.lines(spark, [(1, 5, 1, 1, 5)]), flagged).isEmpty()


def test_lines_and_order_are_read_once(spark, tmp_path):
    """The source is scanned by one job; what is left to read are pairs and edges."""
    flagged = b.accounts(spark, [{"gl_account_id": 101, "intercompany_flag": True}])
    path = str(tmp_path / "lines")
    b.lines(spark, [(i, 101, 1, i, 5 - 10 * (i % 2)) for i in range(100)]).write.parquet(path)
    pairs = elimination_pairs(spark.read.parquet(path), flagged, pieces=4)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert path not in "".join(pairs.inputFiles()) and plan.count("FileScan") == 1 and "Window" not in plan
    assert pairs.count() == 50


def test_elimination_effects(spark):
    centres = b.cost_centers(spark, [(1, None), (2, 1)])
    flagged = b.accounts(spark, [{"gl_account_id": 101, "intercompany_flag": True}])
    # centre 1 period 1 (+5) cancels with centre 1 period 2 (-5); centre 2 stays
    frame = b.lines(spark, [(1, 101, 1, 1, 5), (2, 101, 1, 2, -5), (3, 101, 2, 1, 9)])
    amounts = consolidate(frame, explode_hierarchy(centres, b.DAY))
    out = {}
    for mode in ("reference", "corrected"):
        applied = apply_eliminations(amounts, elimination_pairs(frame, flagged, mode), mode)
        out[mode] = b.collect(final_amounts(applied), "cost_center_id", "fiscal_period_id", "final_amount")
    # the first amount is taken off every period of the second line's key
    assert out["reference"] == [(1, 1, Decimal("0.0000")), (1, 2, Decimal("-10.0000")), (2, 1, Decimal("9.0000"))]
    assert out["corrected"] == [(1, 1, Decimal("0.0000")), (1, 2, Decimal("0.0000")), (2, 1, Decimal("9.0000"))]


def test_zero_rows_and_rounding(spark):
    centres = b.cost_centers(spark, [(1, None)])
    frame = b.lines(spark, [(1, 101, 1, 1, 0), (2, 101, 1, 2, "1.2367"), (3, 101, 1, 3, "0.001")])
    amounts = consolidate(frame, explode_hierarchy(centres, b.DAY)).withColumn("elimination_amount", F.lit(0).cast("decimal(38,4)"))
    assert b.collect(final_amounts(amounts), "fiscal_period_id") == [(2,), (3,)]
    rounded = final_amounts(amounts, include_zero=False, rounding=2)
    assert b.collect(rounded, "fiscal_period_id", "final_amount") == [(2, Decimal("1.2400"))]


def test_equal_rows_are_split(many_pieces):
    """Nine rows in ten are the same row; no piece may hold them all."""
    frame = many_pieces.range(2000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(7).alias("k"))
    placed = lay_out(frame, ["k"])
    sizes = [r["count"] for r in placed.groupBy(PIECE).count().collect()]
    assert max(sizes) < 1000
    numbered = with_dense_index(placed, "i")
    got = [r["k"] for r in numbered.orderBy("i").collect()]
    assert got == sorted(got) and [r["i"] for r in numbered.orderBy("i").collect()] == list(range(1, 2001))
