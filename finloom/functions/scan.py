"""Ordered frames read once: pieces of an order, scanned apart and put together by their states.

A computation that walks over all rows in order and remembers a small state is
run on every piece for each state it may be entered with. What a piece does to
the state is its summary; composing the summaries in order tells the state
every piece is really entered with, and so which of its results hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from finloom.session import materialise

ROWS_PER_PIECE = 1_000_000


def in_pieces(rows: DataFrame, order: list[str], pieces: int | None = None) -> DataFrame:
    """``rows``, stored and dealt into sorted partitions that follow each other in ``order``, which is unique.

    The number of pieces follows the number of rows, counted while they are stored.
    """
    seen = Observation("rows")
    stored = materialise(rows.observe(seen, F.count(F.lit(1)).alias("n")), "unordered")
    if pieces is None:
        pieces = max(1, -(-(seen.get.get("n") or 0) // ROWS_PER_PIECE))
    return stored.repartitionByRange(pieces, *order).sortWithinPartitions(*order)


def _walk(link: np.ndarray, opened: bool) -> np.ndarray:
    """Whether each row is left open by the greedy walk; ``opened`` is the state of the row before the first."""
    place = np.arange(len(link))
    fresh = np.maximum.accumulate(np.where(link, -1, place))  # the last row without a link to the one before it is open
    return np.where(fresh >= 0, (place - fresh) % 2 == 0, opened ^ (place % 2 == 0))


def _parts(amount: Column) -> list[Column]:
    """An amount of four decimals as two numbers and a sign, which are compared faster than decimals."""
    whole = F.floor(F.abs(amount)).cast("long")
    return [whole.alias("_whole"), ((F.abs(amount) - whole) * 10000).cast("long").alias("_rest"), F.signum(amount).cast("int").alias("_sign")]


def cancelling_neighbours(rows: DataFrame, order: list[str], amount: str, within: list[str], pieces: int | None = None) -> DataFrame:
    """Structs ``first`` and ``second``: neighbours in ``order`` whose amounts cancel, paired greedily from the start.

    Walking the rows, one pairs with its successor when their amounts are
    opposite and not zero and both agree in the columns ``within``; both are
    then used up. The state between two rows is whether the earlier one is
    still open. Null amounts pair with nothing. The order is read once; only
    the first and last row of each piece reach the driver.
    """
    columns = rows.columns
    width, keys = len(columns), [columns.index(c) for c in within]
    ordered = in_pieces(rows, order, pieces).select(*columns, *_parts(F.col(amount)))
    row = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in rows.schema)
    out = f"piece int, is_edge boolean, if_open boolean, if_used boolean, first struct<{row}>, second struct<{row}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId()
        head = last = None
        state = (True, False)  # of the row before, if the first row of the piece is open or used up

        def found(first: pa.StructArray, second: pa.StructArray, edge: bool, states: list) -> pa.RecordBatch:
            n = len(first)
            flags = [pa.array(s, pa.bool_()) for s in states]
            return pa.RecordBatch.from_arrays(
                [pa.array([piece] * n, pa.int32()), pa.array([edge] * n, pa.bool_()), *flags, first, second],
                ["piece", "is_edge", "if_open", "if_used", "first", "second"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            new = last is None
            whole = pa.Table.from_batches([batch] if new else [last, batch]).combine_chunks().to_batches()[0]
            numbers = [whole.column(width + k).to_numpy(zero_copy_only=False) for k in range(3)]
            link = (numbers[0][1:] == numbers[0][:-1]) & (numbers[1][1:] == numbers[1][:-1])
            link &= (numbers[2][1:] * numbers[2][:-1]) == -1
            for k in keys:
                key = whole.column(k).to_numpy(zero_copy_only=False)
                link &= key[1:] == key[:-1]
            opens = [_walk(link, s) for s in state]
            rows_of = pa.StructArray.from_arrays([whole.column(i) for i in range(width)], columns)
            second = np.flatnonzero(~opens[0] | ~opens[1]) + 1
            if len(second):
                yield found(rows_of.take(pa.array(second - 1)), rows_of.take(pa.array(second)), False, [~opens[0][second - 1], ~opens[1][second - 1]])
            if len(link):
                state = (bool(opens[0][-1]), bool(opens[1][-1]))
            head = rows_of.slice(0, 1) if new else head
            last = batch.slice(batch.num_rows - 1, 1)
        if last is not None:
            tail = pa.StructArray.from_arrays([last.column(i) for i in range(width)], columns)
            yield found(head, tail, True, [[state[0]], [state[1]]])

    scanned = materialise(ordered.mapInArrow(run, out), "neighbours")
    edges = sorted(scanned.filter("is_edge").collect(), key=lambda r: r["piece"])
    entered: list[tuple[int, bool]] = []
    across = []
    before = None
    for edge in edges:
        used = before is not None and before[1] and _cancels(before[0], edge["first"], amount, within)
        if used:
            across.append((before[0], edge["first"]))
        entered.append((edge["piece"], used))
        before = (edge["second"], edge["if_used"] if used else edge["if_open"])
    spark = rows.sparkSession
    states = spark.createDataFrame(entered, "piece int, used boolean")
    inside = scanned.filter("NOT is_edge").join(F.broadcast(states), "piece").filter(F.expr("if(used, if_used, if_open)"))
    return inside.select("first", "second").unionByName(spark.createDataFrame(across, f"first struct<{row}>, second struct<{row}>"))


def _cancels(one, other, amount: str, within: list[str]) -> bool:
    if one[amount] is None or other[amount] is None or one[amount] == 0:
        return False
    return one[amount] == -other[amount] and all(one[c] == other[c] for c in within)
