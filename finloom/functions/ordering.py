"""Ordered computations that never gather the order in one task.

``lay_out`` sorts a frame by range, so that each partition holds a
contiguous piece of the total order; a hot key is spread because the order
ends in a unique number. Windows then run inside the pieces, and one row
per piece carries state across their edges. The per-piece frames have as
many rows as there are sort partitions, whatever the data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finloom.session import materialise

PIECE = "_piece"
SLOT = "_slot"

_SLOT_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits
_SLOT_MASK = (1 << _SLOT_BITS) - 1


def in_order(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """Sort by range and add the piece number and the position inside it; the numbers hold once the frame is stored.

    Rows that tie on ``order`` are told apart by a number, so that even equal
    rows can be split over several pieces.
    """
    placed = df.withColumn("_tie", F.monotonically_increasing_id()).sort(*order, "_tie").drop("_tie")
    placed = placed.withColumn("_mono", F.monotonically_increasing_id())
    return (
        placed.withColumn(PIECE, F.shiftright("_mono", _SLOT_BITS).cast("int"))
        .withColumn(SLOT, F.col("_mono").bitwiseAND(F.lit(_SLOT_MASK)))
        .drop("_mono")
    )


def lay_out(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """``in_order``, stored."""
    return materialise(in_order(df, order), "ordered")


def _in_piece():
    return Window.partitionBy(PIECE).orderBy(SLOT)


def _upto_here():
    return _in_piece().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _from_here():
    # counted from the far end: a frame that shrinks row by row is quadratic
    backwards = Window.partitionBy(PIECE).orderBy(F.col(SLOT).desc())
    return backwards.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _earlier_pieces():
    return Window.orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)


def _later_pieces():
    return Window.orderBy(F.col(PIECE).desc()).rowsBetween(Window.unboundedPreceding, -1)


def with_dense_index(placed: DataFrame, name: str) -> DataFrame:
    """1-based row number over the whole order."""
    offsets = (
        placed.groupBy(PIECE)
        .agg(F.count("*").alias("_n"))
        .select(PIECE, F.coalesce(F.sum("_n").over(_earlier_pieces()), F.lit(0)).alias("_offset"))
    )
    return (
        placed.join(F.broadcast(offsets), PIECE)
        .withColumn(name, F.col("_offset") + F.col(SLOT) + F.lit(1))
        .drop("_offset")
    )


def with_running_total(placed: DataFrame, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over all rows up to and including this one."""
    offsets = (
        placed.groupBy(PIECE)
        .agg(F.sum(value).alias("_n"))
        .select(PIECE, F.coalesce(F.sum("_n").over(_earlier_pieces()), F.lit(0)).alias("_offset"))
    )
    return (
        placed.withColumn("_sofar", F.sum(value).over(_upto_here()))
        .join(F.broadcast(offsets), PIECE)
        .withColumn(name, F.coalesce(F.col("_sofar"), F.lit(0)) + F.col("_offset"))
        .drop("_offset", "_sofar")
    )


def with_neighbours(placed: DataFrame, columns: list[str]) -> DataFrame:
    """Add structs ``_before`` and ``_after`` with the adjacent rows' columns."""
    row = F.struct(*columns)
    sizes = placed.groupBy(PIECE).agg(F.count("*").alias("_n"))
    heads = placed.filter(F.col(SLOT) == 0).select(PIECE, row.alias("_head"))
    tails = placed.join(F.broadcast(sizes), PIECE).filter(F.col(SLOT) == F.col("_n") - 1).select(PIECE, row.alias("_tail"))
    edges = heads.join(tails, PIECE).select(
        PIECE,
        F.lag("_tail").over(Window.orderBy(PIECE)).alias("_edge_before"),
        F.lead("_head").over(Window.orderBy(PIECE)).alias("_edge_after"),
    )
    return (
        placed.withColumn("_before", F.lag(row).over(_in_piece()))
        .withColumn("_after", F.lead(row).over(_in_piece()))
        .join(F.broadcast(edges), PIECE)
        .withColumn("_before", F.coalesce("_before", "_edge_before"))
        .withColumn("_after", F.coalesce("_after", "_edge_after"))
        .drop("_edge_before", "_edge_after")
    )


def with_last_known(placed: DataFrame, value: Column, name: str) -> DataFrame:
    """Last non-null ``value`` at or before each row."""
    held = placed.withColumn("_held", value)
    carry = _ends(held, F.max_by("_held", _known_slot())).select(
        PIECE, F.last("_end", ignorenulls=True).over(_earlier_pieces()).alias("_carry")
    )
    return (
        held.withColumn(name, F.last("_held", ignorenulls=True).over(_upto_here()))
        .join(F.broadcast(carry), PIECE)
        .withColumn(name, F.coalesce(name, "_carry"))
        .drop("_held", "_carry")
    )


def with_next_known(placed: DataFrame, value: Column, name: str) -> DataFrame:
    """First non-null ``value`` at or after each row."""
    held = placed.withColumn("_held", value)
    carry = _ends(held, F.min_by("_held", _known_slot())).select(
        PIECE, F.last("_end", ignorenulls=True).over(_later_pieces()).alias("_carry")
    )
    return (
        held.withColumn(name, F.last("_held", ignorenulls=True).over(_from_here()))
        .join(F.broadcast(carry), PIECE)
        .withColumn(name, F.coalesce(name, "_carry"))
        .drop("_held", "_carry")
    )


def _known_slot() -> Column:
    return F.when(F.col("_held").isNotNull(), F.col(SLOT))


def _ends(held: DataFrame, end: Column) -> DataFrame:
    return held.groupBy(PIECE).agg(end.alias("_end"))
