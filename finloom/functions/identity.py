"""Ids of new rows, dense and in a stated order, without bringing the order together.

The order is cut into ranges of bounded size: a histogram of the first order
column, refined where a cell is too full, by the next column where one value
fills it. Rows are then numbered within their range, and every range starts
where the ones before it end. Only counts reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finloom.session import materialise

ROWS_PER_RANGE = 1_000_000
MOST_RANGES = 256
#: Cells of one histogram; at most MOST_RANGES of them are refined at once.
CELLS = 512


@dataclass(frozen=True)
class _Cell:
    """Rows not below ``bound`` (a start of the order columns) and below the next cell's."""

    bound: tuple[int, ...]
    rows: int
    low: tuple[int, ...]
    high: tuple[int, ...]

    def cut(self) -> int | None:
        """The first column in which the cell's rows differ."""
        return next((j for j, (a, b) in enumerate(zip(self.low, self.high)) if a < b), None)


def _not_below(order: list[str], bound: tuple[int, ...]) -> Column:
    """Rows at or behind ``bound`` in lexicographic order."""
    columns = order[: len(bound)]
    return F.struct(*columns) >= F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip(columns, bound)])


def _cell_number(order: list[str], cells: list[_Cell]) -> Column:
    """Number of a row's cell, as nested decisions: their depth is the logarithm of the number of cells."""

    def decide(first: int, last: int) -> Column:
        if first == last:
            return F.lit(first)
        middle = (first + last + 1) // 2
        return F.when(_not_below(order, cells[middle].bound), decide(middle, last)).otherwise(decide(first, middle - 1))

    return decide(0, len(cells) - 1)


def _joined(cells: list[_Cell], target: int) -> list[_Cell]:
    """Neighbouring cells put together while they hold at most ``target`` rows."""
    out: list[_Cell] = []
    for cell in cells:
        if out and out[-1].rows + cell.rows <= target:
            before = out[-1]
            # columns behind the first differing one are not in lexicographic order over both, their extremes still bound the rows
            out[-1] = _Cell(before.bound, before.rows + cell.rows, tuple(map(min, before.low, cell.low)), tuple(map(max, before.high, cell.high)))
        else:
            out.append(cell)
    return out


def order_ranges(rows: DataFrame, order: list[str], rows_per_range: int = ROWS_PER_RANGE) -> list[_Cell]:
    """Cells in order with at most twice the wished number of rows each, unless all rows of one agree in every order column.

    ``order`` names integer columns without nulls; ``rows`` is read once per
    refinement, usually once or twice.
    """
    rows = rows.select(*[F.col(c).cast("long").alias(c) for c in order])
    extremes = [F.min(c).alias(f"low{j}") for j, c in enumerate(order)] + [F.max(c).alias(f"high{j}") for j, c in enumerate(order)]
    counted = [F.count("*").alias("n"), *extremes]

    def cell(bound: tuple[int, ...], r) -> _Cell:
        return _Cell(bound, r["n"], tuple(r[f"low{j}"] for j in range(len(order))), tuple(r[f"high{j}"] for j in range(len(order))))

    whole = rows.agg(*counted).first()
    if not whole["n"]:
        return []
    cells = [cell((), whole)]
    target = max(rows_per_range, -(-whole["n"] // MOST_RANGES))
    while True:
        heavy = {i: c.cut() for i, c in enumerate(cells) if c.rows > target and c.cut() is not None}
        if not heavy:
            return cells
        width = {i: -(-(cells[i].high[j] - cells[i].low[j] + 1) // CELLS) for i, j in heavy.items()}
        number = _cell_number(order, cells).alias("cell")
        place = F.lit(None).cast("long")
        for i, j in heavy.items():
            inside = F.expr(f"({order[j]} - {cells[i].low[j]}L) div {width[i]}L")
            place = F.when(F.col("cell") == i, inside).otherwise(place)
        found = rows.select("*", number).select("*", place.alias("place")).filter("place IS NOT NULL").groupBy("cell", "place").agg(*counted).collect()
        finer: list[_Cell] = []
        for i, before in enumerate(cells):
            if i not in heavy:
                finer.append(before)
                continue
            j = heavy[i]
            parts = sorted((r for r in found if r["cell"] == i), key=lambda r: r["place"])
            cut = [cell((*before.low[:j], before.low[j] + r["place"] * width[i]), r) for r in parts]
            finer += [replace(cut[0], bound=before.bound), *cut[1:]]
        cells = _joined(finer, target)


def with_new_ids(rows: DataFrame, order: list[str], last_id: int, name: str = "line_id", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``rows`` with ``name`` = last_id + 1, last_id + 2, .. in the order of ``order``.

    ``order`` names integer columns that together are unique and never null.
    The rows are stored first, so that counts and numbers mean the same rows.
    No rows give no rows.
    """
    stored = materialise(rows, "new-rows")
    cells = order_ranges(stored, order, rows_per_range)
    if not cells:
        return stored.withColumn(name, F.lit(None).cast("long"))
    before, total = [], last_id
    for c in cells:
        before.append(total)
        total += c.rows
    longs = [F.col(c).cast("long").alias(f"_order{j}") for j, c in enumerate(order)]
    names = [f"_order{j}" for j in range(len(order))]
    ranged = stored.select("*", *longs).withColumn("_range", _cell_number(names, cells))
    offset = F.element_at(F.array(*[F.lit(b).cast("long") for b in before]), F.col("_range") + 1)
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*names))
    return ranged.withColumn(name, (offset + inside).cast("long")).drop("_range", *names)


def largest_id(lines: DataFrame, name: str = "line_id") -> int:
    """The largest id given so far; 0 without any."""
    return lines.agg(F.max(name)).first()[0] or 0
