"""Writing budget lines: new lines with their ids and defaults, insert-ignore, upsert, partition overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finloom.functions.identity import largest_id, with_new_ids
from finloom.schemas import FINAL, MONEY, NATURAL_KEY
from finloom.session import materialise


def first_per_key(rows: DataFrame, order: str, last: bool = False) -> DataFrame:
    """The row with the lowest (or highest) ``order`` of each natural key.

    An aggregate rather than a window: rows of one key are reduced before
    the shuffle, so a key with very many rows stays harmless. Rows of equal
    order are told apart by their other columns.
    """
    rest = [c for c in rows.columns if c not in NATURAL_KEY and c != order]
    row = F.struct(F.col(order).alias(order), *rest)
    pick = F.max(row) if last else F.min(row)
    picked = rows.groupBy(*NATURAL_KEY).agg(pick.alias("_row"))
    return picked.select(*NATURAL_KEY, *[F.col(f"_row.{c}").alias(c) for c in rest])


def insert_ignore(rows: DataFrame, target: DataFrame, order: str) -> DataFrame:
    """The rows an insert with ignored duplicates adds to ``target``."""
    return first_per_key(rows, order).join(target.select(*NATURAL_KEY), NATURAL_KEY, "left_anti")


UPDATED = ["original_amount", "adjusted_amount", "spread_method", "source_reference"]


def upsert_actions(rows: DataFrame, target: DataFrame, order: str) -> DataFrame:
    """The last row of each key with the action it causes: INSERT or UPDATE."""
    present = target.select(*NATURAL_KEY).withColumn("_present", F.lit(True))
    return (
        first_per_key(rows, order, last=True)
        .join(present, NATURAL_KEY, "left")
        .withColumn("action", F.when(F.col("_present"), "UPDATE").otherwise("INSERT"))
        .drop("_present")
    )


# Columns that a new line has a default for.
DEFAULTS = {"original_amount": 0, "adjusted_amount": 0, "is_allocated": False}


def new_lines(rows: DataFrame, lines: DataFrame, order: list[str], keep: list[str] | None = None) -> DataFrame:
    """``rows`` as complete new lines of the table ``lines``: all its columns, defaults, and ids above the largest one.

    ``lines`` is the whole table, since ids are unique over all budgets; the
    ids follow ``order``, integer columns that tell the rows apart. Every
    writer of lines takes them from here. ``keep`` names further columns of
    ``rows`` to carry along.
    """
    numbered = with_new_ids(rows, order, largest_id(lines))

    def value(name: str, kind):
        if name == "final_amount":
            amounts = [value(c, MONEY) for c in ("original_amount", "adjusted_amount")]
            return (amounts[0] + amounts[1]).cast(FINAL)
        given = F.col(name) if name in numbered.columns else F.lit(None)
        default = F.lit(DEFAULTS[name]) if name in DEFAULTS else None
        return (given if default is None else F.coalesce(given.cast(kind), default)).cast(kind)

    return numbered.select(*[value(f.name, f.dataType).alias(f.name) for f in lines.schema], *(keep or []))


def upsert(rows: DataFrame, target: DataFrame, order: str, lines: DataFrame | None = None) -> DataFrame:
    """``target`` after the upsert: matched rows take the new amounts, others are added as new lines in the order of ``order``.

    ``lines`` is the whole table when ``target`` is a part of it.
    """
    # the order is kept beside the rows: it numbers the new lines
    actions = materialise(upsert_actions(rows.withColumn("_place", F.col(order)), target, order), "upsert")
    updated = [c for c in UPDATED if c in rows.columns and c in target.columns]
    changes = actions.filter("action = 'UPDATE'").select(*NATURAL_KEY, F.lit(True).alias("_new"), *[F.col(c).alias(f"_n_{c}") for c in updated])

    def value(c: str):
        kind = target.schema[c].dataType
        if c == "final_amount":
            return F.coalesce(F.when(F.col("_new"), (value("original_amount") + value("adjusted_amount")).cast(kind)), F.col(c))
        if c in updated:
            return F.when(F.col("_new"), F.col(f"_n_{c}").cast(kind)).otherwise(F.col(c))
        return F.col(c)

    kept = target.join(changes, NATURAL_KEY, "left").select(*[value(c).alias(c) for c in target.columns])
    added = new_lines(actions.filter("action = 'INSERT'"), target if lines is None else lines, ["_place"])
    return kept.unionByName(added.select(*target.columns))


def append_lines(rows: DataFrame, path: str) -> None:
    """Append budget lines to the table at ``path``, one folder per budget."""
    rows.write.mode("append").partitionBy("header_id").parquet(path)


def overwrite_budgets(rows: DataFrame, path: str, from_target: bool = True) -> None:
    """Replace exactly the budgets that ``rows`` contains.

    Rows computed from the very folders that are about to be replaced
    (``from_target``) are stored first.
    """
    ready = materialise(rows, "overwrite") if from_target else rows
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("header_id").parquet(path)

