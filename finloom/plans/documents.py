"""XML documents of any length as ordered fragments.

An element is a column of text, so nested ones are put together inside a row.
A document is a frame of pieces in order (section, chunk, text): the root's
start, each section's start, its items in chunks of bounded size, and the
ends. No task ever holds a whole document. Every item is one line of text.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finloom.functions.ordering import lay_out, with_dense_index

ITEMS_PER_CHUNK = 1000


def _escaped(value: Column) -> Column:
    text = value.cast("string")
    for character, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;")):
        text = F.replace(text, F.lit(character), F.lit(entity))
    return text


def element(tag: str, attributes: dict[str, Column] | None = None, children: list[Column] | None = None) -> Column:
    """``<tag a="..">children</tag>``; null attributes and null children are left out."""
    listed = [F.concat(F.lit(f' {name}="'), _escaped(value), F.lit('"')) for name, value in (attributes or {}).items()]
    return F.concat(F.concat_ws("", F.lit(f"<{tag}"), *listed, F.lit(">"), *(children or [])), F.lit(f"</{tag}>"))


def leaf(tag: str, value: Column) -> Column:
    """``<tag>value</tag>``, null for a null value."""
    return F.concat(F.lit(f"<{tag}>"), _escaped(value), F.lit(f"</{tag}>"))


class Section(NamedTuple):
    """Items of ``rows`` in ``order`` within an element ``tag``; without a tag they stand in the root.

    ``identified`` gives the items their place in the order, from 1, as an id;
    ``few`` is for sections of a fixed, small size.
    """

    tag: str | None
    rows: DataFrame
    item: Column
    order: list
    identified: str | None = None
    few: bool = False


def document(spark: SparkSession, root: str, attributes: dict[str, object], sections: list[Section], per_chunk: int = ITEMS_PER_CHUNK) -> DataFrame:
    """section, chunk, text: read in this order the texts are the document.

    The order of a section's items is spread like any other order; a chunk
    brings at most ``per_chunk`` items together.
    """
    kind = "section int, chunk long, text string"
    start = spark.range(1).select(element(root, {k: F.lit(v) for k, v in attributes.items()}).alias("t")).first()["t"]
    fixed, parts = [(0, 0, start[: -len(f"</{root}>")])], []
    for i, section in enumerate(sections):
        number = 3 * i + 1
        if section.tag:
            fixed += [(number, 0, f"<{section.tag}>"), (number + 2, 0, f"</{section.tag}>")]
        if section.few:
            placed = section.rows.withColumn("_place", F.row_number().over(Window.orderBy(*section.order)).cast("long"))
        else:
            placed = with_dense_index(lay_out(section.rows, section.order), "_place")
        named = placed.withColumn(section.identified, F.col("_place")) if section.identified else placed
        lines = named.select(F.col("_place"), section.item.alias("_line"))
        chunk = F.expr(f"(_place - 1) div {per_chunk}")
        listed = F.array_sort(F.collect_list(F.struct("_place", "_line")))
        whole = lines.groupBy(chunk.alias("chunk")).agg(F.array_join(listed["_line"], "\n").alias("text"))
        parts.append(whole.select(F.lit(number + 1).alias("section"), "chunk", "text"))
    fixed.append((3 * len(sections) + 1, 0, f"</{root}>"))
    result = spark.createDataFrame(fixed, kind)
    for part in parts:
        result = result.unionByName(part)
    return result


def write_document(pieces: DataFrame, path: str) -> None:
    """The document as text files whose names follow its order."""
    pieces.sort("section", "chunk").select("text").write.text(path)


def items_of(pieces: DataFrame, tag: str, schema: str) -> DataFrame:
    """The items ``tag`` of a document as columns; attributes are named with a leading underscore."""
    lines = pieces.select(F.explode(F.split("text", "\n")).alias("line"))
    mine = lines.filter(F.col("line").rlike(f"^<{tag}[ >]"))
    return mine.select(F.from_xml("line", schema, {"rowTag": tag, "ignoreSurroundingSpaces": "false"}).alias("item")).select("item.*")
