"""Documents of fragments against an XML parser."""

import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from finloom.plans.documents import Section, document, element, items_of, leaf, write_document

HARD = ["a<b>&\"c'", " two  blanks ", "line\nbreak\r\n", "é ü 漢", "", None, "]]>", "<Item>"]


@pytest.fixture(scope="module")
def pieces(spark):
    rows = spark.createDataFrame([(i, HARD[i % len(HARD)], i * 7 % 23) for i in range(50)], "id int, text string, k int")
    nested = F.array_join(F.transform(F.sequence(F.lit(0), F.col("k") % 3), lambda i: element("Part", {"N": i})), "")
    item = element("Item", {"ID": F.col("place"), "Name": F.col("text")}, [leaf("K", F.col("k")), leaf("Text", F.col("text")), nested])
    sections = [
        Section("Items", rows, item, ["k", "id"], "place"),
        Section(None, spark.range(1), element("Total", {}, [leaf("N", F.lit(50))]), ["id"], few=True),
        Section("None", rows.filter("1 = 0"), element("Item", {"ID": F.col("id")}), ["id"]),
    ]
    return document(spark, "Root", {"A": "x & <y>", "B": None, "C": 5}, sections, per_chunk=7)


def test_a_parser_reads_the_whole_document(pieces):
    root = ET.fromstring("\n".join(r["text"] for r in pieces.orderBy("section", "chunk").collect()))
    assert root.tag == "Root" and root.attrib == {"A": "x & <y>", "C": "5"}
    assert [c.tag for c in root] == ["Items", "Total", "None"] and len(root.find("None")) == 0
    want = sorted(((i * 7 % 23, i) for i in range(50)))
    for place, (item, (k, i)) in enumerate(zip(root.find("Items"), want, strict=True), 1):
        text = HARD[i % len(HARD)]
        assert item.get("ID") == str(place) and item.find("K").text == str(k) and len(item.findall("Part")) == k % 3 + 1
        assert item.get("Name") == text
        assert (item.find("Text") is None) == (text is None) and (text is None or (item.find("Text").text or "") == text)


def test_chunks_are_bounded(pieces):
    assert max(len(r["text"].split("\n")) for r in pieces.collect()) == 7


def test_items_are_parsed_back(pieces):
    got = items_of(pieces, "Item", "_ID long, K int, Part array<struct<_N:int>>").orderBy("_ID").collect()
    want = sorted(((i * 7 % 23, i) for i in range(50)))
    assert [(r["_ID"], r["K"], len(r["Part"])) for r in got] == [(n, k, k % 3 + 1) for n, (k, _) in enumerate(want, 1)]


def test_written_files_follow_the_order(spark, pieces, tmp_path):
    path = str(tmp_path / "doc")
    write_document(pieces, path)
    files = sorted((tmp_path / "doc").glob("part-*"))
    assert ET.fromstring("".join(f.read_text(encoding="utf-8") for f in files)).get("C") == "5"
