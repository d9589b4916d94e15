"""The fitted machine on the given tables: held-out accuracy, ties, and what the driver gets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from finloom.llm import quality
from finloom.llm.shared import table

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return table(spark, FOLDER, "documents").select("doc_id", "text"), table(spark, FOLDER, "labels")


@pytest.fixture(scope="module")
def machine(tables):
    return quality.fit(*tables)


def test_held_out_accuracy(tables, machine):
    docs, labels = tables
    scored = quality.score(docs, machine).join(labels, "doc_id").where(quality.held_out()).toPandas()
    good = (scored["score"] >= 0.3).astype(int) == scored["quality"]
    assert len(scored) > 50 and good.mean() > 0.95


def test_labels_of_held_out_rows_are_not_read(tables, machine):
    docs, labels = tables
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.fit(docs.repartition(7), turned.repartition(3))
    assert again.bias == machine.bias and np.array_equal(again.linear, machine.linear)


def test_features_from_executors_equal_those_at_hand(spark):
    texts = ["one two two", None, "", "UPPER | ### 12\nline\nline", "wide " * 3000]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    listed = F.arrow_udf(quality._feature_lists, "place array<short>, value array<float>")(F.col("text"))
    got = {r.i: r.x for r in frame.select("i", listed.alias("x")).collect()}
    for i, (place, value) in enumerate(quality.examples([t or "" for t in texts])):
        assert got[i].place == place.tolist() and np.allclose(got[i].value, value, rtol=1e-6)


def test_equal_rows_score_alike_and_clashing_columns_stay(spark, machine):
    docs = spark.createDataFrame([(1, "same text", "a"), (1, "same text", "b"), (None, None, "c"), (2, "", "d")], "doc_id long, text string, quality string")
    rows = quality.score(docs, machine).collect()
    assert len({r.score for r in rows if r.text == "same text"}) == 1 and len({r.score for r in rows if not r.text}) == 1
    assert {r.quality for r in rows} == set("abcd")


def test_no_rows_and_one_label(spark):
    docs = spark.createDataFrame([(i, "some text") for i in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(8)], "doc_id long, quality int")
    assert quality.fit(docs.where("1 = 0"), labels).score(np.array([0]), np.array([1.0])) == pytest.approx(0.5)
    assert quality.fit(docs, labels).score(np.array([0]), np.array([1.0])) == pytest.approx(0.999)
