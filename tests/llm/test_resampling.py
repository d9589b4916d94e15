"""Importance resampling against a plain computation, its ranks against a global sort."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from finloom.llm import alnum, resampling

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = ["Hello World, this é is 3.5", "", None, "x" * 200 + " y " + "Z" * 70 + " " + "q" * 5000 + " end", "one", "!!", "a b c d", "Ünï ÇÉ \x00 a"]


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def expected(rows, target):
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for _, text in rows:
        np.add.at(s, features(text), 1)
    for text in target:
        np.add.at(t, features(text), 1)
    all_s, all_t = float(s.sum() + 10000), float(t.sum() + 10000)
    out = []
    for i, text in rows:
        f = features(text)
        weight = sum(math.floor(1000 * math.log((float(t[b]) + 1) * all_s / ((float(s[b]) + 1) * all_t))) for b in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    chosen = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, row in enumerate(chosen[: 5 * len(chosen) // 100], 1):
        row[4] = rank
    return sorted(map(str, (r[:5] for r in out)))


def result(df):
    return sorted(str(list(r)) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


@pytest.mark.parametrize("chunk_bytes", [1, 50, 1 << 20])
def test_checksums_of_runs(chunk_bytes):
    rows = [words(t) for t in TEXTS]
    got = {1: [], 2: [], 3: []}
    for chunk in alnum.alnum_chunks(pa.array(TEXTS), chunk_bytes):
        for k, (value, there) in enumerate(chunk.runs(3), 1):
            got[k] += value[there].tolist()
    assert got == {k: [zlib.crc32(" ".join(w[i : i + k]).encode()) for w in rows for i in range(len(w) - k + 1)] for k in got}


def corpus(n, seed=3):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "Math", "proof"]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 60)))) for i in range(n)]
    hot = " ".join(rng.choice(vocabulary, 40))
    rows += [(n + i, hot) for i in range(n // 2)] + [(7, hot)] * 40  # copies, and rows that share their id too
    return rows + [(None, hot), (None, None), (n + n, None), (n + n + 1, ""), (n + n + 2, "é " * 30000)]


def test_resample_equals_a_plain_computation(many_pieces):
    spark, rows = many_pieces, corpus(900)
    target = ["Math proof w1 w2", None, "", "É Math w3 " * 50]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, score string, k0 string").repartition(9)
    got = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), keep=("k0", "score"))
    assert got.columns == ["doc_id", "k0", "n_words", "n_features", "weight", "score", "rank"]
    assert result(got) == expected(rows, target)


def test_resample_empty_tables(spark):
    docs = spark.createDataFrame(corpus(60), "doc_id long, text string")
    none = docs.where("1 = 0")
    assert resampling.resample(none, docs).count() == 0
    assert result(resampling.resample(docs, none.select("text"))) == expected(corpus(60), [])


@pytest.mark.parametrize("share", [(0, 100), (5, 100), (1, 2), (1, 1)])
def test_ranks_of_equal_rows(many_pieces, share):
    """A third of the rows agree in every order column; every rank is given once and follows the order."""
    rows = many_pieces.range(5000).selectExpr("id % 10 <> 0 AS c", "IF(id % 3 = 0, 7L, id * 7919 % 1000) AS a", "IF(id % 3 = 0, 1L, id % 4) AS b").repartition(6)
    got = resampling.rank_highest(rows, "c", ["a", "b"], share).toPandas()
    drawn = got[got["rank"].notna()].sort_values("rank")
    chosen = sorted(map(tuple, rows.where("c").select("a", "b").collect()))
    assert len(got) == 5000 and drawn["c"].all()
    assert drawn["rank"].tolist() == list(range(1, share[0] * len(chosen) // share[1] + 1))
    assert list(zip(drawn["a"], drawn["b"])) == chosen[: len(drawn)]


def test_segments_stay_small_with_equal_rows(many_pieces):
    rows = many_pieces.range(20000).select(F.lit(True).alias("c"), F.lit(1).cast("long").alias("a")).repartition(5)
    got = resampling.rank_highest(rows, "c", ["a"], (1, 1))
    assert got.agg(F.count_distinct("rank")).first()[0] == 20000
    parts = got.where("rank IS NOT NULL").groupBy(F.spark_partition_id()).count().collect()
    assert max(p["count"] for p in parts) < 20000 / 2
