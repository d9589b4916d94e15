"""Document quality by a factorisation machine.

Inputs are hashed words and structure statistics of the whole text. Pairwise
interactions have low rank; a score takes linear time through
sum_{i<j} <v_i, v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i x_i|^2) / 2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finloom.llm.words import WordChunk, word_chunks

BUCKETS = 4096
STATISTICS = 14  # length of _statistics
TRAIN_ROWS = 20000


def _statistics(data: np.ndarray, words: int) -> np.ndarray:
    """Shares of kinds of bytes, of repeated lines, lengths; all between about 0 and 1."""
    n = max(len(data), 1)
    count = np.bincount(data, minlength=256)
    upper, lower, digit = count[65:91].sum(), count[97:123].sum(), count[48:58].sum()
    space, high = count[[32, 9, 10, 11, 12, 13]].sum(), count[128:].sum()
    punctuation = count[[44, 46]].sum()
    other = len(data) - upper - lower - digit - space - high - punctuation
    lines = bytes(data).split(b"\n")
    marks = [count[124], count[33], count[35] + count[36] + count[37] + count[38] + count[42]]
    return np.array(
        [1.0, upper / n, digit / n, space / n, other / n * 4, min(1, punctuation / n * 20), *(np.minimum(1, np.array(marks) / max(words, 1) * 2)),
         np.log1p(words) / 10, min(1, n / max(words, 1) / 20), 1 - len(set(lines)) / len(lines), np.log1p(len(lines)) / 10, high / n]
    )


def features(chunk: WordChunk) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and values of each text's inputs: statistics first, then word buckets with damped, normed counts."""
    for i in range(len(chunk)):
        data = chunk.data[chunk.byte_bounds[i] : chunk.byte_bounds[i + 1]]
        hashes = chunk.hashes[chunk.bounds[i] : chunk.bounds[i + 1]]
        bucket, count = np.unique((hashes % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
        weight = np.log1p(count)
        weight = weight / max(np.sqrt((weight**2).sum()), 1e-9)
        yield np.concatenate([np.arange(STATISTICS), STATISTICS + bucket]), np.concatenate([_statistics(data, len(hashes)), weight])


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, place: np.ndarray, value: np.ndarray) -> float:
        v = self.factors[place] * value[:, None]
        total = v.sum(0)
        return float(self.bias + self.linear[place] @ value + 0.5 * (total @ total - (v**2).sum()))

    def score(self, place: np.ndarray, value: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(place, value), -30, 30))))


Example = tuple[np.ndarray, np.ndarray]


def examples(texts: list[str]) -> list[Example]:
    """Features of a few texts that are at hand."""
    return [x for chunk in word_chunks(pa.array(texts, pa.large_string()), fold=False) for x in features(chunk)]


def train(rows: list[Example], labels: list[int], rank: int = 8, epochs: int = 12, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Adaptive gradient descent on log loss over features; without examples of both labels every score is the share of label 1 (0.5 without any)."""
    size = STATISTICS + BUCKETS
    y = np.array(labels, float)
    rng = np.random.default_rng(seed)
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    machine = Machine(float(np.log(share / (1 - share))), np.zeros(size), np.zeros((size, rank)))
    if len(set(labels)) < 2:
        return machine
    machine.factors = rng.normal(0, 0.02, (size, rank))
    g_linear, g_factors, g_bias = np.full(size, 1e-6), np.full((size, rank), 1e-6), 1e-6
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            place, value = rows[i]
            error = (machine.score(place, value) - y[i]) * weight[i]
            v = machine.factors[place]
            total = (v * value[:, None]).sum(0)
            d_linear = error * value + decay * machine.linear[place]
            d_factors = error * value[:, None] * (total - v * value[:, None]) + decay * v
            g_bias += error**2
            g_linear[place] += d_linear**2
            g_factors[place] += d_factors**2
            machine.bias -= rate * error / np.sqrt(g_bias)
            machine.linear[place] -= rate * d_linear / np.sqrt(g_linear[place])
            machine.factors[place] -= rate * d_factors / np.sqrt(g_factors[place])
    return machine


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def _feature_lists(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Features of texts as lists of small numbers; null texts are empty."""
    for texts in batches:
        wide = texts.cast(pa.large_string()).fill_null("")
        found = [x for chunk in word_chunks(wide, fold=False) for x in features(chunk)]
        ends = pa.array(np.cumsum([0, *(len(place) for place, _ in found)]), pa.int32())
        flat = [np.concatenate([x[k] for x in found]) if found else np.zeros(0) for k in (0, 1)]
        lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(kind))) for x, kind in zip(flat, (np.int16, np.float32))]
        yield pa.StructArray.from_arrays(lists, ["place", "value"])


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Machine:
    """Trains on at most ``most`` labelled rows that are not held out, taken by a hash of the id; labels that are null or not 0 or 1 do not count.

    Features are made where the texts are; the driver gets six bytes per
    feature, in the order of ids and hashes of the texts, and no text.
    """
    chosen = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    listed = F.arrow_udf(_feature_lists, "place array<short>, value array<float>")(F.col("text"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.select("doc_id", F.xxhash64("text").alias("h"), F.col("quality").cast("int"), listed.alias("x")).orderBy("doc_id", "h").limit(most)
    table = rows.select("quality", "x.place", "x.value").toArrow().combine_chunks()
    learned: list[Example] = []
    for batch in table.to_batches():
        place, value = batch.column(1), batch.column(2)
        ends = place.offsets.to_numpy()
        numbers = [x.values.to_numpy() for x in (place, value)]
        learned += [(numbers[0][a:b], numbers[1][a:b]) for a, b in zip(ends, ends[1:])]
    return train(learned, table["quality"].to_pylist())


def score(df: DataFrame, machine: Machine, text: str = "text", into: str = "score") -> DataFrame:
    """``df`` with ``into`` from 0 to 1; null and empty texts are scored by their statistics. A column named ``into`` is replaced."""
    shared = df.sparkSession.sparkContext.broadcast((machine.bias, machine.linear, machine.factors))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Machine(*shared.value)
        for texts in batches:
            array = pa.array([t or "" for t in texts], pa.large_string())
            yield pd.Series([own.score(*x) for chunk in word_chunks(array, fold=False) for x in features(chunk)], dtype=float)

    return df.withColumn(into, F.pandas_udf(run, "double")(F.col(f"`{text}`")))
