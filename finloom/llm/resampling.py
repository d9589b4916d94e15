"""Importance resampling of documents towards a target collection.

Hashed runs of one to three words are counted over all raw and all target
texts; a bucket's gain is the logarithm of its smoothed share in the target
over that in the raw texts. A document's weight is the sum over its runs,
taken from one array. A reproducible Gumbel number is added and the highest
scores are drawn without replacement.

Ranks come from parallel sorting by regular sampling: every stored run is
sorted locally, rows at regular places of the runs give the splitters,
segments are exchanged and merged, and prefix counts of the segments give the
exact rank of every row. Segments that lie wholly behind the draw stay put.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finloom.llm.alnum import alnum_chunks
from finloom.session import materialise

BUCKETS = 10000
LONGEST_RUN = 3
#: Samples of one run that reach the driver, 32 bytes each; with fewer segments than this a run gives one sample per segment.
SAMPLES_OF_A_RUN = 256


def bucket_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """bucket, n: how many runs of words of all texts fall into each bucket; each task adds up its own before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for chunk in alnum_chunks(batch.column(0)):
                for value, there in chunk.runs(LONGEST_RUN):
                    total += np.bincount(value[there] % np.uint32(BUCKETS), minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])

    return df.select(F.col(f"`{text}`")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of every bucket, from at most ``BUCKETS`` rows of counts each."""
    s, t = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for counts, into in ((raw, s), (target, t)):
        for bucket, n in counts.collect():
            into[bucket] = n
    all_s, all_t = s.sum() + BUCKETS, t.sum() + BUCKETS
    return np.array([math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s, t)], np.int64)


def weigh(df: DataFrame, gain: np.ndarray, text: str = "text") -> DataFrame:
    """``df`` without its text, with n_words, n_features and weight; columns of these names are replaced."""
    shared = df.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for texts in batches:
            words, weights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for chunk in alnum_chunks(texts):
                word_gain = np.zeros(len(chunk.starts) + 1, np.int64)
                for value, there in chunk.runs(LONGEST_RUN):
                    word_gain[1:] += np.where(there, own[value % np.uint32(BUCKETS)], 0)
                total = np.cumsum(word_gain)
                words.append(np.diff(chunk.bounds))
                weights.append(total[chunk.bounds[1:]] - total[chunk.bounds[:-1]])
            n, weight = np.concatenate(words), np.concatenate(weights)
            features = sum(np.maximum(n - k, 0) for k in range(LONGEST_RUN))
            yield pa.StructArray.from_arrays([pa.array(n), pa.array(features), pa.array(weight)], ["n_words", "n_features", "weight"])

    added = ["n_words", "n_features", "weight"]
    weighed = F.arrow_udf(run, "n_words long, n_features long, weight long")(F.col(f"`{text}`"))
    rest = [F.col(f"`{c}`") for c in df.columns if c != text and c.lower() not in added]
    return df.select(F.struct(*rest).alias("row"), weighed.alias("w")).select("row.*", "w.*")


def gumbel_score(doc_id: str = "doc_id", weight: str = "weight", seed: int = 42) -> Column:
    """The weight and a Gumbel number of the id's hash, in thousandths; a null id hashes like an empty one."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return (F.col(weight) + F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))).cast("long")


def _behind(keys: list[np.ndarray], splitters: list[np.ndarray]) -> np.ndarray:
    """For each row of ascending composite keys, how many splitters are not greater: a binary search of all rows at once."""
    low = np.zeros(len(keys[0]), np.int64)
    high = np.full(len(keys[0]), len(splitters[0]), np.int64)
    while (open_ := low < high).any():
        middle = np.minimum((low + high) // 2, max(len(splitters[0]) - 1, 0))
        less, equal = np.zeros(len(low), bool), np.ones(len(low), bool)
        for key, splitter in zip(keys, splitters):
            other = splitter[middle]
            less |= equal & (key < other)
            equal &= key == other
        high = np.where(open_ & less, middle, high)
        low = np.where(open_ & ~less, middle + 1, low)
    return low


def rank_highest(rows: DataFrame, candidate: str, order: list[str], share: tuple[int, int]) -> DataFrame:
    """``rows`` with ``rank``: 1, 2, 3 .. by ``order`` for the first floor(share * N) of the N rows that are candidates, null elsewhere.

    ``candidate`` is a boolean column; ``order`` names long columns without
    nulls, all ascending. Rows that agree in all of them are ranked by their
    place in the stored runs, so equal rows are spread like any others and
    no segment outgrows its share. No candidates give null ranks only.
    """
    spark = rows.sparkSession
    # the id of a row within its sorted run: run number above, place in the run below
    placed = rows.sortWithinPartitions(F.desc(candidate), *order).withColumn("_place", F.monotonically_increasing_id())
    runs = materialise(placed, "runs")
    chosen = runs.where(candidate)
    n, n_runs = chosen.agg(F.count("*"), F.count_distinct(F.shiftright("_place", 33))).first()
    wanted = share[0] * n // share[1]
    if not wanted:
        return runs.drop("_place").withColumn("rank", F.lit(None).cast("long"))
    segments = min(4 * n_runs, n)
    stride = max(1, n // (max(n_runs, 1) * min(max(segments, 32), SAMPLES_OF_A_RUN)))
    keys = [*order, "_place"]
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    samples = chosen.where(inside % stride == 0).select(*keys).toArrow()
    samples = [samples[k].to_numpy() for k in keys]
    sorted_ = np.lexsort(samples[::-1])
    cut = np.unique(np.arange(1, segments) * len(sorted_) // segments)
    shared = spark.sparkContext.broadcast([s[sorted_][cut] for s in samples])

    def segment_of(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            yield pa.array(_behind([c.to_numpy(zero_copy_only=False) for c in columns], shared.value))

    def numbered(df: DataFrame) -> DataFrame:
        function = F.arrow_udf(segment_of, "long")
        return df.withColumn("_segment", function(*[F.col(k) for k in keys]))

    sizes = dict(tuple(r) for r in numbered(chosen).groupBy("_segment").count().collect())
    before, last = {}, 0
    for segment in sorted(sizes):
        before[segment], last = last, last + sizes[segment]
    reached = {s: b for s, b in before.items() if b < wanted}
    offsets = spark.createDataFrame(list(reached.items()), "_segment long, _before long")
    numbers = numbered(chosen)
    last_segment = max(reached)
    exchanged = numbers.where(F.col("_segment") <= last_segment).join(F.broadcast(offsets), "_segment")
    merged = exchanged.withColumn("rank", F.col("_before") + F.row_number().over(Window.partitionBy("_segment").orderBy(*keys)))
    merged = merged.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    behind = numbers.where(F.col("_segment") > last_segment).unionByName(runs.where(~F.col(candidate)).withColumn("_segment", F.lit(None).cast("long")))
    columns = [c for c in runs.columns if c != "_place"]
    return merged.select(*columns, "rank").unionByName(behind.select(*columns).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every row of ``docs`` with ``keep``, n_words, n_features, weight, score and rank (null for rows that are not drawn).

    ``floor(percent * N / 100)`` of the N rows with at least ``least_words``
    words are drawn by falling score, ties to the smaller doc_id (null last),
    then to the fewer features. Null and empty texts count no words, weigh 0
    and are never drawn. Repeated rows are drawn each for itself, with ranks
    of their own. Without target texts the gains only damp frequent buckets.
    No rows give no rows. ``keep`` may name the text, to write the drawn
    texts; kept columns with the name of a result column are replaced by it.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    own = ["n_words", "n_features", "weight", "score", "rank"]
    kept = [c for c in dict.fromkeys(("doc_id", *keep)) if c.lower() not in own]
    base = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.col("text").alias("t"))
    rows = weigh(base, gain, text="t").withColumn("score", gumbel_score("k0", seed=seed))
    rows = rows.withColumn("candidate", F.col("n_words") >= least_words).withColumn("down", -F.col("score"))
    rows = rows.withColumn("no_id", F.col("k0").isNull().cast("long")).withColumn("id", F.coalesce(F.col("k0").cast("long"), F.lit(0)))
    ranked = rank_highest(rows, "candidate", ["down", "no_id", "id", "n_features"], (percent, 100))
    return ranked.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], *own)
