"""Masked pseudo-likelihood of texts by a bidirectional window network.

Every word is predicted in two levels: its class (a hash bucket) from the
classes of the words on both sides, then the word itself within its class.
Each round, every task trains a copy of the class network on all of its own
words; Spark averages the copies by words seen. The words within a class have
their counts over the whole corpus, in a Spark table of all words. The most
frequent ones, a bounded number, are broadcast; texts are joined with the table
for the others. Rare and new words are spelled byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finloom.llm.words import WordChunk, mix, word_chunks
from finloom.session import materialise

#: Classes, the upper level of the softmax; the words below them are as many as the corpus has.
VOCABULARY = 256
SIZE = 8
SIDE = 2
OFFSETS = [j for j in range(-SIDE, SIDE + 1) if j]
_SHAPES = [(len(OFFSETS), VOCABULARY + 1, SIZE), (SIZE, VOCABULARY), (1, VOCABULARY)]
_CUTS = np.cumsum([int(np.prod(s)) for s in _SHAPES])
BATCH = 1024
#: Most words that are broadcast with their counts, 16 bytes each.
FREQUENT = 1 << 18


class Model:
    """The class ``network``, ``spelling`` (log-probability of a byte after a byte; a space begins and ends a word) and the tables of a corpus.

    ``words`` has (word, n_word) for every word; ``classes`` has (class, n_class, n_distinct). Both are None before anything is learnt.
    """

    def __init__(self, network: np.ndarray, spelling: np.ndarray, words: DataFrame | None = None, classes: DataFrame | None = None):
        self.network, self.spelling, self.words, self.classes = network, spelling, words, classes

    def __eq__(self, other) -> bool:
        same = np.array_equal(self.network, other.network) and np.array_equal(self.spelling, other.spelling)
        return same and self.words is other.words and self.classes is other.classes


def fresh(seed: int = 5) -> Model:
    flat = np.random.default_rng(seed).normal(0, 0.1, _CUTS[-1])
    flat[_CUTS[1] :] = 0
    return Model(flat, _spelling(np.zeros((256, 256))))


def _spelling(counts: np.ndarray) -> np.ndarray:
    return np.log((counts + 1) / (counts + 1).sum(1, keepdims=True))


def _steps(chunk: WordChunk) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``spelling``: of every byte after the one before it in its word, and of the end of every word."""
    before = np.full(len(chunk.data), 32, np.int64)
    before[1:] = chunk.data[:-1]
    before[chunk.starts] = 32
    return before * 256 + chunk.data, chunk.data[chunk.ends - 1].astype(np.int64) * 256 + 32


def _inside(chunk: WordChunk) -> np.ndarray:
    edges = np.zeros(len(chunk.data) + 1, np.int64)
    np.add.at(edges, chunk.starts, 1)
    np.add.at(edges, chunk.ends, -1)
    return np.cumsum(edges[:-1]) > 0


def _classes(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes) % np.uint64(VOCABULARY)).astype(np.int64)


def _columns(*arrays: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names)


def _count(texts: DataFrame) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """Counts of byte pairs, and the tables of words and classes of a corpus."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words of a class, and at the end, as class -1, places of byte pairs."""
        total = np.zeros(256 * 256, np.int64)
        for batch in batches:
            for chunk in word_chunks(batch.column(0)):
                word, n = np.unique(chunk.hashes, return_counts=True)
                yield _columns(word.view(np.int64), _classes(word), n, names=["word", "class", "n"])
                if len(chunk.starts):
                    step, end = _steps(chunk)
                    total += np.bincount(step[_inside(chunk)], minlength=len(total)) + np.bincount(end, minlength=len(total))
        place = np.flatnonzero(total)
        yield _columns(place, np.full(len(place), -1), total[place], names=["word", "class", "n"])

    both = texts.mapInArrow(words, "word long, class long, n long").groupBy("word", "class").agg(F.sum("n").alias("n_word"))
    both = materialise(both, "lm-words")
    counted = both.where("class >= 0")
    classes = materialise(counted.groupBy("class").agg(F.sum("n_word").alias("n_class"), F.count("*").alias("n_distinct")), "lm-classes")
    # at most one row per pair of bytes, whatever the corpus
    spelled = both.where("class < 0").toPandas()
    counts = np.zeros(256 * 256)
    counts[spelled["word"].to_numpy(int)] = spelled["n_word"].to_numpy(float)
    return counts.reshape(256, 256), counted.select("word", "n_word"), classes


def _parts(flat: np.ndarray) -> list[np.ndarray]:
    return [x.reshape(s) for x, s in zip(np.split(flat, _CUTS[:-1]), _SHAPES)]


def _tokens(chunk: WordChunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of a chunk's words, their contexts (VOCABULARY beyond the text), number of the text of each word."""
    tokens, owner = _classes(chunk.hashes), chunk.text_of_word()
    context = np.full((len(OFFSETS), len(tokens)), VOCABULARY)
    for row, j in enumerate(OFFSETS):
        at = np.arange(len(tokens)) + j
        inside = (at >= 0) & (at < len(tokens))
        inside[inside] = owner[at[inside]] == owner[inside]
        context[row, inside] = tokens[at[inside]]
    return tokens, context, owner


class _Layers:
    """Working copy of the network in single precision; the bias is the last row of ``out``, and the last hidden unit is 1."""

    def __init__(self, flat: np.ndarray):
        embedding, out, bias = _parts(flat.astype(np.float32))
        self.embedding, self.out = embedding, np.concatenate([out, bias])
        self.rows = embedding.reshape(-1, SIZE)  # the same numbers, one row for each offset and class
        self._hidden, self._logits = np.ones((BATCH, SIZE + 1), np.float32), np.empty((BATCH, VOCABULARY), np.float32)
        self._ones = np.ones(VOCABULARY, np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.embedding.ravel(), self.out.ravel()]).astype(float)

    def forward(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden units and logits of at most BATCH words, until the next call; the logits of a word may be moved by one amount so that none overflows."""
        hidden, logits = self._hidden[: context.shape[1]], self._logits[: context.shape[1]]
        total = self.embedding[0].take(context[0], 0)
        for j in range(1, len(OFFSETS)):
            total += self.embedding[j].take(context[j], 0)
        np.tanh(total, out=hidden[:, :SIZE])
        np.matmul(hidden, self.out, out=logits)
        if np.abs(self.out).sum(0).max() > 60:  # no logit is larger, since no hidden unit is larger than 1
            logits -= logits.max(1, keepdims=True)
        return hidden, logits

    def exp(self, logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The exponentials, in place of the logits, and their sums."""
        np.exp(logits, out=logits)
        return logits, logits @ self._ones

    def log_p(self, context: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Log-probability of the class of every word between its neighbours."""
        out = np.empty(len(tokens))
        for a in range(0, len(tokens), BATCH):
            t = tokens[a : a + BATCH]
            logits = self.forward(context[:, a : a + BATCH])[1]
            own = logits[np.arange(len(t)), t].astype(float)
            out[a : a + BATCH] = own - np.log(self.exp(logits)[1].astype(float))
        return out


def train_local(flat: np.ndarray, texts: pa.Array, rate: float) -> tuple[np.ndarray, int]:
    layers, seen = _Layers(flat), 0
    step, first = np.float32(rate / BATCH), np.arange(len(OFFSETS))[:, None] * (VOCABULARY + 1)
    back_to = np.ones((VOCABULARY, SIZE + 1), np.float32)  # the last column adds up the exponentials
    for tokens, context, _ in map(_tokens, word_chunks(texts)):
        for a in range(0, len(tokens), BATCH):
            t, c = tokens[a : a + BATCH], context[:, a : a + BATCH]
            hidden, logits = layers.forward(c)
            # the error of a word's class is step * (exponential / total), less step for its own class
            error = np.exp(logits, out=logits)
            back_to[:, :SIZE] = layers.out[:SIZE].T
            back = error @ back_to
            total = back[:, SIZE].copy()
            scale = (step / total)[:, None]
            back = (back[:, :SIZE] - total[:, None] * back_to[:, :SIZE].take(t, 0)) * (scale * (1 - hidden[:, :SIZE] ** 2))
            error[np.arange(len(t)), t] -= total
            layers.out -= (error.T @ (hidden * scale)).T
            cells, units = (c + first).ravel(), np.tile(back.T.astype(float), len(OFFSETS))
            layers.rows -= np.stack([np.bincount(cells, unit, len(layers.rows)) for unit in units], 1)
            seen += len(t)
    return layers.flat(), seen


def train(docs: DataFrame, text: str = "text", rounds: int = 2, rate: float = 2.0) -> Model:
    """The model after ``rounds`` passes over every word; without words the starting one."""
    model = fresh()
    flat = model.network
    texts = docs.select(F.col(f"`{text}`"))
    for _ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(flat)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, words = shared.value, 0
            for batch in batches:
                own, seen = train_local(own, batch.column(0), rate)
                words += seen
            if words:
                cols = [pa.array(np.arange(len(own))), pa.array(own * words), pa.array(np.full(len(own), words))]
                yield pa.RecordBatch.from_arrays(cols, ["place", "x", "n"])

        # fixed size: one row per parameter, whatever the corpus
        mean = texts.mapInArrow(run, "place long, x double, n long").groupBy("place").agg((F.sum("x") / F.sum("n")).alias("x")).toPandas()
        flat = flat.copy()
        flat[mean["place"].to_numpy(int)] = mean["x"].to_numpy(float)
    counts, words, classes = _count(texts)
    return Model(flat, _spelling(counts), words, classes) if counts.any() else model


def _frequent(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and counts of the words above the least bound that leaves at most FREQUENT of them."""
    level = F.expr("int(8 * log2(n_word))")
    sizes = words.groupBy(level.alias("level")).count().toPandas().sort_values("level", ascending=False)  # at most 8 * 63 rows
    levels = sizes["level"][sizes["count"].cumsum() <= FREQUENT]
    if not len(levels):
        return np.zeros(0, np.int64), np.zeros(0)
    chosen = words.where(level >= int(levels.min())).toPandas().sort_values("word")
    return chosen["word"].to_numpy(np.int64), chosen["n_word"].to_numpy(float)


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``n_words``, ``log_likelihood`` (sum over words) and ``per_word``; null and empty texts have 0, 0 and null.

    A word's log-probability is that of its class between its neighbours plus
    log((n_word + n_distinct * spelled) / (n_class + n_distinct)). Equal texts
    have equal scores. Columns of these names are replaced.
    """
    known, times = np.zeros(0, np.int64), np.zeros(0)
    ahead, below = np.zeros(VOCABULARY), np.zeros(VOCABULARY)  # per class: log of its different words; log of all of its counts
    if model.words is not None:
        known, times = _frequent(model.words)
        table = model.classes.toPandas()  # one row per class
        of, distinct = table["class"].to_numpy(int), table["n_distinct"].to_numpy(float)
        ahead[of], below[of] = np.log(distinct), np.log(table["n_class"].to_numpy(float) + distinct)
    shared = df.sparkSession.sparkContext.broadcast((model.network, model.spelling, known, times, ahead, below))
    keyed = df.drop("n_words", "log_likelihood", "per_word").withColumn("_key", F.xxhash64(f"`{text}`"))
    texts = keyed.select("_key", F.col(f"`{text}`").alias("_text")).dropDuplicates(["_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per text with all that is known here, and one per text and different word that is not among the frequent ones."""
        network, spelling, known, times, ahead, below = shared.value
        layers, spelling = _Layers(network), spelling.ravel()
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for chunk in word_chunks(batch.column(1)):
                if not len(chunk.hashes):
                    continue
                tokens, context, owner = _tokens(chunk)
                step, end = _steps(chunk)
                spelled = np.add.reduceat(spelling[np.append(step, 0)], np.stack([chunk.starts, chunk.ends], 1).ravel())[::2] + spelling[end]
                prior = ahead[tokens] + spelled
                sure, words = layers.log_p(context, tokens) - below[tokens], chunk.hashes.view(np.int64)
                if len(known):
                    place = np.minimum(np.searchsorted(known, words), len(known) - 1)
                    found = known[place] == words
                    sure[found] += np.log(times[place[found]] + np.exp(prior[found]))
                else:
                    found = np.zeros(len(words), bool)
                full = np.flatnonzero(np.diff(chunk.bounds))
                of_text, n_known = np.bincount(owner, sure, len(chunk))[full], np.bincount(owner[found], minlength=len(chunk))[full]
                text_keys = keys[chunk.first + full]
                rest = np.flatnonzero(~found)
                order = rest[np.lexsort((words[rest], owner[rest]))]
                new = np.ones(len(order), bool)
                new[1:] = (owner[order][1:] != owner[order][:-1]) | (words[order][1:] != words[order][:-1])
                first, n = order[new], np.diff(np.append(np.flatnonzero(new), len(order)))
                yield _columns(text_keys, text_keys, n_known.astype(np.int32), of_text, np.ones(len(full), bool), names=["_key", "word", "n", "x", "whole"])
                yield _columns(keys[chunk.first + owner[first]], words[first], n.astype(np.int32), prior[first], np.zeros(len(first), bool),
                               names=["_key", "word", "n", "x", "whole"])

    rows = texts.mapInArrow(run, "_key long, word long, n int, x double, whole boolean")
    if model.words is None:
        rows = rows.withColumn("n_word", F.lit(None).cast("long"))
    else:
        rows = rows.join(model.words, "word", "left")
    share = F.expr("CASE WHEN whole THEN x WHEN n_word IS NULL THEN n * x ELSE n * ln(n_word + exp(x)) END")
    sums = rows.groupBy("_key").agg(F.sum("n").alias("n_words"), F.sum(share).alias("log_likelihood"))
    out = keyed.join(sums, "_key", "left").drop("_key")
    out = out.withColumns({"n_words": F.coalesce("n_words", F.lit(0).cast("long")), "log_likelihood": F.coalesce("log_likelihood", F.lit(0.0))})
    return out.withColumn("per_word", F.expr("IF(n_words > 0, log_likelihood / n_words, NULL)"))
