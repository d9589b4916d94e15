"""Documents that contain benchmark items, found in a latent space of word passages.

Inverse passage frequencies come from all passages of the documents; a range
finder on their TF-IDF matrix (its products are sums over partitions) gives the
space. An inverted index of the items' words finds every stretch with enough
words of an item; stretches that lie close together, or whose passages of about
the item's length are near it in the latent space, are checked by longest common
subsequence and answer.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finloom.llm.words import mix, word_chunks

DIMENSIONS = 4096
RANK = 48
WINDOW = 64
#: Words that windows of the search begin and end at, counted from the start of a text.
UNIT = 4
#: Postings that are added up at once.
POSTINGS_AT_ONCE = 1 << 22
#: Items that one pass over the documents compares; more items take more passes.
ITEMS_AT_ONCE = 20000


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes) % np.uint64(DIMENSIONS)).astype(np.int64)


def _different(x: np.ndarray) -> np.ndarray:
    """The different values of a fresh array, which is put in order."""
    x.sort()
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def _grid(bounds: np.ndarray, size: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, text) of windows of ``size`` every ``step`` places of each text, up to its end; a shorter text is one window."""
    n = np.diff(bounds)
    counts = np.where(n > 0, np.maximum(-(-(n - size) // step), 0) + 1, 0)
    text = np.repeat(np.arange(len(n)), counts)
    begin = bounds[text] + (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)) * step
    return begin, np.minimum(begin + size, bounds[text + 1]), text


def _passages(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes) of every text's words; texts without words give none."""
    for chunk in word_chunks(texts):
        for i in range(len(chunk)):
            hashes = chunk.hashes[chunk.bounds[i] : chunk.bounds[i + 1]]
            if len(hashes):
                yield chunk.first + i, hashes


def _sum_rows(df: DataFrame, per_partition) -> np.ndarray:
    """Column sums of one fixed-size matrix per task, added by Spark; its size does not depend on the data."""

    def run(batches):
        total = per_partition(pa.chunked_array([b.column(0)]) if b.num_rows else None for b in batches)
        flat = total.reshape(len(total), -1)
        lists = pa.ListArray.from_arrays(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32), flat.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), lists], ["row", "v"])

    parts = df.mapInArrow(run, "row long, v array<double>")
    width = parts.select("row", F.posexplode("v").alias("col", "x")).groupBy("row", "col").agg(F.sum("x").alias("x"))
    got = width.toPandas()
    out = np.zeros((DIMENSIONS, int(got["col"].max()) + 1 if len(got) else 1))
    out[got["row"], got["col"]] = got["x"]
    return out


def _cut(columns) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Per chunk of texts: the words' buckets, the number of each word's passage (cut without overlap), the number of passages."""
    for c in columns:
        for chunk in word_chunks(c) if c is not None else ():
            begin, end, _ = _grid(chunk.bounds, WINDOW, WINDOW)
            if len(begin):
                yield _buckets(chunk.hashes), np.repeat(np.arange(len(begin)), end - begin), len(begin)


def latent_space(docs: DataFrame, text: str = "text", seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(idf, basis): the inverse passage frequencies and an orthonormal basis near the leading right singular vectors of all passages."""
    texts = docs.select(F.col(f"`{text}`"))

    def frequencies(columns):
        total = np.zeros((DIMENSIONS, 2))
        for buckets, passage, n in _cut(columns):
            total[:, 0] += np.bincount(_different(passage * DIMENSIONS + buckets) % DIMENSIONS, minlength=DIMENSIONS)
            total[0, 1] += n
        return total

    counted = _sum_rows(texts, frequencies)
    idf = np.log((counted[0, -1] + 1) / (counted[:, 0] + 1)) + 1
    start = np.random.default_rng(seed).normal(size=(DIMENSIONS, RANK))

    def products(columns):  # A^T (A start) over this partition's passages
        total, right = np.zeros((DIMENSIONS, RANK)), (start * idf[:, None]).astype(np.float32)
        for buckets, passage, n in _cut(columns):
            for a in range(0, n, 1024):
                some = slice(*np.searchsorted(passage, [a, a + 1024]))
                bucket, row = buckets[some], passage[some] - a
                images = np.add.reduceat(right.take(bucket, 0), np.searchsorted(row, np.arange(min(1024, n - a))))  # counts @ right
                order = np.argsort(bucket.astype(np.uint16), kind="stable")
                used, first = np.unique(bucket[order], return_index=True)
                total[used] += np.add.reduceat(images.take(row[order], 0), first)  # counts.T @ images
        return total * idf[:, None]

    return idf, np.linalg.qr(_sum_rows(texts, products))[0]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit rows."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for places in filter(None, map(where.get, b.tolist())):
        hit = row & places
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", cosine: float = 0.35, share: float = 0.6, sure: float = 0.8,
          answer_words: int = 4) -> DataFrame:
    """``docs`` with ``leaked_items``: sorted ids of the items that the whole text contains.

    An item is compared with every stretch of twice its words, and with the
    surroundings (its longest peer on both sides) of every passage of about its
    length whose latent vector has a cosine of at least ``cosine`` with its own.
    Stretches that hold too few of its words to contain it are left out by an
    index of all words of the items; nothing else is.
    An item is contained when the longest common subsequence
    has ``sure`` of its words, or ``share`` of them and its last
    ``answer_words`` words in a row. Null and empty texts or items match
    nothing; items of under 8 words must be contained wholly. A column of that
    name is replaced; no rows give no rows.
    """
    out = docs.withColumn("leaked_items", F.expr("CAST(array() AS array<bigint>)"))
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct()
    parts = max(1, -(-items.count() // ITEMS_AT_ONCE))
    idf, basis = latent_space(docs, text)
    for part in range(parts):
        chosen = items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).toPandas()  # at most about ITEMS_AT_ONCE rows
        out = _check(out, chosen["item_id"].tolist(), chosen["text"].tolist(), idf, basis, text, cosine, share, sure, answer_words)
    return out


class _Peers:
    """Items of about the same length: ``numbers``, the longest length, latent ``vectors``, words needed, and postings by word of the vocabulary."""

    def __init__(self, numbers: np.ndarray, words: list[np.ndarray], vectors: np.ndarray, needed: np.ndarray, vocabulary: np.ndarray):
        self.numbers, self.vectors, self.needed = numbers, vectors[numbers], needed[numbers]
        self.longest = max(len(words[i]) for i in numbers)
        item = np.repeat(np.arange(len(numbers)), [len(words[i]) for i in numbers])
        word = np.searchsorted(vocabulary, np.concatenate([words[i] for i in numbers]))
        code, self.times = np.unique(word * len(numbers) + item, return_counts=True)  # by word, then by item
        self.items = code % len(numbers)
        self.bounds = np.searchsorted(code // len(numbers), np.arange(len(vocabulary) + 1))

    def enough(self, bounds: np.ndarray, at: np.ndarray, text: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, item) of the blocks that have the words needed; blocks overlap by half, so every half block of a text is in one.

        ``at``, ``text`` and ``word`` are the places of words of the vocabulary.
        """
        step, width = 4 * (self.longest + UNIT), len(self.bounds) - 1
        mine = self.bounds[word + 1] > self.bounds[word]  # words of these items
        at, text, word = at[mine], text[mine], word[mine]
        begin, end, of_text = _grid(bounds, 2 * step, step)
        if not len(begin):
            return begin, end, begin
        first, last = np.searchsorted(of_text, np.arange(len(bounds) - 1)), np.searchsorted(of_text, np.arange(len(bounds) - 1), "right") - 1
        newest = first[text] + (at - bounds[text]) // step
        here, before = newest <= last[text], newest > first[text]
        block = np.concatenate([newest[here], newest[before] - 1])
        block, word = np.divmod(_different(block * width + np.concatenate([word[here], word[before]])), width)
        size, n = np.diff(self.bounds)[word], len(self.numbers)
        covered, done = np.zeros(len(begin) * n), np.cumsum(size)
        for a in range(0, int(done[-1]) if len(done) else 0, POSTINGS_AT_ONCE):
            some = slice(*np.searchsorted(done, [a, a + POSTINGS_AT_ONCE], "right"))
            k = size[some]
            entry = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(self.bounds[word[some]], k)
            covered += np.bincount(np.repeat(block[some] * n, k) + self.items[entry], self.times[entry], len(covered))
        chosen, item = np.nonzero(covered.reshape(-1, n) >= self.needed)
        return begin[chosen], end[chosen], item


def _close(item: np.ndarray, needed: int, hashes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of twice the item's words that begin with one of them and hold as many as needed."""
    at = np.flatnonzero(np.isin(hashes, item))
    inside = np.searchsorted(at, at + 2 * len(item)) - np.arange(len(at))
    for begin in at[inside >= needed]:
        yield begin, begin + 2 * len(item)


def _check(out, ids, item_texts, idf, basis, text, cosine, share, sure, answer_words):
    words = dict(_passages(pa.array(item_texts, pa.large_string())))
    ids, words = [ids[i] for i in words], list(words.values())
    if not ids:
        return out
    weighted = (basis * idf[:, None]).astype(np.float32)
    vectors = np.array([weighted[_buckets(w)].sum(0) for w in words])
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    lengths, vocabulary = np.array([len(w) for w in words]), np.unique(np.concatenate(words))
    needed = np.where(lengths < 8, lengths, np.ceil(min(share, sure) * lengths - 1e-9))
    of_class = np.floor(np.log(lengths) / np.log(1.5) + 1e-9)
    peers = [_Peers(np.flatnonzero(of_class == c), words, vectors, needed, vocabulary) for c in np.unique(of_class)]
    shared = out.sparkSession.sparkContext.broadcast((ids, words, vocabulary, peers, weighted))

    def contained(item: np.ndarray, window: np.ndarray) -> bool:
        common = _common(item, window)
        if len(item) < 8:
            return common == len(item)
        if common >= sure * len(item):
            return True
        answer = item[-answer_words:]
        return common >= share * len(item) and any(np.array_equal(window[i : i + len(answer)], answer) for i in np.flatnonzero(window == answer[0]))

    def near(hashes: np.ndarray, vector: np.ndarray, longest: int, weighted: np.ndarray) -> Iterator[tuple[int, int]]:
        """Surroundings of the passages of about ``longest`` words, a quarter apart, that the latent space puts near the item."""
        begin, end, _ = _grid(np.array([0, len(hashes)]), max(longest, UNIT), max(longest // 4, 1))
        sums = np.concatenate([np.zeros((1, weighted.shape[1])), np.cumsum(weighted[_buckets(hashes)], axis=0, dtype=float)])
        latent = sums[end] - sums[begin]
        for i in np.flatnonzero(latent @ vector >= cosine * np.maximum(np.linalg.norm(latent, axis=1), 1e-12)):
            yield max(begin[i] - longest, 0), end[i] + longest

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids, words, vocabulary, peers, weighted = shared.value
        for texts in batches:
            found: list[set[int]] = [set() for _ in range(len(texts))]
            for chunk in word_chunks(pa.array(texts, pa.large_string())):
                place = np.minimum(np.searchsorted(vocabulary, chunk.hashes), len(vocabulary) - 1)
                at = np.flatnonzero(vocabulary[place] == chunk.hashes)
                text_of = chunk.text_of_word()[at]
                for group in peers:
                    for begin, end, i in zip(*group.enough(chunk.bounds, at, text_of, place[at])):
                        row = chunk.first + int(np.searchsorted(chunk.bounds, begin, "right")) - 1
                        number = group.numbers[i]
                        if ids[number] in found[row]:
                            continue
                        item, block = words[number], chunk.hashes[begin:end]
                        tried = itertools.chain(_close(item, int(group.needed[i]), block), near(block, group.vectors[i], group.longest, weighted))
                        if any(contained(item, block[a:b]) for a, b in tried):
                            found[row].add(ids[number])
            yield pd.Series([sorted(x) for x in found])

    added = F.pandas_udf(run, "array<bigint>")(F.col(f"`{text}`"))
    return out.withColumn("leaked_items", F.array_sort(F.array_union("leaked_items", added)))
