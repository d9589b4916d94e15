"""Exact Jaccard self-join of word shingle sets by universe partitioning.

Sets meet only within a band of sizes. A band's shingles are hashed into
segments; two sets that differ in at most H shingles agree in an exact segment
or differ by at most one in a segment with deletions, whenever
exact + 2 * deletion segments > H. The excess over H is the slack: a set whose
light segments (empty; with deletions, at most one shingle) weigh less than the
slack has a meeting place beside them and gives no key to nothing. Segments,
deletions and slack of a band follow from a cost estimate. Pairs that share a
key, and one of the rarest shingles of either where the key does not join its
members to one component, are verified by their whole sets.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finloom.llm.components import components
from finloom.llm.words import mix, word_chunks
from finloom.session import materialise

#: Cost of a set that has to give its keys to empty segments, which very many sets may share, against one key.
EMPTY_WEIGHT = 3e5
#: Cost of a key made of a single shingle, which a common passage may carry into many sets.
SINGLE_WEIGHT = 8
#: 64-bit words of a set's marks, the fewest of them where they grow with the set.
MARKS = 8


#: Members of a key, beside the first, that are compared with each other by their marks; those of larger keys meet by rare shingles.
SMALL_KEY = 1024
#: Pairs of members that are compared at once.
PAIRS_AT_ONCE = 1 << 17


def _tail(mean: float, least: int) -> float:
    """Chance that a Poisson count reaches ``least``."""
    term, below = math.exp(-mean), 0.0
    for k in range(least):
        below += term
        term *= mean / (k + 1)
    return max(0.0, 1 - below)


class Bands:
    """Size bands: band i's partners of at least equal size lie in bands i and i + 1."""

    def __init__(self, percent: int):
        self.percent, self.low = percent, [1]
        self._plans: dict[int, tuple[int, int, int]] = {}

    def of(self, size: int) -> int:
        while self.low[-1] <= size:
            self.low.append(self.low[-1] * 100 // self.percent + 1)
        return int(np.searchsorted(self.low, size, "right")) - 1

    def plan(self, band: int) -> tuple[int, int, int]:
        """Exact segments, deletion segments and slack of least cost."""
        if band not in self._plans:
            while len(self.low) < band + 2:
                self.low.append(self.low[-1] * 100 // self.percent + 1)
            low, high = self.low[band], self.low[band + 1] - 1
            differ = (high + high * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)
            half = differ // 2 + 1
            options = []
            for deletion in sorted({0, 1, 2, *(half * j // 8 for j in range(1, 9)), half + 1}):
                for slack in sorted({1, 2, 3, 4, 6, 8, *(8 + differ * j // 16 for j in range(17))}):
                    exact = differ + slack - 2 * deletion
                    if exact < 0 or exact + deletion == 0:
                        continue
                    mean = low / (exact + deletion)
                    none = math.exp(-mean)
                    keys = exact + deletion * (1 + mean)
                    single = none * (exact * mean + deletion * (mean + mean * mean))
                    light = none * (exact + deletion * (1 + mean))
                    risk = _tail(light, -(-slack // 2) if deletion else slack)
                    options.append((keys + SINGLE_WEIGHT * single + EMPTY_WEIGHT * risk, exact, deletion, slack))
            self._plans[band] = min(options)[1:]
        return self._plans[band]


def _keys(tokens: np.ndarray, band: int, bands: Bands) -> np.ndarray:
    exact, deletion, slack = bands.plan(band)
    n = exact + deletion
    salted = mix(tokens + np.uint64(band + 1) * np.uint64(0x9E3779B97F4A7C15))
    segment = (salted % np.uint64(n)).astype(np.int64)
    value = mix(salted ^ np.uint64(0xD6E8FEB86659FD93))
    total = np.zeros(n, np.uint64)
    np.add.at(total, segment, value)
    filled = np.bincount(segment, minlength=n)
    place = mix(np.arange(n, dtype=np.uint64) + np.uint64((band + 1) << 32))
    whole = mix(total + place)
    near = segment >= exact
    less = mix(total[segment[near]] - value[near] + place[segment[near]])
    light = np.count_nonzero(filled[:exact] == 0) + 2 * np.count_nonzero(filled[exact:] <= 1)
    if light < slack:  # something else meets
        whole, less = whole[filled > 0], less[filled[segment[near]] > 1]
    return np.unique(np.concatenate([whole, less]))


def _marks(tokens: np.ndarray, words: int = MARKS) -> np.ndarray:
    """For each of 64 * ``words`` cells, whether an odd number of the tokens falls there: two sets differ in at least as many tokens as their marks do in bits."""
    cells = np.bincount((mix(tokens) % np.uint64(64 * words)).astype(np.int64), minlength=64 * words)
    return np.packbits((cells & 1).astype(bool)).view(np.int64)


def _long_marks(tokens: np.ndarray) -> np.ndarray:
    """Marks with at least a cell for every token; folded in halves, they are those of fewer cells."""
    return _marks(tokens, MARKS << max(0, (len(tokens) - 1).bit_length() - (64 * MARKS - 1).bit_length()))


def shingle_sets(df: DataFrame, k: int, percent: int, what: str) -> DataFrame:
    """``what`` = "class": id, n, c1, c2, long marks; "keys": id, key; "sets": id, n, marks, tokens. Columns of ``df``: id, text."""
    schema = {"class": "id long, n long, c1 long, c2 long, marks array<long>", "keys": "id long, key long",
              "sets": "id long, n long, marks array<long>, tokens array<long>"}[what]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for chunk in word_chunks(texts):
                with np.errstate(over="ignore"):
                    values, bounds = chunk.shingles(k)
                    size, c1, c2, parts, counts, marks = [], [], [], [], [], []
                    for a, b in zip(bounds[:-1], bounds[1:]):
                        tokens = np.unique(values[a:b])
                        size.append(len(tokens))
                        c1.append(mix(tokens + np.uint64(17)).sum(dtype=np.uint64))
                        c2.append(mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
                        if what == "keys":
                            band = bands.of(len(tokens)) if len(tokens) else -1
                            found = [_keys(tokens, x, bands) for x in (band - 1, band) if x >= 0]
                            parts.append(np.concatenate(found) if found else np.zeros(0, np.uint64))
                        elif what == "sets":
                            parts.append(tokens)
                            marks.append(_marks(tokens))
                        else:
                            parts.append(_long_marks(tokens))
                        counts.append(len(parts[-1]))
                n = np.array(size, np.int64)
                c1, c2 = np.array(c1, np.uint64).view(np.int64), np.array(c2, np.uint64).view(np.int64)
                part_ids = ids.slice(chunk.first, len(chunk))
                flat = np.concatenate(parts).view(np.int64)
                if what == "keys":
                    yield pa.RecordBatch.from_arrays([part_ids.take(pa.array(np.repeat(np.arange(len(chunk)), counts))), pa.array(flat)], ["id", "key"])
                    continue
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat))
                if what == "class":
                    yield pa.RecordBatch.from_arrays([part_ids, pa.array(n), pa.array(c1), pa.array(c2), lists], ["id", "n", "c1", "c2", "marks"])
                else:
                    cells = pa.ListArray.from_arrays(pa.array(np.arange(len(chunk) + 1) * MARKS, pa.int32()), pa.array(np.concatenate(marks)))
                    yield pa.RecordBatch.from_arrays([part_ids, pa.array(n), cells, lists], ["id", "n", "marks", "tokens"])

    return df.select("id", "text").mapInArrow(compute, schema)


def _fitting(key: np.ndarray, label: np.ndarray, n: np.ndarray, bounds: np.ndarray, marks: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of one key that have different labels and whose sizes and marks, folded to as many, let them link; rows lie by key."""
    words, heads = np.diff(bounds), np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(heads, len(key)))
    fewest, ends = np.repeat(np.minimum.reduceat(words, heads), size), np.repeat(heads + size, size)
    for width in np.unique(fewest).tolist():
        rows = np.flatnonzero(fewest == width)  # whole keys, so partners lie side by side
        cells = np.empty((len(rows), width), np.uint64)
        for long in np.unique(words[rows]).tolist():
            some = np.flatnonzero(words[rows] == long)
            whole = marks[bounds[rows[some]][:, None] + np.arange(long)]
            cells[some] = np.bitwise_xor.reduce(whole.reshape(len(some), long // width, width), 1)
        partners = ends[rows] - rows - 1
        done = np.cumsum(partners)
        first = 0
        while first < len(rows):
            last = max(first + 1, int(np.searchsorted(done, done[first] + PAIRS_AT_ONCE, "right")))
            k = partners[first:last]
            a = np.repeat(np.arange(first, last), k)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)
            i, j = rows[a], rows[b]
            reach = (n[i] + n[j]) * (100 - percent)
            on = (label[i] != label[j]) & (np.abs(n[i] - n[j]) * (100 + percent) <= reach)
            a, b, i, j, reach = a[on], b[on], i[on], j[on], reach[on]
            on = np.bitwise_count(cells[a] ^ cells[b]).sum(1, dtype=np.int64) * (100 + percent) <= reach
            yield i[on], j[on]
            first = last


def close_members(members: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs of ``_fitting`` within each key. Columns of ``members``: key, id, label, n, marks."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in itertools.chain(batches, [None]):
            rows = [x for x in (left, batch) if x is not None and x.num_rows]
            if not rows:
                continue
            table = pa.Table.from_batches(rows).combine_chunks()
            key = table["key"].to_numpy()
            cut = len(key) if batch is None else int(np.flatnonzero(key == key[-1])[0])  # the last key may go on
            left = None if batch is None else table.slice(cut).combine_chunks().to_batches()[0]
            if not cut:
                continue
            table = table.slice(0, cut).combine_chunks()
            ids, label, n = (table[c].to_numpy() for c in ("id", "label", "n"))
            lists = table["marks"].chunk(0)
            bounds, marks = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy().view(np.uint64)
            for i, j in _fitting(key[:cut], label, n, bounds, marks, percent):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j]))], ["a", "b"])

    placed = members.select("key", "id", "label", "n", "marks").repartition("key").sortWithinPartitions("key")
    return placed.mapInArrow(compute, "a long, b long").where("a <> b").distinct()


def rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """id, n, shingle, place: of each set's rarest shingles those that another of the ``sets`` has, too.

    Sets that link share at least ``percent`` of either's shingles. So each has
    one of the common ones among its rarest 100 - percent of a hundred and one
    more, in the order of the number of sets that hold a shingle, then of the
    shingle. A shingle of one set only takes its place but is not returned.
    """
    each = sets.select("id", F.explode("tokens").alias("shingle"))
    held = materialise(each.groupBy("shingle").agg(F.count("*").alias("held")).where("held > 1"), "held")
    known = each.join(held, "shingle").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("held", "shingle"))).alias("known"))
    known = known.join(sets.select("id", "n"), "id").withColumn("alone", F.expr("n - size(known)"))
    least = F.expr(f"int(greatest(0, n * (100 - {percent}) div 100 + 1 - alone))")
    placed = known.select("id", "n", "alone", F.posexplode(F.slice("known", F.lit(1), least)["shingle"]).alias("at", "shingle"))
    return placed.select("id", "n", "shingle", (F.col("alone") + F.col("at") + 1).alias("place"))


def jaccard_classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id: components of rows whose shingle sets have 100 * intersection >= percent * union.

    Equal sets are one class and meet the others through one row. Rows without
    words are linked with nothing and are their own component; rows without an
    id are left out; repeated ids stay rows of one component. No rows give no rows.
    """
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).where("id IS NOT NULL")
    rows = materialise(shingle_sets(docs, k, percent, "class"), "sets")
    classes = materialise(rows.where("n > 0").groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.min("n").alias("n")), "classes")
    reps = docs.join(classes.select(F.col("rep").alias("id")), "id", "left_semi")

    # a window, not a join of the keys with themselves: that would compute and shuffle all of them twice
    of_key = Window.partitionBy("key")
    keys = shingle_sets(reps, k, percent, "keys").withColumns({"first": F.min("id").over(of_key), "held": F.count("*").over(of_key)})
    shared = materialise(keys.where("id <> first").select("key", "id", "first", (F.col("held") > 2).alias("more")), "keys")
    star = materialise(shared.select(F.col("first").alias("a"), F.col("id").alias("b")).distinct(), "pairs")

    def near(pairs: DataFrame) -> DataFrame:
        """Those whose sizes and marks, folded to as many, let them link."""
        sizes = rows.where("n > 0").select("id", "n", "marks")
        met = pairs.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("marks").alias("ma")), "a")
        met = met.join(sizes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("marks").alias("mb")), "b")
        fold = "aggregate(sequence(i, size({0}) - 1, least(size(ma), size(mb))), 0L, (x, j) -> x ^ {0}[j])"
        bits = f"aggregate(sequence(0, least(size(ma), size(mb)) - 1), 0, (x, i) -> x + bit_count({fold.format('ma')} ^ {fold.format('mb')}))"
        met = met.where(f"least(na, nb) * 100 >= {percent} * greatest(na, nb)")
        return met.where(f"{bits} * (100 + {percent}) <= (na + nb) * (100 - {percent})").select("a", "b").distinct()

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    def sets_of(ids: DataFrame) -> DataFrame:
        return materialise(shingle_sets(reps.join(ids, "id", "left_semi"), k, percent, "sets").where("n > 0"), "tokens")

    def verified(pairs: DataFrame, sets: DataFrame, label: str) -> DataFrame:
        a = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
        b = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
        met = pairs.join(a, "a").join(b, "b").withColumn("both", F.size(F.array_intersect("ta", "tb")))
        return materialise(met.where(f"100L * both >= {percent}L * (na + nb - both)").select("a", "b").distinct(), label)

    # most pairs share one key by chance; their whole sets are not looked at
    star = materialise(near(star), "star")
    linked = verified(star, sets_of(ends(star)), "star")
    # members of a key that the links so far already join need no look at each other, nor has the only one beside the first
    labels = materialise(components(linked), "labels")
    members = shared.where("more").join(labels, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    hubs = labels.select(F.col("id").alias("first"), F.col("component").alias("hub"))
    members = members.join(hubs, "first", "left").withColumn("odd", F.col("label") != F.coalesce("hub", "first"))
    members = materialise(members.select("key", "id", "label", "odd"), "members")
    open_keys = members.groupBy("key").agg((F.min("label") < F.max("label")).alias("open"), F.count("*").alias("held"))
    members = materialise(members.join(open_keys.where("open").select("key", "held"), "key"), "members")
    small = members.where(f"held <= {SMALL_KEY}").join(rows.where("n > 0").select("id", "n", "marks"), "id")
    close = materialise(close_members(small, percent), "close")
    # members of a large key may share no more than a passage of very many texts; two that link share a rare shingle, too
    members = members.where(f"held > {SMALL_KEY}")
    # stored, so that Spark knows how few they are and leaves the sets where they lie
    flags = materialise(members.groupBy("id").agg(F.max("odd").alias("odd"), F.first("label").alias("label")), "flags")
    asked = sets_of(flags.select("id"))
    members = materialise(rare_shingles(asked, percent).join(flags, "id").join(asked.select("id", "marks"), "id"), "members")
    a, b = (members.select("shingle", *[F.col(c).alias(c + side) for c in ("id", "n", "place", "odd", "label", "marks")]) for side in "ab")
    # left of the first common shingle is what one set has and the other lacks; right of it they differ by their sizes, and anywhere by their marks
    bits = " + ".join(f"bit_count(marksa[{i}] ^ marksb[{i}])" for i in range(MARKS))
    apart = f"greatest(placea + placeb - 2 + abs((na - placea) - (nb - placeb)), {bits})"
    fits = f"{apart} * (100 + {percent}) <= (na + nb) * (100 - {percent})"
    rest = a.where("odda").join(b, "shingle").where(f"labela <> labelb AND (NOT oddb OR ida < idb) AND {fits}")
    rest = rest.select(F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b")).distinct()
    rest = materialise(rest.unionByName(close).distinct(), "rest")
    found = labels if rest.isEmpty() else components(linked.unionByName(verified(rest, sets_of(ends(rest)), "rest")))
    of_class = classes.join(found, F.col("rep") == F.col("id"), "left").select("c1", "c2", F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(of_class, ["c1", "c2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))
