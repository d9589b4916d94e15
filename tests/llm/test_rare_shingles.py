"""Candidates of the similarity join that share no more than a passage, and its components against brute force."""

import random

import numpy as np
import pytest

from finloom.llm import jaccard


def brute(rows, k, percent):
    sets = {i: {tuple(t.split()[j : j + k]) for j in range(len(t.split()) - k + 1)} for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return {i: top(i) for i in sets}


def classes(spark, rows, k, percent):
    found = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), k=k, percent=percent)
    return {r.doc_id: r.component_id for r in found.collect()}


def test_texts_with_a_common_passage_form_few_pairs(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(d, passage + " " + " ".join(f"d{d}x{i}" for i in range(10))) for d in range(60)]
    made, store = [], jaccard.materialise

    def counted(df, label):
        stored = store(df, label)
        made.extend([stored.count()] if label == "rest" else [])
        return stored

    monkeypatch.setattr(jaccard, "materialise", counted)
    assert classes(spark, rows, 3, 90) == {d: d for d, _ in rows}
    assert sum(made) <= 60


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_components_of_many_near_copies(spark, k, percent):
    rnd = random.Random(percent)
    rows = []
    for d in range(150):
        words = [f"w{d % 3}_{i}" for i in range(60 + d % 5)]
        for _ in range(rnd.randint(0, 4)):  # few other words, so that copies share changes
            words[rnd.randrange(len(words))] = f"v{rnd.randint(0, 3)}"
        rows.append((d, " ".join(words)))
    assert classes(spark, rows, k, percent) == brute(rows, k, percent)


def test_near_copies_just_out_of_reach_form_few_pairs(spark, monkeypatch):
    rnd, rows = random.Random(8), []
    for d in range(120):
        words = [f"w{i}" for i in range(150)]
        for i in rnd.sample(range(25), 1 if d % 2 else 3):  # three and one changes differ in 24 of 296 shingles, 15 are allowed
            words[5 + i * 5] = f"d{d}x{i}"
        rows.append((d, " ".join(words)))
    made, store = [], jaccard.materialise

    def counted(df, label):
        stored = store(df, label)
        made.extend([stored.count()] if label == "rest" else [])
        return stored

    monkeypatch.setattr(jaccard, "materialise", counted)
    assert classes(spark, rows, 3, 90) == brute(rows, 3, 90)
    assert sum(made) <= 240


def test_marks_never_differ_in_more_places_than_sets():
    rng = np.random.default_rng(4)
    for size in (1, 5, 60, 900):
        a, b = (np.unique(rng.integers(0, 2 * size, size)).astype(np.uint64) for _ in "ab")
        with np.errstate(over="ignore"):
            bits = sum(int(x).bit_count() for x in (jaccard._marks(a) ^ jaccard._marks(b)).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b)) and (size > 60 or bits or np.array_equal(a, b))


def test_folded_marks_are_those_of_fewer_cells():
    tokens = np.arange(3000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 | 1)
    with np.errstate(over="ignore"):
        long, short = jaccard._long_marks(tokens), jaccard._marks(tokens)
    assert len(long) == 64 and np.array_equal(np.bitwise_xor.reduce(long.reshape(-1, jaccard.MARKS)), short)
    assert len(jaccard._long_marks(tokens[:512])) == len(jaccard._long_marks(tokens[:0])) == jaccard.MARKS


def test_whole_sets_are_kept_only_of_texts_that_may_link(spark, monkeypatch):
    rnd, rows = random.Random(2), []
    for d in range(40):  # pairs that share one passage, and a pair of near copies of another length of marks
        passage = [f"p{d // 2}_{i}" for i in range(30)]
        rows.append((d, " ".join(passage + [f"d{d}x{i}" for i in range(10)])))
    words = [f"w{i}" for i in range(520)]
    rows += [(50, " ".join(words[:500])), (51, " ".join(words)), (52, " ".join(f"z{rnd.random()}" for _ in range(600)))]
    made, store = [], jaccard.materialise

    def counted(df, label):
        stored = store(df, label)
        made.extend([stored.count()] if label == "tokens" else [])
        return stored

    monkeypatch.setattr(jaccard, "materialise", counted)
    assert classes(spark, rows, 3, 90) == brute(rows, 3, 90)
    assert sum(made) <= 2


@pytest.mark.parametrize("small", [0, 2])
def test_members_of_larger_keys_meet_by_rare_shingles(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL_KEY", small)
    test_components_of_many_near_copies(spark, 3, 90)


def test_members_of_a_key_are_compared_by_sizes_and_marks(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 700).astype(np.uint64)
    sets = [base[: 700 - 40 * (i % 6)] for i in range(30)] + [rng.integers(0, 2**63, 500).astype(np.uint64) for _ in range(10)]
    with np.errstate(over="ignore"):
        rows = [(i % 3, i, i if i % 5 else 0, len(s), jaccard._long_marks(s).tolist()) for i, s in enumerate(sets)]
    members = spark.createDataFrame(rows, "key long, id long, label long, n long, marks array<long>")
    got = {(r.a, r.b) for r in jaccard.close_members(members, 80).collect()}
    pairs = [(x, y) for x in rows for y in rows if x[1] < y[1] and x[0] == y[0] and x[2] != y[2]]
    apart = {(x[1], y[1]): len(np.setxor1d(sets[x[1]], sets[y[1]])) * 180 - (x[3] + y[3]) * 20 for x, y in pairs}
    assert got == {p for p, more in apart.items() if more <= 0} and 0 < len(got) < len(apart)
