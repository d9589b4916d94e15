"""Base phrases against plain word lists over whole texts, notices against a search without the index."""

import random
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from finloom.llm import licences
from finloom.llm.alnum import alnum_chunks
from finloom.llm.licences import BASE_PHRASES, TEMPLATES, LicenceIndex, scan, words_of

INDEX = LicenceIndex()
NOTICES = [t[1] for t in TEMPLATES]


def plain_base(text):
    words = [w.decode() for w in words_of(text or "")]
    return sorted((i, label) for phrase, label in BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())


def plain_labels(text):
    """Every place of the text is tried as the begin of every template."""
    words = words_of(text or "")
    found = set()
    for t in INDEX.templates:
        for place in range(-len(t.words), len(words)):
            agree = {w for w, places in t.rare.items() for q in places for p in range(max(0, place + q), min(len(words), place + q + licences.SLACK + 1)) if words[p] == w}
            window = words[max(0, place - licences.SLACK) : place + 2 * licences.SLACK + len(t.words)]
            if len(agree) >= t.needed and INDEX.accepted(t, window) is not None:
                found.add(t.label)
    return found


def scanned(texts, chunk_bytes=1 << 20):
    return [r for chunk in alnum_chunks(pa.array(texts, pa.string()), chunk_bytes) for r in scan(chunk, INDEX)]


@pytest.mark.parametrize("number", range(len(TEMPLATES)))
def test_every_notice_is_found(number):
    label, notice, _ = TEMPLATES[number]
    changed = words_of(notice)
    inside = {i + d for k in INDEX.templates[number].keys for i in range(len(changed)) if changed[i : i + len(k)] == k for d in range(1, len(k))}
    free = [i for i in range(len(changed)) if i not in inside]
    changed[free[len(free) // 2] : free[len(free) // 2]] = [] if len(changed) < 15 else [b"copyright", b"holder"]
    for text in (notice, f"some words before it {notice.upper()} and after", b" ".join(changed).decode()):
        assert label in {x[2] for x in scanned([text])[0][2]}, text


def test_without_key_phrases_nothing_is_found():
    texts = ["released under the license of the mit", "license version 2 0 apache under the licensed", "creative attribution commons 4 0 international work", "permission notice",
             "the general public may license the work", "all rights are reserved", "cc , nothing by"]
    assert [r[1:] for r in scanned(texts)] == [([], [])] * len(texts)


def test_phrases_do_not_cross_texts():
    assert [r[1] for r in scanned(["all rights", "reserved all", "rights reserved", None, "", "CC-BY cc.by cc cc by"])] == [[], [], [], [], [], [(0, "cc-by"), (2, "cc-by"), (5, "cc-by")]]


def test_whole_tables_against_plain_words():
    texts = [t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    got = scanned(texts, 5000)
    assert [sorted(r[1]) for r in got] == [plain_base(t) for t in texts]
    assert [r[0] for r in got] == [len(words_of(t or "")) for t in texts]
    short = {"mit": "mit license", "apache-2.0": "apache license version 2 0", "gpl-3.0": "general public license version 3", "cc-by-nc-4.0": "cc by nc 4 0"}
    for r, t in zip(got, texts):
        line = " ".join(w.decode() for w in words_of(t or ""))
        assert {x[2] for x in r[2]} == {label for label, phrase in short.items() if phrase in line}


def test_mixed_texts_against_a_search_without_the_index():
    rng = random.Random(4)
    vocabulary = sorted({w.decode() for n in NOTICES for w in words_of(n)}) + ["lorem", "ipsum"]
    texts = []
    for _ in range(40):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randrange(12))) for _ in range(3)]
        notice = rng.choice(NOTICES).split()
        for _ in range(rng.randrange(4)):
            notice[rng.randrange(len(notice))] = rng.choice(vocabulary)
        texts.append(f"{parts[0]} {' '.join(notice)} {parts[1]} {rng.choice(NOTICES)} {parts[2]}")
    for text, r in zip(texts, scanned(texts)):
        assert {x[2] for x in r[2]} == plain_labels(text), text


def test_repeated_rare_words_stay_linear():
    (n, base, notices), = scanned(["apache license " * 200000 + "all rights reserved"])
    assert (n, len(base), notices) == (400003, 1, [])


def test_find_licences_in_a_frame(spark):
    rows = [(1, None), (2, ""), (3, "Released under the MIT License. All Rights Reserved. All rights reserved"), (3, "Released under the MIT License."), (None, "CC BY x")]
    docs = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id long, text string, labels string")
    got = licences.find_licences(docs).select("doc_id", "labels", *[c.alias(f"r{i}") for i, c in enumerate(licences.summary())]).orderBy("doc_id", "r0").collect()
    assert [tuple(r) for r in got] == [
        (None, "own", 3, 1, 0, 0, "cc-by", "cc-by", 1.0), (1, "own", 0, 0, None, None, "", "", 0.0), (2, "own", 0, 0, None, None, "", "", 0.0),
        (3, "own", 5, 0, None, None, "", "mit", 1.0), (3, "own", 11, 2, 5, 8, "reserved", "mit,reserved", 1.0)]
    assert licences.find_licences(docs.where("1 = 0"), into="text").count() == 0
    assert docs.where(F.lit(True)).columns == ["doc_id", "text", "labels"]


def test_words_are_lowered_only_in_ascii():
    assert [w.decode() for w in words_of("ÀB c_D\x7f9")] == re.findall(r"[^ _\x7f]+", "Àb c_d\x7f9")
