"""Counts of the automaton against a plain longest match, over every word of a table."""

import json
import random

import duckdb
import pytest

from finloom.llm.wordpieces import END, VOCABULARY, WORDS, Counter, byte_letters


def plain(word, pieces, longest):
    """Longest piece first, again and again; the end mark may be left over. None for a word that cannot be cut."""
    count = place = 0
    while place < len(word):
        size = next((n for n in range(min(longest, len(word) - place), 0, -1) if "".join(word[place : place + n]) in pieces), None)
        if size is None:
            return count if word[place:] == [END] else None
        count, place = count + 1, place + size
    return count


def test_every_word_of_a_table():
    with open(VOCABULARY, encoding="utf-8") as file:
        pieces = set(json.load(file)["model"]["vocab"])
    letters, counter, longest = byte_letters(), Counter.of(VOCABULARY), max(map(len, pieces))
    words = {w for (t,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall() for w in WORDS.findall((t or "").lower())}
    assert len(words) > 10000
    for word in words:
        symbols = [*(letters[b] for b in word.encode()), END]
        want = plain(symbols, pieces, longest)
        assert want is not None and counter.count_symbols(symbols) == want, word


@pytest.mark.parametrize("seed", range(3))
def test_random_vocabularies(seed):
    rng = random.Random(seed)
    pieces = {"".join(rng.choices("abc", k=rng.randrange(1, 5))) + rng.choice(["", END]) for _ in range(25)}
    counter = Counter(sorted(pieces))
    for _ in range(500):
        word = [*rng.choices("abc", k=rng.randrange(0, 12)), END]
        want = plain(word, pieces, 6)
        assert counter.count_symbols(word) == (1 if want is None else want), (word, pieces)


def test_long_words_and_words_without_an_end_piece():
    counter = Counter.of(VOCABULARY)
    assert counter.count("a" * 100000) > 5000
    assert counter.count("für thre ç") >= 3 and counter.count(None) == counter.count("") == 0
    assert Counter(["a", "b"]).count_symbols(["a", "b", END]) == 2
