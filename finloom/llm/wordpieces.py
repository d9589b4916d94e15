"""Word-piece counts by a linear longest-match automaton.

A trie of the vocabulary carries, for every node, the node to go on from when
no longer match exists (its failure link) and how many pieces are popped on
the way. Counting needs one pass over a word and builds no pieces.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
END = "</w>"
WORDS = re.compile(r"[^\W\d_]+|\d|[^\s\w]+|_+")
CACHE = 200000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Counter:
    """Greedy longest-match lengths over ``pieces``; symbols are single characters.

    A word's last piece may hold END or not: an END that no piece takes along
    is popped without counting.
    """

    _made: dict[str, Counter] = {}

    def __init__(self, pieces: list[str]):
        self.go: list[dict[str, int]] = [{}]
        parent, symbol, is_piece = [0], [""], [False]
        for piece in pieces:
            at = 0
            for c in self.symbols(piece):
                if c not in self.go[at]:
                    self.go[at][c] = len(self.go)
                    self.go.append({})
                    parent.append(at)
                    symbol.append(c)
                    is_piece.append(False)
                at = self.go[at][c]
            is_piece[at] = at > 0
        if END not in self.go[0]:
            self.go[0][END] = len(self.go)
            self.go.append({})
            parent.append(0)
            symbol.append(END)
            is_piece.append(True)
        alone = self.go[0][END]
        is_piece[alone] = True
        self.fail: list[int | None] = [None] * len(self.go)
        self.popped = [0] * len(self.go)
        level = list(self.go[0].values())
        while level:
            for node in level:
                if is_piece[node]:
                    self.fail[node], self.popped[node] = 0, int(node != alone)
                    continue
                link, count = self.fail[parent[node]], self.popped[parent[node]]
                while link is not None and symbol[node] not in self.go[link]:
                    count += self.popped[link]
                    link = self.fail[link]
                if link is not None:
                    self.fail[node], self.popped[node] = self.go[link][symbol[node]], count
            level = [x for node in level for x in self.go[node].values()]
        self._cache: dict[str, int] = {}
        self._letters = byte_letters()

    @staticmethod
    def symbols(piece: str) -> list[str]:
        return [*piece[: -len(END)], END] if piece.endswith(END) and piece != END else list(piece)

    @classmethod
    def of(cls, path: str) -> Counter:
        if path not in cls._made:
            with open(path, encoding="utf-8") as file:
                cls._made[path] = cls(sorted(json.load(file)["model"]["vocab"]))
        return cls._made[path]

    def count_symbols(self, symbols: list[str]) -> int:
        """Number of pieces; 1 (the unknown piece) for a word that cannot be cut."""
        at = count = 0
        for c in symbols:
            while c not in self.go[at]:
                if self.fail[at] is None:
                    return 1
                count += self.popped[at]
                at = self.fail[at]
            at = self.go[at][c]
        while at:
            if self.fail[at] is None:
                return 1
            count += self.popped[at]
            at = self.fail[at]
        return count

    def count(self, text: str | None) -> int:
        total = 0
        for word in WORDS.findall((text or "").lower()):
            n = self._cache.get(word)
            if n is None:
                n = self.count_symbols([*(self._letters[b] for b in word.encode()), END])
                if len(self._cache) >= CACHE:
                    self._cache.clear()
                if len(word) < 64:
                    self._cache[word] = n
            total += n
        return total


def count_pieces(df: DataFrame, text: str = "text", into: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with the number of word pieces of each whole text; null and empty texts have 0. A column named ``into`` is replaced."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter.of(vocabulary)
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    return df.withColumn(into, F.pandas_udf(run, "long")(F.col(f"`{text}`")))
