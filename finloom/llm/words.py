"""Words of UTF-8 texts as 64-bit hashes, computed over whole Arrow batches.

A word is a maximal run of bytes other than ``\\x20\\x09-\\x0D``; upper-case
ASCII letters may be folded. A word's hash is a polynomial over its bytes with
a final mix, so it does not depend on the place of the word, the process or
the machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Bytes handled at once, unless one text alone is longer.
CHUNK_BYTES = 1 << 20

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            _powers[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]), dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordChunk:
    """Words of some consecutive texts: ``hashes``, byte places ``starts``/``ends`` in ``data``, ``bounds`` of each text's words."""

    __slots__ = ("first", "data", "hashes", "starts", "ends", "bounds", "byte_bounds")

    def __init__(self, first: int, data: np.ndarray, byte_bounds: np.ndarray, fold: bool):
        self.first, self.byte_bounds = first, byte_bounds
        self.data = data = _FOLD[data] if fold else data
        n = len(data)
        inside = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)  # a text begins here
        edge[byte_bounds] = True
        before = np.empty(n + 1, bool)
        before[0], before[1:] = False, inside
        after = np.empty(n + 1, bool)
        after[:n], after[n] = inside, False
        self.starts = starts = np.flatnonzero(after & (~before | edge))
        self.ends = ends = np.flatnonzero(before & (~after | edge))
        power, inverse = _power_tables(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        self.hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        self.bounds = np.searchsorted(starts, byte_bounds)

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def text_of_word(self) -> np.ndarray:
        """For each word, the number of its text in this chunk."""
        return np.repeat(np.arange(len(self)), np.diff(self.bounds))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the ``k``-word shingles in order and the bounds of each text's; a shorter text is one shingle."""
        h, n = self.hashes, np.diff(self.bounds)
        value = np.full(len(h), k, np.uint64)
        for j in range(k):
            m = max(len(h) - j, 0)
            value[:m] = mix(value[:m] * np.uint64(31) + h[j:])
        short = (n > 0) & (n < k)
        counts = np.where(short, 1, np.maximum(n - k + 1, 0))
        bounds = np.concatenate([[0], np.cumsum(counts)])
        out = value[np.repeat(self.bounds[:-1] - bounds[:-1], counts) + np.arange(bounds[-1])]
        for i in np.flatnonzero(short):
            x = np.uint64(int(n[i]))
            for w in h[self.bounds[i] : self.bounds[i + 1]]:
                x = mix(np.array([x], np.uint64) * np.uint64(37) + w)[0]
            out[bounds[i]] = x
        return out, bounds


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the bounds of each; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    bounds = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None and len(texts) else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def word_chunks(texts: pa.Array, fold: bool = True, chunk_bytes: int = CHUNK_BYTES) -> Iterator[WordChunk]:
    """The texts of a batch in order, in chunks of about ``chunk_bytes``; every text is whole."""
    if len(texts) == 0:
        return
    data, bounds = text_bytes(texts)
    first = 0
    with np.errstate(over="ignore"):
        while first < len(texts):
            last = int(np.searchsorted(bounds, bounds[first] + chunk_bytes, "right")) - 1
            last = min(max(last, first + 1), len(texts))
            part = bounds[first : last + 1]
            yield WordChunk(first, data[part[0] : part[-1]], part - part[0], fold)
            first = last
