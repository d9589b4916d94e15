"""Alphanumeric words of UTF-8 texts with their CRC-32, computed over whole Arrow batches.

Upper-case ASCII letters are lowered first. A word is a maximal run of ASCII
letters, digits and bytes from 0x80 up. Checksums of joined words come from
those of the words: appending bytes is a linear map of the checksum.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from finloom.llm.words import text_bytes

CHUNK_BYTES = 1 << 20
#: Words of more bytes are summed by zlib one by one.
STEPPED = 64

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ np.where(c & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return c


_BYTE = _byte_table()


def _next_byte(c: np.ndarray) -> np.ndarray:
    return _BYTE[c & np.uint32(255)] ^ (c >> np.uint32(8))


def _maps_of_short_shifts() -> np.ndarray:
    """[n, k, b]: what byte ``b`` at place ``k`` of a checksum becomes when ``n`` bytes follow."""
    one = np.arange(256, dtype=np.uint32)
    maps = [np.stack([one << np.uint32(8 * k) for k in range(4)])]
    for _ in range(STEPPED - 1):
        maps.append(_next_byte(maps[-1]))
    return np.stack(maps)


_SHORT = _maps_of_short_shifts()
_SHORT_FLAT = _SHORT.reshape(-1)


def _apply(one_map: np.ndarray, c: np.ndarray) -> np.ndarray:
    low = np.uint32(255)
    return one_map[0][c & low] ^ one_map[1][(c >> np.uint32(8)) & low] ^ one_map[2][(c >> np.uint32(16)) & low] ^ one_map[3][c >> np.uint32(24)]


def shifted(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The part of the checksum of a joined string that comes from its head, whose checksum is ``c`` and which ``n`` bytes follow."""
    base = (n & (STEPPED - 1)) * 1024
    low = np.uint32(255)
    out = _SHORT_FLAT[base + (c & low)]
    for k in (1, 2, 3):
        out ^= _SHORT_FLAT[base + 256 * k + ((c >> np.uint32(8 * k)) & low)]
    rest, power = n // STEPPED, None
    while rest.any():
        power = _next_byte(_SHORT[-1]) if power is None else _apply(power, power)
        odd = (rest & 1).astype(bool)
        out[odd] = _apply(power, out[odd])
        rest = rest >> 1
    return out


SPACE = np.uint32(zlib.crc32(b" "))


class AlnumChunk:
    """Words of consecutive texts: places ``starts``/``ends`` in ``data``, checksums ``crc``, ``bounds`` of each text's words."""

    __slots__ = ("data", "starts", "ends", "size", "crc", "bounds")

    def __init__(self, data: np.ndarray, byte_bounds: np.ndarray):
        self.data = data = _FOLD[data]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = _IN_WORD[data]
        edge = np.zeros(len(data) + 1, bool)  # a text begins here
        edge[byte_bounds] = True
        self.starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
        self.ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        self.size = self.ends - self.starts
        self.bounds = np.searchsorted(self.starts, byte_bounds)
        self.crc = self._checksums()

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def _checksums(self) -> np.ndarray:
        out = np.full(len(self.starts), 0xFFFFFFFF, np.uint32)
        active = np.flatnonzero(self.size <= STEPPED)
        place, left, value = self.starts[active], self.size[active], out[active]
        while len(active):
            value = _BYTE[(value ^ self.data[place]) & np.uint32(255)] ^ (value >> np.uint32(8))
            place, left = place + 1, left - 1
            done = left == 0
            out[active[done]] = value[done]
            more = ~done
            active, place, left, value = active[more], place[more], left[more], value[more]
        out ^= np.uint32(0xFFFFFFFF)
        for i in np.flatnonzero(self.size > STEPPED):
            out[i] = zlib.crc32(self.data[self.starts[i] : self.ends[i]])
        return out

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def place_in_text(self) -> np.ndarray:
        return np.arange(len(self.starts)) - np.repeat(self.bounds[:-1], np.diff(self.bounds))

    def runs(self, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1 .. ``longest`` words: checksums of the runs, joined by one space, that end at each word, and which words have one."""
        value, place = self.crc, self.place_in_text()
        yield value, np.ones(len(value), bool)
        for k in range(2, longest + 1):
            head = np.concatenate([np.zeros(1, np.uint32), value[:-1]]) if len(value) else value
            with_space = shifted(head, np.ones(len(head), np.int64)) ^ SPACE
            value = shifted(with_space, self.size) ^ self.crc
            yield value, place >= k - 1


def alnum_chunks(texts: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[AlnumChunk]:
    """The texts of a batch in order, in chunks of about ``chunk_bytes``; every text is whole, null is empty. Memory is linear in the longest text."""
    if len(texts) == 0:
        return
    data, bounds = text_bytes(texts)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(bounds, bounds[first] + chunk_bytes, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        part = bounds[first : last + 1]
        yield AlnumChunk(data[part[0] : part[-1]], part - part[0])
        first = last
