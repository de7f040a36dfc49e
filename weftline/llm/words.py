"""Words and word n-grams of whole Arrow text columns as numpy arrays, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken in blocks of about this many bytes, so memory doesn't follow the Arrow batch.
BLOCK_BYTES = 1 << 19


def _table(separators: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    fold = np.arange(256, dtype=np.uint8)
    fold[ord("A") : ord("Z") + 1] += 32
    inside = np.ones(256, bool)
    for lo, hi in separators:
        inside[lo : hi + 1] = False
    return fold, inside[fold]


#: Words are runs of bytes other than ASCII white space. A-Z are folded.
SPACED = _table([(0x20, 0x20), (0x09, 0x0D)])
#: Words are runs of ASCII letters, digits and everything beyond ASCII. A-Z are folded.
ALNUM = _table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with at most ``limit`` bytes, or of one longer row."""
    data, offsets = flat(texts)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        stop = min(stop, rows)
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(2)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0.. and base^-0.. modulo 2^64, at least n of each; base is odd."""
    size = BLOCK_BYTES + 64
    while size < n:
        size *= 2
    return _powers(base, size)


def polynomial(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:end] for every pair, from one running sum."""
    power, inverse = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=total[1:])
    return mix64((total[ends] - total[starts]) * inverse[starts])


@dataclass
class Words:
    """Words of a block of texts: byte ranges in ``folded``, 64-bit hashes, and ``first``: the index of each text's first word, then the number of words."""

    folded: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def word(self, i: int) -> bytes:
        return self.folded[self.starts[i] : self.ends[i]].tobytes()

    def prefixes(self, n: int) -> np.ndarray:
        """Hash of the first n bytes of each word (of the whole word if it has no more)."""
        return polynomial(self.folded.astype(np.uint64) + np.uint64(1 + n), self.starts, np.minimum(self.starts + n, self.ends), 0x100000001B3)

    def owner(self) -> np.ndarray:
        """Row of each word within the block."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, and whether they are all of one text."""
        count = len(self.starts) - n + 1
        if count <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        at = np.arange(count)
        text_end = np.repeat(self.first[1:], np.diff(self.first))[:count]
        return polynomial(self.hashes, at, at + n, 0x9E3779B97F4A7C15), at + n <= text_end


def words_of(data: np.ndarray, offsets: np.ndarray, kind=ALNUM, hashed: bool = True) -> Words:
    fold, inside = kind
    folded = fold[data]
    mask = inside[data]
    n = len(data)
    bounds = offsets[(offsets > 0) & (offsets < n)]
    before = np.zeros(n, bool)
    before[1:] = mask[:-1]
    before[bounds] = False
    after = np.zeros(n, bool)
    after[:-1] = mask[1:]
    after[bounds - 1] = False
    starts, ends = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    hashes = polynomial(folded.astype(np.uint64) + np.uint64(1), starts, ends, 0x100000001B3) if hashed else np.zeros(0, np.uint64)
    return Words(folded, starts, ends, hashes, np.searchsorted(starts, offsets))


def pack(planes: np.ndarray) -> bytes:
    """Values as byte planes: equal high bytes lie together and compress."""
    return np.ascontiguousarray(planes).view(np.uint8).reshape(len(planes), planes.itemsize).T.tobytes()


def unpack(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).ravel()
