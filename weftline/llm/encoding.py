"""Encoding whole text columns with a public tokenizer, once for each distinct piece in a worker."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .words import Words, blocks, polynomial

#: Known pieces that a worker keeps (about 30 bytes each); when there are more it starts anew.
KNOWN_PIECES = 1_000_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"]] = True
#: Second byte of a Latin-1 letter after C3.
_LATIN = np.zeros(256, bool)
_LATIN[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Pieces that a tokenizer of the ``spaced`` kind encodes independently: cut at ASCII white space, and between letters (of
    ASCII and Latin-1) and ASCII marks other than the apostrophe, both ways. A-Z are folded unless a combining mark may follow."""
    n = len(data)
    combining = bool(((data == 0xCC) | (data == 0xCD)).any())
    folded = data.copy() if combining else _FOLD[data]
    inside, letter, mark = ~_SPACE[data], _LETTER[data], _MARK[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if n else np.zeros(0, np.int64)
    lead = lead[_LATIN[data[lead + 1]]]
    letter[lead] = letter[lead + 1] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | letter[1:] & mark[:-1] | mark[1:] & letter[:-1]
    bounds = offsets[offsets < n]
    start[bounds] = inside[bounds]
    starts = np.flatnonzero(start)
    stop = inside
    stop[:-1] &= ~inside[1:] | start[1:]
    ends = np.flatnonzero(stop) + 1
    hashes = polynomial(folded.astype(np.uint64) + np.uint64(1), starts, ends, 0x100000001B3)
    return Words(folded, starts, ends, hashes, np.searchsorted(starts, offsets))


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, equal to the library's ``encode(text, add_special_tokens=False)``.

    With ``spaced`` the tokenizer must drop white space, fold case by character and split letters from marks, as word_bpe_49k does;
    distinct pieces are then encoded once, known by a 64-bit hash and checked by a second one; where the two disagree the block's
    texts are encoded whole, as is a text that may hold a special token's string.
    """

    def __init__(self, path: str, spaced: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced = Tokenizer.from_file(path), spaced
        self.special = tuple({t.content.encode()[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})
        self._forget()

    def _forget(self) -> None:
        self.keys, self.second = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, keys: np.ndarray, second: np.ndarray, pieces: list[bytes]) -> None:
        got = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        length = np.fromiter(map(len, got), np.int64, len(got))
        total = int(length.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + total] = np.fromiter((i for ids in got for i in ids), np.uint32, total)
        start = self.used + np.cumsum(length) - length
        self.used += total
        at = np.searchsorted(self.keys, keys)
        self.keys, self.second = np.insert(self.keys, at, keys), np.insert(self.second, at, second)
        self.start, self.length = np.insert(self.start, at, start), np.insert(self.length, at, length)

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a block, and where each text's begin; none if two pieces have the same hash."""
        w = pieces_of(data, offsets)
        second = polynomial(w.folded.astype(np.uint64) + np.uint64(7), w.starts, w.ends, 0x5851F42D4C957F2D)
        if len(self.keys) > KNOWN_PIECES:
            self._forget()
        distinct, first, back = np.unique(w.hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.keys):
            new = self.keys[np.minimum(at, len(self.keys) - 1)] != distinct
        if new.any():
            self._learn(distinct[new], second[first[new]], [w.word(i) for i in first[new].tolist()])
            at = np.searchsorted(self.keys, distinct)
        if (self.second[at][back] != second).any():
            return None
        length = self.length[at][back]
        stop = np.cumsum(length)
        bounds = np.concatenate([[0], stop])[w.first]
        where = np.repeat(self.start[at][back] - stop + length, length) + np.arange(stop[-1] if len(stop) else 0)
        return self.pool[where], bounds

    def _whole(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def column(self, texts: pa.Array):
        """The ids of each text, null counting as empty."""
        for row, stop, data, offsets in blocks(texts):
            bounds = offsets.tolist()
            raw = data.tobytes()
            whole = set()
            if not self.spaced or any(s in raw for s in self.special):
                whole = {k for k in range(stop - row) if not self.spaced or any(s in raw[bounds[k] : bounds[k + 1]] for s in self.special)}
            found = self._block(data, offsets) if self.spaced else None
            if found is None:
                whole = set(range(stop - row))
            ids, cut = found or (np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64))
            cut = cut.tolist()
            for k in range(stop - row):
                yield self._whole(raw[bounds[k] : bounds[k + 1]]) if k in whole else ids[cut[k] : cut[k + 1]].tobytes()


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaced: bool = True) -> Encoder:
    """The worker's own encoder; it outlives the task."""
    if (path, spaced) not in _ENCODERS:
        _ENCODERS[path, spaced] = Encoder(path, spaced)
    return _ENCODERS[path, spaced]
