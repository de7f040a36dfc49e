"""LM scoring with an interpolated modified Kneser-Ney model of any order (three by default).

Counting: tasks turn texts into 64-bit word hashes, count within some million tokens, and send blocks of counts to shards by ranges
of hashes. A word's number is its rank in these stored sorted arrays; from here on n-grams are made of numbers. An n-gram is sharded
by its last word but one, so a shard knows all that follows a context, and the shorter n-grams that follow from its own: one shuffle
serves every order from two up. The few words that make up more than half a shard alone are spread by their last two context words;
their bigrams are then merged once more, by the whole bigram, and the figures of these words as contexts are added up. A shard
merges its blocks and stores sorted hash arrays (one file in the shared folder); it sends on, for each last word, in how many
bigrams it stands, which is merged by word. Shards hold about ``SHARD_TOKENS`` tokens, so their number follows the corpus and a
task's memory doesn't.

A file has, for each order, the 40-bit fingerprints of its contexts with their numbers of followers, and the followers as numbers of
three bytes, or of four where a shard has any beyond 16 million, with counts of one byte (larger counts stand apart). Contexts with
more than ``WIDE`` followers keep four bytes of each. So an n-gram takes six or seven bytes; with a million contexts in a shard, one
whose context was never seen is taken for a seen one with probability 1e-6. Numbers are exact up to four thousand million words.

Scoring: workers memory-map the arrays and look up batches of tokens, shard by shard. That suits a model of up to ``DIRECT_SHARDS``
shards, of which every batch meets most. The n-grams of texts are sent to the shards of a larger model instead, by a join with the
table of its files: a task reads a shard's file once for all that was sent to it, and sends back sums by document. N-grams whose last
context word is spread go to their bigram's shard first. What the driver holds is a row of figures for each million words of the
vocabulary and the spread words; only of a model for direct use, also the names of its files.
"""

from __future__ import annotations

import struct
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder
from .shared import Arrays, as_table, bounded_batches, cut_lineage, make_dir, shared_dir
from .words import SPACED, blocks, mix64, pack, unpack, words_of

ORDER, SHARD_TOKENS, FLUSH_TOKENS, SCORE_TOKENS, WORD_SHARD, WIDE, DIRECT_SHARDS = 3, 3_000_000, 2_000_000, 1_000_000, 1_000_000, 255, 256
END = np.uint64(0xFEDCBA9876543210)


def tokens_of(texts: pa.Array):
    """(hashes of all tokens with an end after each text, number of tokens of each text) of blocks of a column."""
    for _, _, data, offsets in blocks(texts):
        w = words_of(data, offsets, SPACED)
        yield np.insert(w.hashes, w.first[1:], END), np.diff(w.first) + 1


def columns_of(words: np.ndarray, lengths: np.ndarray, order: int, begin: int) -> list[np.ndarray]:
    """The words of every n-gram, oldest first: as many columns as the order. ``begin`` stands before a text's first word."""
    out, starts = [words], np.cumsum(lengths) - lengths
    for _ in range(order - 1):
        before = np.empty_like(words)
        before[1:] = out[0][:-1]
        before[starts] = begin
        out.insert(0, before)
    return out


def chain(words: list[np.ndarray]) -> np.ndarray:
    """Hash of the words of each row."""
    out = np.zeros(len(words[0]), np.uint64)
    for w in words:
        out += np.uint64(0x51ED270B)
        out = mix64(out)
        out += w
        out = mix64(out)
    return out


def _sum_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the sums of their counts, and a place of each."""
    if not len(keys):
        return keys, counts.astype(np.int64), np.zeros(0, np.int64)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order].astype(np.int64), first), order[first]


def _times(counts: np.ndarray) -> np.ndarray:
    return np.array([int((counts == k).sum()) for k in (1, 2, 3, 4)])


def _steps(sorted_keys: np.ndarray) -> np.ndarray:
    return np.diff(sorted_keys, prepend=sorted_keys.dtype.type(0))


def _narrow(numbers: np.ndarray) -> np.ndarray:
    return numbers.astype(np.uint32 if not len(numbers) or int(numbers.max()) < 1 << 32 else np.uint64)


_COMPRESS, _EXPAND = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def encode(*arrays: np.ndarray) -> bytes:
    body = b"".join(struct.pack("<4sQ", a.dtype.str[1:].encode().ljust(4), len(a)) + pack(a) for a in arrays)
    return _COMPRESS.compress(body)


def decode(data: bytes) -> list[np.ndarray]:
    data, at, out = _EXPAND.decompress(data), 0, []
    while at < len(data):
        kind, n = struct.unpack_from("<4sQ", data, at)
        kind = np.dtype("<" + kind.decode().strip())
        at += 12
        out.append(unpack(data[at : at + n * kind.itemsize], kind) if n else np.zeros(0, kind))
        at += n * kind.itemsize
    return out


def _small(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.uint8 if not len(counts) or counts.max() < 256 else np.uint32 if counts.max() < 1 << 32 else np.uint64)


def word_shard(h: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of hashes: a shard's sorted arrays lie between its neighbours'."""
    return (((h >> np.uint64(40)) * np.uint64(shards)) >> np.uint64(24)).astype(np.int64)


def _blocks_by(shard: np.ndarray, shards: int, body) -> pa.RecordBatch:
    """One row per shard that occurs, with ``body`` of its positions."""
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    some = [s for s in range(shards) if cut[s] < cut[s + 1]]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([body(order[cut[s] : cut[s + 1]]) for s in some], pa.binary())], ["shard", "body"])


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key in sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Discounts(NamedTuple):
    one: float
    two: float
    more: float

    @classmethod
    def of(cls, n: list[int]) -> Discounts:
        """From the numbers of n-grams seen once to four times; where one is zero, the plain steps .5, 1, 1.5. A tenth is the least, so
        that every context leaves something to words it was not seen with."""
        if not all(n[:4]):
            return cls(0.5, 1.0, 1.5)
        y = n[0] / (n[0] + 2 * n[1])
        d = [k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3)]
        return cls(*(min(max(x, 0.1), k + 0.9) for k, x in enumerate(d)))

    def after(self, counts: np.ndarray) -> np.ndarray:
        return counts - np.where(counts == 1, self.one, np.where(counts == 2, self.two, self.more)) * (counts > 0)


def table(name: str, ctx: np.ndarray, word: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of distinct (context, word) rows, their names beginning with ``name``. A follower's number takes three bytes, and a fourth
    where any is beyond them."""
    word = word.astype(np.uint64)
    far = bool(len(word)) and word.max() >= 1 << 24
    if far:
        short, low = ctx & np.uint64((1 << 40) - 1), word & np.uint64(0xFFFFFFFF)
        order = np.lexsort((low, short))
        short, low, counts = short[order], low[order], counts[order]
    else:
        key = (ctx << np.uint64(24)) | word
        order = np.argsort(key)
        key, counts = key[order], counts[order]
        short, low = key >> np.uint64(24), key & np.uint64(0xFFFFFF)
    first = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]])) if len(short) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(short)))
    wide = n > WIDE
    of_wide = np.repeat(wide, n)
    some, w, c = short[first[~wide]], low[~of_wide], counts[~of_wide]
    out = {"hi": (some >> np.uint64(8)).astype(np.uint32), "lo": some.astype(np.uint8), "n": n[~wide].astype(np.uint8)}
    out["starts"] = (np.cumsum(n[~wide]) - n[~wide])[::16].astype(np.uint32)
    out |= {"w": (w >> np.uint64(8) & np.uint64(0xFFFF)).astype(np.uint16), "v": (w & np.uint64(0xFF)).astype(np.uint8), **_bytes("c", c)}
    if far:
        out["x"] = (w >> np.uint64(24)).astype(np.uint8)
    which = np.repeat(np.cumsum(wide) - 1, n)[of_wide].astype(np.uint64)
    full = word[order[of_wide]] & np.uint64(0xFFFFFFFF)
    by = np.argsort((which << np.uint64(32)) | full)
    full, c = full[by], counts[of_wide][by]
    stop = np.cumsum(n[wide])
    stats = _stats_of(c, stop - n[wide]) if len(c) else np.zeros((0, 4))
    out |= {"wide": short[first[wide]], "wide_stop": stop.astype(np.uint32), "wide_stats": stats.astype(np.uint64).ravel(), "u": full.astype(np.uint32), **_bytes("d", c)}
    return {f"{name}{k}": v for k, v in out.items()}


def _stats_of(counts: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sum, ones, twos and higher counts of each run."""
    return np.stack([np.add.reduceat(x.astype(np.int64), begin) for x in (counts, counts == 1, counts == 2, counts > 2)], axis=1)


#: A count's part in its context's figures: itself in the low 32 bits, then whether it is one or two; 255 is added apart.
_PARTS = np.where(np.arange(256) == 255, 0, np.arange(256)).astype(np.int64)
_PARTS[1] += 1 << 32
_PARTS[2] += 1 << 48


def _small_stats(f: dict[str, np.ndarray], flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The figures of contexts of at most WIDE followers, whose places lie in ``flat``."""
    raw, begin = f["c"][flat], np.cumsum(n) - n
    packed = np.add.reduceat(_PARTS[raw], begin)
    ones, twos = (packed >> 32) & 0xFFFF, packed >> 48
    out = np.stack([packed & 0xFFFFFFFF, ones, twos, n - ones - twos], axis=1).astype(float)
    big = np.flatnonzero(raw == 255)
    if len(big):
        np.add.at(out[:, 0], np.searchsorted(begin, big, "right") - 1, _counts_at(f, "c", flat[big]))
    return out


def _bytes(name: str, counts: np.ndarray) -> dict[str, np.ndarray]:
    large = np.flatnonzero(counts >= 255)
    return {name: np.minimum(counts, 255).astype(np.uint8), f"{name}_at": large.astype(np.uint32), f"{name}_large": counts[large].astype(np.uint64)}


def _counts_at(f: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    out = f[name][at].astype(np.int64)
    big = np.flatnonzero(out == 255)
    if len(big):
        out[big] = f[f"{name}_large"][np.searchsorted(f[f"{name}_at"], at[big].astype(np.uint32))]
    return out


def _lower_bound(value, begin: np.ndarray, stop: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """First place from ``begin`` on, before ``stop``, whose value isn't below the one wanted; each row has its own sorted run."""
    low, high = begin.copy(), stop.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        mid = (low[open_] + high[open_]) >> 1
        less = value(mid) < wanted[open_]
        low[open_[less]] = mid[less] + 1
        high[open_[~less]] = mid[~less]
        open_ = open_[low[open_] < high[open_]]
    return low


def look_up(f: dict[str, np.ndarray], name: str, ctx: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of (context, word) rows, and their contexts' figures (sum, ones, twos, higher); zeros where unknown. Equal contexts
    must stand together."""
    f = {k[len(name) :]: v for k, v in f.items() if k.startswith(name)}
    count, stats = np.zeros(len(ctx), np.int64), np.zeros((len(ctx), 4))
    edge = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
    back = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(ctx))))
    short = ctx[edge] & np.uint64((1 << 40) - 1)
    at, known = _find_short(f, short)
    if known.any():
        have, at = np.flatnonzero(known), at[known]
        near = (at >> 4) << 4
        ahead = near[:, None] + np.arange(15)
        begin = f["starts"][at >> 4].astype(np.int64) + np.where(ahead < at[:, None], f["n"][np.minimum(ahead, len(f["n"]) - 1)], 0).sum(1, dtype=np.int64)
        n = f["n"][at].astype(np.int64)
        stop = begin + n
        flat = np.repeat(stop - np.cumsum(n), n) + np.arange(n.sum())
        per = np.zeros((len(edge), 4))
        per[have] = _small_stats(f, flat, n)
        place = np.full(len(edge), -1)
        place[have] = np.arange(len(have))
        rows = np.flatnonzero(known[back])
        stats[rows] = per[back[rows]]
        mine = place[back[rows]]
        top = f.get("x")
        fits = lambda x: (f["w"][x].astype(np.uint32) << np.uint32(8)) | f["v"][x] | (0 if top is None else top[x].astype(np.uint32) << np.uint32(24))
        _take(f, "c", fits, begin[mine], stop[mine], (word[rows] & 0xFFFFFFFF).astype(np.uint32), count, rows)
    at, known = _find(f["wide"], short)
    if known.any():
        rows = np.flatnonzero(known[back])
        mine = at[back[rows]]
        stats[rows] = f["wide_stats"].reshape(-1, 4)[mine]
        stop = f["wide_stop"].astype(np.int64)
        begin = np.concatenate([[0], stop[:-1]])
        _take(f, "d", lambda x: f["u"][x], begin[mine], stop[mine], (word[rows] & 0xFFFFFFFF).astype(np.uint32), count, rows)
    return count, stats


def _take(f, name, value, begin, stop, wanted, count, rows) -> None:
    at = _lower_bound(value, begin, stop, wanted)
    inside = np.flatnonzero(at < stop)
    inside = inside[value(at[inside]) == wanted[inside]]
    count[rows[inside]] = _counts_at(f, name, at[inside])


def _find_short(f: dict[str, np.ndarray], short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of 40-bit fingerprints, and whether they are there."""
    hi, lo = (short >> np.uint64(8)).astype(np.uint32), short.astype(np.uint8)
    keys = f["hi"]
    if not len(keys):
        return np.zeros(len(short), np.int64), np.zeros(len(short), bool)
    at = np.searchsorted(keys, hi)
    while True:
        here = np.minimum(at, len(keys) - 1)
        same = (at < len(keys)) & (keys[here] == hi)
        wrong = same & (f["lo"][here] != lo)
        if not wrong.any():
            return here, same
        at = at + wrong


class Vocabulary(NamedTuple):
    """Files of words by ranges of hashes; a word's number is that of its file's first word plus its place. 0 is an unknown word,
    one above the last is the begin of a text."""

    files: list[str]
    first: np.ndarray

    @property
    def begin(self) -> int:
        return int(self.first[-1])

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and training counts of distinct sorted hashes."""
        number, count = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        cut = np.searchsorted(word_shard(h, len(self.files)), np.arange(len(self.files) + 1))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            if self.files[s]:
                f, here = Arrays.open(self.files[s]), slice(cut[s], cut[s + 1])
                at, there = _find(f["keys"], h[here])
                number[here], count[here] = np.where(there, self.first[s] + at, 0), np.where(there, f["counts"][at], 0)
        return number, count


class Model(NamedTuple):
    """``stored`` is the table of n-gram files (kind, shard, uri); ``grams`` and ``apart`` list them by shard in a model for direct use."""

    order: int
    words: Vocabulary
    seconds: list[str]
    shards: int
    stored: DataFrame | None
    grams: list[str]
    apart: list[str]
    spread: np.ndarray
    spread_stats: np.ndarray
    tokens: int
    pairs: int
    discounts: list[Discounts]
    word_rest: float

    @property
    def vocabulary(self) -> int:
        return self.words.begin - 1

    def words_at(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers and training counts of distinct sorted hashes, and what ``lowest`` takes."""
        number, count = self.words.find(h)
        stands = count
        if self.order > 1:
            stands = np.zeros(len(h), np.int64)
            known = np.flatnonzero(number)
            shard = np.searchsorted(self.words.first, number[known], "right") - 1
            for s in np.unique(shard).tolist():
                here = known[shard == s]
                if self.seconds[s]:
                    stands[here] = Arrays.open(self.seconds[s])["counts"][number[here] - self.words.first[s]]
        return number, count, stands

    def lowest(self, stands: np.ndarray) -> np.ndarray:
        """Probabilities below the bigram level of words that stand in so many bigrams."""
        return np.maximum(self.discounts[0].after(stands), 0) / max(self.pairs, 1) + self.word_rest / (self.vocabulary + 1)

    def raised(self, k: int, below: np.ndarray, c: np.ndarray, stats: np.ndarray) -> np.ndarray:
        """Probabilities at the level of k-grams from those below, the k-grams' counts and their contexts' figures."""
        d, total = self.discounts[k - 1], stats[:, 0]
        rest = stats[:, 1] * d.one + stats[:, 2] * d.two + stats[:, 3] * d.more
        some = np.maximum(total, 1)
        return np.where(total > 0, np.maximum(d.after(c), 0) / some + rest / some * below, below)

    def rows_at(self, files: list[str], shard: np.ndarray, name: str, ctx: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count, stats = np.zeros(len(ctx), np.int64), np.zeros((len(ctx), 4))
        short = ctx & np.uint64((1 << 40) - 1)
        order = np.argsort(shard.astype(np.uint64) << np.uint64(40) | short) if len(files) < 1 << 24 else np.lexsort((short, shard))
        cut = np.searchsorted(shard[order], np.arange(len(files) + 1))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            if files[s]:
                here = order[cut[s] : cut[s + 1]]
                count[here], stats[here] = look_up(Arrays.open(files[s]), name, ctx[here], word[here])
        return count, stats

    def probabilities(self, tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each token of texts after those before it, and its training count."""
        distinct, back = np.unique(tokens, return_inverse=True)
        number, count, stands = self.words_at(distinct)
        count, p = count[back], self.lowest(stands)[back]
        if not self.shards:
            return p, count
        words = columns_of(number.astype(np.uint64)[back], lengths, self.order, self.words.begin)
        at, apart = _find(self.spread, words[-2])
        shard = _route(words, self.spread, self.shards)
        for k in range(2, self.order + 1):
            ctx = chain(words[-k:-1])
            if k > 2 or not apart.any():
                c, stats = self.rows_at(self.grams, shard, f"{k}.", ctx, words[-1])
            else:
                c, stats, rows = np.zeros(len(p), np.int64), np.zeros((len(p), 4)), np.flatnonzero(~apart)
                c[rows], stats[rows] = self.rows_at(self.grams, shard[rows], "2.", ctx[rows], words[-1][rows])
                rows = np.flatnonzero(apart)
                c[rows], _ = self.rows_at(self.apart, _whole_route(words[-2][rows], words[-1][rows], self.shards), "2.", ctx[rows], words[-1][rows])
                stats[rows] = self.spread_stats[at[rows]]
            p = self.raised(k, p, c, stats)
        return p, count


def _route(words: list[np.ndarray], spread: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each n-gram: by its last word but one or, where that is spread, by its last two context words."""
    last = words[-2]
    out = mix64(last.astype(np.uint64))
    apart = np.flatnonzero(_find(spread, last)[1])
    if len(apart):
        out[apart] = mix64(chain([w[apart] for w in (words[-3:-1] if len(words) > 2 else words)]) + np.uint64(1))
    return (out % np.uint64(shards)).astype(np.int64)


def _whole_route(a: np.ndarray, b: np.ndarray, shards: int) -> np.ndarray:
    return (mix64(chain([a, b]) + np.uint64(2)) % np.uint64(shards)).astype(np.int64)


def _pack_rows(words: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Rows of words with counts: a dictionary, and codes sorted by the last context word, which is told in runs."""
    columns = [words[-2], *reversed(words[:-2]), words[-1]]
    names, codes = np.unique(np.concatenate(columns), return_inverse=True)
    codes = codes.reshape(len(columns), -1)
    order = np.argsort(codes[0] * len(names) + codes[1])
    runs = np.bincount(codes[0], minlength=len(names))
    kind = np.uint32 if len(names) > 65535 else np.uint16
    return encode(_narrow(_steps(names)), _small(runs), *[c[order].astype(kind) for c in codes[1:]], _small(counts[order]))


def _unpack_rows(body: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    steps, runs, *codes, counts = decode(body)
    names = _narrow(np.cumsum(steps, dtype=np.uint64))
    columns = [np.repeat(names, runs), *[names[c] for c in codes]]
    return [*reversed(columns[1:-1]), columns[0], columns[-1]], counts


def _flushed(batches, column: int, limit: int):
    """Tokens and lengths of a task's texts, gathered to about ``limit`` tokens at a time."""
    tokens, lengths, n = [], [], 0
    for batch in batches:
        for t, k in tokens_of(batch.column(column)):
            tokens.append(t)
            lengths.append(k)
            n += len(t)
            if n >= limit:
                yield np.concatenate(tokens), np.concatenate(lengths)
                tokens, lengths, n = [], [], 0
    if n:
        yield np.concatenate(tokens), np.concatenate(lengths)


def _merged_rows(batches):
    """(shard, words, counts) of packed rows, in order of shards; the blocks of a shard follow each other, equal rows are summed
    before they grow too many."""
    shard, parts, n = None, [], 0

    def total():
        words, counts = [np.concatenate(x) for x in zip(*(p[0] for p in parts), strict=True)], np.concatenate([p[1] for p in parts])
        parts.clear()
        _, counts, at = _sum_by(chain(words), counts)
        return [w[at] for w in words], _narrow(counts)

    for batch in batches:
        for s, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if s != shard and parts:
                yield shard, *total()
                n = 0
            shard = s
            parts.append(_unpack_rows(body.as_py()))
            n += len(parts[-1][1])
            if n > 2 * SHARD_TOKENS:
                parts.append(total())
                n = len(parts[0][1]) // 2
    if parts:
        yield shard, *total()


ROW = "kind string, shard int, body binary, uri string, times array<long>"


def _row(kind: str, shard: int, body: bytes = b"", uri: str = "", times=()) -> pa.RecordBatch:
    columns = [pa.array([kind]), pa.array([shard], pa.int32()), pa.array([body], pa.binary()), pa.array([uri]), pa.array([list(map(int, times))], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ROW.split(", ")])


def train(docs: DataFrame, order: int = ORDER, shard_tokens: int = SHARD_TOKENS) -> Model:
    """docs: (text). An empty table gives a model in which every word is unknown."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "model")
    make_dir(folder)
    bounded_batches()
    docs = docs.select("text")
    bytes_read = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    word_shards = max(1, round(bytes_read / 20 / WORD_SHARD))

    def count_words(batches):
        for tokens, _ in _flushed(batches, 0, FLUSH_TOKENS):
            keys, counts = np.unique(tokens, return_counts=True)
            yield _blocks_by(word_shard(keys, word_shards), word_shards, lambda i: encode(_steps(keys[i]), _small(counts[i])))

    def merged(batches):
        """(shard, keys, counts) of blocks of (steps between keys, counts), in order of shards; a shard's blocks follow each other."""
        shard, keys, counts = None, [], []
        for batch in batches:
            for s, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if s != shard and keys:
                    yield shard, *_sum_by(np.concatenate(keys), np.concatenate(counts))[:2]
                    keys, counts = [], []
                shard = s
                k, c = decode(body.as_py())
                keys.append(np.cumsum(k, dtype=np.uint64))
                counts.append(c.astype(np.int64))
                if len(keys) == 16:
                    k, c, _ = _sum_by(np.concatenate(keys), np.concatenate(counts))
                    keys, counts = [k], [c]
        if keys:
            yield shard, *_sum_by(np.concatenate(keys), np.concatenate(counts))[:2]

    def store_words(batches):
        for shard, keys, counts in merged(batches):
            uri = f"{folder}/words-{shard}-{uuid.uuid4().hex}"
            Arrays.write(uri, {"keys": keys, "counts": _small(counts)})
            yield _figures(shard, uri, counts)

    def by_shard(rows: DataFrame, shards: int) -> DataFrame:
        """One task for about every shard, or a few shards a task where there are many."""
        tasks = max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions")), shards // 8)
        return rows.repartition(min(shards, tasks), "shard").sortWithinPartitions("shard")

    def store_seconds(batches):
        for shard, keys, counts in merged(batches):
            dense = np.zeros(int(first[shard + 1] - first[shard]), np.int64)
            dense[keys.astype(np.int64) - first[shard]] = counts
            uri = f"{folder}/seconds-{shard}-{uuid.uuid4().hex}"
            Arrays.write(uri, {"counts": _small(dense)})
            yield _figures(shard, uri, counts)

    def _figures(shard, uri, counts):
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([uri]), pa.array([len(counts)], pa.int64()), pa.array([int(counts.sum())], pa.int64()), pa.array([_times(counts).tolist()], pa.list_(pa.int64()))], ["shard", "uri", "n", "total", "times"])

    word_row = "shard int, uri string, n long, total long, times array<long>"
    stored = cut_lineage(by_shard(docs.mapInArrow(count_words, "shard int, body binary"), word_shards).mapInArrow(store_words, word_row))
    figures = stored.collect()
    total = sum(r["total"] for r in figures)
    uris = lambda rows, shards: [{r["shard"]: r["uri"] for r in rows}.get(s, "") for s in range(shards)]
    sizes = np.zeros(word_shards, np.int64)
    for r in figures:
        sizes[r["shard"]] = r["n"]
    first = np.cumsum(np.concatenate([[1], sizes]))
    words = Vocabulary(uris(figures, word_shards), first)
    none = np.zeros(0, np.uint64)
    if order == 1 or not total:
        times = np.sum([r["times"] for r in figures], axis=0).tolist() if figures else [0] * 4
        d = Discounts.of(times)
        return Model(order, words, [""] * word_shards, 0, None, [], [], none, np.zeros((0, 4)), total, total, [d], _rest(d, times, words.begin - 1, total))
    shards = max(1, -(-total // shard_tokens))
    floor = total / (2 * shards)

    def hot_words(batches):
        for b in batches:
            for shard, uri in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = np.flatnonzero(Arrays.read(uri)["counts"] > floor)
                yield pa.RecordBatch.from_arrays([pa.array(first[shard] + at)], ["word"])

    spread = none
    if shards > 1:
        hot = [r[0] for r in stored.select("shard", "uri").repartition(len(figures), "uri").mapInArrow(hot_words, "word long").collect()]
        spread = np.array(sorted([*hot, words.begin]), np.uint64)

    def count_rows(batches):
        for tokens, lengths in _flushed(batches, 0, FLUSH_TOKENS):
            distinct, back = np.unique(tokens, return_inverse=True)
            n = len(tokens)
            del tokens
            columns = columns_of(_narrow(np.append(words.find(distinct)[0], words.begin))[back], lengths, order, words.begin)
            _, counts, at = _sum_by(chain(columns), np.ones(n, np.uint8))
            columns, counts = [c[at] for c in columns], _small(counts)
            yield _blocks_by(_route(columns, spread, shards), shards, lambda i, columns=columns, counts=counts: _pack_rows([c[i] for c in columns], counts[i]))

    def sent(kind, shard, count, body):
        for b in _blocks_by(shard, count, body).to_pylist():
            yield _row(kind, b["shard"], b["body"])

    def seconds_of(c):
        keys, stands = np.unique(c, return_counts=True)
        return sent("second", np.searchsorted(first, keys.astype(np.int64), "right") - 1, word_shards, lambda i: encode(_narrow(_steps(keys[i])), _small(stands[i])))

    def store_rows(batches):
        for shard, columns, counts in _merged_rows(batches):
            arrays, times = {}, np.zeros((order + 1, 4), np.int64)
            while len(columns) > 1:
                k = len(columns)
                if k == 2:
                    apart = _find(spread, columns[0])[1]
                    a, b, some = columns[0][apart], columns[1][apart], counts[apart]
                    yield from sent("apart", _whole_route(a, b, shards), shards, lambda i, a=a, b=b, some=some: _pack_rows([a[i], b[i]], some[i]))
                    columns, counts = [c[~apart] for c in columns], counts[~apart]
                    yield from seconds_of(columns[1])
                times[k] = _times(counts)
                arrays |= table(f"{k}.", chain(columns[:-1]), columns[-1], counts)
                columns = columns[1:]
                if k > 2:
                    _, counts, at = _sum_by(chain(columns), np.ones(len(counts), np.uint8))
                    columns = [c[at] for c in columns]
            uri = f"{folder}/grams-{shard}-{uuid.uuid4().hex}"
            Arrays.write(uri, arrays)
            yield _row("grams", shard, b"", uri, times.ravel())

    def store_apart(batches):
        for shard, (a, b), counts in _merged_rows(batches):
            times = np.zeros((order + 1, 4), np.int64)
            times[2] = _times(counts)
            yield from seconds_of(b)
            uri = f"{folder}/apart-{shard}-{uuid.uuid4().hex}"
            Arrays.write(uri, table("2.", chain([a]), b, counts))
            by = np.argsort(a, kind="stable")
            keys, begin = np.unique(a[by], return_index=True)
            yield _row("rows", shard, encode(keys.astype(np.uint64), _stats_of(counts[by], begin).ravel()), uri, times.ravel())

    def add_up(batches):
        """Figures of the spread words as contexts, one block for all shards of a task."""
        keys, stats = np.zeros(0, np.uint64), np.zeros((0, 4), np.int64)
        for b in batches:
            for body in b.column(0):
                k, x = decode(body.as_py())
                keys, back = np.unique(np.concatenate([keys, k]), return_inverse=True)
                both, stats = np.concatenate([stats, x.reshape(-1, 4).astype(np.int64)]), np.zeros((len(keys), 4), np.int64)
                np.add.at(stats, back, both)
        yield pa.RecordBatch.from_arrays([pa.array([encode(keys, stats.ravel())], pa.binary())], ["body"])

    rows = cut_lineage(by_shard(docs.mapInArrow(count_rows, "shard int, body binary"), shards).mapInArrow(store_rows, ROW))
    more = cut_lineage(by_shard(rows.filter("kind = 'apart'").select("shard", "body"), shards).mapInArrow(store_apart, ROW))
    second_blocks = rows.unionByName(more).filter("kind = 'second'").select("shard", "body")
    seconds = cut_lineage(by_shard(second_blocks, word_shards).mapInArrow(store_seconds, word_row)).collect()
    stored = rows.filter("kind = 'grams'").unionByName(more.filter("kind = 'rows'")).select("kind", "shard", "uri", "times")
    context_sums = [decode(r[0]) for r in more.filter("kind = 'rows'").select("body").coalesce(8).mapInArrow(add_up, "body binary").collect()]
    spread_stats = np.zeros((len(spread), 4))
    for keys, stats in context_sums:
        spread_stats[np.searchsorted(spread, keys)] += stats.reshape(-1, 4)

    times = np.zeros((order + 1) * 4, np.int64)
    for at, n in stored.select(F.posexplode("times").alias("at", "n")).groupBy("at").agg(F.sum("n")).collect():
        times[at] = n
    times = times.reshape(-1, 4)
    stored = stored.drop("times")
    named = stored.collect() if shards <= DIRECT_SHARDS else []
    grams, apart = (uris([r for r in named if r["kind"] == k], shards) if named else [] for k in ("grams", "rows"))
    second_times = np.sum([r["times"] for r in seconds], axis=0).tolist()
    pairs, kinds = sum(r["total"] for r in seconds), sum(r["n"] for r in seconds)
    discounts = [Discounts.of(second_times), *[Discounts.of(times[k].tolist()) for k in range(2, order + 1)]]
    return Model(order, words, uris(seconds, word_shards), shards, stored, grams, apart, spread, spread_stats, total, pairs, discounts, _rest(discounts[0], second_times, kinds, pairs))


def _rest(d: Discounts, times: list[int], kinds: int, total: int) -> float:
    """Share of the lowest level that discounts set free."""
    return (d.one * times[0] + d.two * times[1] + d.more * (kinds - times[0] - times[1])) / total if total else 1.0


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _gathered(batches, keep):
    """Texts in column ``keep``, gathered to about SCORE_TOKENS tokens at a time, as (tokens, lengths, the columns before the text)."""
    waiting, n = [], 0
    for batch in batches:
        row = 0
        for tokens, lengths in tokens_of(batch.column(keep)):
            waiting.append((tokens, lengths, [batch.column(i).slice(row, len(lengths)) for i in range(keep)]))
            row += len(lengths)
            n += len(tokens)
            if n >= SCORE_TOKENS:
                yield _together(waiting)
                waiting, n = [], 0
    if waiting:
        yield _together(waiting)


def _together(waiting):
    tokens, lengths, kept = zip(*waiting, strict=True)
    return np.concatenate(tokens), np.concatenate(lengths), [pa.concat_arrays(c) for c in zip(*kept, strict=True)]


def _base_columns(m: Model, kept: list, lengths: np.ndarray, count: np.ndarray) -> list[pa.Array]:
    """The columns of SCORED before the last."""
    at = np.cumsum(lengths) - lengths
    per = lambda x: pa.array(np.add.reduceat(x, at))
    floor = m.tokens + m.vocabulary + 1
    return [*kept, pa.array(lengths, pa.int64()), per((count > 0).astype(np.int64)), pa.array(np.full(len(lengths), m.tokens, np.int64)), per(np.log10((count + 1) / floor))]


def _pack_asked(doc: np.ndarray, words: list[np.ndarray], stands: np.ndarray, pairs: np.ndarray) -> bytes:
    names, codes = np.unique(np.concatenate(words), return_inverse=True)
    kind = np.uint32 if len(names) > 65535 else np.uint16
    return encode(_steps(doc), _narrow(_steps(names)), _small(stands), _small(pairs), *codes.reshape(len(words), -1).astype(kind))


def _asked(batches):
    """(uri, documents, words, stands, pairs) of packed n-grams, those of a file after each other, about SCORE_TOKENS at most at a time."""
    last, parts, n = None, [], 0

    def whole():
        doc, stands, pairs, *words = (np.concatenate(x) for x in zip(*parts, strict=True))
        return last, doc, words, stands, pairs

    for batch in batches:
        for uri, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if parts and (uri != last or n >= SCORE_TOKENS):
                yield whole()
                parts, n = [], 0
            last = uri
            doc, names, stands, pairs, *codes = decode(body.as_py())
            names = np.cumsum(names, dtype=np.uint64)
            parts.append((np.cumsum(doc, dtype=np.uint64), stands.astype(np.int64), pairs.astype(np.int64), *[names[c] for c in codes]))
            n += len(doc)
    if parts:
        yield whole()


def _score_by_shards(rows: DataFrame, model: Model) -> DataFrame:
    """SCORED of (doc_id, held_out, text), with n-grams sent to their shards. A document's key is made of its task, a number in the task and
    its place there; it holds, as what was asked is written before it is used."""
    held = rows.sparkSession.sparkContext.broadcast(model._replace(stored=None))
    question = "kind string, shard int, body binary, doc long, " + SCORED.rsplit(", ", 1)[0]
    names = [c.split()[0] for c in question.split(", ")]

    def block(kind, b):
        n = b.num_rows
        kinds = {"kind": pa.array([kind] * n, pa.string()), "shard": b.column(0), "body": b.column(1)}
        types = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
        return pa.RecordBatch.from_arrays([kinds[c] if c in kinds else pa.nulls(n, types[t]) for c, t in (x.split() for x in question.split(", "))], names)

    def ask(batches):
        m, task = held.value, TaskContext.get().partitionId()
        for flush, (tokens, lengths, kept) in enumerate(_gathered(batches, 2)):
            distinct, back = np.unique(tokens, return_inverse=True)
            number, count, stands = m.words_at(distinct)
            n, key = len(lengths), np.arange(len(lengths), dtype=np.uint64) + np.uint64(task << 41 | flush << 21)
            of_docs = [pa.array(["doc"] * n), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(key.astype(np.int64)), *_base_columns(m, kept, lengths, count[back])]
            yield pa.RecordBatch.from_arrays(of_docs, names)
            words = columns_of(number.astype(np.uint64)[back], lengths, m.order, m.words.begin)
            stands, doc, none = stands[back], np.repeat(key, lengths), np.zeros(len(back), np.int64)
            apart = _find(m.spread, words[-2])[1]
            for kind, some in (("apart", np.flatnonzero(apart)), ("grams", np.flatnonzero(~apart))):
                if len(some):
                    w = [x[some] for x in words]
                    shard = _whole_route(w[-2], w[-1], m.shards) if kind == "apart" else _route(w, m.spread, m.shards)
                    yield block(kind, _blocks_by(shard, m.shards, lambda i, w=w, some=some: _pack_asked(doc[some[i]], [x[i] for x in w], stands[some[i]], none[: len(i)])))

    def ask_on(batches):
        """N-grams with the counts of their bigrams, sent on to their own shards."""
        m, waiting, n = held.value, [], 0

        def sent():
            doc, stands, pairs, *words = (np.concatenate(x) for x in zip(*waiting, strict=True))
            return _blocks_by(_route(words, m.spread, m.shards), m.shards, lambda i: _pack_asked(doc[i], [w[i] for w in words], stands[i], pairs[i]))

        for uri, doc, words, stands, _ in _asked(batches):
            pairs, _ = m.rows_at([uri], np.zeros(len(doc), np.int64), "2.", chain(words[-2:-1]), words[-1])
            waiting.append((doc, stands, pairs, *words))
            n += len(doc)
            if n >= SCORE_TOKENS:
                yield sent()
                waiting, n = [], 0
        if waiting:
            yield sent()

    def answer(batches):
        m = held.value
        for uri, doc, words, stands, pairs in _asked(batches):
            p, (at, apart) = m.lowest(stands), _find(m.spread, words[-2])
            for k in range(2, m.order + 1):
                c, stats = m.rows_at([uri], np.zeros(len(doc), np.int64), f"{k}.", chain(words[-k:-1]), words[-1])
                if k == 2 and apart.any():
                    c[apart], stats[apart] = pairs[apart], m.spread_stats[at[apart]]
                p = m.raised(k, p, c, stats)
            key, back = np.unique(doc, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(np.bincount(back, np.log10(p)))], ["doc", "score"])

    def with_files(asked, kind):
        """Sorted by shard, as a merge join leaves them; adaptive execution may split the rows of a shard that many ask."""
        return asked.select("shard", "body").hint("merge").join(model.stored.filter(F.col("kind") == kind).select("shard", "uri"), "shard", "left").select("uri", "body")

    asked = as_table(rows.mapInArrow(ask, question))
    on = with_files(asked.filter("kind = 'apart'"), "rows").mapInArrow(ask_on, "shard int, body binary")
    grams = with_files(asked.filter("kind = 'grams'").select("shard", "body").unionByName(on), "grams")
    sums = grams.mapInArrow(answer, "doc long, score double").groupBy("doc").agg(F.sum("score").alias("score"))
    return asked.filter("kind = 'doc'").drop("kind", "shard", "body").join(sums, "doc", "left").drop("doc")


def score_with(docs: DataFrame, model: Model, held_out) -> DataFrame:
    """One row per document: SCORED, with perplexity."""
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    if model.shards and not model.grams:
        return _score_by_shards(rows, model).withColumn("perplexity", perplexity)
    held = docs.sparkSession.sparkContext.broadcast(model._replace(stored=None))

    def of(batches):
        m = held.value
        for tokens, lengths, kept in _gathered(batches, 2):
            p, count = m.probabilities(tokens, lengths)
            score = pa.array(np.add.reduceat(np.log10(p), np.cumsum(lengths) - lengths))
            yield pa.RecordBatch.from_arrays([*_base_columns(m, kept, lengths, count), score], [c.split()[0] for c in SCORED.split(", ")])

    return rows.mapInArrow(of, SCORED).withColumn("perplexity", perplexity)


def score(docs: DataFrame, folds: int = 7, fold: int = 2, order: int = ORDER) -> DataFrame:
    """Score all documents by a model of those whose id's crc32 modulo ``folds`` isn't ``fold``. Null and empty texts are one end.
    Repeated documents count and are scored each. doc_ids are integers or their decimal text; other texts raise. Other columns of ``docs`` are not looked at."""
    held_out = remainder(F.col("doc_id"), folds) == fold
    return score_with(docs, train(docs.filter(~held_out), order), held_out)
