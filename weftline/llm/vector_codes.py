"""Vector code compression: product quantisation in whole numbers, entries found by slice-and-intersect bitmasks.

Vectors are cut into equal parts, and a codebook for each part position is refined by rounds of assignment and averaging. For every
dimension of a part the entries' coordinates are kept sorted, each rank with the mask of the entries before it. A first guess, the
entry beside the part in the dimension that spreads most, gives a radius that the nearest entry can't exceed. It selects a range of
ranks in each dimension; the exclusive or of two prefix masks is the range's entries, and the AND over all dimensions leaves every
entry within the radius, ties included. Only these are measured.

A round sends the sums of each task, whose size is that of the codebooks, through one aggregate. The codebooks (entries times width
whole numbers) are the only thing that the driver holds.

Rows whose vector is null or holds null or non-finite components are left out. Vectors shorter than the longest, or than a multiple
of the parts, count as ending in zeros. Scaled components beyond +-2^26 count as that. Equal ids are told apart by their vectors;
null ids come last. Fewer rows than entries give as many entries as there are rows. No rows give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import as_table
from .vectors import integers, matrix, products

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows that are measured at a time.
BLOCK = 1024


class Slices:
    """One part's codebook, searchable: for each dimension sorted coordinates, and before each rank the mask of the entries below."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n, width = entries.shape
        self.order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, self.order, axis=0)
        words = -(-n // 64)
        self.masks = np.zeros((width, n + 1, words), np.uint64)
        for d in range(width):
            one = np.zeros((n, words), np.uint64)
            one[np.arange(n), self.order[:, d] // 64] = np.uint64(1) << (self.order[:, d] % 64).astype(np.uint64)
            self.masks[d, 1:] = np.bitwise_or.accumulate(one, axis=0)
        self.widest = int(np.argmax(self.sorted[-1] - self.sorted[0]))

    def guess(self, x: np.ndarray) -> np.ndarray:
        d = self.widest
        return self.order[np.minimum(np.searchsorted(self.sorted[:, d], x[:, d]), len(self.entries) - 1), d]

    def within(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """For each row the mask of the entries no further than its radius in any dimension."""
        out = np.full((len(x), self.masks.shape[2]), ~np.uint64(0))
        for d in range(x.shape[1]):
            low = np.searchsorted(self.sorted[:, d], x[:, d] - radius, "left")
            high = np.searchsorted(self.sorted[:, d], x[:, d] + radius, "right")
            out &= self.masks[d][high] ^ self.masks[d][low]
        return out

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row's nearest entry, the lower index of several."""
        best, dist = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        for a in range(0, len(x), BLOCK):
            best[a : a + BLOCK], dist[a : a + BLOCK] = self._nearest(x[a : a + BLOCK])
        return best, dist

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = ((x - self.entries[self.guess(x)]) ** 2).sum(1)
        masks = self.within(x, np.sqrt(first.astype(np.float64)).astype(np.int64) + 1)
        inside = np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little")[:, : len(self.entries)].astype(bool)
        far = np.iinfo(np.int64).max
        dist = np.full(inside.shape, far)
        if inside.mean() > 0.2:
            all_of = (x * x).sum(1)[:, None] + (self.entries * self.entries).sum(1) - 2 * products(x, self.entries)
            dist[inside] = all_of[inside]
        else:
            row, entry = np.nonzero(inside)
            dist[row, entry] = ((x[row] - self.entries[entry]) ** 2).sum(1)
        best = dist.argmin(1)
        return best, dist[np.arange(len(x)), best]


def _parts(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return [np.ascontiguousarray(p) for p in np.split(x, parts, axis=1)]


def _sums(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """(part, entry, 1 + width): for each entry the number of its parts, then their sums, in one aggregate."""
    parts, entries, width = books.shape

    def partial(batches):
        index, total = [Slices(b) for b in books], np.zeros((parts, entries, 1 + width), np.int64)
        for batch in batches:
            for p, x in enumerate(_parts(matrix(batch.column(0), parts * width), parts)):
                code, _ = index[p].nearest(x)
                np.add.at(total[p], code, np.concatenate([np.ones((len(x), 1), np.int64), x], axis=1))
        used = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total.ravel()[used], pa.int64())], ["at", "v"])

    out = np.zeros(books.size + parts * entries, np.int64)
    for at, v in kept.select("x").mapInArrow(partial, "at long, v long").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[at] = v
    return out.reshape(parts, entries, 1 + width)


def _table_of(rows: DataFrame, scale: int, vector: str, vec_id: str, label: str) -> tuple[DataFrame, int]:
    kept = as_table(integers(rows, scale, vector, vec_id=vec_id, label=label))
    return kept, kept.agg(F.max(F.size("x"))).first()[0] or 1


def codebooks(kept: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """kept (vec_id, x) -> (part, entry, position): the codebooks after all rounds."""
    width = -(-width // parts)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    books = np.zeros((len(first), parts * width), np.int64)
    for i, (x,) in enumerate(first):
        books[i, : len(x)] = x
    books = np.stack(_parts(books, parts))
    for _ in range(rounds if len(first) else 0):
        got = _sums(kept, books)
        n = got[:, :, :1]
        books = np.where(n > 0, got[:, :, 1:] // np.maximum(n, 1), books)
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def codes(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """kept (vec_id, label, x) -> (vec_id, label, code, error): two hex digits of an entry's index for each part."""
    parts, entries, width = books.shape
    digits = max(2, len(f"{max(entries - 1, 0):x}"))
    schema = kept.select("vec_id", "label").schema.add("code", "string").add("error", "long")

    def assign(batches):
        index = [Slices(b) for b in books]
        for batch in batches:
            found = [index[p].nearest(x) for p, x in enumerate(_parts(matrix(batch.column(2), parts * width), parts))]
            text = ["".join(f"{c:0{digits}x}" for c in row) for row in np.stack([f[0] for f in found], 1).tolist()]
            error = np.sum([f[1] for f in found], axis=0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return kept.select("vec_id", "label", "x").mapInArrow(assign, schema)


def compress(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row per kept row: vec_id, code, error, label_error, codebooks_sha256."""
    kept, width = _table_of(rows, scale, vector, vec_id, label)
    books = codebooks(kept, width, parts, entries, rounds)
    coded = as_table(codes(kept, books)) if books.shape[1] else kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    by_label = as_table(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def decode(code: Column, books: np.ndarray, scale: int = SCALE) -> Column:
    """The vector that a code stands for; each component is the middle of its floor's interval."""
    digits = max(2, len(f"{max(books.shape[1] - 1, 0):x}"))
    tables = [F.array(*[F.array(*[F.lit((v + 0.5) / scale) for v in entry]) for entry in book.tolist()]) for book in books]
    return F.concat(*[F.element_at(t, F.conv(F.substring(code, 1 + p * digits, digits), 16, 10).cast("int") + 1) for p, t in enumerate(tables)])
