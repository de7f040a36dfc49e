"""Hard negatives by segment summary filtering.

A vector is cut into segments, of which the mean and the deviation (length of what is left after the mean) are kept, at several
grains. Over one segment the inner product of two vectors lies between the product of the means, times the segment's length, minus
and plus the product of the deviations, so both bounds on a score are sums of inner products of summaries. Coarse bounds are taken
first; only pairs that may still be among an anchor's best go on to finer segments, and what is left is scored exactly.

Anchors are a written table. A task holds the rows of its partition and reads the anchors in blocks from the shared folder; for each
anchor it keeps its best rows, so what is shuffled is a few rows for each anchor and task, and the best of these are the result.
First the positives are found, then, for all windows of scores that they open, the negatives.

Rows without a label, or with a vector that is null or holds null or non-finite components, take no part. Shorter vectors count as
ending in zeros. Scaled components beyond +-2^26 count as that. Rows with an anchor's id are no partners of it; other repeated rows
each count. Equal scores are ordered by id, null ids last. No rows, or no anchors, give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import as_table, open_fs, shared_dir
from .vectors import integers, matrix, products

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 3, 50, 95, 256
#: Segments at each grain, anchors and rows of a block, and rows of a partition.
GRAINS, ANCHORS, ROWS, PART = (1, 4, 16), 256, 8192, 131_072
#: A finer grain is taken for pairs one by one if no more than this part of them is left; else all are scored at once.
SPARSE = 0.25


class Summaries:
    """Rows of integers with the means and deviations of their segments at every grain."""

    def __init__(self, x: np.ndarray):
        self.x = x.astype(np.float64)
        self.exact = x
        self.norm = np.sqrt((self.x**2).sum(1))
        self.means, self.devs = [], []
        for n in GRAINS:
            parts = self.x.reshape(len(x), n, -1)
            mean = parts.mean(2)
            self.means.append(mean * np.sqrt(parts.shape[2]))
            self.devs.append(np.sqrt(((parts - mean[:, :, None]) ** 2).sum(2)))

    def __getitem__(self, which) -> Summaries:
        out = object.__new__(Summaries)
        out.x, out.exact, out.norm = self.x[which], self.exact[which], self.norm[which]
        out.means, out.devs = [m[which] for m in self.means], [d[which] for d in self.devs]
        return out


def bounds(a: Summaries, b: Summaries, grain: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of every row of ``a`` with every row of ``b``, with room for rounding."""
    middle, spread = a.means[grain] @ b.means[grain].T, a.devs[grain] @ b.devs[grain].T
    spread += 1e-9 * np.outer(a.norm, b.norm) + 1e-3
    return middle - spread, middle + spread


def pair_bounds(a: Summaries, b: Summaries, i: np.ndarray, j: np.ndarray, grain: int) -> tuple[np.ndarray, np.ndarray]:
    middle = np.einsum("ij,ij->i", a.means[grain][i], b.means[grain][j])
    spread = np.einsum("ij,ij->i", a.devs[grain][i], b.devs[grain][j]) + 1e-9 * a.norm[i] * b.norm[j] + 1e-3
    return middle - spread, middle + spread


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; minus infinity where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def _survivors(anchors: Summaries, rows: Summaries, allowed: np.ndarray, windows: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all allowed pairs that may be among the k best of their anchor in one of its windows.

    A window is a pair of arrays, the least and the largest score for each anchor. Rows that are surely inside raise the least score
    that still counts to the k-th best of their lower bounds.
    """
    low, high = bounds(anchors, rows, 0)
    keep, floors = np.zeros_like(allowed), []
    for least, most in windows:
        sure = allowed & (high <= most[:, None]) & (low >= least[:, None])
        floor = np.maximum(least, _kth(np.where(sure, low, -np.inf), k))
        floors.append(floor)
        keep |= (high >= floor[:, None]) & (low <= most[:, None])
    keep &= allowed
    total, grain = max(int(allowed.sum()), 1), 1
    if keep.sum() > SPARSE * total:
        low, high = bounds(anchors, rows, 1)
        finer = np.zeros_like(keep)
        for floor, (_, most) in zip(floors, windows, strict=True):
            finer |= (high >= floor[:, None]) & (low <= most[:, None])
        keep, grain = keep & finer, 2
    i, j = np.nonzero(keep)
    if len(i) > SPARSE * keep.size:
        return i, j, products(anchors.exact, rows.exact)[i, j]
    for g in range(grain, len(GRAINS)):
        low, high = pair_bounds(anchors, rows, i, j, g)
        stay = np.zeros(len(i), bool)
        for floor, (_, most) in zip(floors, windows, strict=True):
            stay |= (high >= floor[i]) & (low <= most[i])
        i, j = i[stay], j[stay]
    return i, j, np.einsum("ij,ij->i", anchors.exact[i], rows.exact[j])


def _best(i: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows of each anchor i: higher scores, then smaller ids."""
    order = np.lexsort((ids, -score, i))
    group = i[order]
    start = np.searchsorted(group, group)
    return order[np.arange(len(order)) - start < k]


def _anchor_blocks(path: str, width: int, columns: list[str]):
    where, root = open_fs(path)
    for f in sorted(where.get_file_info(fs.FileSelector(root)), key=lambda f: f.path):
        if f.path.endswith(".parquet"):
            with where.open_input_file(f.path) as src:
                for batch in pq.ParquetFile(src).iter_batches(ANCHORS, columns=columns):
                    if batch.num_rows:
                        yield batch, Summaries(matrix(batch.column(2), width))


_NO_ID = np.iinfo(np.int64).max


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _scan(rows: DataFrame, path: str, width: int, k: int, low: int | None = None, high: int | None = None) -> DataFrame:
    """(anchor, slot, score, vec_id): for each anchor and slot the k best rows of every partition. Without percentages the rows are
    those of the anchor's label and the only slot is 0; with them they are of other labels, and slot s is the window that the
    anchor's s-th positive opens."""

    def run(batches):
        got = [(_ids(b.column(0)), b.column(1).to_numpy(zero_copy_only=False), matrix(b.column(2), width)) for b in batches if b.num_rows]
        if not got:
            return
        ids, labels, x = (np.concatenate(c) for c in zip(*got, strict=True))
        blocks = [(ids[s : s + ROWS], labels[s : s + ROWS], Summaries(x[s : s + ROWS])) for s in range(0, len(ids), ROWS)]
        for batch, anchors in _anchor_blocks(path, width, ["anchor", "label", "x", "vec_id"] + (["scores"] if high is not None else [])):
            of, label, own = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), _ids(batch.column(3))
            n = len(of)
            if high is None:
                windows = [(np.full(n, -np.inf), np.full(n, np.inf))]
            else:
                lists = batch.column(4)
                slots = int(np.diff(lists.offsets.to_numpy()).max(initial=0))
                scores, there = matrix(lists, slots), np.arange(slots) < np.diff(lists.offsets.to_numpy())[:, None]
                windows = [(np.where(there[:, s], -(-low * scores[:, s] // 100), np.inf), np.where(there[:, s], high * scores[:, s] // 100, -np.inf)) for s in range(slots)]
            held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
            for row_ids, row_labels, block in blocks:
                same = label[:, None] == row_labels
                allowed = (same if high is None else ~same) & (own[:, None] != row_ids)
                i, j, score = _survivors(anchors, block, allowed, windows, k)
                for s, (least, most) in enumerate(windows):
                    inside = (score >= least[i]) & (score <= most[i])
                    a, v, c = (np.concatenate([h, new[inside]]) for h, new in zip(held[s], (i, row_ids[j], score), strict=True))
                    best = _best(a, v, c, k)
                    held[s] = a[best], v[best], c[best]
                    if len(best):  # what is held already raises the least score of later blocks
                        full = np.bincount(a[best], minlength=n) >= k
                        worst = np.full(n, np.inf)
                        np.minimum.at(worst, a[best], c[best])
                        windows[s] = np.where(full, np.maximum(least, worst), least), most
            for s, (a, v, c) in enumerate(held):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(of[a], pa.int64()), pa.array(np.full(len(a), s), pa.int32()), pa.array(c, pa.int64()), pa.array(v, pa.int64(), mask=v == _NO_ID)], ["anchor", "slot", "score", "vec_id"])

    return rows.select("vec_id", "label", "x").mapInArrow(run, "anchor long, slot int, score long, vec_id long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: Column, label: Column, vec_id: str = "vec_id", vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """For every anchor (rows where ``anchors`` holds) and each of its best ``positives`` rows of the same label, the best
    ``negatives`` rows of another label whose score is from ``low`` to ``high`` percent of the positive's: anchor_id, positive_id,
    rank, negative_id, positive_score, negative_score."""
    spark = rows.sparkSession
    ready = integers(rows.filter(label.isNotNull()), scale, vector, vec_id=vec_id, label=label.cast("long"), is_anchor=F.coalesce(anchors, F.lit(False)))
    ready = as_table(ready)
    n, longest = ready.agg(F.count("*"), F.max(F.size("x"))).first()
    width = -(-max(longest or 1, 1) // GRAINS[-1]) * GRAINS[-1]
    parts = max(-(-n // PART), min(2 * spark.sparkContext.defaultParallelism, -(-n // 2048)), 1)
    path, again = shared_dir(spark, "anchors"), shared_dir(spark, "anchors")
    ready.filter("is_anchor").select(F.monotonically_increasing_id().alias("anchor"), "vec_id", "label", "x").write.parquet(path)
    anchor_rows = spark.read.parquet(path)
    dealt = ready.repartition(parts)
    found = as_table(_ranked(_scan(dealt, path, width, positives), positives))
    lists = found.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda s: s["score"]).alias("scores"))
    anchor_rows.join(lists, "anchor").write.parquet(again)
    hard = _ranked(_scan(dealt, again, width, negatives, low, high), negatives)
    hard = hard.select("anchor", (F.col("slot") + 1).alias("place"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    chosen = found.select("anchor", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = anchor_rows.select("anchor", F.col("vec_id").alias("anchor_id"))
    return hard.join(chosen, ["anchor", "place"]).join(named, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
