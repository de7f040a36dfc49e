"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

Statistics come from the text alone. The features approximate a Gaussian kernel over the standardised statistics; each of ``PARTS``
partitions of labelled rows sums its part of the normal equations, and the driver adds the parts and solves one system of
``FEATURES`` unknowns. Training takes at most ``TRAIN_ROWS`` labels, chosen by the order of a hash, so it costs the same beside any
corpus; scoring takes every text whole. Calibration pools adjacent violators over a histogram of raw scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder
from .shared import bounded_batches, cut_lineage
from .words import SPACED, blocks, mix64, words_of

FEATURES, RIDGE, WIDTH, SEED, BINS, PARTS, TRAIN_ROWS = 256, 1e-3, 0.35, 11, 2000, 8, 50_000
_MARKS = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
STATISTICS = (
    "log_bytes log_words mean_length deviation_length upper digit mark plain_mark space beyond_ascii letters "
    "distinct_words repeats_before top_word capital_words ends_in_mark same_line log_line long_words distinct_pairs"
).split()


def _class(members) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(members)] = True
    return t


_CLASSES = {
    "upper": _class(range(65, 91)), "digit": _class(range(48, 58)), "mark": _class(_MARKS), "plain_mark": _class(b".,;:?'\"()-"),
    "space": _class([32, *range(9, 14)]), "beyond_ascii": _class(range(128, 256)), "letters": _class([*range(65, 91), *range(97, 123)]),
}


def _distinct(keys: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each row, and how often its most frequent one stands."""
    both = keys + mix64(owner.astype(np.uint64) + np.uint64(1))
    _, first, counts = np.unique(both, return_index=True, return_counts=True)
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, owner[first], counts)
    return np.bincount(owner[first], minlength=rows), top


def statistics_block(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    some = np.maximum(size, 1)
    w = words_of(data, offsets, SPACED)
    owner, n = w.owner(), np.diff(w.first).astype(float)
    words = np.maximum(n, 1)
    length = (w.ends - w.starts).astype(float)
    per = lambda x: np.bincount(owner, x, rows) if len(owner) else np.zeros(rows)
    col = {"log_bytes": np.log1p(size), "log_words": np.log1p(n)}
    col["mean_length"] = per(length) / words
    col["deviation_length"] = np.sqrt(np.maximum(per(length**2) / words - col["mean_length"] ** 2, 0))
    for name, t in _CLASSES.items():
        total = np.concatenate([[0], np.cumsum(t[data])])
        col[name] = (total[offsets[1:]] - total[offsets[:-1]]) / some
    distinct, top = _distinct(w.hashes, owner, rows)
    col["distinct_words"], col["top_word"] = distinct / words, top / words
    pair, whole = w.windows(2)
    same = np.zeros(len(owner))
    if len(pair):
        same[1:] = (w.hashes[1:] == w.hashes[:-1]) & whole
    col["repeats_before"] = per(same) / words
    pairs, _ = _distinct(pair[whole], owner[: len(pair)][whole], rows)
    col["distinct_pairs"] = pairs / np.maximum(n - 1, 1)
    col["capital_words"] = per(_CLASSES["upper"][data[w.starts]].astype(float)) / words if len(owner) else np.zeros(rows)
    col["ends_in_mark"] = per(_CLASSES["mark"][data[w.ends - 1]].astype(float)) / words if len(owner) else np.zeros(rows)
    col["long_words"] = per((length > 14).astype(float)) / words
    # lines: cut at line feeds; a line's hash comes from its words
    feed = np.concatenate([[0], np.cumsum(data == 10)])
    line_of = feed[w.starts] + owner  # grows at each line feed and each text
    if len(owner):
        edge = np.flatnonzero(np.concatenate([[True], np.diff(line_of) > 0]))
        position = np.arange(len(owner)) - np.repeat(edge, np.diff(np.append(edge, len(owner))))
        hashes = np.add.reduceat(mix64(w.hashes + position.astype(np.uint64)), edge)
        lines = np.bincount(owner[edge], minlength=rows).astype(float)
        distinct_lines, _ = _distinct(hashes, owner[edge], rows)
    else:
        lines = distinct_lines = np.zeros(rows)
    col["same_line"] = 1 - distinct_lines / np.maximum(lines, 1)
    col["log_line"] = np.log1p(n / np.maximum(lines, 1))
    return np.stack([col[c] for c in STATISTICS], axis=1)


def statistics():
    """A Column function text -> array of STATISTICS; null counts as empty, an empty text's are zero but for same_line (1)."""

    def of(texts: pa.Array) -> pa.Array:
        parts = [statistics_block(data, offsets) for _, _, data, offsets in blocks(texts)]
        x = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(STATISTICS), pa.int32()), pa.array(x.astype(np.float32).ravel(), pa.float32()))

    bounded_batches()
    return F.arrow_udf(of, "array<float>")


class Model:
    """Standardisation, projection, weights and calibration; a few hundred kB."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int = FEATURES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, 1 / np.maximum(deviation, 1e-6)
        self.direction = rng.normal(0, WIDTH / np.sqrt(len(mean) / 4), (len(mean), features))
        self.phase = rng.uniform(0, 2 * np.pi, features)
        self.weights, self.steps = np.zeros(features + 1), (np.array([0.0]), np.array([0.5]))

    def project(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) * self.scale, -6, 6)
        z = np.cos(z @ self.direction + self.phase) * np.sqrt(2 / len(self.phase))
        return np.concatenate([z, np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.project(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.round(np.clip(np.interp(self.raw(x), *self.steps), 0, 1), 6)


def _rows(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS)).astype(float)


def pool(n: np.ndarray, total: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (centres, non-decreasing means) of groups given by weight, label sum and position."""
    out: list[list[float]] = []
    for w, s, x in zip(n.tolist(), total.tolist(), (at * n).tolist(), strict=True):
        out.append([w, s, x])
        while len(out) > 1 and out[-2][1] * out[-1][0] >= out[-1][1] * out[-2][0]:
            w, s, x = out.pop()
            out[-1] = [out[-1][0] + w, out[-1][1] + s, out[-1][2] + x]
    a = np.array(out)
    return a[:, 2] / a[:, 0], a[:, 1] / a[:, 0]


def fit(labelled: DataFrame, ridge: float = RIDGE) -> Model:
    """labelled: (x: array of STATISTICS, y: 0 or 1). Without rows, every score is one half."""
    p = len(STATISTICS)
    moments = labelled.agg(F.count("*"), *[F.avg(F.col("x")[i].cast("double")) for i in range(p)], *[F.stddev_pop(F.col("x")[i].cast("double")) for i in range(p)]).first()
    model = Model(np.array([m or 0.0 for m in moments[1 : p + 1]]), np.array([m or 0.0 for m in moments[p + 1 :]]))
    if not moments[0]:
        return model
    dim = len(model.weights)

    def partial(batches):
        a, n = np.zeros((dim, dim + 1)), 0
        for b in batches:
            if b.num_rows:
                z, y = model.project(_rows(b.column(0))), b.column(1).to_numpy().astype(float)
                a += z.T @ np.concatenate([z, y[:, None]], axis=1)
                n += b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary())], ["a"])

    sums = labelled.select("x", F.col("y").cast("int").alias("y")).coalesce(PARTS).mapInArrow(partial, "a binary").collect()
    a = sum(np.frombuffer(r[0]) for r in sums).reshape(dim, dim + 1)
    penalty = np.full(dim, ridge * moments[0])
    penalty[-1] = 0
    model.weights = np.linalg.solve(a[:, :dim] + np.diag(penalty + 1e-9), a[:, dim])

    def bins(batches):
        for b in batches:
            at = np.clip(((model.raw(_rows(b.column(0))) + 1) / 3 * BINS).astype(np.int32), 0, BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), b.column(1)], ["bin", "y"])

    hist = labelled.select("x", F.col("y").cast("int").alias("y")).mapInArrow(bins, "bin int, y int").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
    rows = np.array(sorted(tuple(r) for r in hist.collect()), float)
    model.steps = pool(rows[:, 1], rows[:, 2], (rows[:, 0] + 0.5) / BINS * 3 - 1)
    return model


def scorer(model: Model):
    """A Column function statistics -> score."""
    return F.arrow_udf(lambda x: pa.array(model.score(_rows(x)), pa.float64()), "double")


def chosen(labels: DataFrame, rows: int = TRAIN_ROWS, folds: int = 5) -> DataFrame:
    """(_id, y): at most ``rows`` labels, by the order of a hash, whose id's crc32 modulo ``folds`` isn't 0. Null labels and ids are
    left out; a row with several labels counts once for each."""
    known = labels.filter("quality is not null and doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("quality").alias("y"))
    return known.filter(remainder(F.col("_id"), folds) != 0).orderBy(F.xxhash64("_id", F.lit(5)), "_id", "y").limit(rows)


def train(features: DataFrame, labels: DataFrame, **options) -> Model:
    """Fit on rows of features (doc_id, x) with one of the ``chosen`` labels, which are few enough to broadcast."""
    known = chosen(labels, **options)
    return fit(cut_lineage(features.join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select("x", "y")))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score >= 0.3). Other columns of ``docs`` are not looked at."""
    features = cut_lineage(docs.select("doc_id", statistics()(F.col("text")).alias("x")))
    model = train(features, labels)
    out = features.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), scorer(model)(F.col("x")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``docs`` without those that score under ``threshold``; statistics are computed where the texts lie, for training only those of
    the chosen labels. A row with a null or repeated doc_id is scored by its text like any other."""
    known = chosen(labels)
    some = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id"))
    model = fit(cut_lineage(some.select(statistics()(F.col("text")).alias("x"), "y")))
    return docs.filter(scorer(model)(statistics()(F.col("text"))) >= threshold)
