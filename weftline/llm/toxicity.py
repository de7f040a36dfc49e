"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence's probability is a logistic function of its words and of their first bytes (inflected forms share those); a document is
toxic unless every sentence is clean (noisy-or). Both are hashed into buckets. A first pass over the training documents counts buckets by label and keeps the most telling; then
full-batch gradient steps on the documents' likelihood, each a Spark job that sums over partitions. Training takes at most
``TRAIN_ROWS`` labelled rows, chosen by the order of a hash; scoring takes every text whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder
from .shared import bounded_batches, cut_lineage
from .words import ALNUM, blocks, words_of

BUCKETS, KEPT, TRAIN_ROWS, PARTS, STEPS, RATE, PENALTY, CLEAR = 1 << 18, 4096, 20_000, 8, 60, 0.25, 1e-5, 5.0
#: Lengths of word beginnings that are features beside the whole word.
PREFIXES = (4, 5, 6)
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?\n")] = True
RESULT = "struct<score:double,n_sentences:int,n_toxic:int,worst:int,worst_score:double,worst_start:bigint,worst_end:bigint>"


def sentences_block(data: np.ndarray, offsets: np.ndarray):
    """Features of a block as (bucket of each, first feature of each sentence, text of each sentence, its first and last byte)."""
    w = words_of(data, offsets, ALNUM)
    owner = w.owner()
    stops = np.concatenate([[0], np.cumsum(_ENDS[data])])
    place = stops[w.starts] + owner
    edge = np.flatnonzero(np.concatenate([[True], np.diff(place) > 0])) if len(owner) else np.zeros(0, np.int64)
    last = np.append(edge[1:], len(owner))[: len(edge)] - 1
    features = np.stack([w.hashes, *[w.prefixes(n) for n in PREFIXES]], axis=1).ravel()
    return (features >> np.uint64(46)).astype(np.int64), edge * (len(PREFIXES) + 1), owner[edge], w.starts[edge] - offsets[owner[edge]], w.ends[last] - offsets[owner[edge]]


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias

    def block(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        rows = len(offsets) - 1
        bucket, edge, owner, begin, end = sentences_block(data, offsets)
        logit = self.bias + (np.add.reduceat(self.weights[bucket], edge) if len(edge) else np.zeros(0))
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        clean = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), rows)
        order = np.lexsort((-np.arange(len(p)), p, owner))  # a text's last has its highest score, the first of equals
        worst = np.full(rows, -1)
        worst[owner[order]] = order
        has, first = worst >= 0, np.searchsorted(owner, np.arange(rows))
        pick = lambda x: np.where(has, x[worst], -1) if len(x) else np.full(rows, -1)
        return {
            "score": np.round(1 - np.exp(clean), 6), "n_sentences": np.bincount(owner, minlength=rows), "n_toxic": np.bincount(owner[p >= 0.5], minlength=rows),
            "worst": np.where(has, worst - first, -1), "worst_score": np.round(np.where(has, pick(p), 0), 6), "worst_start": pick(begin), "worst_end": pick(end),
        }


def gradient_of(y: np.ndarray, empty: np.ndarray, pairs: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    """Gradient of the documents' log likelihood by weights and bias. ``empty`` sentences of each have no telling word; ``pairs``
    are the (sentence, word) numbers of the others, as 32-bit integers."""
    text = np.repeat(np.arange(len(y)), [len(r) // 8 for r in pairs])
    both = np.frombuffer(b"".join(pairs), np.int32).reshape(-1, 2)
    _, at = np.unique(text * (1 << 32) + both[:, 0], return_inverse=True)
    n = at.max() + 1 if len(at) else 0
    owner = np.zeros(n, np.int64)
    owner[at] = text
    p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(at, weights[both[:, 1]], n), -30, 30)))
    rest = 1 / (1 + np.exp(-bias))
    clean = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y)) + empty * np.log1p(-rest)
    toxic = np.maximum(1 - np.exp(clean), 1e-9)
    pull = np.where(y, (1 - toxic) / toxic, -1.0)
    return np.append(np.bincount(both[:, 1], (p * pull[owner])[at], len(weights)), (p * pull[owner]).sum() + (empty * rest * pull).sum())


def _set(batches, fit_rows):
    for b in batches:
        y = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for row, stop, data, offsets in blocks(b.column(0)):
            bucket, edge, owner, _, _ = sentences_block(data, offsets)
            fit_rows(y[row:stop], bucket, edge, owner)


def fit(labelled: DataFrame) -> Model:
    """labelled: (text, y), at most TRAIN_ROWS rows, checkpointed. Without toxic rows every score is near zero.

    A bucket is telling if the share of toxic documents that have it lies ``CLEAR`` deviations above that of clean ones, so that rare
    words of one or two documents explain nothing. Weights are penalised little, since many telling words never stand in clean text.
    The rows are bounded, so few partitions take them, and as many partial sums reach the driver at any size of input.
    """
    labelled = labelled.coalesce(PARTS)

    def counts(batches):
        n = np.zeros((2, BUCKETS), np.int32)
        total = np.zeros(3, np.int64)

        def add(y, bucket, edge, owner):
            text = np.repeat(owner, np.diff(np.append(edge, len(bucket)))) if len(edge) else np.zeros(0, np.int64)
            both = np.unique(text * BUCKETS + bucket)
            for label in (0, 1):
                n[label] += np.bincount(both[y[both // BUCKETS] == label] % BUCKETS, minlength=BUCKETS).astype(np.int32)
                total[label] += (y == label).sum()
            total[2] += len(edge)

        _set(batches, add)
        yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()], pa.binary()), pa.array([total.tobytes()], pa.binary())], ["n", "total"])

    n, total = np.zeros((2, BUCKETS)), np.zeros(3)
    for r in labelled.mapInArrow(counts, "n binary, total binary").collect():
        n += np.frombuffer(r[0], np.int32).reshape(2, -1)
        total += np.frombuffer(r[1], np.int64)
    if not total[1] or not total[0]:
        return Model(np.zeros(BUCKETS), -8.0 if not total[1] else 8.0)
    odds = np.log((n[1] + 0.1) / (total[1] + 0.2)) - np.log((n[0] + 0.1) / (total[0] + 0.2))
    share = (n[0] + n[1]) / (total[0] + total[1])
    z = (n[1] / total[1] - n[0] / total[0]) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / total[0] + 1 / total[1]))
    telling = np.argsort(-z)[:KEPT]
    telling = np.sort(telling[(z[telling] > CLEAR) & (n[1][telling] >= 3)])
    index = np.full(BUCKETS, -1)
    index[telling] = np.arange(len(telling))

    def gather(batches):
        """Each text as its label, its number of sentences without telling words, and (sentence, word) pairs of the others."""
        for b in batches:
            y, empty, pairs = [], [], []

            def add(labels, bucket, edge, owner, y=y, empty=empty, pairs=pairs):
                sentence = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(bucket)))) if len(edge) else np.zeros(0, np.int64)
                kept = index[bucket] >= 0
                s, k = sentence[kept], index[bucket[kept]]
                used = np.unique(s)
                y.extend(labels.tolist())
                empty.extend((np.bincount(owner, minlength=len(labels)) - np.bincount(owner[used], minlength=len(labels))).tolist())
                cut = np.searchsorted(owner[s], np.arange(len(labels) + 1))
                both = np.stack([s, k], axis=1).astype(np.int32)
                pairs.extend(both[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True))

            _set([b], add)
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(empty, pa.int32()), pa.array(pairs, pa.binary())], ["y", "empty", "pairs"])

    bags = cut_lineage(labelled.mapInArrow(gather, "y int, empty int, pairs binary"))
    weights, bias = np.clip(odds[telling], 0, 6) * 0.5, -6.0
    first = second = np.zeros(len(telling) + 1)
    for step in range(1, STEPS + 1):

        def gradient(batches, weights=weights, bias=bias):
            out = np.zeros(len(weights) + 1)
            for b in batches:
                out += gradient_of(b.column(0).to_numpy().astype(bool), b.column(1).to_numpy(), b.column(2).to_pylist(), weights, bias)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["g"])

        g = sum(np.frombuffer(r[0]) for r in sorted(bags.mapInArrow(gradient, "g binary").collect())) / (total[0] + total[1])
        g[:-1] -= PENALTY * weights
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        weights, bias = weights + move[:-1], bias + move[-1]
    table = np.zeros(BUCKETS)
    table[telling] = weights
    return Model(table, bias)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, folds: int = 5) -> Model:
    """Fit on at most ``rows`` labels whose id's crc32 modulo ``folds`` isn't 0. Null labels are left out. The chosen labels are
    few enough to broadcast, so no text is shuffled to find its label."""
    bounded_batches()
    known = labels.filter("toxic is not null and doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("toxic").alias("y"))
    known = known.filter(remainder(F.col("_id"), folds) != 0).orderBy(F.xxhash64("_id", F.lit(5)), "_id", "y").limit(rows)
    some = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id"))
    return fit(cut_lineage(some.select("text", F.col("y").cast("int").alias("y"))))


def scorer(model: Model):
    """A Column function text -> RESULT: the score, and where the most offending sentence lies (its number and byte range)."""
    held = model

    def of(texts: pa.Array) -> pa.Array:
        parts = [held.block(data, offsets) for _, _, data, offsets in blocks(texts)]
        names = {"score": pa.float64(), "n_sentences": pa.int32(), "n_toxic": pa.int32(), "worst": pa.int32(), "worst_score": pa.float64(), "worst_start": pa.int64(), "worst_end": pa.int64()}
        columns = [pa.array(np.concatenate([p[c] for p in parts]) if parts else [], t) for c, t in names.items()]
        return pa.StructArray.from_arrays(columns, list(names))

    return F.arrow_udf(of, RESULT)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score >= 0.5), and its sentences' facts. A text without words
    has no sentence and scores 0. Other columns of ``docs`` are not looked at."""
    model = train(docs, labels)
    out = docs.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), scorer(model)(F.col("text")).alias("r"))
    return out.select("doc_id", "held_out", "r.score", (F.col("r.score") >= 0.5).cast("int").alias("predicted"), "r.n_sentences", "r.n_toxic", "r.worst", "r.worst_score", "r.worst_start", "r.worst_end")
