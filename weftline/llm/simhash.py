"""SimHash near-duplicates by a generalised pigeonhole search.

Two fingerprints that differ in at most T bits must, for thresholds t_1..t_m with sum (t_i + 1) = T + 1, differ in at most t_i bits
of some part i of the 64 bits. Correlated bits are put into the same part; the number of parts and the unequal thresholds come
from a dynamic program over estimated costs: rows that a part's probes emit and pairs that its buckets hold. Both estimates follow from the
agreement of every bit over all fingerprints. Every distinct fingerprint is emitted once for each bit pattern within a part's
threshold; fingerprints meet in buckets (part, masked bits); each bucket verifies true distances and emits a spanning forest of
its links, never all pairs. Buckets above ``BUCKET`` members are cut into chunks, and each pair of chunks is a task of its own.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, row_again, whole_row
from .graph import components
from .shared import as_table, bounded_batches, cut_lineage
from .words import SPACED, blocks, words_of

SHINGLE, BITS, DISTANCE, SEED, BUCKET = 4, 64, 4, 42, 2048
#: Seconds for a row through the shuffle and for a distance between two fingerprints, for the estimate of costs.
ROW_S, PAIR_S = 3e-6, 3e-9


def fingerprint_block(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprints (uint64) of a block of texts."""
    from xxhash import xxh64_intdigest

    w = words_of(data, offsets, SPACED, hashed=False)
    n_words, rows = np.diff(w.first), len(offsets) - 1
    keep = SPACED[1][data]
    inner = np.ones(len(w.starts), bool)
    inner[w.first[1:][n_words > 0] - 1] = False
    gaps = w.ends[inner]
    keep[gaps] = True
    w.folded[gaps] = 0x20
    place = np.cumsum(keep)
    begin, end = place[w.starts] - 1, place[w.ends - 1]
    raw = w.folded[keep].tobytes()
    count = np.where(n_words == 0, 0, np.maximum(n_words - shingle + 1, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(first[-1]) - np.repeat(first[:-1], count) + np.repeat(w.first[:-1], count)
    last = np.minimum(at + shingle - 1, np.repeat(w.first[1:], count) - 1)
    hashes = np.fromiter((xxh64_intdigest(raw[a:b], SEED) for a, b in zip(begin[at].tolist(), end[last].tolist(), strict=True)), np.uint64, len(at))
    out = np.zeros(rows, np.uint64)
    full = np.flatnonzero(count)
    if len(full):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, first[full], axis=0, dtype=np.int64)
        out[full] = np.packbits(ones * 2 > count[full, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprint(shingle: int = SHINGLE):
    """A Column function text -> fingerprint as a signed long. Null and wordless texts have fingerprint zero."""

    def of(texts: pa.Array) -> pa.Array:
        parts = [fingerprint_block(data, offsets, shingle) for _, _, data, offsets in blocks(texts)]
        return pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64), pa.int64())

    bounded_batches()
    return F.arrow_udf(of, "long")


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints (column fp), and how many of them have bits i and j both set, over all rows."""

    def partial(batches):
        n, total = 0, np.zeros((BITS, BITS), np.int64)
        for b in batches:
            bits = np.unpackbits(np.ascontiguousarray(b.column(0).to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n, total = n + len(bits), total + (bits.T @ bits).astype(np.int64)
        at = np.arange(BITS * BITS)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, BITS * BITS), pa.int32()), pa.array(np.append(total.ravel(), n), pa.int64())], ["at", "n"])

    rows = prints.select("fp").mapInArrow(partial, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS + 1, np.int64)
    for at, n in rows:
        out[at] = n
    return int(out[-1]), out[:-1].reshape(BITS, BITS)


def group_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of near equal size, correlated bits together."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tie = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    left, out = set(range(BITS)), []
    for k in range(parts):
        size = (BITS - sum(map(len, out))) // (parts - k)
        group = [max(left, key=lambda b: (tie[b, list(left)].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            b = max(left, key=lambda b: (tie[b, group].sum(), -b))
            group.append(b)
            left.remove(b)
        out.append(sorted(group))
    return out


def allocate(both: np.ndarray, n: int, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part that is probed, of the cheapest split of the pigeonhole budget."""
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    best: tuple[float, list] = (np.inf, [])
    for m in range(1, distance + 2):
        groups = group_bits(both, n, m)
        table = [(0.0, [])] + [(np.inf, [])] * (distance + 1)
        for g in groups:
            chance = np.zeros(distance + 2)
            chance[0] = 1
            for b in g:
                chance[1:] = chance[1:] * (1 - differ[b]) + chance[:-1] * differ[b]
                chance[0] *= 1 - differ[b]
            new = list(table)
            for used, (cost, chosen) in enumerate(table):
                for t in range(distance + 1 - used):
                    rows = n * sum(comb(len(g), k) for k in range(t + 1))
                    c = cost + ROW_S * rows + PAIR_S * (n * n / 2 * chance[: t + 1].sum() * (2 if t else 1))
                    if c < new[used + t + 1][0]:
                        new[used + t + 1] = (c, [*chosen, (g, t)])
            table = new
        best = min(best, table[distance + 1], key=lambda x: x[0])
    return best[1]


def _forest(fp: np.ndarray, exact: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """A spanning forest of links between members of one bucket, of which at least one was not altered for the probe."""
    a, b = [], []
    bits = np.ascontiguousarray(fp).view(np.uint64)
    open_at, is_exact = np.arange(len(fp)), exact
    while len(open_at):
        stack, open_at = [open_at[-1]], open_at[:-1]
        while stack and len(open_at):
            i = stack.pop()
            near = np.bitwise_count(bits[open_at] ^ bits[i]) <= distance
            if not is_exact[i]:
                near &= is_exact[open_at]
            if near.any():
                found = open_at[near]
                a += [int(fp[i])] * len(found)
                b += fp[found].tolist()
                stack += found.tolist()
                open_at = open_at[~near]
    return a, b


def _probe(part: int, mask: int, flips: list[int]):
    """Buckets in which a fingerprint is met for one part: its masked bits, and those with each of the flips."""
    key = F.col("fp").bitwiseAND(F.lit(mask))
    return F.transform(F.array(*[F.lit(x) for x in flips]), lambda x: F.struct(F.lit(part).alias("part"), key.bitwiseXOR(x).alias("key"), (x == 0).alias("exact")))


def links(prints: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """prints (fp), distinct -> (a, b): links of at most ``distance`` bits that connect whatever all such links connect."""
    n, both = bit_statistics(prints)
    plan = allocate(both, n, distance) if n else []
    signed = lambda v: int(np.uint64(v).astype(np.int64))
    probes = []
    for k, (bits, t) in enumerate(plan):
        flips = [signed(sum(1 << b for b in c)) for r in range(t + 1) for c in combinations(bits, r)]
        probes.append(_probe(k, signed(sum(1 << b for b in bits)), flips))
    if not probes:
        return prints.sparkSession.createDataFrame([], "a long, b long")
    rows = prints.select("fp", F.explode(F.concat(*probes)).alias("p")).select("fp", "p.*")
    large = rows.groupBy("part", "key").count().filter(F.col("count") > bucket)
    large = large.select("part", "key", F.ceil(F.col("count") * 2 / bucket).cast("int").alias("chunks"))
    rows = rows.join(large, ["part", "key"], "left").withColumn("chunk", F.pmod(F.xxhash64("fp", F.lit(3)), F.coalesce("chunks", F.lit(1))).cast("int"))
    chunk_pairs = F.when(F.col("chunks").isNull(), F.array(F.lit("-"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.concat(F.least("chunk", c).cast("string"), F.lit("-"), F.greatest("chunk", c).cast("string"))))
    rows = rows.withColumn("task", F.explode(chunk_pairs))
    buckets = rows.groupBy("part", "key", "task").agg(F.collect_list("fp").alias("fps"), F.collect_list("exact").alias("exacts")).filter(F.size("fps") > 1)

    def verify(batches):
        for batch in batches:
            lists, flags = batch.column(0), batch.column(1)
            ends, fp, exact = lists.offsets.to_numpy(), lists.values.to_numpy(), flags.values.to_numpy(zero_copy_only=False)
            a, b = [], []
            for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                x, y = _forest(fp[s:e], exact[s:e], distance)
                a += x
                b += y
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return buckets.select("fps", "exacts").mapInArrow(verify, "a long, b long").distinct()


def _keys() -> list:
    """Two hashes of a text, by which rows without an id of their own are found again."""
    return [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2")]


def groups(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> tuple[DataFrame, DataFrame]:
    """(marks, classes): marks (doc_id, k1, k2, fp) with two hashes of the text, checkpointed; classes (fp, root, component_id), one
    row per distinct fingerprint. A component's smallest id is small beside its fingerprints and kept as a table, so it is
    broadcast below Spark's limit and else joined where a large component can be split."""
    marks = cut_lineage(docs.select("doc_id", *_keys(), fingerprint(shingle)(F.col("text")).alias("fp")))
    prints = cut_lineage(marks.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(prints, distance))
    rooted = prints.join(roots.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = as_table(rooted)
    least = as_table(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    return marks, cut_lineage(rooted.join(least, "root", "left").select("fp", "root", F.when(F.col("component_id").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id")))


def duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id: the smallest doc_id that links reach.

    Null doc_ids are never the smallest unless a component has no other. Null and empty texts share fingerprint zero.
    """
    marks, classes = groups(docs, **options)
    return marks.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest doc_id.

    Texts are fingerprinted once and not dealt out by component: what goes is an anti-join on the ids of the dropped, a table of
    known size. Rows whose doc_id is null or repeated can't be told apart so; they alone are joined with their marks by hashes of
    their texts, and one of each component stays. Columns may have any names.
    """
    marks, classes = groups(docs, **options)
    whose = marks.join(classes, "fp")
    repeated = marks.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id")
    dropped = as_table(whose.filter("doc_id <> component_id").select("doc_id").unionByName(repeated).distinct())
    chosen = whose.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).join(repeated.withColumn("twice", F.lit(True)), "doc_id", "left").filter("doc_id is null or twice")
    chosen = as_table(chosen.groupBy("root").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("c")).select(F.col("c.doc_id").alias("_id"), F.col("c.k1").alias("_k1"), F.col("c.k2").alias("_k2")))
    plain = docs.filter("doc_id is not null").join(dropped, "doc_id", "left_anti").select(*[quoted(c) for c in docs.columns])
    if chosen.isEmpty():
        return plain
    return plain.unionByName(_one_each(docs, chosen))


def _one_each(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row of docs for each (_id, _k1, _k2); equal rows differ in nothing that matters here, and any of them is taken."""
    rows = docs.select(whole_row(docs), F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_x"), F.xxhash64(F.lit(1), "text").alias("_y"))
    found = rows.join(chosen, F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_x") == F.col("_k1")) & (F.col("_y") == F.col("_k2")))
    return row_again(found.groupBy("_id", "_k1", "_k2").agg(F.first("row").alias("row")), docs.columns)
