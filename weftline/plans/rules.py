"""Frequent itemsets and association rules of many strata in the same jobs.

Units are dealt into blocks of about ``BLOCK`` within their stratum, and a block keeps for every item the bitmap of its units. What is
frequent in a stratum is frequent, by the same share, in at least one of its blocks: so every block is mined on its own, depth first
over intersections of bitmaps, and then what any block found is counted over all blocks of the stratum. No group of rows is larger
than a block, and the number of jobs depends on neither the number of strata nor that of blocks.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.lineage import cut

#: Units of a block, and candidates that are counted against a block at a time.
BLOCK, CANDIDATES = 1 << 15, 4096


def _key(strata: list[str]) -> Column:
    """All strata as one value, in which null equals null."""
    return F.struct(*[F.col(f"`{s}`").alias(s) for s in strata]) if strata else F.struct(F.lit(0).alias("all"))


def _blocks(inc: DataFrame, strata: list[str]) -> tuple[DataFrame, DataFrame]:
    """(key, units) and (key, n, items, bits): for each block its number of units, its items and their bitmaps."""
    sets = cut(inc.filter("unit is not null and item is not null").select(_key(strata).alias("key"), "unit", F.col("item").cast("string").alias("item")).groupBy("key", "unit").agg(F.sort_array(F.collect_set("item")).alias("items")))
    size = cut(sets.groupBy("key").agg(F.count("*").alias("units")))
    dealt = sets.join(size, "key").withColumn("block", F.pmod(F.xxhash64("unit"), F.ceil(F.col("units") / BLOCK)).cast("int"))
    kind = sets.schema["key"].dataType.simpleString()

    def bitmaps(table: pa.Table) -> pa.Table:
        lists = table.column("items").combine_chunks()
        values = lists.flatten().dictionary_encode()
        unit = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        has = np.zeros((len(values.dictionary), len(lists)), bool)
        has[values.indices.to_numpy(), unit] = True
        bits = [row.tobytes() for row in np.packbits(has, axis=1)]
        kinds = [table.schema.field("key").type, pa.int64(), pa.list_(pa.string()), pa.list_(pa.binary())]
        return pa.table([pa.array([v], k) for v, k in zip((table.column("key")[0].as_py(), len(lists), values.dictionary.to_pylist(), bits), kinds, strict=True)], names=["key", "n", "items", "bits"])

    return size, cut(dealt.select("key", "block", "items").groupBy("key", "block").applyInArrow(bitmaps, f"key {kind}, n bigint, items array<string>, bits array<binary>"))


def _matrix(bits: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words."""
    width = max((len(b) for b in bits), default=0)
    width += -width % 8
    return np.frombuffer(b"".join(b.ljust(width, b"\0") for b in bits), np.uint64).reshape(len(bits), -1)


def _mine(bits: np.ndarray, least: int, most_items: int | None):
    """Index tuples of all sets of rows whose bitmaps share at least ``least`` bits."""
    count = np.bitwise_count(bits).sum(1)
    start = np.flatnonzero(count >= least)
    start = start[np.argsort(count[start], kind="stable")]  # rare ones first: their intersections are small
    stack = [((), start, bits[start])]
    while stack:
        prefix, rows, maps = stack.pop()
        for i in range(len(rows)):
            found = (*prefix, int(rows[i]))
            yield found
            if i + 1 < len(rows) and (most_items is None or len(found) < most_items):
                both = maps[i + 1 :] & maps[i]
                keep = np.bitwise_count(both).sum(1) >= least
                if keep.any():
                    stack.append((found, rows[i + 1 :][keep], both[keep]))


def frequent_itemsets(inc: DataFrame, strata: list[str] = (), min_support: float = 0.01, most_items: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, units) and (key, items, freq): sorted itemsets that at least ``min_support`` of a stratum's units have, keyed by the
    struct of all strata. Null units and items are left out; a unit's repeated items count once."""
    if not 0 < min_support <= 1:
        raise ValueError("min_support must be in (0, 1]")
    size, blocks = _blocks(inc, list(strata))
    kind = blocks.schema["key"].dataType.simpleString()

    def candidates(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                names = batch.column(2)[i].as_py()
                sets = [sorted(names[k] for k in s) for s in _mine(_matrix(batch.column(3)[i].as_py()), max(1, ceil(min_support * batch.column(1)[i].as_py() - 1e-9)), most_items)]
                for a in range(0, len(sets), 10_000):
                    part = sets[a : a + 10_000]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(part))), pa.array(part, pa.list_(pa.string()))], ["key", "items"])

    found = cut(blocks.mapInArrow(candidates, f"key {kind}, items array<string>").distinct())
    sizes = found.groupBy("key").agg(F.ceil(F.count("*") / CANDIDATES).cast("int").alias("chunks"))
    dealt = cut(found.join(sizes, "key").groupBy("key", F.pmod(F.xxhash64("items"), "chunks").alias("chunk")).agg(F.collect_list("items").alias("sets")))

    def counts(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                place = {name: k for k, name in enumerate(batch.column(1)[i].as_py())}
                bits, sets, freq = _matrix(batch.column(2)[i].as_py()), [], []
                for items in batch.column(3)[i].as_py():
                    if all(x in place for x in items):
                        sets.append(items)
                        freq.append(int(np.bitwise_count(np.bitwise_and.reduce(bits[[place[x] for x in items]], axis=0)).sum()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(sets), pa.int64())), pa.array(sets, pa.list_(pa.string())), pa.array(freq, pa.int64())], ["key", "items", "freq"])

    met = blocks.select("key", "items", "bits").join(dealt.select("key", "sets"), "key").select("key", "items", "bits", "sets")
    total = met.mapInArrow(counts, f"key {kind}, items array<string>, freq bigint").groupBy("key", "items").agg(F.sum("freq").alias("freq"))
    total = total.join(size, "key").filter(F.col("freq") >= min_support * F.col("units") - 1e-9)
    return size, cut(total.select("key", "items", "freq"))


def association_rules(inc: DataFrame, min_support: float = 0.01, min_confidence: float = 0.3, min_lift: float = 1.0, most_items: int | None = None, strata: list[str] = ()) -> DataFrame:
    """(strata, antecedent, consequent, support, confidence, lift) of all frequent itemsets, consequents of any size; ``most_items``
    keeps to itemsets of that many items. An empty table gives an empty frame.

    A larger consequent of the same itemset never has a higher confidence. So consequents begin with one item, and only those that
    reach the confidence are made longer, by items after their last.
    """
    size, sets = frequent_itemsets(inc, strata, min_support, most_items)
    support = sets.select("key", F.col("items").alias("antecedent"), F.col("freq").alias("fa"))
    bound = F.col("both") >= min_confidence * F.col("fa") - 1e-12
    rules = sets.filter("size(items) > 1").select("key", F.col("freq").alias("both"), "items", F.explode("items").alias("x"))
    rules = rules.select("key", "both", F.array_remove("items", F.col("x")).alias("antecedent"), F.array("x").alias("consequent"))
    front = cut(rules.join(support, ["key", "antecedent"]).filter(bound))
    out = front
    while not front.isEmpty():
        last = F.element_at("consequent", -1)
        longer = front.filter("size(antecedent) > 1").select("key", "both", "antecedent", "consequent", F.explode(F.filter("antecedent", lambda x: x > last)).alias("x"))
        longer = longer.select("key", "both", F.array_remove("antecedent", F.col("x")).alias("antecedent"), F.concat("consequent", F.array("x")).alias("consequent"))
        front = cut(longer.join(support, ["key", "antecedent"]).filter(bound))
        out = out.unionByName(front)
    other = support.select("key", F.col("antecedent").alias("consequent"), F.col("fa").alias("fc"))
    out = out.join(other, ["key", "consequent"]).join(size, "key")
    out = out.select("key", "antecedent", "consequent", (F.col("both") / F.col("units")).alias("support"), (F.col("both") / F.col("fa")).alias("confidence"), (F.col("both") * F.col("units") / (F.col("fa") * F.col("fc"))).alias("lift"))
    return out.filter(F.col("lift") >= min_lift).select(*[F.col("key").getField(s).alias(s) for s in strata], "antecedent", "consequent", "support", "confidence", "lift")


def pair_rules(pairs: DataFrame, min_support: float = 0.01, min_confidence: float = 0.3, min_lift: float = 1.0, strata: list[str] = ()) -> DataFrame:
    """The rules with one item on each side, (strata, antecedent, consequent, support, confidence, lift), from 2x2 tables of pairs."""
    sides = [F.struct(F.col(f"{x}_item").alias("antecedent"), F.col(f"{y}_item").alias("consequent"), F.col(f).alias("f")) for x, y, f in (("left", "right", "fl"), ("right", "left", "fr"))]
    rows = pairs.filter(F.col("a") >= F.greatest(F.lit(1.0), min_support * F.col("n") - 1e-9)).select(*strata, "a", "fl", "fr", "n", F.explode(F.array(*sides)).alias("s"))
    out = rows.select(*strata, "s.antecedent", "s.consequent", (F.col("a") / F.col("n")).alias("support"), (F.col("a") / F.col("s.f")).alias("confidence"), (F.col("a") * F.col("n") / (F.col("fl") * F.col("fr"))).alias("lift"))
    return out.filter((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift))
