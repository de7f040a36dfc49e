"""N-gram Jaccard join by a universe-partition pigeonhole.

A document is the set of its word shingles. Sets are put into bands by size; in a band the universe of shingles is hashed into
segments, and a set into the subsets that fall into each. Two sets of Jaccard similarity T or more differ in at most H shingles, a
number that follows from their sizes, so they can't differ in every one of H + 1 segments. Two kinds of index entries use that:

* ``loose`` segments are indexed with their one-deletion neighbourhoods, so subsets that differ in one shingle meet. If none of d
  loose segments meets, they use up 2d of the differences.
* of the other subsets, each set gives the first H + 1 - 2d in one order of all possible subsets. Sorted like that, the first
  subset that two sets share has at most H - 2d others before it in either set, so both sets give it. The order puts subsets with
  many uncommon shingles first; empty ones come last.

The number of segments and of loose ones is allocated for each band by the least estimated cost of entries and false meetings.
Entries go to their buckets as packed arrays; a bucket's first set is compared with its others on the whole sets. Where the partners
of a first set aren't all connected by that, they are compared with each other in tasks of bounded size, which give a spanning forest
of the links between components. Links within a component are never needed, and pairs are no rows.

Shingles are compared by 64-bit hashes. Equal sets are one class, known by a hash that a second one checks. Null texts and texts
without words have an empty set and are linked with nothing. Null doc_ids are never the smallest unless a component has no other.
"""

from __future__ import annotations

from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import as_table, bounded_batches, cut_lineage
from .words import SPACED, blocks, mix64, polynomial, words_of

SHINGLE, PERCENT = 5, 80
#: Each band's largest set has about this many times the size of its smallest.
BAND = 1.6
#: Entries of a partition and of what a task packs at a time; pairs with one set that are verified in one task; shingles of a chunk.
ENTRIES, PACK, CHUNK, SHINGLES = 2_000_000, 1_000_000, 256, 3_000_000
#: Shingles held to be common: at most so many, each in so many documents of a task's batch, or a share of them. Only the order of subsets depends on it.
COMMON, COMMON_DOCS, COMMON_SHARE = 65_536, 20, 1 / 500
#: Seconds for an entry and for a false meeting, and how likely another set of the band shares a subset of k shingles: A * B^k.
ENTRY_S, MEET_S, SHARED_A, SHARED_B = 1e-6, 5e-5, 1e-3, 0.2


def sets_of(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(first, shingles): each text's distinct shingles, sorted, are shingles[first[i]:first[i + 1]]."""
    w = words_of(data, offsets, SPACED)
    count, rows = np.diff(w.first), len(offsets) - 1
    found, fits = w.windows(n)
    found, owner = found[fits], w.owner()[: len(found)][fits]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        found = np.concatenate([found, polynomial(w.hashes, w.first[short], w.first[short + 1], 0x9E3779B97F4A7C15)])
        owner = np.concatenate([owner, short])
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    found, owner = found[new], owner[new]
    return np.searchsorted(owner, np.arange(rows + 1)), found


def _totals(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]] modulo 2^64."""
    run = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, dtype=np.uint64, out=run[1:])
    return run[first[1:]] - run[first[:-1]]


def set_hashes(first: np.ndarray, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple(mix64(_totals(mix64(shingles ^ np.uint64(salt)), first)) for salt in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def marks(n: int = SHINGLE):
    """A Column function text -> (set, check, size): a set's hash, a second one, and its number of shingles."""

    def of(texts: pa.Array) -> pa.Array:
        got = []
        for _, _, data, offsets in blocks(texts):
            first, shingles = sets_of(data, offsets, n)
            got.append((*set_hashes(first, shingles), np.diff(first)))
        cols = [np.concatenate(c) for c in zip(*got, strict=True)] if got else [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)]
        return pa.StructArray.from_arrays([pa.array(cols[0].view(np.int64)), pa.array(cols[1].view(np.int64)), pa.array(cols[2].astype(np.int64))], ["set", "check", "size"])

    bounded_batches()
    return F.arrow_udf(of, "struct<set:long,check:long,size:long>")


def most_apart(total: int | np.ndarray, percent: int = PERCENT):
    """Most shingles in which two sets with ``total`` elements together may differ."""
    return total * (100 - percent) // (100 + percent)


class Plan:
    """Bands of set sizes and, for each, its number of segments and of loose ones."""

    def __init__(self, counts: dict[int, int], percent: int = PERCENT):
        """counts: number of sets by size; sizes may be rounded, but for the largest."""
        self.percent, largest, low = percent, max(counts, default=1), 1
        lows = []
        while low <= largest:
            lows.append(low)
            low = max(low + 1, int(np.ceil(low * BAND)))
        self.low = np.array(lows, np.int64)
        self.high = np.append(self.low[1:] - 1, low - 1)
        self.segments, self.loose = np.ones(len(lows), np.int64), np.zeros(len(lows), np.int64)
        sizes, n = np.array(sorted(counts), np.int64), np.array([counts[k] for k in sorted(counts)], np.int64)
        for c in range(len(lows)):
            inside = (sizes * 100 >= self.low[c] * percent) & (sizes <= self.high[c])
            self.segments[c], self.loose[c] = self._allocate(int(self.low[c]), int(self.high[c]), int(n[inside].sum()))

    def _allocate(self, low: int, high: int, sets: int) -> tuple[int, int]:
        apart = most_apart(2 * high, self.percent)
        usual = (low + high) // 2
        need = most_apart(2 * usual, self.percent) + 1
        best = None
        for loose in sorted({0, *(2**k for k in range(4)), (apart + 2) // 2}):
            if 2 * loose > apart + 2:
                continue
            for stretch in (1, 1.08, 1.15, 1.25, 1.4, 1.7):
                segments = max(int(np.ceil((apart + 1 - loose) * stretch)), loose, 1)
                cost = self._cost(usual, need, segments, loose, sets)
                if best is None or cost < best[0]:
                    best = cost, segments, loose
        return best[1], best[2]

    @staticmethod
    def _cost(size: int, need: int, segments: int, loose: int, sets: int) -> float:
        """Seconds a set costs: its entries, and its false meetings."""
        k = np.arange(size + 1)
        p = 1 / segments
        if segments == 1:
            share = (k == size).astype(float)
        else:
            log = np.array([lgamma(size + 1) - lgamma(i + 1) - lgamma(size - i + 1) for i in k]) + k * np.log(p) + (size - k) * np.log1p(-p)
            share = np.exp(log)
        meets = np.where(k == 0, share[0], SHARED_A * SHARED_B**k)
        plain = max(need - 2 * loose, 0)
        left, cost = float(plain), 0.0
        for i in range(size, -1, -1):  # the largest subsets are given first
            taken = min(left, float(share[i]) * (segments - loose))
            cost += taken * meets[i]
            left -= taken
        near = np.where(k <= 1, share[0] + share[1] if size else 1.0, SHARED_A * SHARED_B ** np.maximum(k - 1, 0))
        cost += loose * float((share * near).sum())
        return ENTRY_S * (plain + loose * (1 + size * p)) + MEET_S * sets * cost

    def places(self, size: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, band, most differences) for the bands in which each set is indexed, where it may have partners that are not equal."""
        own, out, up = np.searchsorted(self.low, size, "right") - 1, [], 0
        while True:
            band = own + up
            rows = np.flatnonzero((size > 0) & (band < len(self.low)) & (size * 100 >= self.low[np.minimum(band, len(self.low) - 1)] * self.percent))
            if not len(rows):
                return out
            n, band = size[rows], band[rows]
            apart = most_apart(n + np.minimum(self.high[band], n * 100 // self.percent), self.percent)
            out.append((rows[apart > 0], band[apart > 0], apart[apart > 0]))
            up += 1

    def entries(self, size: np.ndarray, each: np.ndarray) -> int:
        """About how many entries there are of ``each`` sets of a size."""
        return int(sum((each[rows] * (apart + 1)).sum() for rows, _, apart in self.places(size)))


def entries(first: np.ndarray, shingles: np.ndarray, plan: Plan, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the index entries of a block of sets; ``common`` is sorted."""
    spread = mix64(shingles ^ np.uint64(0x8EBC6AF09C88C6E3))
    if len(common):
        rare = common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] != shingles
    else:
        rare = np.ones(len(shingles), bool)
    out_row, out_key = [], []
    for rows, band, apart in plan.places(np.diff(first)):
        n, segments, loose = np.diff(first)[rows], plan.segments[band], plan.loose[band]
        begin = np.concatenate([[0], np.cumsum(segments)])  # the segments of all rows, one after another
        of = np.repeat(np.arange(len(rows)), n)
        at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[rows], n)
        segment = (mix64(spread[at] ^ (band[of].astype(np.uint64) << np.uint64(32))) % segments[of].astype(np.uint64)).astype(np.int64)
        slot = begin[of] + segment
        total = int(begin[-1])
        content = np.zeros(total, np.uint64)
        np.add.at(content, slot, spread[at])
        held = np.bincount(slot, minlength=total)
        uncommon = np.bincount(slot[rare[at]], minlength=total)
        owner = np.repeat(np.arange(len(rows)), segments)
        place = np.arange(total) - begin[owner]
        seed = mix64((band[owner].astype(np.uint64) << np.uint64(32)) ^ place.astype(np.uint64) ^ np.uint64(0x589965CC75374CC3))
        key = mix64(content ^ seed)
        is_loose = place < loose[owner]
        # whole subsets of loose segments, and each without one shingle
        whole = np.flatnonzero(is_loose)
        out_row.append(rows[owner[whole]])
        out_key.append(key[whole])
        less = np.flatnonzero(is_loose[slot])
        out_row.append(rows[of[less]])
        out_key.append(mix64((content[slot[less]] - spread[at[less]]) ^ seed[slot[less]]))
        # the first of the other subsets, in the order of all; those that tie with the last are given too
        plain = np.flatnonzero(~is_loose)
        rank = (np.uint64(255) - np.minimum(uncommon[plain], 15).astype(np.uint64) * np.uint64(16) - np.minimum(held[plain], 15).astype(np.uint64)) << np.uint64(24)
        rank |= key[plain] >> np.uint64(40)
        rank |= owner[plain].astype(np.uint64) << np.uint64(32)
        order = np.argsort(rank)
        plain, rank = plain[order], rank[order]
        start = np.searchsorted(owner[plain], np.arange(len(rows) + 1))
        want = np.minimum(np.maximum(apart + 1 - 2 * loose, 0), np.diff(start))
        last = np.where(want > 0, rank[np.minimum(start[:-1] + np.maximum(want - 1, 0), max(len(rank) - 1, 0))], np.uint64(0)) if len(rank) else np.zeros(len(rows), np.uint64)
        given = (want[owner[plain]] > 0) & (rank <= last[owner[plain]])
        out_row.append(rows[owner[plain[given]]])
        out_key.append(key[plain[given]])
    if not out_row:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_row), np.concatenate(out_key)


def common_shingles(docs: DataFrame, n: int = SHINGLE) -> np.ndarray:
    """Sorted shingles that many documents have: those that some task met often among its distinct sets, the most frequent ones first."""

    def flush(held: list[np.ndarray], sets: int):
        shingle, count = np.unique(np.concatenate(held), return_counts=True)
        often = count >= max(COMMON_DOCS, sets * COMMON_SHARE)
        return pa.RecordBatch.from_arrays([pa.array(shingle[often].view(np.int64)), pa.array(count[often])], ["shingle", "n"])

    def count(batches):
        held, size, seen = [], 0, set()
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                first, shingles = sets_of(data, offsets, n)
                for i, h in enumerate(set_hashes(first, shingles)[0].tolist()):
                    if h not in seen:
                        seen.add(h)
                        held.append(shingles[first[i] : first[i + 1]])
                        size += len(held[-1])
                if size > 4 * PACK:
                    yield flush(held, len(seen))
                    held, size, seen = [], 0, set()
        if held:
            yield flush(held, len(seen))

    bounded_batches()
    rows = docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = rows.orderBy(F.desc("n"), "shingle").limit(COMMON).collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def _packed(docs: DataFrame, plan: Plan, common: np.ndarray, parts: int, n: int) -> DataFrame:
    """(part, keys, sets): entries of all documents, sorted and without repeats within what a task packs at a time."""

    def flush(key, sid):
        part = key % np.uint64(parts)
        order = np.lexsort((sid, key, part))
        key, sid, part = key[order], sid[order], part[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
        key, sid, part = key[new], sid[new], part[new].astype(np.int64)
        at = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        stop = np.append(at[1:], len(part))
        return pa.RecordBatch.from_arrays(
            [pa.array(part[at]), pa.array([key[a:b].tobytes() for a, b in zip(at, stop, strict=True)], pa.binary()), pa.array([sid[a:b].tobytes() for a, b in zip(at, stop, strict=True)], pa.binary())],
            ["part", "keys", "sets"],
        )

    def pack(batches):
        keys, sids, size = [], [], 0
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                first, shingles = sets_of(data, offsets, n)
                row, key = entries(first, shingles, plan, common)
                keys.append(key)
                sids.append(set_hashes(first, shingles)[0][row])
                size += len(key)
                if size >= PACK:
                    yield flush(np.concatenate(keys), np.concatenate(sids))
                    keys, sids, size = [], [], 0
        if size:
            yield flush(np.concatenate(keys), np.concatenate(sids))

    bounded_batches()
    return docs.select("text").mapInArrow(pack, "part long, keys binary, sets binary")


class _Met:
    """Keys seen so far with their first set; gives the entries of keys that have a second one. Memory follows the number of keys,
    not that of the sets of one key."""

    def __init__(self):
        self.key, self.first, self.told = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, key: np.ndarray, sid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, set, first set) of entries that share their key with another set."""
        order = np.lexsort((sid, key))
        key, sid = key[order], sid[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
        key, sid = key[new], sid[new]
        begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        unseen = begins[~np.isin(key[begins], self.key)]
        self.key, self.first, self.told = np.append(self.key, key[unseen]), np.append(self.first, sid[unseen]), np.append(self.told, np.zeros(len(unseen), bool))
        order = np.argsort(self.key, kind="stable")
        self.key, self.first, self.told = self.key[order], self.first[order], self.told[order]
        at = np.searchsorted(self.key, key)
        other = sid != self.first[at]
        fresh = np.unique(at[other])
        fresh = fresh[~self.told[fresh]]
        self.told[fresh] = True
        return np.append(key[other], self.key[fresh]), np.append(sid[other], self.first[fresh]), np.append(self.first[at[other]], self.first[fresh])


def meetings(docs: DataFrame, plan: Plan, common: np.ndarray, parts: int, n: int = SHINGLE) -> DataFrame:
    """(key, set, first): sets that share an entry, with the first set of each."""

    def meet(batches):
        met, held, size = _Met(), [], 0

        def give():
            key, sid, first = met.add(*(np.concatenate(c) for c in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(sid), pa.array(first)], ["key", "set", "first"])

        for batch in batches:
            for k, s in zip(batch.column(0), batch.column(1), strict=True):
                held.append((np.frombuffer(k.as_buffer(), np.uint64), np.frombuffer(s.as_buffer(), np.int64)))
                size += len(held[-1][0])
                if size >= PACK:
                    yield give()
                    held, size = [], 0
        if held:
            yield give()

    return _packed(docs, plan, common, parts, n).repartition(parts, "part").select("keys", "sets").mapInArrow(meet, "key long, set long, first long")


def verify(pairs: DataFrame, texts: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """pairs (a, b) of sets, texts (set, text) -> the pairs that are similar. Every set of b travels to where a's is; an a with many
    partners is sent to several tasks."""
    chunks = as_table(pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")))
    heads = chunks.select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("a").alias("set"), F.lit(0).alias("place"))
    others = pairs.join(chunks, "a").select("a", F.pmod(F.xxhash64("b"), "chunks").cast("int").alias("chunk"), F.col("b").alias("set"), F.lit(1).alias("place"))
    rows = heads.unionByName(others).join(texts, "set").repartition("a", "chunk").sortWithinPartitions("a", "chunk", "place")

    def check(batches):
        head, of = None, None
        for batch in batches:
            a, b = [], []
            for row, _, data, offsets in blocks(batch.column(3)):
                first, shingles = sets_of(data, offsets, n)
                hashes = set_hashes(first, shingles)[0].view(np.int64)
                for i in range(len(first) - 1):
                    mine, own, place = (batch.column(c)[row + i].as_py() for c in range(3))
                    if own != hashes[i]:
                        raise ValueError("two texts share a 64-bit hash")
                    found = shingles[first[i] : first[i + 1]]
                    if place == 0:
                        head, of = found, mine
                    elif mine == of:
                        same = int((head[np.minimum(np.searchsorted(head, found), len(head) - 1)] == found).sum())
                        if 100 * same >= percent * (len(head) + len(found) - same):
                            a.append(mine)
                            b.append(own)
                    else:
                        raise ValueError("a set without its text")
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    bounded_batches()
    return rows.select("a", "set", "place", "text").mapInArrow(check, "a long, b long")


def _rooted(sets: DataFrame, links: DataFrame) -> DataFrame:
    """sets (set, ...) with the root of each one's component."""
    return sets.join(components(links).withColumnRenamed("id", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))


def _links_across(lefts: list, rights: list, percent: int) -> tuple[list[int], list[int]]:
    """Links between sets (set, root, shingles) of different components, as many as connect what they connect."""
    size = np.array([len(r[2]) for r in rights])
    tokens = np.concatenate([r[2] for r in rights])
    owner = np.repeat(np.arange(len(rights)), size)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    roots, names = np.array([r[1] for r in rights]), [r[0] for r in rights]
    up: dict[int, int] = {}

    def find(x):
        while up.get(x, x) != x:
            up[x] = x = up.get(up[x], up[x])
        return x

    a, b = [], []
    for name, root, shingles in lefts:
        low, high = np.searchsorted(tokens, shingles, "left"), np.searchsorted(tokens, shingles, "right")
        n = high - low
        at = np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)
        same = np.bincount(owner[at], minlength=len(rights))
        for i in np.flatnonzero((100 * same >= percent * (len(shingles) + size - same)) & (roots != root)).tolist():
            x, y = find(root), find(int(roots[i]))
            if x != y:
                up[x] = y
                a.append(name)
                b.append(names[i])
    return a, b


def across(stars: DataFrame, rooted: DataFrame, texts: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(a, b): links between sets in different components that share an entry, enough to connect what they connect.

    Sets that share an entry share its first set, so they are partners of one star: (a, b) are stars, a among them. Where a star has
    partners in several components, those outside its largest one are compared with all others in one task, by an index of shingles;
    stars of more than ``SHINGLES`` are cut into chunks, and pairs of chunks are tasks. No pair becomes a row that isn't a link.
    """
    members = stars.unionByName(stars.select("a", F.col("a").alias("b"))).distinct().withColumnRenamed("b", "set").join(rooted.select("set", "root", "size"), "set")
    open_ = members.groupBy("a").agg((F.min("root") != F.max("root")).alias("open")).filter("open").select("a")
    members = as_table(members.join(open_, "a", "left_semi"))
    main = members.groupBy("a", "root").agg(F.sum("size").alias("n")).groupBy("a").agg(F.max(F.struct("n", "root"))["root"].alias("main"))
    members = members.join(main, "a").withColumn("out", F.col("root") != F.col("main")).drop("main")
    pieces = lambda x: F.ceil(F.coalesce(F.sum(x), F.lit(0)) / SHINGLES).cast("int")
    chunks = as_table(members.groupBy("a").agg(pieces(F.col("size")).alias("k"), pieces(F.when(F.col("out"), F.col("size"))).alias("ko")))
    members = as_table(members.join(chunks, "a"))
    place = lambda count: F.pmod(F.xxhash64("set"), F.col(count)).cast("int")
    to = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    left = members.filter("out").select("a", place("ko").alias("i"), to("k").alias("j"), F.lit(0).alias("side"), "set", "root")
    right = members.select("a", place("k").alias("j"), to("ko").alias("i"), F.lit(1).alias("side"), "set", "root").select(left.columns)
    rows = left.unionByName(right).join(texts, "set").select("a", "i", "j", "side", "set", "root", "text")
    rows = rows.repartition("a", "i", "j").sortWithinPartitions("a", "i", "j")

    def compare(batches):
        task, sides = None, ([], [])

        def done():
            a, b = _links_across(*sides, percent) if sides[0] and sides[1] else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True))
            for row, _, data, offsets in blocks(batch.column(6)):
                first, shingles = sets_of(data, offsets, n)
                for k in range(len(first) - 1):
                    *new, side, name, root = keys[row + k]
                    if new != task:
                        yield done()
                        task, sides = new, ([], [])
                    sides[side].append((name, root, shingles[first[k] : first[k + 1]]))
        yield done()

    bounded_batches()
    return rows.mapInArrow(compare, "a long, b long").distinct()


def join(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id: the smallest doc_id reachable by links."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    known = cut_lineage(docs.select("doc_id", F.xxhash64("text").alias("k"), marks(n)("text").alias("m")).select("doc_id", "k", "m.*"))
    sets = known.groupBy("set").agg(F.min("doc_id").alias("doc"), F.min("k").alias("k"), F.max("size").alias("size"), F.min("check").alias("c"), F.max("check").alias("d"))
    sets = as_table(sets)
    bins = sets.filter("size > 0").groupBy(F.floor(F.log2("size") * 8)).agg(F.max("size").alias("size"), F.count("*").alias("n"), F.sum((F.col("c") != F.col("d")).cast("int")).alias("bad")).collect()
    if any(r["bad"] for r in bins):
        raise ValueError("two sets share a 64-bit hash")
    plan = Plan({r["size"]: r["n"] for r in bins}, percent)
    size, each = np.array([r["size"] for r in bins], np.int64), np.array([r["n"] for r in bins], np.int64)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-plan.entries(size, each) // ENTRIES))
    met = as_table(meetings(docs, plan, common_shingles(docs, n), parts, n))
    stars = as_table(met.filter("set <> first").select(F.col("first").alias("a"), F.col("set").alias("b")).distinct())
    sized = sets.select("set", "size")
    near = stars.join(sized.select(F.col("set").alias("a"), F.col("size").alias("sa")), "a").join(sized.select(F.col("set").alias("b"), F.col("size").alias("sb")), "b")
    near = as_table(near.filter(f"100 * least(sa, sb) >= {percent} * greatest(sa, sb)").select("a", "b"))
    want = sets.join(met.select("set").distinct(), "set", "left_semi").select("set", "k")
    texts = docs.groupBy(F.xxhash64("text").alias("k")).agg(F.first("text").alias("text")).join(want, "k").select("set", "text")
    texts = as_table(texts)
    links = as_table(verify(near, texts, n, percent))
    rooted = as_table(_rooted(sized, links))
    more = as_table(across(stars, rooted, texts, n, percent))
    if not more.isEmpty():
        rooted = as_table(_rooted(sized, links.unionByName(more)))
    firsts = rooted.join(sets.select("set", "doc"), "set").withColumn("least", F.col("doc"))
    least = as_table(firsts.groupBy("root").agg(F.min("least").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    named = cut_lineage(firsts.drop("least").join(least, "root", "left").select("set", F.when(F.col("least").isNull(), F.col("doc")).otherwise(F.col("least")).alias("component_id")))
    out = known.join(named, "set").select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out
