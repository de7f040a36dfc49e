"""Hard negatives, vector codes and the n-gram join against brute force, with odd rows."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import hard_negatives, ngram_join, vector_codes, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, anchor long, slot int, score double, x string, code string, error long"


def vector_rows(n=260, width=10, seed=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(3)]
    rows = [(i, [c + rng.gauss(0, 0.7) for c in centres[i % 3]], i % 4 if i % 11 else None) for i in range(n)]
    rows += [(400, None, 1), (401, [float("nan")] * width, 1), (402, [float("inf")] + [0.0] * (width - 1), 2), (403, [None] + [0.0] * (width - 1), 2)]
    rows += [(404, [], 0), (405, rows[5][1], 1), (50, rows[50][1], 2), (406, rows[6][1][:7], 0), (407, [1e30] + [0.5] * (width - 1), None)]
    rows += [(500, rows[5][1], 1), (None, rows[7][1], 3)]
    return rows


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, 2, 0.5, "x", "c", 3) for i, v, y in rows], SCHEMA)


def whole(rows, scale, width):
    cap = float(vectors.LARGEST)
    for i, v, y in rows:
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            v = [math.floor(max(min(float(np.float32(c)) * scale, cap), -cap)) for c in v]
            yield i, v + [0] * (width - len(v)), y


def by_id(i):
    return (i is None, i or 0)


def loop_codes(rows, parts, entries, rounds, scale, width):
    kept = sorted(whole(rows, scale, width), key=lambda r: (by_id(r[0]), r[1]))
    cut = lambda v: [v[p * width // parts : (p + 1) * width // parts] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda p, v: min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        found = [[near(p, cut(v)[p])[1] for _, v, _ in kept] for p in range(parts)]
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [cut(v)[p] for (_, v, _), f in zip(kept, found[p], strict=True) if f == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out = []
    for i, v, y in kept:
        got = [near(p, cut(v)[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got), y))
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    total = {}
    for _, _, e, y in out:
        total[y] = total.get(y, 0) + e
    return sorted(((i, c, e, total[y], sha) for i, c, e, y in out), key=str)


@pytest.mark.parametrize("entries", [7, 70, 256])
def test_codes_equal_loops(spark, entries):
    rows = vector_rows()
    got = vector_codes.compress(vector_frame(spark, rows), parts=4, entries=entries, rounds=3, scale=1024)
    assert sorted((tuple(r) for r in got.collect()), key=str) == loop_codes(rows, 4, entries, 3, 1024, 12)


def test_slices_find_nearest_and_lowest_of_ties():
    rng = np.random.default_rng(0)
    entries = rng.integers(-20, 20, (90, 5))
    entries[50:70] = entries[10:30]
    x = rng.integers(-25, 25, (300, 5))
    best, dist = vector_codes.Slices(entries).nearest(x)
    want = ((x[:, None] - entries) ** 2).sum(2)
    assert (dist == want.min(1)).all() and (best == want.argmin(1)).all()
    masks = vector_codes.Slices(entries).within(x, np.full(300, 9))
    inside = np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little")[:, :90]
    assert (inside == (np.abs(x[:, None] - entries).max(2) <= 9)).all()


def test_codes_of_odd_tables(spark):
    empty = vector_codes.compress(vector_frame(spark, []))
    assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and empty.count() == 0
    assert vector_codes.compress(vector_frame(spark, [(1, None, 1), (2, [float("nan")], 1)])).count() == 0
    tie = vector_codes.compress(vector_frame(spark, [(2, [0.5, 0.5], 1), (2, [0.5, 0.5], None), (3, [], 1)])).collect()
    assert [r.error for r in tie] == [0, 0, 0] and sorted(r.code for r in tie)[0] == "00000000"


def test_decoded_vectors_are_near(spark):
    rows = vector_frame(spark, [r for r in vector_rows(width=12) if r[0] not in (404, 406, 407)])
    kept, width = vector_codes._table_of(rows, 1024, "embedding", "vec_id", "label")
    books = vector_codes.codebooks(kept, width, parts=4, entries=64, rounds=4)
    near = vector_codes.codes(kept, books).join(rows.select("vec_id", "embedding"), "vec_id").withColumn("again", vector_codes.decode(F.col("code"), books))
    gap = near.select(F.expr("aggregate(zip_with(again, embedding, (a, b) -> pow(a - b, 2)), 0D, (s, x) -> s + x)").alias("d"), (F.col("error") / 1024**2).alias("e")).collect()
    assert all(abs(math.sqrt(r.d) - math.sqrt(r.e)) < 12 / 1024 for r in gap)


def loop_negatives(rows, k, m, low, high, scale, width):
    kept = [(i, v, (y + 1) % 10 if i is not None and i % 7 == 0 else y) for i, v, y in whole(rows, scale, width) if y is not None]
    out = []
    for i, v, y in kept:
        if i is None or i % 50:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), by_id(j), j, z) for j, w, z in kept if j != i), key=lambda s: s[:2])
        for p, _, positive, _ in [s for s in scored if s[3] == y][:k]:
            fit = [(-s, j) for s, _, j, z in scored if z != y and low * -p <= 100 * -s <= high * -p]
            out += [(i, positive, rank + 1, j, -p, s) for rank, (s, j) in enumerate(fit[:m])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("low", "high"), [(50, 95), (0, 100), (90, 100)])
def test_negatives_equal_loops(spark, low, high, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROWS", 37)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    rows = vector_rows()
    rows += [(600 + i, rows[i][1], rows[i][2]) for i in range(0, 60)]  # ties
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.mine(vector_frame(spark, rows), F.col("vec_id") % 50 == 0, shifted, low=low, high=high)
    assert sorted((tuple(r) for r in got.collect()), key=str) == loop_negatives(rows, 5, 3, low, high, 256, 16)


def test_segment_bounds_hold_and_narrow():
    rng = np.random.default_rng(3)
    a, b = (hard_negatives.Summaries(rng.integers(-300, 300, (n, 64)) + 40 * rng.integers(0, 3, (n, 1))) for n in (20, 50))
    exact, last = a.x @ b.x.T, None
    for grain in range(len(hard_negatives.GRAINS)):
        low, high = hard_negatives.bounds(a, b, grain)
        assert (low <= exact).all() and (exact <= high).all()
        assert last is None or (high - low <= last + 1e-6).all()
        last = high - low


def test_negatives_of_odd_tables(spark):
    mine = lambda rows: hard_negatives.mine(vector_frame(spark, rows), F.col("vec_id") % 50 == 0, F.col("label"))
    empty = mine([])
    assert empty.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and empty.count() == 0
    assert mine([(1, [1.0], 1), (2, [1.0], 2)]).count() == 0
    assert mine([(50, [1.0], 1), (50, [1.0], 1), (51, [0.9], 2)]).count() == 0
    zero = mine([(0, [0.0], 1), (1, [1.0], 1), (2, [3.0], 2), (3, None, 2), (4, [1.0], None)]).collect()
    assert [tuple(r) for r in zero] == [(0, 1, 1, 2, 0, 0)]


WORDS = [a + b for a in ("ka", "lo", "MI", "zé", "tu", "ra") for b in ("ran", "SOL", "ß", "x1", "dé.", "!", "n't")]


def text_rows(seed=0, n=70):
    rng, rows = random.Random(seed), []
    line = " ".join(rng.choice(WORDS) for _ in range(25))
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.choice((1, 3, 4, 5, 6, 9, 12, 20, 40, 90, 300)))]
        if i % 9 == 0:
            words = words[: len(words) // 2] + line.split() + words[len(words) // 2 :]
        rows.append((3 * i, " ".join(words)))
        for c in range(rng.choice((0, 0, 1, 2, 6))):
            near = list(words)
            for _ in range(rng.randrange(0, 1 + len(near) // 25)):
                near[rng.randrange(len(near))] = rng.choice(WORDS) + str(c)
            if rng.random() < 0.3:
                near = near[: rng.randrange(len(near) - len(near) // 8, len(near) + 1)] or near
            rows.append((1000 + 10 * i + c, " ".join(near).swapcase() if rng.random() < 0.2 and "ß" not in " ".join(near) else "\t".join(near)))
    rows += [(5000, None), (5001, ""), (5002, " \n\t"), (5003, "one"), (5004, "ONE "), (5005, "one two three four five six"), (5006, "one two three four five")]
    rows += [(5007, " ".join(rng.choice(WORDS) + str(k % 977) for k in range(25_000))), (None, rows[3][1]), (None, "only null ids"), (None, "Only null ids"), (4, rows[4][1]), (4, rows[4][1])]
    return rows


def loop_join(rows, n=5, percent=80):
    sets = []
    for _, t in rows:
        fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", fold)
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), d if not sets[i] else least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def text_frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, 2, 3, 4) for i, t in rows], "doc_id long, text string, set string, size long, key long, root long, k long")


@pytest.mark.parametrize("seed", [1])
def test_join_equals_loops(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "PACK", 700)
    monkeypatch.setattr(ngram_join, "CHUNK", 3)
    monkeypatch.setattr(ngram_join, "SHINGLES", 400 if seed else 3_000_000)
    monkeypatch.setattr(ngram_join, "COMMON_DOCS", 4)
    rows = text_rows(seed)
    got = ngram_join.join(text_frame(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == loop_join(rows)


def test_join_of_odd_tables(spark):
    assert ngram_join.join(text_frame(spark, [])).collect() == []
    assert {tuple(r) for r in ngram_join.join(text_frame(spark, [(2, None), (1, ""), (3, " ")])).collect()} == {(2, 0, 2), (1, 0, 1), (3, 0, 3)}
    assert {tuple(r) for r in ngram_join.join(text_frame(spark, [(9, "a b"), (2, "A  b"), (2, "a b")])).collect()} == {(9, 1, 2), (2, 1, 2)}


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_similar_sets_share_an_entry(percent):
    """Any two similar sets meet, whatever was allocated: many and few sets of a size, common and uncommon shingles."""
    rng = np.random.default_rng(percent)
    common = np.sort(rng.integers(0, 2**63, 200).astype(np.uint64))
    for trial in range(250):
        size = int(rng.choice((2, 4, 5, 8, 9, 15, 33, 70, 200, 900)))
        base = rng.integers(0, 2**63, size).astype(np.uint64)
        if trial % 3 == 0:
            base[: min(size, 200) // 2] = common[: min(size, 200) // 2]
        drop = rng.integers(0, 1 + size * (100 - percent) // 100)
        other = np.append(base[: size - drop], rng.integers(0, 2**63, rng.integers(0, 1 + size * (100 - percent) // 200)).astype(np.uint64))
        a, b = np.unique(base), np.unique(other)
        same = len(np.intersect1d(a, b))
        if 100 * same < percent * (len(a) + len(b) - same) or np.array_equal(a, b):
            continue
        sets = int(rng.choice((1, 1000, 10**8)))
        plan = ngram_join.Plan({k: sets for k in (1, 5, 50, len(a), len(b), 1000)}, percent)
        row, key = ngram_join.entries(np.array([0, len(a), len(a) + len(b)]), np.append(a, b), plan, common)
        assert len(np.intersect1d(key[row == 0], key[row == 1])), (trial, len(a), len(b), same)


def test_met_tells_every_entry_of_shared_keys():
    rng = np.random.default_rng(5)
    key, sid = rng.integers(0, 300, 2000).astype(np.uint64), rng.integers(0, 4, 2000)
    met, told = ngram_join._Met(), set()
    for at in range(0, 2000, 130):
        k, s, f = met.add(key[at : at + 130], sid[at : at + 130])
        told |= set(zip(k.tolist(), s.tolist(), f.tolist(), strict=True))
    pairs = set(zip(key.tolist(), sid.tolist(), strict=True))
    shared = {k for k, _ in pairs if sum(x == k for x, _ in pairs) > 1}
    assert {(k, s) for k, s, _ in told} == {(k, s) for k, s in pairs if k in shared}
    assert all(len({f for x, _, f in told if x == k}) == 1 for k in shared)
