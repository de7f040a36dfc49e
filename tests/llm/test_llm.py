"""Small tests of the llm operators against brute force, and of odd rows: nulls, empty and long texts, ties, repeats, no rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from weftline.llm import decontamination, encoding, graph, language_model, licences, media, mixing, quality, simhash, token_counts, token_output, toxicity
from weftline.llm.words import ALNUM, SPACED, blocks, words_of

#: The tables' columns and, beside them, names that operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, block string, fp string, row string, rank string, a string"
VOCABULARY = [a + b for a in ("ka", "lo", "Mi", "zé", "tu") for b in ("ran", "SOL", "ß", "x1", "dé.", "!", "n't")]


def sample(seed=0, n=60):
    rng, rows = random.Random(seed), []
    for i in range(n):
        text = " ".join(rng.choice(VOCABULARY) for _ in range(rng.randrange(1, 40)))
        rows.append((i, text.replace(" ", "\n", 1), f"s{i % 3 if i % 2 else 0}"))
    rows += [(100, None, "s1"), (101, "", "s1"), (102, " \t\n", None), (103, rows[3][1], None), (104, rows[3][1] + " more", "s2"), (None, "null id words here", "s1")]
    rows += [(105, " ".join(rng.choice(VOCABULARY) for _ in range(30_000)), "s2"), (5, rows[5][1], rows[5][2]), (106, "́ a b  ｗide 文字 <|endoftext|> T̈ don't ÷ 12 (x)", "s1")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, sample())


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", "z", "f", "r", "k", "a") for i, t, s in rows], SCHEMA)


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", fold(text))


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))


def test_words_match_regular_expressions():
    texts = [t for _, t, _ in sample()] + ["a\x00b\x1fc\x7fd"]
    for kind, plain in ((SPACED, spaced), (ALNUM, alnum)):
        got = []
        for _, _, data, offsets in blocks(pa.array(texts), 300):
            w = words_of(data, offsets, kind)
            for k in range(len(offsets) - 1):
                got.append([w.word(i).decode() for i in range(w.first[k], w.first[k + 1])])
        assert got == [plain(t) for t in texts]


def test_windows_are_equal_where_words_are():
    data = np.frombuffer(b"a b c a b d a b c", np.uint8)
    w = words_of(data, np.array([0, len(data)]))
    got, whole = w.windows(3)
    assert whole.all() and got[0] == got[6] and len(set(got.tolist())) == 6


def test_mixing_meets_targets(docs):
    rows = mixing.mixed_sizes(docs, rows_per_block=4, shard_words=2000).collect()
    assert len(rows) == docs.count()
    source = {(r.doc_id, len(spaced(r.text))): r.source for r in docs.collect()}
    by = collections.defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        by[source[r.doc_id, r["size"]]].append(r)
    sizes = {s: sum(r["size"] for r in v) for s, v in by.items()}
    weights = dict(zip(sorted((s for s in sizes if s is not None)) + [None], (3, 1, 2, 3), strict=True))
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(sizes)
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] <= level * weights[s]}
        for s in full or open_:
            target[s] = 2.0 * sizes[s] if full else level * weights[s]
        left -= sum(2 * sizes[s] for s in full)
        open_ = open_ - full if full else set()
    for s, v in by.items():
        assert v[0].source_size == sizes[s] and v[0].target == pytest.approx(target[s])
        assert abs(sum(r.taken for r in v) - target[s]) <= 2
    assert {tuple(r) for r in rows} == {tuple(r) for r in mixing.mixed_sizes(docs, rows_per_block=4, shard_words=2000).collect()}


def test_mixing_without_rows_and_without_words(spark, docs):
    assert mixing.mixed_sizes(docs.limit(0)).count() == 0
    assert mixing.mix(docs.limit(0)).columns == docs.columns
    rows = mixing.mixed_sizes(frame(spark, [(1, None, None), (2, "", None)])).collect()
    assert [(r["size"], r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2


def test_mix_repeats_whole_rows(docs):
    out = mixing.mix(docs, rows_per_block=4, shard_words=2000)
    assert out.columns == docs.columns
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    counts = collections.Counter((r.doc_id, r.text) for r in out.collect())
    assert set(counts) <= texts and max(counts.values()) <= 4  # doc 5 stands twice


def test_splitting_tree_keeps_quotas(spark):
    nodes = spark.createDataFrame([(1, [40, 7, 0, 300])], "node long, quotas array<bigint>")
    for _ in range(4):
        nodes = mixing._split(nodes, 9)
    rows = [r.quotas for r in nodes.collect()]
    assert len(rows) == 16 and [sum(c) for c in zip(*rows, strict=True)] == [40, 7, 0, 300]
    assert max(map(sum, rows)) - min(map(sum, rows)) <= 1 and min(map(min, rows)) >= 0
    many = spark.range(1, 4000).selectExpr("id as node", "array(6L, 4L) as quotas")
    left = [r.quotas[0] for r in mixing._split(many, 1).filter("node % 2 = 0").collect()]
    expect = [math.comb(6, k) * (math.comb(4, 5 - k) if k < 6 else 0) / math.comb(10, 5) for k in range(7)]
    for k in range(7):
        assert abs(left.count(k) / len(left) - expect[k]) < 0.03


def test_token_counts(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encoding.default_path())
    lengths = sorted(len(t.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect())
    hist = token_counts.histogram(docs)
    rows = [r for r in token_counts.limits(hist).collect() if r.whole]
    assert sorted(r.length for r in rows) == sorted(set(lengths))
    for r in rows:
        assert r.n_docs == lengths.count(r.length) and r.n_beyond == sum(x > r.length for x in lengths)
        assert r.truncated_total == sum(min(x, r.length) for x in lengths)
    assert token_counts.at_limit(hist, 17).filter("whole").first().truncated_total == sum(min(x, 17) for x in lengths)
    assert token_counts.limits(token_counts.histogram(docs.limit(0))).count() == 0


@pytest.mark.parametrize("bits", [False, True])
def test_token_files_round_trip(docs, bits):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encoding.default_path())
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()), key=lambda r: r[:2])
    got = sorted(token_output.write_and_read(docs, bits=bits).collect(), key=lambda r: r.start)
    at = 0
    for (_, doc_id, text), r in zip(rows, got, strict=True):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        assert ((r.doc_id or 0), r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_output.write_and_read(docs.limit(0)).count() == 0


def fingerprint(text):
    w = spaced(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(docs):
    rows = docs.collect()
    got = collections.defaultdict(list)
    for r in simhash.duplicates(docs).collect():
        got[r.doc_id].append(r)
    prints = [(r.doc_id, fingerprint(r.text)) for r in rows]
    comp = {i: i for i in range(len(prints))}
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 4:
                a, b = comp[i], comp[j]
                comp = {k: b if v == a else v for k, v in comp.items()}
    for i, (doc_id, fp) in enumerate(prints):
        ids = [prints[k][0] for k in comp if comp[k] == comp[i] and prints[k][0] is not None]
        assert (f"{fp:016x}", min(ids, default=None)) in {(r.fingerprint, r.component_id) for r in got[doc_id]}
    assert simhash.duplicates(docs.limit(0)).count() == 0
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(comp.values()))
    assert simhash.deduplicate(docs.limit(0)).count() == 0


def test_simhash_large_buckets_and_uneven_thresholds(spark):
    rng = random.Random(1)
    centre = [rng.getrandbits(64) for _ in range(40)]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 6))) for c in centre for _ in range(30)} | set(range(200))
    fps = np.array(sorted(values), np.uint64)
    prints = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    roots = {r.id: r.root for r in graph.components(simhash.links(prints, bucket=16)).collect()}
    comp = list(range(len(fps)))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 4).tolist():
            a, b = comp[i], comp[j]
            comp = [b if c == a else c for c in comp]
    names = [roots.get(x, x) for x in fps.view(np.int64).tolist()]
    assert len(set(zip(comp, names, strict=True))) == len(set(comp)) == len(set(names))
    even = (np.full((64, 64), 0.25) + np.eye(64) * 0.25) * 1e9
    plan = simhash.allocate(even, 10**9)
    assert sum(t + 1 for _, t in plan) == 5 and len({t for _, t in plan}) > 1
    assert simhash.group_bits(np.eye(64) * 50, 100, 4)[0] != []


def test_probes_with_thresholds_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "allocate", lambda both, n, distance: [(list(range(0, 20)), 1), (list(range(20, 64)), 2)])
    rng = random.Random(2)
    pairs = [(c, c ^ sum(1 << b for b in rng.sample(range(64), 4))) for c in (rng.getrandbits(64) for _ in range(30))]
    fps = np.array([x for p in pairs for x in p], np.uint64).view(np.int64)
    got = graph.components(simhash.links(spark.createDataFrame([(int(x),) for x in fps], "fp long")))
    assert got.count() == 30


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.id: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 130)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_hits(text, items):
    w, hit, names = alnum(text), set(), set()
    for name, item in items:
        v = alnum(item)
        n = min(10, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                names.add(name)
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize("limit", [decontamination.BUILT_BYTES, 0])
def test_decontamination(spark, docs, limit):
    rows = docs.collect()
    long = next(r.text for r in rows if r.doc_id == 105)
    items = [("1", " ".join(alnum(long)[50:75])), ("10", rows[4].text), ("2", "LORAN"), ("3", ""), ("4", None), ("5", "words, here"), ("", rows[7].text), ("1", "x " + (rows[9].text or ""))]
    bench = spark.createDataFrame([(int(n) if n else None, t) for n, t in items], "item_id long, text string")
    got = decontamination.report(docs, bench, built_bytes=limit).collect()
    want = []
    for r in rows:
        n, hit, names = brute_hits(r.text, items)
        want.append((-1 if r.doc_id is None else r.doc_id, n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0))
    assert sorted(((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got), key=str) == sorted(want, key=str)
    clean = decontamination.decontaminate(docs, bench, built_bytes=limit)
    assert clean.columns == docs.columns and clean.count() == sum(not w[2] for w in want)
    cut = decontamination.decontaminate(docs, bench, remove="spans", built_bytes=limit).collect()
    left = {(r.doc_id, len(alnum(r.text))) for r in cut}
    assert left == {((None if w[0] == -1 else w[0]), w[1] - w[2]) for w in want}
    assert decontamination.report(docs, bench.limit(0), built_bytes=limit).filter("contaminated").count() == 0
    assert decontamination.report(docs.limit(0), bench, built_bytes=limit).count() == 0


def test_media_round_trip(spark, docs):
    folder, manifest = media.write_archives(docs, archive_bytes=2000)
    assert manifest.count() > 1
    rows = media.facts(media.read_archives(spark, folder, range_bytes=700)).collect()
    want = collections.Counter()
    for r in docs.collect():
        p = media.payload_of((r.text or "").encode())
        want[r.doc_id, len((r.text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert collections.Counter(tuple(r)[:5] for r in rows) == want
    assert media.store_and_read(docs.limit(0)).count() == 0
    assert media.from_png(media.to_png(bytes(range(256)))) == bytes(range(256))


def test_media_damage_is_reported(spark, docs):
    folder, manifest = media.write_archives(docs.filter("doc_id < 3").coalesce(1))
    path = manifest.first().path.removeprefix("file://").removeprefix("file:")
    raw = bytearray(open(path, "rb").read())
    raw[60] ^= 255
    open(path, "wb").write(raw)
    rows = media.read_archives(spark, folder).collect()
    assert sorted(r.error is None for r in rows) == [False, True, True]


def test_licences(spark):
    texts = {
        1: "x. Licensed under the Apache License, Version 2.0. CC BY", 2: "all rights reserved ALL RIGHTS RESERVED!", 3: None, 4: "", 5: "Licensed under the Apache License, Version 3.0",
        6: "This work is licensed under the GNU Lesser General Public License, version 3", 7: "Copyright 2020 Some Body. All rights reserved.", 8: "all rights" + " word" * 20_000 + " cc by", 9: "cc bye general public licenses",
    }
    got = {r.doc_id: r for r in licences.scan(frame(spark, [(k, t, "s") for k, t in texts.items()])).collect()}
    facts = {k: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for k, r in got.items()}
    assert facts[1] == (11, 1, 9, 9, "cc-by", "apache-2.0,cc-by", 1.0)
    assert facts[2] == (6, 2, 0, 3, "reserved", "reserved", 0.5)
    assert facts[3] == facts[4] == (0, 0, None, None, "", "", 0.0)
    assert facts[5][5] == "" and facts[6][5] == "gpl,gpl-notice" and facts[7][5] == "reserved,rights-notice"
    assert facts[8][:4] == (20_004, 1, 20_002, 20_002) and facts[9][1] == 0
    assert licences.scan(frame(spark, [])).count() == 0


def template_pattern(template):
    """A template as a regular expression over words that each have a space behind them."""
    out = ""
    for optional, least, most, word in re.findall(r"\[\[(.*?)\]\]|\{\{(\d+)-(\d+)\}\}|(\S+)", template):
        out += f"(?:{optional} )?" if optional else rf"(?:\S+ ){{{least},{most}}}" if most else f"{word} "
    return re.compile(r"(?<!\S)" + out)


def test_licences_against_regular_expressions(spark):
    rng, texts = random.Random(4), []
    for label, _, template in licences.TEMPLATES:
        for turn in range(8):
            text = re.sub(r"\[\[(.*?)\]\]", lambda m: m[1] if rng.random() < 0.5 else "", template)
            text = re.sub(r"\{\{(\d+)-(\d+)\}\}", lambda m: " ".join(["Body"] * (rng.randint(int(m[1]), int(m[2])) if turn == 0 or rng.random() < 0.8 else 13)), text)
            words = text.split()
            if turn and rng.random() < 0.4:
                words[rng.randrange(len(words))] = rng.choice(["", "other", "the"])
            if turn and rng.random() < 0.2:
                words = words[: rng.randrange(1, len(words))]
            filler = [rng.choice(["all", "rights", "reserved", "licensed", "cc", "by", "copyright", "0", "permission"]) for _ in range(rng.randrange(8))]
            texts.append(rng.choice([" ", ", ", " - "]).join(filler + words + filler))
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in licences.scan(frame(spark, rows)).collect()}
    seen = set()
    for k, t, _ in rows:
        w = alnum(t)
        places = {i: label for p, label in licences.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()}
        n_base = sum(w[i : i + len(p.split())] == p.split() for p in licences.PHRASES for i in range(len(w)))
        line = "".join(x + " " for x in w)
        more = {label: score for label, score, template in licences.TEMPLATES if template_pattern(template).search(line)}
        seen |= set(more)
        want = (len(w), n_base, min(places, default=None), max(places, default=None), ",".join(sorted(set(places.values()))), ",".join(sorted(set(places.values()) | set(more))), max([*more.values(), 0.5 if places else 0.0]))
        assert tuple(got[k])[1:] == want, t
    assert seen == {label for label, _, _ in licences.TEMPLATES}


def test_automaton_regions():
    a = licences.Automaton("x", 1.0, "one [[two three]] four {{1-2}} end")
    for text, want in (("one four q end", 1), ("one two three four p q end", 1), ("one two four q end", 0), ("one four end", 0), ("one four p q r end", 0)):
        raw = np.frombuffer(text.encode(), np.uint8)
        w = words_of(raw, np.array([0, len(raw)]))
        assert a.accepts(w, 0, len(w.starts)) == bool(want), text
    with pytest.raises(ValueError):
        licences.Automaton("x", 1.0, "{{0-2}} end")


def brute_model(texts, order):
    """p(word | context) of an interpolated Kneser-Ney model with counts in dictionaries, its discounts, and raw word counts."""
    raw = collections.Counter(w for t in texts for w in t)
    grams = collections.Counter(tuple(p[i : i + order]) for t in texts for p in [["<s>"] * (order - 1) + t] for i in range(len(t)))
    levels = {order: grams}
    for k in range(order - 1, 0, -1):
        levels[k] = collections.Counter(g[1:] for g in levels[k + 1])
    discounts = {k: (0, *language_model.Discounts.of([sum(c == n for c in v.values()) for n in (1, 2, 3, 4)])) for k, v in levels.items()}
    follow = {k: collections.defaultdict(list) for k in levels}
    for k, v in levels.items():
        for g, c in v.items():
            follow[k][g[:-1]].append(c)

    def p(context, word):
        k = len(context) + 1
        below = p(context[1:], word) if context else 1 / (len(raw) + 1)
        seen = follow[k].get(context)
        if not seen:
            return below
        d, c = discounts[k], levels[k][*context, word]
        return (max(c - d[min(c, 3)], 0) + sum(d[min(x, 3)] for x in seen) * below) / sum(seen)

    return p, discounts, raw


@pytest.mark.parametrize(("order", "shard_tokens", "direct"), [(1, 500, 256), (2, 10**6, 256), (2, 500, 256), (2, 500, 0), (3, 10**6, 0), (3, 500, 256), (3, 500, 0), (4, 400, 0)])
def test_language_model(docs, order, shard_tokens, direct, monkeypatch):
    monkeypatch.setattr(language_model, "WIDE", 3)
    monkeypatch.setattr(language_model, "DIRECT_SHARDS", direct)
    held_out = F.col("doc_id").isin(1, 2, 105)
    rows = [(r.doc_id, [*spaced(r.text), "</s>"]) for r in docs.collect()]
    p, discounts, uni = brute_model([t for i, t in rows if i not in (1, 2, 105) and i is not None], order)
    model = language_model.train(docs.filter(~held_out & F.col("doc_id").isNotNull()), order, shard_tokens=shard_tokens)
    assert [(0, *d) for d in model.discounts] == [discounts[k] for k in range(1, order + 1)]
    assert (len(model.spread) > 0) == (shard_tokens < 10**6 and order > 1)
    assert len(model.grams) == (model.shards if direct else 0) and (model.shards > 0) == (order > 1)
    for context in (("<s>", "<s>", "<s>"), ("kaß", "turan", "never seen"), ("never seen", "loran", "kaß")):
        context = context[len(context) - order + 1 :]
        assert sum(p(context, b) for b in uni) + p(context, "never seen") == pytest.approx(1)
    total = sum(uni.values())
    want = collections.Counter()
    for i, t in rows:
        base = sum(math.log10((uni[b] + 1) / (total + len(uni) + 1)) for b in t)
        padded = ["<s>"] * (order - 1) + t
        score = sum(math.log10(p(tuple(padded[j : j + order - 1]), b)) for j, b in enumerate(t))
        want[i, len(t), sum(uni[b] > 0 for b in t), total, round(base, 4), round(score, 4)] += 1
    got = language_model.score_with(docs, model, F.coalesce(held_out, F.lit(False))).collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in got) == want


def test_language_model_tables_keep_large_counts_and_wide_contexts():
    rng = np.random.default_rng(1)
    word = rng.permutation(3000).astype(np.uint64) + np.uint64(1 << 23)
    ctx = np.repeat(rng.integers(0, 1 << 63, 60, dtype=np.uint64), np.concatenate([[900, 256, 255], np.full(56, 28), [21]]))
    counts = np.where(rng.random(3000) < 0.1, rng.integers(200, 100_000, 3000), rng.integers(1, 5, 3000))
    mixed = rng.permutation(3000)
    f = language_model.table("3.", ctx[mixed], word[mixed], counts[mixed])
    order = np.argsort(ctx & np.uint64((1 << 40) - 1), kind="stable")
    got, stats = language_model.look_up(f, "3.", ctx[order], word[order])
    assert (got == counts[order]).all()
    for c in np.unique(ctx):
        mine = counts[ctx == c]
        assert stats[ctx[order] == c][0].tolist() == [mine.sum(), (mine == 1).sum(), (mine == 2).sum(), (mine > 2).sum()]
    none, empty = language_model.look_up(f, "3.", ctx[order] ^ np.uint64(1), word[order])
    assert not none.any() and not empty.any()
    assert not language_model.look_up(f, "3.", ctx[order], word[order] ^ np.uint64(1 << 22))[0].any()


def test_language_model_without_rows(docs):
    assert language_model.score(docs.limit(0)).count() == 0
    empty = language_model.train(docs.limit(0))
    r = language_model.score_with(docs.filter("doc_id = 1"), empty, F.lit(True)).first()
    assert r.n_known == 0 and r.base_score == 0.0 and math.isfinite(r.score)


def labelled(spark, n=400):
    rng, rows, labels = random.Random(3), [], []
    for i in range(n):
        words = [rng.choice(VOCABULARY) for _ in range(rng.randrange(20, 60))]
        good, toxic = rng.random() < 0.7, rng.random() < 0.3
        if not good:
            words = [w.upper() + "!!" for w in words]
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["vilesome", "vileful", "grub"]))
        rows.append((i, ". ".join(" ".join(words[k : k + 8]) for k in range(0, len(words), 8)), "s"))
        if i % 4 != 1:
            labels.append((i, int(good), int(toxic)))
    rows += [(1000, None, "s"), (1001, "", None), (None, "no id", "s"), (1002, "long " * 50_000, "s"), (7, rows[7][1], "s")]
    labels += [(1000, None, None), (None, 1, 1), (5000, 1, 1), (labels[0])]
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_classifiers_on_held_out_rows(spark, name):
    docs, labels = labelled(spark)
    got = (quality.score if name == "quality" else toxicity.score)(docs, labels).collect()
    known = {r.doc_id: r[name] for r in labels.collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0)
        assert r.predicted == int(r.score >= (0.3 if name == "quality" else 0.5))
    held = [r for r in got if r.held_out and known.get(r.doc_id) is not None]
    assert sum(r.predicted == known[r.doc_id] for r in held) / len(held) > 0.95


def test_toxicity_locates_the_sentence(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    text = "Kaß lo ran. Tu vilesome grub! kaSOL"
    r = frame(spark, [(1, text, "s")]).select(toxicity.scorer(model)(F.col("text")).alias("r")).first().r
    assert r.n_sentences == 3 and r.worst == 1 and text.encode()[r.worst_start : r.worst_end] == b"Tu vilesome grub"


def test_classifiers_without_labels_or_rows(spark):
    docs, labels = labelled(spark, 20)
    for module in (quality, toxicity):
        assert module.score(docs.limit(0), labels).count() == 0
        assert {0 <= r.score <= 1 for r in module.score(docs, labels.limit(0)).collect()} == {True}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns


def test_quality_against_plain_numpy(spark):
    docs, labels = labelled(spark)
    x = docs.select("doc_id", quality.statistics()(F.col("text")).alias("x"))
    model = quality.train(x, labels)
    rows = [(r.x, r.y) for r in x.join(labels.filter("quality is not null"), "doc_id").select("x", F.col("quality").alias("y"), "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    a, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    assert model.mean == pytest.approx(a.mean(0)) and 1 / model.scale == pytest.approx(np.maximum(a.std(0), 1e-6), rel=1e-6)
    z = model.project(a)
    plain = np.linalg.solve(z.T @ z + np.diag([quality.RIDGE * len(y) + 1e-9] * quality.FEATURES + [1e-9]), z.T @ y)
    assert model.raw(a) == pytest.approx(z @ plain, abs=1e-5)
    bins = np.clip(((model.raw(a) + 1) / 3 * quality.BINS).astype(int), 0, quality.BINS - 1)
    groups = [[b, b, sum(bins == b), y[bins == b].sum()] for b in sorted(set(bins))]  # runs of bins: first, last, weight, sum
    while any(groups[i][3] / groups[i][2] >= groups[i + 1][3] / groups[i + 1][2] for i in range(len(groups) - 1)):
        i = next(i for i in range(len(groups) - 1) if groups[i][3] / groups[i][2] >= groups[i + 1][3] / groups[i + 1][2])
        groups[i : i + 2] = [[groups[i][0], groups[i + 1][1], groups[i][2] + groups[i + 1][2], groups[i][3] + groups[i + 1][3]]]
    assert model.steps[1] == pytest.approx([g[3] / g[2] for g in groups])
    scored = {r.doc_id: r.score for r in quality.score(docs, labels).collect()}
    for r in x.filter("doc_id < 40").collect():
        assert scored[r.doc_id] == pytest.approx(float(np.clip(np.interp(model.raw(np.array([r.x])), *model.steps), 0, 1)[0]), abs=1e-4)
    kept = collections.Counter(r.doc_id for r in quality.keep_good(docs, labels).select("doc_id").collect())
    assert kept == collections.Counter(r.doc_id for r in quality.score(docs, labels).collect() if r.predicted)


def test_toxicity_against_loops():
    rng = np.random.default_rng(0)
    weights, bias = rng.normal(0, 1, 12), -1.5
    bags = [[rng.choice(12, rng.integers(1, 4)).tolist() for _ in range(rng.integers(0, 5))] for _ in range(30)]
    y, empty = rng.random(30) < 0.5, rng.integers(0, 3, 30)
    pairs = [np.array([(s, k) for s, words in enumerate(b) for k in words], np.int32).reshape(-1, 2).tobytes() for b in bags]

    def loss(w, c):
        total = 0.0
        for b, toxic, more in zip(bags, y, empty, strict=True):
            clean = 1.0
            for words in [*b, *[[]] * int(more)]:
                clean *= 1 - 1 / (1 + math.exp(-(c + sum(w[k] for k in words))))
            total += math.log(1 - clean) if toxic and clean < 1 else math.log(clean) if not toxic else 0.0
        return total

    some = np.array([bool(b) or bool(e) for b, e in zip(bags, empty, strict=True)])
    got = toxicity.gradient_of(y[some], empty[some], [p for p, k in zip(pairs, some, strict=True) if k], weights, bias)
    for k in range(13):
        step = np.zeros(13)
        step[k] = 1e-5
        slope = (loss(weights + step[:-1], bias + step[-1]) - loss(weights - step[:-1], bias - step[-1])) / 2e-5
        assert got[k] == pytest.approx(slope, abs=1e-5)


def test_toxicity_score_against_loops(spark):
    docs, labels = labelled(spark, 60)
    model = toxicity.train(docs, labels)

    def hashed(word):
        raw = np.frombuffer(word.encode(), np.uint8)
        w = words_of(raw, np.array([0, len(raw)]), ALNUM)
        return [int(h[0]) >> 46 for h in (w.hashes, *[w.prefixes(n) for n in toxicity.PREFIXES])]

    got = {(r.doc_id, r.n_sentences): r for r in toxicity.score(docs, labels).collect()}
    for d in docs.filter("doc_id < 60 or doc_id > 999").collect():
        clean, sentences = 1.0, [alnum(x) for x in re.split(r"[.!?\n]", d.text or "")]
        sentences = [x for x in sentences if x]
        for words in sentences:
            clean *= 1 - 1 / (1 + math.exp(-min(30, max(-30, model.bias + sum(float(model.weights[b]) for w in words for b in hashed(w))))))
        r = got[d.doc_id, len(sentences)]
        assert r.score == pytest.approx(1 - clean, abs=2e-5)


def test_isotonic_pooling():
    at, mean = quality.pool(np.ones(5), np.array([0.0, 1, 0, 1, 1]), np.arange(5.0))
    assert mean.tolist() == [0, 0.5, 1] and at.tolist() == [0, 1.5, 3.5]


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, _found string, row string, fp string, block string, `order` string, d string, `x``y` string"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "q", "f", "r", "p", "b", "o", "d", "xy") for i, t, s in rows], CLASHING)


def test_stages_keep_odd_rows_and_clashing_columns(spark, tmp_path):
    """Null, empty, very long and repeated texts, null and repeated ids, no rows, and columns named like those of the operators."""
    import corpus_pipeline

    rng = random.Random(9)
    words = [a + b for a in ("ka", "lo", "mi", "zé", "tu", "ba") for b in ("ran", "sol", "ß", "x1", "dé", "n't")]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(20, 60))) + ".", f"s{i % 3}" if i % 7 else None) for i in range(60)]
    rows += [(60, None, "s1"), (61, "", "s1"), (None, rows[3][1] + " more", "s2"), (None, "null id words here", "s1"), (None, "null id words here", "s1"), (5, "another text of this id", "s0"), (7, rows[7][1], "s1")]
    rows += [(62, " ".join(rng.choice(words) for _ in range(40_000)), "s2"), (63, rows[4][1], "s0"), (64, rows[4][1], "s1")]
    bench = spark.createDataFrame([(1, " ".join(alnum(rows[8][1])[:12])), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, 0, 0)], "doc_id long, quality int, toxic int")
    for name, table in (("benchmark", bench), ("labels", labels)):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    for docs in (clashing(spark, rows), clashing(spark, rows).limit(0), clashing(spark, [(1, None, None)] * 3)):
        kept = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = collections.Counter(tuple(r) for r in kept.collect())
            kept = stage(spark, kept, str(tmp_path))
            assert kept.columns == docs.columns, name
            after = collections.Counter(tuple(r) for r in kept.collect())
            assert set(after) <= set(before), name
            if name == "SimHash near-dedup":
                prints = {t: fingerprint(t) for _, t, *_ in before}
                todo, groups = set(prints.values()), 0
                while todo:
                    groups, near = groups + 1, [todo.pop()]
                    while near:
                        x = near.pop()
                        found = {y for y in todo if (x ^ y).bit_count() <= simhash.DISTANCE}
                        todo -= found
                        near += found
                assert sum(after.values()) == groups
            elif name == "benchmark decontamination":
                assert after == collections.Counter({r: n for r, n in before.items() if not brute_hits(r[1], [("1", bench.first().text)])[1]})
            elif name == "mixing sources":
                assert all(n <= 3 * before[r] for r, n in after.items())
        tokens = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).collect()
        assert len(tokens) == sum(after.values())
        docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(tokens)


def test_ids_are_integers_or_their_text(spark):
    text = spark.createDataFrame([("3", "a b"), ("11", "c")], "doc_id string, text string")
    assert sorted(r.doc_id for r in token_output.write_and_read(text).collect()) == sorted(r.doc_id for r in media.store_and_read(text).collect()) == [3, 11]
    assert sorted(r.doc_id for r in language_model.score(text).collect()) == [3, 11]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        media.store_and_read(spark.createDataFrame([("x", "a")], "doc_id string, text string")).collect()


def test_documents_without_an_id_are_spread_over_blocks(spark):
    rows = [(None, f"word{i} " * (i % 5 + 1), "s") for i in range(400)]
    sizes, _, _, _ = mixing.plan(frame(spark, rows).select("doc_id", "source", "text"), rows_per_block=20)
    counts = [r["count"] for r in sizes.groupBy("block").count().collect()]
    assert len(counts) == 20 and max(counts) < 60


def test_near_duplicates_are_fingerprinted_once(spark):
    docs = frame(spark, sample(1, 30))
    plan = simhash.deduplicate(docs)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "CartesianProduct" not in plan


def test_pipeline_is_its_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == names
    want = collections.Counter(r.doc_id for r in docs.select("doc_id").collect())
    got = corpus_pipeline.run(spark, sf).collect()
    assert collections.Counter(r.doc_id for r in got) == want and len(want) > 50
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


@pytest.mark.parametrize("most", [1 << 20, 1 << 26, (1 << 32) - 1])
def test_followers_of_any_number_are_told_apart(most):
    """Words whose numbers agree in their low 24 bits, in contexts of few and of many followers."""
    rng = np.random.default_rng(most)
    ctx = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    rows = {}
    for i, c in enumerate(ctx.tolist()):
        base = int(rng.integers(1, 1 << 19))
        for w in {base, (base + (1 << 24)) % most, (base + (3 << 24)) % most, *rng.integers(1, most, 2 if i % 20 else 600).tolist()}:
            rows[c, w] = int(rng.integers(1, 400))
    keys = list(rows)
    f = language_model.table("3.", np.array([c for c, _ in keys], np.uint64), np.array([w for _, w in keys], np.uint64), np.array(list(rows.values())))
    assert ("3.x" in f) == (max(w for _, w in keys) >= 1 << 24)
    asked = sorted({(c, (w + d) % (1 << 32)) for c, w in keys[::3] for d in (0, 1 << 24, 1 << 25, 7)} | set(keys), key=lambda k: (k[0] & ((1 << 40) - 1), k))
    count, stats = language_model.look_up(f, "3.", np.array([c for c, _ in asked], np.uint64), np.array([w for _, w in asked], np.uint64))
    assert count.tolist() == [rows.get(k, 0) for k in asked]
    total = {}
    for (c, _), n in rows.items():
        total[c] = total.get(c, 0) + n
    assert stats[:, 0].tolist() == [total[c] for c, _ in asked]


def test_rows_without_an_id_are_dealt_to_many_files(spark):
    docs = frame(spark, [(None if i % 4 else 7, f"text number {i} " * 50, "s") for i in range(400)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = token_output.write(docs)
        assert manifest.count() > 2 and manifest.agg(F.max("n_docs")).first()[0] < 300
        rows = token_output.read(manifest).orderBy("start").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.doc_id for r in rows] == [None] * 300 + [7] * 100
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
