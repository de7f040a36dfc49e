"""Benchmark decontamination: find benchmark word windows in documents; report them, or remove the spans or the documents.

Benchmark items are cut into windows of ten words (a shorter item is one window). While the hash set of their windows takes at most
``BUILT_BYTES`` (known from the counts of bytes and words beforehand), one task writes it to the shared folder as sorted arrays,
which every executor maps into memory once, and every document is scanned where it lies, without a shuffle. Beyond that size the
windows of documents that a bitmap of the benchmark's hashes lets through are joined with those of the benchmark, and only the
candidates' positions travel back to their texts. Either way each hit is confirmed on the words themselves.

Null texts have no words. Items without words never occur. Rows with the same item_id are one item, a null item_id is the item
named by the empty text. Repeated documents give repeated rows. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_again, whole_row
from .shared import Arrays, as_table, bounded_batches, cut_lineage, make_dir, shared_dir
from .words import ALNUM, Words, blocks, words_of

WINDOW, BUILT_BYTES = 10, 128 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Arrays take a byte for each byte of text, and for each word its place (8), a window's hash (8), place and item (4 each) and bits (4).
WORD_BYTES = 28
#: The bitmap of a large benchmark: 16 files of 2^26 bits.
CHUNKS, CHUNK_BITS = 16, 26
FOUND = "struct<n_words:bigint,n_hit:bigint,items:array<string>,text:string>"


def _bits_of(places: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of ``size`` bits with these set."""
    out = np.zeros(size, bool)
    out[places] = True
    return np.packbits(out, bitorder="little")


def _has_bit(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bitmap[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1 == 1


def build(batches: Iterator[tuple[list[str], pa.Array]], window: int = WINDOW) -> dict[str, np.ndarray]:
    """Arrays of the windows of (names, texts): all words in order, each with a space behind it, and where each begins; names; for
    each length of window the sorted hashes, the first word and the item of each, and a bitmap of the hashes' high bits."""
    texts, lengths, names, found, words = [], [], [], {}, 0
    for got, column in batches:
        for row, stop, w, _ in _words(column):
            size, n_words, owner = w.ends - w.starts, np.diff(w.first), w.owner()
            to = np.cumsum(size + 1) - size - 1
            out = np.full(int((size + 1).sum()), 0x20, np.uint8)
            step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            out[np.repeat(to, size) + step] = w.folded[np.repeat(w.starts, size) + step]
            texts.append(out)
            lengths.append(size + 1)
            own = np.minimum(window, n_words)
            for n in np.unique(own[own > 0]).tolist():
                h, whole = w.windows(n)
                at = np.flatnonzero(whole & (own[owner[: len(h)]] == n))
                found.setdefault(n, []).append((h[at], (at + words).astype(np.uint32), (owner[at] + len(names)).astype(np.uint32)))
            words += len(owner)
            names += got[row:stop]
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    raw = [n.encode() for n in names]
    arrays = {"text": join(texts, np.uint8), "begin": np.concatenate([[0], np.cumsum(join(lengths, np.int64))]), "names": np.frombuffer(b"".join(raw), np.uint8), "name_at": np.concatenate([[0], np.cumsum([len(n) for n in raw])]).astype(np.int64)}
    for n, parts in found.items():
        h, at, item = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        h = h[order]
        bits = max(10, int(len(h) * 16).bit_length())
        arrays |= {f"h{n}": h, f"at{n}": at[order], f"item{n}": item[order], f"bits{n}": _bits_of(h >> np.uint64(64 - bits), 1 << bits)}
    return arrays


class Windows:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays, self.lengths = arrays, sorted(int(k[1:]) for k in arrays if k[0] == "h")

    def name(self, item: int) -> str:
        a, b = self.arrays["name_at"][item : item + 2].tolist()
        return self.arrays["names"][a:b].tobytes().decode()

    def hits(self, w: Words) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, length, items) of every occurrence."""
        text, begin = self.arrays["text"], self.arrays["begin"]
        for n in self.lengths:
            known, places, items, bits = (self.arrays[f"{k}{n}"] for k in ("h", "at", "item", "bits"))
            h, whole = w.windows(n)
            at = np.flatnonzero(whole)
            at = at[_has_bit(bits, h[at] >> np.uint64(64 - (len(bits) * 8).bit_length() + 1))]
            low, high = np.searchsorted(known, h[at], "left"), np.searchsorted(known, h[at], "right")
            for i, a, b in zip(at.tolist(), low.tolist(), high.tolist(), strict=True):
                if a == b:
                    continue
                mine = _joined(w, i, n)
                if got := {self.name(int(items[j])) for j in range(a, b) if text[begin[places[j]] : begin[places[j] + n] - 1].tobytes() == mine}:
                    yield i, n, got


@lru_cache(4)
def windows_in(uri: str) -> Windows:
    return Windows(Arrays.open(uri))


def _words(texts: pa.Array) -> Iterator[tuple[int, int, Words, np.ndarray]]:
    for row, stop, data, offsets in blocks(texts):
        yield row, stop, words_of(data, offsets, ALNUM), offsets


def _joined(w: Words, i: int, n: int) -> bytes:
    return b" ".join([w.word(k) for k in range(i, i + n)])


def _without(text: str | None, begin: int, w: Words, first: int, hit: np.ndarray) -> str:
    """The text without the stretches from the first to the last word of each run of hit words."""
    raw, at, keep = (text or "").encode(), 0, []
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    for a, b in edges.reshape(-1, 2):
        keep.append(raw[at : w.starts[first + a] - begin])
        at = w.ends[first + b - 1] - begin
    return b"".join([*keep, raw[at:]]).decode()


def _found(texts: pa.Array, hits_of, spans: bool) -> pa.Array:
    n_words, n_hit, items, cleaned = [], [], [], []
    for row, stop, w, offsets in _words(texts):
        hit, names = np.zeros(len(w.starts), bool), {}
        owner = w.owner()
        for i, n, got in hits_of(w, row, stop):
            hit[i : i + n] = True
            names.setdefault(int(owner[i]), set()).update(got)
        total = np.concatenate([[0], np.cumsum(hit)])
        per_row = total[w.first[1:]] - total[w.first[:-1]]
        n_words.append(np.diff(w.first))
        n_hit.append(per_row)
        items += [sorted(names.get(k, ())) for k in range(stop - row)]
        if spans:
            for k in range(stop - row):
                text = texts[row + k].as_py()
                cleaned.append(_without(text, int(offsets[k]), w, int(w.first[k]), hit[w.first[k] : w.first[k + 1]]) if per_row[k] else text)
    join = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
    cleaned = pa.array(cleaned if spans else [None] * len(texts), pa.string())
    return pa.StructArray.from_arrays([join(n_words), join(n_hit), pa.array(items, pa.list_(pa.string())), cleaned], ["n_words", "n_hit", "items", "text"])


def _named(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))


def scanner(benchmark: DataFrame, window: int = WINDOW, spans: bool = False):
    """A Column function text -> FOUND over the mapped arrays; call it only below the size limit, as one task builds them."""
    folder = shared_dir(benchmark.sparkSession, "windows")
    make_dir(folder)

    def save(batches):
        uri = f"{folder}/{uuid.uuid4().hex}"
        Arrays.write(uri, build(((b.column(0).to_pylist(), b.column(1)) for b in batches), window))
        yield pa.RecordBatch.from_arrays([pa.array([uri])], ["uri"])

    stored = cut_lineage(_named(benchmark).coalesce(1).mapInArrow(save, "uri string")).first()
    uri = stored[0] if stored else f"{folder}/empty"
    if not stored:  # a benchmark known to have no rows has no task
        Arrays.write(uri, build(iter(())))

    def scan(texts: pa.Array) -> pa.Array:
        return _found(texts, lambda w, row, stop: windows_in(uri).hits(w), spans)

    return F.arrow_udf(scan, FOUND)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, spans: bool = False, built_bytes: int = BUILT_BYTES) -> DataFrame:
    """``docs`` with one more column ``_found`` (FOUND; its text is only filled with ``spans``)."""
    bounded_batches()
    size = benchmark.agg(F.sum(F.octet_length("text") + WORD_BYTES * F.regexp_count("text", F.lit(WORD)))).first()[0] or 0
    if size <= built_bytes:
        return docs.withColumn("_found", scanner(benchmark, window, spans)(F.col("text")))
    return _find_by_join(docs, benchmark, window, spans)


def _bitmap(known: DataFrame) -> list[str]:
    """Files of a bitmap of all window hashes (h), one for each value of their highest four bits."""
    folder = shared_dir(known.sparkSession, "bitmap")
    make_dir(folder)

    def save(batches):
        maps: dict[int, np.ndarray] = {}
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64)
            chunk = h >> np.uint64(60)
            for c in np.unique(chunk).tolist():
                places = (h[chunk == c] >> np.uint64(60 - CHUNK_BITS)) & np.uint64((1 << CHUNK_BITS) - 1)
                maps[c] = maps.get(c, np.uint8(0)) | _bits_of(places, 1 << CHUNK_BITS)
        for c, bits in maps.items():
            uri = f"{folder}/{c}-{uuid.uuid4().hex}"
            Arrays.write(uri, {"bits": bits})
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([uri])], ["chunk", "uri"])

    rows = known.select("h").repartition(CHUNKS, F.shiftrightunsigned("h", 60)).mapInArrow(save, "chunk int, uri string")
    files = {r[0]: r[1] for r in cut_lineage(rows).collect()}
    return [files.get(c, "") for c in range(CHUNKS)]


def _may_be_in(files: list[str], h: np.ndarray) -> np.ndarray:
    out, chunk = np.zeros(len(h), bool), h >> np.uint64(60)
    for c in np.unique(chunk).tolist():
        if files[c]:
            here = np.flatnonzero(chunk == c)
            out[here] = _has_bit(Arrays.open(files[c])["bits"], (h[here] >> np.uint64(60 - CHUNK_BITS)) & np.uint64((1 << CHUNK_BITS) - 1))
    return out


def _find_by_join(docs: DataFrame, benchmark: DataFrame, window: int, spans: bool) -> DataFrame:
    """For benchmarks whose hash set is too large for one task. Texts are known by two hashes; equal texts are looked at once."""
    names = docs.columns
    key = [F.xxhash64("text").alias("_k1"), F.xxhash64(F.reverse("text"), F.lit(1)).alias("_k2")]

    def item_windows(batches):
        for b in batches:
            out: list[list] = [[], [], [], []]
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for _, _, w, _o in _words(pa.array([text], pa.string())):
                    if n := min(window, len(w.starts)):
                        for i, h in enumerate(w.windows(n)[0].view(np.int64).tolist()):
                            for col, v in zip(out, (n, h, _joined(w, i, n).decode(), name), strict=True):
                                col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], ["n", "h", "words", "item"])

    known = as_table(_named(benchmark).mapInArrow(item_windows, "n int, h long, words string, item string").groupBy("n", "h", "words").agg(F.collect_set("item").alias("items")))
    lengths = [r[0] for r in known.select("n").distinct().collect()]
    files = _bitmap(known)

    def doc_windows(batches):
        for b in batches:
            for row, _, w, _o in _words(b.column(0)):
                for n in lengths:
                    h, whole = w.windows(n)
                    at = np.flatnonzero(whole)
                    at = at[_may_be_in(files, h[at])]
                    rows = row + w.owner()[at]
                    yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(rows)), b.column(2).take(pa.array(rows)), pa.array(at - w.first[rows - row], pa.int32()), pa.array(np.full(len(at), n, np.int32)), pa.array(h[at].view(np.int64))], ["_k1", "_k2", "at", "n", "h"])

    texts = docs.select("text", *key).dropDuplicates(["_k1", "_k2"])
    seen = texts.mapInArrow(doc_windows, "_k1 long, _k2 long, at int, n int, h long")
    seen = seen.join(known, ["n", "h"]).groupBy("_k1", "_k2").agg(F.collect_list(F.struct("at", "n", "words", "items")).alias("_seen"))

    def confirm(text: pa.Array, candidates: pa.Array) -> pa.Array:
        lists = candidates.to_pylist()

        def hits(w: Words, row: int, stop: int):
            for k in range(row, stop):
                for c in lists[k] or ():
                    i = int(w.first[k - row]) + c["at"]
                    if _joined(w, i, c["n"]).decode() == c["words"]:
                        yield i, c["n"], c["items"]

        return _found(text, hits, spans)

    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "text", *key)
    out = keyed.join(seen, ["_k1", "_k2"], "left").withColumn("_found", F.arrow_udf(confirm, FOUND)(F.col("text"), F.col("_seen")))
    return out.select("_row.*", "_found")


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items."""
    found = find(docs.select("doc_id", "text"), benchmark, **options)
    items = F.array_sort("_found.items")
    return found.select("doc_id", "_found.n_words", "_found.n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (F.col("_found.n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", **options) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove='spans'``) with the hit stretches cut out of their texts."""
    found = find(docs.select(whole_row(docs), "text"), benchmark, spans=remove == "spans", **options)
    if remove == "documents":
        return row_again(found.filter("_found.n_hit = 0"), docs.columns)
    text = F.when(F.col("_found.n_hit") > 0, F.col("_found.text")).otherwise(F.col("text"))
    return found.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
