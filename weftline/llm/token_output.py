"""Token ids as files of bit-shuffled, compressed blocks, and back.

Documents are range-partitioned and sorted by doc_id, encoded, and each task writes one file in the shared folder. A file is a row
of frames and a chunk index at its end: ids lie in blocks of ``BLOCK`` ids; each block is transposed into byte planes (or bit
planes), and each plane is a zstandard frame of its own. Document ids and lengths are stored in the same way. A file's name is new
for each attempt and only files of finished tasks enter the manifest, so a repeated task leaves no double rows.

doc_ids are integers or their decimal text; other texts raise. doc_id null comes first; rows with the same doc_id follow each other in the order of their texts' hashes. A null or empty text is
just the end id. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import default_path, encoder
from .shared import bounded_batches, cut_lineage, make_dir, open_fs, shared_dir

MAGIC, BLOCK, END_ID = b"WFTTOK01", 1 << 16, 2
MANIFEST = "part int, path string, n_docs long, n_tokens long, n_bytes long"


def to_planes(values: np.ndarray, bits: bool = False) -> list[bytes]:
    """Byte planes (least first) or bit planes of fixed-width values."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    if not bits:
        return [p.tobytes() for p in planes]
    return [np.packbits((p >> k) & 1).tobytes() for p in planes for k in range(8)]


def from_planes(planes: list[bytes], n: int, dtype, bits: bool = False) -> np.ndarray:
    if bits:
        rows = [np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes]
        columns = [sum(rows[8 * b + k] << k for k in range(8)).astype(np.uint8) for b in range(len(rows) // 8)]
    else:
        columns = [np.frombuffer(p, np.uint8) for p in planes]
    return np.ascontiguousarray(np.stack(columns, axis=1)).view(dtype).ravel()


class Writer:
    """One file. Memory holds one block of ids and the index."""

    def __init__(self, out, bits: bool = False, level: int = 3):
        self.out, self.bits, self.at = out, bits, 0
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.index: list[dict] = []
        self.waiting, self.n_waiting, self.n_tokens = [], 0, 0
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def _block(self, kind: str, values: np.ndarray) -> None:
        entry = {"kind": kind, "n": len(values), "type": values.dtype.str, "at": self.at}
        entry["planes"] = [self._put(self.compress(p)) for p in to_planes(values, self.bits)]
        self.index.append(entry)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.waiting.append(ids)
        self.n_waiting += len(ids) // 4
        self.n_tokens += len(ids) // 4
        if self.n_waiting >= 4 * BLOCK:
            self._flush(False)
        if len(self.ids) >= BLOCK:
            self._documents()

    def _flush(self, all_of_it: bool) -> None:
        ids, at = np.frombuffer(b"".join(self.waiting), "<u4"), 0
        while at < len(ids) and (all_of_it or len(ids) - at >= BLOCK):
            self._block("ids", ids[at : at + BLOCK])
            at += BLOCK
        self.waiting = [ids[at:].tobytes()] if at < len(ids) else []
        self.n_waiting = max(0, len(ids) - at)

    def _documents(self) -> None:
        if self.ids:
            self._block("doc_null", np.array([i is None for i in self.ids], "u1"))
            self._block("doc_id", np.array([i or 0 for i in self.ids], "<i8"))
            self._block("doc_len", np.array(self.lengths, "<u4"))
        self.ids, self.lengths = [], []

    def close(self) -> None:
        self._flush(True)
        self._documents()
        index = self.compress(json.dumps({"bits": self.bits, "blocks": self.index}).encode())
        self._put(index)
        self._put(struct.pack("<Q", len(index)) + MAGIC)


class Reader:
    def __init__(self, f):
        self.f = f
        f.seek(f.size() - 16)
        length, magic = struct.unpack("<Q8s", f.read(16))
        if magic != MAGIC:
            raise ValueError("not a token file, or cut off")
        f.seek(f.size() - 16 - length)
        self.decompress = zstandard.ZstdDecompressor().decompress
        index = json.loads(self.decompress(f.read(length)))
        self.bits, self.index = index["bits"], index["blocks"]

    def blocks(self, kind: str) -> Iterator[np.ndarray]:
        for e in self.index:
            if e["kind"] == kind:
                self.f.seek(e["at"])
                data, at, planes = self.f.read(sum(e["planes"])), 0, []
                for n in e["planes"]:
                    planes.append(self.decompress(data[at : at + n]))
                    at += n
                yield from_planes(planes, e["n"], e["type"], self.bits)

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        """doc_id and ids of each document, with one block of ids in memory beside the document."""
        ids, have, at = self.blocks("ids"), b"", 0
        for nulls, names, lengths in zip(self.blocks("doc_null"), self.blocks("doc_id"), self.blocks("doc_len"), strict=True):
            for null, name, n in zip(nulls.tolist(), names.tolist(), lengths.tolist(), strict=True):
                if len(have) - at < 4 * n:
                    parts, got = [have[at:]], len(have) - at
                    while got < 4 * n:
                        parts.append(next(ids).tobytes())
                        got += len(parts[-1])
                    have, at = b"".join(parts), 0
                yield (None if null else name), have[at : at + 4 * n]
                at += 4 * n


def write(docs: DataFrame, path: str | None = None, end_id: int = END_ID, bits: bool = False, folder: str | None = None) -> DataFrame:
    """Encode and write all documents; the manifest (MANIFEST, one row per file, parts in ascending doc_id order), checkpointed."""
    folder, path = folder or shared_dir(docs.sparkSession, "tokens"), path or default_path()
    make_dir(folder)
    bounded_batches()
    end = struct.pack("<I", end_id)

    def save(batches):
        part, writer, name = TaskContext.get().partitionId(), None, f"{folder}/{uuid.uuid4().hex}.tok"
        where, file = open_fs(name)
        n_docs = 0
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                out = where.open_output_stream(file)
                writer = Writer(out, bits)
            for doc_id, ids in zip(b.column(0).to_pylist(), encoder(path).column(b.column(1)), strict=True):
                writer.add(doc_id, ids + end)
            n_docs += b.num_rows
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [name], "n_docs": [n_docs], "n_tokens": [writer.n_tokens], "n_bytes": [writer.at]})

    # rows without an id, or of one id, are dealt on by their texts
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*order).sortWithinPartitions(*order)
    return cut_lineage(rows.mapInArrow(save, MANIFEST))


def read(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Starts come from a running sum over the manifest, one row per file.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))

    def load(batches):
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                where, file = open_fs(name)
                with where.open_input_file(file) as f:
                    rows = []
                    for doc_id, ids in Reader(f).documents():
                        rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
                        start += len(ids) // 4
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    # a given number of partitions: the rows are tiny, and would else be merged into one task that reads every file
    return files.repartition(max(1, manifest.count()), F.col("path")).mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def write_and_read(docs: DataFrame, **options) -> DataFrame:
    return read(write(docs, **options))
