"""Media columns: payloads as 8-bit greyscale PNG images in ZIP archives, read back through a Spark data source of its own.

Writing: each task streams its documents into archives of about ``ARCHIVE_BYTES`` in the shared folder; only archives of finished
tasks enter the manifest. Reading: the data source plans byte ranges of the archives; a task opens its archive's directory (the list
at its end), reads the members whose header lies in its range, some megabytes at a time, and yields Arrow batches. A member that
can't be read is tried again alone by its offset; if that fails it comes as a row with an error and no bytes.

Null texts are empty; a payload is never empty. Repeated rows and doc_ids are stored and read once each; a null doc_id stays null.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared import bounded_batches, cut_lineage, make_dir, open_fs, read_bytes, shared_dir, write_bytes
from .words import flat

ROW, ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES, TRIES = 64, 64 << 20, 8 << 20, 4 << 20, 3
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
STORED = "archive string, offset long, doc_id long, n_bytes long, media binary, error string"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 6) -> bytes:
    """Rows of 64 samples, each after a filter byte 0."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    raw = np.zeros((len(rows), ROW + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at, data, shape = 8, [], (0, 0)
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            shape = struct.unpack_from(">II", body)
            if tuple(body[8:]) != (8, 0, 0, 0, 0):
                raise ValueError("only 8-bit greyscale images are read")
        elif kind == b"IDAT":
            data.append(body)
        at += n + 12
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] + 1)
    if raw[:, 0].any():
        raise ValueError("only unfiltered rows are read")
    return raw[:, 1:].tobytes()


def payload_of(text: bytes) -> bytes:
    return text.ljust(max(ROW, -(-len(text) // ROW) * ROW), b"\0")


def write_archives(docs: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> tuple[str, DataFrame]:
    """(folder, manifest): the manifest has one row per archive and is also stored beside the archives. doc_ids are integers or their
    decimal text; other texts raise."""
    folder = folder or shared_dir(docs.sparkSession, "media")
    make_dir(folder)
    bounded_batches()

    def save(batches):
        made, out, archive, n = [], None, None, 0

        def close():
            archive.close()
            made.append((path, n, out.tell()))
            out.close()

        for b in batches:
            data, offsets = flat(b.column(1))
            bounds = offsets.tolist()
            for k, doc_id in enumerate(b.column(0).to_pylist()):
                if out is None:
                    path, n = f"{folder}/{uuid.uuid4().hex}.zip", 0
                    where, file = open_fs(path)
                    out = where.open_output_stream(file)
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                text = data[bounds[k] : bounds[k + 1]].tobytes()
                archive.writestr(zipfile.ZipInfo(f"{n}/{'null' if doc_id is None else doc_id}/{len(text)}.png"), to_png(payload_of(text)))
                n += 1
                if out.tell() >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "n", "bytes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    manifest = cut_lineage(rows.mapInArrow(save, "path string, n long, bytes long"))
    listed = [(r["path"], r["bytes"]) for r in manifest.select("path", "bytes").collect()]
    write_bytes(f"{folder}/_manifest.json", json.dumps(sorted(listed)).encode())
    return folder, manifest


class Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int):
        self.folder, self.range_bytes = folder, range_bytes

    def partitions(self) -> list[Range]:
        out = []
        for path, size in json.loads(read_bytes(f"{self.folder}/_manifest.json")):
            out += [Range(path, a, min(size, a + self.range_bytes)) for a in range(0, size, self.range_bytes)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        where, file = open_fs(part.path)
        with where.open_input_file(file) as f:
            directory = zipfile.ZipFile(f).infolist()
            members = sorted((m for m in directory if part.begin <= m.header_offset < part.end), key=lambda m: m.header_offset)
            while members:
                size, k = 0, 0
                while k < len(members) and (not k or size + members[k].compress_size <= BATCH_BYTES):
                    size += members[k].compress_size
                    k += 1
                yield self._batch(where, file, f, part.path, members[:k])
                members = members[k:]

    def _batch(self, where, file, f, path, members) -> pa.RecordBatch:
        begin = members[0].header_offset
        size = members[-1].header_offset + members[-1].compress_size + 2048 - begin
        try:
            f.seek(begin)
            span = f.read(size)
        except OSError:
            span = b""
        columns: list[list] = [[], [], [], [], [], []]
        for m in members:
            media, error = self._member(span, m.header_offset - begin, m), None
            if media is None:
                media, error = self._again(where, file, m)
            _, doc_id, n = m.filename[:-4].split("/")
            for c, v in zip(columns, (path, m.header_offset, None if doc_id == "null" else int(doc_id), int(n), media, error), strict=True):
                c.append(v)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in STORED.split(", ")])

    @staticmethod
    def _member(span: bytes, at: int, m: zipfile.ZipInfo) -> bytes | None:
        """The member's bytes if they are in the span and undamaged."""
        if len(span) < at + 30 or span[at : at + 4] != b"PK\x03\x04":
            return None
        name, extra = struct.unpack_from("<HH", span, at + 26)
        data = span[at + 30 + name + extra : at + 30 + name + extra + m.compress_size]
        return data if len(data) == m.file_size and zlib.crc32(data) == m.CRC else None

    def _again(self, where, file, m) -> tuple[bytes | None, str | None]:
        error = "damaged member"
        for _ in range(TRIES):
            try:
                with where.open_input_file(file) as f:
                    f.seek(m.header_offset)
                    data = self._member(f.read(m.compress_size + 2 * len(m.filename) + 2048), 0, m)
                if data is not None:
                    return data, None
            except OSError as e:
                error = str(e)
        return None, error


class MediaArchives(DataSource):
    """``spark.read.format("media_archives").load(folder)``; option range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return STORED

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))


def read_archives(spark, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").option("range_bytes", range_bytes).load(folder)


def feature(payload: bytes) -> str:
    """Mean, deviation, entropy in bits, mean step between neighbours and share of zero samples."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    some = share[share > 0]
    step = np.abs(np.diff(x.astype(np.int16))).mean()
    return f"mean={x.mean():.4f};sd={x.std():.4f};entropy={-(some * np.log2(some)).sum():.4f};step={step:.4f};zero={share[0]:.4f}"


FACTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def facts(stored: DataFrame) -> DataFrame:
    """Decode stored media and describe payload and form; a member with an error stops the job."""

    def of(batches):
        for b in batches:
            rows = []
            for doc_id, n, media, error in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if error is not None:
                    raise OSError(error)
                p = from_png(media)
                rows.append((doc_id, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), feature(p)))
            kinds = {"long": pa.int64(), "string": pa.string()}
            names, types = zip(*(c.split() for c in FACTS.split(", ")), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 8, types, strict=True)], list(names))

    return stored.select("doc_id", "n_bytes", "media", "error").mapInArrow(of, FACTS)


def store_and_read(docs: DataFrame, **options) -> DataFrame:
    folder, _ = write_archives(docs, **options)
    return facts(read_archives(docs.sparkSession, folder))
