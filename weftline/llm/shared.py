"""Files that the driver and every executor see: they live under ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import tempfile
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from weftline.operators.lineage import cut as as_table  # noqa: F401
from weftline.sources.io import scratch


def shared_dir(spark: SparkSession, label: str) -> str:
    """URI of a new folder under ``spark.checkpoint.dir``."""
    path = scratch(spark, label)
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Eager checkpoint in the shared folder, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        shared_dir(spark, "init")
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    return df.checkpoint()


#: Rows of an Arrow batch of whole texts. Spark's own default is 10,000 whatever their bytes, in the JVM and in Python alike.
BATCH_ROWS = 500


def bounded_batches() -> None:
    """Let the active session send smaller Arrow batches, unless it does already."""
    session, key = SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    if session is not None and not 0 < int(session.conf.get(key)) <= BATCH_ROWS:
        session.conf.set(key, str(BATCH_ROWS))


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """pyarrow file system and path of a URI (file, hdfs, s3, gs)."""
    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def make_dir(uri: str) -> None:
    where, path = open_fs(uri)
    where.create_dir(path, recursive=True)


def write_bytes(uri: str, data) -> None:
    where, path = open_fs(uri)
    with where.open_output_stream(path) as out:
        out.write(data)


def read_bytes(uri: str) -> bytes:
    where, path = open_fs(uri)
    with where.open_input_file(path) as f:
        return f.read()


def mapped(uri: str, dtype) -> np.ndarray:
    """The array in a file of raw values, memory-mapped; a remote file is copied to a nameless local one, whose space is free again
    when the array goes."""
    where, path = open_fs(uri)
    if urlparse(uri).scheme in ("", "file"):
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)
    with tempfile.TemporaryFile() as local:
        with where.open_input_stream(path) as src:
            while chunk := src.read(1 << 22):
                local.write(chunk)
        local.flush()
        return np.memmap(local, dtype=dtype, mode="r") if local.tell() else np.zeros(0, dtype)


class Arrays:
    """A file of named arrays: for each its name, type, place and length, then the values, each array aligned to 8 bytes."""

    @staticmethod
    def write(uri: str, arrays: dict[str, np.ndarray]) -> None:
        head, at = [], 4096
        for name, a in arrays.items():
            head.append(f"{name} {a.dtype.str} {at} {len(a)}")
            at += -(-a.nbytes // 8) * 8
        body = "\n".join(head).encode().ljust(4096, b"\n")
        write_bytes(uri, body + b"".join(a.tobytes().ljust(-(-a.nbytes // 8) * 8, b"\0") for a in arrays.values()))

    @staticmethod
    @lru_cache(4096)
    def open(uri: str) -> dict[str, np.ndarray]:
        """Memory-mapped."""
        return Arrays._named(mapped(uri, np.uint8).view(np.ndarray))

    @staticmethod
    def read(uri: str) -> dict[str, np.ndarray]:
        return Arrays._named(np.frombuffer(read_bytes(uri), np.uint8))

    @staticmethod
    def _named(raw: np.ndarray) -> dict[str, np.ndarray]:
        out = {}
        for line in raw[:4096].tobytes().decode().split("\n"):
            if line:
                name, kind, at, n = line.split()
                kind = np.dtype(kind)
                out[name] = raw[int(at) : int(at) + int(n) * kind.itemsize].view(kind)
        return out
