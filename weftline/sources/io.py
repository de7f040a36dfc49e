"""Reading tables of several forms, and writing results."""

from __future__ import annotations

import json
import re
import tempfile
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from py4j.protocol import Py4JError
from pyarrow import fs
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scratch(spark: SparkSession, label: str) -> str:
    """A new place that the driver and all executors see: under spark.checkpoint.dir, which is set here only if unset and only where
    driver and executors are one process; on a cluster a missing setting is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def read_any(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Parquet, CSV or JSON lines by the name's ending (no ending: Parquet), without index columns left by other tools.

    Without a schema CSV types are inferred; give one where codes with leading zeros must stay text.
    """
    kind = form_of(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "csv":
        reader = reader.option("header", True).option("inferSchema", schema is None)
    df = reader.format(kind).load(path)
    return df.drop(*[c for c in df.columns if re.fullmatch(r"Unnamed: \d+", c)])


def form_of(path: str) -> str:
    """``csv``, ``json`` or ``parquet`` by the name's ending."""
    return next((k for k, ends in {"csv": ".csv", "json": (".json", ".jsonl", ".ndjson")}.items() if path.rstrip("/").endswith(ends)), "parquet")


def probe(spark: SparkSession, paths: list[str], threads: int = 16) -> list[dict]:
    """For each path its form and either its schema or why it can't be read. A schema takes a file's footer or, for text, one pass;
    paths are probed side by side."""

    def one(path: str) -> dict:
        try:
            return {"path": path, "form": form_of(path), "schema": read_any(spark, path).schema, "error": None}
        except (PySparkException, Py4JError) as e:
            return {"path": path, "form": form_of(path), "schema": None, "error": f"{type(e).__name__}: {str(e).strip().splitlines()[0][:500]}"}

    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(one, paths))


def load_with_errors(spark: SparkSession, paths: list[str], source_column: str | None = None, drop_empty: bool = True) -> tuple[DataFrame | None, DataFrame]:
    """(the outer union of all readable files' columns, (path, form, error) of the others).

    Paths of one form and schema are one scan, so the plan grows with the number of schemas and not with that of files. A column that
    files have in different types takes the wider type, or text where they have none in common. ``source_column`` names the file a row
    comes from; ``drop_empty`` leaves out columns without a value, which one pass over the union counts. Without a readable file the
    first is None.
    """
    found = probe(spark, paths)
    kinds = "path string, form string, error string"
    errors = spark.createDataFrame([(f["path"], f["form"], f["error"]) for f in found if f["error"]], kinds)
    groups: dict[tuple[str, str], list[dict]] = {}
    for f in found:
        if not f["error"]:
            groups.setdefault((f["form"], f["schema"].json()), []).append(f)
    frames = []
    for (form, _), files in groups.items():
        schema = files[0]["schema"]
        reader = spark.read.schema(schema)
        if form == "csv":
            reader = reader.option("header", True)
        df = reader.format(form).load([f["path"] for f in files])
        if source_column is not None:
            names = {re.sub("^[a-z]+:/+", "/", f["path"].rstrip("/")): f["path"].rstrip("/").rpartition("/")[2] for f in files}
            at = F.regexp_replace(F.col("_metadata.file_path"), "^[a-z]+:/+", "/")
            parent = F.regexp_extract(at, "^(.*)/[^/]*$", 1)
            table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
            df = df.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(table[at], table[parent]).alias(source_column))
        frames.append(df)
    if not frames:
        return None, errors
    types: dict[str, set[str]] = {}
    for df in frames:
        for c, t in df.dtypes:
            types.setdefault(c, set()).add(t)
    wider = ("tinyint", "smallint", "int", "bigint", "float", "double")
    common = {c: max(t, key=wider.index) if t <= set(wider) else "string" for c, t in types.items() if len(t) > 1}
    frames = [df.select(*[F.col(f"`{c}`").cast(common[c]).alias(c) if c in common else F.col(f"`{c}`") for c in df.columns]) for df in frames]
    out = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)
    if drop_empty:
        counts = out.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in out.columns]).first().asDict()
        out = out.select(*[F.col(f"`{c}`") for c in out.columns if counts[c]])
    return out, errors


def load_many(spark: SparkSession, paths: list[str], source_column: str | None = None, drop_empty: bool = True, strict: bool = True) -> DataFrame:
    """The outer union of all files' columns, as ``load_with_errors``. With ``strict`` an unreadable path is an error, else it is left
    out; no readable path is an error either way."""
    out, errors = load_with_errors(spark, paths, source_column, drop_empty)
    failed = errors.limit(1).collect() if strict or out is None else []
    if failed or out is None:
        raise ValueError(f"can't read {failed[0]['path']}: {failed[0]['error']}" if failed else "no paths")
    return out


def is_ready(spark: SparkSession, path: str) -> bool:
    """Whether a Parquet dataset can be read and has rows."""
    try:
        return not spark.read.parquet(path).isEmpty()
    except AnalysisException:
        return False


def write_text_columns(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """Every column as text, zstd Parquet."""
    out = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    (out if partitions is None else out.repartition(partitions)).write.option("compression", "zstd").parquet(path)


def write_flat(df: DataFrame, path: str, rows_per_file: int = 250_000, partition_by: list[str] = (), form: str = "parquet") -> None:
    writer = df.write.option("maxRecordsPerFile", rows_per_file).mode("overwrite")
    if form == "parquet":
        writer = writer.option("compression", "zstd")
    elif form == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).format(form).save(path)


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path)) if ":/" in path else (fs.LocalFileSystem(), path)


def _with_facts(df: DataFrame, path: str, rows_per_file: int) -> dict:
    """Writes flat Parquet and, last, a file of facts beside it; readers skip names that begin with ``_``."""
    write_flat(df, path, rows_per_file)
    where, root = _file_system(path)
    files = sum(f.base_name.endswith(".parquet") for f in where.get_file_info(fs.FileSelector(root)))
    facts = {"format": "parquet", "layout": "flat", "files": files, "rows": df.sparkSession.read.parquet(path).count(), "cols": len(df.columns), "compression": "zstd"}
    with where.open_output_stream(f"{root}/_facts.json") as out:
        out.write(json.dumps(facts, indent=2).encode())
    return facts


def replace_flat(df: DataFrame, path: str, rows_per_file: int = 250_000) -> dict:
    """Flat Parquet that takes the place of what is at ``path`` once it is whole, with its facts in ``_facts.json``; returns them.

    ``df`` may read from ``path``. It is written beside it; then the old table is renamed aside, the new one takes its name, and only
    then the old one goes. If the job or the renaming fails the old table is in its place again. Where readers must always find one
    between the two renamings, or renaming is a copy (object stores), use ``save_version``.
    """
    path = path.rstrip("/")
    new, old = (f"{path}.{k}-{uuid.uuid4().hex[:12]}" for k in ("new", "old"))
    facts = _with_facts(df, new, rows_per_file)
    (where, to), (_, source), (_, aside) = _file_system(path), _file_system(new), _file_system(old)
    there = where.get_file_info(to).type != fs.FileType.NotFound
    if there:
        where.move(to, aside)
    try:
        where.move(source, to)
    except Exception:
        if there:
            where.move(aside, to)
        raise
    if there:
        where.delete_dir(aside)
    return facts


def save_version(df: DataFrame, root: str, name: str, rows_per_file: int = 250_000) -> str:
    """A new version of a named output: the folder root/name/version, whole when its ``_facts.json`` is there. Versions sort by
    the time of writing."""
    path = f"{root.rstrip('/')}/{name}/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    _with_facts(df, path, rows_per_file)
    return path


def latest_output(root: str, name: str) -> str | None:
    """The newest whole version of a named output; None without one."""
    uri = f"{root.rstrip('/')}/{name}"
    where, base = _file_system(uri)
    found = where.get_file_info(fs.FileSelector(base, allow_not_found=True))
    for v in sorted((f.base_name for f in found if f.type == fs.FileType.Directory), reverse=True):
        if where.get_file_info(f"{base}/{v}/_facts.json").type == fs.FileType.File:
            return f"{uri}/{v}"
    return None


def dataset_facts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(name, ready, rows, columns) of Parquet datasets, in one job; unreadable ones have 0 rows and aren't ready."""
    parts = []
    for name, path in paths.items():
        try:
            df = spark.read.parquet(path)
        except AnalysisException:
            df = None
        rows = df.agg(F.count("*").alias("rows")) if df is not None else spark.range(1).select(F.lit(0).cast("long").alias("rows"))
        parts.append(rows.select(F.lit(name).alias("name"), (F.col("rows") > 0).alias("ready"), "rows", F.lit(0 if df is None else len(df.columns)).alias("columns")))
    return reduce(DataFrame.unionByName, parts)


def split_columns(df: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """(flag columns, outcome columns, the rest) of a wide table."""
    flags = [c for c in df.columns if c.endswith("_Tested")]
    outcomes = [c for c in df.columns if c.endswith("_Outcome")]
    return flags, outcomes, [c for c in df.columns if c not in {*flags, *outcomes}]


def layout(df: DataFrame) -> str:
    """``pairwise`` if the table holds 2x2 counts of item pairs, ``wide`` if it has flag columns."""
    if {"ab_1", "ab_2", "a", "b", "c", "d"} <= set(df.columns):
        return "pairwise"
    if split_columns(df)[0]:
        return "wide"
    raise ValueError("neither pair counts nor flag columns")


def analysis_table(df: DataFrame, organism: str, pattern: str, recode: dict[str, dict[str, str]] = (), drop: list[str] = ()) -> DataFrame:
    """Values recoded by column, rows whose organism fits the pattern, artefact columns dropped."""
    for column, values in dict(recode or {}).items():
        df = df.replace(values, subset=[column])
    return df.filter(F.col(organism).rlike("(?i)" + pattern)).drop(*drop)
