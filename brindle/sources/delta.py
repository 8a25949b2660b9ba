"""Lakehouse tables with a ``_delta_log``: through their own reader where it is installed, else by replaying the log."""

from __future__ import annotations

import json
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import is_folder, names_in

LOG = "_delta_log"


def is_delta(spark: SparkSession, path: str) -> bool:
    return is_folder(spark, f"{path.rstrip('/')}/{LOG}")


def find_delta(spark: SparkSession, path: str) -> list[str]:
    """The folder itself, or those directly inside that are such tables."""
    path = path.rstrip("/")
    if is_delta(spark, path):
        return [path]
    return [p for n in names_in(spark, path) if is_delta(spark, p := f"{path}/{n}")]


def live_files(spark: SparkSession, path: str, version: int | None = None) -> tuple[dict[str, dict], dict]:
    """Files that are part of the table (path -> partition values), and its metadata: the last checkpoint and the commits after it."""
    log = f"{path.rstrip('/')}/{LOG}"
    names = names_in(spark, log)
    commits = {int(n[:20]): n for n in names if n.endswith(".json") and n[:20].isdigit()}
    checkpoints: dict[int, list[str]] = {}
    for n in names:
        if ".checkpoint" in n and n.endswith(".parquet") and n[:20].isdigit():
            checkpoints.setdefault(int(n[:20]), []).append(n)
    last = max(commits, default=-1) if version is None else version
    base = max((v for v in checkpoints if v <= last), default=-1)
    files: dict[str, dict] = {}
    meta: dict = {}

    def apply(action: dict) -> None:
        nonlocal meta
        if action.get("metaData"):
            meta = action["metaData"]
        if (p := action.get("protocol")) and (p.get("minReaderVersion") or 0) > 1:
            raise ValueError("the table needs reader features that replaying the log doesn't have")
        if add := action.get("add"):
            files[unquote(add["path"])] = dict(add.get("partitionValues") or {})
        if remove := action.get("remove"):
            files.pop(unquote(remove["path"]), None)

    if base >= 0:
        rows = spark.read.parquet(*(f"{log}/{n}" for n in checkpoints[base]))
        for r in rows.toLocalIterator():
            apply({k: v.asDict(True) for k, v in r.asDict().items() if v is not None and k in ("add", "remove", "metaData", "protocol")})
    later = [v for v in sorted(commits) if base < v <= last]
    if later:
        # Lines of a commit stand in order within their file, commits in the order of their names.
        lines = spark.read.text([f"{log}/{commits[v]}" for v in later], wholetext=True).select(F.col("_metadata.file_name").alias("n"), "value")
        for r in sorted(lines.collect()):
            for line in r.value.splitlines():
                if line.strip():
                    apply(json.loads(line))
    return files, meta


def read_delta(spark: SparkSession, path: str, *, version: int | None = None, decimal_as_double: bool = False) -> DataFrame:
    """Only live files are read. Partition columns come from the log, so files are grouped by their values."""
    try:
        reader = spark.read.format("delta")
        df = (reader.option("versionAsOf", version) if version is not None else reader).load(path)
    except Exception as e:
        if "DATA_SOURCE_NOT_FOUND" not in str(e) and "ClassNotFound" not in str(e):
            raise
        df = _replayed(spark, path, version)
    if decimal_as_double:
        df = df.select(*(F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`") for f in df.schema.fields))
    return df


def _replayed(spark: SparkSession, path: str, version: int | None) -> DataFrame:
    files, meta = live_files(spark, path, version)
    schema = T.StructType.fromJson(json.loads(meta["schemaString"])) if meta.get("schemaString") else None
    if not files:
        return spark.createDataFrame([], schema or T.StructType([]))
    keys = list(meta.get("partitionColumns") or [])
    path = path.rstrip("/")
    if schema and keys and all([d.partition("=")[0] for d in name.split("/")[:-1]] == keys for name in files):
        # Folders named by their values, as writers make them: one scan, and Spark prunes partitions.
        return spark.read.schema(schema).option("basePath", path).parquet(*(f"{path}/{name}" for name in files)).select(*(F.col(f"`{f.name}`") for f in schema.fields))
    by: dict[tuple, list[str]] = {}
    for name, values in files.items():
        by.setdefault(tuple(values.get(k) for k in keys), []).append(f"{path}/{name}")
    stored = T.StructType([f for f in schema.fields if f.name not in keys]) if schema else None
    parts = []
    for values, paths in by.items():
        reader = spark.read.schema(stored) if stored and stored.fields else spark.read
        part = reader.parquet(*paths)
        for k, v in zip(keys, values):
            part = part.withColumn(k, F.lit(v).cast(schema[k].dataType if schema else "string"))
        parts.append(part)
    out = reduce(lambda a, b: a.unionByName(b), parts)
    return out.select(*(F.col(f"`{f.name}`") for f in schema.fields)) if schema else out
