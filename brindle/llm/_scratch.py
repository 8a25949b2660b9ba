"""Tables written to the folder that driver and executors share, to cut lineage durably."""

from __future__ import annotations

import pickle
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a temporary one only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by driver and executors")
    base = "file://" + tempfile.mkdtemp(prefix="brindle-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


#: Paths made so far that still stand, oldest first.
_MADE: list[str] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path of its own below the shared folder, deleted when it is discarded or the driver's JVM ends."""
    path = f"{shared_dir(spark)}/brindle-{label}-{uuid.uuid4().hex}"
    system, target = _file_system(spark, path)
    system.deleteOnExit(target)
    _MADE.append(path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(spark: SparkSession, path: str) -> None:
    if path in _MADE:
        _MADE.remove(path)
        system, target = _file_system(spark, path)
        system.delete(target, True)


def mark() -> int:
    """A point in time for ``discard_since``."""
    return len(_MADE)


def discard_since(spark: SparkSession, since: int, keep: str) -> None:
    """Delete what was made after a mark, but for one table, once nothing reads it any more."""
    for path in _MADE[since:]:
        if path != keep:
            discard(spark, path)


def save(folder: str, name: str, value) -> None:
    """A worker's own object as a file of a folder from ``fresh_path``; written under another name, so a task that runs again leaves the same file."""
    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    aside = f"{base}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(aside) as out:
        out.write(pickle.dumps(value))
    system.move(aside, f"{base}/{name}")


def load(folder: str, name: str):
    system, base = fs.FileSystem.from_uri(folder)
    with system.open_input_stream(f"{base}/{name}") as file:
        return pickle.loads(file.read())


#: Rows of a batch between the engine and Python at most, where whole texts travel with other columns.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Bounds the memory of batches of whole texts outside the heap, unless the session asks for less already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
