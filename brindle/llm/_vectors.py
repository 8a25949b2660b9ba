"""Which vectors take part in searches, and how query results meet."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(df: DataFrame, key: str, vector: str, *, zero: bool) -> DataFrame:
    """(id, v): vectors of doubles, not empty, without null or non-finite components.

    ``zero``: all-zero vectors take part too. Rows with a null key take no part.
    """
    v = F.col(vector).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    rows = df.select(F.col(key).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad))
    return rows if zero else rows.where(F.exists("v", lambda x: x != 0))


def by_length(rows: DataFrame, search) -> DataFrame | None:
    """The union of ``search`` over the rows of each vector ``length``: only vectors of one length can be compared."""
    lengths = sorted(r[0] for r in rows.select(F.size("v")).distinct().collect())
    parts = (search(rows.where(F.size("v") == n) if len(lengths) > 1 else rows).withColumn("length", F.lit(n)) for n in lengths)
    return reduce(DataFrame.unionByName, parts) if lengths else None


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list<double> column of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def best(found: DataFrame, k: int, order: list) -> DataFrame:
    """query_id, rank, vec_id, score: the first k rows of each query row (``query_row`` of its ``length``)."""
    turn = Window.partitionBy("length", "query_row").orderBy(*order, "vec_id")
    return found.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
