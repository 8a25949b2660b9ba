"""Joins with aggregates that adaptive execution can split."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_split(left: DataFrame, grouped: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the columns of ``grouped``, one row for each value of the whole-number ``keys``.

    The rows of an aggregate are dealt by its keys already, so a plain join would put it beside the
    other side as it is, and a key that holds a third of all rows would stay one task: adaptive execution only
    splits joins of two fresh shuffles. Comparing complements of the keys makes Spark deal both.
    """
    marks = {k: f"_not_{k}" for k in keys}
    right = grouped.select(*(F.bitwise_not(k).alias(m) for k, m in marks.items()), *(c for c in grouped.columns if c not in keys))
    on = reduce(lambda a, b: a & b, [F.bitwise_not(left[k]) == right[m] for k, m in marks.items()])
    return left.join(right, on, how).drop(*marks.values())
