"""Whole-table text search, value filters and display formatting."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> Column:
    """A column by its verbatim name, which may hold dots and spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_text(df: DataFrame, name: str) -> Column:
    return quoted(name).cast("string")


def search(df: DataFrame, text: str, *, case_sensitive: bool = False, regex: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows in which any column's text contains ``text`` (nulls never match; empty text keeps all rows).

    A regex that doesn't compile is taken literally. Without case, a regex is matched with (?i),
    a literal by lower-casing both sides.
    """
    if not text:
        return df
    if regex:
        try:
            re.compile(text)
        except re.error:
            regex = False

    def matches(c: Column) -> Column:
        if regex:
            return c.rlike(text if case_sensitive else f"(?i){text}")
        return c.contains(text) if case_sensitive else F.lower(c).contains(text.lower())

    hits = [F.coalesce(matches(as_text(df, c)), F.lit(False)) for c in (columns or df.columns)]
    return df.filter(reduce(lambda a, b: a | b, hits)) if hits else df.limit(0)


def search_joined(df: DataFrame, text: str, *, case_sensitive: bool = False) -> DataFrame:
    """The same on the row's columns joined by ``|``, so a text may match across columns."""
    if not text:
        return df
    row = F.concat_ws("|", *(as_text(df, c) for c in df.columns))
    return df.filter(row.contains(text) if case_sensitive else F.lower(row).contains(text.lower()))


def display(df: DataFrame, name: str) -> Column:
    """The text that a result grid shows: NULL, whole floats as integers, thousands separators, hex bytes."""
    kind, c = df.schema[name].dataType, quoted(name)
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        d = c.cast("double")
        text = F.when(F.isnan(d), F.lit("NULL")).when(d == F.floor(d), F.format_number(d, 0)).when(F.abs(d) >= 1e6, F.format_number(d, 2)).otherwise(F.format_string("%.6f", d))
    elif isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        text = F.format_number(c, 0)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    elif isinstance(kind, T.BinaryType):
        text = F.lower(F.hex(c))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("NULL"))


def value_filter(df: DataFrame, allowed: dict[str, Sequence[str]]) -> DataFrame:
    """Rows whose displayed text is in the ticked set of every column named."""
    for name, values in allowed.items():
        df = df.filter(display(df, name).isin(list(values)))
    return df


def text_filters(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Rows in which every column named matches its case-insensitive regex."""
    for name, pattern in patterns.items():
        if pattern:
            df = df.filter(F.coalesce(as_text(df, name).rlike(f"(?i){pattern}"), F.lit(False)))
    return df


def normalise(df: DataFrame, name: str, out: str = "bar") -> DataFrame:
    """(v - min) / (max - min) of a numeric column, 0 if all values are equal.

    The two extremes are one row, joined to every row, so no window gathers the table in one task.
    """
    c = quoted(name).cast("double")
    edge = df.agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    return df.join(F.broadcast(edge)).withColumn(out, F.when(span > 0, (c - F.col("_lo")) / span).when(c.isNotNull(), F.lit(0.0))).drop("_lo", "_hi")
