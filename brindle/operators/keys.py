"""Candidate keys, functional dependencies and a third-normal-form proposal, exact on all rows."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import quoted

#: Relative error of the estimate that only rules combinations out, and combinations that may be tried.
SLACK = 0.05
MOST = 5_000


def distinct_counts(df: DataFrame, *, exact: bool = False) -> dict[str, int]:
    """Distinct non-null values of each column, and the number of rows under ``None``: one pass."""
    count = F.count_distinct if exact else (lambda c: F.approx_count_distinct(c, SLACK / 3))
    row = df.agg(F.count("*").alias("n"), *(count(quoted(c)).alias(f"c{i}") for i, c in enumerate(df.columns))).first()
    return {None: row["n"], **{c: row[f"c{i}"] for i, c in enumerate(df.columns)}}


def _tuples(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(distinct tuples, non-null tuples' rows): nulls are values of a tuple of two or more columns."""
    return df.groupBy(*map(quoted, cols)).agg(F.count("*").alias("n"))


def candidate_keys(df: DataFrame, max_size: int = 2, columns: Sequence[str] | None = None, *, superkeys: bool = False, report_all: bool = True) -> DataFrame:
    """columns, size, unique_count, uniqueness, key_type: keys first, then by uniqueness and size.

    A column is a key if its distinct non-null values are as many as rows; a larger combination if
    its distinct tuples are. Supersets of keys aren't tried (with ``superkeys`` they are listed as
    such), and once a size has given a key the next one that gives none is the last. Estimates
    rule combinations out (the product of distinct counts must reach the rows); those left are
    counted exactly. Without ``report_all`` the ones ruled out aren't counted or listed: for wide tables.
    """
    spark = df.sparkSession
    cols = list(columns or df.columns)
    df = df.select(*map(quoted, cols))
    counts = distinct_counts(df)
    rows = counts[None]
    keys: list[tuple[str, ...]] = []
    out: list[tuple] = []
    for size in range(1, max_size + 1):
        found = []
        every = list(combinations(cols, size))
        tried = [c for c in every if not any(set(k) <= set(c) for k in keys)]
        if superkeys and rows:
            out += [(list(c), size, rows, 100.0, "Superkey") for c in every if any(set(k) < set(c) for k in keys)]
        if len(tried) > MOST:
            raise ValueError(f"{len(tried)} combinations of {size} columns; name fewer columns")
        near, rest = [], []
        for c in tried:
            product = 1
            for x in c:
                product *= max(counts[x] * (1 + SLACK), 1) + 1
            (near if product >= rows else rest).append(c)
        if size == 1:
            exact = df.agg(*(F.count_distinct(quoted(c[0])).alias(f"c{i}") for i, c in enumerate(tried))).first() if tried else []
            sizes = dict(zip(tried, exact))
        else:
            sizes = {c: _tuples(df, c).count() for c in (near + rest if report_all else near)}
        for c in (c for c in tried if c in sizes):
            if sizes[c] == rows and rows:
                found.append(c)
            out.append((list(c), size, sizes[c], 100.0 * sizes[c] / rows if rows else 0.0, "Candidate Key" if sizes[c] == rows and rows else ""))
        if keys and not found:
            break
        keys += found
    table = spark.createDataFrame(out, "columns array<string>, size int, unique_count bigint, uniqueness double, key_type string")
    order = F.when(F.col("key_type") == "Candidate Key", 0).when(F.col("key_type") == "Superkey", 1).otherwise(2)
    return table.orderBy(order, F.desc("uniqueness"), "size", "columns")


def functional_dependencies(df: DataFrame, max_lhs: int = 1, columns: Sequence[str] | None = None, *, nulls_are_values: bool = False) -> DataFrame:
    """determinant, dependent: every group of the determinant has at most one non-null value of the dependent.

    Null determinants form groups. Columns that are unique determine everything and are left out
    alone, as are combinations whose groups all hold one row. One shuffle per determinant serves
    all dependents; a dependent with clearly more distinct values than the determinant has is ruled out first.
    With ``nulls_are_values`` a null dependent counts as a value, and rows with a null determinant are left out.
    """
    spark = df.sparkSession
    cols = list(columns or df.columns)
    df = df.select(*map(quoted, cols))
    counts = distinct_counts(df)
    rows = counts[None]
    out: list[tuple] = []
    for size in range(1, max_lhs + 1):
        for lhs in combinations(cols, size):
            bound = 1.0
            for c in lhs:
                bound *= (counts[c] + 1) * (1 + SLACK)
            rhs = [c for c in cols if c not in lhs and counts[c] * (1 - SLACK) <= bound]
            if not rhs:
                continue
            names = {c: i for i, c in enumerate(rhs)}
            lows = [f(quoted(c)).alias(f"{p}{i}") for c, i in names.items() for p, f in (("lo", F.min), ("hi", F.max))]
            lows += [F.count(quoted(c)).alias(f"k{i}") for c, i in names.items()] if nulls_are_values else []
            groups = df.groupBy(*(quoted(c).alias(f"_l{j}") for j, c in enumerate(lhs))).agg(F.count("*").alias("_n"), *lows)
            differ = {i: F.col(f"lo{i}") != F.col(f"hi{i}") for i in names.values()}
            if nulls_are_values:
                for j in range(size):
                    groups = groups.where(F.col(f"_l{j}").isNotNull())
                differ = {i: F.coalesce(x, F.lit(False)) | ((F.col(f"k{i}") > 0) & (F.col(f"k{i}") < F.col("_n"))) for i, x in differ.items()}
            verdict = groups.agg(F.max("_n").alias("most"), *(F.max(differ[i].cast("int")).alias(f"bad{i}") for i in names.values())).first()
            if not rows or verdict["most"] is None or verdict["most"] <= 1:
                continue
            out += [(list(lhs), c) for c, i in names.items() if not verdict[f"bad{i}"]]
    return spark.createDataFrame(out, "determinant array<string>, dependent string")


def propose_tables(columns: Sequence[str], keys: Sequence[Sequence[str]], dependencies: Sequence[tuple[Sequence[str], str]]) -> list[dict]:
    """One table per determinant with what it determines; columns left over join the first key that overlaps them, else a suggested id."""
    by: dict[tuple[str, ...], list[str]] = {}
    for lhs, rhs in dependencies:
        by.setdefault(tuple(lhs), []).append(rhs)
    tables, covered = [], set()
    for lhs, rhs in by.items():
        tables.append({"columns": [*lhs, *(c for c in rhs if c not in lhs)], "key": list(lhs)})
        covered |= set(rhs)
    left = [c for c in columns if c not in covered]
    if left:
        key = next((list(k) for k in keys if set(k) & set(left)), None)
        tables.append({"columns": [*(key or []), *(c for c in left if not key or c not in key)], "key": key or ["id (suggested)"]})
    return tables


def profile(df: DataFrame, max_combination_size: int = 2, max_lhs_size: int = 1) -> dict:
    """Keys, dependencies and the proposed tables."""
    keys, fds = candidate_keys(df, max_combination_size), functional_dependencies(df, max_lhs_size)
    key_lists = [r["columns"] for r in keys.where("key_type <> ''").collect()]
    pairs = [(r.determinant, r.dependent) for r in fds.collect()]
    return {"keys": keys, "dependencies": fds, "tables": propose_tables(df.columns, key_lists, pairs)}
