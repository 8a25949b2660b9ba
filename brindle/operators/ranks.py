"""Exact ranks at any size: quantiles by narrowing ranges, running totals without a one-task window.

``percentile`` keeps every distinct value of a column in one buffer, and a window without partitions is one
task. Here only counts and a bounded number of values leave the executors.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that one pass cuts a range into, and rows of a range whose values are fetched.
SPLITS = 32
FETCH = 20_000
#: Ranges of a running total at most, and rows that one of them is meant to hold.
RANGES = 256
RANGE_ROWS = 250_000


class _Range:
    """Rows of column ``c`` with lo < v < hi (None: no bound), of which ``below`` rows lie lower, and the ranks looked for."""

    def __init__(self, c: int, lo, hi, below: int, count: int, ranks: set[int]):
        self.c, self.lo, self.hi, self.below, self.count, self.ranks = c, lo, hi, below, count, ranks

    def of(self, columns: Sequence[Column]) -> Column:
        """The value of a row that lies in the range, else null."""
        v = columns[self.c]
        inside = v.isNotNull() if self.lo is None else v > F.lit(self.lo)
        return F.when(inside if self.hi is None else inside & (v < F.lit(self.hi)), v)


def _each(cells: Sequence[Column]) -> Column:
    """One row for each cell that is not null."""
    return F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull()))


def _order(v: float) -> tuple:
    return (math.isnan(v), v)


def quantiles(df: DataFrame, values: Mapping[str, Column], shares: Sequence[float]) -> dict[str, list[float] | None]:
    """Exact quantiles of each of ``values``, between neighbours by linear interpolation; None without rows. NaN is the greatest value.

    Pass by pass, the ranges that hold the ranks asked for are cut by approximate quantiles of their rows and
    counted, until few rows are left; equal values are a range of their own, so they end the search.
    """
    names = list(values)
    if not names:
        return {}
    rows = df.select(*(v.cast("double").alias(f"v{i}") for i, v in enumerate(values.values())))
    columns = [F.col(f"v{i}") for i in range(len(names))]
    counts = rows.agg(*(F.count(v).alias(f"n{i}") for i, v in enumerate(columns))).first()
    known: dict[tuple[int, int], float] = {}
    work = []
    for c in range(len(names)):
        n = counts[c]
        ranks = {r for s in shares for r in (math.floor(s * (n - 1)), math.ceil(s * (n - 1)))} if n else set()
        if ranks:
            work.append(_Range(c, None, None, 0, n, ranks))
    while work:
        small, large = [r for r in work if r.count <= FETCH], [r for r in work if r.count > FETCH]
        work = []
        if small:
            cells = [F.when(r.of(columns).isNotNull(), F.struct(F.lit(i).alias("i"), columns[r.c].alias("v"))) for i, r in enumerate(small)]
            found: dict[int, list[tuple[float, int]]] = {}
            for x in rows.select(_each(cells).alias("x")).groupBy("x.i", "x.v").agg(F.count("*").alias("n")).collect():
                found.setdefault(x.i, []).append((x.v, x.n))
            for i, r in enumerate(small):
                at = r.below
                for v, n in sorted(found.get(i, []), key=lambda x: _order(x[0])):
                    known |= {(r.c, k): v for k in r.ranks if at <= k < at + n}
                    at += n
        if not large:
            continue
        inner = F.array(*(F.lit((i + 1) / SPLITS) for i in range(SPLITS - 1)))
        cuts = rows.agg(*(F.percentile_approx(r.of(columns), inner, F.lit(2000)).alias(f"q{i}") for i, r in enumerate(large))).first()
        cuts = [sorted(set(q), key=_order) for q in cuts]
        places = []  # 2 j between cuts, 2 j + 1 on cut j
        for i, (r, q) in enumerate(zip(large, cuts)):
            v, code = columns[r.c], F.lit(i * 4 * SPLITS)
            for x in q:
                code = code + (v >= F.lit(x)).cast("int") + (v > F.lit(x)).cast("int")
            places.append(F.when(r.of(columns).isNotNull(), code))
        got = {x.p: x.n for x in rows.select(_each(places).alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()}
        for i, (r, q) in enumerate(zip(large, cuts)):
            at = r.below
            for code in range(2 * len(q) + 1):
                n = got.get(i * 4 * SPLITS + code, 0)
                inside = {k for k in r.ranks if at <= k < at + n}
                if inside and code % 2:
                    known |= {(r.c, k): q[code // 2] for k in inside}
                elif inside:
                    work.append(_Range(r.c, q[code // 2 - 1] if code else r.lo, q[code // 2] if code // 2 < len(q) else r.hi, at, n, inside))
                at += n
    out: dict[str, list[float] | None] = {}
    for c, name in enumerate(names):
        n = counts[c]
        one = []
        for s in shares if n else ():
            p = s * (n - 1)
            lo, hi = known[c, math.floor(p)], known[c, math.ceil(p)]
            one.append(lo if lo == hi or math.isnan(lo) else (math.ceil(p) - p) * lo + (p - math.floor(p)) * hi)
        out[name] = one if n else None
    return out


def distinct_counts(df: DataFrame, names: Sequence[str]) -> dict[str, int]:
    """Distinct non-null values of each column: one shuffle of (column, value), not one copy of the rows for each."""
    from .search import quoted

    if not names:
        return {}

    def text(c: str) -> Column:
        v = quoted(c)
        if df.schema[c].dataType.typeName() in ("float", "double"):
            v = F.when(v == 0, F.lit(0.0)).otherwise(v)
        return v.cast("string") if df.schema[c].dataType.typeName() not in ("array", "struct", "map", "variant") else F.to_json(F.struct(v))

    cells = df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("c"), text(c).alias("v"), quoted(c).isNotNull().alias("k")) for i, c in enumerate(names)))).alias("x")).where("x.k").select("x.c", "x.v").distinct()
    got = {r.c: r.n for r in cells.groupBy("c").agg(F.count("*").alias("n")).collect()}
    return {c: got.get(i, 0) for i, c in enumerate(names)}


def running_total(df: DataFrame, order: str, amount: Column, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``amount`` over all rows up to each one in the order of a column of distinct non-null values.

    The column's range is cut at values of a hashed sample; totals within a range are a window of its rows, and those of the
    ranges before it are at most ``RANGES`` numbers.
    """
    parts = min(RANGES, max(1, -(-df.count() // RANGE_ROWS)))
    sample = sorted((r[0] for r in df.select(order).orderBy(F.xxhash64(order), order).limit(40 * parts).collect()), key=lambda v: _order(v) if isinstance(v, float) else (False, v))
    cuts = [sample[len(sample) * i // parts] for i in range(1, parts)] if sample else []
    part = F.lit(0)
    for x in sorted(set(cuts), key=lambda v: _order(v) if isinstance(v, float) else (False, v)):
        part = part + (F.col(order) >= F.lit(x)).cast("int")
    rows = df.withColumn("_part", part).withColumn("_amount", amount)
    sums = rows.groupBy("_part").agg(F.sum("_amount").alias("_sum"))
    before = sums.select(F.col("_part").alias("_p"), (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))
    inside = F.sum("_amount").over(Window.partitionBy("_part").orderBy(order))
    return rows.withColumn("_in", inside).join(F.broadcast(before), F.col("_part") == F.col("_p")).withColumn(out, F.col("_before") + F.col("_in")).drop("_part", "_amount", "_in", "_p", "_before")
