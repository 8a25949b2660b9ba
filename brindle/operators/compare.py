"""Dataset comparison: null-safe full outer merge, indicators, cell-level differences, summary."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .entropy import NUMERIC
from .search import quoted

TOLERANCE = 1e-10


@dataclass
class Comparison:
    merged: DataFrame
    keys: list[str]
    names: list[str]
    compared: list[str]

    def summary(self) -> DataFrame:
        """Rows and share of each indicator."""
        counts = self.merged.groupBy("indicator").agg(F.count("*").alias("rows"))
        total = counts.agg(F.sum("rows").alias("_t"))
        return counts.join(F.broadcast(total)).select("indicator", "rows", (100.0 * F.col("rows") / F.col("_t")).alias("percent"))

    def coverage(self) -> DataFrame:
        """dataset, rows, percentage: how many of the merged rows each table has."""
        one = self.merged.agg(F.count("*").alias("n"), *(F.count(F.when(F.col(f"`in_{n}`"), 1)).alias(f"c{i}") for i, n in enumerate(self.names)))
        share = lambda c: F.when(F.col("n") > 0, 100.0 * F.col(c) / F.col("n")).otherwise(F.lit(0.0))
        return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("dataset"), F.col(f"c{i}").alias("rows"), share(f"c{i}").alias("percentage")) for i, n in enumerate(self.names)))).alias("x")).select("x.*")

    def difference_statistics(self) -> DataFrame:
        """One row: total_cell_differences, columns_with_differences, rows_with_differences, of rows found in both tables."""
        flags = [F.coalesce(self._differs(c), F.lit(False)).cast("long").alias(f"d{i}") for i, c in enumerate(self.compared)]
        if not flags:
            return self.merged.sparkSession.createDataFrame([(0, 0, 0)], "total_cell_differences bigint, columns_with_differences bigint, rows_with_differences bigint")
        add = lambda cols: reduce(lambda a, b: a + b, cols)
        names = [f"d{i}" for i in range(len(flags))]
        both = self._both().select(*flags)
        one = both.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names), F.count(F.when(add(map(F.col, names)) > 0, 1)).alias("r"))
        return one.select(add(map(F.col, names)).alias("total_cell_differences"), add((F.col(n) > 0).cast("long") for n in names).alias("columns_with_differences"), F.col("r").alias("rows_with_differences"))

    def _differs(self, name: str):
        a, b = (f"{name}_{n}" for n in self.names)
        left, right = quoted(a), quoted(b)
        kinds = [self.merged.schema[c].dataType for c in (a, b)]
        if all(isinstance(k, NUMERIC) for k in kinds):
            unequal = F.abs(left.cast("double") - right.cast("double")) > TOLERANCE
        else:
            unequal = left.cast("string") != right.cast("string")
        return F.coalesce(unequal, left.isNull() != right.isNull())

    def _both(self) -> DataFrame:
        if len(self.names) != 2:
            raise ValueError("cell differences need exactly two tables")
        return self.merged.where("indicator = 'all'")

    def cell_differences(self) -> DataFrame:
        """column, different: in how many rows found in both tables a column differs; one aggregation."""
        both = self._both()
        if not self.compared:
            return self.merged.sparkSession.createDataFrame([], "column string, different bigint")
        one = both.agg(*(F.count(F.when(self._differs(c), 1)).alias(f"c{i}") for i, c in enumerate(self.compared)))
        cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("different")) for i, c in enumerate(self.compared))))
        return one.select(cells.alias("x")).select("x.*")

    def row_differences(self) -> DataFrame:
        """Keys and an array of (column, value_1, value_2) of each row that differs."""
        both = self._both()
        one = [F.when(self._differs(c), F.struct(F.lit(c).alias("column"), *(quoted(f"{c}_{n}").cast("string").alias(f"value_{i}") for i, n in enumerate(self.names, 1)))) for c in self.compared]
        found = both.select(*map(quoted, self.keys), F.filter(F.array(*one), lambda x: x.isNotNull()).alias("differences")) if one else both.select(*map(quoted, self.keys), F.array().alias("differences")).limit(0)
        return found.where(F.size("differences") > 0)


def infer_keys(dfs: Sequence[DataFrame]) -> list[str]:
    """Common columns that look like ids, else all common columns."""
    common = [c for c in dfs[0].columns if all(c in d.columns for d in dfs[1:])]
    ids = [c for c in common if c.lower() in ("id", "key") or c.lower().endswith(("_id", "_key", "id", "key"))]
    return ids or common


def compare(dfs: Sequence[DataFrame], names: Sequence[str] | None = None, key_columns: Sequence[str] | None = None) -> Comparison:
    """Full outer merge of tables on null-safe keys, with in_<name> flags and an indicator.

    Other columns are suffixed by the table's name. Repeated keys give all their pairs, as in SQL.
    The indicator is ``all``, ``<name>_only`` or a comma list.
    """
    if len(dfs) < 2:
        raise ValueError("at least two tables are needed")
    names = list(names or [f"df{i}" for i in range(1, len(dfs) + 1)])
    keys = list(key_columns) if key_columns else [c for c in dfs[0].columns if all(c in d.columns for d in dfs[1:])]
    if not keys or any(k not in d.columns for k in keys for d in dfs):
        raise ValueError("the tables need common key columns")
    parts = []
    for d, n in zip(dfs, names):
        rest = [c for c in d.columns if c not in keys]
        parts.append(d.select(*(quoted(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(quoted(c).alias(f"{c}_{n}") for c in rest), F.lit(True).alias(f"in_{n}")))

    def merge(a: DataFrame, b: DataFrame) -> DataFrame:
        on = reduce(lambda x, y: x & y, [a[f"_k{i}"].eqNullSafe(b[f"_k{i}"]) for i in range(len(keys))])
        got = a.join(b, on, "full_outer")
        # Null keys are matched too, so what tells a missing side is its flag, not its key.
        flags = reduce(lambda x, y: x | y, [F.coalesce(a[c], F.lit(False)) for c in a.columns if c.startswith("in_") and c[3:] in names])
        key = [F.when(flags, a[f"_k{i}"]).otherwise(b[f"_k{i}"]).alias(f"_k{i}") for i in range(len(keys))]
        return got.select(*key, *(a[c] for c in a.columns if not c.startswith("_k")), *(b[c] for c in b.columns if not c.startswith("_k")))

    merged = reduce(merge, parts)
    flags = [F.coalesce(F.col(f"`in_{n}`"), F.lit(False)) for n in names]
    merged = merged.withColumns({f"in_{n}": f for n, f in zip(names, flags)})
    present = F.filter(F.array(*(F.when(F.col(f"`in_{n}`"), F.lit(n)) for n in names)), lambda x: x.isNotNull())
    indicator = F.when(F.size(present) == len(names), F.lit("all")).when(F.size(present) == 0, F.lit("none")).when(F.size(present) == 1, F.concat(F.element_at(present, 1), F.lit("_only"))).otherwise(F.array_join(present, ","))
    merged = merged.withColumn("indicator", indicator)
    merged = merged.select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)), *(quoted(c) for c in merged.columns if not c.startswith("_k")))
    compared = [c for c in dfs[0].columns if c not in keys and all(c in d.columns for d in dfs[1:])]
    return Comparison(merged, keys, names, compared)
