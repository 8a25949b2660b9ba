"""Which columns explain a column: association measures, forest importance, drill-down tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .entropy import numeric_columns, pearson
from .ranks import running_total
from .search import as_text, quoted

RESULT = "feature string, importance_value double, correlation double"


def _codes(rows: DataFrame, name: str) -> DataFrame:
    """Alphabetical codes of the distinct values of ``name``; the distinct values alone are ordered."""
    values = rows.select(name).where(F.col(name).isNotNull()).distinct()
    return running_total(values, name, F.lit(1), "_upto").select(F.col(name).alias(f"{name}_v"), (F.col("_upto") - 1).cast("double").alias(f"{name}_c"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row, association: sqrt(chi2 / n / min(r - 1, k - 1)), at most 1, without continuity correction."""
    cells = df.select(as_text(df, a).alias("a"), as_text(df, b).alias("b")).where("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").alias("o"))
    left = cells.groupBy("a").agg(F.sum("o").alias("ra"))
    right = cells.groupBy("b").agg(F.sum("o").alias("rb"))
    sizes = left.agg(F.count("*").alias("r"), F.sum("ra").alias("n")).join(F.broadcast(right.agg(F.count("*").alias("k"))))
    # chi2 = n * (sum of o^2 / (row * column) - 1): empty cells need no row.
    total = cells.join(left, "a").join(right, "b").agg(F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("rb"))).alias("s"))
    v = F.sqrt(F.greatest(F.col("s") - 1, F.lit(0.0)) / (F.least("r", "k") - 1))
    return total.join(F.broadcast(sizes)).select(F.when((F.col("n") >= 5) & (F.least("r", "k") > 1), F.least(v, F.lit(1.0))).otherwise(F.lit(0.0)).alias("association"))


def association(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row, association: |Pearson| of numbers, Cramer's V of categories, |Pearson| with alphabetical codes for one of each; 0 below five complete rows."""
    numeric = set(numeric_columns(df))
    if a not in numeric and b not in numeric:
        return cramers_v(df, a, b)
    rows = df.select(*((quoted(c).cast("double") if c in numeric else as_text(df, c)).alias(n) for c, n in ((a, "x"), (b, "y")))).where("x is not null and y is not null")
    for c, n in ((a, "x"), (b, "y")):
        if c not in numeric:
            codes = _codes(rows, n)
            rows = rows.join(codes, rows[n] == codes[f"{n}_v"]).drop(n, f"{n}_v").withColumnRenamed(f"{n}_c", n)
    return rows.agg(F.when(F.count("*") >= 5, F.abs(pearson(F.col("x"), F.col("y")))).alias("c")).select(F.coalesce(F.nanvl("c", F.lit(0.0)), F.lit(0.0)).alias("association"))


def prefilter(df: DataFrame, target: str) -> list[str]:
    """Features that are neither nearly unique (over 100 rows) nor mostly null; the three least unique ones if none is left."""
    features = [c for c in df.columns if c != target]
    if not features:
        return []
    row = df.agg(F.count("*").alias("n"), *(f for i, c in enumerate(features) for f in (F.approx_count_distinct(quoted(c)).alias(f"d{i}"), F.count(quoted(c)).alias(f"k{i}")))).first()
    n = max(row["n"], 1)
    kept = [c for i, c in enumerate(features) if not (n > 100 and row[f"d{i}"] / n > 0.99) and 1 - row[f"k{i}"] / n <= 0.8]
    return kept or sorted(features, key=lambda c: (row[f"d{features.index(c)}"], c))[:3]


def encoded(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numbers (null: the mean) and alphabetical codes (null: a code of its own) as doubles, under c0, c1 and so on."""
    numeric = set(numeric_columns(df))
    means = df.agg(*(F.avg(quoted(c)).alias(f"m{i}") for i, c in enumerate(columns) if c in numeric), F.lit(0).alias("_")).first().asDict()
    rows = df.select(*((F.coalesce(quoted(c).cast("double"), F.lit(float(means[f"m{i}"] or 0.0))) if c in numeric else F.coalesce(as_text(df, c), F.lit("_MISSING_"))).alias(f"c{i}") for i, c in enumerate(columns)))
    for i, c in enumerate(columns):
        if c not in numeric:
            codes = _codes(rows, f"c{i}")
            rows = rows.join(codes, rows[f"c{i}"] == codes[f"c{i}_v"]).drop(f"c{i}", f"c{i}_v").withColumnRenamed(f"c{i}_c", f"c{i}")
    return rows


def explain(df: DataFrame, target: str, *, trees: int = 10, sort: str = "importance_value") -> DataFrame:
    """feature, importance_value and correlation (association), highest first.

    The forest is grown on four fifths of the rows, those of a hash, so the same ones each time. Where it
    finds nothing to split by, the associations stand in, else the shares of distinct values, else all count the same; each sums up to 1.
    """
    spark = df.sparkSession
    features = prefilter(df, target)
    if not features:
        return spark.createDataFrame([], RESULT)
    known = df.where(quoted(target).isNotNull())
    rows = encoded(known, [target, *features])
    inputs = [f"c{i + 1}" for i in range(len(features))]
    part = F.pmod(F.xxhash64("c0", *inputs, F.lit(42)), F.lit(5))
    data = VectorAssembler(inputCols=inputs, outputCol="features").transform(rows.withColumn("part", part)).select("features", F.col("c0").alias("label"), "part")
    related = [float(association(df, f, target).first()[0]) for f in features]
    train = data.where("part < 4")
    grown = [0.0] * len(features)
    if train.limit(2).count() == 2:
        forest = RandomForestRegressor(numTrees=trees, maxDepth=5 if len(features) >= 3 else 3, featureSubsetStrategy="sqrt", seed=42)
        grown = forest.fit(train).featureImportances.toArray().tolist()
    spread = lambda: [float(x) for x in df.agg(*(F.approx_count_distinct(quoted(c)) / F.count("*") for c in features)).first()]
    importance = next(v for v in (grown, related, spread() if not (sum(grown) or sum(related)) else [], [1.0] * len(features)) if sum(v) > 0)
    out = [(f, v / sum(importance), r) for f, v, r in zip(features, importance, related)]
    return spark.createDataFrame(out, RESULT).orderBy(F.desc(sort), "feature")


def _grouped(df: DataFrame, c: str, n: int):
    """The n most frequent values as they are, others as Other."""
    top = [r[0] for r in df.select(as_text(df, c).alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "v").limit(n).collect()]
    return F.when(as_text(df, c).isin(top), as_text(df, c)).otherwise(F.when(as_text(df, c).isNotNull(), F.lit("Other")))


def drill_down(df: DataFrame, feature: str, target: str, *, top: int = 10, grid: int = 20) -> DataFrame:
    """The table behind a chart of two columns.

    Two numbers: counts on a grid. A numeric target: count, mean and deviation for each of the top
    values, by mean. A numeric feature: its quartiles for each target value. Two categories: shares of
    target values within each feature value.
    """
    numeric = set(numeric_columns(df))
    if feature in numeric and target in numeric:
        x, y = quoted(feature).cast("double"), quoted(target).cast("double")
        lo_x, hi_x, lo_y, hi_y = df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
        cell = lambda c, lo, hi: F.least(F.floor((c - F.lit(lo)) / F.lit(((hi - lo) / grid) or 1.0)), F.lit(grid - 1)).cast("int")
        if lo_x is None or lo_y is None:
            return df.sparkSession.createDataFrame([], "x int, y int, count bigint")
        return df.where(x.isNotNull() & y.isNotNull()).groupBy(cell(x, lo_x, hi_x).alias("x"), cell(y, lo_y, hi_y).alias("y")).agg(F.count("*").alias("count"))
    if target in numeric:
        y = quoted(target).cast("double")
        return df.groupBy(_grouped(df, feature, top).alias("value")).agg(F.count("*").alias("count"), F.avg(y).alias("mean"), F.stddev(y).alias("std")).where("value is not null").orderBy(F.desc("mean"), "value").limit(15)
    if feature in numeric:
        x = quoted(feature).cast("double")
        return df.groupBy(_grouped(df, target, top).alias("value")).agg(F.percentile(x, F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0)))).alias("quartiles")).where("value is not null")
    cells = df.groupBy(_grouped(df, feature, 8).alias("value"), _grouped(df, target, 5).alias("target")).agg(F.count("*").alias("count")).where("value is not null and target is not null")
    return cells.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy("value")))
