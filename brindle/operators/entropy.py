"""Shannon entropy of columns, as a ranking of how much they tell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .search import as_text, quoted

#: Kinds that are cut into bins if they have more than BINS distinct values.
NUMERIC = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DecimalType)
BINS = 10


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def profile(df: DataFrame, bins: int = BINS) -> DataFrame:
    """column, entropy, normalized_entropy and importance, highest first.

    One pass finds ranges and distinct counts (one row), a second counts (column, bin) pairs of all
    columns together; counts meet by column only after partial aggregation.
    """
    numeric = set(numeric_columns(df))
    names = df.columns
    if not names:
        return df.sparkSession.createDataFrame([], "column string, entropy double, normalized_entropy double, importance string")
    facts = []
    for i, c in enumerate(names):
        if c in numeric:
            v = quoted(c).cast("double")
            v = F.when(~F.isnan(v), v)
            facts += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.approx_count_distinct(v, 0.01).alias(f"d{i}")]
    row = df.agg(*facts).first().asDict() if facts else {}
    # Close to the limit the estimate is replaced by an exact count.
    close = [i for i, c in enumerate(names) if c in numeric and bins / 2 <= row[f"d{i}"] <= 2 * bins]
    if close:
        row |= df.agg(*(F.count_distinct(quoted(names[i])).alias(f"d{i}") for i in close)).first().asDict()

    def bucket(i: int, c: str):
        if c in numeric and row[f"d{i}"] > bins:
            lo, hi = row[f"lo{i}"], row[f"hi{i}"]
            v = quoted(c).cast("double")
            place = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil((v - F.lit(lo)) * bins / F.lit(hi - lo))))
            return F.when(~F.isnan(v), place.cast("string"))
        return as_text(df, c)

    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), bucket(i, c).alias("bin")) for i, c in enumerate(names))))
    counts = df.select(cells.alias("x")).select("x.*").where("bin is not null").groupBy("column", "bin").agg(F.count("*").alias("n"))
    # Entropy from sums: log2(N) - sum(n log2 n) / N.
    sums = counts.groupBy("column").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    known = sums.select("column", F.greatest(F.lit(0.0), F.log2("t") - F.col("s") / F.col("t")).alias("entropy"))
    every = df.sparkSession.createDataFrame([(c,) for c in names], "column string")
    out = every.join(known, "column", "left").select("column", F.coalesce("entropy", F.lit(0.0)).alias("entropy"))
    top = out.agg(F.max("entropy").alias("_top"))
    share = F.when(F.col("_top") > 0, F.col("entropy") / F.col("_top")).otherwise(F.lit(0.0))
    level = F.when(F.col("normalized_entropy") >= 0.8, "High").when(F.col("normalized_entropy") >= 0.5, "Medium").when(F.col("normalized_entropy") >= 0.3, "Low").otherwise("Very Low")
    return out.join(F.broadcast(top)).withColumn("normalized_entropy", share).withColumn("importance", level).drop("_top").orderBy(F.desc("entropy"), "column")


def column_entropy(df: DataFrame, name: str, bins: int = BINS) -> float:
    return profile(df.select(quoted(name).alias(name)), bins).first().entropy


__all__ = ["column_entropy", "numeric_columns", "profile"]


def pearson(x, y):
    """Correlation of complete pairs; null where one of the two does not vary."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))
