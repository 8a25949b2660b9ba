"""Column statistics, best-fitting distributions and the data behind histograms, box plots, Q-Q plots and ECDFs."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .entropy import numeric_columns
from .ranks import distinct_counts, quantiles, running_total
from .search import as_text, quoted

FITS = "distribution string, parameters array<double>, sse double, ks double, p_value double"
MAX_BINS = 512


def column_stats(df: DataFrame) -> DataFrame:
    """One row per column: rows, missing, distinct, and for numbers min, max, mean, median, sample deviation, population skewness and excess kurtosis.

    One pass for the moments, one shuffle of (column, value) for distinct values, and the passes of exact ranks for medians.
    """
    numeric = set(numeric_columns(df))
    null = F.lit(None).cast("double")
    aggs, names = [F.count("*").alias("n")], df.columns
    for i, c in enumerate(names):
        v = quoted(c).cast("double")
        aggs.append(F.count(quoted(c)).alias(f"k{i}"))
        if c in numeric:
            for p, f in (("lo", F.min), ("hi", F.max), ("av", F.avg), ("sd", F.stddev), ("sk", F.skewness), ("ku", F.kurtosis)):
                aggs.append(f(v).alias(f"{p}{i}"))
    distinct = distinct_counts(df, names)
    medians = quantiles(df, {c: quoted(c) for c in names if c in numeric}, [0.5])
    exact = {f"d{i}": F.lit(distinct[c]).cast("long") for i, c in enumerate(names)}
    exact |= {f"me{i}": F.lit((medians[c] or [None])[0]).cast("double") for i, c in enumerate(names) if c in numeric}
    one = df.agg(*aggs).withColumns(exact)
    value = lambda p, i, c: (F.col(f"{p}{i}") if c in numeric else null)
    cells = [
        F.struct(F.lit(c).alias("column"), F.lit("numeric" if c in numeric else "categorical").alias("type"), F.col("n").alias("rows"), (F.col("n") - F.col(f"k{i}")).alias("missing"), F.col(f"d{i}").alias("distinct"), *(value(p, i, c).alias(a) for p, a in (("lo", "min"), ("hi", "max"), ("av", "mean"), ("me", "median"), ("sd", "std"), ("sk", "skewness"), ("ku", "kurtosis"))))
        for i, c in enumerate(names)
    ]
    return one.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def top_values(df: DataFrame, name: str, n: int = 5) -> DataFrame:
    """value, count: the n most frequent non-null values; ties by value."""
    return df.select(as_text(df, name).alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(n)


def histogram(df: DataFrame, name: str, bins: int) -> DataFrame:
    """bin, low, high, count: equal-width bins, the last closed on both sides."""
    v = quoted(name).cast("double")
    rows = df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    lo, hi = rows.agg(F.min("v"), F.max("v")).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, count bigint")
    width = (hi - lo) / bins or 1.0
    place = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = rows.groupBy(place.alias("bin")).agg(F.count("*").alias("count"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("low"), (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("high"), F.coalesce("count", F.lit(0)).alias("count"))


def box_plot(df: DataFrame, name: str) -> DataFrame:
    """Quartiles, whiskers at 1.5 IQR and how many values lie beyond."""
    v = quoted(name).cast("double")
    q1, mid, q3 = quantiles(df, {name: v}, [0.25, 0.5, 0.75])[name] or [None] * 3
    fence = [F.lit(x).cast("double") for x in ((q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)) if q1 is not None else (None, None))]
    inside = v.between(*fence)
    return df.agg(*(F.lit(x).cast("double").alias(n) for n, x in (("q1", q1), ("median", mid), ("q3", q3))), F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"), F.count(F.when(~inside, 1)).alias("outliers"))


def ecdf(df: DataFrame, name: str) -> DataFrame:
    """value, share: the share of rows at or below each distinct value; distinct values are counted before they are ordered."""
    counts = df.select(quoted(name).cast("double").alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return running_total(counts, "value", F.col("n"), "upto").join(F.broadcast(total)).select("value", (F.col("upto") / F.col("t")).alias("share"))


def qq_normal(df: DataFrame, name: str, points: int = 99) -> DataFrame:
    """theoretical, sample: quantiles of the standard normal and of the column."""
    shares = [(i + 1) / (points + 1) for i in range(points)]
    got = quantiles(df, {name: quoted(name)}, shares)[name] or [None] * points
    return df.sparkSession.createDataFrame([(NormalDist().inv_cdf(s), q) for s, q in zip(shares, got)], "theoretical double, sample double")


def _digamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    return out + math.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)


def _gamma_cdf(a: float, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma, by its series or continued fraction."""

    def one(v: float) -> float:
        if v <= 0:
            return 0.0
        head = math.exp(min(700.0, -v + a * math.log(v) - math.lgamma(a)))
        if v < a + 1:
            term = total = 1 / a
            k = a
            for _ in range(500):
                k += 1
                term *= v / k
                total += term
                if term < total * 1e-14:
                    break
            return min(1.0, head * total)
        b, c = v + 1 - a, 1e300
        d = 1 / b
        h = d
        for i in range(1, 500):
            an = -i * (i - a)
            b += 2
            d = 1 / (an * d + b or 1e-300)
            c = b + an / c or 1e-300
            h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return 1 - head * h

    return np.array([one(float(v)) for v in x])


def _beta_cdf(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """By Simpson's rule on t = sin^2(u), which removes the poles of the density for a, b >= 1/2."""
    lbeta = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)

    def one(v: float) -> float:
        if v <= 0 or v >= 1:
            return float(v >= 1)
        u = np.linspace(1e-12, math.asin(math.sqrt(v)), 801)
        f = np.exp(math.log(2) - lbeta + (2 * a - 1) * np.log(np.sin(u)) + (2 * b - 1) * np.log(np.cos(u)))
        return float(min(1.0, (u[1] - u[0]) / 3 * (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum())))

    return np.array([one(float(v)) for v in x])


def _ks_p(d: float, n: int) -> float:
    """Kolmogorov's limit with Stephens' correction."""
    t = d * (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n))
    if t < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101))))


def fit_distributions(df: DataFrame, name: str) -> DataFrame:
    """Normal, uniform, exponential, lognormal, gamma and beta, best (least squared error of the density) first.

    Parameters are maximum-likelihood (beta: moments) from one aggregation; densities are compared
    on a histogram (Freedman-Diaconis or Sturges bins, whichever are more, at most 512), and the
    distance of Kolmogorov and Smirnov is taken at its edges. Columns of one distinct value are
    ``constant``, of fewer than five ``discrete``.
    """
    spark = df.sparkSession
    v = quoted(name).cast("double")
    rows = df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    s = rows.agg(F.count("*").alias("n"), F.approx_count_distinct("v").alias("d"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd")).first()
    if not s.n or s.lo == s.hi:
        return spark.createDataFrame([("constant", [s.lo or 0.0], 0.0, 0.0, 1.0)] if s.n else [], FITS)
    if s.d < 8 and rows.distinct().count() < 5:
        return spark.createDataFrame([("discrete", [], 0.0, 0.0, 1.0)], FITS)
    q = quantiles(rows, {"v": F.col("v")}, [0.25, 0.75])["v"]
    span, iqr = s.hi - s.lo, q[1] - q[0]
    bins = max(math.ceil(math.log2(s.n)) + 1, math.ceil(span / (2 * iqr * s.n ** (-1 / 3))) if iqr > 0 else 1)
    bins = min(bins, MAX_BINS)
    # Logarithms of the distance to a point just below the least value.
    shift = s.lo - span * 1e-6
    y = F.col("v") - F.lit(shift)
    logs = rows.agg(F.avg(F.log(y)).alias("m"), F.stddev_pop(F.log(y)).alias("s"), F.avg(y).alias("a")).first()
    counts = np.array([r["count"] for r in histogram(rows, "v", bins).orderBy("bin").collect()], float)
    edges = np.linspace(s.lo, s.hi, bins + 1)
    density, below = counts / counts.sum() / (span / bins), np.concatenate(([0], counts.cumsum())) / counts.sum()
    mid = (edges[1:] + edges[:-1]) / 2
    normal = np.vectorize(NormalDist().cdf)
    found = []

    def add(label, parameters, pdf, cdf):
        ks = float(np.abs(cdf(edges) - below).max())
        found.append((label, [float(p) for p in parameters], float(((pdf(mid) - density) ** 2).sum()), ks, _ks_p(ks, s.n)))

    add("normal", (s.mean, s.sd), lambda x: np.exp(-(((x - s.mean) / s.sd) ** 2) / 2) / (s.sd * math.sqrt(2 * math.pi)), lambda x: normal((x - s.mean) / s.sd))
    add("uniform", (s.lo, span), lambda x: np.full(len(x), 1 / span), lambda x: (x - s.lo) / span)
    scale = s.mean - s.lo
    add("exponential", (s.lo, scale), lambda x: np.exp(-(x - s.lo) / scale) / scale, lambda x: 1 - np.exp(-(x - s.lo) / scale))
    if logs.s > 0:
        z = lambda x: (np.log(np.maximum(x - shift, 1e-300)) - logs.m) / logs.s
        add("lognormal", (logs.s, shift, math.exp(logs.m)), lambda x: np.exp(-(z(x) ** 2) / 2) / ((x - shift) * logs.s * math.sqrt(2 * math.pi)), lambda x: normal(z(x)))
        t = math.log(logs.a) - logs.m
        k = (3 - t + math.sqrt((t - 3) ** 2 + 24 * t)) / (12 * t)
        for _ in range(30):  # Newton steps on log k - digamma(k) = t
            step = (math.log(k) - _digamma(k) - t) / (1 / k - (_digamma(k * 1.0001) - _digamma(k)) / (k * 0.0001))
            k = max(k - step, k / 2)
        theta = logs.a / k
        add("gamma", (k, shift, theta), lambda x: np.exp((k - 1) * np.log(x - shift) - (x - shift) / theta - math.lgamma(k) - k * math.log(theta)), lambda x: _gamma_cdf(k, (x - shift) / theta))
    m, var = (s.mean - s.lo) / span, (s.sd / span) ** 2
    both = m * (1 - m) / var - 1
    if both > 0 and 0 < m < 1:
        a, b = m * both, (1 - m) * both
        lbeta = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
        u = lambda x: np.clip((x - s.lo) / span, 1e-9, 1 - 1e-9)
        add("beta", (a, b, s.lo, span), lambda x: np.exp((a - 1) * np.log(u(x)) + (b - 1) * np.log(1 - u(x)) - lbeta) / span, lambda x: _beta_cdf(a, b, (x - s.lo) / span))
    return spark.createDataFrame(sorted(found, key=lambda r: (r[2], r[0])), FITS)


def profile(df: DataFrame) -> dict:
    """Statistics of all columns, best fits of the numeric ones and the top values of the others."""
    numeric = set(numeric_columns(df))
    return {"stats": column_stats(df), "fits": {c: fit_distributions(df, c) for c in df.columns if c in numeric}, "top": {c: top_values(df, c) for c in df.columns if c not in numeric}}
