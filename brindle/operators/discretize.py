"""Numeric binning, grouping of rare categories and discretisation of targets."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .distributions import histogram
from .entropy import numeric_columns
from .ranks import quantiles
from .search import as_text, quoted

METHODS = ("auto", "quantile", "equal_width", "sturges", "freedman_diaconis", "jenks")
#: Distinct values up to which natural breaks are found on the values themselves; beyond, on cells that are cut again where a break falls.
JENKS_VALUES = 1_000_000
#: Cells of a range, and ranges that one pass cuts.
JENKS_CELLS, JENKS_RANGES = 4_096, 16


def column_type(df: DataFrame, name: str) -> str:
    """numeric, unless fewer than 20 distinct values make less than 5 % of the rows."""
    if name not in numeric_columns(df):
        return "categorical"
    n, d = df.agg(F.count(quoted(name)), F.count_distinct(quoted(name))).first()
    return "categorical" if n and d / n < 0.05 and d < 20 else "numeric"


def _cuts(w: np.ndarray, sx: np.ndarray, sq: np.ndarray, k: int) -> list[int]:
    """Where k classes of least squared deviation begin, but for the first, among blocks in order with their weights, sums and sums of squares.

    Exact dynamic programming; the best last cut never moves back as blocks are added, so the middle of each range
    is solved first and bounds both halves, all ranges of a level at once.
    """
    n, k = len(w), min(k, len(w))
    cw, cx, cq = (np.concatenate(([0.0], np.cumsum(v))) for v in (w, sx, sq))

    def cost(i, j):  # of the class of blocks i..j-1
        return (cq[j] - cq[i]) - (cx[j] - cx[i]) ** 2 / (cw[j] - cw[i])

    best = np.concatenate(([0.0], cost(0, np.arange(1, n + 1))))
    back = []
    for c in range(1, k):
        now, where = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        # Ranges of ends lo..hi whose last cut lies in first..last.
        lo, hi, first, last = (np.array([v]) for v in (n if c == k - 1 else c + 1, n, c, n - 1))
        while len(lo):
            j = (lo + hi) // 2
            count = np.minimum(last, j - 1) - first + 1
            starts = np.cumsum(count) - count
            i = np.arange(count.sum()) - np.repeat(starts - first, count)
            costs = best[i] + cost(i, np.repeat(j, count))
            least = np.minimum.reduceat(costs, starts)
            ties = np.flatnonzero(costs == np.repeat(least, count))
            now[j], where[j] = least, i[ties[np.searchsorted(ties, starts)]]
            cut = where[j]
            lo, hi, first, last = (np.concatenate(v) for v in ((lo, j + 1), (j - 1, hi), (first, cut), (cut, last)))
            some = lo <= hi
            lo, hi, first, last = lo[some], hi[some], first[some], last[some]
        best = now
        back.append(where)
    out, j = [], n
    for where in reversed(back):
        j = int(where[j])
        out.append(j)
    return out[::-1]


def jenks(values: Sequence[float], weights: Sequence[float], k: int) -> list[float]:
    """Inner breaks of k classes of least squared deviation: exact dynamic programming on sorted distinct values."""
    x, w = np.asarray(values, float), np.asarray(weights, float)
    y = x - (w @ x) / w.sum()
    y = y / (np.abs(y).max(initial=0.0) or 1.0)
    return [float((x[j - 1] + x[j]) / 2) for j in _cuts(w, w * y, w * y * y, k)]


def _jenks_by_cells(rows: DataFrame, lo: float, hi: float, mean: float, k: int) -> list[float]:
    """Breaks as of ``jenks`` for more values than the driver can hold.

    The range is cut into cells, each with its exact weight, sum and squares, and the best cuts between cells are found.
    Cells beside a cut, and those of most deviation, are cut again until each cell beside a cut is one value.
    """
    y = (F.col("v") - F.lit(mean)) / F.lit(max(hi - mean, mean - lo))
    parts = F.count("*").alias("n"), F.sum(y).alias("x"), F.sum(y * y).alias("q"), F.min("v").alias("a"), F.max("v").alias("b")
    blocks = np.empty((0, 5))
    todo = [(lo, hi)]
    while True:
        place = F.lit(None).cast("int")
        for r, (a, b) in enumerate(todo):
            at = F.least(F.floor((F.col("v") / 2 - F.lit(a / 2)) / F.lit(b / 2 - a / 2) * JENKS_CELLS), F.lit(JENKS_CELLS - 1)).cast("int")
            place = F.when(F.col("v").between(a, b), at + F.lit(r * JENKS_CELLS)).otherwise(place)
        got = rows.withColumn("p", place).where("p is not null").groupBy("p").agg(*parts).drop("p").toPandas().to_numpy(float)
        done = {a for a, _ in todo}
        blocks = np.concatenate((blocks[[a not in done for a in blocks[:, 3]]] if len(blocks) else blocks, got))
        blocks = blocks[np.argsort(blocks[:, 3])]
        n, x, q, first, last = blocks.T
        cuts = _cuts(n, x, q, k)
        wide = first < last
        beside = [i for j in cuts for i in (j - 1, j) if wide[i]]
        if not beside:
            return [float((last[j - 1] + first[j]) / 2) for j in cuts]
        near = [i for j in cuts for i in (j - 2, j + 1) if 0 <= i < len(n) and wide[i]]
        rest = np.argsort(np.where(wide, x * x / n - q, np.inf), kind="stable")[:JENKS_RANGES].tolist()
        chosen = list(dict.fromkeys(beside + near + [i for i in rest if wide[i]]))
        todo = [(float(first[i]), float(last[i])) for i in chosen[: max(JENKS_RANGES, len(beside))]]


@dataclass
class Discretizer:
    """Edges and labels of a numeric column; a value belongs to bin i if edge[i] <= x < edge[i + 1].

    ``auto`` takes natural breaks for two or more peaks, quantiles for a skew over 1.5,
    Freedman-Diaconis over 0.5, else quantiles. Bins below ``min_bin_size`` rows are merged into
    their smaller neighbour.
    """

    method: str = "auto"
    n_bins: int | None = None
    min_bin_size: int = 5
    max_bins: int = 10
    edges: list[float] = field(default_factory=list)  # inner edges
    labels: list[str] = field(default_factory=list)
    chosen: str = ""

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"unknown method {self.method}; one of {', '.join(METHODS)}")

    def fit(self, df: DataFrame, name: str) -> Discretizer:
        v = quoted(name).cast("double")
        rows = df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
        s = rows.agg(F.count("*").alias("n"), F.count_distinct("v").alias("d"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"), F.skewness("v").alias("skew")).first()
        self.edges, self.labels = [], []
        if not s.n or s.d < 2:
            self.chosen = self.method
            self.labels = [f"All values: {s.lo:g}"] if s.n else []
            return self
        self.chosen = self._select(rows, s) if self.method == "auto" else self.method
        k = self._count(rows, s)
        k = max(2, min(k, self.max_bins, s.d))
        inner = self._breaks(rows, s, k)
        inner = sorted({float(e) for e in inner if s.lo < e <= s.hi})
        self.edges = self._merged(rows, inner)
        self._label(s)
        return self

    def _select(self, rows: DataFrame, s) -> str:
        # Bins by Freedman and Diaconis or by Sturges, whichever are narrower; a peak is higher than both its neighbours.
        q1, q3 = quantiles(rows, {"v": F.col("v")}, [0.25, 0.75])["v"]
        width = (s.hi - s.lo) / (math.log2(s.n) + 1)
        if q3 > q1:
            width = min(width, 2 * (q3 - q1) / s.n ** (1 / 3))
        counts = [r["count"] for r in histogram(rows, "v", max(1, math.ceil((s.hi - s.lo) / width))).orderBy("bin").collect()]
        if sum(b > max(a, c) for a, b, c in zip(counts, counts[1:], counts[2:])) >= 2:
            return "jenks"
        skew = abs(s.skew or 0.0)
        return "quantile" if skew > 1.5 or skew <= 0.5 else "freedman_diaconis"

    def _count(self, rows: DataFrame, s) -> int:
        if self.n_bins:
            return self.n_bins
        if self.chosen == "sturges":
            return int(math.ceil(1 + math.log2(s.n)))
        if self.chosen == "freedman_diaconis":
            q = quantiles(rows, {"v": F.col("v")}, [0.25, 0.75])["v"]
            iqr = q[1] - q[0]
            return int(math.ceil((s.hi - s.lo) / (2 * iqr * s.n ** (-1 / 3)))) if iqr > 0 else 5
        return max(3, min(self.max_bins, int(math.sqrt(s.n))))

    def _breaks(self, rows: DataFrame, s, k: int) -> list[float]:
        if self.chosen in ("equal_width", "sturges", "freedman_diaconis"):
            return [s.lo + (s.hi - s.lo) * i / k for i in range(1, k)]
        if self.chosen == "quantile":
            return quantiles(rows, {"v": F.col("v")}, [i / k for i in range(1, k)])["v"]
        if not math.isfinite(s.mean):  # infinite values lie in the outermost classes
            rows = rows.where(F.abs("v") != F.lit(math.inf))
            s = rows.agg(F.count_distinct("v").alias("d"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean")).first()
            if s.d < 2:
                return []
        if s.d <= JENKS_VALUES:
            got = rows.groupBy("v").agg(F.count("*").alias("n")).toArrow()
            values, weights = got["v"].to_numpy(), got["n"].to_numpy()
            order = np.argsort(values)
            return jenks(values[order], weights[order], k)
        return _jenks_by_cells(rows, s.lo, s.hi, s.mean, k)

    def _merged(self, rows: DataFrame, inner: list[float]) -> list[float]:
        place = F.lit(0)
        for e in inner:
            place = place + (F.col("v") >= F.lit(e)).cast("int")
        got = {r.b: r.n for r in rows.groupBy(place.alias("b")).agg(F.count("*").alias("n")).collect()}
        counts = [got.get(i, 0) for i in range(len(inner) + 1)]
        while len(counts) > 1 and min(counts) < self.min_bin_size:
            i = counts.index(min(counts))
            j = 1 if i == 0 else i - 1 if i == len(counts) - 1 or counts[i - 1] <= counts[i + 1] else i + 1
            lo = min(i, j)
            counts[lo] += counts.pop(lo + 1)
            inner = inner[:lo] + inner[lo + 1 :]
        return inner

    def _label(self, s) -> None:
        span = s.hi - s.lo
        digits = 0 if span > 100 else 1 if span > 10 else 2 if span > 1 else 4
        text = lambda v: f"{v:.{digits}f}"
        e = self.edges
        if not e:
            self.labels = [f"{text(s.lo)} - {text(s.hi)}"]
            return
        self.labels = [f"≤ {text(e[0])}", *(f"{text(a)} - {text(b)}" for a, b in zip(e, e[1:])), f"> {text(e[-1])}"]
        if len(set(self.labels)) < len(self.labels):
            self.labels = [f"{label} ({i})" for i, label in enumerate(self.labels, 1)]

    def column(self, name: str) -> Column:
        """The label of each value; null for null."""
        v = quoted(name).cast("double")
        if not self.labels:
            return F.lit(None).cast("string")
        out = F.lit(self.labels[-1])
        for e, label in zip(reversed(self.edges), reversed(self.labels[:-1])):
            out = F.when(v < F.lit(e), F.lit(label)).otherwise(out)
        return F.when(v.isNotNull() & ~F.isnan(v), out)

    def transform(self, df: DataFrame, name: str, out: str | None = None) -> DataFrame:
        return df.withColumn(out or f"{name}_binned", self.column(name))

    def summary(self, df: DataFrame, name: str) -> DataFrame:
        return category_stats(df.select(self.column(name).alias("v")).where("v is not null"), "v")


def category_stats(df: DataFrame, name: str) -> DataFrame:
    """category, count, percent."""
    counts = df.groupBy(as_text(df, name).alias("category")).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("_t"))
    return counts.join(F.broadcast(total)).select("category", "count", (100.0 * F.col("count") / F.col("_t")).alias("percent"))


def bin_numeric(df: DataFrame, name: str, *, method: str = "quantile", n_bins: int = 5, min_bin_size: int = 5, out: str | None = None) -> DataFrame:
    """Adds <name>_binned: labels of bins, ``Missing`` for nulls, ``All values: v`` for a constant column."""
    d = Discretizer(method, n_bins, min_bin_size).fit(df, name)
    return df.withColumn(out or f"{name}_binned", F.coalesce(d.column(name), F.lit("Missing")))


def group_categories(df: DataFrame, name: str, *, top_n: int = 5, other: str = "Other", out: str | None = None) -> DataFrame:
    """Adds <name>_grouped: the top_n most frequent values (ties by value), others as ``Other``, nulls as ``Missing``."""
    t = as_text(df, name)
    top = [r.v for r in df.select(t.alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").limit(top_n).collect()]
    return df.withColumn(out or f"{name}_grouped", F.when(t.isNull(), F.lit("Missing")).when(t.isin(top), t).otherwise(F.lit(other)))


def auto_categorize(df: DataFrame, name: str, **options) -> tuple[DataFrame, str]:
    """Bins a numeric column, groups another; says which."""
    if column_type(df, name) == "numeric":
        return bin_numeric(df, name, **{k: v for k, v in options.items() if k in ("method", "n_bins", "min_bin_size")}), "binned"
    return group_categories(df, name, **{k: v for k, v in options.items() if k in ("top_n", "other")}), "grouped"


def discretize_target(df: DataFrame, name: str, *, method: str = "auto", n_bins: int | None = None, in_place: bool = False) -> tuple[DataFrame, Discretizer]:
    d = Discretizer(method, n_bins).fit(df, name)
    return d.transform(df, name, name if in_place else None), d
