"""CN2 rule induction: separate and conquer with beam search; every beam level is one aggregation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .discretize import Discretizer
from .entropy import numeric_columns
from .ranks import distinct_counts, quantiles
from .search import as_text, quoted

MEASURES = ("likelihood_ratio", "entropy")


@dataclass(frozen=True)
class Condition:
    feature: str
    op: str  # == <= >
    value: object

    def __str__(self) -> str:
        return f"{self.feature} {self.op} {self.value}"

    def column(self, df: DataFrame) -> Column:
        if isinstance(self.value, (int, float)) and not isinstance(self.value, bool):
            c = _number(df, self.feature)
        else:
            c = as_text(df, self.feature)
        hit = {"==": c == F.lit(self.value), "<=": c <= F.lit(self.value), ">": c > F.lit(self.value)}[self.op]
        return F.coalesce(hit, F.lit(False))  # null never matches


@dataclass
class Rule:
    conditions: list[Condition]
    prediction: str
    coverage: int
    accuracy: float
    quality: float
    counts: dict[str, int] = field(default_factory=dict)

    def __str__(self) -> str:
        return f"IF {' AND '.join(map(str, self.conditions))} THEN {self.prediction}"

    def column(self, df: DataFrame) -> Column:
        return reduce(lambda a, b: a & b, [c.column(df) for c in self.conditions])


def _is_time(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))


def _number(df: DataFrame, c: str) -> Column:
    if _is_time(df, c):
        return F.unix_micros(quoted(c).cast("timestamp")) / 1e6
    return quoted(c).cast("double")


def quality(covered: Sequence[int], totals: Sequence[int], measure: str) -> float:
    n, k = sum(covered), len(totals)
    if not n:
        return -math.inf
    if measure == "likelihood_ratio":
        return 2 * sum(c * math.log(c / (n / k) + 1e-10) for c in covered if c)
    h = -sum(c / n * math.log2(c / n) for c in covered if c)
    return n / sum(totals) * (1 - h / math.log2(k) if k > 1 else 1.0)


@dataclass
class CN2:
    max_rules: int = 10
    beam_width: int = 3
    min_covered: int = 5
    max_length: int = 3
    measure: str = "likelihood_ratio"
    bins: int = 4
    laplace: bool = True
    rules: list[Rule] = field(default_factory=list)
    classes: list[str] = field(default_factory=list)
    default: str | None = None

    def __post_init__(self):
        if self.measure not in MEASURES:
            raise ValueError(f"unknown quality measure {self.measure}")

    def conditions(self, df: DataFrame, features: Sequence[str]) -> list[Condition]:
        """Numbers: ``==`` up to ``bins`` distinct values, else <= and > at quantiles; others: == for the ten most frequent values."""
        numeric = [f for f in features if f in numeric_columns(df) or _is_time(df, f)]
        out: list[Condition] = []
        if numeric:
            cuts = quantiles(df, {f: _number(df, f) for f in numeric}, [i / self.bins for i in range(1, self.bins)])
            distinct = distinct_counts(df.select(*(_number(df, f).cast("double").alias(f) for f in numeric)), numeric)
            for f in numeric:
                if distinct[f] <= self.bins:
                    values = [r[0] for r in df.select(_number(df, f).alias("v")).where("v is not null").distinct().orderBy("v").collect()]
                    out += [Condition(f, "==", v) for v in values]
                else:
                    out += [Condition(f, op, float(q)) for q in sorted(set(cuts[f] or [])) for op in ("<=", ">")]
        for f in features:
            if f not in numeric:
                top = df.select(as_text(df, f).alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").limit(10).collect()
                out += [Condition(f, "==", r.v) for r in top]
        return out

    def fit(self, df: DataFrame, target: str, features: Sequence[str] | None = None) -> CN2:
        """Learn rules for the text of ``target``; rows without it are left out.

        Conditions are bits of an integer array per row, and rows with equal bits and class
        are counted once, so the search works on a table of distinct patterns.
        """
        features = list(features or [c for c in df.columns if c != target])
        known = df.where(quoted(target).isNotNull())
        totals = {r.y: r.n for r in known.groupBy(as_text(df, target).alias("y")).agg(F.count("*").alias("n")).collect()}
        self.classes, self.rules = sorted(totals), []
        if not self.classes:
            raise ValueError("no rows with a target")
        self.default = max(self.classes, key=lambda c: (totals[c], c))
        conds = self.conditions(known, features)
        bits = F.array(*(c.column(known) for c in conds)) if conds else F.array()
        patterns = known.select(as_text(df, target).alias("y"), bits.alias("b")).groupBy("y", "b").agg(F.count("*").alias("n")).cache()
        try:
            left = patterns
            while conds and len(self.rules) < self.max_rules:
                rule = self._best(left, conds)
                if rule is None:
                    break
                self.rules.append(rule)
                picked = [conds.index(c) for c in rule.conditions]
                left = left.where(~reduce(lambda a, b: a & b, [F.col("b")[i] for i in picked]))
        finally:
            patterns.unpersist()
        return self

    def _best(self, left: DataFrame, conds: list[Condition]) -> Rule | None:
        totals = {r.y: r.n for r in left.groupBy("y").agg(F.sum("n").alias("n")).collect()}
        if sum(totals.values()) < self.min_covered:
            return None
        order = [totals.get(c, 0) for c in self.classes]
        beam: list[tuple[int, ...]] = [()]
        best: tuple[float, Rule] | None = None
        for _ in range(self.max_length):
            tried = list(dict.fromkeys(tuple(sorted((*base, i))) for base in beam for i, c in enumerate(conds) if c.feature not in {conds[j].feature for j in base}))
            if not tried:
                break
            sums = [F.sum(F.when(reduce(lambda a, b: a & b, [F.col("b")[i] for i in t]), F.col("n")).otherwise(0)).alias(f"t{k}") for k, t in enumerate(tried)]
            rows = {r.y: r for r in left.groupBy("y").agg(*sums).collect()}
            scored = []
            for k, t in enumerate(tried):
                counts = [int(rows[c][f"t{k}"] or 0) if c in rows else 0 for c in self.classes]
                n = sum(counts)
                if n < self.min_covered:
                    continue
                q, most = quality(counts, order, self.measure), max(counts)
                scored.append((q, t, counts))
                accuracy = most / n
                if accuracy >= 0.5 and (best is None or q > best[0] + 1e-12):
                    best = (q, Rule([conds[i] for i in t], self.classes[counts.index(most)], n, accuracy, q, dict(zip(self.classes, counts))))
            scored.sort(key=lambda s: (-s[0], s[1]))
            beam = [t for _, t, _ in scored[: self.beam_width]]
            if not beam:
                break
        return best[1] if best else None

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Adds the class of the first rule that matches, else the commonest class."""
        value = F.lit(self.default)
        for r in reversed(self.rules):
            value = F.when(r.column(df), F.lit(r.prediction)).otherwise(value)
        return df.withColumn(out, value)

    def predict_proba(self, df: DataFrame, out: str = "probabilities") -> DataFrame:
        """Adds a map of class -> probability of the first rule that matches (Laplace), uniform if none does."""
        k = len(self.classes)
        as_map = lambda ps: F.create_map(*(x for c, p in zip(self.classes, ps) for x in (F.lit(c), F.lit(float(p)))))
        value = as_map([1 / k] * k)
        for r in reversed(self.rules):
            add = 1 if self.laplace else 0
            value = F.when(r.column(df), as_map([(r.counts[c] + add) / (r.coverage + add * k) for c in self.classes])).otherwise(value)
        return df.withColumn(out, value)

    def rules_table(self, spark) -> DataFrame:
        rows = [(i, str(r), r.prediction, r.coverage, float(r.accuracy), float(r.quality), len(r.conditions)) for i, r in enumerate(self.rules, 1)]
        return spark.createDataFrame(rows, "rule_id int, rule string, prediction string, coverage bigint, accuracy double, quality double, length int")

    def score(self, df: DataFrame, target: str) -> float:
        return self.predict(df.where(quoted(target).isNotNull()), "_p").agg(F.avg((F.col("_p") == as_text(df, target)).cast("double"))).first()[0] or 0.0


def discover_rules(df: DataFrame, target: str, **options) -> CN2:
    """Rules for a column: a numeric one of over 15 values is discretised first; other columns may have 2 to 50 classes."""
    distinct = df.agg(F.count_distinct(quoted(target))).first()[0]
    if distinct < 2:
        raise ValueError(f"{target} has fewer than two classes")
    if target in numeric_columns(df) and distinct > 15:
        df = Discretizer().fit(df, target).transform(df, target, target)
    elif distinct > 50:
        raise ValueError(f"{target} has {distinct} classes; at most 50 are supported")
    return CN2(**({"beam_width": 5} | options)).fit(df, target)
