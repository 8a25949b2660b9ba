"""Quality classifier: a sparse ensemble of rules over statistics of the text.

Trees are boosted on a bounded sample of labelled texts; the path to every node is a conjunctive
rule. Lasso logistic regression over the rules keeps few of them, and those are compiled into one
Spark column expression over statistics columns. Statistics cover each whole text; the
language, source, id and labels are no inputs. The sample's statistics, not its texts, reach the
driver. Null and empty texts have zero statistics and a score as any other; very long texts are
read whole, each by itself. Rows that repeat are scored each, and learned from once; where
labels of one id differ, 1 counts. A score equal to the threshold is predicted 1. Without labelled rows of
both classes every score is the share of ones (0.5 without any). Extra columns, also ones with names of the
result, are ignored, an empty table has no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._learn import boost, fold, labelled_rows, lasso_logistic
from ._textvec import slices

#: Labelled rows the rules are learned from, at most.
SAMPLE = 8_000
STATISTICS = ["log_bytes", "words", "word_bytes", "distinct", "upper", "digit", "space", "sentence_end", "comma", "loud", "symbol", "bar", "markup", "other_ascii", "non_ascii", "lines", "line_bytes", "repeated_lines", "longest_word", "top_word", "lines_ended", "first_upper"]
_KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\n\r\x0b\x0c", "sentence_end": b".?", "comma": b",;:", "loud": b"!", "symbol": b"#$%&*@^~", "bar": b"|", "markup": b"<>{}[]=/\\_"}
_LETTER = b"abcdefghijklmnopqrstuvwxyz"
_TABLE = np.zeros((256, len(_KINDS) + 2))
for _j, _chars in enumerate(_KINDS.values()):
    _TABLE[list(_chars), _j] = 1
_TABLE[128:, -1] = 1
_TABLE[[b for b in range(128) if not _TABLE[b].any() and b not in _LETTER], -2] = 1


def statistics(text: bytes) -> list[float]:
    n = len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _TABLE / n
    words = text.split()
    k = max(len(words), 1)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = max(len(lines), 1)
    kinds = counts.tolist()
    return [
        float(np.log1p(n)),
        float(np.log1p(len(words))),
        sum(map(len, words)) / k,
        len(seen) / k,
        *kinds,
        float(np.log1p(len(lines))),
        float(np.log1p(n / m)),
        1 - len(set(lines)) / m,
        float(max(map(len, words), default=0)),
        max(seen.values(), default=0) / k,
        sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / m,
        float(text.lstrip()[:1].isupper()),
    ]


def statistics_table(rows: DataFrame, kind: str) -> DataFrame:
    """rows: id, t -> id and the statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in slices(batch, 1):
                x = np.array([statistics(t) for t in raw])
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in x.T)], ["id", *STATISTICS])

    return rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"{s} double" for s in STATISTICS))


@dataclass
class Rules:
    """intercept + sum of weight * (all conditions hold), through the logistic function."""

    intercept: float
    rules: list[tuple[float, tuple]]

    def column(self) -> Column:
        z = F.lit(self.intercept)
        for weight, conditions in self.rules:
            holds = F.lit(True)
            for j, is_left, t in conditions:
                c = F.col(STATISTICS[j])
                holds = holds & ((c <= t) if is_left else (c > t))
            z = z + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-z))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for weight, conditions in self.rules:
            z += weight * _holds(x, conditions)
        return 1 / (1 + np.exp(-z))


def _holds(x: np.ndarray, conditions: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, is_left, t in conditions:
        out &= (x[:, j] <= t) if is_left else (x[:, j] > t)
    return out


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, l1: float = 0.002) -> Rules:
    """x: statistics of labelled texts, y: their labels."""
    if len(set(y)) < 2:
        share = y.mean() if len(y) else 0.5
        return Rules(float(np.log((share + 1e-3) / (1 - share + 1e-3))), [])
    _, grown = boost(x, y, trees=trees, depth=depth, rate=0.3, least=max(2, len(y) // 200))
    paths = list(dict.fromkeys(tuple(dict.fromkeys(p)) for tree in grown for p in tree.paths()))
    kept, columns = [], {}
    for p in paths:  # rules that hold for the same rows, or the opposite ones, count once
        h = _holds(x, p)
        if 0 < h.sum() < len(h) and h.tobytes() not in columns and (~h).tobytes() not in columns:
            columns[h.tobytes()] = h
            kept.append(p)
    m = np.stack(list(columns.values()), axis=1).astype(float)
    centre = m.mean(axis=0)
    intercept, w = lasso_logistic(m - centre, y, l1)
    return Rules(intercept - float(centre @ w), [(float(v), p) for v, p in zip(w, kept) if abs(v) > 1e-6])


def score_table(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", *, folds: int = 4, held: int = 2, threshold: float = 0.7, limit: int = SAMPLE) -> DataFrame:
    """key, held_out, score, predicted and the statistics for each row of ``docs``."""
    sample = labelled_rows(docs, labels, key, text, label, folds=folds, held=held, limit=limit)
    known = sorted(statistics_table(sample.select(F.struct("h", "y").alias("id"), "t"), "struct<h: bigint, y: int>").collect())
    rules = fit(np.array([r[1:] for r in known], float).reshape(len(known), len(STATISTICS)), np.array([r.id.y for r in known], float))
    stats = statistics_table(docs.select(F.col(key).alias("id"), F.col(text).alias("t")), docs.schema[key].dataType.simpleString())
    scored = stats.withColumn("score", rules.column())
    return scored.select(F.col("id").alias(key), F.coalesce(fold(F.col("id"), folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *STATISTICS)
