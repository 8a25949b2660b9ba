"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's score is a logistic function of its words; the document's is their noisy-or,
1 - product of (1 - sentence score). Only document labels are known, so the noisy-or
likelihood is maximised over a bounded labelled sample, with a lasso that leaves few words, whose
strength is the one that fits a third of the sample best after learning from the rest. The
sentence scores then locate the sentences that offend: those that reach the threshold or,
in a document that only reaches it through several, the highest one (the first of equal ones).

Words are lower-cased and freed of ASCII punctuation; a word and its first bytes (a rough stem) count if
they occur in ``LEAST_DOCS`` sampled documents and are so much more or less frequent in toxic ones
that chance is unlikely. They are counted in Spark; only the words left and the sentences that hold
them reach the driver. Sentences end at ``. ! ?`` or a new line.

Null and empty texts have no sentence and score 0, and so do all texts if no labels of both kinds are
known. Very long texts are read whole, each by itself. Rows that repeat are scored each, and learned
from once; where labels of one id differ, 1 counts. A score equal to the threshold is predicted 1. Extra columns are
ignored unless named, an empty table has no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._learn import fold, labelled_rows, sigmoid
from ._textvec import U, Words, mix, slices

#: Labelled rows the words are learned from, at most.
SAMPLE = 10_000
LEAST_DOCS = 3
#: Bytes of a rough stem; standard deviations from an even share that a word must show.
STEM = 5
SCREEN = 2.5
#: Documents' worth of evidence that the lasso takes for a word to count: the strengths tried.
PULLS = (0.3, 1.0, 3.0)
_ENDS = b".!?\n\r"
#: Letters stay, sentence ends become new lines, other ASCII becomes spaces; bytes of other scripts stay.
_CLEAN = bytes(10 if b in _ENDS else b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass
class Bags:
    """Words of some texts by sentence: ``hash`` and ``sentence`` of each word, ``text`` of each sentence, byte spans."""

    hash: np.ndarray
    sentence: np.ndarray
    text: np.ndarray
    start: np.ndarray
    stop: np.ndarray


def bags(raw: list[bytes]) -> Bags:
    w = Words([t.translate(_CLEAN) for t in raw])
    line = np.cumsum(np.frombuffer(w.buf, np.uint8) == 10)[w.starts]
    new = np.concatenate(([True], line[1:] != line[:-1])) if len(line) else np.empty(0, bool)
    at = np.flatnonzero(new)
    text = np.searchsorted(w.first, at, "right") - 1
    begins = 1 + np.concatenate(([0], np.cumsum([len(t) + 1 for t in raw])))
    last = np.concatenate((at[1:], [len(line)])) - 1 if len(at) else at
    sentence = np.cumsum(new) - 1
    stem = mix(w.starts_hash(STEM) ^ U(0x57E3))
    return Bags(np.concatenate((w.hash, stem)), np.concatenate((sentence, sentence)), text, w.starts[at] - begins[text], w.ends[last] - begins[text])


@dataclass
class Model:
    """Sorted word hashes, their weights, and the weight of any sentence."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    def sentences(self, b: Bags) -> np.ndarray:
        """Score of each sentence."""
        n = len(b.text)
        if not n or not len(self.words):
            return np.full(n, sigmoid(np.array(self.bias)))
        at = np.minimum(np.searchsorted(self.words, b.hash), len(self.words) - 1)
        hit = self.words[at] == b.hash
        return sigmoid(self.bias + np.bincount(b.sentence[hit], self.weights[at[hit]], n))

    def texts(self, b: Bags, count: int) -> np.ndarray:
        p = self.sentences(b)
        return -np.expm1(np.bincount(b.text, np.log1p(-np.minimum(p, 1 - 1e-12)), count)) if len(p) else np.zeros(count)


def _once(b: Bags) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each word of each text, once."""
    owner = b.text[b.sentence]
    order = np.lexsort((b.hash, owner))
    h, o = b.hash[order], owner[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (o[1:] != o[:-1]))) if len(h) else np.empty(0, bool)
    return h[new], o[new]


def _learns(h: Column) -> Column:
    """The two thirds of the sample that the choice of the strength learns from."""
    return F.pmod(F.xxhash64(h), F.lit(3)) != 0


def _screen(sample: DataFrame, least: int) -> np.ndarray:
    """Sorted hashes of the words that tell toxic texts of the sample (y, t) apart."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in slices(batch, 1):
                h, o = _once(bags(raw))
                words, which = np.unique(h, return_inverse=True)
                bad = np.bincount(which, part.column(0).to_numpy()[o], len(words)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(np.bincount(which, minlength=len(words)).astype(np.int64)), pa.array(bad)], ["h", "docs", "bad"])

    even = sample.agg(F.avg("y")).first()[0]
    words = sample.select("y", "t").mapInArrow(count, "h bigint, docs bigint, bad bigint").groupBy("h").agg(F.sum("docs").alias("docs"), F.sum("bad").alias("bad"))
    apart = F.abs(F.col("bad") - F.col("docs") * even) >= SCREEN * F.sqrt(F.col("docs") * even * (1 - even))
    return np.sort(words.where((F.col("docs") >= least) & apart).select("h").toArrow()["h"].to_numpy().view(np.uint64))


@dataclass
class Sample:
    """Sentences of some labelled texts: ``text`` of each sentence, and the (sentence, word) pairs it holds, once each."""

    y: np.ndarray
    text: np.ndarray
    sentence: np.ndarray
    code: np.ndarray


def _sample(rows: DataFrame, words: np.ndarray) -> Sample:
    """rows: h, y, t."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = max(len(words), 1)
        for batch in batches:
            for part, raw in slices(batch, 2):
                b = bags(raw)
                at = np.minimum(np.searchsorted(words, b.hash), k - 1)
                hit = words[at] == b.hash if len(words) else np.zeros(len(b.hash), bool)
                pairs = np.unique(b.sentence[hit] * k + at[hit])
                first = np.searchsorted(b.text, np.arange(len(raw) + 1))
                cut = np.searchsorted(pairs, first * k)
                lists = [(pairs[i:j] - f * k) for i, j, f in zip(cut, cut[1:], first)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(first).astype(np.int64)), pa.array(lists, pa.list_(pa.int64()))], ["h", "y", "n", "pairs"])

    got = rows.select("h", "y", "t").mapInArrow(find, "h bigint, y int, n bigint, pairs array<bigint>").toArrow().sort_by("h")
    n, sizes = got["n"].to_numpy(), np.array([len(x) for x in got["pairs"]], np.int64)
    k = max(len(words), 1)
    flat = np.concatenate([x.values.to_numpy() for x in got["pairs"]] or [np.empty(0, np.int64)])
    return Sample(got["y"].to_numpy().astype(float), np.repeat(np.arange(len(n)), n), flat // k + np.repeat(np.cumsum(n) - n, sizes), flat % k)


def loss(s: Sample, w: np.ndarray, bias: float) -> float:
    """Mean negative log likelihood of the documents' labels under the noisy-or."""
    z = bias + np.bincount(s.sentence, w[s.code], len(s.text))
    total = np.bincount(s.text, np.logaddexp(0, z), len(s.y))
    return float(np.where(s.y > 0, -np.log(-np.expm1(-np.maximum(total, 1e-9))), total).mean())


def optimise(s: Sample, k: int, *, pull: float, steps: int = 200, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights of k words and the bias: proximal steps with moments on the noisy-or likelihood and the lasso."""
    y, t, first, n = s.y, s.text, len(s.text), len(s.y)
    share = min(max(y.mean(), 0.01), 0.9)
    l1 = pull / n
    b = float(np.log(np.expm1(-np.log1p(-share) / max(first / n, 1)) + 1e-9))
    w = np.zeros(k)
    m1, m2, mb1, mb2 = np.zeros(k), np.zeros(k), 0.0, 0.0
    for it in range(1, steps + 1):
        z = b + np.bincount(s.sentence, w[s.code], first)
        total = np.bincount(t, np.logaddexp(0, z), n)
        factor = np.where(y > 0, -1 / np.expm1(np.clip(total, 1e-6, 60)), 1.0)
        dz = sigmoid(z) * factor[t] / n
        g, gb = np.bincount(s.code, dz[s.sentence], k), dz.sum()
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        mb1, mb2 = 0.9 * mb1 + 0.1 * gb, 0.99 * mb2 + 0.01 * gb * gb
        size = rate / (np.sqrt(m2 / (1 - 0.99**it)) + 1e-8)
        w = w - size * m1 / (1 - 0.9**it)
        w = np.sign(w) * np.maximum(np.abs(w) - size * l1, 0)
        b -= rate * (mb1 / (1 - 0.9**it)) / (np.sqrt(mb2 / (1 - 0.99**it)) + 1e-8)
    return w, float(b)


def fit(sample: DataFrame, *, pulls: tuple[float, ...] = PULLS, least: int = LEAST_DOCS) -> Model:
    """sample: (h, y, t), a bounded table."""
    none = Model(np.empty(0, np.uint64), np.empty(0), -35.0)
    if sample.select("y").distinct().count() < 2:
        return none
    pull = pulls[0]
    part, rest = sample.where(_learns(F.col("h"))), sample.where(~_learns(F.col("h")))
    if len(pulls) > 1 and part.select("y").distinct().count() == 2 and rest.limit(1).count():
        words = _screen(part, least)
        learn, judge = _sample(part, words), _sample(rest, words)
        pull = min(pulls, key=lambda p: loss(judge, *optimise(learn, len(words), pull=p)))
    words = _screen(sample, least)
    w, bias = optimise(_sample(sample, words), len(words), pull=pull)
    used = w != 0
    return Model(words[used], w[used], bias)


def _located(m: Model, b: Bags, raw: list[bytes], score: np.ndarray, threshold: float) -> list[list[dict]]:
    """Code point spans and scores of the sentences that offend, of each text."""
    p = m.sentences(b)
    chosen = p >= threshold
    first = np.searchsorted(b.text, np.arange(len(raw) + 1))
    for i in np.flatnonzero(score >= threshold).tolist():
        at = slice(first[i], first[i + 1])
        if not chosen[at].any():
            chosen[first[i] + int(p[at].argmax())] = True
    out: list[list[dict]] = [[] for _ in raw]
    for k in np.flatnonzero(chosen).tolist():
        text, i, j = raw[b.text[k]], int(b.start[k]), int(b.stop[k])
        begin = len(text[:i].decode("utf-8", "replace"))
        out[b.text[k]].append({"start": begin, "stop": begin + len(text[i:j].decode("utf-8", "replace")), "score": float(p[k])})
    return out


def score_table(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", *, folds: int = 4, held: int = 2, threshold: float = 0.3, limit: int = SAMPLE, sentences: bool = True, columns: list[str] | None = None) -> DataFrame:
    """key, held_out, score, predicted[, offending: start, stop (code points) and score of each offending sentence] and ``columns``."""
    model = fit(labelled_rows(docs, labels, key, text, label, folds=folds, held=held, limit=limit))
    kept = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's words
    names = [f"c{i}" for i in range(len(columns or []))]
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("t"), *(F.col(c).alias(n) for c, n in zip(columns or [], names)))

    spans = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = kept.value
        for batch in batches:
            for part, raw in slices(batch, 1):
                b = bags(raw)
                score = m.texts(b, len(raw))
                cols, head = [part.column(0), pa.array(score)], ["id", "score"]
                if sentences:
                    cols.append(pa.array(_located(m, b, raw, score, threshold), spans))
                    head.append("offending")
                yield pa.RecordBatch.from_arrays([*cols, *part.columns[2:]], [*head, *names])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = rows.mapInArrow(run, f"id {kinds['id']}, score double" + ", offending array<struct<start: int, stop: int, score: double>>" * sentences + "".join(f", {n} {kinds[n]}" for n in names))
    return out.select(F.col("id").alias(key), F.coalesce(fold(F.col("id"), folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *(["offending"] if sentences else []), *(F.col(n).alias(c) for c, n in zip(columns or [], names)))
