import random
import re
import zlib

import numpy as np
import pytest
from brindle.llm import _learn as learn
from brindle.llm import quality, toxicity

DOCS = "doc_id long, text string, score double, predicted int, k string, t string, held_out string"
LABELS = "doc_id long, quality int, toxic int, k int"


def make(spark, n=1200):
    rng = random.Random(2)
    vocab = [f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.choice('klmn')}{rng.choice('aeiou')}" for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        toxic, good = rng.random() < 0.2, rng.random() < 0.7
        sentences = [" ".join(rng.choice(vocab) for _ in range(8)) for _ in range(rng.randrange(3, 12))]
        if toxic:
            sentences[rng.randrange(len(sentences))] += " you " + rng.choice(["zidiot", "Zmoron,"]) + " there"
        text = ". ".join(sentences) + "."
        if not good:
            text = text.upper().replace(" ", "!! ") if rng.random() < 0.5 else text.replace(" ", "$$ ")
        rows.append((i, text, 0.0, 1, "x", "y", "z"))
        labels.append((i, int(good), int(toxic), 3))
    rows += [(5000 + i, t, 0.0, 1, "x", "y", "z") for i, t in enumerate([None, "", " \n", "!!!", "a" * 200_000, "ü " * 5000])] + [(None, "null id", 0.0, 1, "x", "y", "z"), rows[0], rows[0]]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (None, 1, 1, 3), (1, None, None, 3), (7, 5, 5, 3)], LABELS), {i: (q, t) for i, q, t, _ in labels}


def check(got, truth, which, rows):
    assert len(got) == rows
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    right = [r.predicted == truth[r.doc_id][which] for r in held if r.doc_id in truth]
    assert sum(right) / len(right) >= 0.95


def test_quality(spark):
    docs, labels, truth = make(spark)
    df = quality.score_table(docs, labels)
    got = df.collect()
    check(got, truth, 0, docs.count())
    assert all(r.predicted == int(r.score >= 0.7) for r in got)
    x = np.array([quality.statistics((f"text number {i} of words." if i % 2 else f"TEXT!! {i} $$ ##").encode()) for i in range(200)])
    rules = quality.fit(x, np.arange(200) % 2.0)
    x = [quality.statistics(t) for t in (b"some words here.", b"XX!! $$", b"")]
    table = spark.createDataFrame([tuple(r) for r in x], ", ".join(f"{s} double" for s in quality.STATISTICS))
    assert np.allclose([r.s for r in table.select(rules.column().alias("s")).collect()], rules.score(np.array(x)))
    assert len(rules.rules) >= 1


def test_toxicity(spark):
    docs, labels, truth = make(spark)
    got = toxicity.score_table(docs, labels).collect()
    check(got, truth, 1, docs.count())
    assert all(r.predicted == int(r.score >= 0.3) for r in got)
    text = {r.doc_id: r.text for r in docs.collect()}
    told = [[text[r.doc_id][s.start : s.stop].lower() for s in r.offending] for r in got if r.doc_id in truth and truth[r.doc_id] == (1, 1) and r.predicted]
    found = [any("zidiot" in s or "zmoron" in s for s in x) for x in told]
    assert len(found) > 50 and sum(found) / len(found) >= 0.98
    assert all(bool(r.offending) == bool(r.predicted) for r in got)
    assert all(r.score == 0 and r.offending == [] for r in got if r.doc_id in (5000, 5001, 5002))


def test_noisy_or_by_brute_force():
    """Scores and spans of texts against a plain reading of the definition."""
    names = ["bad", "worse", "fine", "ünd"]
    hashes = [int(toxicity.bags([n.encode()]).hash[0]) for n in names]
    stems = [int(toxicity.bags([n.encode()]).hash[1]) for n in ("worse",)]
    weights = dict(zip(names, (2.0, 3.0, -1.5, 0.5)))
    order = np.argsort(np.array([*hashes, *stems], np.uint64))
    model = toxicity.Model(np.array([*hashes, *stems], np.uint64)[order], np.array([*weights.values(), 0.25])[order], -2.0)
    rng = random.Random(3)
    texts = ["".join(rng.choice([*names, "other", "Bad", "worst"]) + rng.choice([" ", ", ", ". ", "! ", "\n", "?!"]) for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    raw = [t.encode() for t in texts]
    b = toxicity.bags(raw)
    score = model.texts(b, len(raw))
    spans = toxicity._located(model, b, raw, score, 0.3)
    for t, got, where in zip(texts, score, spans):
        rest, scored = 1.0, []
        for m in re.finditer(r"[^.!?\n\r]+", t):
            words = re.findall(r"[^\x00-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in m.group()))
            if words:
                z = -2.0 + sum(weights.get(w, 0.0) + (0.25 if w[:5] == "worse"[:5] else 0.0) for w in words)
                p = 1 / (1 + np.exp(-z))
                rest *= 1 - p
                inner = re.search(r"[a-zA-Z\x80-\uffff].*[a-zA-Z\x80-\uffff]", m.group())
                scored.append((m.start() + inner.start(), m.start() + inner.end(), p))
        assert got == pytest.approx(1 - rest, abs=1e-9)
        want = [s for s in scored if s[2] >= 0.3] or ([max(scored, key=lambda s: s[2])] if got >= 0.3 else [])
        assert [(s["start"], s["stop"], round(s["score"], 9)) for s in where] == [(i, j, round(p, 9)) for i, j, p in want]


def test_training_reaches_an_optimum():
    """No step of one weight or the bias lowers the lasso objective, and the gradient is the objective's."""
    rng = np.random.default_rng(4)
    n, k = 400, 6
    text = np.repeat(np.arange(n), 4)
    sentence, code = np.nonzero(rng.random((4 * n, k)) < 0.2)
    z = -3 + 4.0 * np.bincount(sentence[code == 0], minlength=4 * n)
    y = np.zeros(n)
    np.maximum.at(y, text, (rng.random(4 * n) < 1 / (1 + np.exp(-z))).astype(float))
    s = toxicity.Sample(y, text, sentence, code)
    w, b = toxicity.optimise(s, k, pull=1.0, steps=600, rate=0.02)
    objective = lambda w, b: toxicity.loss(s, w, b) + np.abs(w).sum() / n
    here = objective(w, b)
    for j in range(k):
        for step in (-0.1, 0.1):
            assert objective(w + step * (np.arange(k) == j), b) > here - 1e-5
    assert objective(w, b - 0.1) > here - 1e-5 and objective(w, b + 0.1) > here - 1e-5
    assert w[0] > 2 and np.abs(w[1:]).max() < 1


def test_labels_that_tie_or_repeat(spark):
    """Differing labels of one id count as 1, repeated rows are learned from once, the held-out fold never."""
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(40)] + [(1, "t1"), (1, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(2, 1), (2, 1)], "doc_id long, y int")
    got = learn.labelled_rows(docs, labels, "doc_id", "text", "y", folds=4, held=2, limit=100).collect()
    assert sorted((r.t, r.y) for r in got) == sorted([(f"t{i}", 1 if i == 2 else i % 2) for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2] + [("other", 1)] * (zlib.crc32(b"1") % 4 != 2))
    assert learn.labelled_rows(docs, labels, "doc_id", "text", "y", folds=4, held=2, limit=7).count() <= 7


def test_without_labels_or_rows(spark):
    docs, labels, _ = make(spark, 20)
    none = labels.limit(0)
    assert {r.score for r in quality.score_table(docs, none).collect()} == {0.5}
    assert all(r.score < 1e-9 for r in toxicity.score_table(docs, none).collect())
    assert quality.score_table(docs.limit(0), labels).count() == toxicity.score_table(docs.limit(0), labels).count() == 0
