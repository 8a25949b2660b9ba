import math
from fractions import Fraction

import numpy as np
from brindle.llm import ann, topk
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, id long, list int, v string"
BAD = [None, [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [1.0, 2.0], []]


def table(spark, n, bad=True):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, 16))).astype(np.float32)
    x[n // 3 : n // 2] = x[0]  # one vector holds many rows
    rows = [(int(i), v.tolist(), 0, 1, 2, "x") for i, v in enumerate(x)]
    rows += [(100 * n + 100 * i, v, 0, 1, 2, "x") for i, v in enumerate(BAD)] if bad else []
    rows += [(None, x[1].tolist(), 0, 1, 2, "x")]
    return spark.createDataFrame(rows, SCHEMA), x.astype(float)


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score, r.rank))
    return out


def test_ann(spark):
    df, x = table(spark, 3000)
    got = by_query(ann.search(df, F.col("id") % 100 == 0))
    hits = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(3000), d)) if i != q][:10]
        assert [r for _, _, r in got[q]] == list(range(1, 11))
        assert all(abs(s - d[v]) < 1e-12 for v, s, _ in got[q])
        assert [(s, v) for v, s, _ in got[q]] == sorted((s, v) for v, s, _ in got[q])
        hits += len(set(order) & {v for v, _, _ in got[q]})
    assert hits >= 0.9 * 300 and len(got) == 30
    assert [v for v, _, _ in got[0]] == list(range(1000, 1010))  # equal vectors, by id


def test_ann_few_rows(spark):
    df, _ = table(spark, 4, bad=False)
    assert {k: len(v) for k, v in by_query(ann.search(df, F.col("id") % 100 == 0)).items()} == {0: 3}
    assert ann.search(df.limit(0), F.col("id") % 100 == 0).count() == 0


def test_exact_topk(spark):
    df, x = table(spark, 9000)
    got = by_query(topk.search(df, F.col("id") % 100 == 0))
    w = np.floor(1024 * x).astype(np.int64)
    zero = 900000 + 100  # the zero vector takes part here
    assert set(got) == {*range(0, 9000, 100), zero}
    for q in range(0, 9000, 100):
        s = np.append(w @ w[q], 0)
        ids = np.append(np.arange(9000), zero)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:10]
        assert [(v, t) for v, t, _ in got[q]] == [(int(ids[i]), int(s[i])) for i in order]
    assert topk.search(df.limit(0), F.col("id") % 100 == 0).count() == 0


def rows_of(spark, pairs):
    return spark.createDataFrame([(i, v, 0, 1, 2, "x") for i, v in pairs], SCHEMA.replace("array<float>", "array<double>"))


def brute(pairs, score, order, k=10):
    """Sorted (query_id, rank, vec_id, score): every row is a query of its own, against rows of another id and the same length."""
    out = []
    for qi, q in pairs:
        if qi % 100 == 0:
            found = sorted(((score(q, v), i) for i, v in pairs if i != qi and len(v) == len(q)), key=lambda s: (order * s[0], s[1]))
            out += [(qi, r, i, s) for r, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def test_repeated_ids_and_lengths(spark):
    """Repeated query rows each get k results; repeated candidates are candidates each; lengths don't mix."""
    rng = np.random.default_rng(6)
    pairs = [(int(i), rng.normal(size=4).tolist()) for i in [*range(95, 130), 100, 100, 101, 101, 200, 200]]
    pairs += [(int(i), rng.normal(size=3).tolist()) for i in [300, 300, *range(301, 309)]]
    df = rows_of(spark, pairs)
    # Few enough rows for one list: nothing is approximate.
    small = [*pairs[:12], *pairs[-16:]]
    df, want = rows_of(spark, small), brute(small, lambda q, v: float(np.sqrt(((np.array(q) - np.array(v)) ** 2).sum())), 1)
    got = sorted(tuple(r) for r in ann.search(df, F.col("id") % 100 == 0).collect())
    assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want], atol=1e-12)
    whole = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in pairs]
    want = brute(whole, lambda q, v: sum(a * b for a, b in zip(q, v)), -1)
    assert sorted(tuple(r) for r in topk.search(rows_of(spark, pairs), F.col("id") % 100 == 0).collect()) == want


def test_topk_of_very_large_components(spark):
    """Beyond 64 bits the ranks are exact and the score is null; norms on either side of 2^62 meet."""
    rng = np.random.default_rng(7)
    huge = [(500, [-1e308] * 5), (501, [1e308] * 5), (502, [1e308, 1e308, 1e308, 1e308, 1.1e308])]
    for scales, more in ([2.0**20, 1.0, 300_000.0, 2.0**21], []), ([1.0, 2.0**21, 1e12, 1e100, 1e306], huge):
        pairs = [(int(i), (scales[i % len(scales)] * rng.normal(size=5)).tolist()) for i in range(90, 420)] + more
        want = brute([(i, [math.floor(Fraction(x) * 1024) for x in v]) for i, v in pairs], lambda q, v: sum(a * b for a, b in zip(q, v)), -1)
        want = [(q, r, i, s if -(1 << 63) <= s < 1 << 63 else None) for q, r, i, s in want]
        assert sorted(map(tuple, topk.search(rows_of(spark, pairs), F.col("id") % 100 == 0).collect())) == want
        assert any(s is None for *_, s in want) if more else any(s is not None and s > 1 << 56 for *_, s in want)


def test_topk_sends_no_copies_of_queries(spark, monkeypatch):
    """Many blocks of queries meet many blocks of rows, through files: no row of the plan holds a block for each other block."""
    for name, n in (("BLOCK", 64), ("LARGE", 128), ("SPREAD", 4), ("QUERIES", 8), ("PAGE", 16), ("SCORED", 8), ("PILOT", 40)):
        monkeypatch.setattr(topk, name, n, raising=False)
    rng = np.random.default_rng(8)
    pairs = [(int(i), (v * rng.choice([1, 1, 2.0**16])).tolist()) for i, v in zip([*range(0, 60_000, 50)], np.round(rng.normal(size=(1200, 3)), 1))]
    found = topk.search(rows_of(spark, pairs), F.col("id") % 100 == 0, k=4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    whole = np.array([[int(np.floor(1024 * x)) for x in v] for _, v in pairs])
    ids = np.array([i for i, _ in pairs])
    want = []
    for q in range(0, len(pairs), 2):
        s = whole @ whole[q]
        want += [(int(ids[q]), r, int(ids[i]), int(s[i])) for r, i in enumerate([i for i in np.lexsort((ids, -s)) if i != q][:4], 1)]
    assert sorted(map(tuple, found.collect())) == want
