"""Exact ranks and what rests on them, beside brute force."""

import math
from itertools import combinations

import numpy as np
import pytest
from brindle.operators import compare, discretize, distributions, encode, ranks, similarity
from brindle.sources import text
from pyspark.sql import functions as F


def brute_quantile(x, s):
    x = sorted(x)
    p = s * (len(x) - 1)
    lo, hi = x[math.floor(p)], x[math.ceil(p)]
    return lo if lo == hi else (math.ceil(p) - p) * lo + (p - math.floor(p)) * hi


@pytest.mark.parametrize("fetch", [50, 20_000])
def test_quantiles(spark, monkeypatch, fetch):
    """Ranges are narrowed until few values are left; a value that holds most rows ends the search."""
    monkeypatch.setattr(ranks, "FETCH", fetch)
    rng = np.random.default_rng(1)
    n = 3000
    x, y, z = rng.normal(size=n), rng.integers(0, 9, n).astype(float), np.where(rng.random(n) < 0.6, 3.0, rng.lognormal(size=n))
    df = spark.createDataFrame([(float(a), float(b), None if i % 7 == 0 else float(c), None) for i, (a, b, c) in enumerate(zip(x, y, z))], "x double, y double, z double, w double")
    shares = [0, 0.013, 0.25, 0.5, 0.75, 0.999, 1]
    got = ranks.quantiles(df, {c: F.col(c) for c in "xyzw"}, shares)
    assert got["w"] is None
    for c, v in (("x", x), ("y", y), ("z", z[[i for i in range(n) if i % 7]])):
        assert got[c] == pytest.approx([brute_quantile(v, s) for s in shares], rel=1e-15)
    assert ranks.distinct_counts(df, list("xyzw")) == {"x": n, "y": 9, "z": len(set(z[[i for i in range(n) if i % 7]])), "w": 0}


def test_running_total(spark, monkeypatch):
    monkeypatch.setattr(ranks, "RANGE_ROWS", 100)
    values = [f"v{i % 997:03}{'é' * (i % 3)}" for i in range(1500)]
    df = spark.createDataFrame([(v,) for v in sorted(set(values))], "v string").repartition(5)
    got = {r.v: r.upto for r in ranks.running_total(df, "v", F.lit(1), "upto").collect()}
    assert got == {v: i for i, v in enumerate(sorted(set(values)), 1)}
    few = spark.createDataFrame([(float(v),) for v in (3, 1, 1, 2, 2, 2)], "x double")
    assert [(r.value, round(r.share, 6)) for r in distributions.ecdf(few, "x").orderBy("value").collect()] == [(1.0, 0.333333), (2.0, 0.833333), (3.0, 1.0)]


def test_natural_breaks_by_brute_force(spark):
    """The classes of least squared deviation among all ways to cut the values."""
    rng = np.random.default_rng(2)
    values = sorted(set(np.round(rng.lognormal(size=14) * 10, 1)))
    weights = rng.integers(1, 5, len(values))
    rows = [(float(v),) for v, w in zip(values, weights) for _ in range(w)]

    def cost(part):
        x = np.repeat([v for v, _ in part], [w for _, w in part])
        return ((x - x.mean()) ** 2).sum()

    pairs = list(zip(values, weights))
    best = min(combinations(range(1, len(values)), 3), key=lambda cut: sum(cost(pairs[a:b]) for a, b in zip((0, *cut), (*cut, len(values)))))
    got = discretize.Discretizer("jenks", 4, min_bin_size=1).fit(spark.createDataFrame(rows, "v double"), "v")
    assert got.edges == pytest.approx([(values[i - 1] + values[i]) / 2 for i in best])


@pytest.mark.parametrize("limit", [1_000_000, 100])
def test_natural_breaks_of_many_values(spark, monkeypatch, limit):
    """Exact on all values, not on quantiles of them, also where cells are cut again and again."""
    monkeypatch.setattr(discretize, "JENKS_VALUES", limit)
    monkeypatch.setattr(discretize, "JENKS_CELLS", 64, raising=False)
    rng = np.random.default_rng(4)
    for x in (rng.lognormal(size=2500) * 10, np.concatenate((rng.normal(size=2000), [1e6, 2e6, math.inf]))):
        v, w = np.unique(x[np.isfinite(x)], return_counts=True)
        sums = [np.concatenate(([0.0], np.cumsum(w * (v - v.mean()) ** p))) for p in (0, 1, 2)]
        cost = lambda i, j: sums[2][j] - sums[2][i] - (sums[1][j] - sums[1][i]) ** 2 / (sums[0][j] - sums[0][i])  # noqa: B023, E731
        i, j = np.triu_indices(len(v), 1)
        ok = i > 0
        i, j = i[ok], j[ok]
        at = int((cost(0, i) + cost(i, j) + cost(j, len(v))).argmin())
        want = [(v[c - 1] + v[c]) / 2 for c in (i[at], j[at])]
        got = discretize.Discretizer("jenks", 3, min_bin_size=1).fit(spark.createDataFrame([(float(a),) for a in x], "v double"), "v")
        assert got.edges == pytest.approx(want, rel=1e-12)


def test_two_peaks_are_enough(spark):
    df = spark.createDataFrame([(float(v),) for v, n in enumerate((5, 20, 18, 19, 5, 4)) for _ in range(n)], "v double")
    assert discretize.Discretizer().fit(df, "v").chosen == "jenks"


def test_embedding_clusters(spark):
    rows = [(i, [10.0 + i % 3, 0.1 * (i % 2), 0.0] if i % 2 else [0.1, 9.0 + i % 5, 0.2]) for i in range(40)]
    got = {r.k: r.cluster for r in similarity.embedding_clusters(spark.createDataFrame(rows, "k int, v array<double>"), "k", "v", 2).collect()}
    assert len({got[i] for i in range(0, 40, 2)}) == len({got[i] for i in range(1, 40, 2)}) == 1 and got[0] != got[1]


def test_fits_recover_their_distribution(spark):
    rng = np.random.default_rng(3)
    for name, x in (("normal", rng.normal(5, 2, 4000)), ("exponential", rng.exponential(3, 4000)), ("uniform", rng.uniform(1, 9, 4000))):
        fits = distributions.fit_distributions(spark.createDataFrame([(float(v),) for v in x], "v double"), "v").collect()
        assert name in {f.distribution for f in fits[:3]} and fits[0].sse <= fits[-1].sse
        own = next(f for f in fits if f.distribution == name)
        assert own.ks < 0.03 and own.sse <= 3 * fits[0].sse + 1e-4


def test_factors_of_texts(spark):
    """Words of two subjects fall into two factors; documents need no ids."""
    a, b = ["alpha beta gamma", "gamma alpha", "beta alpha gamma gamma"], ["delta epsilon zeta", "zeta delta", "epsilon zeta zeta delta"]
    df = spark.createDataFrame([(t,) for t in (a + b) * 5 + [None, ""]], "t string")
    got = [set(ws) for ws in encode.topics_nmf(df, "t", topics=2, top=3)]
    assert sorted(map(sorted, got)) == [["alpha", "beta", "gamma"], ["delta", "epsilon", "zeta"]]


def test_names_and_subjects(spark):
    texts = ["We met Dr. Ada Byron in London.", "They saw Ada Byron at Acme Corp today.", "It was bought by Acme Corp in London for IBM.", "Python and sql, with IBM."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {(r.type, r.entity, r["count"]) for r in encode.entities(df, "t").collect()} == {("PERSON", "ada byron", 2), ("ORG", "acme corp", 2), ("GPE", "london", 2), ("ORG", "ibm", 2)}
    assert {(r.domain, r.term, r.rows) for r in encode.domain_terms(df, "t").collect()} == {("tech", "python", 1), ("tech", "sql", 1)}
    assert any(c.startswith("has_entity_") for c in encode.encode(df, "t", algorithm="advanced", analysis="entity_focused").columns)


def test_comparison_statistics(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, "y"), (3, 3.0, None)], "id int, v double, s string")
    b = spark.createDataFrame([(1, 1.5, "z"), (2, 2.0, "y"), (4, 3.0, None)], "id int, v double, s string")
    c = compare.compare([a, b], ["a", "b"], ["id"])
    assert {(r.dataset, r.rows, round(r.percentage, 2)) for r in c.coverage().collect()} == {("a", 3, 75.0), ("b", 3, 75.0)}
    assert tuple(c.difference_statistics().first()) == (2, 2, 1)


def test_header_rules():
    assert text.has_header([["a"]]) and text.has_header([["when", "x"], ["3", "y"]]) and text.has_header([["7", "status"], ["8", "9"]])
    assert not text.has_header([["7", "x"], ["8", "y"]]) and text.has_header([["p", "q"], ["r", "s"]])
