import random

from brindle.llm import _components, minhash

SCHEMA = "doc_id long, text string, row long, id long, n int, th string, comp string"


def shingles(t):
    w = (t or "").encode().translate(minhash.Words.__init__.__globals__["LOWER"]).split()
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return sorted(((i, len(s), root(i) if i is not None and s else i, i is None or (root(i) if s else i) == i) for i, s in sets), key=str)


def make(seed):
    rng = random.Random(seed)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([4, 30, 120, 300]))]
        for _ in range(rng.choice([1, 2, 9, 25])):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 30)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(99)}"
            rows.append((len(rows), " ".join(w).upper() if rng.random() < 0.2 else "\n".join(w)))
    return rows + [(1000 + i, rows[5][1]) for i in range(40)] + [(2000, None), (2001, ""), (2002, "  "), (2003, "a"), (2004, "A"), (2005, "a b"), (2006, "é a b"), (None, rows[0][1]), (7, "a totally other text here")]


def test_matches_brute_force(spark):
    for seed in (1, 2):
        rows = make(seed)
        df = spark.createDataFrame([(i, t, 1, 2, 3, "x", "y") for i, t in rows], SCHEMA)
        got = sorted((tuple(r)[:4] for r in minhash.near_dedup(df).collect()), key=str)
        assert got == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert minhash.near_dedup(df).count() == 0


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.id: r.comp for r in _components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(101)}, 500: 500, 501: 500}


def test_long_text(spark):
    long = " ".join(str(i) for i in range(200_000))
    df = spark.createDataFrame([(1, long), (2, long + " x")], "doc_id long, text string")
    assert {tuple(r)[:4] for r in minhash.near_dedup(df).collect()} == {(1, 199_998, 1, True), (2, 199_999, 1, False)}


def test_leaders_lose_no_link(spark, monkeypatch):
    """The same result with more rounds of leaders, and with no leaders at all."""
    rows = make(3)
    df = spark.createDataFrame([(i, t, 1, 2, 3, "x", "y") for i, t in rows], SCHEMA)
    for rounds in (0, 4):
        monkeypatch.setattr(minhash, "LEADER_ROUNDS", rounds)
        assert sorted((tuple(r)[:4] for r in minhash.near_dedup(df).collect()), key=str) == brute(rows)
