import hashlib
import random

from brindle.llm import substring

SCHEMA = "doc_id long, text string, th long, id long, a int, mm string, spans string"


def brute(rows, width):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        if i is not None:
            for s in range(len(w) - width + 1):
                k = tuple(w[s : s + width])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in split:
        gone = set()
        if i is not None:
            for s in range(len(w) - width + 1):
                if first[tuple(w[s : s + width])] < i:
                    gone.update(range(s, s + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_for(seed, width):
    rng = random.Random(seed)
    word = lambda n: [f"w{rng.randrange(n)}" for _ in range(rng.randrange(5, 90))]
    shared = [[f"s{rng.randrange(400)}" for _ in range(rng.randrange(width - 4, 3 * width))] for _ in range(4)]
    rows = []
    for i in range(120):
        parts = [word(1000)]
        for _ in range(rng.randrange(3)):
            p = list(rng.choice(shared))
            a = rng.randrange(len(p))
            if rng.random() < 0.3:
                p[a] = "edit"
            if rng.random() < 0.4:
                p = p[a // 3 :]
            parts += [p, word(3 if rng.random() < 0.2 else 1000)]
        rows.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(x for p in parts for x in p)))
    rows += [(200 + i, rows[3][1]) for i in range(30)]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "a " * 400), (304, "a " * 100 + "b " + "a " * 90), (305, "a b " * 100), (306, "b a " * 99), (None, rows[0][1]), (5, "x y z"), (5, rows[7][1]), (0, rows[0][1]), (307, "Ünï cödé \x1c x" * 40), (308, "Ünï cödé \x1c x" * 40)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, "x", "y") for i, t in rows], SCHEMA)


def test_matches_brute_force(spark):
    for seed, width, k in ((1, 12, 4), (2, 20, 8), (3, 50, 16)):
        rows = rows_for(seed, width)
        got = substring.dedup(frame(spark, rows), width=width, seed=k).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, width)


def test_keeps_columns_and_untouched_texts(spark):
    rows = [(1, "a  b\nc"), (2, None)]
    got = {r.doc_id: r for r in substring.dedup(frame(spark, rows), columns=["text", "mm"]).collect()}
    assert got[1].kept_text == "a  b\nc" and got[1].mm == "x" and got[2].kept_text is None and got[2].text is None
    assert substring.dedup(frame(spark, rows).limit(0)).count() == 0


def test_long_text(spark):
    rng = random.Random(4)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(300_000)) + " " + "q" * 1_500_000
    got = substring.dedup(frame(spark, [(1, long), (2, "lead " + long)]), keep_text=False).collect()
    assert {r.doc_id: (r.n_words, r.n_removed) for r in got} == {1: (300_001, 0), 2: (300_002, 300_001)}
