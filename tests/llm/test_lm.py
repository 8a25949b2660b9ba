import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from brindle.llm import lm

SCHEMA = "doc_id long, text string, id long, t string, shard int, n long"


def words(t):
    return (t or "").encode().translate(lm.Words.__init__.__globals__["LOWER"]).split() + ["end"]


def brute(rows):
    train = [words(t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    uni = Counter(w for d in train for w in d)
    N, V = sum(uni.values()), len(uni)
    bi = Counter((a, b) for d in train for a, b in zip(["begin", *d], d))
    ctx, follows, before = Counter(), defaultdict(Counter), Counter()
    for (a, b), c in bi.items():
        ctx[a] += c
        follows[a][min(c, 3)] += 1
        before[b] += 1
    nth = lambda cs: [sum(1 for c in cs if c == i) for i in range(1, 5)]
    D, L = lm._discounts(nth(bi.values())), lm._discounts(nth(before.values()))
    disc = lambda c, d: 0 if c == 0 else d[min(c, 3) - 1]
    rest = sum(disc(c, L) for c in before.values()) / len(bi)
    low = lambda w: (before[w] - disc(before[w], L)) / len(bi) + rest / (V + 1)

    def p(a, b):
        if not ctx[a]:
            return low(b)
        return (bi[a, b] - disc(bi[a, b], D)) / ctx[a] + sum(D[k - 1] * n for k, n in follows[a].items()) / ctx[a] * low(b)

    out = {}
    for i, t in rows:
        d = words(t)
        out[i, len(t or "")] = (i is not None and zlib.crc32(str(i).encode()) % 5 == 1, len(d), sum(uni[w] > 0 for w in d), N, sum(math.log10((uni[w] + 0.5) / (N + 0.5 * (V + 1))) for w in d), sum(math.log10(p(a, b)) for a, b in zip(["begin", *d], d)))
    vocabulary = list(uni)
    some = [a for a in ["begin", *vocabulary[:20]] if ctx[a]]
    assert all(abs(sum(p(a, b) for b in vocabulary) + rest / (V + 1) * sum(D[k - 1] * n for k, n in follows[a].items()) / ctx[a] - 1) < 1e-9 for a in some)
    return out


def test_matches_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"W{i}" if i % 3 else f"ü{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(vocab[: rng.choice([5, 60])]) for _ in range(rng.randrange(0, 60)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "never seen words"), (None, "W1 W2"), (503, "W1 " * 5000)]
    df = spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], SCHEMA)
    want = brute(rows)
    texts = dict(rows)
    for shards in (None, 40):
        got = lm.score_table(df, shards=shards).collect()
        assert len(got) == len(rows)
        for r in got:
            w = want[r.doc_id, len(texts[r.doc_id] or "")]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
            assert abs(r.base_score - w[4]) < 1e-6 * abs(w[4]) and abs(r.score - w[5]) < 1e-6 * abs(w[5])
    assert lm.score_table(df.limit(0)).count() == 0


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    r = lm.score_table(df).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and math.isfinite(r.score)


def test_counts_beyond_32_bits(tmp_path):
    """Stored, merged and looked up as they are."""
    counts = np.array([1, lm.FULL - 1, lm.FULL, lm.FULL + 1, 7, 1 << 50], np.int64)
    lm._save_counts(f"file://{tmp_path}", "counts-0", counts)
    for path in (str(tmp_path), f"file://{tmp_path}"):
        files = lm.Files(lm.Model(path, 1, [6]))
        assert files.counts("counts", 0, np.array([5, 0, 2, 2, 3, 1])).tolist() == counts[[5, 0, 2, 2, 3, 1]].tolist()
        assert files.by_id("counts", np.array([0, 3, 5, lm.UNKNOWN], np.uint64)).tolist() == [1, lm.FULL + 1, 1 << 50, 0]
    keys = np.array([3, 9], np.uint64)
    raw, packed = lm._pack(keys), lm._pack_counts(np.array([1 << 40, 2], np.int64))
    assert [x.tolist() for x in lm._merge([raw, raw], [packed, packed])] == [[3, 9], [1 << 41, 4]]


def test_store_without_paths(tmp_path):
    """Arrays are read, not copied to the machine."""
    lm._save(f"file://{tmp_path}", "words-0", np.arange(5, dtype="<u8"))
    files = lm.Files(lm.Model(f"file://{tmp_path}", 1, [5]))
    files.open = files._read
    assert files.ids(np.array([2, 7], np.uint64)).tolist() == [2, lm.UNKNOWN]


def test_clashing_names_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a b", 0.5, 9), (1, "a b", 0.5, 9), (1, "c", 0.5, 9), (2, "a b", 0.1, 3)], "doc_id long, text string, score double, n_tokens int")
    got = lm.score_table(df).collect()
    assert sorted(r.n_tokens for r in got) == [2, 3, 3, 3] and {r.train_tokens for r in got} == {sum(r.n_tokens for r in got if not r.held_out)}


class Stages:
    """Stands for a DataFrame and keeps the functions that workers would run."""

    def __init__(self):
        self.run = []

    def mapInArrow(self, f, schema):  # noqa: N802
        self.run.append(f)
        return self

    def groupBy(self, *_):  # noqa: N802
        return self

    applyInArrow = mapInArrow  # noqa: N815

    def collect(self):
        return []


def test_memory_of_a_worker(tmp_path):
    """Two of these and the engine share an executor; a batch of the engine's may have 10,000 texts."""
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 400_000, 3_000))) for _ in range(1_200)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])
    del texts
    m = lm.Model(f"file://{tmp_path}", 4)
    for count, tokens in ((lm._count_words, 3_600_000), (lm._count_pairs, 3_600_000 + 1_200)):
        stages, total = Stages(), 0
        count(stages, m)
        tracemalloc.start()
        for out in stages.run[0](iter([batch])):
            for row in out.to_pylist():
                if row["shard"] >= 0:
                    total += int(lm._unpack_counts(row["counts"]).sum())
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert total == tokens and peak < 160e6, (count.__name__, total, peak)


def test_merging_holds_what_is_distinct():
    """60 blocks of one shard, as many tasks send them, with nearly the same keys."""
    keys = np.arange(1, 200_001, dtype=np.uint64) * np.uint64(1 << 33)
    raw, counts = lm._pack(keys), lm._pack_counts(np.ones(len(keys), np.int64))
    assert lm._unpack(raw).tolist() == keys.tolist()
    tracemalloc.start()
    k, c = lm._merge([raw] * 60, [counts] * 60)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (k == keys).all() and (c == 60).all() and peak < 160e6, peak


def test_tallies_of_many_parts(monkeypatch):
    """Merged and sent on early, every key counts once for each time it came."""
    monkeypatch.setattr(lm, "HOLD", 50)
    rng = random.Random(8)
    words = [[rng.choice([0, 7, (1 << 64) - 1, *range(1 << 40, (1 << 40) + span)]) for _ in range(rng.randrange(1, 90))] for span in (5, 30, 400) * 12]
    parts = [np.unique(np.array(w, np.uint64), return_counts=True) for w in words]
    want = Counter(x for w in words for x in w)
    bounds = np.array([0, (1 << 40) + 3, 1 << 62], np.uint64)
    out = list(lm._emitted(iter(parts), bounds))
    assert len(out) > 1
    got = Counter()
    for batch in out:
        for r in batch.to_pylist():
            k = lm._unpack(r["keys"])
            assert (np.diff(k) > 0).all() and (np.searchsorted(bounds, k, "right") - 1 == r["shard"]).all()
            got.update(dict(zip(k.tolist(), lm._unpack_counts(r["counts"]).tolist())))
    assert got == want
    shards = [pa.RecordBatch.from_pylist([r for b in out for r in b.to_pylist() if r["shard"] == s], out[0].schema) for s in range(3)]
    merged = {}
    for s, batch in enumerate(shards):
        shard, _, k, c = lm._merge_batches(batch.slice(i, 2) for i in range(0, batch.num_rows, 2))
        assert shard == s
        merged |= dict(zip(k.tolist(), c.tolist()))
    assert merged == want


def test_groups_of_small_batches():
    """Texts of several batches are counted together, none is lost or moved."""
    texts = ["a" * n for n in (0, 3, lm.GROUP, 5, lm.GROUP // 2, lm.GROUP // 2 + 9, 1)] + [None, ""]
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t], pa.string())], ["id", "t"]) for i, t in enumerate(texts)]
    got = [([x for part in held for x in part["id"].to_pylist()], [len(r) for r in raw]) for held, raw in lm._groups(iter(batches), 1)]
    assert [i for ids, _ in got for i in ids] == list(range(len(texts))) and [n for _, sizes in got for n in sizes] == [len(t or "") for t in texts]
    assert 1 < len(got) < len(texts) and all(sum(sizes) <= lm.GROUP for _, sizes in got)
