import base64
import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import tiktoken
from brindle.llm import bpe, packing
from tokenizers import Tokenizer

BPE, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, source string, k string, n long, rid int, t string"
HARD = [None, "", " ", "a", "it's  we'll\n\n\tthey'RE 12 345!!", "x" * 3000, " " * 700 + "b", "é" * 999 + " \x85 ñ\x1c\x1d z", "<|endoftext|> a<|startoftext|>b", "ab" * 40 + "'" + "ll" * 30, "日本語 \U0001f600 テスト" * 50]


def enc():
    with open(BPE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, 2, "y") for i, t, s in rows], SCHEMA)


def texts():
    rng = random.Random(1)
    out = list(HARD)
    for _ in range(40):
        out.append("".join(rng.choice(["ab", " ", "  ", "\n", "'s", "'", "l", "12", "é", "!", "?!", "\t "]) for _ in range(rng.randint(1, 400))))
    return out


def test_every_code_point_splits_as_the_library_does():
    codec, e = bpe.load(BPE, P.PATTERN), enc()
    words = packing.load(WORDS)
    tok = Tokenizer.from_file(WORDS)
    for lo in [*range(0, 0xD800, 512), *range(0xE000, 0x20000, 512)]:
        text = "".join(f"a{c} {c}1{c}" for c in map(chr, range(lo, min(lo + 512, 0xD800) if lo < 0xD800 else lo + 512)))
        assert list(codec.encode(text)) == e.encode_ordinary(text)
        assert words.encode_many([text])[0] == struct.pack(f"<{len(i := tok.encode(text, add_special_tokens=False).ids)}H", *i)


def test_encode_table(spark):
    e = enc()
    rows = [(i, t, "s") for i, t in enumerate(texts())] + [(3, "a", "s"), (3, "a", "s"), (None, "null id " * 30, "s")]
    got = bpe.encode_table(docs(spark, rows), "doc_id", "text", BPE, P.PATTERN, chunk=64, overlap=16).collect()
    want = []
    for i, t, _ in rows:
        ids = e.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:4]) for r in got)
    assert bpe.encode_table(docs(spark, rows).limit(0), "doc_id", "text", BPE, P.PATTERN).count() == 0


def test_pack(spark):
    tok = Tokenizer.from_file(WORDS)
    rows = [(i, t, None if i % 7 == 0 else "hot" if i % 3 else f"s{i % 4}") for i, t in enumerate(texts())] + [(3, "a", "hot"), (None, "null id " * 9, "hot")]
    got = packing.pack(docs(spark, rows), "doc_id", "text", "source", WORDS, window=64, block_tokens=500).collect()
    want = sorted(str((i, [*tok.encode(t or "", add_special_tokens=False).ids, 2])) for i, t, _ in rows)
    by, seqs = {}, {}
    for r in got:
        assert 0 < r.length <= 64
        ids = struct.unpack(f"<{r.length}H", r.ids)
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids))
    back = []
    for (i, n), parts in by.items():
        parts.sort()
        if sum(len(p) for _, p in parts) != n:  # rows that repeat
            continue
        assert [s for s, _ in parts] == [sum(len(p) for _, p in parts[:k]) for k in range(len(parts))]
        back.append(str((i, [x for _, p in parts for x in p])))
    assert set(back) <= set(want) and len(back) >= len(want) - 2
    for k, parts in seqs.items():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at == 64 or k == max(seqs)
    assert sorted(seqs) == list(range(len(seqs)))
    assert packing.pack(docs(spark, rows).limit(0), "doc_id", "text", "source", WORDS).count() == 0


def test_mixture_is_even(spark):
    """Documents many windows long and short ones: every window but the last keeps the target, and deficits are carried."""
    rows = [(i, "word " * 1999, "a") for i in range(10)] + [(100 + i, "word " * 18, "b") for i in range(190)] + [(900 + i, "word " * 9, "rare") for i in range(20)]
    got = packing.pack(docs(spark, rows), "doc_id", "text", "source", WORDS, window=200, least=20, block_tokens=1000).collect()
    total = sum(r.length for r in got)
    for name, ids in (("a", range(10)), ("b", range(100, 290)), ("rare", range(900, 920))):
        want = 200 * sum(r.length for r in got if r.doc_id in ids) / total
        share = [sum(r.length for r in got if r.doc_id in ids and r.sequence_id == k) for k in range(total // 200)]
        turn = want if want >= 20 else 20
        assert all(abs(sum(share[: k + 1]) - (k + 1) * want) <= turn + 22 for k in range(len(share)))
        if name != "rare":
            assert all(abs(x - want) <= 24 for x in share[:-1])


def test_mixture_of_given_shares(spark):
    """The queue that ends early leaves its slots to the other."""
    rows = [(i, "word " * 499, "a" if i % 2 else "b") for i in range(20)]
    got = packing.pack(docs(spark, rows), "doc_id", "text", "source", WORDS, window=100, shares={"a": 3.0, "b": 1.0}, least=20, block_tokens=1000).collect()
    share = {k: sum(r.length for r in got if r.sequence_id == k and r.doc_id % 2) for k in range(100)}
    assert all(abs(share[k] - 75) <= 2 for k in range(65)) and all(share[k] == 0 for k in range(68, 100))
    assert sum(r.length for r in got) == 10_000 and {sum(r.length for r in got if r.sequence_id == k) for k in range(100)} == {100}


def test_cut_pieces():
    """Against a plain walk over the tokens."""
    rng = np.random.default_rng(5)
    n = rng.integers(1, 40, 200)
    pos = np.cumsum(n) - n
    a = rng.integers(0, 9, 200)
    of, start, length, seq, offset = packing._cut(pos, a, n, 16)
    cover = [(int(o), int(s + k), int(q), int(f + k)) for o, s, m, q, f in zip(of, start, length, seq, offset) for k in range(m)]
    assert cover == [(d, int(a[d]) + k, int(pos[d] + k) // 16, int(pos[d] + k) % 16) for d in range(200) for k in range(n[d])]


def test_stitching_reads_a_bounded_part():
    """A run without a boundary is read a bounded number of times, and the boundaries are the whole text's."""
    codec = bpe.load(BPE, P.PATTERN)
    for text in ("x" * 40_000, "some words " * 300 + "y" * 20_000 + " and more" * 500 + " " * 9000 + "end", "ab " * 5000):
        read = []

        def boundaries(t):
            read.append(len(t))
            return codec.boundaries(t)

        spans = [(a, b, [a + x for x in codec.boundaries(text[a:b])]) for a, b in bpe.chunk_spans(len(text), 256, 64)]
        assert bpe.stitch(text, spans, boundaries) == codec.boundaries(text)
        assert sum(read) <= 5 * len(text)


def test_long_texts_at_the_default_chunk(spark):
    e = enc()
    rows = [(1, "words and more " * 5000, "s"), (2, "z" * 150_000, "s"), (2, "é1 " * 20_000, "s")]
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.encode_table(docs(spark, rows), "doc_id", "text", BPE, P.PATTERN).collect())
    ids = [(i, e.encode_ordinary(t)) for i, t, _ in rows]
    assert got == sorted((i, len(x), hashlib.sha256(struct.pack(f"<{len(x)}I", *x)).hexdigest()) for i, x in ids)


def test_pack_very_long_text(spark):
    """A text of many windows beside short ones, at the default window; clashing names and repeated rows."""
    tok = Tokenizer.from_file(WORDS)
    rows = [(1, "some longer words 123 " * 20_000, "a"), (2, "b", "b"), (2, "b", "b"), (3, None, None)]
    df = docs(spark, rows).withColumnRenamed("k", "sequence_id").withColumnRenamed("rid", "row")
    got = packing.pack(df, "doc_id", "text", "source", WORDS).collect()
    long = sorted((r.start, struct.unpack(f"<{r.length}H", r.ids)) for r in got if r.doc_id == 1)
    assert [x for _, p in long for x in p] == [*tok.encode(rows[0][1], add_special_tokens=False).ids, 2]
    assert sum(r.length for r in got if r.doc_id == 2) == 2 * (len(tok.encode("b", add_special_tokens=False).ids) + 1)
    total = sum(r.length for r in got)
    assert [sum(r.length for r in got if r.sequence_id == k) for k in range(-(-total // 4096))] == [4096] * (total // 4096) + [total % 4096] * (total % 4096 > 0)
