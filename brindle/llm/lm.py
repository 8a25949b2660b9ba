"""Interpolated modified Kneser-Ney language model (bigrams), counted in Spark, searched in mapped files.

1. Words of the training texts are counted: tasks send sorted blocks of (64-bit hash, count) by
   hash range, and every range becomes a sorted hash array with counts. A word's id is its rank.
2. Bigrams are counted the same way, as sorted blocks of (id of the context, id of the word) by
   ranges of the context; each range becomes a sorted array of 64-bit keys with counts, and an
   array of how many words follow each context once, twice, and more often.
3. How many contexts precede each word (its continuation count) becomes an array by id.
4. Workers map these files and score whole texts: distinct words and bigrams of a group of texts
   are looked up together, in sorted order.

The files lie in the shared folder; each is written under another name, then renamed, so a task
that runs again leaves the same file. Blocks are delta-coded by byte planes, which
the shuffle's compression makes small, without planes of zeros. Tasks hold the distinct keys of a bounded number of words, and merge blocks as they come. Discounts come from the counts of counts
(Chen and Goodman); the lowest order is interpolated with a uniform share for V + 1 words, and
a word that follows an unseen context has its lowest-order probability.

Counts of any size are exact: those beyond 32 bits stand in a list beside their array. A null text is empty: its one token is the end. Rows with a null id are scored but not learned
from, and count as not held out; rows that repeat, or share an id, are learned from and scored each. Very long texts are read whole, each by itself. With
nothing to learn from, N and V are 0. Extra columns are ignored, also ones with names of the result; an empty table has no result.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._learn import fold
from ._scratch import fresh_path, small_batches
from ._textvec import U, Words, slices

END, BEGIN, UNKNOWN = 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFD
#: Bytes of text counted or scored together; keys that a task holds beside those of one such group before it merges them.
GROUP = 8 << 20
HOLD = 2 << 20
#: What a 32-bit count says if the true one stands elsewhere; bytes of training text a shard is meant for.
FULL = 0xFFFFFFFF
SHARD = 24 << 20
#: Files a worker has mapped at once (each holds a descriptor), and arrays it holds where files can't be mapped.
MAPPED, HELD = 240, 24
BLOCK = "shard int, keys binary, counts binary"


def _planes(values: np.ndarray) -> bytes:
    """uint64 values as their number of byte planes, and these planes, lowest first."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return bytes([width]) + values.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _values(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view("<u8").ravel()


def _pack(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys as byte planes of their differences."""
    return _planes(np.diff(keys, prepend=U(0)))


def _unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(_values(raw), dtype=np.uint64)


def _pack_counts(counts: np.ndarray) -> bytes:
    return _planes(counts.astype(np.uint64))


def _unpack_counts(raw: bytes) -> np.ndarray:
    return _values(raw).astype(np.int64)


def _blocks(keys: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    """Rows of BLOCK: the keys (sorted, distinct) cut at the first key of each shard."""
    at = np.append(np.searchsorted(keys, bounds), len(keys))
    full = [s for s in range(len(bounds)) if at[s + 1] > at[s]]
    return pa.RecordBatch.from_arrays(
        [pa.array(full, pa.int32()), pa.array([_pack(keys[at[s] : at[s + 1]]) for s in full], pa.binary()), pa.array([_pack_counts(counts[at[s] : at[s + 1]]) for s in full], pa.binary())],
        ["shard", "keys", "counts"],
    )


class _Tally:
    """Distinct keys, sorted, and their summed counts, of parts added one by one.

    Parts are merged once they have HOLD keys and no fewer than are distinct so far; what is held follows the distinct keys, not the parts.
    """

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = self.distinct = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size - self.distinct >= max(HOLD, self.distinct):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) > 1:
            # What isn't needed any more goes at once.
            k = np.concatenate(self.keys)
            self.keys.clear()
            c = np.concatenate(self.counts)
            self.counts.clear()
            order = np.argsort(k, kind="stable")
            k = k[order]
            c = c[order]
            del order
            first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            self.keys, self.counts = [k[first]], [np.add.reduceat(c, first)]
        self.size = self.distinct = len(self.keys[0]) if self.keys else 0
        return (self.keys[0], self.counts[0]) if self.keys else (np.empty(0, np.uint64), np.empty(0, np.int64))

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """What was merged; the tally is empty then."""
        out = self.merge()
        self.__init__()
        return out


def _merge(keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of some blocks, sorted, and their summed counts."""
    tally = _Tally()
    for k, c in zip(keys, counts):
        tally.add(_unpack(k), _unpack_counts(c))
    return tally.merge()


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> tuple[int, list[bytes], np.ndarray, np.ndarray]:
    """Shard of the blocks of a group, what stands in its rows without counts, distinct keys and their summed counts."""
    tally, heads, shard = _Tally(), [], 0
    for batch in batches:
        shard = batch["shard"][0].as_py()
        for k, c in zip(batch["keys"], batch["counts"]):
            if shard < 0:
                heads.append(k.as_py())
            else:
                tally.add(_unpack(k.as_py()), _unpack_counts(c.as_py()))
    return shard, heads, *tally.merge()


def _head(shard: int, values: list[int]) -> pa.RecordBatch:
    """A row of BLOCK that holds numbers, below shard 0."""
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([np.array(values, "<i8").tobytes()], pa.binary()), pa.array([b""], pa.binary())], ["shard", "keys", "counts"])


def _emitted(parts: Iterator[tuple[np.ndarray, np.ndarray]], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of the summed parts; they go when merging no longer keeps what is held below half of HOLD."""
    tally = _Tally()
    for keys, counts in parts:
        tally.add(keys, counts)
        del keys, counts
        if tally.distinct > HOLD // 2:
            yield _blocks(*tally.take(), bounds)
    if tally.size:
        yield _blocks(*tally.take(), bounds)


def _groups(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[pa.RecordBatch], list[bytes]]]:
    """Rows of batches that follow each other, whose texts have about GROUP bytes together, and those texts."""
    held, raw, size = [], [], 0
    for batch in batches:
        for part, texts in slices(batch, column, GROUP):
            more = sum(map(len, texts)) + len(texts)
            if held and size + more > GROUP:
                yield held, raw
                held, raw, size = [], [], 0
            held.append(part)
            raw += texts
            size += more
    if held:
        yield held, raw


def _save(folder: str, name: str, values: np.ndarray) -> None:
    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    aside = f"{base}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(aside) as out:
        out.write(memoryview(np.ascontiguousarray(values)).cast("B") if values.size else b"")
    system.move(aside, f"{base}/{name}")


def _save_counts(folder: str, name: str, counts: np.ndarray) -> None:
    """Counts of 32 bits, and beside them the places and values of those that need more."""
    large = np.flatnonzero(counts >= FULL)
    _save(folder, name, np.minimum(counts, FULL).astype("<u4"))
    _save(folder, f"large-{name}", np.stack([large, counts[large]]).astype("<i8"))


@dataclass
class Model:
    """What a worker needs besides the files; a few numbers for each shard."""

    folder: str
    shards: int
    sizes: list[int] = field(default_factory=list)  # words of each shard
    tokens: int = 0  # N, with ends
    texts: int = 0
    distinct: int = 0  # V, with the end
    bigrams: int = 0
    discounts: list[float] = field(default_factory=lambda: [0.5, 1.0, 1.5])
    low_discounts: list[float] = field(default_factory=lambda: [0.5, 1.0, 1.5])
    low_rest: float = 1.0
    end_contexts: int = 0

    def hash_bounds(self) -> np.ndarray:
        return np.array([(s << 64) // self.shards for s in range(self.shards)], np.uint64)

    def id_bounds(self) -> np.ndarray:
        """The first id of each shard's words."""
        return np.concatenate(([0], np.cumsum(self.sizes)[:-1])).astype(np.uint64)


class Files:
    """The arrays of a model, by name and shard, opened when first used.

    In a shared folder they are memory-mapped. From a store without paths the arrays used last are held,
    each no larger than its shard; nothing is copied to the machine.
    """

    def __init__(self, m: Model):
        self.m = m
        url = urlparse(m.folder)
        self.path = url.path if url.scheme in ("", "file") else None
        self.open = lru_cache(maxsize=MAPPED if self.path else HELD)(self._map if self.path else self._read)

    def _map(self, name: str, kind: str) -> np.ndarray:
        path = f"{self.path}/{name}"
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)

    def _read(self, name: str, kind: str) -> np.ndarray:
        system, base = fs.FileSystem.from_uri(self.m.folder)
        with system.open_input_file(f"{base}/{name}") as f:
            return np.frombuffer(f.read(), kind)

    def array(self, name: str, shard: int, kind: str) -> np.ndarray:
        return self.open(f"{name}-{shard}", kind)

    def counts(self, name: str, shard: int, at: np.ndarray) -> np.ndarray:
        """Counts at places, of any size."""
        out = self.array(name, shard, "<u4")[at].astype(np.int64)
        full = np.flatnonzero(out == FULL)
        if len(full):
            places, values = self.array(f"large-{name}", shard, "<i8").reshape(2, -1)
            out[full] = values[np.searchsorted(places, at[full])]
        return out

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted hashes, UNKNOWN for others."""
        out = np.full(len(hashes), UNKNOWN, np.uint64)
        at = np.append(np.searchsorted(hashes, self.m.hash_bounds()), len(hashes))
        for s, base in enumerate(self.m.id_bounds().tolist()):
            part = hashes[at[s] : at[s + 1]]
            words = self.array("words", s, "<u8") if len(part) else part
            if len(words):
                i = np.searchsorted(words, part)
                hit = words[np.minimum(i, len(words) - 1)] == part
                out[at[s] : at[s + 1]] = np.where(hit, i.astype(np.uint64) + U(base), U(UNKNOWN))
        return out

    def by_id(self, name: str, ids: np.ndarray) -> np.ndarray:
        """Counts of sorted ids of words; 0 for UNKNOWN and other marks."""
        out = np.zeros(len(ids), np.int64)
        bounds = self.m.id_bounds()
        at = np.searchsorted(ids, np.append(bounds, U(sum(self.m.sizes))))
        for s, base in enumerate(bounds.tolist()):
            if at[s + 1] > at[s]:
                out[at[s] : at[s + 1]] = self.counts(name, s, (ids[at[s] : at[s + 1]] - U(base)).astype(np.int64))
        return out


def _shard_of_context(m: Model) -> np.ndarray:
    """Bounds of bigram keys: contexts of a word shard together; the begin mark falls into the last."""
    return m.id_bounds() << U(32)


def _stream(first: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """begin, words, end of each text in one array, and where each text starts in it."""
    texts = len(first) - 1
    starts = first + 2 * np.arange(texts + 1)
    out = np.empty(len(ids) + 2 * texts, np.uint64)
    keep = np.ones(len(out), bool)
    keep[starts[:-1]] = keep[starts[1:] - 1] = False
    out[keep] = ids
    out[starts[:-1]], out[starts[1:] - 1] = BEGIN, END
    return out, starts


def _count_words(texts: DataFrame, m: Model) -> None:
    bounds = m.hash_bounds()

    def emit(batches):
        rows = 0

        def parts():
            nonlocal rows
            for _, raw in _groups(batches, 0):
                rows += len(raw)
                yield np.unique(Words(raw, lower=True).hash, return_counts=True)

        yield from _emitted(parts(), bounds)
        yield _head(-1, [rows])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, heads, keys, counts = _merge_batches(batches)
        total = sum(int(np.frombuffer(h, "<i8")[0]) for h in heads) if shard < 0 else int(counts.sum())
        if shard >= 0:
            _save(m.folder, f"words-{shard}", keys)
            _save_counts(m.folder, f"counts-{shard}", counts)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(keys)]), pa.array([total])], ["shard", "n", "total"])

    got = {r.shard: r for r in texts.mapInArrow(emit, BLOCK).groupBy("shard").applyInArrow(reduce, "shard int, n bigint, total bigint").collect()}
    m.sizes = [got[s].n if s in got else 0 for s in range(m.shards)]
    m.texts = got[-1].total if -1 in got else 0
    m.tokens = sum(r.total for r in got.values())
    m.distinct = sum(m.sizes) + (m.texts > 0)
    if sum(m.sizes) >= UNKNOWN:
        raise OverflowError("more distinct words than 32-bit ids")
    for s in range(m.shards):
        if s not in got:
            _save(m.folder, f"words-{s}", np.empty(0, "<u8"))
            _save_counts(m.folder, f"counts-{s}", np.empty(0, np.int64))


def _discounts(n: list[int]) -> list[float]:
    """Discounts of counts 1, 2 and 3 or more from the numbers of things counted 1 to 4 times."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    out = []
    for i, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = i - (i + 1) * y * b / a if a else 0.5 * i
        out.append(min(max(d, 0.05), i - 0.05))
    return out


def _count_pairs(texts: DataFrame, m: Model) -> None:
    def parts(batches):
        files = Files(m)
        for _, raw in _groups(batches, 0):
            w = Words(raw, lower=True)
            words, which = np.unique(w.hash, return_inverse=True)
            stream, _ = _stream(w.first, files.ids(words)[which])
            del w, words, which
            pairs = (stream[:-1] << U(32)) | stream[1:]
            pairs = pairs[stream[:-1] != U(END)]
            del stream
            yield np.unique(pairs, return_counts=True)

    def emit(batches):
        yield from _emitted(parts(batches), _shard_of_context(m))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, _, keys, counts = _merge_batches(batches)
        _save(m.folder, f"pairs-{shard}", keys)
        _save_counts(m.folder, f"paircounts-{shard}", counts)
        base, size = int(m.id_bounds()[shard]), m.sizes[shard]
        follows = np.zeros(3 * (size + 1), np.int64)
        for i in range(0, len(keys), HOLD):
            context = keys[i : i + HOLD] >> U(32)
            # The begin mark has the row behind the words of the last shard.
            row = np.where(context == U(BEGIN), U(size), context - U(base)).astype(np.int64)
            follows += np.bincount(row * 3 + np.minimum(counts[i : i + HOLD], 3) - 1, minlength=len(follows))
        _save(m.folder, f"contexts-{shard}", follows.astype("<u4"))
        nth = [int((counts == i).sum()) for i in range(1, 5)]
        yield _blocks(*np.unique(keys & U(0xFFFFFFFF), return_counts=True), m.id_bounds())
        yield _head(-1 - shard, [len(keys), *nth])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, heads, ids, counts = _merge_batches(batches)
        n = np.frombuffer(heads[0], "<i8").tolist() if shard < 0 else before(shard, ids, counts)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([n], pa.list_(pa.int64()))], ["shard", "n"])

    def before(shard: int, ids: np.ndarray, counts: np.ndarray) -> list[int]:
        dense = np.zeros(m.sizes[shard], np.int64)
        words = ids < U(UNKNOWN)
        dense[(ids[words] - m.id_bounds()[shard]).astype(np.int64)] = counts[words]
        _save_counts(m.folder, f"before-{shard}", dense)
        ends = int(counts[ids == U(END)].sum())
        every = np.append(counts[words], ends) if ends else counts[words]
        return [ends, *(int((every == i).sum()) for i in range(1, 5)), int((every >= 3).sum())]

    blocks = texts.mapInArrow(emit, BLOCK).groupBy("shard").applyInArrow(reduce, BLOCK)
    rows = blocks.groupBy("shard").applyInArrow(contexts, "shard int, n array<bigint>").collect()
    high, low = [r.n for r in rows if r.shard < 0], {r.shard: r.n for r in rows if r.shard >= 0}
    sums = [sum(c) for c in zip(*high)] or [0] * 5
    m.bigrams, m.discounts = sums[0], _discounts(sums[1:])
    ends, *nth, more = [sum(c) for c in zip(*low.values())] or [0] * 6
    m.end_contexts, m.low_discounts = ends, _discounts(nth)
    d = m.low_discounts
    m.low_rest = (d[0] * nth[0] + d[1] * nth[1] + d[2] * more) / m.bigrams if m.bigrams else 1.0
    done = {-1 - r.shard for r in rows if r.shard < 0}
    for s in range(m.shards):
        if s not in done:
            _save(m.folder, f"pairs-{s}", np.empty(0, "<u8"))
            _save_counts(m.folder, f"paircounts-{s}", np.empty(0, np.int64))
            _save(m.folder, f"contexts-{s}", np.zeros(3 * (m.sizes[s] + 1), "<u4"))
        if s not in low:
            _save_counts(m.folder, f"before-{s}", np.zeros(m.sizes[s], np.int64))


def train(texts: DataFrame, shards: int | None = None) -> Model:
    """Count the words and bigrams of one column of texts; the files lie in the shared folder.

    Shards follow the size of the text, so that what one task merges stays the same at any size.
    """
    spark = texts.sparkSession
    small_batches(spark)
    size = texts.agg(F.sum(F.octet_length(texts.columns[0]))).first()[0] or 0
    m = Model(fresh_path(spark, "lm"), shards or max(8, -(-size // SHARD)))
    _count_words(texts, m)
    _count_pairs(texts, m)
    return m


def _less(counts: np.ndarray, d: list[float]) -> np.ndarray:
    """Counts less their discount."""
    return np.maximum(counts - np.array([0.0, *d])[np.minimum(counts, 3)], 0.0)


def score_group(files: Files, raw: list[bytes]) -> tuple[np.ndarray, ...]:
    """n_tokens, n_known, base score and model score of each text."""
    m = files.m
    w = Words(raw, lower=True)
    texts = len(raw)
    words, which = np.unique(w.hash, return_inverse=True)
    first = w.first
    del w
    ids = files.ids(words)
    order = np.argsort(ids, kind="stable")
    seen, before = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    seen[order], before[order] = files.by_id("counts", ids[order]), files.by_id("before", ids[order])
    # One more row each for the end, one for the begin mark as a context.
    seen, before = np.append(seen, [m.texts, m.texts]), np.append(before, [m.end_contexts, 0])
    local, starts = _stream(first, which.astype(np.uint64))
    del words, which, order
    local = np.where(local == U(END), U(len(ids)), np.where(local == U(BEGIN), U(len(ids) + 1), local)).astype(np.int64)
    names = np.append(ids, [U(END), U(BEGIN)])
    keep = local[:-1] != len(ids)
    context, token = local[:-1][keep], local[1:][keep]
    del local, keep
    owner = np.repeat(np.arange(texts), np.diff(starts) - 1)
    n = np.diff(starts) - 1
    known = np.bincount(owner, seen[token] > 0, texts).astype(np.int64)
    base = np.bincount(owner, np.log10((seen + 0.5) / (m.tokens + 0.5 * (m.distinct + 1)))[token], texts)

    low = (_less(before, m.low_discounts) / m.bigrams if m.bigrams else np.zeros(len(before))) + m.low_rest / (m.distinct + 1)
    pairs, at = np.unique((names[context] << U(32)) | names[token], return_inverse=True)
    count, rest = np.zeros(len(pairs), np.int64), np.ones(len(pairs))
    cut = np.append(np.searchsorted(pairs, _shard_of_context(m)), len(pairs))
    for s in range(m.shards):
        part = pairs[cut[s] : cut[s + 1]]
        have = files.array("pairs", s, "<u8") if len(part) else part
        if len(have):
            i = np.minimum(np.searchsorted(have, part), len(have) - 1)
            count[cut[s] : cut[s + 1]] = np.where(have[i] == part, files.counts("paircounts", s, i), 0)
        if len(part):
            c = part >> U(32)
            row = np.where(c == U(BEGIN), U(m.sizes[s]), c - m.id_bounds()[s]).astype(np.int64)
            ok = (c != U(UNKNOWN)) & (row <= m.sizes[s])
            follows = np.zeros((len(part), 3))
            follows[ok] = files.array("contexts", s, "<u4").reshape(-1, 3)[row[ok]]
            rest[cut[s] : cut[s + 1]] = follows @ np.array(m.discounts)
    of = seen[context]
    del pairs, context
    with np.errstate(divide="ignore", invalid="ignore"):
        p = np.where(of > 0, _less(count, m.discounts)[at] / of + rest[at] / of * low[token], low[token])
    return n, known, base, np.bincount(owner, np.log10(p), texts)


def score_table(df: DataFrame, key: str = "doc_id", text: str = "text", *, folds: int = 5, held: int = 1, shards: int | None = None) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for each row of ``df``."""
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("t"))
    m = train(rows.where(fold(F.col("id"), folds) != held).select("t"), shards)

    def run(batches):
        files = Files(m)
        for held, raw in _groups(batches, 1):
            n, known, base, score = score_group(files, raw)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([part.column(0) for part in held]), pa.array(n), pa.array(known), pa.array(base), pa.array(score)], ["id", "n_tokens", "n_known", "base_score", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select(F.col("id").alias(key), F.coalesce(fold(F.col("id"), folds) == held, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(m.tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
