"""Vectorised word hashing over batches of texts (numpy, no loop over words).

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D. A word's 64-bit hash is a polynomial
over table-mixed bytes, taken from prefix sums modulo 2^64 and then finalised; hashes of word
sequences come from prefix sums over the word hashes in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SEGMENT = 1 << 20
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BASES = {"byte": 0x9E3779B97F4A7C15, "word": 0xD1342543DE82EF95}
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i up to n."""
    if kind not in _POWERS or len(_POWERS[kind][0]) <= n:
        size = max(n + 1, SEGMENT + 1)
        out = []
        for base in (_BASES[kind], pow(_BASES[kind], -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        if n > 8 * SEGMENT:
            return out[0], out[1]  # a very long text: not kept
        _POWERS[kind] = (out[0], out[1])
    return _POWERS[kind]


def hash_spans(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes a[start:end] of sorted spans, segment by segment."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(out):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + SEGMENT, "right")))
        part = a[base : int(ends[j - 1])]
        power, inverse = _powers("byte", len(part))
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[part] * power[: len(part)], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * U(0xC2B2AE3D27D4EB4F))
        i = j
    return out


class Words:
    """Words of a few texts: byte ``starts`` and ``ends`` in ``buf``, ``first`` word of each text, 64-bit ``hash``."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        buf = b"\n" + b"\n".join(texts) + b"\n"
        self.buf = buf.translate(LOWER) if lower else buf
        a = np.frombuffer(self.buf, np.uint8)
        space = SPACE[a]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.starts, self.ends = edges[0::2], edges[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = 1 + np.concatenate(([0], np.cumsum(sizes + 1)))
        self.first = np.searchsorted(self.starts, begins)
        self.hash = self._hash(self.ends)

    def starts_hash(self, size: int) -> np.ndarray:
        """Hash of the first ``size`` bytes of each word."""
        return self._hash(np.minimum(self.starts + size, self.ends))

    def _hash(self, ends: np.ndarray) -> np.ndarray:
        return hash_spans(np.frombuffer(self.buf, np.uint8), self.starts, ends)

    def prefix(self, seed: int) -> np.ndarray:
        """Prefix sums for ``span``; another seed gives an independent hash."""
        h = mix(self.hash ^ U(seed))
        sums = np.empty(len(h) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(h * _powers("word", len(h))[0][: len(h)], out=sums[1:])
        return sums


def span(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of the word sequences [start, stop)."""
    inverse = _powers("word", len(prefix))[1]
    return mix((prefix[stop] - prefix[start]) * inverse[start] + (stop - start).astype(np.uint64) * U(0x165667B19E3779F9))


def groups(sizes: list[int], limit: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """[i, j) ranges of texts with about ``limit`` bytes together."""
    i = total = 0
    for j, n in enumerate(sizes):
        if total and total + n > limit:
            yield i, j
            i, total = j, 0
        total += n + 1
    if i < len(sizes):
        yield i, len(sizes)


def encoded(texts: list[str | None]) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]


def raw_texts(column: pa.Array) -> list[bytes]:
    """The bytes of a string column; null is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: int, limit: int = SEGMENT) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch whose texts have about ``limit`` bytes together, however many rows that is, and those texts."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for i, j in groups(sizes, limit):
        part = batch.slice(i, j - i)
        yield part, raw_texts(part.column(column))
