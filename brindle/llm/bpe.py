"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into overlapping chunks that are pre-tokenised independently (in parallel tasks
for long texts). A chunk may begin inside a pre-token, so its first boundaries can be wrong; two
neighbours are stitched at the first position of their overlap where both have a boundary. The
pre-tokeniser looks ahead by one character and never behind, so from a shared boundary on both
agree. A chunk that does not resynchronise inside the overlap is tokenised again from the last
sure boundary, together with the next one. Pieces are then encoded one by one; decoding
concatenates the raw bytes of the ids.

Null texts count as empty; empty texts have no ids. Very long texts are read a bounded number of times, even
where no chunk resynchronises; the chunks of one text meet in one task, which holds that text. Rows that repeat, or share an id
or none, are encoded each. Extra columns are ignored, also ones with names of the result; an empty table has no result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 32_768
OVERLAP = 512
CACHE_ENTRIES = 300_000


@lru_cache(maxsize=1)
def _odd_characters() -> dict[int, str]:
    """Characters that are letters or digits to ``regex`` but not to the library's Unicode tables.

    They are taken for a sign of neither class while splitting.
    """
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([i]): i for i in range(256)}
    odd: set[str] = set()
    for kind in (r"\p{L}", r"\p{N}"):
        probe = tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks=single, special_tokens={})
        odd |= set(regex.findall(kind, every)) - set(bytes(probe.encode_ordinary(every)).decode())
    return {ord(c): "\u00a7" for c in odd}


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


class Codec:
    """Ranks and split pattern; encodes pieces with a bounded cache of piece -> ids."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.odd = _odd_characters()
        self.perhaps_odd = re.compile(f"[{chr(min(self.odd, default=0x10FFFF))}-\U0010ffff]").search
        self.raw = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.raw[rank] = token
        self.cache: dict[str, tuple[int, ...]] = {}

    def piece(self, piece: str) -> tuple[int, ...]:
        got = tuple(self.core._encode_single_piece(piece))
        if len(piece) <= 64:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[piece] = got
        return got

    def encode_pieces(self, pieces: list[str]) -> array:
        ids, known = array("I"), self.cache.get
        extend = ids.extend
        for p in pieces:
            extend(known(p) or self.piece(p))
        return ids

    def boundaries(self, text: str) -> list[int]:
        """Starts of the pre-tokens of ``text``."""
        if self.perhaps_odd(text):
            text = text.translate(self.odd)
        return [m.start() for m in self.pattern.finditer(text)]

    def encode(self, text: str) -> array:
        if self.perhaps_odd(text):
            return self.encode_pieces(_text_offsets(self.boundaries(text), text))
        return self.encode_pieces(self.pattern.findall(text))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))


def chunk_spans(length: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """[start, end) of the overlapping chunks of a text of ``length`` characters."""
    return [(at, min(length, at + chunk + overlap)) for at in range(0, max(length, 1), chunk)]


def stitch(text: str, chunks: list[tuple[int, int, list[int]]], boundaries) -> list[int]:
    """Starts of the pre-tokens of ``text`` from those of its chunks.

    ``chunks``: (start, end, starts of pre-tokens in the text), by start. ``boundaries``
    pre-tokenises a string and is called only where a chunk fails to resynchronise.
    """
    out: list[int] = []
    sure, end = chunks[0][2], chunks[0][1]  # true starts so far; where that chunk's text ended
    tried, tried_at, i = 0, -1, 1
    while i < len(chunks):
        start, stop, starts = chunks[i]
        # The last pre-tokens of a cut chunk may be cut short, and a trailing white-space run is split by what follows.
        trusted = sure[bisect_left(sure, start) :][:-2]
        shared = set(starts).intersection(trusted)
        if shared:
            at = min(shared)
            out += [b for b in sure if b < at]
            sure = starts[starts.index(at) :]
        else:
            at = sure[-2] if len(sure) > 2 else sure[0]
            out += [b for b in sure if b < at]
            # A run without a boundary is read again only at twice its length, so all readings together stay in proportion to the text.
            while at == tried_at and stop - at < 2 * tried and i + 1 < len(chunks):
                i += 1
                stop = chunks[i][1]
            sure = [at + b for b in boundaries(text[at:stop])]
            tried, tried_at = stop - at, at
        end = stop
        i += 1
    assert end == len(text)
    return out + sure


def _text_offsets(starts: list[int], text: str) -> list[str]:
    return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]


def _digest(codec: Codec, ids: array) -> tuple[int, str, str]:
    if ids.itemsize != 4:
        raise RuntimeError("unsigned int is not 32 bits here")
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()


def encode_table(df: DataFrame, key: str, text: str, path: str, pattern: str, *, chunk: int = CHUNK, overlap: int = OVERLAP, keep_ids: bool = True) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256[, ids binary little-endian uint32]) for each row.

    Texts over ``chunk`` characters are cut into chunk rows dealt over the cluster; the chunks of
    one text meet again in one task, which holds one text at a time.
    """
    rows = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    out_schema = f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids binary" if keep_ids else "")

    def rows_out(found: list[tuple], arrow_key: pa.Array) -> pa.RecordBatch:
        cols = [arrow_key, pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.string())]
        names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep_ids:
            cols.append(pa.array([x[3] for x in found], pa.binary()))
            names.append("ids")
        return pa.RecordBatch.from_arrays(cols, names)

    def one(codec: Codec, ids: array) -> tuple:
        return (*_digest(codec, ids), ids.tobytes() if keep_ids else None)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path, pattern)
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                yield rows_out([one(codec, codec.encode(t)) for t in part.column(1).to_pylist()], part.column(0))

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path, pattern)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                starts = array("I", codec.boundaries(row.column(3)[0].as_py()))
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([starts.tobytes()], pa.binary())], ["rid", "k", "at", "c", "starts"])

    def join(group: pa.Table) -> pa.Table:
        codec = load(path, pattern)
        group = group.sort_by("at")
        at, pieces = group["at"].to_pylist(), group["c"].to_pylist()
        whole = "".join(p[:chunk] for p in pieces[:-1]) + pieces[-1]
        spans = []
        for a, p, s in zip(at, pieces, group["starts"].to_pylist()):
            starts = array("I")
            starts.frombytes(s)
            spans.append((a, a + len(p), [a + x for x in starts]))
        found = one(codec, codec.encode_pieces(_text_offsets(stitch(whole, spans, codec.boundaries), whole)))
        return pa.Table.from_batches([rows_out([found], group["k"].slice(0, 1).combine_chunks())])

    small = rows.where(F.length("t") <= chunk).mapInArrow(short, out_schema)
    # One id per row, not per key, for repeated keys; every chunk row carries its own.
    n = F.length("t")
    cut = (
        rows.where(n > chunk)
        .withColumn("rid", F.struct(F.monotonically_increasing_id().alias("i"), F.xxhash64("t").alias("h")))
        .withColumn("at", F.explode(F.sequence(F.lit(0), n - 1, F.lit(chunk))))
        .select("rid", "k", "at", F.substring(F.col("t"), F.col("at") + 1, F.lit(chunk + overlap)).alias("c"))
        .repartition(F.col("rid"), F.col("at"))
    )
    large = cut.mapInArrow(pretokenise, f"rid struct<i bigint, h bigint>, k {kind}, at int, c string, starts binary").groupBy("rid").applyInArrow(join, out_schema)
    return small.unionByName(large)
