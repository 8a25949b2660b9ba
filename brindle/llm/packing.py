"""Mixture-controlled packing by deficit round-robin over source queues.

Every document's tokens join the queue of its source (null is a source too). A round gives each
queue a quantum of ``window`` tokens times the source's target share, and a queue serves all whole
tokens of its deficit, cutting a document where that ends; the fraction left is carried on. A queue
that is owed fewer than ``least`` tokens a round is passed over until it is owed that many, so rare
sources don't fall into pieces of single tokens. No queue runs dry before its end, so
after turn ``j`` a queue has served exactly ``floor(j * quantum)`` tokens (``quantum`` that of all
rounds of a turn): deficits carried across all windows and partitions in closed form.

Rounds, laid end to end, are cut into sequences of ``window`` tokens, so only the last one is
padded. All queues together are never further from their targets than one token for each source
served every round and ``least`` for each of the others, and no window holds more or less of a source than its
quantum by more than that and the source's own turn. Shares that are not given are the sources' shares of
all tokens, which empties all queues together; with other shares, a queue that ends early leaves
its slots to the others.

Positions come from two prefix sums over small per-block totals (blocks hold a bounded number
of tokens whatever the source), so a source with a third of all rows is spread over many tasks.
Rows are told apart by a row id written with the tokens: repeated rows are packed once each, and ids that
tie or are null need no care. A null or empty text has one id, the end token. A very long text is cut like any
other, within one row of ids. Extra columns are ignored, an empty table has no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import materialise
from ._textvec import slices
from ._wordbpe import load

WINDOW = 4096
#: Tokens that a queue is owed before it is served.
LEAST = 64
#: Tokens that a block of the prefix sums holds, about, and how many blocks there are at most:
#: one task adds up the blocks' totals, many tasks the documents within them.
BLOCK_TOKENS = 262_144
BLOCKS = 100_000


def tokenise(df: DataFrame, key: str, text: str, group: str | None, path: str, end_id: int) -> DataFrame:
    """(row, key, source, n, ids): a row id, the queue and the ids (of the tokenizer's ``dtype``) with the end id."""
    rows = df.select(F.col(key).alias("key"), (F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("source"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = load(path)
        tail, size = np.array([end_id], words.dtype).tobytes(), words.dtype.itemsize
        for batch in batches:
            for part, raw in slices(batch, 2):
                ids = [x + tail for x in words.encode_many(raw)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) // size for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["key", "source", "n", "ids"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, source string, n bigint, ids binary").select(F.monotonically_increasing_id().alias("row"), "*")


def schedule(meta: DataFrame, *, window: int = WINDOW, shares: dict[str, float] | None = None, least: int = LEAST, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(row, a, n, pos): pieces of each row's tokens, n from a on, and where they lie in the served stream. meta: row, source, n."""
    total = meta.agg(F.sum("n")).first()[0] or 1
    block_tokens = max(block_tokens, -(-total // BLOCKS))
    blocks = -(-total // block_tokens)
    # Queues are in the order of a hash of the row id, so that blocks are even for any source.
    h = F.xxhash64("row")
    queue = meta.withColumn("h", h).withColumn("qb", F.shiftright(F.shiftrightunsigned(h, 40) * F.lit(blocks), 24))
    mine = Window.partitionBy("source")
    sums = queue.groupBy("source", "qb").agg(F.sum("n").alias("n"))
    sums = sums.select("source", "qb", (F.sum("n").over(mine.orderBy("qb")) - F.col("n")).alias("before"), F.sum("n").over(mine).alias("tokens"))
    inside = Window.partitionBy("source", "qb").orderBy("h", "row")
    queue = queue.withColumn("_in", F.sum("n").over(inside) - F.col("n"))
    same = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.qb") == F.col("b.qb"))
    queue = queue.alias("a").join(sums.alias("b"), same).select("a.row", "a.source", "a.n", (F.col("b.before") + F.col("a._in")).alias("start"), "b.tokens")

    if shares is None:
        owed = F.col("tokens") * F.lit(float(window)) / F.lit(float(total))
        last = F.lit(-(-total // window))
    else:
        weight = F.lit(float(min(shares.values())))
        for name, value in shares.items():
            weight = F.when(F.col("source") == name, F.lit(float(value))).otherwise(weight)
        owed = weight * window / float(sum(shares.values()))
        last = F.lit((1 << 62))
    queue = queue.withColumn("every", F.greatest(F.lit(1), F.ceil(F.lit(float(least)) / owed)).cast("long")).withColumn("quantum", owed * F.col("every"))
    # Every turn that can touch the row, one more on either side for rounding; empty ones drop out.
    end = F.col("start") + F.col("n")
    turns = F.sequence(F.greatest(F.lit(0), F.floor(F.col("start") / F.col("quantum")) - 1).cast("long"), (F.floor(end / F.col("quantum")) + 1).cast("long"))
    from_ = F.greatest("start", F.floor(F.col("turn") * F.col("quantum")).cast("long"))
    to = F.least(end, F.floor((F.col("turn") + 1) * F.col("quantum")).cast("long"))
    pieces = queue.withColumn("turn", F.explode(turns)).select("row", "source", "start", from_.alias("x"), to.alias("y"), F.least((F.col("turn") + 1) * F.col("every"), last).alias("round")).where("x < y")
    pieces = pieces.select("row", "source", "x", (F.col("x") - F.col("start")).alias("a"), (F.col("y") - F.col("x")).alias("n"), "round", F.floor(F.col("round") / max(1, block_tokens // window)).cast("long").alias("sb"))
    # A block of rounds holds about block_tokens; ranges of blocks go through one small running sum.
    sums = pieces.groupBy("sb").agg(F.sum("n").alias("n"))
    sums = sums.select("sb", (F.sum("n").over(Window.orderBy("sb")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("sb").orderBy("round", F.col("source").asc_nulls_first(), "x").rowsBetween(Window.unboundedPreceding, 0)
    local = pieces.withColumn("_in", F.sum("n").over(inside) - F.col("n"))
    return local.join(sums, "sb").select("row", "a", "n", (F.col("before") + F.col("_in")).cast("long").alias("pos"))


def _cut(pos: np.ndarray, a: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Pieces cut where sequences end: index of the piece, start within the document, length, sequence, offset."""
    first = pos // window
    parts = (pos + n - 1) // window - first + 1
    of = np.repeat(np.arange(len(n)), parts)
    seq = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    lo = np.maximum(seq * window, pos[of])
    hi = np.minimum((seq + 1) * window, (pos + n)[of])
    return of, a[of] + lo - pos[of], hi - lo, seq, lo - seq * window


def pack(df: DataFrame, key: str, text: str, group: str | None, path: str, *, window: int = WINDOW, end_id: int = 2, shares: dict[str, float] | None = None, least: int = LEAST, keep_ids: bool = True, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids of the tokenizer's ``dtype``]."""
    tokens = materialise(tokenise(df, key, text, group, path, end_id), "packing")
    pieces = schedule(tokens.select("row", "source", "n"), window=window, shares=shares, least=least, block_tokens=block_tokens)
    of_row = pieces.groupBy("row").agg(F.collect_list(F.struct("a", "n", "pos")).alias("p"))
    placed = tokens.select("row", "key", "n", "ids").join(of_row, "row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = load(path).dtype
        for batch in batches:
            for part, raw in slices(batch, 2):
                lists = part.column(3)
                flat = lists.flatten()
                a, n, pos = (flat.field(i).to_numpy() for i in range(3))
                row = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy())
                of, start, length, seq, offset = _cut(pos, a, n, window)
                row = row[of]
                ids = [np.frombuffer(x, dtype) for x in raw]
                got = [ids[d][i:j] for d, i, j in zip(row.tolist(), start.tolist(), (start + length).tolist())]
                cols = [part.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in got], pa.int64()), part.column(1).take(pa.array(row)), pa.array(seq), pa.array(offset)]
                names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if keep_ids:
                    cols.append(pa.array([x.tobytes() for x in got], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    kind = placed.schema["key"].dataType.simpleString()
    schema = f"`{key}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + (", ids binary" if keep_ids else "")
    return placed.select("key", "n", "ids", "p").mapInArrow(cut, schema)
