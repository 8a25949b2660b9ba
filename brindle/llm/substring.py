"""Substring dedup by compaction of a word de Bruijn graph.

The graph's edges are the windows of ``width`` consecutive words of one document. As in
minimiser-partitioned compaction, consecutive windows with the same minimiser (smallest hash of
a ``seed``-word k-mer inside) form one path, which is emitted as one row instead of up to
``width - seed + 1`` edges. Windows with equal words have equal minimisers, so all copies of an
edge meet in one minimiser:

* minimisers of one document alone hold nothing to remove and drop out;
* paths with equal words collapse to one node with their smallest document (partial aggregation,
  so thousands of copies cost one row a task);
* a minimiser with one distinct path is unbranched. If every occurrence of such a path u is followed by v, and
  every one of v follows u (out-degree and in-degree one, ends of a document count as branches),
  the two are one: joins of nodes with their neighbours find these links, and pointer jumping, a join that doubles
  its reach each round, compacts each chain to its head. All occurrences run through the whole chain, so the head's
  smallest document settles all its edges, and only the head's occurrences are joined again;
* where paths branch, one occurrence of each distinct path is fetched by its source coordinates
  and opened into single windows, which settle by their own word sequence.

Paths, and opened windows, are the same only if their words agree: each carries a 128-bit BLAKE2 digest of its
words, taken where the text stands at its coordinates. Hashes of 64 bits only choose minimisers and label neighbours (a link
needs two labels to agree). A window goes if its word sequence starts in a document with a smaller id.

Null and empty texts have no words, texts of fewer than ``width`` words no window. Rows with a null id are kept
whole, and nothing is removed because of them. Rows that repeat an id are judged each by its own text; equal ids don't remove
each other, so repeated rows all lose the same. Very long texts are read whole, each by itself. Extra columns, also
ones with names of the result, are ignored unless named; an empty table has no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._joins import join_split
from ._scratch import discard, materialise
from ._textvec import Words, groups, slices, span

WIDTH = 50
SEED = 16
KMER = 11


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive values."""
    out, have = x, 1
    while 2 * have <= n:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (n - have)], out[n - have :]) if n > have else out


def _paths(w: Words, width: int, seed: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, minimiser) of each path."""
    n = len(w.hash)
    none = np.empty(0, np.int64)
    if n < width:
        return none, none, none, none.astype(np.uint64)
    pk = w.prefix(KMER)
    at = np.arange(n - seed + 1)
    low = _sliding_min(span(pk, at, at + seed), width - seed + 1)
    owner = np.searchsorted(w.first, np.arange(len(low)), "right") - 1
    whole = np.arange(len(low)) + width <= w.first[owner + 1]
    new = np.empty(len(low), bool)
    new[0] = True
    new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1]) | ~whole[:-1]
    start = np.flatnonzero(new & whole)
    ids = np.cumsum(new) - 1
    count = np.bincount(ids[whole], minlength=int(ids[-1]) + 1)[ids[start]]
    return owner[start], start, count, low[start]


def _spaced(texts: list[bytes]) -> list[bytes]:
    """Texts with one space between words, so that equal words are equal bytes."""
    return [b" ".join(t.split()) for t in texts]


def _digests(w: Words, start: np.ndarray, stop: np.ndarray) -> list[pa.Array]:
    """Two 64-bit halves of the digest of the words [start, stop) of spaced texts."""
    buf, digest = w.buf, hashlib.blake2b
    raw = b"".join([digest(buf[i:j], digest_size=16).digest() for i, j in zip(w.starts[start].tolist(), w.ends[stop - 1].tolist())])
    halves = np.frombuffer(raw, "<i8").reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(halves[:, k])) for k in range(2)]


def emit_paths(rows: DataFrame, kind: str, width: int, seed: int) -> DataFrame:
    """rows: id, th, rid, t -> (id, th, rid, a, n, mm, p1, p2): n windows from word a share minimiser mm; p1 and p2 digest their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in slices(batch, 3):
                w = Words(_spaced(raw))
                owner, start, count, low = _paths(w, width, seed)
                of = pa.array(owner)
                cols = [*(part.column(i).take(of) for i in range(3)), pa.array((start - w.first[owner]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(low.view(np.int64))]
                yield pa.RecordBatch.from_arrays([*cols, *_digests(w, start, start + count + width - 1)], ["id", "th", "rid", "a", "n", "mm", "p1", "p2"])

    return rows.mapInArrow(run, f"id {kind}, th bigint, rid bigint, a int, n int, mm bigint, p1 bigint, p2 bigint")


def open_paths(rows: DataFrame, kind: str, width: int) -> DataFrame:
    """rows: id, t, paths -> (mm, p1, p2, i, w1, w2, low): the windows of each path, with the path's smallest document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in slices(batch, 1):
                w = Words(_spaced(raw))
                paths = part.column(2)
                flat = paths.flatten()
                sizes = np.array(pc.list_value_length(paths))
                a, n = flat.field("a").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int64)
                owner = np.repeat(np.arange(len(raw)), sizes)
                # Some thousands of windows at a time, however many paths a text has.
                for i, j in groups(n.tolist(), 1 << 16):
                    of = np.repeat(np.arange(i, j), n[i:j])
                    idx = np.arange(len(of)) - np.repeat(np.cumsum(n[i:j]) - n[i:j], n[i:j])
                    at = (w.first[owner] + a)[of] + idx
                    take = pa.array(of)
                    cols = [*(flat.field(c).take(take) for c in ("mm", "p1", "p2")), pa.array(idx.astype(np.int32)), *_digests(w, at, at + width), part.column(0).take(pa.array(owner[of]))]
                    yield pa.RecordBatch.from_arrays(cols, ["mm", "p1", "p2", "i", "w1", "w2", "low"])

    return rows.mapInArrow(run, f"mm bigint, p1 bigint, p2 bigint, i int, w1 bigint, w2 bigint, low {kind}")


def compact(nodes: DataFrame) -> DataFrame:
    """Heads of the nonbranching chains of nodes (p1, p2, n, next, prev): p1, p2 and len, the edges of the whole chain.

    next and prev label (p1) the one neighbour that all occurrences have, null otherwise. A chain ends
    where its text does, so there are no cycles.
    """
    spark = nodes.sparkSession
    u = nodes.where("next is not null").select(F.col("p1").alias("u1"), F.col("p2").alias("u2"), F.col("n").alias("un"), "next")
    v = nodes.select("p1", "p2", "n", "prev")
    linked = v.join(u, (u.next == v.p1) & (v.prev == u.u1), "left")
    at = linked.select("p1", "p2", "n", F.coalesce("u1", "p1").alias("h1"), F.coalesce("u2", "p2").alias("h2"), F.coalesce("un", F.lit(0)).cast("long").alias("off"), F.col("u1").isNull().alias("done"))
    at = materialise(at, "chains")
    while at.where("not done").limit(1).count():
        to = at.select(F.col("p1").alias("t1"), F.col("p2").alias("t2"), F.col("h1").alias("j1"), F.col("h2").alias("j2"), F.col("off").alias("more"), F.col("done").alias("ends"))
        rest = at.where("not done").join(to, (F.col("h1") == F.col("t1")) & (F.col("h2") == F.col("t2")))
        rest = rest.select("p1", "p2", "n", F.col("j1").alias("h1"), F.col("j2").alias("h2"), (F.col("off") + F.col("more")).alias("off"), F.col("ends").alias("done"))
        before, at = at, materialise(at.where("done").unionByName(rest), "chains")
        discard(spark, before.scratch_path)
    return at.groupBy(F.col("h1").alias("p1"), F.col("h2").alias("p2")).agg(F.max(F.col("off") + F.col("n")).cast("int").alias("len"))


def _keep(text: bytes, spans: list[dict] | None, width: int) -> tuple[int, int, bytes]:
    """(words, removed words, kept words joined by one space)."""
    words = text.split()  # of bytes: exactly 0x20 and 0x09-0x0D
    if not spans:
        return len(words), 0, b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int32)
    for s in spans:
        gone[s["a"]] += 1
        gone[s["a"] + s["n"] + width - 1] -= 1
    out = np.cumsum(gone[:-1]) > 0
    return len(words), int(out.sum()), b" ".join([x for x, g in zip(words, out.tolist()) if not g])


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", *, width: int = WIDTH, seed: int = SEED, keep_text: bool = True, columns: list[str] | None = None) -> DataFrame:
    """One row per row of ``df``: key, n_words, n_removed, kept_sha256[, kept_text] and the ``columns`` named."""
    kind = df.schema[key].dataType.simpleString()
    carried = [F.col(c).alias(f"c{i}") for i, c in enumerate(columns or [])]
    docs = df.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("t"), *carried)
    known = docs.where(F.col("id").isNotNull())
    paths = materialise(emit_paths(known.select("id", "th", F.monotonically_increasing_id().alias("rid"), "t"), kind, width, seed), "paths")

    shared = paths.groupBy("mm").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("mm")
    row = Window.partitionBy("rid").orderBy("a")
    follows = F.lead("a").over(row) == F.col("a") + F.col("n")
    leads = F.lag("a").over(row) + F.lag("n").over(row) == F.col("a")
    found = join_split(paths, shared, ["mm"]).select("id", "th", "a", "n", "mm", "p1", "p2", F.when(follows, F.lead("p1").over(row)).alias("next"), F.when(leads, F.lag("p1").over(row)).alias("prev"))
    found = materialise(found, "shared")
    path = ["mm", "p1", "p2"]
    one = lambda c: F.when((F.count(c) == F.count("*")) & (F.min(c) == F.max(c)), F.min(c)).alias(c)
    distinct = found.groupBy(*path).agg(F.min(F.struct("id", "th", "a", "n")).alias("r"), F.max("id").alias("hi"), one("next"), one("prev"))
    per_mm = distinct.groupBy("mm").agg(F.count("*").alias("c"))
    nodes = materialise(join_split(distinct, per_mm, ["mm"]).select(*path, F.col("r.id").alias("low"), F.col("r.th").alias("th"), F.col("r.a").alias("a"), F.col("r.n").alias("n"), "hi", "next", "prev", (F.col("c") > 1).alias("branched")), "nodes")
    # Unbranched paths: the heads of their chains.
    plain = nodes.where("not branched")
    heads = plain.select(*path, "low").join(compact(plain.select("p1", "p2", "n", "next", "prev")), ["p1", "p2"])
    # Branched ones: their windows. Not written: its two uses and the last join read one shuffle of the texts (a reused exchange).
    split = nodes.where("branched")
    reps = split.groupBy(F.col("low").alias("id"), "th").agg(F.collect_list(F.struct("a", "n", *path)).alias("paths"))
    opened = open_paths(known.join(reps, ["id", "th"]).select("id", "t", "paths"), kind, width)
    best = opened.groupBy("mm", "w1", "w2").agg(F.min("low").alias("best"), F.max("low").alias("worst")).where("best < worst").drop("worst")
    # Neighbouring windows with the same smallest document are one run.
    run = F.col("i") - F.row_number().over(Window.partitionBy(*path, "best").orderBy("i"))
    runs = join_split(opened, best, ["mm", "w1", "w2"]).where("best < low").withColumn("run", run).groupBy(*path, "best", "run").agg(F.min("i").alias("i"), F.count("*").cast("int").alias("n"))
    better = runs.groupBy(*path).agg(F.collect_list(F.struct("i", "n", "best")).alias("better"))
    opened_low = join_split(split.select(*path, "low", "hi", F.col("n").alias("len")), better, path, "left").where("low < hi or better is not null").drop("hi")
    settled = opened_low.unionByName(heads, allowMissingColumns=True)
    hits = join_split(found, settled, path).select(
        "id",
        "th",
        F.when(F.col("low") < F.col("id"), F.array(F.struct("a", F.col("len").alias("n"))))
        .otherwise(F.transform(F.filter(F.coalesce("better", F.array()), lambda b: b["best"] < F.col("id")), lambda b: F.struct((F.col("a") + b["i"]).alias("a"), b["n"].alias("n"))))
        .alias("s"),
    )
    spans = hits.where(F.size("s") > 0).groupBy("id", "th").agg(F.flatten(F.collect_list("s")).alias("spans"))
    names = [f"c{i}" for i in range(len(carried))]
    empty = F.lit(None).cast(spans.schema["spans"].dataType)
    joined = known.join(spans, ["id", "th"], "left").select("id", "t", "spans", *names).unionByName(docs.where(F.col("id").isNull()).select("id", "t", empty.alias("spans"), *names))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in slices(batch, 1):
                got = [_keep(t, s, width) for t, s in zip(raw, part.column(2).to_pylist())]
                cols = [part.column(0), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64()), pa.array([hashlib.sha256(x[2]).hexdigest() for x in got])]
                head = ["id", "n_words", "n_removed", "kept_sha256"]
                if keep_text:
                    cols.append(pa.array([x[2].decode("utf-8", "surrogatepass") if x[1] else t for x, t in zip(got, part.column(1).to_pylist())], pa.string()))
                    head.append("kept_text")
                yield pa.RecordBatch.from_arrays([*cols, *part.columns[3:]], [*head, *names])

    schema = f"id {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * keep_text + "".join(f", {n} {docs.schema[n].dataType.simpleString()}" for n in names)
    out = joined.mapInArrow(cut, schema)
    return out.toDF(*[{"id": key, **dict(zip(names, columns or []))}.get(c, c) for c in out.columns])
