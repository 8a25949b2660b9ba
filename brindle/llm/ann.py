"""Approximate nearest neighbours: inverted lists of coarse centroids, product-quantised residuals.

Centroids and codebooks are fitted on a bounded sample; every vector is indexed. A query probes
the lists of its nearest centroids, ranks their codes by asymmetric distance tables, and reranks
the ``refine`` best of each block by the exact Euclidean distance on the original vectors. The
number of probes is the least that covers ``COVER`` of the true neighbours of queries within the
sample. Lists are cut into blocks of at most about ``BLOCK`` rows (and queries likewise), so one
very common vector spreads over many tasks; codes that tie with the last one kept are all
reranked, so equal vectors are ranked by id.

Vectors that are null, empty, zero or hold null or non-finite components take no part, as queries
or as candidates. Vectors of different lengths are no candidates for each other: every length has an index
of its own. Rows that repeat an id are separate candidates, and separate queries, each with its own
k results under the one query_id; a row is no candidate for a query of the same id. Ties go
to the smaller id. Extra columns are ignored, an empty table has no results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import materialise
from ._vectors import best, by_length, matrix, usable

#: Rows the index is fitted on, at most; rows and queries of a block, about.
SAMPLE = 20_000
BLOCK = 1_024
COVER = 0.98
CODES = 256


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm from distinct random rows; empty centres take the farthest rows."""
    rng = np.random.default_rng(seed)
    rows = np.unique(x, axis=0)
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(rounds):
        d = _square(x, centres)
        near = d.argmin(1)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        empty = np.flatnonzero(counts == 0)
        if len(empty):
            centres[empty] = x[np.argsort(-d.min(1), kind="stable")[: len(empty)]]
    return centres


@dataclass
class Index:
    centres: np.ndarray
    books: list[np.ndarray]
    probes: int

    def lists(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        """The n nearest lists of each row."""
        return np.argsort(_square(x, self.centres), axis=1, kind="stable")[:, :n]

    def codes(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        r = np.array_split(x - self.centres[lists], len(self.books), axis=1)
        return np.stack([_square(p, b).argmin(1).astype(np.uint8) for p, b in zip(r, self.books)], axis=1)

    def table(self, q: np.ndarray, which: int) -> np.ndarray:
        """Squared distance of the query's residual to each code of each part."""
        parts = np.array_split(q - self.centres[which], len(self.books))
        out = np.full((len(self.books), CODES), np.inf)
        for j, (p, b) in enumerate(zip(parts, self.books)):
            out[j, : len(b)] = ((b - p) ** 2).sum(1)
        return out


def fit(x: np.ndarray, rows: int, k: int, parts: int = 16) -> Index:
    """x: the sample, rows: how many there are in all."""
    centres = kmeans(x, int(min(max(8, rows**0.5), 1024, max(1, len(x) // 16))), 8, 1)
    index = Index(centres, [], len(centres))
    near = index.lists(x)[:, 0]
    residual = np.array_split(x - centres[near], min(parts, x.shape[1]), axis=1)
    index.books = [kmeans(p, CODES, 5, 2 + j) for j, p in enumerate(residual)]
    some = np.random.default_rng(3).choice(len(x), min(300, len(x)), replace=False)
    d = _square(x[some], x)
    d[np.arange(len(some)), some] = np.inf
    true = np.argsort(d, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    place = np.argsort(index.lists(x[some], len(centres)), axis=1)  # rank of each list for each query
    ranks = np.sort(place[np.arange(len(some))[:, None], near[true]].ravel())
    index.probes = int(ranks[min(len(ranks) - 1, int(COVER * len(ranks)))]) + 1 if len(ranks) else len(centres)
    return index


def search(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", *, k: int = 10, refine: int = 128) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which ``is_query`` (on column id) holds."""
    rows = usable(df, key, vector, zero=False)
    kind = rows.schema["id"].dataType.simpleString()
    found = by_length(rows, lambda part: _search(part, is_query, kind, k, refine))
    if found is None:
        found = df.sparkSession.createDataFrame([], f"length int, query_row bigint, query_id {kind}, vec_id {kind}, score double")
    return best(found, k, ["score"])


def _search(rows: DataFrame, is_query: Column, kind: str, k: int, refine: int) -> DataFrame:
    """query_row, query_id, vec_id, score: candidates of rows of one length, k of each block."""
    spark = rows.sparkSession
    out_schema = f"query_row bigint, query_id {kind}, vec_id {kind}, score double"
    total = rows.count()
    if total < 2:
        return spark.createDataFrame([], out_schema)
    sample = np.array([r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()])
    index = spark.sparkContext.broadcast(fit(sample, total, k))  # at most 1024 centres and 256 codes a part

    def assign(batches):
        ix = index.value
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))
                lists = ix.lists(x)[:, 0]
                codes = ix.codes(x, lists)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "v", "list", "codes"])

    def probe(batches):
        ix = index.value
        for batch in batches:
            if batch.num_rows:
                lists = ix.lists(matrix(batch.column(1)), ix.probes)
                of = pa.array(np.repeat(np.arange(len(lists)), lists.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), batch.column(2).take(of), pa.array(lists.ravel().astype(np.int32))], ["id", "v", "row", "list"])

    indexed = materialise(rows.mapInArrow(assign, f"id {kind}, v array<double>, list int, codes binary"), "ivf")
    asks = rows.where(is_query).withColumn("row", F.monotonically_increasing_id())
    probes = materialise(asks.mapInArrow(probe, f"id {kind}, v array<double>, row bigint, list int"), "probes")
    # One row for each list at most: the number of blocks that its rows, and its queries, are dealt to.
    blocks = indexed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("rb"))
    asked = probes.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("qb"))
    cells = F.broadcast(blocks.join(asked, "list"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = indexed.join(cells, "list").withColumn("r", F.pmod(F.xxhash64("id"), F.col("rb")).cast("int")).withColumn("q", spread("qb")).drop("rb", "qb")
    right = probes.join(cells, "list").withColumn("q", F.pmod(F.xxhash64("row", F.lit(7)), F.col("qb")).cast("int")).withColumn("r", spread("rb")).drop("rb", "qb")

    def scan(block: pa.Table, queries: pa.Table) -> pa.Table:
        ix, out = index.value, ([], [], [], [])
        if block.num_rows and queries.num_rows:
            ids, x = block["id"].to_numpy(), matrix(block["v"])
            codes = np.frombuffer(b"".join(block["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)
            which, part = block["list"][0].as_py(), np.arange(codes.shape[1])
            for q, row, v in zip(queries["id"].to_pylist(), queries["row"].to_pylist(), matrix(queries["v"])):
                near = ix.table(v, which)[part, codes].sum(1)
                near[ids == q] = np.inf
                few = np.flatnonzero((near <= np.partition(near, refine - 1)[refine - 1]) if len(near) > refine else np.ones(len(near), bool))
                few = few[ids[few] != q]
                score = np.sqrt(((x[few] - v) ** 2).sum(1))
                first = np.lexsort((ids[few], score))[:k]
                out[0].extend([row] * len(first))
                out[1].extend([q] * len(first))
                out[2].extend(ids[few[first]].tolist())
                out[3].extend(score[first].tolist())
        types = (pa.int64(), block.schema.field("id").type, block.schema.field("id").type, pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(out, types)], ["query_row", "query_id", "vec_id", "score"])

    by = ["list", "r", "q"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(scan, out_schema)
