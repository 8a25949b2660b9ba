"""Exact top-k by integer inner product: best-first search in M-trees.

Vectors become whole numbers, floor(scale * x). With one more coordinate, sqrt(M - |x|^2) for the
largest squared norm M of the tree (0 for a query), the greatest inner product is the least Euclidean
distance, a metric. Blocks of rows are bulk-loaded into M-trees: a page holds routing objects with
covering radius and distance to their parent, a leaf page holds rows with theirs. A search opens
pages by least possible distance and skips, through the stored distances and the triangle
inequality, objects that can't beat the k-th best, before computing their distance. The queries of a block
search together, each with its own bound. They start
from the k-th best score against a pilot, a bounded sample of rows, so that a tree is left at once if
all it holds is worse. Bounds have a slack for rounding and keep ties; scores are computed in whole numbers.

Rows are dealt to blocks evenly by a hash, one tree and one task each. Queries lie in the shared folder as files of
whole numbers, a block in each, which every task reads one after the other: no copies of them are sent. Rows
whose squared norm is 2^62 or more (all others multiply without overflow in 64 bits) lie in
blocks of their own, and pairs with one of them are scored in whole numbers of any width. A score beyond 64 bits
is null in the result, its rank is exact.

Vectors that are null, empty or hold null or non-finite components take no part; those of different lengths are no
candidates for each other. Rows that repeat an id are separate candidates, and separate queries, each
with its own k results under the one query_id; a row is no candidate for a query of the same
id. Ties go to the smaller id. Extra columns are ignored, an empty table has no results.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._scratch import fresh_path, load, materialise, save
from ._vectors import best, by_length, matrix, usable

#: Rows of a block at least (if there are as many), at most, and at most in bytes of doubles; blocks that rows are spread over before these grow.
BLOCK, LARGE, LARGE_BYTES, SPREAD = 4_096, 65_536, 32 << 20, 64
#: Queries of a block, and rows of a leaf page that are scored at once.
QUERIES, SCORED = 1_024, 1_024
PAGE, FANOUT = 256, 16
#: Products below this are whole numbers in doubles too.
EXACT = float(1 << 53)
#: Rows of the pilot, at most; squared norms from which whole numbers of any width are used.
PILOT = 4_096
WIDE = float(1 << 62)


@dataclass
class Page:
    """Rows (leaf) or child pages, with their routing objects, radii and distances to this page's own routing object."""

    rows: np.ndarray | slice | None
    children: list[Page]
    routing: np.ndarray
    radius: np.ndarray
    parent: np.ndarray


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - p) ** 2).sum(-1))


def build(x: np.ndarray, rows: np.ndarray, own: np.ndarray) -> Page:
    """Bulk load: rows go to the nearest of some routing objects; a page that can't be split becomes a leaf."""
    none = np.empty(0)
    if len(rows) > PAGE:
        pick = rows[np.linspace(0, len(rows) - 1, FANOUT).astype(int)]
        objects = np.unique(x[pick], axis=0)
        if len(objects) > 1:
            near = np.stack([_distances(x[rows], o) for o in objects], axis=1).argmin(1)
            parts = [(o, rows[near == j]) for j, o in enumerate(objects) if (near == j).any()]
            if len(parts) > 1:
                routing = np.stack([o for o, _ in parts])
                radius = np.array([_distances(x[r], o).max() for o, r in parts])
                return Page(None, [build(x, r, o) for o, r in parts], routing, radius, _distances(routing, own))
    return Page(rows, [], none, none, _distances(x[rows], own))


@dataclass
class Tree:
    ids: np.ndarray
    whole: np.ndarray  # int64, in the order of the leaf pages
    plain: np.ndarray  # the same as doubles
    top: float  # M
    root: Page
    own: np.ndarray

    @classmethod
    def load(cls, ids: np.ndarray, whole: np.ndarray) -> Tree:
        f = whole.astype(float)
        norms = (f * f).sum(1)
        top = float(norms.max(initial=0.0))
        x = np.concatenate((f, np.sqrt(top - norms)[:, None]), axis=1)
        root = build(x, np.arange(len(x)), x.mean(0))
        order, at = [], 0
        stack = [root]
        while stack:  # rows of a leaf page lie side by side
            page = stack.pop()
            stack += page.children
            if page.rows is not None:
                order.append(page.rows)
                page.rows = slice(at, at + len(page.rows))
                at = page.rows.stop
        rows = np.concatenate(order)
        return cls(ids[rows], whole[rows], f[rows], top, root, x.mean(0))

    def search(self, asked: np.ndarray, q: np.ndarray, k: int, floors: list[int | None]) -> list[list[tuple[int, int]]]:
        """For each row of ``q`` (ids in ``asked``) the k best (score, id) that reach its floor, best first; ties to the smaller id.

        The queries of a block go down together: a page is opened once, by those that it may still hold something for.
        """
        f = np.concatenate((q.astype(float), np.zeros((len(q), 1))), axis=1)
        norms = (f * f).sum(1)
        best_: list[list[tuple[int, int]]] = [[] for _ in q]
        plain = norms * self.top < EXACT * EXACT / 4
        for some, table, vectors in ((plain, self.plain, f[:, :-1]), (~plain, self.whole, q)):
            if some.any():
                self._descend(np.flatnonzero(some), table, vectors, asked, f, norms + self.top, k, floors, best_)
        return best_

    def _descend(self, live: np.ndarray, table: np.ndarray, vectors: np.ndarray, asked: np.ndarray, f: np.ndarray, norm: np.ndarray, k: int, floors: list[int | None], best_: list) -> None:
        slack = 1e-6 * (1 + np.sqrt(norm))
        least = -(1 << 63)
        reach = np.array([least if x is None else x for x in floors], np.int64)

        def bounds(some: np.ndarray) -> np.ndarray:
            far = np.sqrt(np.maximum(norm[some] - 2.0 * reach[some], 0.0)) + slack[some]
            return np.where(reach[some] == least, np.inf, far)

        bound = np.full(len(f), np.inf)
        bound[live] = bounds(live)
        # Pages by the least distance that any of their queries may find there.
        heap = [(0.0, 0, live, np.zeros(len(live)), _distances(f[live], self.own), self.root)]
        count = 0
        while heap:
            _, _, some, low, to_own, page = heapq.heappop(heap)
            few = low <= bound[some]
            some, to_own = some[few], to_own[few]
            if not len(some):
                continue
            # What the triangle inequality leaves, before any distance is computed.
            if page.rows is None:
                hit = np.abs(to_own[:, None] - page.parent) - page.radius <= bound[some][:, None]
                for j in np.flatnonzero(hit.any(0)).tolist():
                    mine = some[hit[:, j]]
                    d = _distances(f[mine], page.routing[j])
                    low = np.maximum(d - page.radius[j], 0.0)
                    well = low <= bound[mine]
                    if well.any():
                        count += 1
                        heapq.heappush(heap, (float(low[well].min()), count, mine[well], low[well], d[well], page.children[j]))
                continue
            for at in range(page.rows.start, page.rows.stop, SCORED):
                to = min(at + SCORED, page.rows.stop)
                parent = page.parent[at - page.rows.start : to - page.rows.start]
                hit = np.abs(to_own[:, None] - parent) <= bound[some][:, None]
                rows = np.flatnonzero(hit.any(0))
                mine = np.flatnonzero(hit.any(1))
                if not len(rows):
                    continue
                ids = self.ids[at:to][rows]
                scores = vectors[some[mine]] @ table[at:to][rows].T
                well = hit[np.ix_(mine, rows)] & (scores >= reach[some[mine]][:, None]) & (ids != asked[some[mine]][:, None])
                changed = np.flatnonzero(well.any(1))
                for i in changed.tolist():
                    who, cols = int(some[mine[i]]), np.flatnonzero(well[i])
                    got, names = scores[i, cols], ids[cols]
                    first = np.lexsort((names, -got))[:k]
                    best_[who] = sorted(best_[who] + list(zip(map(int, got[first].tolist()), names[first].tolist())), key=lambda s: (-s[0], s[1]))[:k]
                    if len(best_[who]) == k:
                        reach[who] = best_[who][-1][0]
                if len(changed):
                    moved = some[mine[changed]]
                    bound[moved] = np.minimum(bound[moved], bounds(moved))


def _integers(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as Python's whole numbers."""
    return np.array([[math.floor(Fraction(x) * scale) for x in row] for row in v.tolist()], object).reshape(v.shape)


def _wide_search(ids: np.ndarray, whole: np.ndarray, qid, q: np.ndarray, k: int) -> list[tuple[int, int]]:
    few = np.flatnonzero(ids != qid)
    found = zip((whole[few] @ q).tolist() if len(few) else [], ids[few].tolist())
    return heapq.nsmallest(k, found, key=lambda s: (-s[0], s[1]))


def _sortable(score: int) -> bytes:
    """Bytes that order scores beyond 64 bits among each other and around those within, which are all one."""
    if -(1 << 63) <= score < 1 << 63:
        return b"\x01"
    raw = abs(score).to_bytes((score.bit_length() + 7) // 8, "big")
    raw = len(raw).to_bytes(4, "big") + raw
    return b"\x02" + raw if score > 0 else b"\x00" + bytes(255 - b for b in raw)


def search(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", *, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest inner products of every row for which ``is_query`` (on column id) holds."""
    rows = usable(df, key, vector, zero=True)
    kind = rows.schema["id"].dataType.simpleString()
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.floor(x * scale).cast("double") * F.floor(x * scale).cast("double"))
    large = F.exists("v", lambda x: F.abs(x) >= WIDE / scale)
    rows = materialise(rows.select("id", "v", F.monotonically_increasing_id().alias("row"), (large | (norm >= WIDE)).alias("wide")), "vectors")
    found = by_length(rows, lambda part: _search(part, is_query, kind, k, scale))
    if found is None:
        found = df.sparkSession.createDataFrame([], f"length int, query_row bigint, query_id {kind}, vec_id {kind}, score bigint, sort binary")
    return best(found, k, [F.desc("sort"), F.desc("score")])


def _search(rows: DataFrame, is_query: Column, kind: str, k: int, scale: int) -> DataFrame:
    """query_row, query_id, vec_id, score, sort: candidates of rows (row, id, v, wide) of one length."""
    spark = rows.sparkSession
    facts = rows.agg(*(F.count(F.when(c, 1)).alias(n) for n, c in (("n", ~F.col("wide")), ("wide", F.col("wide")), ("q", is_query & ~F.col("wide")), ("qwide", is_query & F.col("wide")))), F.max(F.size("v")).alias("length")).first()
    # Few blocks of many rows leave few results to compare, but every core should have some.
    most = max(BLOCK, min(LARGE, LARGE_BYTES // (8 * facts.length)))
    narrow = [max(1, -(-facts.n // most), min(SPREAD, -(-facts.n // BLOCK))), max(1, -(-facts.q // QUERIES))]
    blocks, qblocks = (a + -(-x // y) for a, x, y in zip(narrow, (facts.wide, facts.qwide), (BLOCK, QUERIES)))

    def deal(seed: int, at: int, count: int) -> Column:
        """Blocks of narrow rows first, then those of wide ones."""
        h = F.xxhash64("row", F.lit(seed))
        return F.when(F.col("wide"), F.lit(at) + F.pmod(h, F.lit(max(1, count - at)))).otherwise(F.pmod(h, F.lit(at))).cast("int")

    few = F.pmod(F.xxhash64("row", F.lit(11)), F.lit(max(1, facts.n // (2 * PILOT)))) == 0
    pilot = rows.where(~F.col("wide") & few).orderBy(F.xxhash64("row"), "row").limit(PILOT).select("id", "v").toArrow()
    pilot_ids = pilot["id"].to_numpy()
    pilot = spark.sparkContext.broadcast((pilot_ids, np.floor(matrix(pilot["v"]) * scale).astype(np.int64)))

    def whole(group: pa.Table) -> np.ndarray:
        v = matrix(group["v"])
        return _integers(v, scale) if group["wide"][0].as_py() else np.floor(v * scale).astype(np.int64)

    def block(group: pa.Table) -> pa.Table:
        x, ids = whole(group), group["id"].to_pylist()
        floors = [None] * len(ids)
        if x.dtype != object:
            pids, px = pilot.value
            for i, (qid, q) in enumerate(zip(ids, x)):
                scores = (px @ q)[pids != qid] if len(px) else px
                floors[i] = int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else None
            x = x.astype(np.min_scalar_type(-1 - int(np.abs(x).max(initial=0))))
        save(folder, str(group["qb"][0].as_py()), (group["row"].to_numpy(), group["id"].to_numpy(), x, floors))
        return pa.table({"qb": group["qb"].slice(0, 1)})

    # The stated query set lies in the shared folder, a file for each block, and meets every block of rows.
    folder = fresh_path(spark, "queries")
    asked = rows.where(is_query).withColumn("qb", deal(7, narrow[1], qblocks)).groupBy("qb").applyInArrow(block, "qb int")
    asked = sorted(r.qb for r in asked.collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches)).sort_by([("id", "ascending"), ("row", "ascending")])
        ids, x = group["id"].to_numpy(), whole(group)
        del group
        tree = Tree.load(ids, x) if x.dtype != object else None
        for qb in asked:
            rows_, qids, q, floors = load(folder, str(qb))
            if tree is not None and q.dtype != object:
                got = tree.search(qids, q.astype(np.int64), k, floors)
            else:
                got = [_wide_search(ids, x.astype(object), qid, one, k) for qid, one in zip(qids, q.astype(object))]
            of = np.repeat(np.arange(len(got)), [len(g) for g in got])
            scores = [s for g in got for s, _ in g]
            sort = [_sortable(s) for s in scores]
            fits = [s if m == b"\x01" else None for s, m in zip(scores, sort)]
            yield pa.RecordBatch.from_arrays([pa.array(rows_[of], pa.int64()), pa.array(qids[of], id_kind), pa.array([v for g in got for _, v in g], id_kind), pa.array(fits, pa.int64()), pa.array(sort, pa.binary())], ["query_row", "query_id", "vec_id", "score", "sort"])

    id_kind = to_arrow_type(rows.schema["id"].dataType)
    dealt = rows.withColumn("b", deal(3, narrow[0], blocks)).repartition(blocks, "b")
    return dealt.groupBy("b").applyInArrow(run, f"query_row bigint, query_id {kind}, vec_id {kind}, score bigint, sort binary")
