"""Row and column similarity, unusual rows and principal components of numeric columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .entropy import numeric_columns
from .search import quoted

#: Rows of a block, and block pairs that set the bound on the farthest pairs. Neither changes a result.
BLOCK_ROWS, SEED_PAIRS = 512, 32


def zscores(df: DataFrame, columns: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Nulls become the column's mean, then (x - mean) / population standard deviation (0 for constant columns).

    Means and deviations are one row of constants, found in one pass.
    """
    cols = list(columns or numeric_columns(df))
    row = df.agg(*(f for i, c in enumerate(cols) for f in (F.avg(quoted(c)).alias(f"m{i}"), F.stddev_pop(quoted(c).cast("double")).alias(f"s{i}"), F.count(quoted(c)).alias(f"n{i}"))), F.count("*").alias("n")).first()

    def z(i: int, c: str) -> Column:
        n, mean = row["n"] or 1, row[f"m{i}"]
        # Filling with the mean leaves the sum of squares and enlarges the count.
        sd = (row[f"s{i}"] or 0.0) * (row[f"n{i}"] / n) ** 0.5
        if mean is None or sd == 0:
            return F.lit(0.0).alias(c)
        return ((F.coalesce(quoted(c).cast("double"), F.lit(float(mean))) - F.lit(float(mean))) / F.lit(float(sd))).alias(c)

    return df.select(*map(quoted, keep), *(z(i, c) for i, c in enumerate(cols)))


def column_distances(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column_1, column_2, distance: Euclidean over rows that are standardised across columns; one aggregation for all pairs."""
    cols = list(columns or numeric_columns(df))
    means = df.agg(*(F.avg(quoted(c)).alias(f"m{i}") for i, c in enumerate(cols))).first()
    filled = F.array(*(F.coalesce(quoted(c).cast("double"), F.lit(float(means[f"m{i}"] or 0.0))) for i, c in enumerate(cols)))
    k = float(len(cols))
    rows = df.select(filled.alias("x"))
    rows = rows.withColumn("m", F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / k)
    rows = rows.withColumn("s", F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + (v - F.col("m")) * (v - F.col("m"))) / k))
    rows = rows.select(*((F.when(F.col("s") > 0, (F.col("x")[i] - F.col("m")) / F.col("s")).otherwise(F.lit(0.0))).alias(f"z{i}") for i in range(len(cols))))
    pairs = list(combinations(range(len(cols)), 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "column_1 string, column_2 string, distance double")
    one = rows.agg(*(F.sqrt(F.sum((F.col(f"z{a}") - F.col(f"z{b}")) * (F.col(f"z{a}") - F.col(f"z{b}")))).alias(f"d{a}_{b}") for a, b in pairs))
    return one.select(F.explode(F.array(*(F.struct(F.lit(cols[a]).alias("column_1"), F.lit(cols[b]).alias("column_2"), F.col(f"d{a}_{b}").alias("distance")) for a, b in pairs))).alias("x")).select("x.*")


def _cell(cols: int) -> Column:
    """Place on a Z-order curve of 256 steps a column (the first seven), so that rows of a block lie together."""
    steps = [F.coalesce(F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.nanvl(F.col("z")[j], F.lit(0.0)) + 4) * 32))), F.lit(0)) for j in range(min(cols, 7))]
    code = F.lit(0).cast("long")
    for bit in range(7, -1, -1):
        for s in steps:
            code = F.shiftleft(code, 1) + F.shiftright(s, bit) % 2
    return code


def _blocks(z: DataFrame, kind: str, cols: int, size: int) -> DataFrame:
    """id, least key, keys, values (row by row) and bounding box of runs of rows along the curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                keys = batch.column(0).slice(i, size)
                values = batch.column(1).slice(i, size).flatten().to_numpy(zero_copy_only=False).reshape(len(keys), cols)
                box = [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (values.reshape(-1), values.min(axis=0), values.max(axis=0))]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), *box], ["ks", "zs", "lo", "hi"])

    placed = z.where("k is not null").withColumn("cell", _cell(cols))
    dealt = placed.repartitionByRange("cell", "k").sortWithinPartitions("cell", "k").select("k", "z")
    found = dealt.mapInArrow(run, f"ks array<{kind}>, zs array<double>, lo array<double>, hi array<double>")
    found = found.select(F.monotonically_increasing_id().alias("id"), F.array_min("ks").alias("least"), "*")
    # Cut off here: both sides of the join of blocks have to see the same blocks.
    return found.checkpoint() if found.sparkSession.sparkContext.getCheckpointDir() else found.localCheckpoint()


def _best(pairs: DataFrame, kind: str, cols: int, n: int, farthest: bool) -> DataFrame:
    """row_1, row_2, distance: among the n first of each pair of blocks (i, ks, zs, i2, ks2, zs2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                one = {f: batch.column(f)[r] for f in batch.schema.names}
                ka, kb = one["ks"].as_py(), one["ks2"].as_py()
                a, b = (one[c].values.to_numpy(zero_copy_only=False).reshape(-1, cols) if cols else np.zeros((len(k), 0)) for c, k in (("zs", ka), ("zs2", kb)))
                place = {k: x for x, k in enumerate(sorted({*ka, *kb}))}
                ra, rb = (np.array([place[k] for k in ks], np.int64) for ks in (ka, kb))
                square = np.zeros((len(ka), len(kb)))
                for j in range(cols):
                    square += (a[:, j, None] - b[None, :, j]) ** 2
                within = one["i"].as_py() == one["i2"].as_py()
                x, y = np.nonzero(ra[:, None] < rb[None, :] if within else ra[:, None] != rb[None, :])
                distance = np.sqrt(square[x, y])
                # NaN is the largest of all distances, as in Spark.
                score = np.where(np.isnan(distance), np.inf, distance) * (-1 if farthest else 1)
                if len(score) > n:
                    few = np.nonzero(score <= np.partition(score, n - 1)[n - 1])[0]
                    x, y, distance, score = x[few], y[few], distance[few], score[few]
                low, high = np.minimum(ra[x], rb[y]), np.maximum(ra[x], rb[y])
                first = np.lexsort((high, low, score))[:n]
                names = list(place)
                sides = [pa.array([names[v] for v in side[first].tolist()], batch.schema.field("ks").type.value_type) for side in (low, high)]
                yield pa.RecordBatch.from_arrays([*sides, pa.array(distance[first])], ["row_1", "row_2", "distance"])

    return pairs.mapInArrow(run, f"row_1 {kind}, row_2 {kind}, distance double")


def row_pairs(df: DataFrame, key: str, columns: Sequence[str] | None = None, *, n: int = 5, farthest: bool = False, exact_rows: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """row_1, row_2, distance: the n closest (or farthest) pairs of rows on standardised columns, each pair once.

    Exact at every size: blocks of rows are compared with blocks, and a pair of blocks is left out only where
    its bounding boxes show that it holds none of the n. Ties go by row_1, row_2; rows without a key take no part.
    Only a caller that gives ``exact_rows`` gets, beyond so many rows, close pairs by random-projection
    hashing (approximate, none farther apart than 1.0) and no farthest pairs.
    """
    cols = [c for c in (columns or numeric_columns(df)) if c != key]
    z = zscores(df, cols, [key]).select(quoted(key).alias("k"), F.array(*map(quoted, cols)).cast("array<double>").alias("z"))
    order = [F.desc("distance") if farthest else F.asc("distance"), "row_1", "row_2"]
    if exact_rows is not None and df.count() > exact_rows:
        if farthest:
            raise ValueError(f"farthest pairs need all pairs; at most {exact_rows} rows")
        vectors = z.select("k", array_to_vector("z").alias("v"))
        model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=0.5, numHashTables=4, seed=42).fit(vectors)
        near = model.approxSimilarityJoin(vectors, vectors, 1.0, "distance")
        pairs = near.where(F.col("datasetA.k") < F.col("datasetB.k")).select(F.col("datasetA.k").alias("row_1"), F.col("datasetB.k").alias("row_2"), "distance").distinct()
        return pairs.orderBy(*order).limit(n)

    kind, m = z.schema["k"].dataType.simpleString(), len(cols)
    blocks = _blocks(z, kind, m, block_rows)
    square = F.lit(0.0)
    for j in range(m):
        lo, hi, lo2, hi2 = (F.col(c)[j] for c in ("lo", "hi", "lo2", "hi2"))
        # Rounded as the distances are, operation by operation, so that no pair passes its bound.
        gap = F.greatest(hi2 - lo, hi - lo2) if farthest else F.greatest(F.lit(0.0), lo2 - hi, lo - hi2)
        square = square + gap * gap
    boxes = blocks.select(F.col("id").alias("i"), "least", "lo", "hi")
    others = blocks.select(F.col("id").alias("i2"), F.col("least").alias("least2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    bounds = boxes.join(others, F.col("i") <= F.col("i2")).select("i", "i2", F.least("least", "least2").alias("least"), F.sqrt(square).alias("bound"))
    left = blocks.select(F.col("id").alias("i"), "ks", "zs")
    right = blocks.select(F.col("id").alias("i2"), F.col("ks").alias("ks2"), F.col("zs").alias("zs2"))

    def best(chosen: DataFrame) -> DataFrame:
        full = chosen.select("i", "i2").join(left, "i").join(right, "i2").select("i", "ks", "zs", "i2", "ks2", "zs2")
        return _best(full, kind, m, n, farthest).orderBy(*order).limit(n)

    seed = bounds.orderBy(F.desc("bound"), "i", "i2").limit(SEED_PAIRS) if farthest else bounds.where("i = i2")
    found = best(seed).collect()
    if len(found) == n:
        last = found[-1]
        limit = F.lit(last.distance)
        closer = F.col("bound") > limit if farthest else F.col("bound") < limit
        bounds = bounds.where(closer | F.isnan("bound") | ((F.col("bound") == limit) & (F.col("least") <= F.lit(last.row_1))))
    return best(bounds)


def unusual_rows(df: DataFrame, key: str, columns: Sequence[str] | None = None, *, limit: int = 3) -> DataFrame:
    """key, score (sum of |z|) and the columns with |z| over ``limit``, highest first."""
    cols = [c for c in (columns or numeric_columns(df)) if c != key]
    z = zscores(df, cols, [key])
    parts = F.array(*(F.struct(F.lit(c).alias("c"), F.abs(quoted(c)).alias("z")) for c in cols))
    return z.select(quoted(key), F.aggregate(parts, F.lit(0.0), lambda a, v: a + v["z"]).alias("score"), F.transform(F.filter(parts, lambda v: v["z"] > limit), lambda v: v["c"]).alias("extreme")).orderBy(F.desc("score"), quoted(key))


def pca(df: DataFrame, columns: Sequence[str] | None = None, components: int = 3) -> dict:
    """Explained and cumulative variance, loadings and a function that adds the scores.

    The covariance of all pairs is one aggregation; its eigenvectors are found on the driver (the
    matrix is columns x columns). A component's largest loading is positive.
    """
    cols = list(columns or numeric_columns(df))
    z = zscores(df, cols)
    pairs = [(a, b) for a in range(len(cols)) for b in range(a, len(cols))]
    row = z.agg(*(F.avg(quoted(cols[a]) * quoted(cols[b])).alias(f"c{a}_{b}") for a, b in pairs)).first()
    m = np.zeros((len(cols), len(cols)))
    for a, b in pairs:
        m[a, b] = m[b, a] = row[f"c{a}_{b}"] or 0.0
    values, vectors = np.linalg.eigh(m)
    order = np.argsort(-values)[: min(components, len(cols))]
    vectors = vectors[:, order] * np.sign(vectors[np.abs(vectors[:, order]).argmax(0), order])
    share = values[order] / values.sum() if values.sum() > 0 else np.zeros(len(order))
    spark = df.sparkSession
    variance = spark.createDataFrame([(i + 1, float(s), float(c)) for i, (s, c) in enumerate(zip(share, share.cumsum()))], "component int, explained double, cumulative double")
    loadings = spark.createDataFrame([(i + 1, c, float(vectors[j, i])) for i in range(len(order)) for j, c in enumerate(cols)], "component int, column string, loading double")

    def scores(keep: Sequence[str] = ()) -> DataFrame:
        rows = zscores(df, cols, [k for k in keep if k not in cols])
        sums = []
        for i in range(len(order)):
            total = F.lit(0.0)
            for j, c in enumerate(cols):
                total = total + quoted(c) * F.lit(float(vectors[j, i]))
            sums.append(total.alias(f"pc{i + 1}"))
        return rows.select(*(quoted(k) for k in keep if k not in cols), *sums)

    return {"variance": variance, "loadings": loadings, "scores": scores}


def embedding_clusters(df: DataFrame, key: str, vector: str, clusters: int = 8) -> DataFrame:
    """key, cluster: vectors grouped by bisecting k-means (cosine distance), top down."""
    from pyspark.ml.clustering import BisectingKMeans

    rows = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(quoted(key).alias("k"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = BisectingKMeans(k=clusters, seed=42, distanceMeasure="cosine").fit(rows)
    return model.transform(rows).select(F.col("k").alias(key), F.col("prediction").alias("cluster"))
