"""Connected components by label propagation with pointer jumping, all in Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import materialise


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable from each id of ``edges`` (a, b). Ids without an edge have no row.

    A round takes the least label among a node's neighbours, then jumps to that label's own
    label, so paths shorten by halves. Labels are written to the shared folder every round and only sink, so the rounds end.
    """
    both = materialise(edges.select(F.col("a").alias("s"), F.col("b").alias("d")).union(edges.select("b", "a")).distinct(), "edges")
    labels = materialise(both.groupBy("s").agg(F.least(F.min("d"), F.col("s")).alias("comp")).withColumnRenamed("s", "id"), "labels")
    while True:
        near = both.join(labels, both.s == labels.id).groupBy("d").agg(F.min("comp").alias("near"))
        lower = labels.join(near, labels.id == near.d, "left").select("id", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("id").alias("j"), F.col("comp").alias("far"))
        after = materialise(lower.join(jump, lower.comp == jump.j, "left").select("id", "was", F.least("comp", "far").alias("comp")), "labels")
        labels = after.select("id", "comp")
        if after.where("was <> comp").limit(1).count() == 0:
            return labels
