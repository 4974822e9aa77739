"""Connected components of a link table, with nothing of it on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import discard, row_count, small_side, stored

#: Rows that may be broadcast (about 40 bytes each).
BROADCAST_ROWS = 100_000


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, label), the smallest node of each component. Rounds of taking the
    least label among neighbours and of following labels of labels, until none
    changes; every round's labels are a written table."""
    edges = stored(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    n = row_count(labels)
    while n:
        near = edges.join(small_side(labels.withColumnRenamed("node", "b"), n, BROADCAST_ROWS), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = stored(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "labels")
        up = step.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = step.join(small_side(up, n, BROADCAST_ROWS), "label", "left").select("node", "old", F.least("label", F.coalesce("above", "label")).alias("label"))
        jumped = stored(jumped, "labels")
        discard(labels, step)
        labels = jumped.select("node", "label")
        if not jumped.filter("label <> old").take(1):
            break
    discard(edges)
    return labels
