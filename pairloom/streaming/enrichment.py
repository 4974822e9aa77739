"""Enrichment of a stream of similarity rows. The position is an integer axis, so windows
are ordinary keys; state is one row for each window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pairloom.operators.aggregates import enrichment
from pairloom.operators.rows import load_pairs


def start_enrichment(rows: DataFrame, path: str, checkpoint: str, threshold: float = 0.999, **trigger) -> StreamingQuery:
    """Keeps path/<batch> at the counts of the windows that each micro-batch changed."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return enrichment(load_pairs(rows), threshold).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()
