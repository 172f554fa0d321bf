"""Streams into an index: each micro-batch is one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..engine import VectorEngine


def last_per_id(rows: DataFrame, order: str | None) -> DataFrame:
    """One row per id, the last by ``order`` (ties: the larger vector)."""
    by = [F.col(order).desc_nulls_last()] if order else []
    w = Window.partitionBy("external_id").orderBy(*by, F.col("vec").desc_nulls_last())
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").select("external_id", "vec")


def stream_into(rows: DataFrame, engine: VectorEngine, checkpoint: str, name: str = "upserts", mode: str = "upsert", order: str | None = None, once: bool = False):
    """Start a streaming query that commits every micro-batch of ``rows``
    (external_id, vec and, if named, ``order``). The batch number is part of
    the commit, so a batch replayed after a failure is not applied twice. Ids
    repeated within a batch count once, the last by ``order``; the first batch
    of an empty index builds it."""

    def apply(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        engine.write(last_per_id(batch, order), mode if engine.has_index else "build", stream=(name, number))

    writer = rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
