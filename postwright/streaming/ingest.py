"""Streaming form of the idempotent append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from postwright.sources.boards import append_new


def ingest_stream(spark: SparkSession, landed: str, schema: str, target: str, checkpoint: str, order: str = "raw_job_id") -> StreamingQuery:
    """Append what lands in ``landed`` (Parquet files of raw rows) to ``target``, each key once.

    State is the target itself: a batch is joined against it, so a batch that is
    replayed after a failure adds nothing, and no state store grows.
    """
    rows = spark.readStream.schema(schema).parquet(landed)

    def write(batch: DataFrame, _: int) -> None:
        append_new(batch, target, order)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
