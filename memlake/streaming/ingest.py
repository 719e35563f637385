"""Streams of incoming records and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from memlake.sources.store import MEMORY_KEYS, Store, memory_rules, remember


def ingest(spark: SparkSession, source: str, schema: T.StructType, store: Store, checkpoint: str) -> StreamingQuery:
    """Adds the rows of JSON files that appear under `source` to the store's memories, one version for each micro-batch.

    A batch that runs again after a failure changes nothing: rows whose fingerprint the scope holds are only touched.
    """

    def add(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            records = store.read("memories")
            store.write("memories", remember(records, batch, F.current_timestamp()), MEMORY_KEYS, memory_rules())

    rows = spark.readStream.schema(schema).json(source)
    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) over tumbling windows of event time; rows later than `late` drop out on a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    counted = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "total")
