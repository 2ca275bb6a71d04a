"""Streaming ingestion into a store, and the aggregates that a stream can keep.

Ingestion appends micro-batches; its checkpoint takes the place of any restart logic. Algebra on history needs all of a
timeline's events, so it is asked of the store; sessions, windows and first occurrences are kept on the stream itself,
with a watermark for how late events may come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chronoweave.sources.store import EventStore

#: A micro-batch is due after this time; sources take the row limit as an option of their own (see also batches.MicroBatcher).
TRIGGER = "5 seconds"
#: Bits of seq that number the rows of a batch.
BATCH_BITS = 36


def numbered(batch: DataFrame, first: int) -> DataFrame:
    """batch with seq: first and on, by partition and place in it, without gaps. Takes one count of its partitions."""
    part = F.spark_partition_id()
    sizes = sorted((r["p"], r["count"]) for r in batch.groupBy(part.alias("p")).count().collect())
    offsets, at = [], first
    for p, n in sizes:
        offsets += [F.lit(p), F.lit(at)]
        at += n
    if not offsets:
        return batch.withColumn("seq", F.lit(first))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return batch.withColumn("seq", F.element_at(F.create_map(*offsets), part) + place)


def ingest_stream(raw: DataFrame, store: EventStore, checkpoint: str, trigger: str | None = TRIGGER, available_now: bool = False, name: str = "stream") -> StreamingQuery:
    """Append a stream of raw (timeline_id, json) rows to the store. Rows keep their order within a batch by seq.

    A batch is written under its own name, and one that is tried again replaces what it wrote before, whole or in part:
    each is stored once, and no history is read for that. Streams into the same store need different names.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            store.append(numbered(batch, batch_id << BATCH_BITS).select("timeline_id", "json", "seq"), f"{name}-{batch_id}")
        finally:
            batch.unpersist()

    out = raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out.trigger(processingTime=trigger or TRIGGER)).start()


def timed(events: DataFrame, delay: str) -> DataFrame:
    """Events (with ts_ns) with a TIMESTAMP column ts and a watermark on it."""
    return events.withColumn("ts", F.timestamp_micros(F.expr("ts_ns div 1000"))).withWatermark("ts", delay)


def stream_sessions(events: DataFrame, timeout: str, delay: str) -> DataFrame:
    """Sessions by timeline: a gap over timeout ends one."""
    out = timed(events, delay).groupBy("timeline_id", F.session_window("ts", timeout).alias("w")).agg(F.count("*").alias("n_events"))
    return out.select("timeline_id", "w.start", "w.end", "n_events")


def stream_windows(prices: DataFrame, size: str, slide: str, delay: str) -> DataFrame:
    """Sum, average and count of value by timeline and window."""
    out = timed(prices, delay).groupBy("timeline_id", F.window("ts", size, slide).alias("w")).agg(F.sum("value").alias("sum"), F.avg("value").alias("avg"), F.count("*").alias("count"))
    return out.select("timeline_id", "w.start", "w.end", "sum", "avg", "count")


def stream_first_seen(events: DataFrame, equals: str) -> DataFrame:
    """When each timeline first had the value, and its last event; for update or complete output."""
    return events.groupBy("timeline_id").agg(F.min(F.when(F.col("value") == equals, F.col("ts_ns"))).alias("first_ns"), F.max("ts_ns").alias("last_ns"))
