"""An event store on Parquet: raw JSON with its timeline, type, instant and arrival order as columns, partitioned by day and batch.

Type, instant and timeline are physical columns, so filters on them reach the scan, and the JSON of events that they
leave out isn't read; the day prunes partitions. Events are as they came: none is dropped as a repeat, and late ones are
as good as others, as every query sorts. Only a batch that is written again under its own name takes the place of what
it wrote before.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import json_events
from chronoweave.functions.json_events import Classifier
from chronoweave.model import slice_of

SCHEMA = "timeline_id string, seq bigint, ts_ns bigint, type string, json string, day date, batch string"
#: The batch of rows that are simply appended.
APPENDED = "appended"
DAY_NS = 86400 * 10**9


class EventStore:
    def __init__(self, spark: SparkSession, path: str, classifier: Classifier | None = None):
        self.spark, self.path, self.classifier = spark, path, classifier or Classifier()

    # --- writing

    def rows(self, raw: DataFrame) -> DataFrame:
        """raw (timeline_id, json, seq) with the columns that the store filters by. What isn't a JSON object is kept, without a type, and never read as an event."""
        v = F.when(F.col("json").rlike(json_events.OBJECT), F.try_parse_json("json"))
        read = raw.select("timeline_id", F.col("seq").cast("long").alias("seq"), "json", F.explode(F.array(v)).alias("v"))
        kind = F.when(F.col("v").isNotNull(), json_events.kind(F.col("v")))
        return read.select("timeline_id", "seq", json_events.event_time(F.col("v")).alias("ts_ns"), kind.alias("type"), "json").withColumn("day", day_of(F.col("ts_ns")))

    def append(self, raw: DataFrame, batch: str = "") -> None:
        """Write raw (timeline_id, json, seq). With the name of a batch, whatever an earlier try of that batch wrote is replaced.

        Rows are dealt by day in parts of AQE's advisory size: few files a day, and no task with a whole day.
        """
        out = self.rows(raw).withColumn("batch", F.lit(batch or APPENDED)).hint("rebalance", "day").write.partitionBy("day", "batch")
        if batch:
            out.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)
        else:
            out.mode("append").parquet(self.path)

    def compact_to(self, path: str) -> EventStore:
        """A copy of the store in few files a day, each sorted by timeline, as one batch: for stores that many small batches made."""
        out = self.raw().withColumn("batch", F.lit(APPENDED)).hint("rebalance", "day").sortWithinPartitions("day", "timeline_id", "ts_ns", "seq")
        out.write.partitionBy("day", "batch").mode("overwrite").parquet(path)
        return EventStore(self.spark, path, self.classifier)

    def ingest(self, timeline_id: str, events: Iterable[Any]) -> int:
        """Append events given as objects or JSON texts; returns how many. None at all is an error."""
        texts = [e if isinstance(e, str) else json.dumps(e) for e in events]
        if not texts:
            raise ValueError("no events provided")
        first = time.time_ns()
        data = [(timeline_id, t, first + i) for i, t in enumerate(texts)]
        self.append(self.spark.createDataFrame(data, "timeline_id string, json string, seq long"))
        return len(texts)

    # --- reading

    def raw(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], SCHEMA)
            raise

    def timelines(self, time_range: tuple[int, int] | None = None) -> DataFrame:
        """The ids that have events (within time_range), without reading any JSON."""
        rows = self.raw().where("type is not null")
        return (within(rows, time_range) if time_range else rows).select("timeline_id").distinct()

    def load(self, timeline_id: str = "", time_range: tuple[int, int] | None = None, filters: dict[str, Any] | None = None, now_ns: int | None = None) -> DataFrame:
        """Classified events of one timeline, or of all.

        time_range: nanoseconds, both ends included; events without a usable time are out of any range, and without a
        range they are at now_ns. filters: equalities of top-level keys, all of which must hold; nothing matching
        means nothing found.
        """
        rows = self.raw()
        if timeline_id:
            rows = rows.where(F.col("timeline_id") == timeline_id)
        if time_range:
            rows = within(rows, time_range)
        events = self.classifier.stored(rows, now_ns if now_ns is not None else time.time_ns())
        return events.where(json_events.matches(F.col("attrs"), filters)) if filters else events


def within(rows: DataFrame, time_range: tuple[int, int]) -> DataFrame:
    lo, hi = time_range
    return rows.where(F.col("ts_ns").between(lo, hi) & F.col("day").between(day_of(F.lit(lo)), day_of(F.lit(hi))))


def day_of(ts_ns) -> Any:
    """The UTC day; the first of 1970 for events without a time."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.coalesce(slice_of(ts_ns, DAY_NS), F.lit(0)).cast("int"))
