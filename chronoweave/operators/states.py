"""From events to intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.model import HOUR, by_time, plus, span
from chronoweave.operators import intervals


def of_type(events: DataFrame, source: str) -> DataFrame:
    return events.where(F.col("type") == source)


def latest_event_to_state(events: DataFrame, equals: str) -> DataFrame:
    """Runs of the value `equals`: from the run's first event to the next other value, the last run to one nanosecond after the last event."""
    order, every = by_time(), Window.partitionBy("timeline_id")
    value = F.coalesce("value", F.lit(""))
    seen = events.select("timeline_id", "ts_ns", "seq", value.alias("state"), F.lag(value).over(order).alias("_before"), F.max("ts_ns").over(every).alias("_last"))
    runs = seen.where("_before is null or _before <> state")
    ended = runs.select("timeline_id", "state", F.col("ts_ns").alias("start_ns"), F.coalesce(F.lead("ts_ns").over(order), plus(F.col("_last"), 1)).alias("end_ns"))
    return ended.where(F.col("state") == equals)


def has_existed(events: DataFrame, equals: str) -> DataFrame:
    """From the first event of value `equals` to an hour after the last event of any value."""
    seen = events.groupBy("timeline_id").agg(F.min(F.when(F.col("value") == equals, F.col("ts_ns"))).alias("start_ns"), plus(F.max("ts_ns"), HOUR).alias("end_ns"))
    return intervals.as_bool(seen.where("start_ns is not null"))


def has_existed_within(events: DataFrame, equals: str, window_ns: int) -> DataFrame:
    """The window after each event of value `equals`, merged."""
    hits = events.where(F.col("value") == equals).select("timeline_id", F.col("ts_ns").alias("start_ns"), plus(F.col("ts_ns"), window_ns).alias("end_ns"))
    return intervals.as_bool(intervals.islands(hits))


def state_to_bool(states: DataFrame) -> DataFrame:
    return intervals.as_bool(states)


def longer_than(states: DataFrame, least_ns: int) -> DataFrame:
    """Intervals of at least the duration, as they are."""
    return states.where(span(F.col("start_ns"), F.col("end_ns")) >= least_ns)
