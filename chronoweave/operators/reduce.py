"""From intervals to durations. Scalars have one row per timeline of `universe`, 0.0 where nothing is true."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.model import SECOND, span


def length() -> Column:
    return span(F.col("start_ns"), F.col("end_ns"))


def over(universe: DataFrame, found: DataFrame) -> DataFrame:
    return universe.join(found, "timeline_id", "left").select("timeline_id", F.coalesce("value", F.lit(0.0)).alias("value"))


def duration_where(df: DataFrame) -> DataFrame:
    """Seconds of the true intervals, summed without merging."""
    total = F.sum(length().cast("decimal(20,0)")).cast("double")  # overlapping intervals may add up to more than a BIGINT holds
    return df.where("value").groupBy("timeline_id").agg((total / SECOND).alias("value"))


def longest_true(df: DataFrame, least_ns: int = 0) -> DataFrame:
    """Seconds of the longest true interval of at least least_ns."""
    return df.where("value").where(length() >= least_ns).groupBy("timeline_id").agg((F.max(length()) / SECOND).alias("value"))


def duration_in_current_state(states: DataFrame) -> DataFrame:
    """Each interval with its seconds as value."""
    return states.select("timeline_id", (length() / SECOND).alias("value"), "start_ns", "end_ns")
