"""Windows in time: sliding, tumbling and session windows, and rows within one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.functions.durations import parse_duration
from chronoweave.model import MOST, plus, slice_of, span


@dataclass(frozen=True)
class WindowSpec:
    """A window by strings, as queries give them."""

    kind: str
    size_ns: int
    slide_ns: int = 0
    timeout_ns: int = 0

    @classmethod
    def parse(cls, kind: str, size: str, slide: str = "", timeout: str = "", lenient: bool = False) -> WindowSpec:
        """size is required of every kind; a bad duration is an error."""
        if not size:
            raise ValueError("window size is required")
        return cls(kind, *(parse_duration(x, lenient) if x else 0 for x in (size, slide, timeout)))


def sliding_windows(spark: SparkSession, start_ns: int, end_ns: int, size_ns: int, slide_ns: int) -> DataFrame:
    """(start_ns, end_ns) of windows that start every slide from start, cut at end."""
    if slide_ns <= 0 or size_ns <= 0:
        raise ValueError("window size and slide must be positive")
    n = max(0, -(-(end_ns - start_ns) // slide_ns))
    return spark.range(n).select((F.lit(start_ns) + F.col("id") * slide_ns).alias("start_ns")).select("start_ns", F.least(F.col("start_ns") + size_ns, F.lit(end_ns)).alias("end_ns"))


def tumbling_windows(spark: SparkSession, start_ns: int, end_ns: int, size_ns: int) -> DataFrame:
    return sliding_windows(spark, start_ns, end_ns, size_ns, size_ns)


def in_tumbling(rows: DataFrame, size_ns: int, origin_ns: int = 0) -> DataFrame:
    """rows with the [start_ns, end_ns) of their tumbling window, by arithmetic: no join."""
    past = F.pmod(F.pmod(F.col("ts_ns"), F.lit(size_ns)) - origin_ns % size_ns, F.lit(size_ns))
    return rows.withColumn("start_ns", F.coalesce(F.try_subtract("ts_ns", past), F.lit(-MOST))).withColumn("end_ns", plus(F.col("start_ns"), size_ns))


def in_sliding(rows: DataFrame, size_ns: int, slide_ns: int, origin_ns: int = 0) -> DataFrame:
    """rows, once for each sliding window (starts at origin plus multiples of slide, none before origin) that they are in."""
    last = slice_of(F.col("ts_ns") - origin_ns, slide_ns)
    first = F.greatest(slice_of(F.col("ts_ns") - origin_ns - size_ns, slide_ns) + 1, F.lit(0).cast("long"))
    out = rows.where(F.col("ts_ns") >= origin_ns).withColumn("_k", F.explode(F.when(first <= last, F.sequence(first, last))))
    return out.withColumn("start_ns", F.lit(origin_ns) + F.col("_k") * slide_ns).withColumn("end_ns", F.col("start_ns") + size_ns).drop("_k")


def sessions(rows: DataFrame, timeout_ns: int) -> DataFrame:
    """Sessions of each timeline: a gap over the timeout starts a new one; it ends a timeout after its last row."""
    order = Window.partitionBy("timeline_id").orderBy("ts_ns")
    before = F.lag("ts_ns").over(order)
    fresh = rows.select("timeline_id", "ts_ns", F.when(span(before, F.col("ts_ns")) > timeout_ns, 1).otherwise(0).alias("_new"))
    numbered = fresh.withColumn("session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("timeline_id", "session").agg(F.min("ts_ns").alias("start_ns"), plus(F.max("ts_ns"), timeout_ns).alias("end_ns"), F.count("*").alias("n_events"))


def within(rows: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """Rows of [start, end)."""
    return rows.where((F.col("ts_ns") >= start_ns) & (F.col("ts_ns") < end_ns))


def instants(rows: DataFrame) -> DataFrame:
    return rows.select("timeline_id", "ts_ns")


def ohlc(prices: DataFrame, size_ns: int, origin_ns: int = 0) -> DataFrame:
    """Bars of prices per tumbling window: open, high, low, close, volume, stamped with the window's start."""
    order = F.struct("ts_ns", "seq")
    bars = in_tumbling(prices, size_ns, origin_ns).groupBy("timeline_id", F.col("start_ns")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.sum("volume").alias("volume"),
    )
    return bars.withColumnRenamed("start_ns", "ts_ns")


def top_k(rows: DataFrame, by: str, k: int, *keys: str) -> DataFrame:
    """The k rows of largest `by` for each of keys (whole timelines by default); ties by instant."""
    order = Window.partitionBy(*(keys or ("timeline_id",))).orderBy(F.desc(by), *[c for c in ("ts_ns", "seq") if c in rows.columns])
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def on_weekdays(rows: DataFrame, *days: int) -> DataFrame:
    """Rows of the given days of the week in UTC, Monday is 1."""
    return rows.where((F.pmod(slice_of(F.col("ts_ns"), 86400 * 10**9) + 3, F.lit(7)) + 1).isin(*days))
