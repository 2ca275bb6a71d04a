"""Aggregates of prices: over a timeline, over a trailing window, over given windows.

A trailing window holds the rows j up to i, in (ts_ns, seq) order, with ts_j >= ts_i - w. A RANGE frame on the instant
would also take in later rows of the same instant, so the frame is on a key that tells them apart: twice the instant
plus a fraction that grows with the row's number. A reach of 2 w + 1 on that key takes in all of the instant ts_i - w,
whatever its rows' fractions, and none of the one before.

Timelines are cut into slices of time, each with the last window of the slice before it as a margin, so that a hot
timeline is the work of many tasks. At SLICE windows a slice, few rows are carried twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from chronoweave.model import MOST, SECOND, plus, slice_of, span

#: Aggregates by name, of a value column, an order column and a percentage.
AGGREGATES: dict[str, Callable[[Column, Column, float], Column]] = {
    "sum": lambda v, o, p: F.sum(v),
    "avg": lambda v, o, p: F.avg(v),
    "min": lambda v, o, p: F.min(v),
    "max": lambda v, o, p: F.max(v),
    "count": lambda v, o, p: F.sum(F.when(v.isNotNull(), 1.0).otherwise(0.0)),
    "variance": lambda v, o, p: F.var_pop(v),
    "stddev": lambda v, o, p: F.stddev_pop(v),
    "percentile": lambda v, o, p: F.percentile(v, min(max(p, 0.0), 100.0) / 100),
    "median": lambda v, o, p: F.percentile(v, 0.5),
    "first": lambda v, o, p: F.min_by(v, o),
    "last": lambda v, o, p: F.max_by(v, o),
}


def spec(kind: str, value: Column, percentile: float = 50.0) -> Column:
    if kind not in AGGREGATES:
        raise ValueError(f"unsupported aggregation: {kind}")
    return AGGREGATES[kind](value, F.struct("ts_ns", "seq"), percentile)


def aggregate(prices: DataFrame, kind: str, percentile: float = 50.0) -> DataFrame:
    """One row per timeline: value, count and the last instant."""
    return prices.groupBy("timeline_id").agg(spec(kind, F.col("value"), percentile).alias("value"), F.count("*").alias("count"), F.max("ts_ns").alias("ts_ns")).select("timeline_id", F.lit(kind).alias("agg_type"), "value", "count", "ts_ns")


#: Windows in a slice, unless slice_ns says otherwise.
SLICE = 64
#: The order of rows in a slice, with ties told apart.
KEY = "_key"


def trailing(window_ns: int, *keys: str) -> WindowSpec:
    """The window of w up to each row, on rows that have the key of ties."""
    return Window.partitionBy(*keys).orderBy(KEY).rangeBetween(-min(2 * window_ns + 1, MOST), 0)


def keyed(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with the key of ties: fewer than 10^12 rows share the partition keys."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("ts_ns", "seq"))
    fraction = n.cast("decimal(12,0)") * F.expr("0.000000000001BD")
    return rows.withColumn(KEY, (F.col("ts_ns").cast("decimal(20,0)") * F.expr("2BD") + fraction).cast("decimal(35,12)"))


def sliced(rows: DataFrame, window_ns: int, slice_ns: int | None, compute: Callable[[DataFrame, tuple[str, ...]], DataFrame]) -> DataFrame:
    """compute(rows with the key of ties, partition keys) over slices of timelines with a margin, or whole ones for a slice_ns of 0. compute must pass the column _own on."""
    size = max(slice_ns, window_ns) if slice_ns else min(SLICE * max(window_ns, SECOND), MOST)
    if slice_ns == 0 or size >= MOST // 4:
        return compute(keyed(rows.withColumn("_own", F.lit(True)), "timeline_id"), ("timeline_id",)).drop("_own", KEY)
    own = slice_of(F.col("ts_ns"), size)
    # a row is margin of the next slice only if some window there can reach it
    reach = slice_of(plus(F.col("ts_ns"), window_ns), size)
    spread = rows.withColumn("_slice", F.explode(F.array_distinct(F.array(own, reach)))).withColumn("_own", F.col("_slice") == own)
    return compute(keyed(spread, "timeline_id", "_slice"), ("timeline_id", "_slice")).where("_own").drop("_own", "_slice", KEY)


def moving(prices: DataFrame, kind: str, window_ns: int, percentile: float = 50.0, slice_ns: int | None = None) -> DataFrame:
    """The aggregate over the trailing window of each row: timeline_id, ts_ns, seq, agg_type, value, count."""

    def compute(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        frame = trailing(window_ns, *keys)
        out = {"_v": spec(kind, F.col("value"), percentile).over(frame), "_n": F.count("*").over(frame)}
        return rows.withColumns(out).drop("value").withColumnsRenamed({"_v": "value", "_n": "count"})

    return sliced(prices, window_ns, slice_ns, compute).select("timeline_id", "ts_ns", "seq", F.lit(kind).alias("agg_type"), "value", "count")


def windowed(prices: DataFrame, windows: DataFrame, kind: str, percentile: float = 50.0) -> DataFrame:
    """The aggregate in each of windows (start_ns, end_ns) for each timeline, stamped with the window's end; empty windows have no row.

    Rows meet windows on slices of time as long as the longest window, so the range join is an equality join.
    """
    size = windows.agg(F.max(span(F.col("start_ns"), F.col("end_ns")))).first()[0] or 1
    slices = F.sequence(slice_of(F.col("start_ns"), size), slice_of(F.col("end_ns") - 1, size))
    own = windows.where("start_ns < end_ns").select("start_ns", "end_ns", F.explode(slices).alias("_slice"))
    hit = (F.col("ts_ns") >= F.col("start_ns")) & (F.col("ts_ns") < F.col("end_ns"))
    joined = prices.withColumn("_slice", slice_of(F.col("ts_ns"), size)).join(own, "_slice").where(hit)
    out = joined.groupBy("timeline_id", "start_ns", "end_ns").agg(spec(kind, F.col("value"), percentile).alias("value"), F.count("*").alias("count"))
    return out.select("timeline_id", F.lit(kind).alias("agg_type"), "value", "count", "start_ns", "end_ns", F.col("end_ns").alias("ts_ns"))
