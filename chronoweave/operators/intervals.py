"""The algebra of intervals: merge, intersection, union, gaps and complement, by sweeps over window functions.

All sweeps shuffle once, on timeline_id. AND and OR first merge each input, so what the sweep carries is bounded by the
disjoint intervals of a timeline, not by its events.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.model import slice_of

BOOL = "timeline_id string, value boolean, start_ns bigint, end_ns bigint"


def true_only(df: DataFrame) -> DataFrame:
    return df.where("value").select("timeline_id", "start_ns", "end_ns")


def islands(df: DataFrame, *keys: str) -> DataFrame:
    """Unions of touching or overlapping [start_ns, end_ns) for each of keys."""
    keys = keys or ("timeline_id",)
    order = Window.partitionBy(*keys).orderBy("start_ns", "end_ns")
    before = F.max("end_ns").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = df.select(*keys, "start_ns", "end_ns", F.when(F.col("start_ns") <= before, 0).otherwise(1).alias("_new"))
    grouped = fresh.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "_island").agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns")).drop("_island")


def sliced_islands(df: DataFrame, slice_ns: int, *keys: str) -> DataFrame:
    """islands() for timelines with very many intervals: merged within slices of time first, so that one hot timeline is many tasks' work."""
    keys = keys or ("timeline_id",)
    local = islands(df.withColumn("_slice", slice_of(F.col("start_ns"), slice_ns)), *keys, "_slice")
    return islands(local, *keys)


def as_bool(df: DataFrame, value: bool = True) -> DataFrame:
    return df.select("timeline_id", F.lit(value).alias("value"), "start_ns", "end_ns")


def merge(df: DataFrame) -> DataFrame:
    """True intervals, merged; false ones say nothing and go."""
    return as_bool(islands(true_only(df)))


def covered(tagged: DataFrame, n: int, *keys: str) -> DataFrame:
    """Where n inputs are true at once. tagged: keys, start_ns, end_ns, each input already merged."""
    keys = keys or ("timeline_id",)
    steps = tagged.select(*keys, F.explode(F.array(F.struct(F.col("start_ns").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_ns").alias("t"), F.lit(-1).alias("d")))).alias("e"))
    order = Window.partitionBy(*keys).orderBy("t")
    sums = steps.groupBy(*keys, F.col("e.t").alias("t")).agg(F.sum("e.d").alias("d"))
    depth = sums.select(*keys, F.col("t").alias("start_ns"), F.lead("t").over(order).alias("end_ns"), F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_depth"))
    return islands(depth.where(F.col("_depth") == n).select(*keys, "start_ns", "end_ns"), *keys)


def and_(inputs: Sequence[DataFrame]) -> DataFrame:
    """Instants at which all inputs are true. One input is returned as it is; none can't be: see the planner."""
    if len(inputs) == 1:
        return inputs[0]
    tagged = reduce(DataFrame.unionByName, [islands(true_only(x).withColumn("_input", F.lit(i)), "timeline_id", "_input") for i, x in enumerate(inputs)])
    return as_bool(covered(tagged.drop("_input"), len(inputs)))


def or_(inputs: Sequence[DataFrame]) -> DataFrame:
    """Instants at which some input is true. One input is returned as it is."""
    if len(inputs) == 1:
        return inputs[0]
    return as_bool(islands(reduce(DataFrame.unionByName, map(true_only, inputs))))


def not_(df: DataFrame) -> DataFrame:
    """The gaps between true intervals as false intervals, over the span of all intervals. It never yields true time; see complement()."""
    every = Window.partitionBy("timeline_id")
    order = every.orderBy("start_ns", "end_ns")
    spans = df.select("timeline_id", "value", "start_ns", "end_ns", F.min("start_ns").over(every).alias("_lo"), F.max("end_ns").over(every).alias("_hi"))
    # the cursor is the end of the last true interval, in order
    trues = spans.where("value").withColumns({"_cursor": F.coalesce(F.lag("end_ns").over(order), F.col("_lo")), "_last": F.lead("end_ns").over(order).isNull()})
    gaps = trues.select("timeline_id", F.explode(F.array(F.struct(F.col("_cursor").alias("s"), F.col("start_ns").alias("e")), F.when(F.col("_last"), F.struct(F.col("end_ns").alias("s"), F.col("_hi").alias("e"))))).alias("g"))
    none = spans.groupBy("timeline_id").agg(F.max("value").alias("any"), F.min("_lo").alias("s"), F.max("_hi").alias("e")).where("not any")
    out = gaps.where("g is not null").select("timeline_id", "g.s", "g.e").unionByName(none.select("timeline_id", "s", "e")).where("s < e")
    return out.select("timeline_id", F.lit(False).alias("value"), F.col("s").alias("start_ns"), F.col("e").alias("end_ns"))


def complement(df: DataFrame, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """True where df is not, within [start_ns, end_ns) or else the span of each timeline's own intervals (false ones count for the span)."""
    spans = df.groupBy("timeline_id").agg(F.min("start_ns").alias("lo"), F.max("end_ns").alias("hi"))
    lo, hi = (F.lit(v).cast("long") if v is not None else F.col(c) for v, c in ((start_ns, "lo"), (end_ns, "hi")))
    spans = spans.select("timeline_id", lo.alias("lo"), hi.alias("hi"))
    cut = islands(true_only(df)).join(spans, "timeline_id", "right")
    order = Window.partitionBy("timeline_id").orderBy("start_ns")
    within = cut.where("start_ns is null or (end_ns > lo and start_ns < hi)").unionByName(spans.selectExpr("timeline_id", "hi as start_ns", "hi as end_ns", "lo", "hi"))
    gap = within.select("timeline_id", F.greatest(F.coalesce(F.lag("end_ns").over(order), F.col("lo")), F.col("lo")).alias("start_ns"), F.least(F.col("start_ns"), F.col("hi")).alias("end_ns"))
    return as_bool(gap.where("start_ns < end_ns"))
