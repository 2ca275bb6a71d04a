"""Impossible travel: transactions of one customer at places too far apart for the time between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.model import HOUR, MINUTE, plus, slice_of, span
from chronoweave.operators import intervals

EARTH_KM = 6371.0
PLACE = "city string, state string, lat double, lng double, type string"
#: Where the reader puts a text that doesn't fit.
BAD = "_unread"


@dataclass(frozen=True)
class FraudConfig:
    """Limits of possible travel; walking and driving speeds play no part in it."""

    flying_kmh: float = 950.0
    tolerance: float = 1.1
    near_km: float = 500.0
    same_place_km: float = 0.1
    least_overlaps: int = 2


def places(events: DataFrame) -> DataFrame:
    """Events with the place in their value: a JSON object of PLACE's types, or else the value is a city and the sale in store."""
    # a generator, so that the text is read once and not for every column and filter
    read = events.select("timeline_id", "ts_ns", "value", F.explode(F.array(F.from_json("value", f"{PLACE}, {BAD} string", {"columnNameOfCorruptRecord": BAD}))).alias("p"))
    good = F.col("value").rlike(r"^\s*\{") & F.col(f"p.{BAD}").isNull()
    text = lambda k, default="": F.when(good, F.coalesce(f"p.{k}", F.lit(""))).otherwise(default)
    number = lambda k: F.when(good, F.coalesce(f"p.{k}", F.lit(0.0))).otherwise(0.0)
    out = read.select("timeline_id", "ts_ns", text("city", F.col("value")).alias("city"), text("state").alias("state"), text("type", F.lit("in-store")).alias("sale"), number("lat").alias("lat"), number("lng").alias("lng"))
    return out.withColumn("place", F.lower(F.concat_ws(",", "city", "state", "sale")))


def distance_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance by the haversine formula."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


def possible(a: str, b: str, config: FraudConfig) -> Column:
    """Whether one can have been at places a and b at their times."""
    c = lambda side, name: F.col(f"{side}.{name}")
    online = [c(s, "sale") == "online" for s in (a, b)]
    km = distance_km(c(a, "lat"), c(a, "lng"), c(b, "lat"), c(b, "lng"))
    gap = span(F.least(c(a, "ts_ns"), c(b, "ts_ns")), F.greatest(c(a, "ts_ns"), c(b, "ts_ns"))) / HOUR
    travel = F.when(km < config.near_km, True).when(gap == 0, km < config.same_place_km).otherwise(km / gap <= config.flying_kmh * config.tolerance)
    return F.when(online[0] & online[1], True).when(online[0] | online[1], False).otherwise(travel)


def impossible_travel(events: DataFrame, window_ns: int = 30 * MINUTE, config: FraudConfig | None = None) -> DataFrame:
    """True intervals, per customer (timeline), in which two suspicious pairs of places or more were active.

    A pair of places is suspicious if some two events there within the window can't both be. The join on customer is
    narrowed to neighbouring slices of time as long as the window, so it doesn't pair a customer's whole history.
    """
    config = config or FraudConfig()
    seen = places(events)
    own = slice_of(F.col("ts_ns"), window_ns)
    a = seen.withColumn("slice", own).alias("a")
    b = seen.withColumn("slice", F.explode(F.array(own - 1, own, own + 1))).alias("b")
    close = (F.col("a.timeline_id") == F.col("b.timeline_id")) & (F.col("a.slice") == F.col("b.slice")) & (F.col("a.place") < F.col("b.place")) & (F.abs(F.col("a.ts_ns") - F.col("b.ts_ns")) <= window_ns)
    pairs = a.join(b, close).where(~possible("a", "b", config)).select("a.timeline_id", F.col("a.place").alias("p1"), F.col("b.place").alias("p2")).distinct()
    sides = pairs.select("timeline_id", "p1", "p2", F.explode(F.array("p1", "p2")).alias("place"))
    spans = seen.select("timeline_id", "place", F.col("ts_ns").alias("start_ns"), plus(F.col("ts_ns"), window_ns).alias("end_ns"))
    active = intervals.islands(spans, "timeline_id", "place")
    both = intervals.covered(sides.join(active, ["timeline_id", "place"]), 2, "timeline_id", "p1", "p2")
    nth = F.dense_rank().over(Window.partitionBy("timeline_id").orderBy("p1", "p2"))
    enough = both.withColumn("_nth", nth).withColumn("_pairs", F.max("_nth").over(Window.partitionBy("timeline_id"))).where(F.col("_pairs") >= config.least_overlaps)
    return intervals.as_bool(intervals.islands(enough.select("timeline_id", "start_ns", "end_ns")))


def detect(events: DataFrame, window_ns: int = 30 * MINUTE, config: FraudConfig | None = None) -> DataFrame:
    """One row per customer: fraud_detected, its intervals, processed_events."""
    found = impossible_travel(events, window_ns, config).groupBy("timeline_id").agg(F.sort_array(F.collect_list(F.struct("start_ns", "end_ns"))).alias("intervals"))
    return events.groupBy("timeline_id").agg(F.count("*").alias("processed_events")).join(found, "timeline_id", "left").select("timeline_id", F.col("intervals").isNotNull().alias("fraud_detected"), "intervals", "processed_events")
