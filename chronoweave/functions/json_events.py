"""Raw JSON to typed events, in one projection over a VARIANT.

Types are strict: a JSON number is no string and the other way round. The first usable of a list of keys wins. Rows
that aren't JSON objects are dropped (so are objects with a key twice, which VARIANT refuses).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.model import SECOND

# The keys that may hold a type, a time and a value, in order.
TYPE_KEYS = ("eventType", "event_type", "type", "action", "event", "messageType")
TIME_KEYS = ("timestamp", "ts", "time", "eventTime", "event_time")
VALUE_KEYS = ("value", "state", "action", "status")
UNKNOWN = "unknown"
#: What a JSON object begins with.
OBJECT = r"^[ \t\n\r]*\{"
RFC3339 = r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})(?:\.(\d+))?(Z|[+-]\d{2}:\d{2})$"


def at(v: Column, key: str) -> Column:
    quoted = key.replace("\\", "\\\\").replace("'", "\\'")
    return F.try_variant_get(v, f"$['{quoted}']", "variant")


def kind_of(v: Column, key: str) -> Column:
    return F.schema_of_variant(at(v, key))


def has(v: Column, key: str) -> Column:
    return at(v, key).isNotNull()


def string_at(v: Column, key: str) -> Column:
    """The key's value if it is a JSON string, else null."""
    return F.when(kind_of(v, key) == "STRING", F.try_variant_get(at(v, key), "$", "string"))


def number_at(v: Column, key: str) -> Column:
    """The key's value as a double if it is a JSON number, else null."""
    return F.when(kind_of(v, key).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), F.try_variant_get(at(v, key), "$", "double"))


def rfc3339_ns(text: Column) -> Column:
    """Nanoseconds of an RFC 3339 instant with a zone; null for anything else, and for instants that a BIGINT can't hold."""
    whole = F.concat_ws("", F.regexp_extract(text, RFC3339, 1), F.lit("T"), F.regexp_extract(text, RFC3339, 2), F.regexp_extract(text, RFC3339, 4))
    seconds = F.unix_seconds(F.try_to_timestamp(F.when(text.rlike(RFC3339), whole)))
    return F.try_add(F.try_multiply(seconds, F.lit(SECOND)), F.rpad(F.regexp_extract(text, RFC3339, 3), 9, "0").try_cast("long"))


def time_at(v: Column, key: str) -> Column:
    unix = number_at(v, key)
    return F.coalesce(rfc3339_ns(string_at(v, key)), F.try_multiply(unix.try_cast("long"), F.lit(SECOND)))


def event_time(v: Column) -> Column:
    """Nanoseconds of the first usable time key, else null."""
    return F.coalesce(*[time_at(v, k) for k in TIME_KEYS])


def event_type(v: Column) -> Column:
    return F.coalesce(*[string_at(v, k) for k in TYPE_KEYS])


def kind(v: Column) -> Column:
    """The event's type, or the name of the unknown one."""
    return F.coalesce(event_type(v), F.lit(UNKNOWN))


def parsed(raw: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` and attrs (a VARIANT) of the rows of raw whose json is an object.

    A generator, so that no later filter or projection reads the text again.
    """
    objects = raw.where(F.col("json").rlike(OBJECT))
    return objects.select(*keep, F.explode(F.array(F.try_parse_json("json"))).alias("attrs")).where("attrs is not null")


def plain_value(v: Column, kind: Column) -> Column:
    """The first string among the value keys, else the type's name."""
    return F.coalesce(*[string_at(v, k) for k in VALUE_KEYS], kind)


def value_of(first: str, second: str) -> Callable[[Column, Column], Column]:
    """The string at `first` (empty if it is there as something else), else the one at `second`, else empty."""
    return lambda v, kind: F.when(has(v, first), F.coalesce(string_at(v, first), F.lit(""))).otherwise(F.coalesce(string_at(v, second), F.lit("")))


class Classifier:
    """The event types that are known, each with how its value is found; others are generic. Users may add types."""

    def __init__(self):
        self.values: dict[str, Callable[[Column, Column], Column]] = {}
        self.fields: dict[str, dict[str, Callable[[Column, str], Column]]] = {}
        self.register("play", fields={"video_id": string_at, "cdn": string_at, "device_type": string_at})
        self.register("seek", fields={"seek_from_time": number_at, "seek_to_time": number_at, "video_id": string_at})
        self.register("rebuffer", fields={"buffer_duration": number_at, "cdn": string_at, "device_type": string_at, "video_id": string_at})
        self.register("playerStateChange", value=value_of("state", "newState"))
        self.register("cdnChange", value=value_of("cdn", "newCDN"))
        self.register("userAction", value=value_of("action", "userAction"))

    def register(self, kind: str, value: Callable[[Column, Column], Column] | None = None, fields: dict[str, Callable[[Column, str], Column]] | None = None) -> Classifier:
        """value(variant, type) gives the event's value; fields are typed columns that only this type fills."""
        self.values[kind] = value or plain_value
        self.fields[kind] = fields or {}
        return self

    def classify(self, raw: DataFrame, now_ns: int | Column, extra: Sequence[str] = ()) -> DataFrame:
        """Events of raw (timeline_id, json, seq): timeline_id, ts_ns, seq, type, value, attrs, has_ts and the typed columns.

        now_ns: the instant for events without a usable time. extra: further columns of raw to keep.
        """
        v = F.col("attrs")
        found = parsed(raw, "timeline_id", "seq", *extra).withColumns({"type": kind(v), "at": event_time(v)})
        return self._typed(found, now_ns, extra)

    def stored(self, rows: DataFrame, now_ns: int | Column, extra: Sequence[str] = ()) -> DataFrame:
        """The same of rows (timeline_id, json, seq, ts_ns, type) whose instant and type are known already.

        Filters on them come before the JSON is read.
        """
        known = rows.where("type is not null").select("timeline_id", "seq", "type", F.col("ts_ns").alias("at"), *extra, F.explode(F.array(F.try_parse_json("json"))).alias("attrs"))
        return self._typed(known, now_ns, extra)

    def _typed(self, found: DataFrame, now_ns: int | Column, extra: Sequence[str]) -> DataFrame:
        """Values and typed columns for (timeline_id, seq, type, at, attrs)."""
        v, own = F.col("attrs"), F.col("type")
        value = plain_value(v, own)
        for name, rule in self.values.items():
            if rule is not plain_value:
                value = F.when(own == name, rule(v, own)).otherwise(value)
        columns: dict[str, list[Column]] = {}
        for name, fields in self.fields.items():
            for key, read in fields.items():
                columns.setdefault(key, []).append(F.when(own == name, read(v, key)))
        now = now_ns if isinstance(now_ns, Column) else F.lit(now_ns)
        at = [F.coalesce("at", now).cast("long").alias("ts_ns"), "seq", "type", value.alias("value"), "attrs", F.col("at").isNotNull().alias("has_ts")]
        return found.select("timeline_id", *at, *[F.coalesce(*c).alias(k) for k, c in columns.items()], *extra)


def matches(v: Column, filters: dict) -> Column:
    """AND of equalities of top-level keys, strict in type; a filter on a missing key fails. Lists and objects compare by their JSON text."""
    out = F.lit(True)
    for key, want in filters.items():
        if isinstance(want, bool):
            one = (kind_of(v, key) == "BOOLEAN") & (F.try_variant_get(at(v, key), "$", "boolean") == want)
        elif isinstance(want, (int, float)):
            one = number_at(v, key) == float(want)
        elif isinstance(want, str):
            one = string_at(v, key) == want
        elif want is None:
            one = kind_of(v, key) == "VOID"
        else:
            import json

            one = F.to_json(at(v, key)) == json.dumps(want, separators=(",", ":"))
        out = out & F.coalesce(one, F.lit(False))
    return out


def prices(events: DataFrame, value_field: str = "") -> DataFrame:
    """Prices of events (with attrs): the value field if it is a number, else 0.0; without a field 1.0 for a non-empty value. Volume is the attribute volume."""
    v = F.col("attrs")
    value = F.coalesce(number_at(v, value_field), F.lit(0.0)) if value_field else F.when(F.col("value") != "", 1.0).otherwise(0.0)
    return events.select("timeline_id", "ts_ns", "seq", value.alias("value"), F.coalesce(number_at(v, "volume"), F.lit(0.0)).alias("volume"), F.lit("").alias("symbol"))


def numeric_intervals(events: DataFrame, value_field: str = "") -> DataFrame:
    """The same values as intervals of no length."""
    return prices(events, value_field).select("timeline_id", "value", F.col("ts_ns").alias("start_ns"), F.col("ts_ns").alias("end_ns"))
