"""Frames and their columns.

Every frame carries timeline_id, so one plan answers all ids at once. Instants are BIGINT nanoseconds since 1970 UTC:
interval tails of one nanosecond don't fit a TIMESTAMP.

* events: timeline_id, ts_ns, seq, type, value, attrs (VARIANT)
* state intervals: timeline_id, state, start_ns, end_ns
* bool intervals: timeline_id, value BOOLEAN, start_ns, end_ns
* numeric intervals: timeline_id, value DOUBLE, start_ns, end_ns
* prices: timeline_id, ts_ns, seq, value DOUBLE, volume DOUBLE, symbol

(ts_ns, seq) orders the rows of a timeline; seq breaks ties.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

SECOND = 1_000_000_000
MINUTE, HOUR, DAY = 60 * SECOND, 3600 * SECOND, 24 * 3600 * SECOND


def by_time() -> WindowSpec:
    return Window.partitionBy("timeline_id").orderBy("ts_ns", "seq")


@dataclass
class Track:
    """A frame with its kind: state, bool, numeric, metric, aggregate or scalar."""

    kind: str
    df: DataFrame

    @property
    def unit(self) -> str:
        return {"state": "intervals", "bool": "boolean_intervals", "scalar": "seconds"}.get(self.kind, "")


@dataclass
class QueryResult:
    df: DataFrame | None
    unit: str = ""
    kind: str = ""
    metadata: dict[str, Any] = field(default_factory=dict)
    events: DataFrame | None = None

    def count_events(self) -> int:
        """How many events the result is of: a job of its own, run when first asked for and then kept as eventCount."""
        if "eventCount" not in self.metadata:
            self.metadata["eventCount"] = self.events.count() if self.events is not None else 0
        return self.metadata["eventCount"]


#: The last instant, and the longest span, that a BIGINT of nanoseconds holds.
MOST = 2**63 - 1


def plus(ts: Column, delta_ns: int) -> Column:
    """ts + delta_ns, or the last (first) instant where that lies beyond it."""
    return F.coalesce(F.try_add(ts, F.lit(delta_ns)), F.when(ts.isNotNull(), F.lit(MOST if delta_ns > 0 else -MOST)))


def span(start: Column, end: Column) -> Column:
    """end - start, or the longest span where that is longer: it takes instants of several centuries."""
    return F.coalesce(F.try_subtract(end, start), F.when(start.isNotNull() & end.isNotNull(), F.lit(MOST)))


def slice_of(ts: Column, size: int | Column) -> Column:
    """floor(ts / size) for BIGINT nanoseconds, in whole numbers: a DOUBLE can't tell instants less than 256 ns apart."""
    size = size if isinstance(size, Column) else F.lit(size)
    return F.call_function("div", ts, size) - F.when(ts % size < 0, 1).otherwise(0)


def ns(ts) -> Any:
    """Nanoseconds of a TIMESTAMP or TIMESTAMP_NTZ column (the latter read as UTC, if the session is)."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp")) * 1000
