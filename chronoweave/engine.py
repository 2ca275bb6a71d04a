"""The engine: ingest, query, replay, badges and fraud over a store or any frame of events."""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.json_events import Classifier
from chronoweave.model import MINUTE, MOST, SECOND, QueryResult
from chronoweave.operators import badges, fraud
from chronoweave.plans.planner import process
from chronoweave.plans.spec import QuerySpec, ReplaySpec
from chronoweave.sources.store import EventStore

#: Names of processing modes; all give the same, exact answer, and others count as auto.
MODES = ("single", "concurrent", "auto")


class Engine:
    def __init__(self, spark: SparkSession, path: str, classifier: Classifier | None = None, lenient_durations: bool = False):
        self.spark, self.store, self.lenient = spark, EventStore(spark, path, classifier), lenient_durations

    def ingest(self, timeline_id: str, events: list[Any]) -> int:
        return self.store.ingest(timeline_id, events)

    def query(self, spec: QuerySpec, now_ns: int | None = None) -> QueryResult:
        """A query over one timeline, or all if it names none. Filters are for replays; a query's are noted and not applied."""
        found = self._run(spec.timeline_id, spec, None, now_ns, "query", spec.processing_mode)
        if spec.filters:
            found.metadata["notes"].append("filters apply to replays only")
        return found

    def replay(self, spec: ReplaySpec, now_ns: int | None = None) -> QueryResult:
        """A query over the events that match its filters and time range."""
        return self._run(spec.timeline_id or spec.query.timeline_id, spec.query, spec.query.filters, now_ns, "replay", spec.processing_mode or spec.query.processing_mode)

    def _run(self, timeline_id: str, spec: QuerySpec, filters: dict[str, Any] | None, now_ns: int | None, what: str, mode: str) -> QueryResult:
        span = spec.time_range.bounds if spec.time_range else None
        events = self.store.load(timeline_id, span, filters, now_ns)
        universe = self.spark.range(1).select(F.lit(timeline_id).alias("timeline_id")) if timeline_id else None if filters else self.store.timelines(span)
        out = process(events, spec.operations, universe=universe, lenient_durations=self.lenient)
        out.metadata |= {"run": f"{what}-{timeline_id or 'all'}-{time.time_ns()}", "processingMode": mode if mode in MODES else "auto"}
        return out

    def write(self, result: QueryResult, path: str) -> str:
        """Write a result's rows as Parquet, for results too large to return; gives the path."""
        if result.df is None:
            raise ValueError("the result has no rows")
        result.df.write.mode("overwrite").parquet(path)
        result.metadata["location"] = path
        return path

    def badge(self, badge: str, user_id: str, start_ns: int, end_ns: int) -> DataFrame:
        """One user's badge over a range, with details (seconds reached and required) and metadata (range and number of operations); see badges.evaluate for all users at once."""
        badges.validate(user_id, badge, start_ns, end_ns)
        found = badges.evaluate(self.store.load(user_id, (start_ns, end_ns)), badge, time.time_ns())
        of = badges.BADGES[badge]
        details = F.create_map(F.lit("reached_seconds"), F.col("result"), F.lit("required_seconds"), F.lit(of.required_ns / SECOND))
        about = {"start_ns": start_ns, "end_ns": end_ns, "operations": len(of.ops)}
        return found.withColumns({"details": details, "metadata": F.create_map(*[F.lit(x) for k, v in about.items() for x in (k, str(v))])})

    def fraud(self, events: DataFrame, window_ns: int = 30 * MINUTE) -> DataFrame:
        """Impossible travel of every customer of events; see fraud_of for one customer's report."""
        return fraud.detect(events, window_ns)

    def fraud_of(self, customer_id: str, window_ns: int = 0, start_ns: int | None = None, end_ns: int | None = None) -> dict[str, Any]:
        """The report on one customer's stored transactions: no events are an error, a window of 0 is the usual one."""
        began = time.monotonic()
        span = (-MOST if start_ns is None else start_ns, MOST if end_ns is None else end_ns) if (start_ns, end_ns) != (None, None) else None
        found = self.fraud(self.store.load(customer_id, span), window_ns or 30 * MINUTE).first()
        if found is None:
            raise ValueError(f"no events of customer {customer_id}")
        own = found.asDict(recursive=True)
        return {"customer_id": own.pop("timeline_id"), **own, "start_ns": start_ns, "end_ns": end_ns, "execution_seconds": time.monotonic() - began}


#: Rows of a result that a response holds; more are for write().
MOST_ROWS = 100_000


def as_json(result: QueryResult, timeline_id: str = "", limit: int = MOST_ROWS) -> dict[str, Any]:
    """A result as a response: a number for one timeline's scalar, else rows. With more rows than limit the metadata says that they are truncated."""
    rows = [] if result.df is None else [r.asDict(recursive=True) for r in result.df.limit(limit + 1).collect()]
    result.count_events()
    meta = {k: v for k, v in result.metadata.items() if k != "notes" or v}
    if len(rows) > limit:
        rows, meta["truncated"] = rows[:limit], True
    if result.kind in ("scalar", "none") and timeline_id:
        body: Any = rows[0]["value"] if rows else 0
    else:
        body = rows
    return {"result": body, "unit": result.unit, "metadata": meta}
