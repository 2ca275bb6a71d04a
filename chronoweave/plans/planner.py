"""Folds a list of operations into lazy DataFrames: one plan for all timelines of the events.

Operations run in order and are found by id; the result is that of the id `result`, else the last. Nested operations
aren't stored. Equal operations are planned once, so Spark can share their exchange.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.durations import parse_duration
from chronoweave.functions.json_events import prices
from chronoweave.model import QueryResult, Track
from chronoweave.operators import aggregates, finance, intervals, reduce, states, windows
from chronoweave.plans.spec import Op, instant_ns


class PlanError(ValueError):
    pass


@dataclass
class Planned:
    track: Track | None
    tracks: dict[str, Track] = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)


class Planner:
    """Plans operations on events: timeline_id, ts_ns, seq, type, value and for price operators attrs.

    universe: ids for which scalars have a row, those of events by default. on_progress: is told of each operation as it
    is planned (operator_started, operator_completed or operator_failed, at the end orchestrator_completed).
    """

    def __init__(self, events: DataFrame, universe: DataFrame | None = None, lenient_durations: bool = False, on_progress: Callable[[dict[str, Any]], None] | None = None):
        self.on_progress = on_progress or (lambda event: None)
        self.events, self.lenient = events, lenient_durations
        self.universe = universe if universe is not None else events.select("timeline_id").distinct()
        self.tracks: dict[str, Track] = {}
        self.made: dict[str, Track] = {}
        self.notes: list[str] = []

    # --- parameters: a value of the wrong type counts as missing

    def text(self, op: Op, name: str, default: str = "") -> str:
        v = op.params.get(name)
        return v if isinstance(v, str) else default

    def number(self, op: Op, name: str, default: float) -> float:
        v = op.params.get(name)
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else default

    def duration(self, text: str) -> int:
        return parse_duration(text, self.lenient)

    def window(self, op: Op, default: str, name: str = "window") -> int:
        return self.duration(self.text(op, name, default))

    # --- inputs

    def of_source(self, op: Op) -> DataFrame:
        return states.of_type(self.events, op.source)

    def priced(self, op: Op) -> DataFrame:
        return prices(self.events, self.text(op, "value_field"))

    def named(self, ids: Sequence[str], take_states: bool) -> list[DataFrame]:
        """Bool tracks by id; unknown ids and other kinds are passed over."""
        out = []
        for i in ids:
            track = self.tracks.get(i)
            if track and track.kind == "bool":
                out.append(track.df)
            elif track and track.kind == "state" and take_states:
                out.append(states.state_to_bool(track.df))
        return out

    def nested(self, op: Op, kind: str) -> DataFrame:
        if op.of is None:
            raise PlanError(f"{op.op} requires 'of'")
        track = self.plan(op.of)
        if track.kind != kind:
            raise PlanError(f"{op.op} requires 'of' to give a {kind} timeline")
        return track.df

    def empty(self) -> DataFrame:
        return self.universe.select("timeline_id", F.lit(True).alias("value"), F.lit(0).cast("long").alias("start_ns"), F.lit(0).cast("long").alias("end_ns")).where("false")

    def scalar(self, df: DataFrame | None) -> Track:
        return Track("scalar", reduce.over(self.universe, df) if df is not None else self.universe.select("timeline_id", F.lit(0.0).alias("value")))

    # --- operations

    def within(self, op: Op) -> Track:
        text = self.text(op, "window")
        if not text and op.window:
            text = op.window
            self.notes.append(f"{op.id}: window read from the operation, not its params")
        if not text:
            raise PlanError("HasExistedWithin requires the window parameter")
        return Track("bool", states.has_existed_within(self.of_source(op), op.equals, self.duration(text)))

    def combined(self, inputs: list[DataFrame], how: Callable[[list[DataFrame]], DataFrame]) -> DataFrame:
        return how(inputs) if inputs else self.empty()

    def duration_where(self, op: Op) -> Track:
        if op.condition_all:
            return self.scalar(reduce.duration_where(self.combined(self.named(op.condition_all, True), intervals.and_)))
        if op.condition_any:
            return self.scalar(reduce.duration_where(self.combined(self.named(op.condition_any, True), intervals.or_)))
        return self.scalar(None)

    def longest(self, op: Op) -> Track:
        source = self.text(op, "sourceOperationId")
        track = self.tracks.get(source)
        if not source or track is None or track.kind != "bool":
            raise PlanError("LongestConsecutiveTrueDuration requires sourceOperationId of a bool timeline")
        least = self.text(op, "duration")
        return self.scalar(reduce.longest_true(track.df, self.duration(least) if least else 0))

    def moving(self, op: Op, kind: str) -> Track:
        return Track("aggregate", aggregates.moving(self.priced(op), kind, self.window(op, "5m"), self.number(op, "percentile", 50.0)))

    def windowed(self, op: Op) -> Track:
        """Windows of `window`, every `slide` (the window's own size by default), from `start` to `end`."""
        size = self.window(op, "5m")
        start, end = (instant_ns(self.text(op, n)) for n in ("start", "end"))
        spans = windows.sliding_windows(self.events.sparkSession, start, end, size, self.window(op, self.text(op, "window", "5m"), "slide"))
        return Track("aggregate", aggregates.windowed(self.priced(op), spans, self.text(op, "aggregation", "avg"), self.number(op, "percentile", 50.0)))

    def exposure(self, op: Op) -> Track:
        """Positions are the events of `source`, prices those of the parameter price_source."""
        position, price = (prices(states.of_type(self.events, t), self.text(op, "value_field")) for t in (op.source, self.text(op, "price_source")))
        return self.metric(finance.position_exposure(position, price))

    def metric(self, df: DataFrame) -> Track:
        return Track("metric", df)

    def dispatch(self) -> dict[str, Callable[[Op], Track]]:
        return {
            "LatestEventToState": lambda o: Track("state", states.latest_event_to_state(self.of_source(o), o.equals)),
            "HasExisted": lambda o: Track("bool", states.has_existed(self.of_source(o), o.equals)),
            "HasExistedWithin": self.within,
            "DurationWhere": self.duration_where,
            "DurationInCurState": lambda o: Track("numeric", reduce.duration_in_current_state(self.nested(o, "state"))),
            "Not": lambda o: Track("bool", intervals.not_(self.nested(o, "bool"))),
            "AND": lambda o: Track("bool", self.combined(self.named(o.condition_all, False), intervals.and_)),
            "OR": lambda o: Track("bool", self.combined(self.named(o.condition_any, False), intervals.or_)),
            "LongestConsecutiveTrueDuration": self.longest,
            "TWAP": lambda o: self.metric(finance.twap(self.priced(o), self.window(o, "5m"))),
            "VWAP": lambda o: self.metric(finance.vwap(self.priced(o), self.window(o, "5m"))),
            "BollingerBands": lambda o: self.metric(finance.bollinger(self.priced(o), self.window(o, "20m"), self.number(o, "multiplier", 2.0))),
            "RSI": lambda o: self.metric(finance.rsi(self.priced(o), self.window(o, "14m"))),
            "MACD": lambda o: self.metric(finance.macd(self.priced(o), *(self.window(o, d, n) for n, d in (("fast_period", "12m"), ("slow_period", "26m"), ("signal_period", "9m"))))),
            "VaR": lambda o: self.metric(finance.value_at_risk(self.priced(o), self.window(o, "720h"), self.number(o, "confidence", 95.0))),
            "Drawdown": lambda o: self.metric(finance.drawdown(self.priced(o))),
            "SharpeRatio": lambda o: self.metric(finance.sharpe(self.priced(o), self.window(o, "720h"), self.number(o, "risk_free_rate", 0.02))),
            "TransactionVelocity": lambda o: self.metric(finance.transaction_velocity(self.priced(o), self.window(o, "1h"))),
            "MovingAverage": lambda o: self.moving(o, "avg"),
            "MovingSum": lambda o: self.moving(o, "sum"),
            "MovingMax": lambda o: self.moving(o, "max"),
            "MovingMin": lambda o: self.moving(o, "min"),
            "MovingCount": lambda o: self.moving(o, "count"),
            "MovingVariance": lambda o: self.moving(o, "variance"),
            "MovingStdDev": lambda o: self.moving(o, "stddev"),
            "MovingPercentile": lambda o: self.moving(o, "percentile"),
            "MovingMedian": lambda o: self.moving(o, "median"),
            "MovingFirst": lambda o: self.moving(o, "first"),
            "MovingLast": lambda o: self.moving(o, "last"),
            "WindowedAggregate": self.windowed,
            "EMA": lambda o: self.metric(finance.ema(self.priced(o), self.window(o, "12m", "period"))),
            "PositionExposure": self.exposure,
            "Percentile": lambda o: Track("aggregate", aggregates.aggregate(self.priced(o), "percentile", self.number(o, "percentile", 50.0))),
            "Complement": lambda o: Track("bool", intervals.complement(self.nested(o, "bool"))),
        }

    def plan(self, op: Op) -> Track:
        known = self.dispatch()
        if op.op not in known:
            raise PlanError(f"unsupported operation: {op.op}")
        key = repr((op.op, op.source, op.equals, op.window, op.of, [id(self.tracks.get(i)) for i in (*op.condition_all, "|", *op.condition_any, self.text(op, "sourceOperationId"))], sorted(op.params.items(), key=str)))
        if key not in self.made:
            self.made[key] = known[op.op](op)
        return self.made[key]

    def tell(self, what: str, done: int, of: int, **more: Any) -> None:
        self.on_progress({"event_type": what, "timestamp": time.time(), "progress_percent": 100.0 * done / max(1, of), **more})

    def run(self, ops: Sequence[Op]) -> Planned:
        last = None
        for n, op in enumerate(ops):
            self.tell("operator_started", n, len(ops), operator_id=op.id)
            try:
                last = self.tracks[op.id] = self.plan(op)
            except Exception as e:
                self.tell("operator_failed", n, len(ops), operator_id=op.id, error=str(e))
                raise
            self.tell("operator_completed", n + 1, len(ops), operator_id=op.id)
        self.tell("orchestrator_completed", 1, 1)
        return Planned(self.tracks.get("result", last), self.tracks, self.notes)


def process(events: DataFrame, ops: Sequence[Op], **options: Any) -> QueryResult:
    """The result of operations on events. Without operations: the number 0 for each timeline, no unit."""
    planner = Planner(events, **options)
    planned = planner.run(ops)
    info = {"operationCount": len(ops), "processedAt": time.time(), "notes": planned.notes}
    if planned.track is None:
        return QueryResult(planner.universe.select("timeline_id", F.lit(0).alias("value")), "", "none", info, events)
    return QueryResult(planned.track.df, planned.track.unit, planned.track.kind, info, events)
