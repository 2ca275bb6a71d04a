"""Query specifications: operations by name over events, as dataclasses and as JSON."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any


class SpecError(ValueError):
    pass


@dataclass(frozen=True)
class Op:
    id: str
    op: str
    source: str = ""
    equals: str = ""
    window: str = ""
    of: Op | None = None
    condition_all: tuple[str, ...] = ()
    condition_any: tuple[str, ...] = ()
    params: dict[str, Any] = field(default_factory=dict, hash=False)

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> Op:
        if not isinstance(d, dict):
            raise SpecError("an operation must be an object")
        text = {k: d.get(k) or "" for k in ("id", "op", "source", "equals", "window")}
        if bad := [k for k, v in text.items() if not isinstance(v, str)]:
            raise SpecError(f"{bad[0]} must be a string")
        return cls(**text, of=cls.from_dict(d["of"]) if d.get("of") else None, condition_all=tuple(d.get("conditionAll") or ()), condition_any=tuple(d.get("conditionAny") or ()), params=dict(d.get("params") or {}))

    def to_dict(self) -> dict[str, Any]:
        out: dict[str, Any] = {"id": self.id, "op": self.op}
        for key, value in (("source", self.source), ("equals", self.equals), ("window", self.window), ("of", self.of and self.of.to_dict()), ("conditionAll", list(self.condition_all)), ("conditionAny", list(self.condition_any)), ("params", self.params)):
            if value:
                out[key] = value
        return out


RFC3339 = re.compile(r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(?:\.(\d+))?(Z|[+-]\d{2}:\d{2})")


def instant_ns(text: str) -> int:
    """Nanoseconds of an RFC 3339 instant."""
    m = RFC3339.fullmatch(text) if isinstance(text, str) else None
    if not m:
        raise SpecError(f"not an instant: {text!r}")
    try:
        whole = datetime.fromisoformat(m[1] + ("+00:00" if m[3] == "Z" else m[3]))
    except ValueError as e:
        raise SpecError(f"not an instant: {text!r}") from e
    return int((whole - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds()) * 10**9 + int((m[2] or "0").ljust(9, "0")[:9])


@dataclass(frozen=True)
class TimeRange:
    start: str
    end: str

    @property
    def bounds(self) -> tuple[int, int]:
        return instant_ns(self.start), instant_ns(self.end)


@dataclass
class QuerySpec:
    """timeline_id "" stands for all timelines."""

    timeline_id: str = ""
    operations: tuple[Op, ...] = ()
    filters: dict[str, Any] = field(default_factory=dict)
    time_range: TimeRange | None = None
    processing_mode: str = ""

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> QuerySpec:
        if not isinstance(d, dict):
            raise SpecError("a query must be an object")
        span = d.get("time_range")
        out = cls(d.get("timeline_id") or "", tuple(map(Op.from_dict, d.get("operations") or ())), dict(d.get("filters") or {}), TimeRange(span.get("start"), span.get("end")) if span else None, d.get("processing_mode") or "")
        if out.time_range:
            _ = out.time_range.bounds
        return out

    def to_dict(self) -> dict[str, Any]:
        out: dict[str, Any] = {"timeline_id": self.timeline_id, "operations": [o.to_dict() for o in self.operations]}
        if self.filters:
            out["filters"] = self.filters
        if self.time_range:
            out["time_range"] = {"start": self.time_range.start, "end": self.time_range.end}
        if self.processing_mode:
            out["processing_mode"] = self.processing_mode
        return out


@dataclass
class ReplaySpec:
    """A query over stored history. chunk_size is read and has no effect: partitions are Spark's business."""

    timeline_id: str
    query: QuerySpec
    chunk_size: int = 0
    processing_mode: str = ""

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> ReplaySpec:
        if not isinstance(d, dict):
            raise SpecError("a replay must be an object")
        return cls(d.get("timeline_id") or "", QuerySpec.from_dict(d.get("query") or {}), int(d.get("chunk_size") or 0), d.get("processing_mode") or "")


def query_from_json(text: str) -> QuerySpec:
    try:
        return QuerySpec.from_dict(json.loads(text))
    except json.JSONDecodeError as e:
        raise SpecError(f"not JSON: {e}") from e


def replay_from_json(text: str) -> ReplaySpec:
    try:
        return ReplaySpec.from_dict(json.loads(text))
    except json.JSONDecodeError as e:
        raise SpecError(f"not JSON: {e}") from e
