"""Micro-batches of events that arrive one by one: written when there are enough of them, or when the first has waited long enough."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from chronoweave.sources.store import EventStore

#: Events in a batch at most, and seconds until one is due.
MOST_EVENTS, MOST_SECONDS = 1000, 5.0


@dataclass(frozen=True)
class Flush:
    """What was written, and why: size, timeout or final."""

    batch: int
    events: int
    reason: str
    seconds: float


class MicroBatcher:
    """Collects events for a store, so that clients that send few at a time don't make a file each.

    An event that is accepted is in memory until its batch is written: close() writes what is left, and a crash loses
    it. A batch whose write fails stays, and is tried again with the next flush.
    """

    def __init__(self, store: EventStore, most_events: int = MOST_EVENTS, most_seconds: float = MOST_SECONDS):
        if most_events < 1 or most_seconds <= 0:
            raise ValueError("a batch must hold an event and wait some time")
        self.store, self.most_events, self.most_seconds = store, most_events, most_seconds
        self.flushes: list[Flush] = []
        self._rows: list[tuple[str, str, int]] = []
        self._lock, self._began = threading.RLock(), 0.0
        self._timer: threading.Timer | None = None

    def add(self, timeline_id: str, events: Iterable[Any]) -> int:
        """Accept events given as objects or JSON texts; returns how many. None at all is an error."""
        texts = [e if isinstance(e, str) else json.dumps(e) for e in events]
        if not texts:
            raise ValueError("no events provided")
        with self._lock:
            first = time.time_ns()
            for i, text in enumerate(texts):
                if not self._rows:
                    self._start()
                self._rows.append((timeline_id, text, first + i))
                if len(self._rows) >= self.most_events:
                    self.flush("size")
        return len(texts)

    def _start(self) -> None:
        self._began = time.monotonic()
        self._timer = threading.Timer(self.most_seconds, self.flush, ("timeout",))
        self._timer.daemon = True
        self._timer.start()

    def flush(self, reason: str = "final") -> None:
        """Write what there is."""
        with self._lock:
            if self._timer:
                self._timer.cancel()
            if not self._rows:
                return
            spark = self.store.spark
            self.store.append(spark.createDataFrame(self._rows, "timeline_id string, json string, seq long"))
            self.flushes.append(Flush(len(self.flushes), len(self._rows), reason, time.monotonic() - self._began))
            self._rows = []

    def close(self) -> None:
        self.flush("final")

    def __enter__(self) -> MicroBatcher:
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()
