"""Durations as text, such as 1h30m or 5s: a signed run of decimal numbers with units of ns, us, µs, ms, s, m or h."""

from __future__ import annotations

import re
from decimal import Decimal

UNITS = {"ns": 1, "us": 10**3, "µs": 10**3, "μs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}
LENIENT = {"d": 24 * 3600 * 10**9, "w": 7 * 24 * 3600 * 10**9}
PART = re.compile(r"(\d+\.?\d*|\.\d+)([a-zµμ]+)")
MOST = 2**63 - 1


class DurationError(ValueError):
    pass


def parse_duration(text: str, lenient: bool = False) -> int:
    """Nanoseconds of text. lenient: days (d) and weeks (w) too. Bare 0 is the only number without a unit."""
    units = UNITS | LENIENT if lenient else UNITS
    body = text[1:] if text[:1] in ("+", "-") else text
    if body == "0":
        return 0
    at, total = 0, 0
    while at < len(body):
        m = PART.match(body, at)
        if not m or m[2] not in units:
            raise DurationError(f"invalid duration {text!r}")
        total += int(Decimal(m[1]) * units[m[2]])
        at = m.end()
    if not body or total > MOST:
        raise DurationError(f"invalid duration {text!r}")
    return -total if text[0] == "-" else total


def hours(duration_ns: int) -> float:
    return duration_ns / UNITS["h"]
