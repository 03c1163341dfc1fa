"""Times, durations and half-open ranges, for the driver side of a query."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

_UNITS = {"d": 86400.0, "h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "µs": 1e-6, "ns": 1e-9}
_PART = re.compile(r"(\d+(?:\.\d+)?)(ms|us|µs|ns|d|h|m|s)")
_LAYOUTS = ("%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%dT%H:%M", "%Y-%m-%d")


def parse_duration(text: str) -> timedelta:
    """``1d2h3m4s``, ``500ms``; the whole text must be consumed."""
    at, total = 0, 0.0
    for m in _PART.finditer(text):
        if m.start() != at:
            break
        total, at = total + float(m[1]) * _UNITS[m[2]], m.end()
    if not text or at != len(text):
        raise ValueError(f"not a duration: {text!r}")
    return timedelta(seconds=total)


def parse_time(text: str) -> datetime:
    """Epoch seconds, RFC 3339 with or without fractions, or a date with or without a time (UTC)."""
    text = text.strip()
    if re.fullmatch(r"\d+", text):
        return datetime.fromtimestamp(int(text), timezone.utc)
    if re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)", text):
        return datetime.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", text)).astimezone(timezone.utc)
    for layout in _LAYOUTS:
        try:
            return datetime.strptime(text, layout).replace(tzinfo=timezone.utc)
        except ValueError:
            continue
    raise ValueError(f"not a time: {text!r}")


def resolve_range(start: str = "", end: str = "", duration: str = "", now: datetime | None = None, ago_as_end: bool = False) -> tuple[datetime, datetime]:
    """Start and end from any two of start, end and duration; ``end`` may be a duration ago."""
    now = now or datetime.now(timezone.utc)
    if start and end and duration:
        raise ValueError("give two of start, end and duration")
    last = (now - parse_duration(end) if ago_as_end else parse_time(end)) if end else None
    first = parse_time(start) if start else None
    if duration:
        span = parse_duration(duration)
        if first is not None:
            last = first + span
        else:
            last = last or now
            first = last - span
    last = last or now
    if first is None:
        raise ValueError("no start and no duration")
    if first >= last:
        raise ValueError("start is not before end")
    if first > now:
        raise ValueError("start lies in the future")
    return first, min(last, now)
