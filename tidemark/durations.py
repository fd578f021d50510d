"""Durations, time shifts and request times, parsed at plan time."""

from __future__ import annotations

import re
import time

#: Unit spellings and their length in milliseconds (mon is 30 days).
_GO = {"ns": 1e-6, "us": 1e-3, "µs": 1e-3, "μs": 1e-3, "ms": 1.0, "s": 1e3, "m": 6e4, "h": 3.6e6}
_LONG = {
    "d": 864e5, "w": 7 * 864e5, "y": 365 * 864e5, "min": 6e4, "minute": 6e4, "minutes": 6e4, "hour": 3.6e6, "hours": 3.6e6,
    "week": 7 * 864e5, "weeks": 7 * 864e5, "mon": 30 * 864e5,
}


def parse_duration(text: str) -> int:
    """Milliseconds of `90s`, `1h30m`, `7d`, `2weeks`, `1mon`, ...; a plain number has no unit and is an
    error, except `0`. Only the short units combine; `1d12h` is an error."""
    s = text.strip()
    if re.fullmatch(r"[+-]?0+", s):
        return 0
    m = re.fullmatch(r"([+-]?)(\d+(?:\.\d*)?|\.\d+)\s*([A-Za-zµμ]+)", s)
    if m and m[3] in _LONG:
        return round((-1 if m[1] == "-" else 1) * float(m[2]) * _LONG[m[3]])
    sign, rest = (-1, s[1:]) if s[:1] == "-" else (1, s[1:] if s[:1] == "+" else s)
    found = re.findall(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|μs|ms|s|m|h)", rest)
    if not found or "".join(a + b for a, b in found) != rest:
        raise ValueError(f"bad duration: {text!r}")
    return round(sign * sum(float(a) * _GO[b] for a, b in found))


def parse_shift(text: str) -> int:
    """A duration with optional sign; empty is 0."""
    return parse_duration(text) if text.strip() else 0


def parse_time(text: str, now_ms: int | None = None) -> int:
    """`now`, `-<duration>` before now, or epoch seconds; milliseconds."""
    now = int(time.time() * 1000) if now_ms is None else now_ms
    s = text.strip()
    if s in ("", "now"):
        return now
    if s[0] == "-":
        return now + parse_duration(s)
    return int(float(s) * 1000)


def window_points(text: str, step_ms: int, median: bool = False) -> int:
    """Window size in points: a plain integer counts points; a duration is converted, for the mean to
    the points it spans, for the median to one more when it is a whole number of steps."""
    s = text.strip()
    if re.fullmatch(r"[+-]?[1-9]\d*", s):
        return int(s)
    d = parse_duration(s)
    return d // step_ms + 1 if median else (d - 1) // step_ms + 1 if d > 0 else 1
