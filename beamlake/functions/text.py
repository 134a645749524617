"""Durations, time stamps, file names and small JSON checks of commands."""

from __future__ import annotations

import datetime as dt
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nanoseconds of each unit of a duration.
_UNITS = {"ns": 1, "us": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "min": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9}
_PART = re.compile(r"\s*(\d+(?:\.\d+)?)\s*(ns|us|ms|min|s|m|h|d)")


def duration_ns(text: str) -> int:
    """'5s', '2m', '1h 30m', '250ms' in nanoseconds."""
    at, total, text = 0, 0, text.strip()
    while at < len(text):
        m = _PART.match(text, at)
        if not m:
            raise ValueError(f"no duration: {text!r}")
        whole, _, part = m[1].partition(".")
        total += int(whole) * _UNITS[m[2]] + (int(part) * _UNITS[m[2]] // 10 ** len(part) if part else 0)
        at = m.end()
    if not text:
        raise ValueError("no duration: ''")
    return total


def rfc3339_ns(text: str) -> int:
    """Nanoseconds since the epoch of a time stamp with an offset or Z; up to nine digits of a second count."""
    m = re.fullmatch(r"(\d{4}-\d\d-\d\d)[Tt ](\d\d:\d\d:\d\d)(?:\.(\d{1,9}))?(Z|z|[+-]\d\d:\d\d)", text.strip())
    if not m:
        raise ValueError(f"no RFC 3339 time: {text!r}")
    at = dt.datetime.fromisoformat(f"{m[1]}T{m[2]}{'+00:00' if m[4] in 'Zz' else m[4]}")
    return int(at.timestamp()) * 10**9 + int((m[3] or "0").ljust(9, "0"))


def rfc3339(ns: Column) -> Column:
    """Time stamp in UTC with nanoseconds, from nanoseconds since the epoch; the session's time zone does not matter."""
    div = lambda a, b: F.call_function("div", a, F.lit(b))
    second = div(ns - F.pmod(ns, F.lit(10**9)), 10**9)
    rest = F.pmod(second, F.lit(86400))
    days = div(second - rest, 86400).cast("int")
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    clock = F.concat_ws(":", two(rest / 3600), two(F.pmod(rest, F.lit(3600)) / 60), two(F.pmod(rest, F.lit(60))))
    return F.concat(F.date_format(F.date_from_unix_date(days), "yyyy-MM-dd"), F.lit("T"), clock, F.lit("."), F.lpad(F.pmod(ns, F.lit(10**9)).cast("string"), 9, "0"), F.lit("Z"))


def clean_name(name: Column) -> Column:
    """A name as part of a path: characters that file systems refuse become underscores; dots alone or nothing become one too."""
    out = F.regexp_replace(name, r'[/\\?<>:*|"\x00-\x1f]', "_")
    return F.when(out.rlike(r"^\.*$"), "_").otherwise(out)


def specification_problems(text: str | None, required: dict[str, type] | None = None) -> list[str]:
    """What is wrong with a sensor's JSON specification: not JSON, not an object, or fields missing or of another type."""
    if text is None:
        return []
    try:
        found = json.loads(text)
    except json.JSONDecodeError as e:
        return [f"not JSON: {e.msg}"]
    if not isinstance(found, dict):
        return ["not an object"]
    return [f"{k}: {'missing' if k not in found else 'not ' + t.__name__}" for k, t in (required or {}).items() if not isinstance(found.get(k), t)]
