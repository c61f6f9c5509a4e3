"""Periods such as '4h': their length in seconds, their kind, the windows that fit them, and how many rows a span should have."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}  # fixed values
CATEGORICAL = ("session", "hour", "day", "week", "month", "quarter", "year", "season")
#: The windows that each kind of period can have.
WINDOWS = {
    "fixed": ("discrete", "continuous"),
    "numeric": ("discrete", "continuous"),
    "categorical": ("discrete", "developing"),
    "alltime": ("expanding",),
}


def seconds(period: str) -> int:
    """'4h' to 14400. The unit is one of s, m, h, d and w, in either case."""
    found = re.fullmatch(r"\s*(\d+)\s*([a-zA-Z])\s*", period or "")
    unit = found and found[2].lower()
    if not found or unit not in UNIT_SECONDS or int(found[1]) < 1:
        raise ValueError(f"{period!r} isn't a number and one of {', '.join(UNIT_SECONDS)}")
    return int(found[1]) * UNIT_SECONDS[unit]


def kind(period: str | int) -> str:
    """fixed ('4h'), numeric (24 rows), categorical ('session_asia', 'hour') or alltime."""
    text = str(period).strip().lower()
    if text in ("alltime", "all", "expanding"):
        return "alltime"
    if text.isdigit():
        return "numeric"
    if any(text == c or text.startswith(f"{c}_") for c in CATEGORICAL):
        return "categorical"
    seconds(text)
    return "fixed"


def check_window(period: str | int, window: str) -> None:
    allowed = WINDOWS[kind(period)]
    if window not in allowed:
        raise ValueError(f"a {kind(period)} period takes {' or '.join(allowed)} windows, not {window}")


def window_rows(period: str, bar: str) -> int:
    """How many bars a fixed period spans; at least one."""
    return max(1, seconds(period) // seconds(bar))


def epoch(ts) -> Column:
    return F.unix_timestamp((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def expected_rows(start, end, bar: str) -> Column:
    """Bars from start to end, both included."""
    return (F.floor((epoch(end) - epoch(start)) / seconds(bar)) + 1).cast("long")
