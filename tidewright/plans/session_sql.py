"""Queries of sessions and of aggregates over runs of a season, with their SQL."""

import pandas as pd
from pyspark.sql import functions as F

from ..functions.chunks import chunked
from ..functions.win import lag
from ..operators import sessions
from .feature_sql import Steps, even
from .registry import BARS, E, dv, lg, query, rl, sh, since

WIDTHS, LEAST = (168, 720), 20


def score(x: str, over: str) -> str:
    """An expanding z-score with at least LEAST values."""
    return f"coalesce(CASE WHEN count({x}) {over} >= {LEAST} AND stddev_samp({x}) {over} >= 1e-12 THEN ({x} - avg({x}) {over}) / stddev_samp({x}) {over} END, 0.0)"


# extremes so far

_steps = Steps(BARS, sh("high low close"))
_steps.add(ath=f"max(high) {E}", atl=f"min(low) {E}")
_steps.add(to_ath=even(dv("ath - close", "close"), 4), to_atl=even(dv("close - atl", "close"), 4))
_steps.add(
    since_ath=f"coalesce({since('high >= ath')}, count(*) OVER (PARTITION BY symbol))",
    since_atl=f"coalesce({since('low <= atl')}, count(*) OVER (PARTITION BY symbol))",
)
_steps.add(**{f"{k}_mean_{w}": rl("avg", k, w) for k in ("to_ath", "to_atl") for w in WIDTHS})
_steps.add(**{f"{k}_mean_{w}_z{LEAST}": score(f"{k}_mean_{w}", E) for k in ("to_ath", "to_atl") for w in WIDTHS})
_scores = [f"{k}_mean_{w}_z{LEAST}" for k in ("to_ath", "to_atl") for w in WIDTHS]
query(
    "ath_atl",
    sessions.extremes,
    _steps.sql(["ath", "atl", "to_ath", "to_atl", "since_ath", "since_atl", *_scores], {"since_ath", "since_atl"}),
)

# ranges of sessions on bars

INSIDE = {"us": "hour(ts) >= 14 AND hour(ts) < 21", "asia": "(hour(ts) >= 22 OR hour(ts) < 7)", "london": "hour(ts) >= 8 AND hour(ts) < 16", "day": "true"}
DATE = {k: "ts::DATE" for k in INSIDE} | {"asia": "CASE WHEN hour(ts) < 7 THEN ts::DATE - 1 ELSE ts::DATE END"}
ENDS = {"us": "date::TIMESTAMP + INTERVAL 21 HOUR", "asia": "date::TIMESTAMP + INTERVAL 31 HOUR", "london": "date::TIMESTAMP + INTERVAL 16 HOUR", "day": "date::TIMESTAMP + INTERVAL 24 HOUR"}


def completed(name: str) -> str:
    """Of session name on every bar: prices of the last one that ended."""
    ended = f"SELECT *, {ENDS[name]} AS ends FROM (SELECT symbol, {DATE[name]} AS date, arg_min(open, ts) AS o, max(high) AS h, min(low) AS l, arg_max(close, ts) AS c FROM bars WHERE {INSIDE[name]} GROUP BY 1, 2)"
    return f"SELECT b.symbol, b.ts, e.o, e.h, e.l, e.c FROM bars b ASOF LEFT JOIN ({ended}) e ON b.symbol = e.symbol AND b.ts >= e.ends"


def developing(name: str) -> str:
    """Of session name on every bar in it: prices of its bars before."""
    over = "OVER (PARTITION BY symbol, date ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    inside = f"SELECT symbol, ts, first_value(open) {over} AS o, max(high) {over} AS h, min(low) {over} AS l, last_value(close) {over} AS c FROM (SELECT *, {DATE[name]} AS date FROM bars WHERE {INSIDE[name]})"
    return f"SELECT b.symbol, b.ts, e.o, e.h, e.l, e.c FROM bars b LEFT JOIN ({inside}) e ON b.symbol = e.symbol AND b.ts = e.ts"


UPPER, LOWER = "(h - greatest(o, c))", "(least(o, c) - l)"
FIGURES = {
    "high": "h",
    "low": "l",
    "range": "h - l",
    "range_pct": even(dv("h - l", "l"), 4),
    "body": "abs(c - o)",
    "body_pct": even(dv("abs(c - o)", "o"), 4),
    "upper_wick": UPPER,
    "lower_wick": LOWER,
    "wick_ratio": f"CASE WHEN {UPPER} + {LOWER} > 0 THEN {even(f'{UPPER} / ({UPPER} + {LOWER})', 4)} WHEN {UPPER} + {LOWER} IS NOT NULL THEN 0.0 END",
}


def figures(prices) -> str:
    """All sessions side by side, with the scores of the means of their shares over the rows that have them."""
    parts, columns, joins = [BARS], [], []
    for k in INSIDE:
        parts.append(f"{k}_p AS (SELECT symbol, ts, {', '.join(f'{v} AS {n}' for n, v in FIGURES.items())} FROM ({prices(k)}))")
        means = ", ".join(f"{rl('avg', m, w)} AS {m}_mean_{w}" for m in ("range_pct", "body_pct") for w in WIDTHS)
        parts.append(f"{k}_m AS (SELECT symbol, ts, {means} FROM {k}_p WHERE range_pct IS NOT NULL)")
        scored = [f"{m}_mean_{w}" for m in ("range_pct", "body_pct") for w in WIDTHS]
        parts.append(f"{k}_z AS (SELECT symbol, ts, {', '.join(f'{score(n, E)} AS {n}_z{LEAST}' for n in scored)} FROM {k}_m)")
        columns += [f"round({k}_p.{n}, 6) AS {k}_{n}" for n in FIGURES] + [f"round(coalesce({k}_z.{n}_z{LEAST}, 0.0), 6) AS {k}_{n}_z{LEAST}" for n in scored]
        joins.append(f"JOIN {k}_p ON b.symbol = {k}_p.symbol AND b.ts = {k}_p.ts LEFT JOIN {k}_z ON b.symbol = {k}_z.symbol AND b.ts = {k}_z.ts")
    return f"WITH {', '.join(parts)} SELECT b.symbol, b.ts, {', '.join(columns)} FROM bars b {' '.join(joins)}"


query("session_figures", sessions.session_figures, figures(completed))
query("session_figures_developing", lambda b: sessions.session_figures(b, "developing"), figures(developing))

# ranges of each day's sessions

for _name, (_start, _end) in sessions.DAILY.items():
    _day = f"g AS (SELECT symbol, ts::DATE AS date, arg_min(open, ts) AS o, max(high) AS h, min(low) AS l, arg_max(close, ts) AS c FROM bars WHERE hour(ts) >= {_start} AND hour(ts) < {_end} GROUP BY 1, 2)"
    _shown = {"open": "o", "high": "h", "low": "l", "close": "c", "range": "h - l", "range_pct": dv("h - l", "o"), "body": "abs(c - o)", "body_pct": dv("abs(c - o)", "o"), "upper": UPPER, "lower": LOWER, "wick_ratio": f"{UPPER} / ({LOWER} + 1e-10::DOUBLE)"}
    query(
        "session_ranges" if _name == "asia" else f"session_ranges_{_name}",
        lambda b, name=_name: sessions.daily_ranges(b, name),
        f"WITH {BARS}, {_day} SELECT symbol, date, " + ", ".join(f"{v} AS {k}" for k, v in _shown.items()) + " FROM g",
        exact=True,
    )

# users' aggregates over runs of a season: Spark's own, and one in pandas

def season():
    """Quarters of the day; none in the evening."""
    return F.when(F.hour("ts") < 18, F.floor(F.hour("ts") / 6).cast("int"))


SEASON_SQL = "CASE WHEN hour(ts) < 18 THEN hour(ts) // 6 END"


def middle(x: pd.Series) -> float:
    """Mean of the least and the largest value, as an aggregate of a user's own."""
    return (x.min() + x.max()) / 2 if len(x.dropna()) else None


def _of_runs(mode: str):
    def make(bars):
        before = chunked(bars.select("symbol", "ts", "quote_volume"), lambda b: b.withColumn("x", lag("quote_volume")), 1)
        each = {"total": F.sum("x"), "top": F.max("x"), "middle": F.pandas_udf(middle, "double")("x")}
        return sessions.over_runs(before, season(), each, mode).select("symbol", "ts", *each)

    return make


def _runs_sql(mode: str) -> str:
    steps = Steps(BARS, f"s AS (SELECT symbol, ts, {lg('quote_volume')} AS x, {SEASON_SQL} AS season FROM bars)")
    steps.add(fresh=f"coalesce(season <> {lg('season')}, season IS NOT NULL)").add(n=f"sum(fresh::INTEGER) {E}").add(run="CASE WHEN season IS NOT NULL THEN n END").add(last="max(run) OVER (PARTITION BY symbol)")
    each = {"total": "sum(x) {o}", "top": "max(x) {o}", "middle": "(min(x) {o} + max(x) {o}) / 2"}
    every = "OVER (PARTITION BY symbol, run)"
    so_far = "OVER (PARTITION BY symbol, run ORDER BY ts ROWS UNBOUNDED PRECEDING)"
    over, known, scale = {
        "whole": (every, "run < last", "1"),
        "developing": (so_far, "run IS NOT NULL", "1"),
        "projected": (so_far, "run IS NOT NULL", f"(count(*) {every} / (count(*) {so_far})::DOUBLE)"),
    }[mode]
    return steps.add(**{k: f"CASE WHEN {known} THEN ({v.format(o=over)}) * {scale} END" for k, v in each.items()}).sql(list(each))


for _mode in sessions.MODES:
    query(f"season_runs_{_mode}", _of_runs(_mode), _runs_sql(_mode))
