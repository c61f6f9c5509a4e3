"""Sessions: users' aggregates over runs of a season, and the price range of trading sessions on every bar, as completed or as it develops."""

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from ..functions.chunks import chunked, with_z
from ..functions.scans import Extreme, Fill, Sums, doubles, floats, scan
from ..functions.win import lag, roll, shifted

MODES = ("whole", "developing", "projected")

# fixed values: hours of sessions on bars, over midnight where the start is later, and of the sessions of a day
SESSIONS = {"us": (14, 21), "asia": (22, 7), "london": (8, 16), "day": (0, 24)}
DAILY = {"asia": (0, 8), "london": (8, 16), "ny": (16, 24)}

FIGURES = ("high", "low", "range", "range_pct", "body", "body_pct", "upper_wick", "lower_wick", "wick_ratio")


def even(x: Column, digits: int) -> Column:
    """x rounded half to even after scaling, as array libraries round; F.bround looks at the decimal digits of x instead."""
    scale = float(10**digits)
    return F.rint(x * scale) / scale


def numbered_runs(df: DataFrame, season: Column, name: str = "run") -> DataFrame:
    """Add the number of the run of rows with one season that a row is in, from 1 by symbol; NULL, and the end of a run, where the season is NULL.

    Runs are counted in pieces of time; a run that goes on into the next piece keeps its number.
    """
    marked = df.withColumn("_season", season)
    fresh = F.col("_season").isNotNull() & (lag("_season").isNull() | (F.col("_season") != lag("_season")))
    marked = chunked(marked, lambda b: b.withColumn("_fresh", F.coalesce(fresh, F.lit(False)).cast("int")), 1)
    found = scan(marked, [Sums({name: "_fresh"})], name="runs")
    return found.withColumn(name, F.when(F.col("_season").isNotNull(), F.col(name))).drop("_season", "_fresh")


def over_runs(df: DataFrame, season: Column, aggregates: dict[str, Column], mode: str = "developing") -> DataFrame:
    """Add each aggregate over the run of rows with one season that a row is in.

    An aggregate is any column that aggregates: of Spark (F.sum("x")), or of the
    user's own in Arrow or pandas (F.arrow_udf of a grouped-aggregate kind applied
    to columns). Modes:

    - whole: over all rows of the run, on each of them (looks ahead); NULL in a
      symbol's last run, which may go on;
    - developing: over the run's rows up to this one;
    - projected: developing, times the rows of the whole run by the rows so far
      (looks ahead, as it takes the length of the run).

    Rows without season have NULL and end a run. An empty table gives no row. A
    task holds one run, so seasons should change now and then.
    """
    if mode not in MODES:
        raise ValueError(f"{mode!r} is none of {', '.join(MODES)}")
    names = df.columns
    rows = numbered_runs(df, season, "_run")
    # rows without a run are each a partition of their own, so that they never gather in one task
    run = Window.partitionBy("symbol", "_run", F.when(F.col("_run").isNull(), F.col("ts")))
    every = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = F.col("_run").isNotNull()
    if mode == "whole":
        last = rows.groupBy(F.col("symbol").alias("_symbol")).agg(F.max("_run").alias("_last"))
        rows = rows.join(last, F.col("symbol").eqNullSafe(F.col("_symbol")), "left")
        values = {k: F.when(known & (F.col("_run") < F.col("_last")), a.over(every)) for k, a in aggregates.items()}
    else:
        so_far = run.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        scale = F.count(F.lit(1)).over(every) / F.count(F.lit(1)).over(so_far) if mode == "projected" else F.lit(1.0)
        values = {k: F.when(known, a.over(so_far) * scale if mode == "projected" else a.over(so_far)) for k, a in aggregates.items()}
    return rows.select(*names, *[v.alias(k) for k, v in values.items()])


def extremes(bars: DataFrame, widths: tuple[int, ...] = (168, 720), least: int = 20) -> DataFrame:
    """Highest high and lowest low before a bar (ath, atl), how far the close is from them as a share of the close, rows since (the number of all rows before any), z-scores of the distances' means over each width.

    The extremes are carried from piece to piece, so a long history is many tasks.
    """
    s = chunked(bars.select("symbol", "ts", "high", "low", "close"), lambda b: shifted(b, ["high", "low", "close"]), 1)
    s = scan(s, [Extreme("high", "ath", "since_ath"), Extreme("low", "atl", "since_atl", smallest=True)], name="extremes")
    close = F.col("close")
    away = {"to_ath": even(F.try_divide(F.col("ath") - close, close), 4), "to_atl": even(F.try_divide(close - F.col("atl"), close), 4)}
    s = s.select("symbol", "ts", "ath", "atl", *[v.alias(k) for k, v in away.items()], "since_ath", "since_atl")
    means = {f"{k}_mean_{w}": (k, w) for k in away for w in widths}
    s = chunked(s, lambda b: b.withColumns({m: roll(F.avg, k, w) for m, (k, w) in means.items()}), max(widths))
    return with_z(s, list(means), (least,)).drop(*means)


def in_hours(start: int, end: int) -> Column:
    """Whether ts lies in [start, end), over midnight where the start is later."""
    hour = F.hour("ts")
    return ((hour >= start) | (hour < end)) if start > end else (hour >= start) & (hour < end)


def session_date(start: int, end: int) -> Column:
    """The day on which the session that ts lies in began."""
    day = F.to_date("ts")
    return F.when(F.hour("ts") < end, F.date_sub(day, 1)).otherwise(day) if start > end else day


def figures(open_: Column, high: Column, low: Column, close: Column) -> dict[str, Column]:
    """FIGURES of a session: its range and body, also as shares of its low and open, the wicks over and under the body and the upper one's share of both (0 without any)."""
    upper, lower = high - F.greatest(open_, close), F.least(open_, close) - low
    body, both = F.abs(close - open_), upper + lower
    ratio = F.when(both > 0, even(upper / both, 4)).when(both.isNotNull(), 0.0)
    return dict(zip(FIGURES, (high, low, high - low, even(F.try_divide(high - low, low), 4), body, even(F.try_divide(body, open_), 4), upper, lower, ratio)))


def session_bars(bars: DataFrame, hours: tuple[int, int]) -> DataFrame:
    """(symbol, date, open, high, low, close, ends) of each session that has bars."""
    start, end = hours
    g = bars.where(in_hours(start, end)).groupBy("symbol", session_date(start, end).alias("date"))
    g = g.agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"))
    ends = F.date_add("date", 1 if start > end else 0).cast("timestamp_ntz") + F.expr(f"INTERVAL {end} HOUR")
    return g.withColumn("ends", ends)


PRICES = ("open", "high", "low", "close")


@dataclass
class OpenSession:
    """Open, high, low and close of the earlier rows of the session that a row is in, known by a key; NULL at its first row and outside."""

    key: str
    prefix: str
    out: list[StructField] = field(init=False)

    def __post_init__(self):
        self.out = [StructField(f"{self.prefix}{p}", DoubleType()) for p in PRICES]

    def _runs(self, piece):
        key = floats(piece, self.key)
        rows = np.flatnonzero(~np.isnan(key))
        key = key[rows]
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(rows) else []
        prices = [floats(piece, p)[rows] for p in PRICES]
        return rows, [(key[a], [p[a:b] for p in prices], a, b) for a, b in zip(cuts, [*cuts[1:], len(rows)])]

    def summarise(self, piece):
        _, runs = self._runs(piece)
        if not runs:
            return None
        key, (o, h, lo, c), _, _ = runs[-1]
        return key, (o[0], np.fmax.reduce(h), np.fmin.reduce(lo), c[-1]), len(runs) == 1

    def merge(self, earlier, later):
        if earlier is None or later is None:
            return later if earlier is None else earlier
        if not (later[2] and later[0] == earlier[0]):
            return (later[0], later[1], False)
        a, b = earlier[1], later[1]
        return later[0], (a[0], np.fmax(a[1], b[1]), np.fmin(a[2], b[2]), b[3]), earlier[2]

    def apply(self, piece, before, whole):
        rows, runs = self._runs(piece)
        out = np.full((4, len(piece)), np.nan)
        for key, (o, h, lo, c), a, b in runs:
            goes_on = before is not None and before[0] == key
            opened, top, bottom, last = before[1] if goes_on else (o[0], np.nan, np.nan, np.nan)
            at = rows[a:b]
            high, low = np.fmax.accumulate(np.r_[top, h])[:-1], np.fmin.accumulate(np.r_[bottom, lo])[:-1]
            out[0, at] = opened
            out[1, at], out[2, at], out[3, at] = high, low, np.r_[last, c[:-1]]
            if not goes_on:
                out[:, at[0]] = np.nan
        return [doubles(x) for x in out]


def session_prices(bars: DataFrame, mode: str, sessions: dict[str, tuple[int, int]]) -> DataFrame:
    """(symbol, ts, {session}__open, __high, __low, __close) on every bar: of the last session that ended at or before ts (completed), or of the open session's bars before this one (developing)."""
    each = bars.select("symbol", "ts", *PRICES)
    if mode == "developing":
        keys = {f"{k}__key": F.when(in_hours(*h), F.unix_date(session_date(*h))).cast("double") for k, h in sessions.items()}
        return scan(each.withColumns(keys), [OpenSession(f"{k}__key", f"{k}__") for k in sessions], name="open_sessions").drop(*keys, *PRICES)
    columns = [f"{k}__{p}" for k in sessions for p in PRICES]
    none = {c: F.lit(None).cast("double") for c in columns} | {f"{k}__ended": F.lit(False) for k in sessions}
    rows = each.select("symbol", "ts", F.lit(1).alias("_kind"), *[v.alias(c) for c, v in none.items()])
    for k, hours in sessions.items():
        mine = none | {f"{k}__{p}": F.col(p) for p in PRICES} | {f"{k}__ended": F.lit(True)}
        rows = rows.unionByName(session_bars(each, hours).select("symbol", F.col("ends").alias("ts"), F.lit(0).alias("_kind"), *[v.alias(c) for c, v in mine.items()]))
    fills = [Fill(f"{k}__ended", {f"{k}__{p}_of": f"{k}__{p}" for p in PRICES}) for k in sessions]
    found = scan(rows, fills, order=["_kind"], name="ended_sessions").where("_kind = 1")
    return found.select("symbol", "ts", *[F.col(f"{c}_of").alias(c) for c in columns])


def session_figures(bars: DataFrame, mode: str = "completed", sessions: dict[str, tuple[int, int]] | None = None, widths: tuple[int, ...] = (168, 720), least: int = 20) -> DataFrame:
    """FIGURES of trading sessions on every bar, and z-scores of the means of range_pct and body_pct over each width of rows that have them.

    completed: of the last session that ended before or at the bar's time, whatever
    bars are missing since; developing: of the bars of the open session before this
    one, NULL outside of the session and on its first bar. Neither looks ahead. A
    session over midnight belongs to the day on which it began.
    """
    if mode not in ("completed", "developing"):
        raise ValueError(f"{mode!r} is neither completed nor developing")
    sessions = SESSIONS if sessions is None else sessions
    s = session_prices(bars, mode, sessions)
    made = {f"{k}_{n}": v for k in sessions for n, v in figures(*[F.col(f"{k}__{p}") for p in PRICES]).items()}
    s = s.select("symbol", "ts", *[v.alias(n) for n, v in made.items()])
    shares = ("range_pct", "body_pct")
    # the rows of each session are a series of their own, so means and scores of all sessions are one table
    each = s.select("symbol", "ts", F.explode(F.array(*[F.struct(F.lit(k).alias("session"), *[F.col(f"{k}_{m}").alias(m) for m in shares]) for k in sessions])).alias("e"))
    each = each.where("e.range_pct IS NOT NULL").select(F.struct("symbol", "e.session").alias("symbol"), "ts", *[F.col(f"e.{m}").alias(m) for m in shares])
    means = {f"{m}_mean_{w}": (m, w) for m in shares for w in widths}
    each = chunked(each, lambda b: b.withColumns({n: roll(F.avg, m, w) for n, (m, w) in means.items()}), max(widths))
    each = with_z(each, list(means), (least,))
    scores = [f"{n}_z{least}" for n in means]
    wide = each.groupBy(F.col("symbol.symbol").alias("_symbol"), F.col("ts").alias("_ts")).agg(*[F.max(F.when(F.col("symbol.session") == k, F.col(n))).alias(f"{k}_{n}") for k in sessions for n in scores])
    joined = s.join(wide, F.col("symbol").eqNullSafe(F.col("_symbol")) & (F.col("ts") == F.col("_ts")), "left")
    return joined.select(*s.columns, *[F.coalesce(f"{k}_{n}", F.lit(0.0)).alias(f"{k}_{n}") for k in sessions for n in scores])


def time_ranges(bars: DataFrame, mode: str = "completed") -> DataFrame:
    """Extremes so far and the figures of sessions, in one of the modes of session_figures."""
    return extremes(bars).join(session_figures(bars, mode), ["symbol", "ts"], "left")


def daily_ranges(bars: DataFrame, session: str = "asia") -> DataFrame:
    """A row for each day's session (DAILY): open, high, low, close, range and body, also as shares of the open, wicks and their ratio. Sees the session's own bars."""
    start, end = DAILY[session]
    g = session_bars(bars, (start, end)).dropna(subset=list(PRICES))
    o, h, lo, c = (F.col(p) for p in PRICES)
    upper, lower, body = h - F.greatest(o, c), F.least(o, c) - lo, F.abs(c - o)
    return g.select("symbol", "date", *PRICES, (h - lo).alias("range"), F.try_divide(h - lo, o).alias("range_pct"), body.alias("body"), F.try_divide(body, o).alias("body_pct"), upper.alias("upper"), lower.alias("lower"), (upper / (lower + 1e-10)).alias("wick_ratio"))
