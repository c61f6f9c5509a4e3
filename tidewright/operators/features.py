"""Feature groups: bars in, (symbol, ts, features) out. Unless said otherwise a row sees only earlier bars."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunks import chunked, with_z
from ..functions.rolling import Rolled, rolled
from ..functions.scans import Fill, Runs, Sums, scan
from ..functions.win import by_symbol, corr, cross, diff, ewm, flag, frame, lag, pct_change, roll, row_mean, shifted

YEAR = math.sqrt(252 * 24)


def true_range() -> Column:
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - lag("close")), F.abs(F.col("low") - lag("close")))


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole) * 100


def tag(level: float) -> str:
    return str(level).replace(".", "p")


def bollinger(bars: DataFrame, period: int = 20, sigmas: tuple[int, ...] = (1, 2, 3, 4), levels: tuple[float, ...] = (1.8, 2.0, 2.5, 3.0)) -> DataFrame:
    """Bands of mean and standard deviation with touches, times since, widths, positions and distances; bands of the mean true range and of the implied volatility; z-scores."""
    s = chunked(bars.select("symbol", "ts", "high", "low", "close"), lambda b: _bollinger(b, period, sigmas, levels), period + 2)
    since = {f"since_{side}_{k}": F.col(f"touch_{side}_{k}") == 1 for k in sigmas for side in ("up", "down")}
    return with_z(s, [*[f"{m}_{k}" for k in sigmas for m in ("width", "position")], "atr", "ivol"], since=since)


def _bollinger(bars: DataFrame, period: int, sigmas: tuple[int, ...], levels: tuple[float, ...]) -> DataFrame:
    s = shifted(bars, ["high", "low", "close"])
    s = s.withColumns({"mean": roll(F.avg, "close", period), "sd": roll(F.stddev_samp, "close", period), "tr": true_range()})
    s = s.withColumns({"atr": roll(F.avg, "tr", period), "ivol": F.try_divide(F.col("sd"), F.col("mean")) * YEAR})
    c, mean, out = F.col("close"), F.col("mean"), {"atr_pct": F.bround(percent(F.col("atr"), F.col("close")), 4)}
    for k in sigmas:
        up, down = mean + k * F.col("sd"), mean - k * F.col("sd")
        out |= {f"upper_{k}": up, f"lower_{k}": down, f"width_{k}": percent(up - down, mean), f"position_{k}": F.bround(percent(c - down, up - down), 2), f"to_upper_{k}": F.bround(percent(up - c, c), 4), f"to_lower_{k}": F.bround(percent(c - down, c), 4), f"touch_up_{k}": flag(F.col("high") >= up), f"touch_down_{k}": flag(F.col("low") <= down)}
    for k in levels:
        for name, half in (("atr", F.col("atr") * k), ("ivol", mean * F.col("ivol") * k)):
            up, down = mean + half, mean - half
            out |= {f"{name}_upper_{tag(k)}": up, f"{name}_lower_{tag(k)}": down, f"{name}_position_{tag(k)}": F.bround(percent(c - down, up - down), 2)}
    return s.withColumns(out).drop("high", "low", "close")


def level_tests(column: str, low: tuple[int, ...], high: tuple[int, ...]) -> tuple[dict[str, Column], dict[str, Column]]:
    """For each level of a column from 0 to 100: whether it is there (at or under a low level, at or over a high one) and how far it is beyond; and the conditions by the name of the rows since they held."""
    x, out, since = F.col(column), {}, {}
    for v, low_side in [(v, True) for v in low] + [(v, False) for v in high]:
        there = x <= v if low_side else x >= v
        beyond = F.least(x - v, F.lit(0.0)) if low_side else F.greatest(x - v, F.lit(0.0))
        out |= {f"{column}_at_{v}": flag(there), f"{column}_beyond_{v}": F.when(x.isNotNull(), beyond)}
        since[f"{column}_since_{v}"] = there
    return out, since


LOW, HIGH = (20, 30, 40), (60, 70, 80)


def rsi(bars: DataFrame, period: int = 14, low: tuple[int, ...] = LOW, high: tuple[int, ...] = HIGH) -> DataFrame:
    """Relative strength by simple means, its change, levels and z-scores; a period without losses is 100, one without moves NULL."""
    s = chunked(bars.select("symbol", "ts", "close"), lambda b: _rsi(b, period), period + 3)
    levels, since = level_tests("rsi", low, high)
    return with_z(s.withColumns(levels), ["rsi", "change"], since=since)


def _rsi(bars: DataFrame, period: int) -> DataFrame:
    s = shifted(bars, ["close"]).withColumn("d", diff("close"))
    gain, loss = F.when(F.col("d") > 0, F.col("d")).otherwise(0.0), F.when(F.col("d") < 0, -F.col("d")).otherwise(0.0)
    s = s.withColumns({"g": roll(F.avg, gain, period), "l": roll(F.avg, loss, period)})
    s = s.withColumn("rsi", F.when(F.col("l") == 0, F.when(F.col("g") > 0, 100.0)).otherwise(100 - 100 / (1 + F.try_divide(F.col("g"), F.col("l")))))
    return s.withColumn("change", diff("rsi")).drop("close", "d", "g", "l")


def stochastic(bars: DataFrame, k: int = 12, d: int = 3, smooth: int = 3, low: tuple[int, ...] = LOW, high: tuple[int, ...] = HIGH) -> DataFrame:
    """Place of the close in the range of k rows, smoothed, with its mean over d rows: crossings, levels, changes, z-scores. A flat range is NULL."""
    s = chunked(bars.select("symbol", "ts", "high", "low", "close"), lambda b: _stochastic(b, k, d, smooth), k + d + smooth + 2)
    (of_k, since_k), (of_d, since_d) = (level_tests(c, low, high) for c in ("k", "d"))
    crossed = {"since_up": F.col("cross") == 1, "since_down": F.col("cross") == -1}
    return with_z(s.withColumns(of_k | of_d), ["k", "d", "k_change", "d_change"], since=crossed | since_k | since_d)


def _stochastic(bars: DataFrame, k: int, d: int, smooth: int) -> DataFrame:
    s = shifted(bars, ["high", "low", "close"])
    lowest, highest = roll(F.min, "low", k), roll(F.max, "high", k)
    s = s.withColumn("raw", F.try_divide(100 * (F.col("close") - lowest), highest - lowest))
    s = s.withColumn("k", roll(F.avg, "raw", smooth) if smooth > 1 else F.col("raw")).withColumn("d", roll(F.avg, "k", d)).withColumn("cross", cross("k", "d"))
    return s.withColumns({"k_change": diff("k"), "d_change": diff("d")}).drop("high", "low", "close", "raw")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Difference of two exponential means (line), its own mean (signal), their difference (hist); crossings and times since, changes, z-scores."""
    s = ewm(shifted(bars, ["close"]), "close", [fast, slow])
    s = s.withColumn("line", F.col(f"ewm_{fast}") - F.col(f"ewm_{slow}")).select("symbol", "ts", "line")
    s = ewm(s, "line", [signal], prefix="mean").withColumnRenamed(f"mean_{signal}", "signal").withColumn("hist", F.col("line") - F.col("signal"))
    s = chunked(s, lambda b: b.withColumns({"cross": cross("line", "signal"), "zero_cross": cross("line", F.lit(0.0))} | {f"{c}_change": diff(c) for c in ("line", "signal", "hist")}), 1)
    since = {f"since_{n}{side}": F.col(c) == sign for n, c in (("", "cross"), ("zero_", "zero_cross")) for side, sign in (("up", 1), ("down", -1))}
    return with_z(s, ["line", "signal", "hist", "line_change", "signal_change", "hist_change"], since=since)


def candles(bars: DataFrame, doji: float = 0.1, wick: float = 2.0, period: int = 20) -> DataFrame:
    """Patterns of one to three candles with strengths, how many bullish and bearish ones of late, volume against its mean, z-scores."""
    s = chunked(bars.select("symbol", "ts", "open", "high", "low", "close", "volume"), lambda b: _candles(b, doji, wick, period), period + 4)
    return with_z(s, ["hammer_strength", "star_strength", "bullish_count", "bearish_count", "intensity", "cluster"])


def _candles(bars: DataFrame, doji: float, wick: float, period: int) -> DataFrame:
    s = shifted(bars, ["open", "high", "low", "close", "volume"])
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    s = s.withColumns({"body": c - o, "size": F.abs(c - o), "upper": h - F.greatest(o, c), "lower": F.least(o, c) - lo, "range": h - lo})
    s = s.withColumn("mean_size", F.avg("size").over(frame(period)))
    b, b1, b2, c1, c2, o1 = F.col("body"), lag("body"), lag("body", 2), lag("close"), lag("close", 2), lag("open")
    s = s.withColumns({
        "doji": flag(F.col("size") <= F.col("mean_size") * doji), "hammer": flag((F.col("lower") > F.col("size") * wick) & (F.col("upper") < F.col("size")) & (b > 0)), "star": flag((F.col("upper") > F.col("size") * wick) & (F.col("lower") < F.col("size")) & (b < 0)),
        "bull_engulfing": flag((b1 < 0) & (b > 0) & (o <= c1) & (c >= o1)), "bear_engulfing": flag((b1 > 0) & (b < 0) & (o >= c1) & (c <= o1)),
        "three_white": flag((b > 0) & (b1 > 0) & (b2 > 0) & (c > c1) & (c1 > c2)), "three_black": flag((b < 0) & (b1 < 0) & (b2 < 0) & (c < c1) & (c1 < c2)),
    })
    any_ = lambda *names: F.greatest(*[F.col(n) for n in names])
    s = s.withColumns({"hammer_strength": F.when(F.col("hammer") == 1, F.try_divide(F.col("lower"), F.col("size"))).otherwise(0.0), "star_strength": F.when(F.col("star") == 1, F.try_divide(F.col("upper"), F.col("size"))).otherwise(0.0), "bullish_count": F.sum(any_("hammer", "bull_engulfing", "three_white")).over(frame(period)).cast("double"), "bearish_count": F.sum(any_("star", "bear_engulfing", "three_black")).over(frame(period)).cast("double"), "intensity": F.try_divide(F.col("volume"), roll(F.avg, "volume", period))})
    s = s.withColumn("cluster", F.col("bullish_count") + F.col("bearish_count"))
    return s.drop("open", "high", "low", "close", "volume", "mean_size")


#: Hours of sessions, over midnight where the start is later; fixed values.
SESSIONS = {"asia": (22, 7), "london": (8, 16), "us": (14, 21)}


def in_session(start: int, end: int, hour: Column | None = None) -> Column:
    hour = F.hour("ts") if hour is None else hour
    return ((hour >= start) | (hour < end)) if start > end else (hour >= start) & (hour < end)


def check_sessions(sessions: dict[str, tuple[int, int]]) -> list[tuple[str, str]]:
    """Pairs of sessions that share an hour."""
    hours = {k: {h % 24 for h in range(a, b if a <= b else b + 24)} for k, (a, b) in sessions.items()}
    names = sorted(hours)
    return [(x, y) for i, x in enumerate(names) for y in names[i + 1 :] if hours[x] & hours[y]]


def calendar(events: dict[str, tuple[str, ...]] | None = None, sessions: dict[str, tuple[int, int]] | None = None) -> dict[str, Column]:
    """Flags of ts by name: quarter, election cycle year, weekday, weekend, first Friday, sessions, dated events."""
    day, hour = F.weekday("ts"), F.hour("ts")
    weekend = ((day == 4) & (hour >= 23)) | (day == 5) | ((day == 6) & (hour < 17))
    out = {"quarter": F.quarter("ts"), "cycle_year": F.pmod(F.year("ts") - 2016, F.lit(4)) + 1, "weekday": day, "is_weekend": weekend.cast("int"), "first_friday": ((F.dayofmonth("ts") <= 7) & (day == 4)).cast("int")}
    out |= {f"session_{k}": in_session(*v).cast("int") for k, v in (sessions or SESSIONS).items()}
    out |= {f"is_{k}": F.to_date("ts").cast("string").isin(*v).cast("int") for k, v in (events or {}).items()}
    return out


def seasonality(bars: DataFrame, events: dict[str, tuple[str, ...]] | None = None, sessions: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Calendar flags of a row's own time."""
    return bars.select("symbol", "ts", *[v.alias(k) for k, v in calendar(events, sessions).items()])


def volume_rolling(bars: DataFrame, widths: tuple[int, ...] = (1, 4, 12, 24, 48, 72, 168)) -> DataFrame:
    """Over each width: volume, bought volume, its share, peak against mean, momentum (change times excess of the share) and its change. Runs month by month."""
    return chunked(bars.select("symbol", "ts", "quote_volume", "taker_buy_quote_volume"), lambda b: _volume_rolling(b, widths), max(widths) + 2)


def _volume_rolling(bars: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    s = shifted(bars, ["quote_volume", "taker_buy_quote_volume"]).withColumnsRenamed({"quote_volume": "v", "taker_buy_quote_volume": "b"})
    first = {}
    for w in widths:
        total, buy = F.sum("v").over(frame(w)), F.sum("b").over(frame(w))
        first |= {f"sum_{w}": total, f"buy_{w}": buy, f"ratio_{w}": buy / (total + 1e-10), f"peak_{w}": F.max("v").over(frame(w)) / (F.avg("v").over(frame(w)) + 1e-10)}
    s = s.withColumns(first).withColumns({f"momentum_{w}": pct_change("v", w) * (F.col(f"ratio_{w}") - 0.5) for w in widths})
    return s.withColumns({f"acceleration_{w}": pct_change(f"momentum_{w}") for w in widths}).drop("v", "b")


def volume_by_season(bars: DataFrame) -> DataFrame:
    """Totals of each hour of the day over the whole history, on every row (looks ahead)."""
    season = Window.partitionBy("symbol", "season")
    s = bars.withColumn("season", F.hour("ts"))
    total, buy = F.sum("quote_volume").over(season), F.sum("taker_buy_quote_volume").over(season)
    return s.select("symbol", "ts", "season", total.alias("total"), buy.alias("buy"), F.try_divide(buy, total).alias("ratio"), F.try_divide(F.max("quote_volume").over(season), F.avg("quote_volume").over(season)).alias("concentration"))


def volume_seasons(bars: DataFrame, seasons: tuple[str, ...] | None = None, events: dict[str, tuple[str, ...]] | None = None, sessions: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """For each season (names of calendar(), all but weekday if none are given): of all bars whose season has the row's value, the volume before
    them, what of it was bought, its share, and the largest volume against the mean; z-scores. Looks ahead, as totals are of the whole history.

    One aggregation makes all totals: a symbol has as many as its seasons have values, and bars look them up in its map.
    """
    flags = calendar(events, sessions)
    seasons = tuple(k for k in flags if k != "weekday") if seasons is None else seasons
    s = shifted(bars, ["quote_volume", "taker_buy_quote_volume"]).withColumns({f"_{k}": flags[k].cast("int") for k in seasons})
    key = lambda k: F.concat_ws("=", F.lit(k), F.coalesce(F.col(f"_{k}").cast("string"), F.lit("")))
    each = s.select("symbol", "quote_volume", "taker_buy_quote_volume", F.explode(F.array(*[key(k) for k in seasons])).alias("key"))
    total, buy = F.sum("quote_volume"), F.sum("taker_buy_quote_volume")
    sums = each.groupBy("symbol", "key").agg(F.struct(total.alias("total"), buy.alias("buy"), F.try_divide(buy, total).alias("ratio"), (F.max("quote_volume") / (F.avg("quote_volume") + 1e-10)).alias("concentration")).alias("sums"))
    sums = sums.groupBy(F.col("symbol").alias("_symbol")).agg(F.map_from_entries(F.collect_list(F.struct("key", "sums"))).alias("_sums"))
    s = s.join(sums, F.col("symbol").eqNullSafe(F.col("_symbol")))
    out = {f"{k}_{m}": F.col("_sums")[key(k)][m] for k in seasons for m in ("total", "buy", "ratio", "concentration")}
    s = s.select("symbol", "ts", *[v.alias(k) for k, v in out.items()])
    return with_z(s, [f"{k}_{m}" for k in seasons for m in ("total", "ratio", "concentration")])


def volume_momentum(bars: DataFrame, periods: tuple[int, ...] = (5, 10, 20, 50), widths: tuple[int, ...] = (24, 72, 168)) -> DataFrame:
    """Changes of volume, of the bought share and of rolling volume over each period; volumes against their means over each width; z-scores of all."""
    s = chunked(bars.select("symbol", "ts", "quote_volume", "taker_buy_quote_volume"), lambda b: _volume_momentum(b, periods, widths), max(*periods, *widths) + 3)
    return with_z(s, [c for c in s.columns if c not in ("symbol", "ts")])


def _volume_momentum(bars: DataFrame, periods: tuple[int, ...], widths: tuple[int, ...]) -> DataFrame:
    s = shifted(bars, ["quote_volume", "taker_buy_quote_volume"]).withColumn("r", F.try_divide(F.col("taker_buy_quote_volume"), F.col("quote_volume")))
    s = s.withColumns({f"sum_{p}": roll(F.sum, "quote_volume", p) for p in periods})
    out = {}
    for p in periods:
        out |= {f"volume_{p}": pct_change("quote_volume", p), f"buy_ratio_{p}": pct_change("r", p), f"total_{p}": pct_change(f"sum_{p}")}
    volumes = {"relative": "quote_volume", "buy_relative": "taker_buy_quote_volume"}
    s = s.select("symbol", "ts", *volumes.values(), *[v.alias(k) for k, v in out.items()])
    s = rolled(s, {f"{name}_{w}": Rolled("mean", w, v) for w in widths for name, v in volumes.items()})
    return s.withColumns({f"{name}_{w}": F.try_divide(F.col(v), F.col(f"{name}_{w}")) for w in widths for name, v in volumes.items()}).drop(*volumes.values())


def vwap(bars: DataFrame, period: int = 20, mults: tuple[float, ...] = (1.0, 1.5, 2.0, 2.5, 3.0)) -> DataFrame:
    """Volume-weighted price with bands; sees its own bar. The deviation needs a second window over the first one's result."""
    return chunked(bars.select("symbol", "ts", "high", "low", "close", "quote_volume"), lambda b: _vwap(b, period, mults), 2 * period)


def _vwap(bars: DataFrame, period: int, mults: tuple[float, ...]) -> DataFrame:
    s = bars.select("symbol", "ts", "close", F.col("quote_volume").alias("v"), ((F.col("high") + F.col("low") + F.col("close")) / 3).alias("tp"))
    s = s.withColumn("vwap", F.try_divide(roll(F.sum, F.col("tp") * F.col("v"), period), roll(F.sum, "v", period)))
    dev = roll(F.sum, F.pow(F.col("tp") - F.col("vwap"), 2) * F.col("v"), period)
    s = s.withColumn("sd", F.sqrt(F.try_divide(dev, roll(F.sum, "v", period))))
    bands = [x for m in mults for x in ((F.col("vwap") + m * F.col("sd")).alias(f"upper_{tag(m)}"), (F.col("vwap") - m * F.col("sd")).alias(f"lower_{tag(m)}"), F.try_divide(F.col("close") - F.col("vwap"), m * F.col("sd")).alias(f"position_{tag(m)}"))]
    return s.select("symbol", "ts", "vwap", "sd", *bands)


NODES = 3
#: Bins that profiles made at once have together.
PROFILE_CELLS = 1 << 20


def profile_of(p: np.ndarray, v: np.ndarray, low: np.ndarray, high: np.ndarray, bins: int, area: float, much: float, little: float) -> np.ndarray:
    """Rows of prices and volumes (n x period) with their bounds to point of control, value area (low, high) and the NODES largest and smallest nodes; NaN where there is none.

    Equal bins from low to high, the last closed on the right, weighted by volume
    and smoothed over three bins. The value area takes bins by falling volume as
    long as their sum is within the area. Ties go to the lower price.
    """
    n, step = len(p), (high - low) / bins
    at = np.clip(np.floor((p - low[:, None]) / step[:, None]), 0, bins - 1).astype(np.int64)
    raw = np.bincount((at + np.arange(n)[:, None] * bins).ravel(), v.ravel(), n * bins).reshape(n, bins)
    wide = np.pad(raw, ((0, 0), (1, 1)))
    hist = (wide[:, :-2] + wide[:, 1:-1] + wide[:, 2:]) / 3
    price = low[:, None] + (np.arange(bins) + 0.5) * step[:, None]
    falling, rising = np.argsort(-hist, axis=1, kind="stable"), np.argsort(hist, axis=1, kind="stable")
    take = lambda order: np.take_along_axis(price, order, 1)
    by_volume = np.take_along_axis(hist, falling, 1)
    inside = np.cumsum(by_volume, axis=1) <= area * hist.sum(axis=1, keepdims=True)
    ordered = take(falling)
    out = [ordered[:, 0], np.where(inside.any(axis=1), np.where(inside, ordered, np.inf).min(axis=1), np.nan), np.where(inside.any(axis=1), np.where(inside, ordered, -np.inf).max(axis=1), np.nan)]
    mean = hist.mean(axis=1)
    large, small = by_volume[:, :NODES] >= much * mean[:, None], np.take_along_axis(hist, rising, 1)[:, :NODES] <= little * mean[:, None]
    nodes = [np.where(large, ordered[:, :NODES], np.nan), np.where(small, take(rising)[:, :NODES], np.nan)]
    return np.column_stack([*out, *nodes])


def volume_profile(bars: DataFrame, period: int = 24, bins: int = 100, area: float = 0.7, much: float = 1.5, little: float = 0.5) -> DataFrame:
    """Histogram of typical price by volume over the last rows: point of control, value area, nodes of much and little volume, their distances to the close, z-scores. Rows without a full frame, or whose frame has one price, have NULL."""
    s = chunked(bars.select("symbol", "ts", "high", "low", "close", "quote_volume"), lambda b: _volume_profile(b, period, bins, area, much, little), period + 1)
    return with_z(s, [c for c in s.columns if c.startswith("to_") or c == "va_width"])


def _volume_profile(bars: DataFrame, period: int, bins: int, area: float, much: float, little: float) -> DataFrame:
    s = shifted(bars, ["high", "low", "close", "quote_volume"]).withColumn("p", (F.col("high") + F.col("low") + F.col("close")) / 3)
    names = ["poc", "va_low", "va_high", *[f"hvn_{i + 1}" for i in range(NODES)], *[f"lvn_{i + 1}" for i in range(NODES)]]

    def slide(piece: pa.Table) -> pa.Table:
        """Frames of a piece are views of its columns, so a bar is sent once."""
        piece = piece.take(pc.sort_indices(piece, sort_keys=[("ts", "ascending")]))
        values = np.full((len(piece), len(names)), np.nan)
        if len(piece) >= period:
            p, v, low, high = (np.lib.stride_tricks.sliding_window_view(piece.column(c).to_numpy(zero_copy_only=False), period) for c in ("p", "quote_volume", "low", "high"))
            bottom, top = low.min(axis=1), high.max(axis=1)
            known = np.flatnonzero(~np.isnan(p).any(axis=1) & ~np.isnan(v).any(axis=1) & (top > bottom))
            for some in np.array_split(known, max(1, len(known) * bins // PROFILE_CELLS)):
                values[some + period - 1] = profile_of(p[some], v[some], bottom[some], top[some], bins, area, much, little)
        found = [pa.array(x, mask=np.isnan(x)) for x in values.T]
        return pa.Table.from_arrays([*[piece.column(c) for c in ("symbol", "ts", "close")], *found], ["symbol", "ts", "close", *names])

    s = s.groupBy("symbol").applyInArrow(slide, f"symbol {s.schema['symbol'].dataType.simpleString()}, ts timestamp_ntz, close double, " + ", ".join(f"{n} double" for n in names))
    c = F.col("close")
    away = {f"to_{n}": F.bround(percent(F.col(n) - c, c), 4) for n in names} | {"va_width": F.bround(percent(F.col("va_high") - F.col("va_low"), c), 4)}
    return s.withColumns(away).drop("close")


#: Round prices; fixed values.
MAJOR, MINOR = (1000.0, 5000.0, 10000.0, 20000.0, 30000.0, 40000.0, 50000.0), (1000.0, 2000.0, 3000.0, 4000.0, 5000.0)


def touches(level: Column, period: int, margin: float) -> Column:
    """How many of the last rows reach each row's own level within the margin; NULL without a full frame."""
    return roll(F.sum, flag((F.col("low") <= level * (1 + margin)) & (F.col("high") >= level * (1 - margin))).cast("double"), period)


def price_levels(bars: DataFrame, period: int = 20, major: tuple[float, ...] = MAJOR, minor: tuple[float, ...] = MINOR, margin: float = 0.01) -> DataFrame:
    """Nearest major and minor level strictly over and under the close, their distances and touches, levels near the close, centred support and resistance (looks ahead), z-scores of distances."""
    s = chunked(bars.select("symbol", "ts", "high", "low", "close"), lambda b: _price_levels(b, period, major, minor, margin), period + period // 2 + 1, ahead=(period - 1) // 2)
    return with_z(s, [c for c in s.columns if c.startswith("to_")])


def _price_levels(bars: DataFrame, period: int, major: tuple[float, ...], minor: tuple[float, ...], margin: float) -> DataFrame:
    s = shifted(bars, ["high", "low", "close"])
    c, found = F.col("close"), {}
    for name, values in (("major", major), ("minor", minor)):
        given = F.array(*[F.lit(float(v)) for v in values])
        found |= {f"{name}_up": F.array_min(F.filter(given, lambda v: v > c)), f"{name}_down": F.array_max(F.filter(given, lambda v: v < c)), f"{name}_cluster": F.coalesce(F.size(F.filter(given, lambda v: (v >= c * (1 - margin)) & (v <= c * (1 + margin)))), F.lit(0))}
    centred = by_symbol().rowsBetween(-(period // 2), (period - 1) // 2)
    found |= {"resistance": F.when(F.count("high").over(centred) >= period, F.max("high").over(centred)), "support": F.when(F.count("low").over(centred) >= period, F.min("low").over(centred))}
    s = s.withColumns(found)
    names = ["major_up", "major_down", "minor_up", "minor_down", "resistance", "support"]
    s = s.withColumns({f"to_{n}": F.bround(percent(F.col(n) - c, c), 4) for n in names} | {f"{n}_strength": touches(F.col(n), period, margin) for n in names})
    return s.drop("high", "low", "close")


def market_structure(bars: DataFrame, p: int = 5) -> DataFrame:
    """Swing highs and lows over p rows to either side (looks ahead) and how far they stand out, higher highs and so on, breaks, trend, z-scores."""
    s = chunked(bars.select("symbol", "ts", "high", "low"), lambda b: _market_structure(b, p), 5 * p + 1, ahead=p)
    return with_z(s, ["high_strength", "low_strength"])


def _market_structure(bars: DataFrame, p: int) -> DataFrame:
    s = shifted(bars, ["high", "low"])
    around = by_symbol().rowsBetween(-p, p)
    inside = F.count(F.lit(1)).over(around) == 2 * p + 1
    s = s.withColumns({"sh": flag(inside & (F.col("high") == F.max("high").over(around))), "sl": flag(inside & (F.col("low") == F.min("low").over(around)))})
    past = by_symbol().rowsBetween(-2 * p, -1)
    top = lambda f, c, m: f(F.when(F.col(m) == 1, F.col(c))).over(past)
    late = F.count(F.lit(1)).over(past) == 2 * p
    s = s.withColumns({"hh": flag(late & (F.col("sh") == 1) & (F.col("high") > top(F.max, "high", "sh"))), "lh": flag(late & (F.col("sh") == 1) & (F.col("high") < top(F.min, "high", "sh"))), "ll": flag(late & (F.col("sl") == 1) & (F.col("low") < top(F.min, "low", "sl"))), "hl": flag(late & (F.col("sl") == 1) & (F.col("low") > top(F.max, "low", "sl")))})
    near, wide = by_symbol().rowsBetween(-p, -1), by_symbol().rowsBetween(-2 * p + 1, 0)
    up, down = (F.col("hh") == 1) & (F.max("hl").over(near) == 1), (F.col("ll") == 1) & (F.max("lh").over(near) == 1)
    bulls, bears = F.sum(F.col("hh") + F.col("hl")).over(wide), F.sum(F.col("lh") + F.col("ll")).over(wide)
    span = F.max("high").over(around) - F.min("low").over(around)
    mean = lambda c: F.avg(c).over(around)
    strength = lambda c, m, gap: F.when((F.col(m) == 1) & (span > 0), F.bround(gap / span * 100, 2)).otherwise(0.0)
    s = s.withColumns({"high_strength": strength("high", "sh", F.col("high") - mean("high")), "low_strength": strength("low", "sl", mean("low") - F.col("low"))})
    strong = {f"strong_{side}_{tag(t)}": flag(F.col(f"{side}_strength") > t) for side in ("high", "low") for t in (1.5, 2.0, 2.5)}
    s = s.withColumns(strong | {"broken": F.when(down, -1).when(up, 1).otherwise(0), "trend": F.signum((bulls - bears).cast("double")).cast("int")})
    return s.withColumnRenamed("broken", "structure_break").drop("high", "low")


def streaks(bars: DataFrame, periods: tuple[int, ...] = (20, 50, 100), threshold: float = 0.5, busy: float = 1.5) -> DataFrame:
    """Signed length of runs of rises or falls (flat rows carry on), the return of a run on its last row (looks ahead by one), running counts of true ranges and volumes well over their means, both together, z-scores.

    Runs, counts and the close at which a run began are carried from piece to piece.
    """
    hits = [f"{k}_{p}" for p in periods for k in ("volatility", "volume")]
    s = chunked(bars.select("symbol", "ts", "high", "low", "close", "quote_volume"), lambda b: _streak_rows(b, periods, threshold, busy), max(periods) + 3)
    s = scan(s, [Runs("_sign", "_sign", "price", through=True), Sums({c: f"_{c}" for c in hits})], name="streaks")
    s = s.withColumn("price", F.coalesce(F.col("price").cast("long"), F.lit(0)))
    s = chunked(s, _streak_ends, 2, ahead=1)
    s = scan(s, [Fill("_begins", {"_first": "close"})], name="streak_ends")
    s = s.withColumns({"length": F.abs("price"), "returns": F.when(F.col("_ended"), F.coalesce(percent(F.col("close"), F.col("_first")) - 100, F.lit(0.0))).otherwise(0.0)})
    s = s.withColumns({f"combined_{p}": flag((F.col(f"volatility_{p}") > 0) & (F.col(f"volume_{p}") > 0)) for p in periods})
    return with_z(s.select("symbol", "ts", "price", "length", "returns", *hits, *[f"combined_{p}" for p in periods]), ["length", "returns", *hits])


def _streak_rows(bars: DataFrame, periods: tuple[int, ...], threshold: float, busy: float) -> DataFrame:
    s = shifted(bars, ["high", "low", "close", "quote_volume"]).withColumns({"_s": F.signum(pct_change("close")), "_tr": true_range()})
    out = {"_sign": F.when(F.col("_s") != 0, F.col("_s"))}
    for p in periods:
        out |= {f"_volatility_{p}": flag(F.col("_tr") > roll(F.avg, "_tr", p) * (1 + threshold)), f"_volume_{p}": flag(F.col("quote_volume") > roll(F.avg, "quote_volume", p) * busy)}
    return s.select("symbol", "ts", "close", *[v.alias(k) for k, v in out.items()])


def _streak_ends(s: DataFrame) -> DataFrame:
    ended = F.coalesce(F.abs(F.lead("price").over(by_symbol())) < F.abs("price"), F.lit(False))
    return s.withColumn("_ended", ended).withColumn("_begins", F.coalesce(lag("_ended"), F.lit(False)))


def volatility(bars: DataFrame, widths: tuple[int, ...] = (24, 168, 720)) -> DataFrame:
    """Parkinson and close-to-close range volatility, true range and true range weighted by volume, their means over each width, the mean of the four over the middle width, z-scores."""
    s = chunked(bars.select("symbol", "ts", "high", "low", "close", "quote_volume"), lambda b: _volatility(b, widths), widths[0] + max(widths) + 2, "quarter")
    return with_z(s, ["parkinson", "gk", "tr", "weighted", "composite"])


def _volatility(bars: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    s = shifted(bars, ["high", "low", "close", "quote_volume"])
    hl, cc = F.ln(F.try_divide(F.col("high"), F.col("low"))), F.ln(F.try_divide(F.col("close"), lag("close")))
    gk = 0.5 * hl * hl - (2 * math.log(2) - 1) * cc * cc
    s = s.withColumns({"parkinson": F.sqrt(hl * hl / (4 * math.log(2))), "gk": F.when(gk >= 0, F.sqrt(gk)), "tr": true_range(), "busy": F.try_divide(F.col("quote_volume"), roll(F.avg, "quote_volume", widths[0]))})
    s = s.withColumn("weighted", F.col("tr") * F.col("busy"))
    kinds = ("parkinson", "gk", "tr", "weighted")
    s = rolled(s, {f"{m}_{w}": Rolled("mean", w, m) for m in kinds for w in widths})
    s = s.withColumn("composite", row_mean([F.col(f"{m}_{widths[min(1, len(widths) - 1)]}") for m in kinds]))
    return s.drop("high", "low", "close", "quote_volume", "busy")


def funding_features(rates: DataFrame, widths: tuple[int, ...] = (8, 24, 72, 168)) -> DataFrame:
    """Of an eight-hourly rate: annual mean, deviation, skew and share above 0; sees its own row. Runs quarter by quarter."""
    return chunked(rates.select("symbol", "ts", "fundingRate"), lambda r: _funding_features(r, widths), max(widths), "quarter")


def _funding_features(rates: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    out = {}
    x = F.col("fundingRate")
    for w in widths:
        mean, sd = roll(F.avg, x, w), roll(F.stddev_samp, x, w)
        out |= {f"annual_{w}": mean * 24 * 365, f"sd_{w}": sd, f"z_{w}": (x - mean) / (sd + 1e-10), f"skew_{w}": F.when(sd > 1e-12, roll(F.skewness, x, w)) * math.sqrt(w * (w - 1)) / (w - 2), f"positive_{w}": roll(F.avg, (x > 0).cast("double"), w)}
    return rates.select("symbol", "ts", *[v.alias(k) for k, v in out.items()])


def returns(bars: DataFrame, lags: tuple[int, ...] = (1, 2, 3, 4, 5, 10, 20, 50), widths: tuple[int, ...] = (5, 10, 20, 50)) -> DataFrame:
    """Log and percent returns over each lag, yearly volatility and cumulative returns over each width (the product is of 1 and log returns), z-scores."""
    s = chunked(bars.select("symbol", "ts", "close"), lambda b: _returns(b, lags, widths), max(*lags, *widths) + 2)
    s = with_z(s, [c for c in s.columns if c.startswith(("log_", "raw_", "vol_", "cum_"))])
    renamed = {f"raw_{n}_z{z}": f"pct_{n}_z{z}" for n in lags for z in (168, 720)}
    return s.drop(*[f"raw_{n}" for n in lags]).withColumnsRenamed(renamed)


def _returns(bars: DataFrame, lags: tuple[int, ...], widths: tuple[int, ...]) -> DataFrame:
    s = shifted(bars, ["close"]).withColumns({f"log_{n}": F.ln(F.try_divide(F.col("close"), lag("close", n))) for n in lags} | {f"raw_{n}": pct_change("close", n) * 100 for n in lags})
    out = {f"pct_{n}": F.bround(f"raw_{n}", 4) for n in lags}
    for w in widths:
        out |= {f"vol_{w}": roll(F.stddev_samp, "log_1", w) * YEAR, f"cum_log_{w}": roll(F.sum, "log_1", w), f"cum_pct_{w}": F.bround((roll(F.product, 1 + F.col("log_1"), w) - 1) * 100, 4)}
    return s.withColumns(out).drop("close")


def relationship(bars: DataFrame, benchmark: str, widths: tuple[int, ...] = (24, 72, 168, 336, 720)) -> DataFrame:
    """Against one symbol's closes at the same times: correlation, beta, relative strength and volatility, log spread."""
    own = bars.select("symbol", "ts", "close")  # the benchmark itself gets no row
    bench = own.where(F.col("symbol") == benchmark).select(F.col("ts").alias("_ts"), F.col("close").alias("bench"))
    s = own.where(F.col("symbol") != benchmark).join(bench, F.col("ts") == F.col("_ts"), "left").drop("_ts")
    s = chunked(s, lambda b: _relationship(b, widths), max(widths) + 2, "quarter")
    return with_z(s, [c for c in s.columns if c not in ("symbol", "ts")])


def _relationship(pairs: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    s = shifted(pairs, ["close", "bench"]).withColumns({"a": F.ln(F.try_divide(F.col("close"), lag("close"))), "b": F.ln(F.try_divide(F.col("bench"), lag("bench")))})
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    s = s.withColumns({"x": F.when(both, F.col("a")), "y": F.when(both, F.col("b")), "spread": F.ln(F.try_divide(F.col("close"), F.col("bench")))})
    strength = {f"strength_{w}": F.bround((pct_change("close", w) - pct_change("bench", w)) * 100, 4) for w in widths}
    pairs = {"corr": "corr", "beta": "beta", "relative_vol": "sd_ratio"}
    s = s.select("symbol", "ts", "spread", "x", "y", *[v.alias(k) for k, v in strength.items()])
    s = rolled(s, {f"{name}_{w}": Rolled(kind, w, "x", "y") for w in widths for name, kind in pairs.items()})
    made = {f"{name}_{w}": F.bround(f"{name}_{w}", 4) if name == "relative_vol" else F.col(f"{name}_{w}") for w in widths for name in ("corr", "beta", "strength", "relative_vol")}
    return s.select("symbol", "ts", "spread", *[v.alias(k) for k, v in made.items()])


HALVINGS = ("2012-11-28", "2016-07-09", "2020-05-11", "2024-04-20")  # fixed values


def cycle(bars: DataFrame) -> DataFrame:
    """Year within the halving cycle and days to the next one (1460 days after the last), one hour earlier than the row."""
    at = F.col("ts") - F.expr("INTERVAL 1 HOUR")
    day = F.to_date(at)
    bounds = [F.lit(h).cast("date") for h in HALVINGS]
    bounds.append(F.date_add(bounds[-1], 1460))
    last, nxt = F.lit(None).cast("date"), bounds[0]
    for a, b in zip(bounds, bounds[1:]):
        last, nxt = F.when(day >= a, a).otherwise(last), F.when(day >= a, b).otherwise(nxt)
    year = (F.floor(F.datediff(day, last) / F.datediff(nxt, last) * 4) + 1).cast("int")
    return bars.select("symbol", "ts", year.alias("cycle_year"), F.datediff(nxt, day).alias("days_to_next"), flag(at == last.cast("timestamp_ntz")).alias("is_halving"))


def aux_series(series: DataFrame, widths: tuple[int, ...] = (24, 72, 168, 336, 720)) -> DataFrame:
    """Of an index (open, high, low, close): range, body and shadows in percent, means and distances to them over each width, changes over a day and a week of hours, z-scores."""
    s = chunked(series.select("symbol", "ts", "open", "high", "low", "close"), lambda b: _aux_series(b, widths), max(*widths, 168) + 1, "quarter")
    return with_z(s, ["close", "range_pct", "change_24", "change_168"])


def _aux_series(series: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    s = shifted(series, ["open", "high", "low", "close"])
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    out = {"range_pct": F.bround(percent(h - lo, o), 2), "body_pct": F.bround(percent(c - o, o), 2), "upper_pct": F.bround(percent(h - F.greatest(o, c), o), 2), "lower_pct": F.bround(percent(F.least(o, c) - lo, o), 2)}
    out |= {f"change_{n}": pct_change("close", n) * 100 for n in (24, 168)}
    s = rolled(s.withColumns(out), {f"mean_{w}": Rolled("mean", w, "close") for w in widths})
    return s.withColumns({f"vs_mean_{w}": percent(c, F.col(f"mean_{w}")) - 100 for w in widths}).drop("open", "high", "low")


def fear_greed_features(series: DataFrame, widths: tuple[int, ...] = (24, 72, 168)) -> DataFrame:
    """Of a daily value: the day before, means and distances to them, changes, z-scores; widths are rows of the daily series. Runs year by year."""
    s = chunked(series.select("symbol", "ts", "value"), lambda d: _fear_greed_features(d, widths), max(*widths, 168) + 1, "year")
    return with_z(s, ["value", "change_24", "change_168"])


def _fear_greed_features(series: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    s = shifted(series, ["value"])
    s = s.withColumns({f"change_{n}": diff("value", n) for n in (24, 168)})
    s = rolled(s, {f"mean_{w}": Rolled("mean", w, "value") for w in widths})
    return s.withColumns({f"vs_mean_{w}": F.col("value") - F.col(f"mean_{w}") for w in widths})


#: Times of high value to miners, (start, end); fixed values.
HIGH_VALUE = (("2017-12-05", "2017-12-21"), ("2021-01-05", "2021-01-12"), ("2021-02-01", "2021-02-20"), ("2021-03-10", "2021-03-15"))


def in_intervals(bars: DataFrame, intervals: DataFrame) -> DataFrame:
    """Add inside: whether ts lies in one of the intervals (start, end), both included; they don't overlap. Bars and intervals meet by month, so neither needs to be small."""
    month = lambda c: F.date_trunc("month", F.col(c).cast("timestamp_ntz"))
    months = intervals.select("start", "end", F.explode(F.sequence(month("start"), month("end"), F.expr("INTERVAL 1 MONTH"))).alias("_month"))
    months = months.select(F.col("start").alias("_start"), F.col("end").alias("_end"), "_month")
    joined = bars.join(months, (F.date_trunc("month", F.col("ts")) == F.col("_month")) & F.col("ts").between(F.col("_start"), F.col("_end")), "left")
    return joined.withColumn("inside", F.col("_start").isNotNull().cast("int")).drop("_start", "_end", "_month")
