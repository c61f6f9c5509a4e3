"""Signals as columns, and a backtest replay as one ordered fold for each (run, symbol)."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.win import lag


def signal_gate(bars: DataFrame, period_hours: int = 4, first_hour: int = 2, last_hour: int = 20) -> DataFrame:
    """Rows on the period's grid (from 1996-01-01) within trading hours and not at the weekend."""
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp")) - 820454400
    on = (F.pmod(seconds, F.lit(period_hours * 3600)) == 0) & F.hour("ts").between(first_hour, last_hour) & (F.weekday("ts") < 5)
    return bars.select("symbol", "ts", on.cast("int").alias("gate"))


def trading_state(bars: DataFrame) -> DataFrame:
    """The last rule that applies: weekend, then outside 9 to 16 o'clock (overnight)."""
    hour = F.hour("ts")
    state = F.when((hour >= 16) | (hour < 9), "DISABLED_OVERNIGHT").when(F.weekday("ts") >= 5, "DISABLED_WEEKEND").otherwise("ENABLED")
    return bars.select("symbol", "ts", state.alias("state"))


def book_prices(bars: DataFrame, base: float = 0.0005, most: float = 0.01) -> DataFrame:
    """Bid and ask around low, close and high; the spread widens with the bar's range. Volatility, stochastic and momentum of the bar before."""
    s = bars.withColumn("spread", F.least(base * (1 + 10 * F.try_divide(F.col("high") - F.col("low"), F.col("close"))), F.lit(most)))
    out = [(F.col(x) * (1 + sign * F.col("spread") / 2)).alias(f"{x}_{side}") for x in ("low", "close", "high") for side, sign in (("bid", -1), ("ask", 1))]
    h, lo, c = lag("high"), lag("low"), lag("close")
    return s.select("symbol", "ts", "spread", *out, F.try_divide(h - lo, c).alias("volatility"), F.try_divide(c - lo, h - lo).alias("stochastic"), (c - lag("open")).alias("momentum"))


def macd_entry(features: DataFrame, least: float = 1e-4, most_z: float = 2.0, notional: float = 1000.0) -> DataFrame:
    """Entries of a flat book: histogram large enough, z-score not extreme, signs agree; with side and target size."""
    h, line, signal = F.col("hist"), F.col("line"), F.col("signal")
    agree = ((h > 0) & (line > signal)) | ((h < 0) & (line < signal))
    enter = F.coalesce((F.abs(h) >= least) & (F.abs(F.col("z_hist")) <= most_z) & agree, F.lit(False))
    size = notional / F.col("close") * F.least(F.abs(F.try_divide(h, line)), F.lit(1.0)) * F.signum(h)
    return features.select("symbol", "ts", enter.cast("int").alias("enter"), F.when(enter, F.when(h > 0, "buy").otherwise("sell")).alias("side"), F.when(enter, size).alias("target"))


@dataclass(frozen=True)
class ReplayConfig:
    equity: float = 10_000.0
    notional: float = 1_000.0
    taker_bps: float = 5.0
    maker_bps: float = 1.0
    max_leverage: float = 3.0
    stop: float = 0.2
    offset_bps: float = 2.0
    max_age: int = 3

    def __post_init__(self):
        if self.equity <= 0 or self.max_leverage < 1 or min(self.taker_bps, self.maker_bps) < 0 or not 0 < self.stop <= 1:
            raise ValueError("replay settings out of range")


STATE = "symbol string, ts timestamp_ntz, size double, entry double, realized double, unrealized double, fees double, equity double, trades long, event string"


def step(state: dict, bar: dict, config: ReplayConfig) -> str:
    """One bar: stop, fill or convert the open order, then place one if the signal asks for another side. Average-cost accounting; signed sizes."""
    event = ""

    def fill(size, price, bps, name):
        nonlocal event
        old, state["fees"] = state["size"], state["fees"] + abs(size * price) * bps / 1e4
        closing = min(abs(size), abs(old)) if old * size < 0 else 0.0
        state["realized"] += closing * (price - state["entry"]) * (1 if old > 0 else -1)
        new = old + size
        if old * size >= 0:
            state["entry"] = (abs(old) * state["entry"] + abs(size) * price) / abs(new) if new else 0.0
        elif abs(size) > abs(old):
            state["entry"] = price
        state["size"] = 0.0 if abs(new) < 1e-12 else new
        if not state["size"]:
            state["entry"] = 0.0
        state["trades"] += 1
        event = f"{event} {name}".strip()

    worth = config.equity + state["realized"] - state["fees"] + state["size"] * (bar["close"] - state["entry"])
    state["peak"] = max(state["peak"], worth)
    if state["size"] and worth < state["peak"] * (1 - config.stop):
        fill(-state["size"], bar["close"], config.taker_bps, "stop")
        state["order"] = None
    signal = bar["signal"] or 0
    if signal and state["order"] is None and signal * state["size"] <= 0:
        want = signal * config.notional / bar["close"]
        if abs(want) * bar["close"] <= config.max_leverage * max(worth, 0):
            state["order"] = [want - state["size"], bar["close"] * (1 - signal * config.offset_bps / 1e4), 0]
    if state["order"] is not None:
        size, limit, age = state["order"]
        if bar["low"] <= limit <= bar["high"]:
            fill(size, limit, config.maker_bps, "maker")
            state["order"] = None
        elif age >= config.max_age:
            fill(size, bar["close"], config.taker_bps, "taker")
            state["order"] = None
        else:
            state["order"][2] = age + 1
    return event


def start(config: ReplayConfig) -> dict:
    return {"size": 0.0, "entry": 0.0, "realized": 0.0, "fees": 0.0, "trades": 0, "peak": config.equity, "order": None}


def replay(bars: DataFrame, config: ReplayConfig = ReplayConfig()) -> DataFrame:
    """bars with a column signal (-1, 0, 1) to a state for each bar. A run of one symbol is one fold, as each bar needs the state before it; runs and symbols are dealt over tasks."""

    def run(pdf):
        pdf = pdf.sort_values("ts", kind="stable")
        state, out = start(config), []
        for bar in pdf.to_dict("records"):
            event = step(state, bar, config)
            unrealized = state["size"] * (bar["close"] - state["entry"])
            out.append((bar["symbol"], bar["ts"], state["size"], state["entry"], state["realized"], unrealized, state["fees"], config.equity + state["realized"] - state["fees"] + unrealized, state["trades"], event))
        import pandas as pd

        return pd.DataFrame(out, columns=["symbol", "ts", "size", "entry", "realized", "unrealized", "fees", "equity", "trades", "event"])

    return bars.select("symbol", "ts", "high", "low", "close", "signal").groupBy("symbol").applyInPandas(run, STATE)
