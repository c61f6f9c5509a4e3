"""Gates, the MACD strategy, execution and risk: what a bar alone decides is a column, what needs the state before it is one ordered fold."""

import math
from collections import deque
from dataclasses import dataclass, field, fields
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import epoch, seconds
from ..functions.win import by_symbol, lag

#: Signal periods are counted from here: 1996-01-01, in seconds; fixed value.
GRID_START = 820454400
#: The two sides of an order.
SIDES = {1: "buy", -1: "sell"}
#: A maker order turns into a taker order beyond these, of the bar before: range, move with the order, and stochastic from the order's own end.
URGENT_RANGE, URGENT_MOVE, URGENT_STOCHASTIC = 0.02, 0.01, 0.1
#: How a new limit keeps its distance: shares of the range and of how far the stochastic is beyond STRETCHED, and of the move with the order, up to MOST_CHASE.
RANGE_SHARE, STRETCHED, STRETCH_SHARE, CHASE_SHARE, MOST_CHASE = 5.0, 0.2, 0.001, 0.0001, 0.0002
#: The least histogram that counts as a signal; the weekly z-score that ends a position, in multiples of the one that forbids an entry; the hour from which overnight begins.
LEAST_HIST, EXIT_Z, OVERNIGHT = 1e-4, 1.5, 16
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


@dataclass(frozen=True)
class Settings:
    """All settings of a run. Ranges are checked; from_tree takes a nested settings file."""

    candle_period: str = "1h"
    signal_period: str = "4h"
    signal_start_hour: int = 0
    signal_start_day: str | None = None
    min_spacing_hours: float = 0.0
    allow_overnight: bool = True
    trading_hours: tuple[int, int] | None = None
    trading_days: tuple[str, ...] = ()
    trading_disabled_datetime: tuple[tuple[str, str], ...] = ()
    trading_disabled_hours: tuple[tuple[int, int], ...] = ()
    position_size: float = 100_000.0
    entry_bps: float = 0.0
    exit_bps: float = 0.0
    rebalance_threshold: float = 0.01
    zscore_weekly_threshold: float = 2.0
    zscore_monthly_threshold: float = 3.0
    maker_fee_bps: float = 0.0
    taker_fee_bps: float = 0.0
    simulated_spread_bps: float = 1.0
    max_spread_bps: float = 10.0
    min_order_size_usd: float = 100.0
    max_order_size_usd: float = 400_000.0
    max_position_size_usd: float = 150_000.0
    max_position_coins: float = 1e9
    max_leverage: float = 2.0
    max_drawdown: float = 0.1
    max_volatility: float = 1.0
    concentration_limit: float = 1.0
    price_update_threshold: float = 0.005
    taker_conversion_hours: float = 2.0
    use_stochastic_oscillator: bool = True
    use_momentum: bool = True
    use_dynamic_spread: bool = True
    fill_delay: bool = False
    continue_on_error: bool = True

    def __post_init__(self):
        positive = ("position_size", "max_leverage", "max_volatility", "max_position_size_usd", "concentration_limit")
        bad = [n for n in positive if getattr(self, n) <= 0]
        bad += [n for n in ("maker_fee_bps", "taker_fee_bps", "simulated_spread_bps", "min_order_size_usd", "rebalance_threshold", "min_spacing_hours") if getattr(self, n) < 0]
        bad += ["max_drawdown"] * (not 0 < self.max_drawdown <= 1)
        bad += ["max_order_size_usd"] * (self.max_order_size_usd < self.min_order_size_usd)
        bad += ["max_spread_bps"] * (self.max_spread_bps < self.simulated_spread_bps)
        bad += ["trading_days"] * any(d not in DAYS for d in self.trading_days)
        bad += ["signal_start_day"] * (self.signal_start_day is not None and self.signal_start_day not in DAYS)
        hours = [*self.trading_disabled_hours, *([self.trading_hours] if self.trading_hours else [])]
        bad += ["hours"] * any(not 0 <= h <= 24 for pair in hours for h in pair)
        if bad or seconds(self.signal_period) % seconds(self.candle_period):
            raise ValueError(f"settings out of range: {', '.join(bad) or 'signal_period is no multiple of candle_period'}")

    @classmethod
    def from_tree(cls, tree: dict) -> "Settings":
        """From a nested dict, whatever the blocks are called; names that no setting has are left out, and numbers where a setting is text (a signal period in rows)."""
        known, found = {f.name: f.default for f in fields(cls)}, {}

        def walk(node):
            for k, v in node.items():
                if isinstance(v, dict):
                    walk(v)
                elif k in known and (isinstance(v, str) or not isinstance(known[k], str)):
                    found[k] = tuple(tuple(x) if isinstance(x, list) else x for x in v) if isinstance(v, list) else v

        walk(tree)
        return cls(**found)


def on_grid(period: str) -> Column:
    """Whether ts is on the grid of the signal period."""
    return F.pmod(epoch("ts") - GRID_START, F.lit(seconds(period))) == 0


def in_hours(start: int, end: int) -> Column:
    hour = F.hour("ts")
    return ((hour >= start) | (hour < end)) if start > end else (hour >= start) & (hour < end)


def in_ranges(ranges: tuple[tuple[str, str], ...]) -> Column:
    out = F.lit(False)
    for a, b in ranges:
        out = out | F.col("ts").between(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz"))
    return out


def trading_state(bars: DataFrame, s: Settings) -> DataFrame:
    """Add trading_state: days, hours, ranges, disabled hours, overnight; the last rule that applies wins."""
    rules = []
    if s.trading_days:
        rules.append((~F.weekday("ts").isin(*[DAYS.index(d) for d in s.trading_days]), "DISABLED_DAYS"))
    if s.trading_hours and not s.allow_overnight:
        rules.append((~F.hour("ts").between(s.trading_hours[0], s.trading_hours[1] - 1), "DISABLED_HOURS"))
    if s.trading_disabled_datetime:
        rules.append((in_ranges(s.trading_disabled_datetime), "DISABLED_RANGE"))
    rules += [(in_hours(a, b), "DISABLED_HOURS") for a, b in s.trading_disabled_hours]
    if not s.allow_overnight:
        rules.append((F.hour("ts") >= OVERNIGHT, "DISABLED_OVERNIGHT"))
    return bars.withColumn("trading_state", F.coalesce(*[F.when(cond, name) for cond, name in reversed(rules)], F.lit("ENABLED")))


def signal_gate(bars: DataFrame, s: Settings) -> DataFrame:
    """Add gate: on the period's grid, within trading hours and days, outside disabled ranges and hours, and not before the first bar on the start day and hour. Spacing needs the last signal's time, so the fold checks it."""
    ok = on_grid(s.signal_period) & ~in_ranges(s.trading_disabled_datetime)
    if s.trading_hours:
        ok = ok & in_hours(*s.trading_hours)
    if s.trading_days:
        ok = ok & F.weekday("ts").isin(*[DAYS.index(d) for d in s.trading_days])
    for a, b in s.trading_disabled_hours:
        ok = ok & ~in_hours(a, b)
    first = F.hour("ts") == s.signal_start_hour
    if s.signal_start_day:
        first = first & (F.weekday("ts") == DAYS.index(s.signal_start_day))
    started = F.max(first.cast("int")).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)) == 1
    return bars.withColumn("gate", ok & started)


def book(bars: DataFrame, s: Settings) -> DataFrame:
    """Add bid and ask around low, close and high by a spread that widens with the bar's range, and volatility, stochastic and momentum of the bar before."""
    half = F.least(s.simulated_spread_bps / 1e4 * (1 + 10 * F.coalesce(F.try_divide(F.col("high") - F.col("low"), F.col("close")), F.lit(0.0))), F.lit(s.max_spread_bps / 1e4)) / 2
    out = bars.withColumns({f"{x}_{side}": F.col(x) * (1 + sign * half) for x in ("low", "close", "high") for side, sign in (("bid", -1), ("ask", 1))})
    h, lo, c = lag("high"), lag("low"), lag("close")
    return out.withColumns({"exec_volatility": F.coalesce(F.try_divide(h - lo, c), F.lit(0.0)), "exec_stochastic": F.coalesce(F.try_divide(c - lo, h - lo), F.lit(0.5)), "exec_momentum": F.coalesce(c - lag("open"), F.lit(0.0))})


def quotes(booked: DataFrame, s: Settings) -> DataFrame:
    """Add to a book what a bar decides for open orders of each side, whatever their size: buy_limit and sell_limit, where one would be placed anew, and buy_urgency and sell_urgency, why it would turn into a taker order ('' if nothing in the bar says so)."""
    most, range_, stochastic = s.max_spread_bps / 1e4, F.col("exec_volatility"), F.col("exec_stochastic")
    out = {}
    for sign, side in SIDES.items():
        ahead = sign * F.col("exec_momentum")  # the price moves away from the order
        stretched = F.lit(STRETCHED) - stochastic if sign > 0 else stochastic - (1 - STRETCHED)
        at_end = stochastic < URGENT_STOCHASTIC if sign > 0 else stochastic > 1 - URGENT_STOCHASTIC
        rules = [(s.use_dynamic_spread, "volatility", range_ > URGENT_RANGE, F.least(range_ * RANGE_SHARE, F.lit(most))), (s.use_momentum, "momentum", ahead > URGENT_MOVE, -F.greatest(F.least(ahead * CHASE_SHARE, F.lit(MOST_CHASE)), F.lit(-MOST_CHASE))), (s.use_stochastic_oscillator, "stochastic", at_end, F.greatest(stretched, F.lit(0.0)) * STRETCH_SHARE)]
        used = [(name, urgent, distance) for on, name, urgent, distance in rules if on]
        distance = sum((d for _, _, d in used), F.lit(s.simulated_spread_bps / 1e4))
        out[f"{side}_limit"] = F.col("close_bid" if sign > 0 else "close_ask") * (1 - sign * distance)
        out[f"{side}_urgency"] = F.coalesce(*[F.when(urgent, name) for name, urgent, _ in used], F.lit(""))
    return booked.withColumns(out)


def limit_price(s: Settings, bar: dict, side: int, edge_bps: float) -> float:
    return bar["close_bid"] * (1 - edge_bps / 1e4) if side > 0 else bar["close_ask"] * (1 + edge_bps / 1e4)


def clamp_size(s: Settings, equity: float, close: float, size: float) -> float:
    """The size within equity times leverage, the concentration limit, and the limits in currency and coins."""
    most = min(equity * s.max_leverage / close, equity * s.concentration_limit / close, s.max_position_size_usd / close, s.max_position_coins)
    return math.copysign(min(abs(size), max(most, 0.0)), size)


@dataclass
class State:
    """What a bar needs of the bars before."""

    cash: float
    size: float = 0.0
    entry: float = 0.0
    realized: float = 0.0
    maker_fees: float = 0.0
    taker_fees: float = 0.0
    peak: float = 0.0
    equity: float = 0.0
    orders: list = field(default_factory=list)
    returns: deque = field(default_factory=lambda: deque(maxlen=20))
    last_pnl: float | None = None
    last_signal: object = None
    made: int = 0

    def unrealized(self, close: float) -> float:
        return self.size * (close - self.entry)

    def mark(self, close: float) -> None:
        self.equity = self.cash + self.realized - self.maker_fees - self.taker_fees + self.unrealized(close)
        self.peak = max(self.peak, self.equity)

    def leverage(self, close: float) -> float:
        return abs(self.size * close) / self.equity if self.equity > 0 else math.inf if self.size else 0.0

    def drawdown(self) -> float:
        return 1 - self.equity / self.peak if self.peak > 0 else 0.0

    def volatility(self) -> float:
        return float(np.std(self.returns)) * math.sqrt(252) if len(self.returns) == 20 else 0.0


class Strategy(Protocol):
    """What a strategy of one's own has to offer. A signal is a dict of side (1, -1), size, type, order_type ('maker', 'taker'), price, params."""

    def signals(self, bar: dict, state: State, s: Settings) -> list[dict]: ...

    def target(self, bar: dict, state: State, s: Settings) -> float: ...


class MacdStrategy:
    """Enters with the histogram's sign, leaves when it flips or the weekly z-score is extreme, rebalances in between, leaves when volatility is too high. Needs columns line, signal, hist, z_week, z_month."""

    def target(self, bar, state, s):
        line, hist = bar["line"] or 0.0, bar["hist"] or 0.0
        share = min(abs(hist) / abs(line), 1.0) if line else 0.0
        volatility = state.volatility()
        if volatility > 0:
            share *= max(1 - volatility / s.max_volatility, 0.0)
        return s.position_size / bar["close"] * share * (1 if hist > 0 else -1)

    def enters(self, bar, s):
        hist, line, signal = (bar[k] or 0.0 for k in ("hist", "line", "signal"))
        calm = abs(bar["z_week"] or 0.0) <= s.zscore_weekly_threshold and abs(bar["z_month"] or 0.0) <= s.zscore_monthly_threshold
        return abs(hist) >= LEAST_HIST and calm and (line > signal if hist > 0 else line < signal)

    def leaves(self, bar, state, s):
        return state.size * (bar["hist"] or 0.0) < 0 or abs(bar["z_week"] or 0.0) > EXIT_Z * s.zscore_weekly_threshold

    def signals(self, bar, state, s):
        out = self.decide(bar, state, s)
        return [x for x in out if x["size"] > 0]

    def decide(self, bar, state, s):
        away = -1 if state.size > 0 else 1
        if state.volatility() > s.max_volatility:
            return [signal(s, bar, away, abs(state.size), "risk", "taker", 0.0)] if state.size else []
        if not state.size:
            side = 1 if (bar["hist"] or 0.0) > 0 else -1
            params = {k: float(bar[k] or 0.0) for k in ("line", "signal", "hist")}
            return [signal(s, bar, side, abs(self.target(bar, state, s)), "entry", "maker", s.entry_bps, params)] if self.enters(bar, s) else []
        if self.leaves(bar, state, s):
            return [signal(s, bar, away, abs(state.size), "exit", "taker", s.exit_bps)]
        gap = self.target(bar, state, s) - state.size
        if abs(gap) / abs(state.size) > s.rebalance_threshold:
            return [signal(s, bar, 1 if gap > 0 else -1, abs(gap), "rebalance", "maker", s.entry_bps / 2)]
        return []


def signal(s, bar, side, size, kind, order_type, edge_bps, params=None):
    return {"side": side, "size": size, "type": kind, "order_type": order_type, "price": limit_price(s, bar, side, edge_bps), "params": params or {}}


class Refused(Exception):
    """A signal or an order that a rule turns down; the run goes on with an error row."""


def check_signal(x: dict, bar: dict, state: State, s: Settings) -> None:
    value, close = x["size"] * bar["close"], bar["close"]
    if not s.min_order_size_usd <= value <= s.max_order_size_usd:
        raise Refused("order size")
    room = s.max_spread_bps / 1e4
    if (x["side"] > 0 and x["price"] > close * (1 + room)) or (x["side"] < 0 and x["price"] < close * (1 - room)):
        raise Refused("limit price")
    worth = abs(state.size + x["side"] * x["size"]) * close
    if worth > abs(state.size) * close:  # less is always allowed
        if worth > s.max_position_size_usd:
            raise Refused("position size")
        if state.equity <= 0 or worth / state.equity > s.max_leverage:
            raise Refused("leverage")
        if worth / state.equity > s.concentration_limit:
            raise Refused("concentration")


def risk_signals(bar: dict, state: State, s: Settings) -> list[dict]:
    """Stop-loss by drawdown, and a cut of what is over the leverage limit."""
    if not state.size:
        return []
    away, close = -1 if state.size > 0 else 1, bar["close"]
    out = []
    if state.drawdown() > s.max_drawdown:
        out.append({"side": away, "size": abs(state.size), "type": "stop", "order_type": "taker", "price": close, "params": {}})
    elif state.leverage(close) > s.max_leverage:
        over = abs(state.size) - max(state.equity, 0.0) * s.max_leverage / close
        out.append({"side": away, "size": over, "type": "risk", "order_type": "taker", "price": close, "params": {}})
    return out


def becomes_taker(order: dict, bar: dict, s: Settings) -> str:
    """Why a maker order becomes a taker order, or '': its age, or what the bar says for its side (quotes)."""
    age = (bar["ts"] - order["ts"]).total_seconds()
    return "age" if age > s.taker_conversion_hours * 3600 else bar[f"{SIDES[order['side']]}_urgency"]


def limit_fill(order: dict, bar: dict) -> float | None:
    if order["side"] > 0:
        return min(order["price"], bar["high_ask"]) if bar["low_ask"] <= order["price"] <= bar["high_ask"] else None
    return max(order["price"], bar["low_bid"]) if bar["low_bid"] <= order["price"] <= bar["high_bid"] else None


def fill(state: State, side: int, size: float, price: float, fees: float, is_maker: bool) -> None:
    """Average-cost accounting: the entry is weighted on adding, stays on reducing, and is the price after a flip."""
    old, change = state.size, side * size
    new = old + change
    if old * change < 0:
        closed = min(abs(change), abs(old))
        state.realized += closed * (price - state.entry) * (1 if old > 0 else -1)
        if abs(change) > abs(old) + 1e-12:
            state.entry = price
    else:
        state.entry = (abs(old) * state.entry + size * price) / abs(new)
    state.size = 0.0 if abs(new) < 1e-12 else new
    if not state.size:
        state.entry = 0.0
    if is_maker:
        state.maker_fees += fees
    else:
        state.taker_fees += fees


def step(state: State, bar: dict, s: Settings, strategy: Strategy) -> list[dict]:
    """One bar: mark, signals, risk, orders, fills, state. Returns event rows, the state last."""
    close, rows = bar["close"], []

    def event(kind, name, **more):
        rows.append({"kind": kind, "name": name} | more)

    def order_event(name, o, **more):
        event("order", name, id=o["id"], ref=o["signal"], side=SIDES[o["side"]], order_type=o["order_type"], size=o["size"], price=more.pop("price", o["price"]), **more)

    state.mark(close)
    open_before = list(state.orders)
    wanted = []
    spaced = state.last_signal is None or (bar["ts"] - state.last_signal).total_seconds() >= s.min_spacing_hours * 3600
    if bar["gate"] and spaced:
        wanted = strategy.signals(bar, state, s)
        state.last_signal = bar["ts"]
    enabled = bar["trading_state"] == "ENABLED"
    for x in [*wanted, *risk_signals(bar, state, s)]:
        state.made += 1
        name = f"{bar['symbol']}-{bar['ts']:%Y%m%d%H%M%S}-{state.made}"
        safe = x["type"] in ("stop", "risk")
        side = SIDES[x["side"]]
        event("signal", x["type"], id=f"s-{name}", side=side, order_type=x["order_type"], size=x["size"], price=x["price"], params=x["params"])
        try:
            if not enabled and not safe:
                raise Refused(f"trading is {bar['trading_state']}")
            if not safe:
                check_signal(x, bar, state, s)
            if safe or x["type"] == "exit":
                for o in state.orders:
                    order_event("cancelled", o, reason=f"superseded by {x['type']}")
                state.orders, open_before = [], []
            o = {"id": f"o-{name}", "signal": f"s-{name}", "ts": bar["ts"]} | x
            state.orders.append(o)
            order_event("created", o)
        except Refused as e:
            event("error", "refused", ref=f"s-{name}", side=side, size=x["size"], price=x["price"], reason=str(e))
            if not s.continue_on_error:
                raise

    left = []
    for o in state.orders:
        if (s.fill_delay and not any(o is x for x in open_before)) or not (enabled or o["type"] in ("stop", "risk")):
            left.append(o)
            continue
        why = becomes_taker(o, bar, s) if o["order_type"] == "maker" else ""
        if why:
            o["order_type"] = "taker"
            order_event("converted", o, reason=why)
        price = close if o["order_type"] == "taker" else limit_fill(o, bar)
        if price is None:
            moved = bar[f"{SIDES[o['side']]}_limit"]
            if abs(moved - o["price"]) / o["price"] > s.price_update_threshold:
                o["price"] = moved
                order_event("repriced", o)
            left.append(o)
            continue
        maker = o["order_type"] == "maker"
        fees = o["size"] * price * (s.maker_fee_bps if maker else s.taker_fee_bps) / 1e4
        fill(state, o["side"], o["size"], price, fees, maker)
        order_event("filled", o, price=price)
        event("trade", o["type"], id=f"t-{o['id'][2:]}", ref=o["id"], side=SIDES[o["side"]], order_type=o["order_type"], size=o["size"], price=price, fees=fees, is_maker=maker, params=o["params"])
    state.orders = left
    state.mark(close)
    pnl = state.realized + state.unrealized(close)
    if state.last_pnl is not None and state.equity > 0:
        state.returns.append((pnl - state.last_pnl) / state.equity)
    state.last_pnl = pnl
    event("state", bar["trading_state"], size=state.size, price=close, entry=state.entry, realized=state.realized, unrealized=state.unrealized(close), maker_fees=state.maker_fees, taker_fees=state.taker_fees, equity=state.equity, leverage=min(state.leverage(close), 1e9), drawdown=state.drawdown(), volatility=state.volatility())
    return rows


EVENTS = "symbol string, ts timestamp_ntz, seq int, kind string, name string, id string, ref string, side string, order_type string, size double, price double, fees double, is_maker boolean, reason string, entry double, realized double, unrealized double, maker_fees double, taker_fees double, equity double, leverage double, drawdown double, volatility double, params map<string,double>"
_KINDS = {"string": pa.string(), "timestamp_ntz": pa.timestamp("us"), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "map<string,double>": pa.map_(pa.string(), pa.float64())}
_ARROW = pa.schema([(n, _KINDS[k]) for n, k in (f.rsplit(" ", 1) for f in EVENTS.split(", "))])
#: Columns that the fold reads.
READS = ["symbol", "ts", "close", "gate", "trading_state", "low_bid", "low_ask", "close_bid", "close_ask", "high_bid", "high_ask", *[f"{side}_{what}" for side in SIDES.values() for what in ("limit", "urgency")]]


def prepared(bars: DataFrame, s: Settings) -> DataFrame:
    """bars with everything that the fold takes from a bar alone."""
    return quotes(book(signal_gate(trading_state(bars, s), s), s), s)


def replay(bars: DataFrame, s: Settings = Settings(), strategy: Strategy | None = None, features: tuple[str, ...] = ("line", "signal", "hist", "z_week", "z_month")) -> DataFrame:
    """All events of a backtest, as EVENTS: signals, orders, trades, errors and a state for each bar.

    Bars of a symbol follow one another through one fold, batch by batch, so a
    task holds one batch and the state; symbols are dealt over tasks. Bars whose
    close is NULL are left out.
    """
    strategy = strategy or MacdStrategy()
    rows = prepared(bars, s).where("close is not null").select(*READS, *features).repartition("symbol").sortWithinPartitions("symbol", "ts")

    def fold(batches):
        symbol, state = None, None
        for batch in batches:
            out = []
            for bar in batch.to_pylist():
                if state is None or bar["symbol"] != symbol:
                    symbol, state = bar["symbol"], State(s.position_size)
                for n, row in enumerate(step(state, bar, s, strategy)):
                    row["params"] = list(row.get("params", {}).items())
                    out.append({"symbol": symbol, "ts": bar["ts"], "seq": n} | row)
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return rows.mapInArrow(fold, EVENTS)


def states(events: DataFrame) -> DataFrame:
    return events.where("kind = 'state'").select("symbol", "ts", F.col("price").alias("close"), "size", "entry", "realized", "unrealized", "maker_fees", "taker_fees", "equity", "leverage", "drawdown", "volatility", F.col("name").alias("trading_state"), F.greatest(F.col("size"), F.lit(0.0)).alias("long_size"), F.greatest(-F.col("size"), F.lit(0.0)).alias("short_size"))


def trades(events: DataFrame) -> DataFrame:
    return events.where("kind = 'trade'").select("symbol", "ts", F.col("id").alias("trade_id"), F.col("ref").alias("order_id"), "side", "size", "price", "fees", "is_maker", F.col("name").alias("trade_type"), "params")


def orders(events: DataFrame) -> DataFrame:
    """Each order with its last status, when it was made and last changed, and why."""
    o = events.where("kind = 'order'").withColumn("at", F.struct("ts", "seq"))
    return o.groupBy("symbol", F.col("id").alias("order_id")).agg(F.max_by("name", "at").alias("status"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.max_by("price", "at").alias("price"), F.first("size").alias("size"), F.first("side").alias("side"), F.max_by("order_type", "at").alias("order_type"), F.count_if(F.col("name") == "repriced").alias("repriced"), F.max_by("reason", F.when(F.col("reason").isNotNull(), F.col("at"))).alias("reason"))


def signals(events: DataFrame) -> DataFrame:
    """Signals with the edge of their price against the bar's close, in basis points."""
    closes = states(events).select("symbol", "ts", "close")
    rows = events.where("kind = 'signal'").join(closes, ["symbol", "ts"])
    sign = F.when(F.col("side") == "buy", 1).otherwise(-1)
    return rows.select("symbol", "ts", F.col("id").alias("signal_id"), F.col("name").alias("signal_type"), "side", "size", F.col("price").alias("limit_price"), "order_type", ((F.col("close") - F.col("price")) * sign / F.col("close") * 1e4).alias("edge_bps"), "params")


def errors(events: DataFrame) -> DataFrame:
    return events.where("kind = 'error'").select("symbol", "ts", F.col("ref").alias("signal_id"), F.col("reason"), "side", "size", "price")


def position_changes(events: DataFrame) -> DataFrame:
    """States whose size differs from the bar before: what a log of position updates shows."""
    s = states(events).withColumn("before", F.coalesce(lag("size"), F.lit(0.0)))
    return s.where("size <> before").select("symbol", "ts", "before", "size", "entry", "realized", "equity", "leverage")
