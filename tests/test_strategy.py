"""Replays worked out by hand, and the rules of execution and risk one by one."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewright.operators import analytics, strategy
from tidewright.operators.strategy import Settings, State

T0 = dt.datetime(2024, 1, 1)
EASY = Settings(signal_period="1h", position_size=1000.0, max_position_size_usd=5000.0, min_order_size_usd=1.0, simulated_spread_bps=0.0, max_spread_bps=0.0, taker_fee_bps=10.0, concentration_limit=5.0, use_momentum=False, use_stochastic_oscillator=False, use_dynamic_spread=False, rebalance_threshold=10.0)
COLUMNS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, line double, signal double, hist double, z_week double, z_month double"


def bars(spark, rows, symbol="a"):
    """rows of (low, high, close, hist)."""
    return spark.createDataFrame([(symbol, T0 + dt.timedelta(hours=i), *map(float, (c, h, lo, c, x, 0, x, 0, 0))) for i, (lo, h, c, x) in enumerate(rows)], COLUMNS)


def test_long_flip_and_short_by_hand(spark):
    got = strategy.replay(bars(spark, [(10, 10, 10, 1.0), (9, 12, 12, 1.0), (11, 12, 12, -1.0), (8, 12, 12, -1.0), (8, 8, 8, -1.0)]), EASY)
    s = strategy.states(got).orderBy("ts").collect()
    assert [r.size for r in s] == pytest.approx([100, 100, 0, -1000 / 12, -1000 / 12])
    assert s[1].unrealized == pytest.approx(200) and s[2].realized == pytest.approx(200) and s[2].taker_fees == pytest.approx(1.2)
    assert s[4].equity == pytest.approx(1000 + 200 - 1.2 + 4 * 1000 / 12) and s[4].short_size == pytest.approx(1000 / 12) and s[4].long_size == 0
    t = strategy.trades(got).orderBy("ts").collect()
    assert [(r.side, r.trade_type, r.is_maker) for r in t] == [("buy", "entry", True), ("sell", "exit", False), ("sell", "entry", True)]
    assert t[0].params == {"line": 1.0, "signal": 0.0, "hist": 1.0}
    assert strategy.position_changes(got).count() == 3
    o = {r.order_id: r for r in strategy.orders(got).collect()}
    assert len(o) == 3 and all(r.status == "filled" for r in o.values())
    assert sorted(r.edge_bps for r in strategy.signals(got).collect()) == pytest.approx([0, 0, 0])


def test_fill_accounting():
    s = State(1000.0)
    strategy.fill(s, 1, 10, 10.0, 1.0, True)
    strategy.fill(s, 1, 10, 20.0, 0.0, True)
    assert (s.size, s.entry) == (20, 15.0)
    strategy.fill(s, -1, 5, 25.0, 2.0, False)
    assert (s.size, s.entry, s.realized) == (15, 15.0, 50.0)
    strategy.fill(s, -1, 25, 5.0, 0.0, False)
    assert (s.size, s.entry, s.realized, s.maker_fees, s.taker_fees) == (-10, 5.0, -100.0, 1.0, 2.0)
    strategy.fill(s, 1, 10, 4.0, 0.0, False)
    assert (s.size, s.entry, s.realized) == (0, 0, -90.0)


def bar(**more):
    return {"symbol": "a", "ts": T0 + dt.timedelta(hours=5), "close": 10.0, "gate": False, "trading_state": "ENABLED", "low_bid": 9.0, "low_ask": 9.1, "close_bid": 10.0, "close_ask": 10.1, "high_bid": 11.0, "high_ask": 11.1, "buy_limit": 10.0, "sell_limit": 10.1, "buy_urgency": "", "sell_urgency": ""} | more


def quoted(spark, s, **more):
    """A bar with the quotes that Spark makes of it."""
    rows = spark.createDataFrame([({"close_bid": 10.0, "close_ask": 10.1, "exec_volatility": 0.0, "exec_stochastic": 0.5, "exec_momentum": 0.0} | more)])
    return bar(**strategy.quotes(rows, s).first().asDict())


def order(**more):
    return {"id": "o-1", "signal": "s-1", "ts": T0 + dt.timedelta(hours=4), "side": 1, "size": 5.0, "type": "entry", "order_type": "maker", "price": 10.0, "params": {}} | more


def test_limit_fills():
    assert strategy.limit_fill(order(), bar()) == 10.0
    assert strategy.limit_fill(order(price=8.0), bar()) is None and strategy.limit_fill(order(price=12.0), bar()) is None
    assert strategy.limit_fill(order(side=-1, price=10.5), bar()) == 10.5 and strategy.limit_fill(order(side=-1, price=8.5), bar()) is None


def test_conversion_to_taker(spark):
    s = Settings(taker_conversion_hours=2.0)
    why = lambda side=1, settings=s, **more: strategy.becomes_taker(order(side=side), quoted(spark, settings, **more), settings)
    assert why() == "" and strategy.becomes_taker(order(ts=T0), bar(), s) == "age"
    assert why(exec_volatility=0.03) == "volatility" and why(exec_volatility=0.02) == ""
    assert why(exec_momentum=0.02) == "momentum" and why(-1, exec_momentum=0.02) == "" and why(-1, exec_momentum=-0.02) == "momentum"
    assert why(exec_stochastic=0.05) == "stochastic" and why(-1, exec_stochastic=0.95) == "stochastic"
    assert why(exec_stochastic=0.1) == "" and why(-1, exec_stochastic=0.9) == ""
    assert why(exec_volatility=0.03, exec_momentum=0.02, exec_stochastic=0.05) == "volatility"
    none = Settings(use_dynamic_spread=False, use_momentum=False, use_stochastic_oscillator=False)
    assert why(settings=none, exec_volatility=0.03, exec_momentum=0.02, exec_stochastic=0.05) == ""


def test_new_limits_by_hand(spark):
    s = Settings(simulated_spread_bps=1.0, max_spread_bps=10.0)
    assert quoted(spark, s)["buy_limit"] == pytest.approx(10.0 * (1 - 0.0001 + min(0, 0.0002) * -1))
    b = quoted(spark, s, exec_volatility=0.01, exec_stochastic=0.1, exec_momentum=3.0)
    assert b["buy_limit"] == pytest.approx(10.0 * (1 - (0.0001 + 0.001 + 0.0001 - 0.0002)))
    assert b["sell_limit"] == pytest.approx(10.1 * (1 + 0.0001 + 0.001 + 0.0002))
    b = quoted(spark, s, exec_stochastic=0.9, exec_momentum=-1.0)
    assert b["buy_limit"] == pytest.approx(10.0 * (1 - (0.0001 + 0.0001))) and b["sell_limit"] == pytest.approx(10.1 * (1 + 0.0001 + 0.0001 - 0.0001))


def test_orders_wait_reprice_convert_and_cancel(spark):
    s = Settings(**{**EASY.__dict__, "fill_delay": True, "taker_conversion_hours": 3.0, "price_update_threshold": 0.1})
    got = strategy.replay(bars(spark, [(10, 10, 10, 1.0), (14, 15, 15, 0.0), (15, 15, 15, 0.0), (15, 15, 15, 0.0), (16, 16, 16, 0.0)]), s)
    names = [(r.ts.hour, r.name) for r in got.where("kind = 'order'").orderBy("ts", "seq").collect()]
    assert names == [(0, "created"), (1, "repriced"), (2, "filled")]
    state, made = State(1000.0, size=10.0, entry=10.0), []
    state.orders, state.peak = [order(price=1.0)], 5000.0
    for r in strategy.step(state, bar(), EASY, strategy.MacdStrategy()):
        made.append((r["kind"], r["name"], r.get("reason")))
    assert ("signal", "stop", None) in made and ("order", "cancelled", "superseded by stop") in made and ("trade", "stop", None) in made
    assert state.size == 0 and not state.orders


def test_refusals_and_leverage_cut():
    s = Settings(min_order_size_usd=100.0, max_position_size_usd=1000.0, max_leverage=2.0, concentration_limit=1.5)
    x = {"side": 1, "size": 5.0, "price": 10.0, "type": "entry", "order_type": "maker", "params": {}}
    state = State(1000.0)
    state.mark(10.0)
    for change, why in (({}, "order size"), ({"size": 50.0, "price": 11.0}, "limit price"), ({"size": 150.0}, "position size")):
        with pytest.raises(strategy.Refused, match=why):
            strategy.check_signal(x | change, bar(), state, s)
    strategy.check_signal(x | {"size": 90.0}, bar(), state, s)
    poor = State(300.0)
    poor.mark(10.0)
    with pytest.raises(strategy.Refused, match="leverage"):
        strategy.check_signal(x | {"size": 90.0}, bar(), poor, s)
    poor.size, poor.entry = 90.0, 10.0
    poor.mark(10.0)
    cut = strategy.risk_signals(bar(), poor, s)
    assert cut[0]["type"] == "risk" and cut[0]["side"] == -1 and cut[0]["size"] == pytest.approx(90 - 300 * 2 / 10)
    assert strategy.clamp_size(s, 300.0, 10.0, -90.0) == pytest.approx(-45.0)


def test_strategy_rules():
    m, s, state = strategy.MacdStrategy(), Settings(position_size=1000.0), State(1000.0)
    b = bar(line=2.0, signal=1.0, hist=1.0, z_week=0.0, z_month=0.0)
    assert m.target(b, state, s) == pytest.approx(50.0)
    assert [x["type"] for x in m.signals(b, state, s)] == ["entry"]
    assert not m.signals(b | {"hist": 1e-5}, state, s) and not m.signals(b | {"z_week": 2.5}, state, s) and not m.signals(b | {"z_month": 3.5}, state, s) and not m.signals(b | {"line": 0.5}, state, s)
    state.size = 40.0
    assert [(x["type"], x["size"]) for x in m.signals(b, state, s)] == [("rebalance", pytest.approx(10.0))]
    assert m.signals(b | {"hist": -1.0}, state, s)[0]["type"] == "exit" and m.signals(b | {"z_week": 3.5}, state, s)[0]["order_type"] == "taker"
    state.returns.extend([1.0, -1.0] * 10)
    assert m.signals(b, state, s)[0]["type"] == "risk"


def test_gates_refuse_and_runs_are_one_fold_each(spark):
    night = Settings(**{**EASY.__dict__, "trading_disabled_hours": ((0, 24),)})
    got = strategy.replay(bars(spark, [(10, 10, 10, 1.0)] * 3), Settings(**{**EASY.__dict__, "trading_disabled_datetime": (("2024-01-01", "2024-01-02"),)}))
    assert got.where("kind = 'trade'").count() == 0
    assert strategy.replay(bars(spark, [(10, 10, 10, 1.0)] * 3), night).where("kind = 'trade'").count() == 0
    both = bars(spark, [(10, 10, 10, 1.0), (9, 12, 12, 1.0)]).union(bars(spark, [(10, 10, 10, -1.0), (9, 12, 12, -1.0)], "b"))
    s = {(r.symbol, r.ts.hour): r for r in strategy.states(strategy.replay(both, EASY)).collect()}
    assert s["a", 1].unrealized == pytest.approx(200) and s["b", 1].realized == pytest.approx(-200) and s["b", 1].size == 0  # stopped
    assert strategy.replay(both.limit(0), EASY).count() == 0


def test_metrics_and_charts_of_a_run(spark):
    got = strategy.replay(bars(spark, [(10, 10, 10, 1.0), (9, 12, 12, 1.0), (11, 12, 12, -1.0), (8, 12, 12, -1.0), (8, 8, 8, -1.0)]), EASY)
    m = analytics.run_metrics(strategy.states(got), strategy.trades(got)).first()
    assert m.trade_count == 3 and m.maker_ratio == pytest.approx(2 / 3) and m.time_in_market == 0.8 and m.taker_fees == pytest.approx(1.2)
    assert m.total_pnl == pytest.approx(200 + 4000 / 12)
    charts = analytics.chart_frames(strategy.states(got), strategy.trades(got))
    assert charts["equity"].count() == 5 and charts["returns"].agg(F.sum("n")).first()[0] == 4 and charts["trades"].count() == 3


def test_settings():
    s = Settings.from_tree({"time": {"signal_period": "4h", "trading_hours": [9, 16], "trading_disabled_hours": [[3, 4]]}, "strategy": {"signal_period": 5, "position_size": 5.0}, "logging": {"level": "x"}})
    assert s.signal_period == "4h" and s.trading_hours == (9, 16) and s.position_size == 5.0
    for bad in ({"max_leverage": 0.0}, {"trading_days": ("someday",)}, {"signal_period": "90m"}, {"max_drawdown": 2.0}, {"max_order_size_usd": 1.0}):
        with pytest.raises(ValueError):
            Settings(**bad)
