"""Signals matched to orders and fills against plain Python, over pieces of time."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import analytics, matching

T0 = dt.datetime(2024, 1, 30)


def sequence(seed):
    rng, at, rows = random.Random(seed), T0, []
    for i in range(300):
        at += dt.timedelta(minutes=rng.choice([0, 3, 20, 90, 400]))
        rows.append((rng.choice(["a", "b", None]), at, 10 + i, rng.choice(["signal", "order", "fill", "fill"]), rng.choice([1, -1]), round(rng.uniform(5, 9), 2), float(rng.randrange(1, 5)), rng.random() < 0.5))
    return rows


def by_hand(rows, within):
    key = lambda r: (r[1], r[2])
    of = {k: [r for r in rows if r[3] == k] for k in ("signal", "order", "fill")}

    def last(marks, r):
        found = [m for m in marks if m[0] == r[0] and m[1] <= r[1]]
        best = max(found, key=key, default=None)
        return best if best is not None and r[1] - best[1] <= within else None

    first = {}
    for o in sorted(of["order"], key=key):
        s = last(of["signal"], o)
        if s is not None:
            first.setdefault(s[2], o)
    fills = {}
    for f in of["fill"]:
        o = last(list(first.values()), f)
        if o is not None:
            fills.setdefault(o[2], []).append(f)
    out = []
    for s in of["signal"]:
        o = first.get(s[2])
        mine = fills.get(o[2], []) if o else []
        size = sum(f[6] for f in mine)
        price = sum(f[6] * f[5] for f in mine) / size if mine else None
        out.append((s[0], s[1], s[2], o and o[2], len(mine), size, price, max((f[1] for f in mine), default=None), sum(f[7] for f in mine), (price - s[5]) / s[5] * s[4] * 1e4 if mine else None, int(not mine)))
    return sorted(out, key=lambda r: r[2])


def tables(spark, rows):
    e = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, id long, kind string, side int, price double, size double, is_maker boolean")
    return [e.where(F.col("kind") == k).drop("kind") for k in ("signal", "order", "fill")]


@pytest.mark.parametrize("seed", [1, 2])
def test_matched_by_hand(spark, seed):
    rows = sequence(seed)
    found = matching.matched(*tables(spark, rows), "6 hours").select("symbol", "ts", "id", "order_id", "n_fills", "filled", "fill_price", "fill_ts", "maker_fills", "slippage_bps", "missed")
    got, want = sorted((tuple(r) for r in found.collect()), key=lambda r: r[2]), by_hand(rows, dt.timedelta(hours=6))
    assert len(got) == len(want) and sum(r[-1] for r in want) not in (0, len(want))
    for r, w in zip(got, want):
        assert all(a == b or a == pytest.approx(b) for a, b in zip(r, w)), (r, w)


def test_execution_frame_by_hand(spark):
    """Two fills, a missed signal between them, and what the statistics make of it."""
    at = lambda h: T0 + dt.timedelta(hours=h)
    rows = [("a", at(0), 1, "signal", 1, 10.0, 0.0, False), ("a", at(1), 2, "order", 0, 0.0, 0.0, False), ("a", at(2), 3, "fill", 0, 11.0, 2.0, True), ("a", at(30), 4, "signal", 1, 12.0, 0.0, False), ("a", at(60), 5, "signal", -1, 12.0, 0.0, False), ("a", at(60), 6, "order", 0, 0.0, 0.0, False), ("a", at(61), 7, "fill", 0, 13.0, 1.0, False), ("a", at(62), 8, "fill", 0, 14.0, 1.0, True)]
    frame = matching.execution_frame(matching.matched(*tables(spark, rows), "6 hours")).orderBy("ts")
    assert [(r.coin_position_change, r.coin_position, r.trade_pnl, r.total_pnl, r.missed_signals, r.maker_trades) for r in frame.collect()] == [(2.0, 2.0, 0.0, 0.0, 0, 1), (0.0, 2.0, 0.0, 0.0, 1, None), (-2.0, 0.0, 5.0, 5.0, 0, 0)]
    s = analytics.trading_summary(frame).first()
    assert (s.total_pnl, s.total_trades, s.missed_trades, s.maker_rate, s.avg_trade_spacing, s.avg_trade_size) == (5.0, 2, 1, 50.0, 60.0, pytest.approx((22 + 27) / 2))
    assert s.avg_slippage_bps == pytest.approx((1000 + (13.5 - 12) / 12 * -1e4) / 2)
    assert matching.execution_frame(matching.matched(*[t.limit(0) for t in tables(spark, rows)])).count() == 0
