"""Queries of the feature groups with their SQL, written as steps: each adds columns to those before."""

import math

from pyspark.sql import functions as F

from ..operators import features, regimes, trading
from ..sources import bars as src
from .registry import BARS, DAILY, E, FUNDING, O, YEAR, crs, dv, fl, lg, pc, query, rl, rw, sh, since

ZS = (168, 720)


class Steps:
    """SQL as a chain of common table expressions."""

    def __init__(self, *ctes: str, last: str = "s"):
        self.ctes, self.last = list(ctes), last

    def add(self, **columns: str) -> "Steps":
        name = f"t{len(self.ctes)}"
        self.ctes.append(f"{name} AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in columns.items())} FROM {self.last})")
        self.last = name
        return self

    def z(self, names: list[str]) -> "Steps":
        self.add(**{f"{n}__{k}": f"{f}({n}) {E}" for n in names for k, f in (("n", "count"), ("m", "avg"), ("s", "stddev_samp"))})
        return self.add(**{f"{n}_z{p}": f"coalesce(CASE WHEN {n}__n >= {p} AND {n}__s >= 1e-12 THEN ({n} - {n}__m) / {n}__s END, 0.0)" for n in names for p in ZS})

    def sql(self, names: list[str], whole: set[str] = frozenset()) -> str:
        shown = ", ".join(f"{n} AS {n}" if n in whole else f"round({n}, 6) AS {n}" for n in names)
        return f"WITH {', '.join(self.ctes)} SELECT symbol, ts, {shown} FROM {self.last}"


def zs(names) -> list[str]:
    return [f"{n}_z{p}" for n in names for p in ZS]


def q(expr: str) -> str:
    return f"({expr})"


def pct(part: str, whole: str) -> str:
    return f"({dv(part, whole)} * 100)"


def even(expr: str, digits: int) -> str:
    return f"round_even({expr}, {digits})"


TR = f"greatest(high - low, abs(high - {lg('close')}), abs(low - {lg('close')}))"
LOW, HIGH = (20, 30, 40), (60, 70, 80)


def bands(period: int) -> str:
    sig, lev = (1, 2, 3, 4), {"1p8": 1.8, "2p0": 2.0, "2p5": 2.5, "3p0": 3.0}
    s = Steps(BARS, sh("high low close")).add(mean=rl("avg", "close", period), sd=rl("stddev_samp", "close", period), tr=TR).add(atr=rl("avg", "tr", period), ivol=f"{dv('sd', 'mean')} * {YEAR}::DOUBLE")
    cols, ints = {"atr_pct": even(pct("atr", "close"), 4)}, set()
    for k in sig:
        up, down = f"(mean + {k} * sd)", f"(mean - {k} * sd)"
        cols |= {f"upper_{k}": up, f"lower_{k}": down, f"width_{k}": pct(f"{up} - {down}", "mean"), f"position_{k}": even(pct(f"close - {down}", f"{up} - {down}"), 2), f"to_upper_{k}": even(pct(f"{up} - close", "close"), 4), f"to_lower_{k}": even(pct(f"close - {down}", "close"), 4), f"touch_up_{k}": fl(f"high >= {up}"), f"touch_down_{k}": fl(f"low <= {down}")}
        ints |= {f"touch_up_{k}", f"touch_down_{k}"}
    for k, v in lev.items():
        for name, half in (("atr", f"(atr * {v}::DOUBLE)"), ("ivol", f"(mean * ivol * {v}::DOUBLE)")):
            cols |= {f"{name}_upper_{k}": f"mean + {half}", f"{name}_lower_{k}": f"mean - {half}", f"{name}_position_{k}": even(pct(f"close - (mean - {half})", f"(mean + {half}) - (mean - {half})"), 2)}
    later = {f"since_{side}_{k}": since(f"touch_{side}_{k} = 1") for k in sig for side in ("up", "down")}
    names = [*[f"{m}_{k}" for k in sig for m in ("width", "position")], "atr", "ivol"]
    return s.add(**cols).add(**later).z(names).sql(["mean", "sd", "tr", "atr", "ivol", *cols, *later, *zs(names)], ints | set(later))


for _p in (20, 10, 14, 30):
    query("bollinger" if _p == 20 else f"bollinger_{_p}", lambda b, p=_p: features.bollinger(b, p), bands(_p))


def levels(s: Steps, c: str) -> tuple[list[str], set[str]]:
    cols, ints = {}, set()
    for v in (*LOW, *HIGH):
        there = f"{c} <= {v}" if v in LOW else f"{c} >= {v}"
        cols |= {f"{c}_at_{v}": fl(there), f"{c}_since_{v}": since(there), f"{c}_beyond_{v}": f"CASE WHEN {c} IS NOT NULL THEN {'least' if v in LOW else 'greatest'}({c} - {v}, 0.0) END"}
        ints |= {f"{c}_at_{v}", f"{c}_since_{v}"}
    s.add(**cols)
    return list(cols), ints


def strength(period: int) -> str:
    s = Steps(BARS, sh("close")).add(d=f"close - {lg('close')}").add(g=rl("avg", "CASE WHEN d > 0 THEN d ELSE 0.0 END", period), l=rl("avg", "CASE WHEN d < 0 THEN -d ELSE 0.0 END", period))
    s.add(rsi="CASE WHEN l = 0 THEN CASE WHEN g > 0 THEN 100.0 END ELSE 100 - 100 / (1 + g / nullif(l, 0)) END::DOUBLE").add(change=f"rsi - {lg('rsi')}")
    names, ints = levels(s, "rsi")
    return s.z(["rsi", "change"]).sql(["rsi", "change", *names, *zs(["rsi", "change"])], ints)


for _p in (14, 7, 21):
    query("rsi" if _p == 14 else f"rsi_{_p}", lambda b, p=_p: features.rsi(b, p), strength(_p))


def place(k: int) -> str:
    low, high = q(rl("min", "low", k)), q(rl("max", "high", k))
    s = Steps(BARS, sh("high low close")).add(raw=dv(f"100 * (close - {low})", f"{high} - {low}")).add(k=rl("avg", "raw", 3)).add(d=rl("avg", "k", 3)).add(x=crs("k", "d", lg("k"), lg("d")))
    s.add(since_up=since("x = 1"), since_down=since("x = -1"), k_change=f"k - {lg('k')}", d_change=f"d - {lg('d')}")
    a, ints = levels(s, "k")
    b, more = levels(s, "d")
    names = ["k", "d", "k_change", "d_change"]
    text = s.z(names).sql([*names, "since_up", "since_down", *a, *b, *zs(names)], ints | more | {"since_up", "since_down"})
    return text.replace("SELECT symbol, ts, round(k, 6)", 'SELECT symbol, ts, x AS "cross", round(k, 6)')


for _p in (12, 5, 8, 21):
    query("stochastic" if _p == 12 else f"stochastic_{_p}", lambda b, p=_p: features.stochastic(b, p), place(_p))


def folded(x: str, span: int) -> str:
    return f"list_reduce({x}, lambda a, v: a + 2.0::DOUBLE / {span + 1} * (v - a))"


def macd_steps(fast: int, slow: int, signal: int) -> Steps:
    w = f"OVER ({O} ROWS UNBOUNDED PRECEDING)"
    e = f"e AS (SELECT symbol, ts, list(close) {w} AS x FROM s WHERE close IS NOT NULL)"
    line = f"line AS (SELECT s.symbol, s.ts, s.rn, {folded('x', fast)} - {folded('x', slow)} AS line FROM s LEFT JOIN e ON s.symbol = e.symbol AND s.ts = e.ts)"
    g = f"g AS (SELECT symbol, ts, list(line) {w} AS x FROM line WHERE line IS NOT NULL)"
    m = f"m AS (SELECT l.*, {folded('x', signal)} AS signal FROM line l LEFT JOIN g ON l.symbol = g.symbol AND l.ts = g.ts)"
    s = Steps(BARS, sh("close"), e, line, g, m, last="m").add(hist="line - signal")
    s.add(crossed=crs("line", "signal", lg("line"), lg("signal")), zero_cross=crs("line", "0", lg("line"), "0"), **{f"{c}_change": f"{c} - {lg(c)}" for c in ("line", "signal", "hist")})
    return s.add(since_up=since("crossed = 1"), since_down=since("crossed = -1"), since_zero_up=since("zero_cross = 1"), since_zero_down=since("zero_cross = -1")).z(MACD)


MACD = ["line", "signal", "hist", "line_change", "signal_change", "hist_change"]
SINCE = ["since_up", "since_down", "since_zero_up", "since_zero_down"]


def means(fast: int, slow: int, signal: int) -> str:
    text = macd_steps(fast, slow, signal).sql([*MACD, "zero_cross", *SINCE, *zs(MACD)], {"zero_cross", *SINCE})
    return text.replace("SELECT symbol, ts, round(line, 6)", 'SELECT symbol, ts, crossed AS "cross", round(line, 6)')


for _p in ((12, 26, 9), (8, 21, 5), (21, 55, 9), (5, 35, 5)):
    query("macd" if _p == (12, 26, 9) else "macd_" + "_".join(map(str, _p)), lambda b, p=_p: features.macd(b, *p), means(*_p))


def _with_close(b):
    return features.macd(b).withColumnRenamed("hist_z168", "z_hist").join(b.select("symbol", "ts", "close"), ["symbol", "ts"])


_m = macd_steps(12, 26, 9)
_enter = "abs(hist) >= 0.0001 AND abs(hist_z168) <= 2 AND ((hist > 0 AND line > signal) OR (hist < 0 AND line < signal))"
query("macd_entry", lambda b: trading.macd_entry(_with_close(b)), f"WITH {', '.join(_m.ctes)}, n AS (SELECT y.*, b.close AS price, coalesce({_enter}, false) AS e FROM {_m.last} y JOIN bars b ON b.symbol = y.symbol AND b.ts = y.ts) SELECT symbol, ts, e::INTEGER AS enter, CASE WHEN e THEN CASE WHEN hist > 0 THEN 'buy' ELSE 'sell' END END AS side, round(CASE WHEN e THEN 1000.0::DOUBLE / price * least(abs({dv('hist', 'line')}), 1.0) * sign(hist) END, 6) AS target FROM n")


def candle(doji: float, wick: float, period: int) -> str:
    s = Steps(BARS, sh("open high low close volume")).add(body="close - open", size="abs(close - open)", upper="high - greatest(open, close)", lower="least(open, close) - low", range="high - low").add(ms=f"avg(size) {rw(period)}")
    b1, b2, c1, c2, o1 = lg("body"), lg("body", 2), lg("close"), lg("close", 2), lg("open")
    flags = {
        "doji": f"size <= ms * {doji}::DOUBLE", "hammer": f"lower > size * {wick}::DOUBLE AND upper < size AND body > 0", "star": f"upper > size * {wick}::DOUBLE AND lower < size AND body < 0",
        "bull_engulfing": f"{b1} < 0 AND body > 0 AND open <= {c1} AND close >= {o1}", "bear_engulfing": f"{b1} > 0 AND body < 0 AND open >= {c1} AND close <= {o1}",
        "three_white": f"body > 0 AND {b1} > 0 AND {b2} > 0 AND close > {c1} AND {c1} > {c2}", "three_black": f"body < 0 AND {b1} < 0 AND {b2} < 0 AND close < {c1} AND {c1} < {c2}",
    }
    s.add(**{k: fl(v) for k, v in flags.items()})
    s.add(hammer_strength=f"CASE WHEN hammer = 1 THEN {dv('lower', 'size')} ELSE 0.0 END", star_strength=f"CASE WHEN star = 1 THEN {dv('upper', 'size')} ELSE 0.0 END", bullish_count=f"(sum(greatest(hammer, bull_engulfing, three_white)) {rw(period)})::DOUBLE", bearish_count=f"(sum(greatest(star, bear_engulfing, three_black)) {rw(period)})::DOUBLE", intensity=dv("volume", q(rl("avg", "volume", period))))
    names = ["hammer_strength", "star_strength", "bullish_count", "bearish_count", "intensity", "cluster"]
    return s.add(cluster="bullish_count + bearish_count").z(names).sql(["body", "size", "upper", "lower", "range", *flags, *names, *zs(names)], set(flags))


query("candles", features.candles, candle(0.1, 2.0, 20))
query("candles_30", lambda b: features.candles(b, 0.15, 2.5, 30), candle(0.15, 2.5, 30))

_W = (1, 4, 12, 24, 48, 72, 168)
_s = Steps(BARS, f"s AS (SELECT symbol, ts, {lg('quote_volume')} AS v, {lg('taker_buy_quote_volume')} AS b FROM bars)")
_s.add(**{k: v for w in _W for k, v in {f"sum_{w}": f"sum(v) {rw(w)}", f"buy_{w}": f"sum(b) {rw(w)}", f"ratio_{w}": f"sum(b) {rw(w)} / (sum(v) {rw(w)} + 1e-10)", f"peak_{w}": f"max(v) {rw(w)} / (avg(v) {rw(w)} + 1e-10)"}.items()})
_s.add(**{f"momentum_{w}": f"{pc('v', w)} * (ratio_{w} - 0.5)" for w in _W}).add(**{f"acceleration_{w}": pc(f"momentum_{w}") for w in _W})
_n = [f"{k}_{w}" for w in _W for k in ("sum", "buy", "ratio", "peak", "momentum")]
# The acceleration divides by a momentum that is 0 up to rounding where the share is a half, so both sides compare it where the momentum before is over 1e-9.
_acc = {f"acceleration_{w}": f"CASE WHEN abs({lg(f'momentum_{w}')}) > 1e-9 THEN acceleration_{w} END" for w in _W}
query("volume_rolling", lambda b: _accelerated(features.volume_rolling(b)), f"WITH {', '.join(_s.ctes)} SELECT symbol, ts, " + ", ".join(f"round({n}, 6) AS {n}" for n in _n) + ", " + ", ".join(f"round({v}, 6) AS {k}" for k, v in _acc.items()) + f" FROM {_s.last}")


def _accelerated(df):
    from ..functions.win import lag

    return df.withColumns({f"acceleration_{w}": F.when(F.abs(lag(f"momentum_{w}")) > 1e-9, F.col(f"acceleration_{w}")) for w in _W})


_P, _W3 = (5, 10, 20, 50), (24, 72, 168)
_s = Steps(BARS, sh("quote_volume taker_buy_quote_volume")).add(r=dv("taker_buy_quote_volume", "quote_volume"), **{f"sum_{p}": rl("sum", "quote_volume", p) for p in _P})
_v = {k: v for p in _P for k, v in {f"volume_{p}": pc("quote_volume", p), f"buy_ratio_{p}": pc("r", p), f"total_{p}": pc(f"sum_{p}")}.items()}
_v |= {k: v for w in _W3 for k, v in {f"relative_{w}": dv("quote_volume", q(rl("avg", "quote_volume", w))), f"buy_relative_{w}": dv("taker_buy_quote_volume", q(rl("avg", "taker_buy_quote_volume", w)))}.items()}
query("volume_momentum", features.volume_momentum, _s.add(**_v).z(list(_v)).sql([*_v, *zs(_v)]))


def vwap(period: int) -> str:
    s = Steps(BARS, "s AS (SELECT symbol, ts, close, quote_volume AS v, (high + low + close) / 3 AS tp FROM bars)").add(vwap=dv(q(rl("sum", "tp * v", period)), q(rl("sum", "v", period))))
    s.add(sd=f"sqrt({dv(q(rl('sum', '(tp - vwap) * (tp - vwap) * v', period)), q(rl('sum', 'v', period)))})")
    cols = {k: v for m in (1.0, 1.5, 2.0, 2.5, 3.0) for t in [str(m).replace(".", "p")] for k, v in {f"upper_{t}": f"vwap + {m}::DOUBLE * sd", f"lower_{t}": f"vwap - {m}::DOUBLE * sd", f"position_{t}": dv("close - vwap", f"{m}::DOUBLE * sd")}.items()}
    return s.add(**cols).sql(["vwap", "sd", *cols])


for _p in (20, 5, 8, 10, 12, 14, 21, 26, 30, 50, 55, 100, 200):
    query("vwap_bands" if _p == 20 else f"vwap_{_p}", lambda b, p=_p: features.vwap(b, p), vwap(_p))

_LV = {"major": (40.0, 50.0, 60.0, 70.0), "minor": (10.0, 20.0, 30.0, 45.0, 55.0)}
_c = f"OVER ({O} ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING)"
_f = {}
for _k, _vals in _LV.items():
    _l = "[" + ", ".join(f"{v}::DOUBLE" for v in _vals) + "]"
    _f |= {f"{_k}_up": f"list_min(list_filter({_l}, lambda v: v > close))", f"{_k}_down": f"list_max(list_filter({_l}, lambda v: v < close))", f"{_k}_cluster": f"CASE WHEN close IS NULL THEN 0 ELSE len(list_filter({_l}, lambda v: v >= close * (1 - 0.01::DOUBLE) AND v <= close * (1 + 0.01::DOUBLE))) END::INTEGER"}
_f |= {"resistance": f"CASE WHEN count(high) {_c} >= 20 THEN max(high) {_c} END", "support": f"CASE WHEN count(low) {_c} >= 20 THEN min(low) {_c} END"}
_lv = ["major_up", "major_down", "minor_up", "minor_down", "resistance", "support"]
_touch = lambda n: fl(f"low <= {n} * (1 + 0.01::DOUBLE) AND high >= {n} * (1 - 0.01::DOUBLE)")
_s = Steps(BARS, sh("high low close")).add(**_f).add(**{f"to_{n}": even(pct(f"{n} - close", "close"), 4) for n in _lv}, **{f"t_{n}": _touch(n) for n in _lv}).add(**{f"{n}_strength": rl("sum", f"t_{n}", 20) for n in _lv})
query("price_levels", lambda b: features.price_levels(b, major=_LV["major"], minor=_LV["minor"]), _s.z([f"to_{n}" for n in _lv]).sql([*_f, *[f"to_{n}" for n in _lv], *[f"{n}_strength" for n in _lv], *zs([f"to_{n}" for n in _lv])], {"major_cluster", "minor_cluster"}))


def structure(p: int) -> str:
    around, past, near, wide = (f"OVER ({O} ROWS BETWEEN {a})" for a in (f"{p} PRECEDING AND {p} FOLLOWING", f"{2 * p} PRECEDING AND 1 PRECEDING", f"{p} PRECEDING AND 1 PRECEDING", f"{2 * p - 1} PRECEDING AND CURRENT ROW"))
    inside = f"rn > {p} AND rn <= n - {p}"
    s = Steps(BARS, sh("high low")).add(n="count(*) OVER (PARTITION BY symbol)").add(sh=fl(f"{inside} AND high = max(high) {around}"), sl=fl(f"{inside} AND low = min(low) {around}"))
    of = lambda f, c, m: f"{f}(CASE WHEN {m} = 1 THEN {c} END) {past}"
    late = f"rn > {2 * p}"
    kinds = {"hh": f"sh = 1 AND high > {of('max', 'high', 'sh')}", "lh": f"sh = 1 AND high < {of('min', 'high', 'sh')}", "ll": f"sl = 1 AND low < {of('min', 'low', 'sl')}", "hl": f"sl = 1 AND low > {of('max', 'low', 'sl')}"}
    s.add(**{k: fl(f"{late} AND {v}") for k, v in kinds.items()})
    span = f"(max(high) {around} - min(low) {around})"
    gap = {"high": f"(high - avg(high) {around})", "low": f"(avg(low) {around} - low)"}
    s.add(**{f"{side}_strength": f"CASE WHEN s{side[0]} = 1 AND {span} > 0 THEN {even(f'{gap[side]} / {span} * 100', 2)} ELSE 0.0 END" for side in ("high", "low")})
    strong = {f"strong_{side}_{t}": fl(f"{side}_strength > {v}::DOUBLE") for side in ("high", "low") for t, v in (("1p5", 1.5), ("2p0", 2.0), ("2p5", 2.5))}
    s.add(structure_break=f"CASE WHEN ll = 1 AND max(lh) {near} = 1 THEN -1 WHEN hh = 1 AND max(hl) {near} = 1 THEN 1 ELSE 0 END", trend=f"sign(sum(hh + hl) {wide} - sum(lh + ll) {wide})::INTEGER", **strong)
    whole = ["sh", "sl", *kinds, *strong, "structure_break", "trend"]
    return s.z(["high_strength", "low_strength"]).sql([*whole, "high_strength", "low_strength", *zs(["high_strength", "low_strength"])], set(whole))


for _p in (5, 10, 20, 50):
    query("market_structure" if _p == 5 else f"market_structure_{_p}", lambda b, p=_p: features.market_structure(b, p), structure(_p))

_R = (20, 50, 100)
_s = Steps(BARS, sh("high low close quote_volume")).add(s1=f"sign({pc('close')})::INTEGER", tr=TR).add(prev=f"last_value(CASE WHEN s1 <> 0 THEN s1 END IGNORE NULLS) OVER ({O} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
_s.add(island=f"sum({fl('s1 <> 0 AND (prev IS NULL OR s1 <> prev)')}) {E}").add(price="coalesce(sum(s1) OVER (PARTITION BY symbol, island ORDER BY ts ROWS UNBOUNDED PRECEDING), 0)::BIGINT")
_s.add(ended=fl(f"abs(lead(price) OVER ({O})) < abs(price)"), length="abs(price)").add(begun=lg("ended"))
_s.add(begin=f"coalesce(max(CASE WHEN begun = 1 THEN rn END) {E}, 1)").add(returns="CASE WHEN ended = 1 THEN coalesce((close / nullif(first_value(close) OVER (PARTITION BY symbol, begin ORDER BY ts), 0)) * 100 - 100, 0.0) ELSE 0.0 END")
_s.add(**{k: v for p in _R for k, v in {f"v_{p}": fl(f"tr > ({rl('avg', 'tr', p)}) * 1.5"), f"b_{p}": fl(f"quote_volume > ({rl('avg', 'quote_volume', p)}) * 1.5")}.items()})
_s.add(**{k: v for p in _R for k, v in {f"volatility_{p}": f"(sum(v_{p}) {E})::BIGINT", f"volume_{p}": f"(sum(b_{p}) {E})::BIGINT"}.items()}).add(**{f"combined_{p}": f"(volatility_{p} > 0 AND volume_{p} > 0)::INTEGER" for p in _R})
_hits = [f"{k}_{p}" for p in _R for k in ("volatility", "volume")]
query("streaks", features.streaks, _s.z(["length", "returns", *_hits]).sql(["price", "length", "returns", *_hits, *[f"combined_{p}" for p in _R], *zs(["length", "returns", *_hits])], {"price", "length", *_hits, *[f"combined_{p}" for p in _R]}))

_hl, _cc = f"ln({dv('high', 'low')})", f"ln({dv('close', lg('close'))})"
_VW, _VK = (24, 168, 720), ("parkinson", "gk", "tr", "weighted")
_s = Steps(BARS, sh("high low close quote_volume")).add(parkinson=f"sqrt({_hl} * {_hl} / {4 * math.log(2)!r}::DOUBLE)", g2=f"0.5::DOUBLE * {_hl} * {_hl} - {2 * math.log(2) - 1!r}::DOUBLE * {_cc} * {_cc}", tr=TR, busy=dv("quote_volume", q(rl("avg", "quote_volume", 24))))
_s.add(gk="CASE WHEN g2 >= 0 THEN sqrt(abs(g2)) END", weighted="tr * busy").add(**{f"{m}_{w}": rl("avg", m, w) for m in _VK for w in _VW})
_s.add(composite="list_avg([" + ", ".join(f"{m}_168" for m in _VK) + "])")
query("volatility", features.volatility, _s.z([*_VK, "composite"]).sql([*_VK, *[f"{m}_{w}" for m in _VK for w in _VW], "composite", *zs([*_VK, "composite"])]))


def _fixed_regimes(b):
    """Metrics of regimes by fixed bounds, as SQL can't fit a mixture."""
    s = features.volatility(b, (24, 168, 720)).select("symbol", "ts", F.try_divide("tr_24", "tr_168").alias("x"))
    s = s.withColumn("x_regime", F.when(F.col("x") < 0.95, 0).when(F.col("x") < 1.05, 1).when(F.col("x").isNotNull(), 2))
    found = regimes.regime_metrics(s, ["x"], 12)
    return found.select("symbol", "ts", F.col("x_regime").alias("regime"), *[F.col(f"x_regime_{m}").alias(m) for m in ("duration", "stability", "intensity", "transition_prob")])


_s = Steps(BARS, sh("high low close")).add(tr=TR).add(x=dv(q(rl("avg", "tr", 24)), q(rl("avg", "tr", 168)))).add(regime="CASE WHEN x < 0.95 THEN 0 WHEN x < 1.05 THEN 1 WHEN x IS NOT NULL THEN 2 END")
_s.add(changed=f"CASE WHEN regime IS NOT NULL THEN {fl('regime <> ' + lg('regime'))} END", fresh=f"(regime IS NOT NULL AND {lg('regime')} IS NULL)::INTEGER").add(run=f"sum(coalesce(changed, 0) + fresh) {E}")
_s.add(duration="CASE WHEN regime IS NOT NULL THEN row_number() OVER (PARTITION BY symbol, run ORDER BY ts) END::INTEGER", stability=f"1 - ({rl('avg', 'changed', 12)})", intensity="CASE WHEN regime IS NOT NULL THEN (x - avg(x) OVER (PARTITION BY symbol, regime)) / nullif(avg(x) OVER (PARTITION BY symbol, regime), 0) END", transition_prob=f"CASE WHEN count(changed) {rw(12)} >= 12 THEN (sum(changed) {rw(11)} + 1) / 12.0::DOUBLE END")
query("regime_metrics", _fixed_regimes, _s.sql(["regime", "duration", "stability", "intensity", "transition_prob"], {"regime", "duration"}))
query("regimes", regimes.regimes)
query("volume_profile", features.volume_profile)

_ff = {}
for _w in (8, 24, 72, 168):
    _sd = q(rl("stddev_samp", "fundingRate", _w))
    _ff |= {f"annual_{_w}": f"({rl('avg', 'fundingRate', _w)}) * 24 * 365", f"sd_{_w}": f"{_sd} * 10000", f"z_{_w}": f"CASE WHEN {_sd} > 1e-9 THEN (fundingRate - ({rl('avg', 'fundingRate', _w)})) / ({_sd} + 1e-10) END", f"skew_{_w}": f"CASE WHEN {_sd} > 1e-12 THEN {rl('skewness', 'fundingRate', _w)} END", f"positive_{_w}": rl("avg", "(fundingRate > 0)::INTEGER", _w)}


def _scaled_funding(r):
    """Rates are around 1e-4, so deviations are shown in basis points."""
    s = features.funding_features(r)
    return s.withColumns({f"sd_{w}": F.col(f"sd_{w}") * 10000 for w in (8, 24, 72, 168)} | {f"z_{w}": F.when(F.col(f"sd_{w}") > 1e-9, F.col(f"z_{w}")) for w in (8, 24, 72, 168)})


query("funding", _scaled_funding, Steps(FUNDING, last="rates").add(**_ff).sql(list(_ff)), src.funding)

_L, _RW = (1, 2, 3, 4, 5, 10, 20, 50), (5, 10, 20, 50)
_s = Steps(BARS, sh("close")).add(**{k: v for n in _L for k, v in {f"log_{n}": f"ln({dv('close', lg('close', n))})", f"raw_{n}": f"{pc('close', n)} * 100"}.items()})
_rt = {f"pct_{n}": even(f"raw_{n}", 4) for n in _L} | {k: v for w in _RW for k, v in {f"vol_{w}": f"({rl('stddev_samp', 'log_1', w)}) * {YEAR}::DOUBLE", f"cum_log_{w}": rl("sum", "log_1", w), f"cum_pct_{w}": even(f"(({rl('product', '1 + log_1', w)}) - 1) * 100", 4)}.items()}
_zn = [*[f"log_{n}" for n in _L], *[f"raw_{n}" for n in _L], *[f"{k}_{w}" for w in _RW for k in ("vol", "cum_log", "cum_pct")]]
_txt = _s.add(**_rt).z(_zn).sql([*[f"log_{n}" for n in _L], *_rt, *zs(_zn)])
for _k in _L:
    for _z in ZS:
        _txt = _txt.replace(f"AS raw_{_k}_z{_z}, ", f"AS pct_{_k}_z{_z}, ") if _txt.count(f"AS raw_{_k}_z{_z}") == 1 else f"AS pct_{_k}_z{_z}".join(_txt.rsplit(f"AS raw_{_k}_z{_z}", 1))
query("returns", features.returns, _txt)

_BW = (24, 72, 168, 336, 720)
_j = f"j AS (SELECT a.symbol, a.ts, a.close, v.close AS bench FROM bars a LEFT JOIN bars v ON v.symbol = 'view' AND v.ts = a.ts WHERE a.symbol <> 'view'), s AS (SELECT symbol, ts, {lg('close')} AS close, {lg('bench')} AS bench FROM j)"
_s = Steps(BARS, _j).add(a=f"ln({dv('close', lg('close'))})", b=f"ln({dv('bench', lg('bench'))})", spread=f"ln({dv('close', 'bench')})").add(x="CASE WHEN b IS NOT NULL THEN a END", y="CASE WHEN a IS NOT NULL THEN b END")
_rel = {}
for _w in _BW:
    _en = f"CASE WHEN count(x) {rw(_w)} >= {_w} THEN "
    _rel |= {f"corr_{_w}": f"{_en} covar_samp(x, y) {rw(_w)} / nullif(stddev_samp(x) {rw(_w)} * stddev_samp(y) {rw(_w)}, 0) END", f"beta_{_w}": f"{_en} {dv(f'covar_samp(x, y) {rw(_w)}', f'var_samp(y) {rw(_w)}')} END", f"strength_{_w}": even(f"({pc('close', _w)} - {pc('bench', _w)}) * 100", 4), f"relative_vol_{_w}": f"{_en} {even(dv(f'stddev_samp(x) {rw(_w)}', f'stddev_samp(y) {rw(_w)}'), 4)} END"}
query("relationship", lambda b: features.relationship(b, "view"), _s.add(**_rel).z(["spread", *_rel]).sql(["spread", *_rel, *zs(["spread", *_rel])]))

_ax = {"range_pct": even(pct("high - low", "open"), 2), "body_pct": even(pct("close - open", "open"), 2), "upper_pct": even(pct("high - greatest(open, close)", "open"), 2), "lower_pct": even(pct("least(open, close) - low", "open"), 2)}
for _w in _BW:
    _ax |= {f"mean_{_w}": rl("avg", "close", _w), f"vs_mean_{_w}": pct("close", q(rl("avg", "close", _w))) + " - 100"}
_ax |= {f"change_{n}": pc("close", n) + " * 100" for n in (24, 168)}
_zn = ["close", "range_pct", "change_24", "change_168"]
query("aux_series", features.aux_series, Steps(DAILY, sh("open high low close")).add(**_ax).z(_zn).sql(["close", *_ax, *zs(_zn)]), src.daily)
_fg = {k: v for w in (24, 72, 168) for k, v in {f"mean_{w}": rl("avg", "value", w), f"vs_mean_{w}": f"value - ({rl('avg', 'value', w)})"}.items()} | {f"change_{n}": f"value - {lg('value', n)}" for n in (24, 168)}
_zn = ["value", "change_24", "change_168"]
query("fear_greed_features", lambda b: features.fear_greed_features(b.select("symbol", "ts", (F.col("trades") % 100).alias("value"))), Steps(DAILY, f"s AS (SELECT symbol, ts, lag(trades % 100) OVER ({O}) AS value FROM bars)").add(**_fg).z(_zn).sql(["value", *_fg, *zs(_zn)]), src.daily)


def _inside(b):
    spans = b.sparkSession.createDataFrame([("1995-03-01", "1996-01-31"), ("1998-05-01", "1999-01-31")], "a string, b string")
    return features.in_intervals(b, spans.select(F.col("a").cast("timestamp_ntz").alias("start"), F.col("b").cast("timestamp_ntz").alias("end"))).select("symbol", "ts", "inside")


query("interval_membership", _inside, f"WITH {DAILY} SELECT symbol, ts, (ts BETWEEN '1995-03-01' AND '1996-01-31' OR ts BETWEEN '1998-05-01' AND '1999-01-31')::INTEGER AS inside FROM bars", src.daily)

_seasons = {
    "quarter": "quarter(ts)",
    "is_weekend": "(isodow(ts) = 6 OR (isodow(ts) = 5 AND hour(ts) >= 23) OR (isodow(ts) = 7 AND hour(ts) < 17))::INTEGER",
    "first_friday": "(day(ts) <= 7 AND isodow(ts) = 5)::INTEGER",
    "session_asia": "(hour(ts) >= 22 OR hour(ts) < 7)::INTEGER",
}
_v = Steps(BARS, sh("quote_volume taker_buy_quote_volume")).add(**{f"_{k}": v for k, v in _seasons.items()})
for _k in _seasons:
    _over = f"OVER (PARTITION BY symbol, _{_k})"
    _v.add(**{f"{_k}_total": f"sum(quote_volume) {_over}", f"{_k}_buy": f"sum(taker_buy_quote_volume) {_over}", f"{_k}_concentration": f"max(quote_volume) {_over} / (avg(quote_volume) {_over} + 1e-10::DOUBLE)"})
    _v.add(**{f"{_k}_ratio": dv(f"{_k}_buy", f"{_k}_total")})
_zv = [f"{k}_{m}" for k in _seasons for m in ("total", "ratio", "concentration")]
query("volume_seasons", lambda b: features.volume_seasons(b, tuple(_seasons)), _v.z(_zv).sql([*[f"{k}_{m}" for k in _seasons for m in ("total", "buy", "ratio", "concentration")], *zs(_zv)]))
