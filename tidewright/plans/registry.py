"""Queries over the given tables, each with the SQL that it is held against where SQL can express it."""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


from ..functions import win
from ..functions.win import cross, diff, ewm, frame, lag, numbered, pct_change, roll, rounded, so_far, time_since, zscore
from ..operators import analytics, features, trading
from ..sources import bars as src

BARS = """bars AS (
  SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close,
    count(*)::DOUBLE AS volume, count(*)::DOUBLE AS trades, sum(value) AS quote_volume,
    sum(CASE WHEN coalesce(json_extract_string(props, '$.k')::INTEGER, 0) % 2 = 0 THEN value ELSE 0.0 END) AS taker_buy_quote_volume
  FROM events GROUP BY 1, 2)"""
DAILY = """bars AS (
  SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close,
    count(*)::DOUBLE AS volume, count(*)::DOUBLE AS trades, sum(o_totalprice) AS quote_volume, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0.0 END) AS taker_buy_quote_volume
  FROM orders GROUP BY 1, 2)"""
FUNDING = """rates AS (
  SELECT event_type AS symbol, date_trunc('day', ts)::TIMESTAMP + to_hours((hour(ts) // 8 * 8)::INTEGER) AS ts, (avg(coalesce(json_extract_string(props, '$.k')::INTEGER, 0)) - 50) / 10000 AS fundingRate
  FROM events GROUP BY 1, 2)"""
O = "PARTITION BY symbol ORDER BY ts"
E = f"OVER ({O} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
YEAR = repr(math.sqrt(252 * 24))


def rw(n: int) -> str:
    return f"OVER ({O} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def rl(fn: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {rw(n)} >= {n} THEN {fn}({x}) {rw(n)} END"


def z(x: str, least: int) -> str:
    return f"coalesce(CASE WHEN count({x}) {E} >= {least} AND stddev_samp({x}) {E} >= 1e-12 THEN ({x} - avg({x}) {E}) / stddev_samp({x}) {E} END, 0.0)"


def lg(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({O})"


def dv(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def pc(x: str, n: int = 1) -> str:
    return f"({dv(x, lg(x, n))} - 1)"


def fl(cond: str) -> str:
    return f"coalesce({cond}, false)::INTEGER"


def since(cond: str) -> str:
    return f"rn - max(CASE WHEN {cond} THEN rn END) {E}"


def crs(a: str, b: str, la: str, lb: str) -> str:
    return f"CASE WHEN {a} > {b} AND {la} <= {lb} THEN 1 WHEN {a} < {b} AND {la} >= {lb} THEN -1 ELSE 0 END"


def sh(columns: str) -> str:
    """CTE s: columns as of the row before, and the row number."""
    return "s AS (SELECT symbol, ts, " + ", ".join(f"{lg(c)} AS {c}" for c in columns.split()) + f", row_number() OVER ({O}) AS rn FROM bars)"


def out(names: dict[str, str], frm: str, doubles: str = "") -> str:
    """SELECT with the named doubles rounded."""
    d = set(doubles.split())
    return "SELECT symbol, ts, " + ", ".join(f"round({v}, 6) AS {k}" if k in d else f"{v} AS {k}" for k, v in names.items()) + f" FROM {frm}"


def same(names: str) -> dict[str, str]:
    return {n: n for n in names.split()}


Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, make, sql: str | None = None, source=src.hourly, exact: bool = False) -> None:
    """Register make(source(spark, sf_dir)). Doubles are rounded, unless each is made by the same few operations on both sides (exact)."""

    def run(spark, sf_dir: str) -> DataFrame:
        made = make(source(spark, sf_dir))
        return made if exact else rounded(made)

    run.__name__ = name
    Q[name] = run
    if sql:
        SQL[name] = sql.replace(", 6)", f" + {win.NUDGE}, 6)")


def tables(spark, sf_dir: str):
    return lambda name: src.table(spark, sf_dir, name)


OHLC = "open high low close volume trades quote_volume taker_buy_quote_volume"
query("bars_hourly", lambda b: b, f"WITH {BARS} " + out(same(OHLC), "bars", OHLC))
query("bars_daily_orders", lambda b: b, f"WITH {DAILY} " + out(same(OHLC), "bars", OHLC), src.daily)
query("date_range", lambda b: src.between(b, "2024-01-05", "2024-01-06").select("symbol", "ts", "close"), f"WITH {BARS} SELECT symbol, ts, round(close, 6) AS close FROM bars WHERE ts BETWEEN '2024-01-05' AND '2024-01-06'")
query("lookback_trim", lambda b: src.with_lookback(b, "2024-01-05", "2024-01-06", 48, lambda d: d.select("symbol", "ts", roll(F.avg, "close", 24).alias("mean"))), f"WITH {BARS}, w AS (SELECT * FROM bars WHERE ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-06'), r AS (SELECT symbol, ts, {rl('avg', 'close', 24)} AS mean FROM w) SELECT symbol, ts, round(mean, 6) AS mean FROM r WHERE ts >= '2024-01-05'")
query("lag_shift", lambda b: b.select("symbol", "ts", lag("close").alias("l1"), lag("close", 3).alias("l3")), f"WITH {BARS} " + out({"l1": lg("close"), "l3": lg("close", 3)}, "bars", "l1 l3"))
query("diff_pct_change", lambda b: b.select("symbol", "ts", diff("close").alias("d"), pct_change("close", 2).alias("p")), f"WITH {BARS} " + out({"d": f"close - {lg('close')}", "p": pc("close", 2)}, "bars", "d p"))
query("rolling_basic", lambda b: b.select("symbol", "ts", *[roll(f, "close", 24).alias(n) for f, n in ((F.avg, "mean"), (F.sum, "total"), (F.min, "low"), (F.max, "high"), (F.stddev_samp, "sd"), (F.var_samp, "var"))]), f"WITH {BARS} " + out({n: rl(f, "close", 24) for f, n in (("avg", "mean"), ("sum", "total"), ("min", "low"), ("max", "high"), ("stddev_samp", "sd"), ("var_samp", "var"))}, "bars", "mean total low high sd var"))
query("rolling_minperiods1", lambda b: b.select("symbol", "ts", F.avg("close").over(frame(20)).alias("mean"), F.sum("volume").over(frame(20)).alias("total")), f"WITH {BARS} " + out({"mean": f"avg(close) {rw(20)}", "total": f"sum(volume) {rw(20)}"}, "bars", "mean total"))
query("expanding_zscore", lambda b: b.select("symbol", "ts", zscore("close", 168).alias("z")), f"WITH {BARS} " + out({"z": z("close", 168)}, "bars", "z"))
query("time_since", lambda b: numbered(b).select("symbol", "ts", time_since(F.col("close") > 50).alias("n"), F.coalesce(time_since(F.col("close") > 50), F.count("*").over(Window.partitionBy("symbol"))).alias("m")), f"WITH {BARS}, s AS (SELECT *, row_number() OVER ({O}) AS rn FROM bars) SELECT symbol, ts, {since('close > 50')} AS n, coalesce({since('close > 50')}, count(*) OVER (PARTITION BY symbol)) AS m FROM s")
query("crossover", lambda b: b.select("symbol", "ts", cross("close", "open").alias("x")), f"WITH {BARS} SELECT symbol, ts, {crs('close', 'open', lg('close'), lg('open'))} AS x FROM bars")
query("rolling_corr_beta", lambda b: b.select("symbol", "ts", F.when(F.count("close").over(frame(24)) >= 24, win.corr("close", "volume", frame(24))).alias("corr"), F.when(F.count("close").over(frame(24)) >= 24, F.try_divide(F.covar_samp("close", "volume").over(frame(24)), F.var_samp("volume").over(frame(24)))).alias("beta")), f"WITH {BARS} " + out({"corr": f"CASE WHEN count(close) {rw(24)} >= 24 THEN covar_samp(close, volume) {rw(24)} / nullif(stddev_samp(close) {rw(24)} * stddev_samp(volume) {rw(24)}, 0) END", "beta": f"CASE WHEN count(close) {rw(24)} >= 24 THEN {dv(f'covar_samp(close, volume) {rw(24)}', f'var_samp(volume) {rw(24)}')} END"}, "bars", "corr beta"))
query("rolling_skew", lambda b: b.select("symbol", "ts", (roll(F.skewness, "close", 24) * (math.sqrt(24 * 23) / 22)).alias("skew")), f"WITH {BARS} " + out({"skew": rl("skewness", "close", 24)}, "bars", "skew"))
query("rolling_product", lambda b: b.select("symbol", "ts", roll(F.product, 1 + F.col("close") / 1000, 5).alias("p")), f"WITH {BARS} " + out({"p": rl("product", "1 + close / 1000", 5)}, "bars", "p"))
query("expanding_minmax", lambda b: b.select("symbol", "ts", F.max("high").over(so_far()).alias("top"), F.min("low").over(so_far()).alias("bottom"), F.avg("close").over(so_far()).alias("mean")), f"WITH {BARS} " + out({"top": f"max(high) {E}", "bottom": f"min(low) {E}", "mean": f"avg(close) {E}"}, "bars", "top bottom mean"))
query("ewm_span", lambda b: ewm(b.select("symbol", "ts", "close"), "close", [12]).select("symbol", "ts", "ewm_12"), f"WITH {BARS}, l AS (SELECT symbol, ts, list(close) {E} AS x FROM bars) SELECT symbol, ts, round(list_reduce(x, lambda a, v: a + 2.0::DOUBLE / 13 * (v - a)), 6) AS ewm_12 FROM l")
query("seasonality", lambda b: features.seasonality(b, {"fomc": ("2024-01-10", "2024-01-24")}), f"WITH {BARS} SELECT symbol, ts, quarter(ts)::INTEGER AS quarter, ((year(ts) - 2016) % 4 + 1)::INTEGER AS cycle_year, (isodow(ts) - 1)::INTEGER AS weekday, ((isodow(ts) = 5 AND hour(ts) >= 23) OR isodow(ts) = 6 OR (isodow(ts) = 7 AND hour(ts) < 17))::INTEGER AS is_weekend, (day(ts) <= 7 AND isodow(ts) = 5)::INTEGER AS first_friday, (hour(ts) >= 22 OR hour(ts) < 7)::INTEGER AS session_asia, (hour(ts) >= 8 AND hour(ts) < 16)::INTEGER AS session_london, (hour(ts) >= 14 AND hour(ts) < 21)::INTEGER AS session_us, (ts::DATE::VARCHAR IN ('2024-01-10', '2024-01-24'))::INTEGER AS is_fomc FROM bars")
query("volume_categorical", features.volume_by_season, f"WITH {BARS}, s AS (SELECT *, hour(ts)::INTEGER AS season FROM bars) " + out({"season": "season", "total": "sum(quote_volume) OVER p", "buy": "sum(taker_buy_quote_volume) OVER p", "ratio": "sum(taker_buy_quote_volume) OVER p / nullif(sum(quote_volume) OVER p, 0)", "concentration": "max(quote_volume) OVER p / nullif(avg(quote_volume) OVER p, 0)"}, "s WINDOW p AS (PARTITION BY symbol, season)", "total buy ratio concentration"))
query("funding_asof", lambda b: b, f"WITH {BARS}, {FUNDING} SELECT b.symbol, b.ts, round(b.close, 6) AS close, round(coalesce(r.fundingRate, -1.0), 6) AS fundingRate FROM bars b ASOF LEFT JOIN rates r ON b.symbol = r.symbol AND b.ts >= r.ts", lambda s, d: src.as_of(src.hourly(s, d).select("symbol", "ts", "close"), src.funding(s, d), "fundingRate", -1.0))
query("resample_ffill", lambda b: src.fill_hours(b, "close"), f"WITH {BARS}, g AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM bars GROUP BY symbol) SELECT g.symbol, g.ts, round(b.close, 6) AS close FROM g ASOF LEFT JOIN bars b ON g.symbol = b.symbol AND g.ts >= b.ts")
query("cycle", features.cycle, f"WITH {DAILY}, h AS (SELECT *, ts - INTERVAL 1 HOUR AS t0 FROM bars), b AS (SELECT *, CASE WHEN t0::DATE >= '2024-04-20' THEN DATE '2024-04-20' WHEN t0::DATE >= '2020-05-11' THEN DATE '2020-05-11' WHEN t0::DATE >= '2016-07-09' THEN DATE '2016-07-09' WHEN t0::DATE >= '2012-11-28' THEN DATE '2012-11-28' END AS last, CASE WHEN t0::DATE >= '2024-04-20' THEN DATE '2024-04-20' + 1460 WHEN t0::DATE >= '2020-05-11' THEN DATE '2024-04-20' WHEN t0::DATE >= '2016-07-09' THEN DATE '2020-05-11' WHEN t0::DATE >= '2012-11-28' THEN DATE '2016-07-09' ELSE DATE '2012-11-28' END AS next FROM h) SELECT symbol, ts, (floor((t0::DATE - last) / (next - last)::DOUBLE * 4) + 1)::INTEGER AS cycle_year, (next - t0::DATE)::INTEGER AS days_to_next, coalesce(t0 = last::TIMESTAMP, false)::INTEGER AS is_halving FROM b", src.daily)
_pnl = f"p AS (SELECT symbol, ts, close, sign({lg('close')} - {lg('close', 2)})::DOUBLE AS position FROM bars), q AS (SELECT *, coalesce(position * (close - {lg('close')}), 0.0) AS pnl FROM p), f AS (SELECT *, round(sum(pnl) {E}, 6) AS total FROM q)"
def _run(bars):
    """pnl_frame with totals rounded as in the SQL, so that both sides see the same peaks."""
    return analytics.pnl_frame(bars).withColumn("total", win.near("total"))


query("pnl_frame", _run, f"WITH {BARS}, {_pnl} " + out(same("close position pnl total"), "f", "close position pnl total"))
query("drawdown", lambda b: analytics.drawdowns(_run(b)), f"WITH {BARS}, {_pnl}, k AS (SELECT *, max(total) {E} AS peak FROM f), e AS (SELECT *, sum(CASE WHEN total < peak THEN 0 ELSE 1 END) {E} AS episode FROM k), r AS (SELECT symbol, episode, max(peak - total) AS fall, min(ts) AS a, count(*) AS n FROM e GROUP BY 1, 2), h AS (SELECT *, CASE WHEN n > 1 THEN (epoch(lead(a) OVER (PARTITION BY symbol ORDER BY episode)) - epoch(a)) / 3600 END AS hours FROM r) SELECT symbol, round(max(fall), 6) AS max_drawdown, round(coalesce(max(hours), 0.0), 6) AS longest_hours FROM h GROUP BY symbol")
_yr = repr(math.sqrt(365 * 24))
query("trade_stats", lambda b: analytics.trade_stats(_run(b)), f"WITH {BARS}, {_pnl} SELECT symbol, count(*) FILTER (pnl <> 0) AS trades, round(count(*) FILTER (pnl > 0) / nullif(count(*) FILTER (pnl <> 0), 0), 6) AS win_rate, round(sum(pnl) FILTER (pnl > 0) / nullif(-sum(pnl) FILTER (pnl < 0), 0), 6) AS profit_factor, round(max(pnl), 6) AS best, round(min(pnl), 6) AS worst, round(avg(pnl) / nullif(stddev_samp(pnl), 0) * {_yr}::DOUBLE, 6) AS sharpe, round(avg(pnl) / nullif(stddev_samp(pnl) FILTER (pnl < 0), 0) * {_yr}::DOUBLE, 6) AS sortino, round(quantile_cont(pnl, 0.05), 6) AS var_95 FROM f GROUP BY symbol")
query("equity_metrics", analytics.equity_metrics, f"WITH {BARS}, r AS (SELECT *, {pc('close')} AS r, close / nullif(max(close) {E}, 0) - 1 AS dd FROM bars), g AS (SELECT symbol, count(r) AS n, arg_max(close, ts) / nullif(arg_min(close, ts), 0) - 1 AS total_return, stddev_samp(r) AS sd, min(dd) AS dd FROM r GROUP BY symbol) SELECT symbol, n, round(total_return, 6) AS total_return, round(pow(1 + total_return, 252.0::DOUBLE / n) - 1, 6) AS annual_return, round(sd * {repr(math.sqrt(252))}::DOUBLE, 6) AS volatility, round(dd, 6) AS max_drawdown FROM g")
query("risk_windows", lambda b: analytics.risk_windows(_run(b)), f"WITH {BARS}, {_pnl}, w AS (SELECT symbol, ts, stddev_pop(pnl) {rw(20)} * {repr(math.sqrt(252))}::DOUBLE AS volatility, list(pnl) {rw(100)} AS x, quantile_cont(pnl, 0.05) {rw(100)} AS var_95 FROM f) SELECT symbol, ts, round(volatility, 6) AS volatility, round(var_95, 6) AS var_95, round(list_avg(list_filter(x, lambda v: v <= var_95)), 6) AS shortfall FROM w")
_FQ = ("open", "close", "quote_volume", "taker_buy_quote_volume")
query("feature_quality", lambda b: analytics.feature_quality(b, list(_FQ)), f"WITH {BARS}, t AS ({' UNION ALL '.join(f'''SELECT '{c}' AS feature, {c} AS x FROM bars''' for c in _FQ)}) SELECT feature, count(*) FILTER (x IS NULL) AS nulls, count(DISTINCT x) AS \"distinct\", round(min(x), 6) AS least, round(max(x), 6) AS greatest, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd FROM t GROUP BY 1")
query("correlations", lambda b: analytics.correlations(b, list(_FQ)), f"WITH {BARS} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{c}' AS b, round(covar_samp({a}, {c}) / nullif(stddev_samp({a}) * stddev_samp({c}), 0), 6) AS corr FROM bars" for i, a in enumerate(_FQ) for c in _FQ[i:]))
query("percentiles", lambda b: analytics.percentiles(b, "close"), f"WITH {BARS} SELECT symbol, " + ", ".join(f"round(quantile_cont(close, {p}), 6) AS p{round(100 * p)}" for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) + " FROM bars GROUP BY symbol")
query("histogram", lambda b: analytics.histogram(b, "close", 0.0, 100.0, 20), f"WITH {BARS} SELECT symbol, least(floor(close / 5.0::DOUBLE), 19)::INTEGER AS bin, count(*) AS n FROM bars WHERE close BETWEEN 0 AND 100 GROUP BY 1, 2")
_heat = "c AS (SELECT ts::DATE AS day, least(floor(value / 10.0::DOUBLE), 9)::INTEGER AS level, sum(value) AS v FROM events GROUP BY 1, 2), g AS (SELECT day, unnest(range(10))::INTEGER AS level FROM (SELECT DISTINCT day FROM c)), d AS (SELECT g.day, g.level, coalesce(c.v, 0.0) AS v FROM g LEFT JOIN c ON g.day = c.day AND g.level = c.level)"
query("heatmap_densify", analytics.heatmap, f"WITH {_heat} SELECT day, level, round(v, 6) AS v FROM d", lambda s, d: src.table(s, d, "events"))
query("heatmap_ffill", lambda e: analytics.heatmap_filled(analytics.heatmap(e), 40.0), f"WITH {_heat}, f AS (SELECT day, level, coalesce(last_value(CASE WHEN v <> 0 THEN v END IGNORE NULLS) OVER (PARTITION BY level ORDER BY day ROWS UNBOUNDED PRECEDING), 0.0) AS v FROM d) SELECT day, level, round(CASE WHEN v < 40 THEN 0.0 ELSE v END, 6) AS v FROM f", lambda s, d: src.table(s, d, "events"))
_cat = "k AS (SELECT symbol AS source, min(ts) AS start, max(ts) AS \"end\", count(*) AS n FROM bars GROUP BY symbol)"
query("catalog", analytics.catalog, f"WITH {BARS}, {_cat} SELECT source, start, \"end\", n, ((epoch(\"end\") - epoch(start)) / 3600 + 1 - n)::BIGINT AS missing FROM k")
query("catalog_overlap", lambda b: analytics.overlap(analytics.catalog(b)), f"WITH {BARS}, {_cat} SELECT max(start) AS start, min(\"end\") AS \"end\", count(*) AS sources FROM k")
query("signal_gate", trading.signal_gate, f"WITH {BARS} SELECT symbol, ts, ((epoch(ts)::BIGINT - 820454400) % 14400 = 0 AND hour(ts) BETWEEN 2 AND 20 AND isodow(ts) <= 5)::INTEGER AS gate FROM bars")
query("trading_state", trading.trading_state, f"WITH {BARS} SELECT symbol, ts, CASE WHEN hour(ts) >= 16 OR hour(ts) < 9 THEN 'DISABLED_OVERNIGHT' WHEN isodow(ts) >= 6 THEN 'DISABLED_WEEKEND' ELSE 'ENABLED' END AS state FROM bars")
_book = {"spread": "spread"} | {f"{x}_{s}": f"{x} * (1 {g} spread / 2)" for x in ("low", "close", "high") for s, g in (("bid", "-"), ("ask", "+"))} | {"volatility": dv(f"{lg('high')} - {lg('low')}", lg("close")), "stochastic": dv(f"{lg('close')} - {lg('low')}", f"{lg('high')} - {lg('low')}"), "momentum": f"{lg('close')} - {lg('open')}"}
query("book_prices", trading.book_prices, f"WITH {BARS}, s AS (SELECT *, least(0.0005::DOUBLE * (1 + 10 * {dv('high - low', 'close')}), 0.01::DOUBLE) AS spread FROM bars) " + out(_book, "s", " ".join(_book)))


query("backtest_replay", lambda b: trading.replay(b.withColumn("signal", F.coalesce(F.signum(lag("close") - lag("close", 2)).cast("int"), F.lit(0)))))


def queries() -> dict:
    from . import event_sql, feature_sql, more, session_sql  # noqa: F401  they add their queries when they are imported

    return dict(Q)


def oracle_sql() -> dict[str, str]:
    from . import event_sql, feature_sql, more, session_sql  # noqa: F401

    return dict(SQL)
