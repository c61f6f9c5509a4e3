"""More queries with their SQL: alignment, periods, statistics, catalog, gates and states, feature pipeline."""

from pyspark.sql import functions as F

from ..functions import names, periods
from ..operators import analytics, features, groups, strategy
from ..sources import bars as src
from ..sources import files
from .registry import BARS, E, O, _pnl, _run, _yr, dv, lg, pc, query, rw

RUN = strategy.Settings(trading_hours=(2, 20), trading_days=("monday", "tuesday", "wednesday", "thursday", "friday"), trading_disabled_hours=((22, 1), (11, 12)), trading_disabled_datetime=(("2024-01-10", "2024-01-11"),), allow_overnight=False, signal_start_day="tuesday", signal_start_hour=4)


def _even(b):
    return b.where(F.hour("ts") % 2 == 0).select("symbol", "ts", (F.col("close") + 1).alias("close"))


query("fill_index", lambda b: src.fill_index(b.select("symbol", "ts", "close"), _even(b), "close"), f"WITH {BARS} SELECT symbol, ts, round(CASE WHEN hour(ts) % 2 = 0 THEN close + 1 ELSE close END, 6) AS close FROM bars")
query("common_index", lambda b: src.common_index(b.select("symbol", "ts", "open"), _even(b), ["close"]), f"WITH {BARS} SELECT symbol, ts, round(open, 6) AS open, round(close + 1, 6) AS close FROM bars WHERE hour(ts) % 2 = 0")
query("outer_difference", lambda b: src.outer_difference(b.where(F.hour("ts") < 12), _even(b), "close"), f"WITH {BARS}, a AS (SELECT * FROM bars WHERE hour(ts) < 12), b AS (SELECT symbol, ts, close + 1 AS close FROM bars WHERE hour(ts) % 2 = 0) SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.ts, b.ts) AS ts, round(a.close - b.close, 6) AS close FROM a FULL JOIN b ON a.symbol = b.symbol AND a.ts = b.ts")
query("overlap_ratio", lambda b: src.overlap_ratio(b, b.where(F.col("ts") >= F.lit("2024-01-08").cast("timestamp_ntz"))), f"WITH {BARS}, a AS (SELECT symbol, min(ts) AS a0, max(ts) AS a1 FROM bars GROUP BY symbol), b AS (SELECT symbol, min(ts) AS b0, max(ts) AS b1 FROM bars WHERE ts >= '2024-01-08' GROUP BY symbol), r AS (SELECT a.symbol, CASE WHEN b0 IS NULL OR epoch(least(a1, b1)) < epoch(greatest(a0, b0)) THEN 0.0 WHEN a0 = a1 THEN 1.0 ELSE (epoch(least(a1, b1)) - epoch(greatest(a0, b0))) / (epoch(a1) - epoch(a0)) END AS ratio FROM a LEFT JOIN b ON a.symbol = b.symbol) SELECT symbol, round(ratio, 6) AS ratio, ratio < 0.9 AS warn FROM r")
query("coercion", lambda e: e.select("event_id", F.expr("try_cast(get_json_object(props, '$.k') AS int)").alias("k"), F.expr("try_cast(event_type AS double)").alias("bad")).dropna(subset=["k"]), "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k, try_cast(event_type AS DOUBLE) AS bad FROM events WHERE try_cast(json_extract_string(props, '$.k') AS INTEGER) IS NOT NULL", lambda s, d: src.table(s, d, "events"))
query("expected_rows", lambda b: b.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n")).select("symbol", periods.expected_rows("a", "b", "4h").alias("expected"), "n"), f"WITH {BARS} SELECT symbol, (floor((epoch(max(ts)) - epoch(min(ts))) / 14400) + 1)::BIGINT AS expected, count(*) AS n FROM bars GROUP BY symbol")
query("bars_with_features", lambda b: groups.join_features(b.select("symbol", "ts", "close"), features.returns(b).select("symbol", "ts", F.lit(1).alias("close"), F.col("log_1").isNotNull().alias("known"))), f"WITH {BARS} SELECT symbol, ts, round(close, 6) AS close, row_number() OVER ({O}) > 2 AS known FROM bars")
query("column_names", lambda b: b.select("symbol", "ts", *names.select_names(b.columns, containing="volume", leave_out=("volume",))), f"WITH {BARS} SELECT symbol, ts, round(quote_volume, 6) AS quote_volume, round(taker_buy_quote_volume, 6) AS taker_buy_quote_volume FROM bars")
query("feature_map", lambda b: groups.feature_map(b).select("symbol", "ts", F.size("features").alias("n"), F.element_at("features", "trades").alias("trades"), F.try_element_at("features", F.lit("none")).alias("absent")), f"WITH {BARS}, m AS (SELECT symbol, ts, MAP {{'trades': trades, 'quote_volume': quote_volume, 'taker_buy_quote_volume': taker_buy_quote_volume}} AS m FROM bars) SELECT symbol, ts, cardinality(m)::INTEGER AS n, round(m['trades'], 6) AS trades, round(m['none'], 6) AS absent FROM m")
query("strings", lambda b: b.select("symbol", F.upper("symbol").alias("upper"), F.replace("symbol", F.lit("e"), F.lit("")).alias("without_e"), F.col("symbol").startswith("v").alias("v"), F.col("symbol").contains("i").alias("i"), F.regexp_replace("symbol", "[^a-m]", "").alias("letters"), F.length("symbol").alias("n")).distinct(), f"WITH {BARS} SELECT DISTINCT symbol, upper(symbol) AS upper, replace(symbol, 'e', '') AS without_e, starts_with(symbol, 'v') AS v, contains(symbol, 'i') AS i, regexp_replace(symbol, '[^a-m]', '', 'g') AS letters, length(symbol)::INTEGER AS n FROM bars")
query("sorted_sink", lambda b: b.orderBy("symbol", F.col("ts").desc()).select("symbol", "ts", "close"), f"WITH {BARS} SELECT symbol, ts, round(close, 6) AS close FROM bars ORDER BY symbol, ts DESC")
query("topk_nodes", lambda b: analytics.top_in_groups(b, "quote_volume", ["symbol"]).select("symbol", "rank", "ts", "quote_volume"), f"WITH {BARS}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY quote_volume DESC, ts) AS rank FROM bars) SELECT symbol, rank::INTEGER AS rank, ts, round(quote_volume, 6) AS quote_volume FROM r WHERE rank <= 3")
query("bottomk_nodes", lambda b: analytics.top_in_groups(b, "quote_volume", ["symbol"], largest=False).select("symbol", "rank", "ts", "quote_volume"), f"WITH {BARS}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY quote_volume, ts) AS rank FROM bars) SELECT symbol, rank::INTEGER AS rank, ts, round(quote_volume, 6) AS quote_volume FROM r WHERE rank <= 3")
query("top_groups", lambda b: b.groupBy("symbol").agg(F.sum("trades").alias("trades")).orderBy(F.col("trades").desc(), "symbol").limit(3), f"WITH {BARS} SELECT symbol, round(sum(trades), 6) AS trades FROM bars GROUP BY symbol ORDER BY trades DESC, symbol LIMIT 3")
query("value_counts", lambda e: analytics.value_counts(e, "event_type"), "SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1", lambda s, d: src.table(s, d, "events"))
query("percentile_vector", lambda b: analytics.percentile_vector(b, "close"), f"WITH {BARS}, p AS (SELECT symbol, quantile_cont(close, [{', '.join(str(i / 100) for i in range(1, 100))}]) AS p FROM bars GROUP BY symbol) SELECT symbol, i::INTEGER AS percentile, round(p[i], 6) AS value FROM p, range(1, 100) t(i)")
_CP = ("open", "close", "quote_volume")
query("column_profile", lambda b: analytics.column_profile(b.withColumn("open", F.when(F.hour("ts") > 3, F.col("open"))), list(_CP)), f"WITH {BARS}, t AS ({' UNION ALL '.join(f'''SELECT symbol, ts, '{c}' AS feature, {'CASE WHEN hour(ts) > 3 THEN open END' if c == 'open' else c} AS x FROM bars''' for c in _CP)}) SELECT symbol, feature, count(*) FILTER (x IS NULL) AS nulls, round(count(*) FILTER (x IS NULL) * 100.0 / count(*), 6) AS null_percent, count(DISTINCT x) AS \"distinct\", round(arg_min(x, ts) FILTER (x IS NOT NULL), 6) AS first, round(arg_max(x, ts) FILTER (x IS NOT NULL), 6) AS last FROM t GROUP BY 1, 2")
query("cumulative", lambda b: analytics.cumulative(b, "close"), f"WITH {BARS} SELECT symbol, ts, round(sum(close) {E}, 6) AS total, round(product(1 + close / 10000) {E}, 6) AS growth, round(max(close) {E}, 6) AS top, count(close) {E} AS n FROM bars")
query("time_since_capped", lambda b: analytics.time_since_capped(b, F.col("close") > 90, 12), f"WITH {BARS}, s AS (SELECT *, row_number() OVER ({O}) AS rn, count(*) OVER (PARTITION BY symbol) AS n, max((close > 90)::INTEGER) OVER (PARTITION BY symbol) AS ever FROM bars) SELECT symbol, ts, CASE WHEN ever = 0 THEN n ELSE least(coalesce(rn - max(CASE WHEN close > 90 THEN rn END) {E}, n), 12) END AS since FROM s")
query("developing_session", lambda b: analytics.developing(b, "quote_volume", F.floor(F.hour("ts") / 8).cast("int")), f"WITH {BARS}, s AS (SELECT *, (hour(ts) // 8)::INTEGER AS season FROM bars), c AS (SELECT *, coalesce(season <> lag(season) OVER ({O}), true) AS changed FROM s), r AS (SELECT *, sum(changed::INTEGER) {E} AS run FROM c), w AS (SELECT *, sum(quote_volume) OVER (PARTITION BY symbol, run ORDER BY ts ROWS UNBOUNDED PRECEDING) AS so_far, row_number() OVER (PARTITION BY symbol, run ORDER BY ts) AS pos, sum(quote_volume) OVER (PARTITION BY symbol, run) AS whole, count(*) OVER (PARTITION BY symbol, run) AS length FROM r), b AS (SELECT symbol, run + 1 AS run, max(length) AS before FROM w GROUP BY 1, 2) SELECT w.symbol, w.ts, w.season, w.run::BIGINT AS run, round(so_far, 6) AS so_far, round(whole, 6) AS whole, round(so_far * (coalesce(before, pos)::DOUBLE / pos), 6) AS projected FROM w LEFT JOIN b ON w.symbol = b.symbol AND w.run = b.run")


def _heatmap(s, d):
    e = src.table(s, d, "events")
    days = e.select(F.to_date("ts").alias("day")).distinct()
    prices = days.select(F.datediff("day", F.lit("2024-01-01").cast("date")).alias("x"), F.col("day").cast("timestamp_ntz").alias("ts"))
    levels = s.createDataFrame([(i, 10.0 * i) for i in range(8)], "y int, level double")
    triples = e.select(F.col("event_id").alias("n"), F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("x"), F.floor(F.col("value") / 10).cast("int").alias("y"), "value")
    return analytics.heatmap_triples(triples, levels, prices, prices.select("ts"))


query("heatmap_triples", lambda h: h, "WITH h AS (SELECT DISTINCT ts::DATE AS day FROM events), c AS (SELECT ts::DATE AS day, floor(value / 10.0::DOUBLE)::INTEGER AS y, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2) SELECT h.day::TIMESTAMP AS ts, (l.y * 10.0)::DOUBLE AS level, round(coalesce(c.value, 0.0), 6) AS value FROM h CROSS JOIN range(8) l(y) LEFT JOIN c ON c.day = h.day AND c.y = l.y", _heatmap)

_hoursql = f"k AS (SELECT *, max(total) {E} AS pk FROM f), e AS (SELECT *, sum(CASE WHEN total < pk THEN 0 ELSE 1 END) {E} AS episode FROM k), rr AS (SELECT symbol, episode, min(ts) AS a, count(*) AS n FROM e GROUP BY 1, 2), hh AS (SELECT *, CASE WHEN n > 1 THEN (epoch(lead(a) OVER (PARTITION BY symbol ORDER BY episode)) - epoch(a)) / 3600 END AS hours FROM rr), hm AS (SELECT symbol, coalesce(max(hours), 0.0) AS hours FROM hh GROUP BY symbol)"
_sum = {
    "total_pnl": "arg_max(total, ts)", "max_drawdown": "min(total - peak)", "max_drawdown_hours": "any_value(hours)", "sharpe": f"coalesce(avg(r) / nullif(stddev_samp(r), 0) * {_yr}::DOUBLE, 0.0)", "sortino": f"coalesce(avg(r) / nullif(stddev_samp(r) FILTER (r < 0), 0) * {_yr}::DOUBLE, 0.0)", "volatility": f"stddev_samp(r) * {_yr}::DOUBLE",
    "var_95": "quantile_cont(r, 0.05)", "var_99": "quantile_cont(r, 0.01)", "win_rate": "coalesce(count(*) FILTER (t AND pnl > 0) * 100.0::DOUBLE / nullif(count(*) FILTER (t), 0), 0.0)", "profit_factor": "abs(sum(pnl) FILTER (t AND pnl > 0) / nullif(sum(pnl) FILTER (t AND pnl < 0), 0))",
    "avg_trade_pnl": "coalesce(avg(pnl) FILTER (t), 0.0)", "avg_winner": "coalesce(avg(pnl) FILTER (t AND pnl > 0), 0.0)", "avg_loser": "coalesce(avg(pnl) FILTER (t AND pnl < 0), 0.0)", "largest_winner": "coalesce(max(pnl) FILTER (t AND pnl > 0), 0.0)", "largest_loser": "coalesce(min(pnl) FILTER (t AND pnl < 0), 0.0)",
    "maker_rate": "coalesce(sum(mk) FILTER (t) * 100.0::DOUBLE / nullif(count(*) FILTER (t), 0), 0.0)", "avg_trade_size": "coalesce(avg(tv) FILTER (t), 0.0)", "avg_trade_spacing": "coalesce(avg((epoch(ts) - epoch(before)) / 3600) FILTER (t), 0.0)", "max_position": "max(abs(cp))", "avg_slippage_bps": "coalesce(avg(bps) FILTER (t), 0.0)",
}
_trading_sql = "SELECT tr.symbol, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in _sum.items()) + ", count(*) FILTER (t) AS total_trades, sum(missed)::BIGINT AS missed_trades FROM tr JOIN hm ON tr.symbol = hm.symbol GROUP BY tr.symbol"

_cm = {"total_return": "tot", "annual_return": "tot * 252.0::DOUBLE / n", "volatility": "sd * sqrt(252.0::DOUBLE / n)", "sharpe": "coalesce(m / nullif(sd, 0) * sqrt(252.0::DOUBLE / n), 0.0)", "sortino": "coalesce(m / nullif(dn, 0) * sqrt(252.0::DOUBLE / n), 0.0)", "max_drawdown": "abs(dd)", "win_rate": "coalesce(ups::DOUBLE / nullif(moves, 0), 0.0)", "profit_factor": "abs(gain / nullif(lost, 0))"}
query("curve_metrics", lambda b: analytics.curve_metrics(b, "close"), f"WITH {BARS}, r AS (SELECT *, {pc('close')} AS r, close / nullif(max(close) {E}, 0) - 1 AS d FROM bars), g AS (SELECT symbol, count(*) AS n, arg_max(close, ts) / nullif(arg_min(close, ts), 0) - 1 AS tot, avg(r) AS m, stddev_samp(r) AS sd, stddev_samp(r) FILTER (r < 0) AS dn, min(d) AS dd, count(*) FILTER (r > 0) AS ups, count(*) FILTER (r <> 0) AS moves, sum(r) FILTER (r > 0) AS gain, sum(r) FILTER (r < 0) AS lost FROM r GROUP BY symbol) SELECT symbol, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in _cm.items()) + " FROM g")


def _risk_states(b):
    return _run(b).select("symbol", "ts", "close", F.coalesce("position", F.lit(0.0)).alias("size"), (1000 + F.col("total")).alias("equity"), F.col("total").alias("pnl"))


_full = lambda n, x: f"CASE WHEN count(r) {rw(n)} >= {n} THEN {x} ELSE 0.0 END"
query("risk_metrics", lambda b: analytics.risk_metrics(_risk_states(b)), f"WITH {BARS}, {_pnl}, s AS (SELECT symbol, ts, close, coalesce(position, 0.0) AS size, 1000 + total AS equity, total AS pnl FROM f), x AS (SELECT *, {dv('pnl - ' + lg('pnl'), 'equity')} AS r FROM s), y AS (SELECT *, {_full(20, f'stddev_pop(r) {rw(20)} * sqrt(252.0::DOUBLE)')} AS vol, {_full(100, f'quantile_cont(r, 0.05) {rw(100)}')} AS v95, list(r) {rw(100)} AS l, {_full(252, f'avg(r) {rw(252)} / nullif(stddev_pop(r) {rw(252)}, 0) * sqrt(252.0::DOUBLE)')} AS sh, max(pnl) {E} AS peak, count(r) {rw(100)} AS n100, CASE WHEN count(*) {rw(20)} >= 20 THEN sum(pnl) {rw(20)} ELSE 0.0 END AS t20 FROM x) SELECT symbol, ts, round(vol, 6) AS volatility, round(v95, 6) AS var_95, round(CASE WHEN n100 >= 100 THEN list_avg(list_filter(l, lambda z: z <= v95)) ELSE 0.0 END, 6) AS expected_shortfall, round(coalesce(sh, 0.0), 6) AS sharpe, round(peak - pnl, 6) AS max_drawdown, round({dv('abs(size * close)', 'equity')}, 6) AS concentration, round(CASE WHEN hour(ts) < 9 OR hour(ts) >= 16 THEN abs(size * close) ELSE 0.0 END, 6) AS overnight_exposure, round(t20, 6) AS rolling_pnl, round(vol, 6) AS rolling_volatility FROM y")

_entries = "k AS (SELECT symbol AS source_id, lower(symbol) AS nickname, min(ts) AS start, max(ts) AS \"end\", count(*) AS n FROM bars GROUP BY symbol)"
query("catalog_entries", lambda b: analytics.catalog_entries(b, "bars").drop("headers"), f"WITH {BARS}, {_entries} SELECT source_id, nickname, 'bars/symbol=' || source_id AS directory, '1h' AS granularity, start, \"end\", n, (floor((epoch(\"end\") - epoch(start)) / 3600) + 1 - n)::BIGINT AS missing FROM k")


def _kinds(b):
    return b.sparkSession.createDataFrame([("view", 1), ("click", 2), ("nothing", 3)], "source_type string, priority int")


_kindsql = "p AS (SELECT * FROM (VALUES ('view', 1), ('click', 2), ('nothing', 3)) v(source_type, priority))"
query("catalog_upsert", lambda b: analytics.upsert(analytics.catalog_entries(b.where(F.col("symbol") != "click"), "old"), analytics.catalog_entries(b.where(F.col("symbol").isin("click", "view")), "new")).select("source_id", "directory", "n"), f"WITH {BARS}, {_entries} SELECT source_id, CASE WHEN source_id IN ('click', 'view') THEN 'new' ELSE 'old' END || '/symbol=' || source_id AS directory, n FROM k")
query("catalog_status", lambda b: analytics.collection_status(analytics.catalog_entries(b, "bars"), _kinds(b)), f"WITH {BARS}, {_entries}, {_kindsql} SELECT source_type, priority, count(nickname) AS sources, min(start) AS start, max(\"end\") AS \"end\", count(nickname) > 0 AS collected FROM p LEFT JOIN k ON contains(nickname, source_type) GROUP BY 1, 2")
query("catalog_missing", lambda b: analytics.missing_sources(analytics.catalog_entries(b, "bars"), _kinds(b)), f"WITH {BARS}, {_entries}, {_kindsql} SELECT source_type, priority FROM p WHERE NOT EXISTS (SELECT 1 FROM k WHERE contains(nickname, source_type))")

_ranges = "ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-11'"
query("trading_states", lambda b: strategy.trading_state(b, RUN).select("symbol", "ts", "trading_state"), f"WITH {BARS} SELECT symbol, ts, CASE WHEN hour(ts) >= 16 THEN 'DISABLED_OVERNIGHT' WHEN hour(ts) >= 11 AND hour(ts) < 12 THEN 'DISABLED_HOURS' WHEN hour(ts) >= 22 OR hour(ts) < 1 THEN 'DISABLED_HOURS' WHEN {_ranges} THEN 'DISABLED_RANGE' WHEN hour(ts) < 2 OR hour(ts) >= 20 THEN 'DISABLED_HOURS' WHEN isodow(ts) > 5 THEN 'DISABLED_DAYS' ELSE 'ENABLED' END AS trading_state FROM bars")
query("signal_gates", lambda b: strategy.signal_gate(b, RUN).select("symbol", "ts", "gate"), f"WITH {BARS} SELECT symbol, ts, (epoch(ts)::BIGINT - 820454400) % 14400 = 0 AND NOT ({_ranges}) AND hour(ts) >= 2 AND hour(ts) < 20 AND isodow(ts) <= 5 AND NOT (hour(ts) >= 22 OR hour(ts) < 1) AND NOT (hour(ts) >= 11 AND hour(ts) < 12) AND max((hour(ts) = 4 AND isodow(ts) = 2)::INTEGER) {E} = 1 AS gate FROM bars")
query("fear_greed", lambda r: files.fear_greed(r), "WITH raw AS (SELECT o_orderdate::DATE::TIMESTAMP + INTERVAL 1 DAY AS ts, max(o_totalprice) AS value FROM orders GROUP BY 1) SELECT ts, round(value, 6) AS fear_greed_value FROM raw WHERE ts <= (SELECT max(ts) FROM raw) - INTERVAL 2 DAY", lambda s, d: src.table(s, d, "orders").groupBy(F.unix_timestamp(F.to_date("o_orderdate").cast("timestamp")).alias("timestamp")).agg(F.max("o_totalprice").cast("string").alias("value")))


def _macd_run(b):
    """The MACD strategy over hourly bars: no SQL, as each bar needs the state before it; tests replay it by hand."""
    m = features.macd(b, 8, 21, 5).select("symbol", "ts", "line", "signal", "hist", F.col("hist_z168").alias("z_week"), F.col("hist_z720").alias("z_month"))
    return strategy.replay(b.join(m, ["symbol", "ts"]), strategy.Settings(position_size=10_000.0, max_position_size_usd=15_000.0, taker_fee_bps=5.0, maker_fee_bps=1.0, max_drawdown=0.5))


query("strategy_states", lambda b: strategy.states(_macd_run(b)))
query("strategy_trades", lambda b: strategy.trades(_macd_run(b)).drop("params"))
query("strategy_orders", lambda b: strategy.orders(_macd_run(b)))
query("strategy_signals", lambda b: strategy.signals(_macd_run(b)).drop("params"))
query("strategy_errors", lambda b: strategy.errors(_macd_run(b)))
query("run_metrics", lambda b: analytics.run_metrics(*(f(_macd_run(b)) for f in (strategy.states, strategy.trades))))
