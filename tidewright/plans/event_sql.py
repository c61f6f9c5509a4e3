"""Queries over event rows with their SQL: dated events on bars, signals matched to orders and fills, catalogs of files."""

from pyspark.sql import functions as F

from ..functions.win import near
from ..operators import analytics, events, matching
from ..sources import bars as src
from ..sources import footers
from .more import _hoursql, _trading_sql
from .registry import BARS, E, O, lg, query

# dated events

_day = {k: f"ts::DATE IN ({', '.join(f'''DATE '{d}' ''' for d in v)})" for k, v in (events.ECONOMIC | events.MAJOR).items() if isinstance(v, list)}
_day["NFP"] = "(day(ts) <= 7 AND isodow(ts) = 5)"
query(
    "seasonality_events",
    lambda b: events.event_flags(b, events.known_events(b.sparkSession)),
    f"WITH {BARS} SELECT symbol, ts, " + ", ".join(f"{v}::INTEGER AS is_{k}" for k, v in _day.items()) + " FROM bars",
)


def _busy_days(spark, sf_dir: str):
    """Events from a table: a name for each priority of orders, on the days that have at least 4 of them open."""
    orders = src.table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    busy = orders.groupBy(F.to_date("o_orderdate").alias("date"), F.concat(F.lit("P"), F.substring("o_orderpriority", 1, 1)).alias("name")).count().where("count >= 4")
    known = src.table(spark, sf_dir, "orders").select(F.concat(F.lit("P"), F.substring("o_orderpriority", 1, 1)).alias("name")).distinct()
    none = known.select(F.lit("busy").alias("category"), "name", F.lit(None).cast("date").alias("date"), F.lit(None).cast("string").alias("rule"))
    return events.event_flags(src.daily(spark, sf_dir), busy.select(F.lit("busy").alias("category"), "name", "date", F.lit(None).cast("string").alias("rule")).unionByName(none))


_busy = "busy AS (SELECT o_orderdate::DATE AS day, substr(o_orderpriority, 1, 1) AS p FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2 HAVING count(*) >= 4)"
query(
    "busy_day_events",
    lambda d: d,
    f"WITH days AS (SELECT DISTINCT o_orderpriority AS symbol, date_trunc('day', o_orderdate)::TIMESTAMP AS ts FROM orders), {_busy} SELECT symbol, ts, " + ", ".join(f"(EXISTS (SELECT 1 FROM busy WHERE day = ts::DATE AND p = '{i}'))::INTEGER AS is_P{i}" for i in range(1, 6)) + " FROM days",
    _busy_days,
)

# signals, orders and fills: views, clicks and purchases of a fifth of the users each, in their order

K = "coalesce(cast(get_json_object(props, '$.k') AS int), 0)"
WITHIN = "3 hours"


def _sequence(spark, sf_dir: str):
    e = src.table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id") % 5).alias("symbol"), "ts", F.col("event_id").alias("id"), "event_type", F.col("value").alias("price"), F.expr(K).alias("k"))
    of = lambda kind: e.where(F.col("event_type") == kind)
    signals = of("view").withColumn("side", F.when(F.col("k") % 2 == 0, 1).otherwise(-1))
    fills = of("purchase").withColumns({"size": (F.col("k") % 7 + 1).cast("double"), "is_maker": F.col("k") % 3 == 0})
    return matching.matched(signals, of("click"), fills, WITHIN)


_matched = f"""ev AS (
  SELECT 'u' || (user_id % 5) AS symbol, ts, event_id AS id, event_type, value AS price, coalesce(json_extract_string(props, '$.k')::INTEGER, 0) AS k FROM events
), sig AS (
  SELECT symbol, ts, id, price, CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END AS side FROM ev WHERE event_type = 'view'
), ord AS (
  SELECT s.id AS signal, o.symbol, arg_min(o.id, (o.ts, o.id)) AS order_id, min(o.ts) AS order_ts
  FROM (SELECT * FROM ev WHERE event_type = 'click') o ASOF JOIN sig s ON o.symbol = s.symbol AND o.ts >= s.ts WHERE o.ts - s.ts <= INTERVAL {WITHIN} GROUP BY 1, 2
), fil AS (
  SELECT o.order_id, count(*) AS n_fills, sum(f.k % 7 + 1)::DOUBLE AS filled, sum((f.k % 7 + 1) * f.price) / sum(f.k % 7 + 1) AS fill_price, max(f.ts) AS fill_ts, count(*) FILTER (f.k % 3 = 0) AS maker_fills
  FROM (SELECT * FROM ev WHERE event_type = 'purchase') f ASOF JOIN ord o ON f.symbol = o.symbol AND f.ts >= o.order_ts WHERE f.ts - o.order_ts <= INTERVAL {WITHIN} GROUP BY 1
), m AS (
  SELECT s.symbol, s.ts, s.id, s.side, s.price, o.order_id, o.order_ts, coalesce(f.n_fills, 0) AS n_fills, coalesce(f.filled, 0.0) AS filled, f.fill_price, f.fill_ts, coalesce(f.maker_fills, 0) AS maker_fills,
    (f.fill_price - s.price) / nullif(s.price, 0) * s.side * 10000 AS slippage_bps, (f.n_fills IS NULL)::INTEGER AS missed
  FROM sig s LEFT JOIN ord o ON o.signal = s.id LEFT JOIN fil f ON f.order_id = o.order_id
)"""
query(
    "matched_signals",
    lambda m: m,
    f"WITH {_matched} SELECT symbol, ts, id, side, round(price, 6) AS price, order_id, order_ts, n_fills, round(filled, 6) AS filled, round(fill_price, 6) AS fill_price, fill_ts, maker_fills, round(slippage_bps, 6) AS slippage_bps, missed FROM m",
    _sequence,
)

_order = "PARTITION BY symbol ORDER BY ts, id"
_so_far = f"OVER ({_order} ROWS UNBOUNDED PRECEDING)"
_before = f"OVER ({_order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_frame = f"""x AS (
  SELECT symbol, coalesce(fill_ts, ts) AS ts, id, missed, CASE WHEN missed = 0 THEN side * filled ELSE 0.0 END AS cc, fill_price AS p, CASE WHEN missed = 0 THEN filled * fill_price END AS tv,
    CASE WHEN missed = 0 THEN (maker_fills = n_fills)::INTEGER END AS mk, slippage_bps AS bps FROM m
), y AS (
  SELECT *, sum(cc) {_so_far} AS cp, last_value(p IGNORE NULLS) {_before} AS lp FROM x
), z AS (
  SELECT *, CASE WHEN missed = 0 THEN coalesce((cp - cc) * (p - lp), 0.0) ELSE 0.0 END AS pnl FROM y
), tf AS (
  SELECT *, round(sum(pnl) {_so_far}, 6) AS total FROM z
), f AS (
  SELECT * FROM tf
), tr AS (
  SELECT *, total - {lg('total')} AS r, max(total) {E} AS peak, cc <> 0 AS t, max(CASE WHEN cc <> 0 THEN ts END) OVER ({O} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM tf
)"""


def _summary(found):
    """Totals are rounded as in the SQL, so that a signal that earns nothing is no loss on either side."""
    frame = matching.execution_frame(found)
    return analytics.trading_summary(frame.withColumn("total_pnl", near("total_pnl")))


query("trading_summary", _summary, f"WITH {_matched}, {_frame}, {_hoursql} {_trading_sql}", _sequence)

# catalogs from footers

_TIMED = {"events": "ts", "orders": "o_orderdate"}


def _footers(spark, sf_dir: str):
    """Of the files of two tables, each with its own column of time."""
    out = None
    for name, time in _TIMED.items():
        files = footers.file_catalog(spark, f"{sf_dir}/{name}.parquet", time)
        each = footers.source_catalog(files, F.lit(name)).select("source", "rows", "start", "end", F.concat_ws(",", "columns").alias("columns"))
        out = each if out is None else out.unionByName(each)
    return out


query(
    "catalog_footers",
    lambda c: c,
    " UNION ALL ".join(f"SELECT '{n}' AS source, count(*) AS rows, min({t}) AS start, max({t}) AS \"end\", (SELECT string_agg(column_name, ',' ORDER BY column_index) FROM duckdb_columns() WHERE table_name = '{n}') AS columns FROM {n}" for n, t in _TIMED.items()),
    _footers,
)
