"""Which signal an order answers and which order a fill, by sequence in time; what was missed, and what a run's fills come to."""

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from ..functions.scans import Fill, doubles, floats, scan


@dataclass
class Totals:
    """Running sums of doubles, NULL as 0. names: result to column."""

    names: dict[str, str]
    out: list[StructField] = field(init=False)

    def __post_init__(self):
        self.out = [StructField(n, DoubleType()) for n in self.names]

    def _values(self, piece):
        return np.array([np.nan_to_num(floats(piece, c)) for c in self.names.values()]).reshape(len(self.names), len(piece))

    def summarise(self, piece):
        return self._values(piece).sum(axis=1)

    def merge(self, earlier, later):
        return earlier + later

    def apply(self, piece, before, whole):
        return [doubles(x) for x in self._values(piece).cumsum(axis=1) + (0.0 if before is None else before[:, None])]


def after_last(rows: DataFrame, marks: DataFrame, within: str, unit: str = "month") -> DataFrame:
    """rows (symbol, ts, ...) with mark_id, NULL where no mark (symbol, ts, id) of the symbol came at or before them within that long. Of marks at one time the last is the one with the largest id.

    Rows and marks are one sequence, in pieces of time; the last mark is carried on. ids are whole numbers below 2^53.
    """
    data = F.struct(*[c for c in rows.columns if c not in ("symbol", "ts")])
    at = F.unix_micros(F.col("ts").cast("timestamp")).cast("double")
    own = rows.select("symbol", "ts", F.lit(1).alias("_kind"), F.lit(None).cast("double").alias("_id"), at.alias("_at"), data.alias("_row"))
    theirs = marks.select("symbol", "ts", F.lit(0).alias("_kind"), F.col("id").cast("double").alias("_id"), at.alias("_at"), F.lit(None).cast(own.schema["_row"].dataType).alias("_row"))
    both = own.unionByName(theirs).withColumn("_mark", F.col("_kind") == 0)
    found = scan(both, [Fill("_mark", {"_mark_id": "_id", "_mark_at": "_at"})], unit, ["_kind", "_id"], "sequence").where("_kind = 1")
    limit = F.expr(f"unix_micros(timestamp_micros(0) + INTERVAL {within})")
    return found.select("symbol", "ts", "_row.*", F.when(F.col("_at") - F.col("_mark_at") <= limit, F.col("_mark_id").cast("long")).alias("mark_id"))


def matched(signals: DataFrame, orders: DataFrame, fills: DataFrame, within: str = "1 day") -> DataFrame:
    """A row for each signal (symbol, ts, id, side 1 or -1, price): the order that answered it and its fills.

    orders (symbol, ts, id) answer the last signal of their symbol before them, the
    first such order counts; fills (symbol, ts, id, size, price, is_maker) belong to
    the last of these orders before them. Both only within that long. Columns:
    order_id, order_ts, n_fills, filled, fill_price (mean by size), fill_ts (the
    last), maker_fills, slippage_bps (how much worse than the signal's price, by
    side), missed (no fill). Rows without symbol are a symbol of their own.
    """
    answers = after_last(orders.select("symbol", "ts", "id"), signals, within).where("mark_id IS NOT NULL")
    first = answers.groupBy(F.col("mark_id").alias("_signal"), F.col("symbol").alias("_symbol")).agg(F.min(F.struct("ts", "id")).alias("o"))
    first = first.select("_signal", "_symbol", F.col("o.id").alias("order_id"), F.col("o.ts").alias("order_ts"))
    placed = first.select(F.col("_symbol").alias("symbol"), F.col("order_ts").alias("ts"), F.col("order_id").alias("id"))
    of = after_last(fills.select("symbol", "ts", "id", "size", "price", "is_maker"), placed, within).where("mark_id IS NOT NULL")
    g = of.groupBy(F.col("mark_id").alias("_order"), F.col("symbol").alias("_of")).agg(F.count("*").alias("n_fills"), F.sum("size").alias("filled"), F.try_divide(F.sum(F.col("size") * F.col("price")), F.sum("size")).alias("fill_price"), F.max("ts").alias("fill_ts"), F.sum(F.col("is_maker").cast("long")).alias("maker_fills"))
    out = signals.select("symbol", "ts", "id", "side", "price")
    out = out.join(first, (F.col("id") == F.col("_signal")) & F.col("symbol").eqNullSafe(F.col("_symbol")), "left")
    out = out.join(g, (F.col("order_id") == F.col("_order")) & F.col("symbol").eqNullSafe(F.col("_of")), "left")
    worse = F.try_divide(F.col("fill_price") - F.col("price"), F.col("price")) * F.col("side") * 1e4
    return out.select("symbol", "ts", "id", "side", "price", "order_id", "order_ts", F.coalesce("n_fills", F.lit(0)).alias("n_fills"), F.coalesce("filled", F.lit(0.0)).alias("filled"), "fill_price", "fill_ts", F.coalesce("maker_fills", F.lit(0)).alias("maker_fills"), worse.alias("slippage_bps"), F.col("n_fills").isNull().cast("int").alias("missed"))


def execution_frame(found: DataFrame) -> DataFrame:
    """What trading_summary reads, from matched signals: a row for each, at the time of its last fill, or of the signal if it was missed, in order of time and id.

    A filled signal changes the position by side times size; the profit of a row is
    the position before it times the change of price since the fill before, so
    signals that were missed neither trade nor earn.
    """
    filled = F.col("missed") == 0
    s = found.select("symbol", F.coalesce("fill_ts", "ts").alias("ts"), "id", "missed", F.when(filled, F.col("side") * F.col("filled")).otherwise(0.0).alias("change"), F.col("fill_price").alias("p"), F.when(filled, F.col("filled") * F.col("fill_price")).alias("trade_value"), F.when(filled, (F.col("maker_fills") == F.col("n_fills")).cast("int")).alias("maker_trades"), F.col("slippage_bps").alias("miss_bps"), filled.alias("_filled"))
    s = scan(s, [Totals({"position": "change"}), Fill("_filled", {"_last": "p"}, earlier=True)], order=["id"], name="positions")
    s = s.withColumn("pnl", F.when(F.col("_filled"), F.coalesce((F.col("position") - F.col("change")) * (F.col("p") - F.col("_last")), F.lit(0.0))).otherwise(0.0))
    s = scan(s, [Totals({"total": "pnl"})], order=["id"], name="profits")
    return s.select("symbol", "ts", F.col("position").alias("coin_position"), F.col("change").alias("coin_position_change"), F.col("pnl").alias("trade_pnl"), F.col("total").alias("total_pnl"), "trade_value", "maker_trades", F.col("missed").alias("missed_signals"), "miss_bps")


