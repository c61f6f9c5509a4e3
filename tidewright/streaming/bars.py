"""Hourly bars from a stream of events, with a watermark for late ones."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_stream(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """events (event_type, ts, event_id, value, props) to the bars of sources.bars.hourly by tumbling hours; append mode emits an hour once the watermark has passed it."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    order = F.struct("ts", "event_id")
    even = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0)) % 2 == 0
    g = e.groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("symbol"))
    bars = g.agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").cast("double").alias("volume"), F.count("*").cast("double").alias("trades"), F.sum("value").alias("quote_volume"), F.sum(F.when(even, F.col("value")).otherwise(0.0)).alias("taker_buy_quote_volume"))
    return bars.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume", "trades", "quote_volume", "taker_buy_quote_volume")
