"""Bars from the event and order tables, files, resampling, gap filling and as-of alignment."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, quote_volume double, trades double, taker_buy_quote_volume double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(unit: str, c: str = "ts"):
    return F.date_trunc(unit, F.col(c)).cast("timestamp_ntz")


def resample(df: DataFrame, keys: list[str], order, value: str, buy) -> DataFrame:
    """Open, high, low, close and sums by keys; map-side partial aggregates, one shuffle."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.min_by(v, order).alias("open"), F.max(v).alias("high"), F.min(v).alias("low"), F.max_by(v, order).alias("close"), F.count("*").cast("double").alias("volume"), F.count("*").cast("double").alias("trades"), F.sum(v).alias("quote_volume"), F.sum(F.when(buy, v).otherwise(0.0)).alias("taker_buy_quote_volume"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    e = e.select(F.col("event_type").alias("symbol"), bucket("hour").alias("ts"), F.struct("ts", "event_id").alias("o"), "value", (k % 2 == 0).alias("buy"))
    return resample(e, ["symbol", "ts"], F.col("o"), "value", F.col("buy"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    o = o.select(F.col("o_orderpriority").alias("symbol"), bucket("day", "o_orderdate").alias("ts"), F.struct("o_orderdate", "o_orderkey").alias("o"), F.col("o_totalprice").alias("value"), (F.col("o_orderstatus") == "F").alias("buy"))
    return resample(o, ["symbol", "ts"], F.col("o"), "value", F.col("buy"))


def funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Funding rate of each eight hours: (mean k - 50) / 10000."""
    e = table(spark, sf_dir, "events")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    hour = (F.floor(F.hour("ts") / 8) * 8).cast("int")
    at = (bucket("day") + F.make_dt_interval(F.lit(0), hour)).cast("timestamp_ntz")
    return e.groupBy(F.col("event_type").alias("symbol"), at.alias("ts")).agg(((F.avg(k) - 50) / 10000).alias("fundingRate"))


def between(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows with start <= ts <= end; on a scan the filter reaches the files."""
    return df.where(F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def with_lookback(df: DataFrame, start: str, end: str, hours: int, apply) -> DataFrame:
    """apply over rows from hours before start, then only [start, end]."""
    since = F.lit(start).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(hours))
    wide = df.where((F.col("ts") >= since) & (F.col("ts") <= F.lit(end).cast("timestamp_ntz")))
    return between(apply(wide), start, end)


def fill_hours(df: DataFrame, value: str) -> DataFrame:
    """A row for each hour between a symbol's first and last, the last known value carried forward."""
    span = df.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = span.select("symbol", F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 HOUR"))).alias("ts"))
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(df.select("symbol", "ts", value), ["symbol", "ts"], "left").withColumn(value, F.last(value, ignorenulls=True).over(w))


def as_of(left: DataFrame, right: DataFrame, value: str, missing: float | None = None) -> DataFrame:
    """Add right's last value at or before each row of left: one union and one window, no range join. missing replaces what has none."""
    a = left.select("symbol", "ts", F.lit(1).alias("_side"), F.lit(None).cast("double").alias("_v"), F.struct(*left.columns).alias("_row"))
    b = right.select("symbol", "ts", F.lit(0).alias("_side"), F.col(value).alias("_v"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy("symbol").orderBy("ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    known = a.unionByName(b).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    out = known.select("_row.*", F.col("_v").alias(value))
    return out if missing is None else out.withColumn(value, F.coalesce(value, F.lit(missing)))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Bars from CSV files with a header, by a fixed schema."""
    return spark.read.schema(BARS).option("header", True).csv(path)


def fill_index(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """left's value where right has none at the same symbol and ts, else right's: assignment on the common index."""
    r = right.select("symbol", "ts", F.col(value).alias("_v"))
    return left.join(r, ["symbol", "ts"], "left").withColumn(value, F.coalesce("_v", value)).drop("_v")


def common_index(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that both sides have, with the named columns of right."""
    return left.join(right.select("symbol", "ts", *columns), ["symbol", "ts"], "inner")


def outer_difference(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """left's value less right's by symbol and ts; rows that one side lacks have NULL."""
    a, b = left.select("symbol", "ts", F.col(value).alias("_a")), right.select("symbol", "ts", F.col(value).alias("_b"))
    return a.join(b, ["symbol", "ts"], "full").select("symbol", "ts", (F.col("_a") - F.col("_b")).alias(value))


def overlap_ratio(left: DataFrame, right: DataFrame) -> DataFrame:
    """By symbol, which part of left's span right covers too; 0 where they don't meet, 1 for a span of one moment inside right's."""
    at = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    a = left.groupBy("symbol").agg(F.min("ts").alias("a0"), F.max("ts").alias("a1"))
    b = right.groupBy("symbol").agg(F.min("ts").alias("b0"), F.max("ts").alias("b1"))
    both = a.join(b, "symbol", "left")
    shared = F.least(at("a1"), at("b1")) - F.greatest(at("a0"), at("b0"))
    ratio = F.when(F.col("b0").isNull() | (shared < 0), 0.0).when(F.col("a0") == F.col("a1"), 1.0).otherwise(F.try_divide(shared, at("a1") - at("a0")))
    return both.select("symbol", ratio.alias("ratio"), (ratio < 0.9).alias("warn"))
