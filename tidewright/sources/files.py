"""Files and paged sources: market data by symbol, auxiliary series, heatmaps, settings, features and results."""

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bars import BARS
from .paged import paged

#: Where the volatility index of options begins; fixed value.
DVOL_START = "2021-03-24"
AUX = "ts timestamp_ntz, open double, high double, low double, close double"


def at_millis(df: DataFrame) -> DataFrame:
    """time (milliseconds) as ts; rows without one are dropped, and of several rows for one symbol and time one is kept whole: the last to arrive (at), if the rows say when, else the largest."""
    rows = df.where("time is not null").withColumn("ts", F.timestamp_millis("time").cast("timestamp_ntz"))
    kept = [c for c in df.columns if c not in ("symbol", "time", "at")]
    arrival = [F.col("at")] if "at" in df.columns else []
    last = rows.groupBy("symbol", "ts").agg(F.max(F.struct(*arrival, F.struct(*kept).alias("row"))).alias("last"))
    return last.select("symbol", "ts", "last.row.*")


def klines(spark: SparkSession, path: str, symbols: list[str], start: int, end: int, width: int = 86_400_000) -> DataFrame:
    schema = "symbol string, time long, open double, high double, low double, close double, volume double, quote_volume double, trades double, taker_buy_quote_volume double, at long"
    out = at_millis(paged(spark, path, symbols, start, end, width, schema))
    return out.withColumn("taker_sell_quote_volume", F.col("quote_volume") - F.col("taker_buy_quote_volume"))


def funding_history(spark: SparkSession, path: str, symbols: list[str], start: int, end: int, width: int = 86_400_000) -> DataFrame:
    """(symbol, ts, fundingRate): mean by eight hours; text that isn't a number counts as missing."""
    raw = paged(spark, path, symbols, start, end, width, "symbol string, time long, fundingRate string")
    rows = raw.select("symbol", F.timestamp_seconds(F.floor(F.col("time") / 28_800_000) * 28_800).cast("timestamp_ntz").alias("ts"), F.expr("try_cast(fundingRate AS double)").alias("x"))
    return rows.dropna(subset=["ts", "x"]).groupBy("symbol", "ts").agg(F.avg("x").alias("fundingRate"))


def options_volatility(spark: SparkSession, path: str, symbol: str, start: int, end: int, width: int = 86_400_000) -> DataFrame:
    """(symbol, ts, implied_volatility) from the day on that the index exists; pages go back in time, as the service gives the latest first."""
    begins = int(datetime.fromisoformat(DVOL_START).replace(tzinfo=UTC).timestamp() * 1000)
    rows = at_millis(paged(spark, path, [symbol], min(max(start, begins), end), end, width, direction="backward"))
    return rows.select("symbol", "ts", F.col("close").alias("implied_volatility"))


def index_series(spark: SparkSession, path: str, symbol: str, start: int, end: int, width: int = 86_400_000, daily: str | None = None) -> DataFrame:
    """A share or volatility index: bars with returns. A slice without hourly rows has those of the daily series, if there is a path to one."""
    rows = at_millis(paged(spark, path, [symbol], start, end, width, **({"fallback": daily} if daily else {})))
    return rows.withColumn("returns", F.try_divide(F.col("close"), F.lag("close").over(Window.partitionBy("symbol").orderBy("ts"))) - 1)


def futures(spark: SparkSession, path: str, symbols: list[str], start: int, end: int, width: int = 86_400_000) -> DataFrame:
    """Bars whose side isn't known: half of the volume counts as bought."""
    rows = at_millis(paged(spark, path, symbols, start, end, width))
    return rows.withColumns({"quote_volume": F.col("volume") * F.col("close"), "taker_buy_quote_volume": 0.5 * F.col("volume") * F.col("close")})


def fear_greed(raw: DataFrame, held_back: int = 2) -> DataFrame:
    """(timestamp in seconds, value) to (ts, fear_greed_value): known a day later; the last days, which may still change, are left out."""
    rows = raw.select((F.timestamp_seconds(F.col("timestamp").cast("long")).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")).alias("ts"), F.expr("try_cast(value AS double)").alias("fear_greed_value")).dropna()
    last = rows.agg(F.max("ts").alias("_last"))
    return rows.join(F.broadcast(last), F.col("ts") <= F.col("_last") - F.make_dt_interval(F.lit(held_back))).drop("_last")  # one row


def read_vix(spark: SparkSession, path: str) -> DataFrame:
    """Text without a header: date, time, open, high, low, close."""
    raw = spark.read.schema("day string, clock string, open double, high double, low double, close double").csv(path)
    return raw.select(F.try_to_timestamp(F.concat_ws(" ", "day", "clock"), F.lit("MM/dd/yyyy HH:mm")).cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close").dropna(subset=["ts"])


HEATMAP = "y array<double>, liq array<array<double>>, prices array<array<double>>"


def read_heatmap(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """JSON of price levels, triples (place in time, place of the level, value) and prices: tables levels (y, level), triples (n, x, y, value) and prices (x, ts, open, high, low, close, volume)."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"success boolean, data struct<{HEATMAP.replace(' array', ': array')}>").alias("r"))
    body = raw.where("r.success and r.data is not null").select("r.data.*")
    levels = body.select(F.posexplode("y").alias("y", "level"))
    triples = body.select(F.posexplode("liq").alias("n", "t")).select("n", F.col("t")[0].cast("int").alias("x"), F.col("t")[1].cast("int").alias("y"), F.col("t")[2].alias("value"))
    p = body.select(F.posexplode("prices").alias("x", "p"))
    prices = p.select("x", F.timestamp_seconds(F.col("p")[0].cast("long")).cast("timestamp_ntz").alias("ts"), *[F.col("p")[i + 1].alias(c) for i, c in enumerate(("open", "high", "low", "close", "volume"))])
    return levels, triples, prices


def save_raw(bars: DataFrame, path: str) -> None:
    """Bars by symbol; symbols that are written before and not in bars stay."""
    bars.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(path)


def load_raw(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if symbol is None else rows.where(F.col("symbol") == symbol)


def csv_by_file(spark: SparkSession, path: str) -> DataFrame:
    """CSV files named by symbol; the symbol comes from the name of the file."""
    fields = ", ".join(f for f in BARS.split(", ") if not f.startswith("symbol "))
    rows = spark.read.schema(fields).option("header", True).csv(path)
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1).alias("symbol"), "*")


def write_features(df: DataFrame, path: str, group: str) -> DataFrame:
    """Write a feature table by group and symbol, other groups and symbols stay; returns its metadata: first and last ts, rows, columns."""
    target = f"{path}/group={group}"
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(target)
    meta = read_features(df.sparkSession, path, group).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("rows"))
    meta = meta.select(F.lit(group).alias("group"), "*", F.array(*[F.lit(c) for c in df.columns]).alias("columns"))
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/metadata/group={group}")
    return meta


def read_features(spark: SparkSession, path: str, group: str, symbol: str | None = None) -> DataFrame:
    """What write_features wrote for one group, and for one symbol if it is named."""
    return load_raw(spark, f"{path}/group={group}", symbol)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The metadata of all groups at a path."""
    return spark.read.json(f"{path}/metadata")


def write_results(states: DataFrame, trades: DataFrame, metrics: DataFrame, path: str) -> None:
    """State history and trades as CSV, metrics as JSON."""
    states.write.mode("overwrite").option("header", True).csv(f"{path}/state_history")
    flat = [F.to_json(c).alias(c) if t.startswith(("map", "array", "struct")) else F.col(c) for c, t in trades.dtypes]
    trades.select(*flat).write.mode("overwrite").option("header", True).csv(f"{path}/trades")
    metrics.write.mode("overwrite").json(f"{path}/metrics")


def read_settings(path: str) -> dict:
    """A JSON or simple YAML file of settings as a dict; only the driver reads it. Of YAML it knows nested keys, scalars, [a, b] and lists of scalars by `- item`."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    root: dict = {}
    open_: list[tuple[int, dict, str | None, dict]] = [(-1, root, None, root)]  # indent, keys there, the key above and what holds it
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        indent, item = len(body) - len(body.lstrip()), body.strip()
        if item == "-" or item.startswith("- "):
            while open_[-1][0] > indent or (open_[-1][0] == indent and open_[-1][2] is None):
                open_.pop()
            _, keys, name, above = open_[-1]
            if name is None or (isinstance(keys, dict) and keys):
                raise ValueError(f"a list without a key of its own: {line!r}")
            if not isinstance(above[name], list):
                above[name] = []
            above[name].append(_scalar(item[1:].strip()))
            continue
        while open_[-1][0] >= indent:
            open_.pop()
        name, _, value = item.partition(":")
        keys = open_[-1][1]
        if value.strip():
            keys[name] = _scalar(value.strip())
        else:
            keys[name] = {}
            open_.append((indent, keys[name], name, keys))
    return root


def _scalar(text: str):
    try:
        return json.loads(text.replace("'", '"'))
    except ValueError:
        return text


def event_table(spark: SparkSession, settings: dict) -> DataFrame:
    """(category, name, date or NULL, rule or NULL) from the events of a settings file: lists of dates, or a rule such as first_friday."""
    rows = []
    for category, events in settings.get("events", {}).items():
        for name, dates in events.items() if isinstance(events, dict) else [(category, events)]:
            rows += [(category, name, d, None) for d in dates] if isinstance(dates, list) else [(category, name, None, str(dates))]
    return spark.createDataFrame(rows, "category string, name string, day string, rule string").select("category", "name", F.to_date("day").alias("date"), "rule")


def session_table(spark: SparkSession, settings: dict) -> DataFrame:
    """(name, start, end) in minutes of the day; a session whose end is not after its start runs over midnight."""
    minutes = lambda t: int(t.split(":")[0]) * 60 + int(t.split(":")[1])
    return spark.createDataFrame([(k, minutes(a), minutes(b)) for k, (a, b) in settings["time_features"]["sessions"].items()], "name string, start int, end int")
