"""Sessions that a gap ends, and feature rows of a stream that replace earlier ones once, even if a batch comes twice."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def gap_sessions(rows: DataFrame, gap: str = "3 hours", delay: str = "2 hours") -> DataFrame:
    """(symbol, start, end, last, rows, open, high, low, close) of runs of rows (symbol, ts, value) with at most gap from one to the next; end is gap after the last.

    On a stream with a watermark of delay a session comes out, in append mode, when
    the watermark has passed its end, and rows later than that are left out; a row
    within the delay may join two sessions. A batch gives the same sessions.
    """
    rows = rows.select("symbol", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", delay)
    at = F.struct("ts", "value")
    g = rows.groupBy("symbol", F.session_window("ts", gap).alias("w"))
    g = g.agg(F.max("ts").alias("last"), F.count("*").alias("rows"), F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"))
    return g.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "last", "rows", "open", "high", "low", "close")


def upsert_into(path: str, keys: tuple[str, ...] = ("symbol", "ts"), order: str | None = None) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that puts rows into the feature table at path; a later batch replaces rows with the same keys.

    A batch is a folder of its own, named by its number, which a batch that is
    replayed writes anew: nothing is read, and nothing is added twice. Of several
    rows of a batch with the same keys the one with the largest value in order
    stays (rows equal in that: the largest row). read_upserted() gives the rows that hold.
    """

    def put(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        rank = F.struct(*[F.col(c) for c in ([order] if order else []) + rest])
        one = batch.groupBy(*keys).agg(F.max(F.struct(rank.alias("rank"), F.struct(*rest).alias("row"))).alias("top"))
        one.select(*keys, "top.row.*").write.mode("overwrite").parquet(f"{path}/batch={number:020d}")

    return put


def read_upserted(spark: SparkSession, path: str, keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """The rows that hold: of each key that of the last batch which has it."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    top = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch").cast("long")).alias("row"))
    return top.select(*keys, "row.*")


def compact(spark: SparkSession, path: str, below: int, target: str, keys: tuple[str, ...] = ("symbol", "ts")) -> None:
    """Write the rows that hold after the batches below a number as one batch of a new table at target, with the later batches beside it; a stream then goes on into target."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    number = F.col("batch").cast("long")
    rows.where(number < below).groupBy(*keys).agg(F.max_by(F.struct(*rest), number).alias("row")).select(*keys, "row.*").write.mode("overwrite").parquet(f"{target}/batch={max(0, below - 1):020d}")
    later = rows.where(number >= below).select(number.alias("n")).distinct().collect()  # one row for each batch
    for n in sorted(r.n for r in later):
        rows.where(number == n).drop("batch").write.mode("overwrite").parquet(f"{target}/batch={n:020d}")
