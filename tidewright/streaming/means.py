"""Exponential means of a stream: a state for each symbol, rows held back until the watermark has passed them, so that late rows still take their place."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that transformWithState needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = pd.Timestamp(0)


class ExponentialMeans(StatefulProcessor):
    """y += 2 / (span + 1) * (x - y) for each span, seeded with the first value; a missing value leaves the means as they are.

    Rows wait in a map by time, of several for one time the last to come. A timer
    at a row's time fires when the watermark passes it; then all waiting rows up to
    there go through the means in order and come out, so the result is that of a
    batch whatever order rows come in within the delay. What is held is one row for
    each time within the delay and one mean for each span.
    """

    def __init__(self, spans: list[int]):
        self.spans = spans

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "micros long", "x double")
        self.means = handle.getValueState("means", ", ".join(f"y{s} double" for s in self.spans))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = set()
        for batch in rows:
            for ts, x in zip(batch["ts"], batch["x"]):
                micros = (ts - EPOCH) // pd.Timedelta(microseconds=1)
                self.waiting.updateValue((micros,), (None if pd.isna(x) else float(x),))
                due.add(micros // 1000 + 1)
        # a timer for each row would be many; one for the first row that waits is enough, as it sets the next
        set_ = list(self.handle.listTimers())
        if due and (not set_ or min(due) < min(set_)):
            for t in set_:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(min(due))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs()
        times = sorted(k[0] for k in self.waiting.keys())
        ready = [t for t in times if t // 1000 < until]
        held = self.means.get() if self.means.exists() else None
        ys = list(held) if held is not None else [None] * len(self.spans)
        out = []
        for micros in ready:
            (x,) = self.waiting.getValue((micros,))
            if x is not None:
                ys = [x if y is None else y + 2.0 / (s + 1) * (x - y) for y, s in zip(ys, self.spans)]
            out.append((EPOCH + pd.Timedelta(microseconds=micros), x, *ys))
            self.waiting.removeKey((micros,))
        if ready:
            self.means.update(tuple(ys))
        if len(ready) < len(times):  # the timer that fired is the only one, and goes
            self.handle.registerTimer(times[len(ready)] // 1000 + 1)
        if out:
            frame = pd.DataFrame(out, columns=["ts", "x", *[f"ewm_{s}" for s in self.spans]])
            frame.insert(0, "symbol", key[0])
            yield frame

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def streaming_means(stream: DataFrame, value: str, spans: list[int], delay: str = "2 hours") -> DataFrame:
    """(symbol, ts, x, ewm_{span}) of a stream with symbol, ts and a value: each row once the watermark, delay behind the latest ts, has passed it. Rows that come later than that are left out.

    The session needs use_state_store(). Symbols are spread over the shuffle
    partitions; a restart goes on from the checkpoint.
    """
    rows = stream.select("symbol", F.col("ts").cast("timestamp").alias("ts"), F.col(value).cast("double").alias("x")).withWatermark("ts", delay)
    schema = "symbol string, ts timestamp, x double, " + ", ".join(f"ewm_{s} double" for s in spans)
    return rows.groupBy("symbol").transformWithStateInPandas(ExponentialMeans(spans), schema, outputMode="Append", timeMode="EventTime")
