"""Streams against batches: restarts, late rows, replayed batches."""

import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from tidewright.functions import win
from tidewright.streaming import means, sessions

T0 = dt.datetime(2024, 1, 1)
BARS = "symbol string, ts timestamp, close double"


def write(spark, path, rows, schema=BARS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def run(stream, name, path, sink="parquet"):
    q = stream.writeStream.format(sink).outputMode("append").option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/{name}_state").trigger(availableNow=True).start()
    q.awaitTermination(300)
    return q


def test_means_equal_the_batch_over_a_restart(spark, tmp_path):
    """Rows out of order within the delay take their place; one that comes later than the delay is left out; the second run goes on from the first one's state."""
    means.use_state_store(spark)
    path, rng = f"file://{tmp_path}", random.Random(1)
    rows = [(s, T0 + dt.timedelta(minutes=30 * i), None if i % 11 == 3 else rng.uniform(1, 9)) for i in range(60) for s in ("a", "b", "c")]
    shuffled = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rng.uniform(0, 100)))  # at most 100 minutes out of order

    def stream():
        source = spark.readStream.schema(BARS).option("maxFilesPerTrigger", 1).parquet(f"{path}/bars")
        return means.streaming_means(source, "close", [3, 12])

    for part in (shuffled[:60], shuffled[60:100]):
        write(spark, f"{path}/bars", part)
    run(stream(), "out", path)
    first = spark.read.parquet(f"{path}/out").count()
    assert 0 < first < 100
    write(spark, f"{path}/bars", shuffled[100:])
    write(spark, f"{path}/bars", [("a", T0 - dt.timedelta(days=1), 1e9)])  # too late
    write(spark, f"{path}/bars", [(s, T0 + dt.timedelta(days=9), 5.0) for s in ("a", "b", "c")])  # moves the watermark on
    write(spark, f"{path}/bars", [("d", T0 + dt.timedelta(days=9, hours=1), 5.0)])
    run(stream(), "out", path)
    got = spark.read.parquet(f"{path}/out").where(F.col("ts") < F.lit(T0 + dt.timedelta(days=5)))
    want = win.ewm(spark.createDataFrame(rows, BARS), "close", [3, 12])
    key = lambda r: (r.symbol, r.ts)
    got, want = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
    assert len(got) == len(rows) and [key(r) for r in got] == [key(r) for r in want]
    for r, w in zip(got, want):
        assert (r.ewm_3, r.ewm_12) == (w.ewm_3, w.ewm_12) or (r.ewm_3, r.ewm_12) == pytest.approx((w.ewm_3, w.ewm_12))


VALUES = "symbol string, ts timestamp, value double"


def sessions_by_hand(rows, gap):
    out = []
    for symbol in sorted({r[0] for r in rows}):
        held = []
        for r in [*sorted(r for r in rows if r[0] == symbol), None]:
            if held and (r is None or r[1] - held[-1][1] > gap):
                v = [x[2] for x in held]
                out.append((symbol, held[0][1], held[-1][1] + gap, held[-1][1], len(held), v[0], max(v), min(v), v[-1]))
                held = []
            held.append(r)
    return out


def test_gap_sessions(spark, tmp_path):
    """Sessions come out once the watermark has passed them; a row within the delay joins two; a later one is left out; a restart goes on."""
    path, rng = f"file://{tmp_path}", random.Random(2)
    rows, at = [], T0
    for _ in range(80):
        at += dt.timedelta(minutes=rng.choice([5, 40, 100, 300]))
        rows.append((rng.choice("ab"), at, float(len(rows) % 17)))
    gap = dt.timedelta(hours=3)
    batch = sorted(tuple(r) for r in sessions.gap_sessions(spark.createDataFrame(rows, VALUES)).collect())
    assert batch == sessions_by_hand(rows, gap) and len(batch) > 5
    source = lambda: sessions.gap_sessions(spark.readStream.schema(VALUES).option("maxFilesPerTrigger", 1).parquet(f"{path}/rows"))
    late = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rng.uniform(0, 100)))
    for part in (late[:30], late[30:50]):
        write(spark, f"{path}/rows", part, VALUES)
    run(source(), "out", path)
    some = spark.read.parquet(f"{path}/out").count()
    for part in (late[50:], [("a", T0, 99.0)], [("z", T0 + dt.timedelta(days=90), 0.0)], [("z", T0 + dt.timedelta(days=91), 0.0)]):
        write(spark, f"{path}/rows", part, VALUES)
    run(source(), "out", path)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{path}/out").where("symbol <> 'z'").collect())
    assert got == batch and 0 < some < len(batch)


def test_upsert_once_even_if_replayed(spark, tmp_path):
    """The commit of the last batch is lost, as when a job dies after writing: the restart writes the batch again, and no row is there twice."""
    path, schema = f"file://{tmp_path}", "symbol string, ts timestamp, x double, seen int"
    at = lambda h: T0 + dt.timedelta(hours=h)
    parts = [[("a", at(0), 1.0, 1), ("a", at(1), 2.0, 1), ("b", at(0), 3.0, 1)], [("a", at(1), 5.0, 2), ("a", at(1), 4.0, 3), ("b", at(2), None, 2)], [("b", at(2), 7.0, 1), ("a", at(3), 8.0, 1)]]
    put, calls = sessions.upsert_into(f"{path}/table", order="seen"), []

    def start():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        q = stream.writeStream.foreachBatch(lambda batch, n: (calls.append(n), put(batch, n))).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination(300)

    for part in parts[:2]:
        write(spark, f"{path}/in", part, schema)
    start()
    for f in [*glob.glob(f"{tmp_path}/state/commits/1"), *glob.glob(f"{tmp_path}/state/commits/.1.crc")]:
        os.remove(f)
    write(spark, f"{path}/in", parts[2], schema)
    start()
    assert calls == [0, 1, 1, 2]
    want = [("a", at(0), 1.0, 1), ("a", at(1), 4.0, 3), ("a", at(3), 8.0, 1), ("b", at(0), 3.0, 1), ("b", at(2), 7.0, 1)]
    read = lambda p: sorted(tuple(r) for r in sessions.read_upserted(spark, p).collect())
    assert read(f"{path}/table") == want
    sessions.compact(spark, f"{path}/table", 2, f"{path}/small")
    assert read(f"{path}/small") == want and len(glob.glob(f"{tmp_path}/small/batch=*")) == 2
