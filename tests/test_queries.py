"""Every query with SQL against DuckDB on the smallest tables, and hand-made cases for what SQL doesn't express."""

import datetime as dt
import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewright.functions import win
from tidewright.operators import features, trading
from tidewright.plans import registry
from tidewright.sources import bars as src
from tidewright.sources import files
from tidewright.streaming.bars import hourly_stream

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)


def rows_of(columns, rows):
    return sorted(repr([round(r[c], 7) if isinstance(r[c], float) else r[c] for c in columns]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_duckdb(spark, name):
    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    found = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    df = registry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    columns = sorted(names)
    assert rows_of(columns, [r.asDict() for r in df.collect()]) == rows_of(columns, [dict(zip(names, r)) for r in found.fetchall()])


def made(spark, closes, **more):
    rows = [("a", T0 + dt.timedelta(hours=i), c, *[v[i] for v in more.values()]) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double" + "".join(f", {k} double" for k in more))


def test_rising_price_has_rsi_100(spark):
    got = features.rsi(made(spark, [float(i) for i in range(1, 40)])).orderBy("ts").collect()
    assert got[0].rsi is None and got[-1].rsi == 100.0


def test_flat_price_is_null_or_zero(spark):
    flat = made(spark, [5.0] * 30, high=[5.0] * 30, low=[5.0] * 30)
    last = features.stochastic(flat).orderBy("ts").collect()[-1]
    assert last.k is None and last.k_z168 == 0.0
    assert features.bollinger(flat.limit(0)).count() == 0


def test_ewm_over_chunks(spark):
    x = [None, 3.0, None, 5.0, 4.0, 8.0, 1.0]
    got = win.ewm(made(spark, x), "close", [3], F.floor(F.hour("ts") / 2)).orderBy("ts").collect()
    y, want = None, []
    for v in x:
        y = y if v is None else v if y is None else y + 0.5 * (v - y)
        want.append(y)
    assert [r.ewm_3 for r in got] == pytest.approx(want, nan_ok=True) if None not in want[1:] and want[0] is not None else [r.ewm_3 for r in got][0] is None and [r.ewm_3 for r in got][1:] == pytest.approx(want[1:])


def test_features_see_only_the_past(spark):
    bars = src.hourly(spark, SF).where("symbol = 'view'")
    cut = bars.agg(F.expr("percentile_approx(cast(ts as timestamp), 0.5)")).first()[0]
    early = bars.where(F.col("ts") <= F.lit(cut).cast("timestamp_ntz"))
    for group in (features.bollinger, features.rsi, features.macd, features.candles, features.returns, features.volume_profile):
        whole, part = ({r.ts: r for r in group(d).collect()} for d in (bars, early))
        assert all(whole[t] == r for t, r in part.items())


def test_replay_by_hand(spark):
    config = trading.ReplayConfig(equity=1000.0, notional=100.0, taker_bps=10.0, maker_bps=0.0, offset_bps=0.0, max_age=1)
    bars = spark.createDataFrame([("a", T0 + dt.timedelta(hours=i), h, lo, c, s) for i, (h, lo, c, s) in enumerate([(10.0, 10.0, 10.0, 1), (12.0, 9.0, 12.0, 0), (12.0, 11.0, 12.0, -1), (10.0, 8.0, 8.0, 0)])], "symbol string, ts timestamp_ntz, high double, low double, close double, signal int")
    got = trading.replay(bars, config).orderBy("ts").collect()
    assert [r.event for r in got] == ["maker", "", "maker", ""]
    assert got[0].size == 10 and got[1].unrealized == 20
    assert got[2].realized == 20 and got[2].size == pytest.approx(-100 / 12)
    assert got[3].equity == pytest.approx(1020 + 100 / 12 * 4)
    with pytest.raises(ValueError):
        trading.ReplayConfig(max_leverage=0.5)


def test_sessions_overlap():
    assert features.check_sessions(features.SESSIONS) == [("london", "us")]


def test_files_round_trip(spark, tmp_path):
    bars = src.hourly(spark, SF)
    meta = files.write_features(bars, f"file://{tmp_path}/out", "bars").first()
    assert meta.rows == bars.count()
    bars.select("symbol", "ts", "open", "high", "low", "close", "volume", "quote_volume", "trades", "taker_buy_quote_volume").write.option("header", True).csv(f"file://{tmp_path}/csv")
    assert src.read_csv(spark, f"file://{tmp_path}/csv").count() == bars.count()


def test_stream_equals_batch(spark, tmp_path):
    src.table(spark, SF, "events").write.parquet(f"file://{tmp_path}/events")
    schema = spark.read.parquet(f"file://{tmp_path}/events").schema
    stream = hourly_stream(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/events"))
    q = stream.writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/state").start()
    q.processAllAvailable()
    q.stop()
    columns = ["symbol", "ts", "open", "close", "high", "low", "volume", "trades", "quote_volume", "taker_buy_quote_volume"]
    assert rows_of(columns, spark.table("hours").collect()) == rows_of(columns, src.hourly(spark, SF).collect())


def test_volume_profile_by_brute_force(spark):
    table = src.hourly(spark, SF).where("symbol = 'view'")
    bars = table.orderBy("ts").collect()
    got = features.volume_profile(table, 8, 10).orderBy("ts").collect()
    assert len(got) == len(bars) and got[3].poc is None
    for i in range(8, len(bars)):
        last = bars[i - 8 : i]
        low, high = min(b.low for b in last), max(b.high for b in last)
        step, raw = (high - low) / 10, [0.0] * 12
        for b in last:
            raw[min(int(((b.high + b.low + b.close) / 3 - low) / step), 9) + 1] += b.quote_volume
        hist = [(raw[k] + raw[k + 1] + raw[k + 2]) / 3 for k in range(10)]
        price = [low + (k + 0.5) * step for k in range(10)]
        falling = sorted(range(10), key=lambda k: (-round(hist[k], 9), k))
        total, inside = 0.0, []
        for k in falling:
            total += hist[k]
            if total > 0.7 * sum(hist):
                break
            inside.append(price[k])
        mean, r, close = sum(hist) / 10, got[i], last[-1].close
        large = [price[k] for k in falling if hist[k] >= 1.5 * mean][:3]
        assert r.poc == pytest.approx(price[falling[0]]) and r.to_poc == pytest.approx((r.poc - close) / close * 100, abs=1e-4)
        assert (r.va_low, r.va_high) == (pytest.approx((min(inside), max(inside))) if inside else (None, None))
        assert [x for x in (r.hvn_1, r.hvn_2, r.hvn_3) if x is not None] == pytest.approx(large)
        small = sorted((k for k in range(10) if hist[k] <= 0.5 * mean), key=lambda k: (round(hist[k], 9), k))[:3]
        assert sorted(x for x in (r.lvn_1, r.lvn_2, r.lvn_3) if x is not None) == pytest.approx(sorted(price[k] for k in small))


def test_aligned_series(spark):
    a, b = made(spark, [1.0, None, 3.0]), made(spark, [9.0, 8.0])
    assert [r.close for r in src.fill_index(a, b, "close").orderBy("ts").collect()] == [9.0, 8.0, 3.0]
    assert src.overlap_ratio(a, b).first().ratio == 0.5


def test_stream_drops_late_rows(spark, tmp_path):
    """Append mode: an hour comes out once the watermark has passed it, and a row that comes later than that is left out."""
    rows = lambda *xs: spark.createDataFrame([(i, T0 + dt.timedelta(hours=h), 1, "view", v, None) for i, (h, v) in enumerate(xs)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    at = f"file://{tmp_path}/events"
    rows((0, 1.0), (0, 2.0)).coalesce(1).write.parquet(at)
    stream = hourly_stream(spark.readStream.schema(spark.read.parquet(at).schema).option("maxFilesPerTrigger", 1).parquet(at))
    q = stream.writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/state").start()
    q.processAllAvailable()
    for batch in (rows((48, 5.0)), rows((0, 100.0), (96, 5.0)), rows((200, 5.0))):
        batch.coalesce(1).write.mode("append").parquet(at)
        q.processAllAvailable()
    q.stop()
    found = {r.ts: r for r in spark.table("late").collect()}
    assert found[T0].high == 2.0 and found[T0].volume == 2.0 and found[T0].taker_buy_quote_volume == 3.0
