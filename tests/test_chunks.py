"""Rolling functions in pieces of time give what they give over whole histories, from several tasks for one symbol."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidewright.functions.chunks import chunked, with_z
from tidewright.functions.win import by_symbol, frame, lag, numbered, time_since, zscore
from tidewright.operators import analytics, features

T0 = dt.datetime(2024, 1, 1)


def rolled(df):
    return df.select("symbol", "ts", lag("x", 5).alias("l"), F.sum("x").over(frame(7)).alias("s"), F.count("x").over(frame(7)).alias("n"))


def table(spark):
    """Symbols with full days, with gaps of many days (fewer rows a day than are looked back at), with one row, and without a name."""
    rows = [("full", T0 + dt.timedelta(hours=i), float(i * i % 97), 1) for i in range(24 * 9)]
    rows += [("gaps", T0 + dt.timedelta(hours=17 * i * (1 + i % 3)), float(i), 1) for i in range(40)]
    rows += [("one", T0, 5.0, 1), *[(None, T0 + dt.timedelta(hours=11 * i), None if i % 4 == 0 else float(i), 1) for i in range(30)]]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double, other int").dropDuplicates(["symbol", "ts"])


@pytest.mark.parametrize("unit", ["day", "week", "month", "year"])
def test_pieces_equal_the_whole(spark, unit):
    df = table(spark).cache()
    key = lambda r: (str(r.symbol), r.ts)
    whole, pieces = sorted(rolled(df).collect(), key=key), sorted(chunked(df, rolled, 7, unit).collect(), key=key)
    assert pieces == whole and len(whole) == df.count()


def test_more_than_one_task_a_symbol(spark):
    df, name = table(spark).where("symbol = 'full'"), "spark.sql.adaptive.coalescePartitions.enabled"
    tasks = lambda d: rolled(d).withColumn("task", F.spark_partition_id())
    before = spark.conf.get(name)
    spark.conf.set(name, "false")  # else small partitions are put together again
    try:
        whole, pieces = (len({r.task for r in d.collect()}) for d in (tasks(df), chunked(df, tasks, 7, "day")))
    finally:
        spark.conf.set(name, before)
    assert whole == 1 and pieces > 1


def test_no_row(spark):
    df = table(spark).where("x > 1e9")
    assert chunked(df, rolled, 7).count() == 0 and chunked(df, rolled, 7).schema["symbol"].dataType.simpleString() == "string"


def test_volumes_by_season_look_up_whole_history(spark):
    """Flags of a row's own time, volumes of the row before, by hand: weekend is Friday 23:00 to Sunday 16:59."""
    rows = [("a", dt.datetime(2024, 1, 5, 22) + dt.timedelta(hours=i), v, v / 2) for i, v in enumerate([1.0, 2.0, 4.0, 8.0])]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, quote_volume double, taker_buy_quote_volume double")
    got = features.volume_seasons(bars, ("is_weekend", "quarter")).orderBy("ts").collect()
    assert [r.is_weekend_total for r in got] == [None, 7.0, 7.0, 7.0]
    assert [r.quarter_buy for r in got] == [3.5] * 4 and got[1].is_weekend_ratio == 0.5
    assert got[1].is_weekend_concentration == pytest.approx(4 / (7 / 3))
    assert "is_fomc_total" in features.volume_seasons(bars, None, {"fomc": ("2024-01-06",)}).columns


def looks_ahead(df):
    around = by_symbol().rowsBetween(-7, 5)
    return df.select("symbol", "ts", F.sum("x").over(around).alias("s"), F.count(F.lit(1)).over(around).alias("n"))


@pytest.mark.parametrize("unit", ["day", "month"])
def test_rows_ahead(spark, unit):
    df = table(spark).cache()
    key = lambda r: (str(r.symbol), r.ts)
    assert sorted(chunked(df, looks_ahead, 7, unit, ahead=5).collect(), key=key) == sorted(looks_ahead(df).collect(), key=key)


def plain_z(df, names, least=(168, 720), since=None, unit=None):
    """with_z by windows over whole histories."""
    s = numbered(df)
    return s.withColumns({k: time_since(c) for k, c in (since or {}).items()} | {f"{c}_z{n}": zscore(c, n) for c in names for n in least}).drop("rn")


def close_to(x, y):
    return x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-7, abs_tol=1e-7))


def same_rows(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    columns = sorted(a.columns)
    key = lambda r: (str(r.symbol), r.ts)
    a, b = sorted(a.collect(), key=key), sorted(b.collect(), key=key)
    assert len(a) == len(b)
    wrong = [(r.symbol, r.ts, c, r[c], s[c]) for r, s in zip(a, b) for c in columns if not close_to(r[c], s[c])]
    assert not wrong, wrong[:5]


@pytest.mark.parametrize("unit", ["day", "week", "year"])
def test_scores_and_rows_since(spark, unit):
    """Values far from 0, constants and NULLs at the start and in between."""
    df = table(spark).withColumns({"far": 1e6 + F.col("x") / 10, "flat": F.lit(0.1), "late": F.when(F.dayofmonth("ts") > 4, F.col("x")), "none": F.lit(None).cast("double")}).cache()
    names, since = ["x", "far", "flat", "late", "none"], {"since_big": F.col("x") > 60, "since_never": F.col("x") > 1e9}
    got = with_z(df, names, (2, 20), since, unit)
    same_rows(got, plain_z(df, names, (2, 20), since))
    assert {r.flat_z2 for r in got.collect()} == {0.0} == {r.none_z2 for r in got.collect()}


def hours(spark, days):
    r, rows = random.Random(5), []
    for symbol, price in (("a", 30000.0), ("b", 2.0)):
        for i in range(24 * days):
            if r.random() < 0.03:
                continue
            o, price = price, price * math.exp(r.gauss(0, 0.01))
            v = r.uniform(1, 100)
            rows.append((symbol, dt.datetime(2024, 2, 20) + dt.timedelta(hours=i), o, max(o, price) * 1.002, min(o, price) * 0.997, price, v, v, v * price, v * price * r.random()))
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, trades double, quote_volume double, taker_buy_quote_volume double")


LEVELS = {"low": (30,), "high": (70,)}
GROUPS = {
    "bollinger": {"sigmas": (2,), "levels": (2.0,)}, "rsi": LEVELS, "stochastic": LEVELS, "macd": {}, "candles": {}, "volume_momentum": {"periods": (5, 20), "widths": (24,)}, "vwap": {"mults": (2.0,)}, "volume_profile": {},
    "price_levels": {}, "market_structure": {}, "volatility": {"widths": (24, 72)}, "returns": {"lags": (1, 5), "widths": (5, 50)}, "relationship": {"benchmark": "b", "widths": (24, 72)}, "aux_series": {"widths": (24,)},
    "fear_greed_features": {"widths": (24, 72)},
}


def test_risk_windows_in_pieces_equal_whole_histories(spark, monkeypatch):
    frame = analytics.pnl_frame(hours(spark, 60)).cache()
    pieces = analytics.risk_windows(frame)
    monkeypatch.setattr(analytics, "chunked", lambda df, make, *_, **__: make(df))
    same_rows(pieces, analytics.risk_windows(frame))


@pytest.mark.parametrize("group", GROUPS)
def test_groups_in_pieces_equal_whole_histories(spark, monkeypatch, group):
    bars = hours(spark, 60).withColumn("value", F.round("volume")).cache()
    make = lambda: getattr(features, group)(bars, **GROUPS[group])
    given = features.chunked
    monkeypatch.setattr(features, "chunked", lambda df, make, reach, unit="month", ahead=0: given(df, make, reach, "month", ahead))
    pieces = make()
    monkeypatch.setattr(features, "chunked", lambda df, make, *_, **__: make(df))
    monkeypatch.setattr(features, "with_z", plain_z)
    same_rows(pieces, make())
