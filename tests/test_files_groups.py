"""Sources and sinks round trip, settings, periods, names, the registry of groups and its driver."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidewright.functions import names, periods
from tidewright.operators import analytics, groups
from tidewright.sources import bars as src
from tidewright.sources import files

SF = "/root/testdata/sf0.001"
HOUR = 3_600_000


def write_lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_klines_in_pages_and_slices(spark, tmp_path):
    rows = [{"time": i * HOUR, "open": 1.0, "high": 2.0, "low": 0.5, "close": float(i), "volume": 3.0, "quote_volume": 4.0, "trades": 5.0, "taker_buy_quote_volume": 1.0} for i in range(100)]
    write_lines(tmp_path / "A.json", rows)
    write_lines(tmp_path / "B.json", rows[:10])
    got = files.paged(spark, str(tmp_path), ["A", "B"], 0, 100 * HOUR, 24 * HOUR, page=7)
    assert got.rdd.getNumPartitions() == 10 and got.groupBy("symbol").count().orderBy("symbol").collect() == [("A", 100), ("B", 10)]
    k = files.klines(spark, str(tmp_path), ["A"], 0, 50 * HOUR).orderBy("ts").collect()
    assert len(k) == 50 and k[3].ts == dt.datetime(1970, 1, 1, 3) and k[3].taker_sell_quote_volume == 3.0
    f = files.futures(spark, str(tmp_path), ["B"], 0, 100 * HOUR).orderBy("ts").collect()
    assert f[2].taker_buy_quote_volume == 3.0
    assert files.index_series(spark, str(tmp_path), "B", 0, 100 * HOUR).orderBy("ts").collect()[2].returns == 1.0


def test_funding_and_options_sources(spark, tmp_path):
    write_lines(tmp_path / "A.json", [{"time": 8 * HOUR + 5, "fundingRate": "0.1"}, {"time": 9 * HOUR, "fundingRate": "0.3"}, {"time": 17 * HOUR, "fundingRate": "bad"}])
    assert [tuple(r) for r in files.funding_history(spark, str(tmp_path), ["A"], 0, 100 * HOUR).collect()] == [("A", dt.datetime(1970, 1, 1, 8), pytest.approx(0.2))]
    start = 1616457600000  # 2021-03-23
    write_lines(tmp_path / "D.json", [{"time": start + i * 24 * HOUR, "close": float(i)} for i in range(4)])
    got = files.options_volatility(spark, str(tmp_path), "D", start, start + 200 * HOUR).orderBy("ts").collect()
    assert [r.implied_volatility for r in got] == [1.0, 2.0, 3.0]


def test_vix_text_and_fear_greed(spark, tmp_path):
    (tmp_path / "vix.txt").write_text("01/02/2024,09:30,1,2,0.5,1.5\nbad,row,1,1,1,1\n")
    assert [tuple(r) for r in files.read_vix(spark, str(tmp_path / "vix.txt")).collect()] == [(dt.datetime(2024, 1, 2, 9, 30), 1.0, 2.0, 0.5, 1.5)]
    raw = spark.createDataFrame([(i * 86400, str(i)) for i in range(5)] + [(9, "x")], "timestamp long, value string")
    got = files.fear_greed(raw).orderBy("ts").collect()
    assert [(r.ts.day, r.fear_greed_value) for r in got] == [(2, 0.0), (3, 1.0), (4, 2.0)]


def test_heatmap_json(spark, tmp_path):
    body = {"success": True, "data": {"y": [10.0, 20.0], "liq": [[0, 0, 5.0], [0, 0, 7.0], [1, 1, 3.0], [9, 1, 3.0]], "prices": [[0, 1, 1, 1, 1, 1], [3600, 1, 1, 1, 1, 1]]}}
    (tmp_path / "heat.json").write_text(json.dumps(body))
    levels, triples, prices = files.read_heatmap(spark, str(tmp_path / "heat.json"))
    got = {(r.ts.hour, r.level): r.value for r in analytics.heatmap_triples(triples, levels, prices, prices.select("ts")).collect()}
    assert got == {(0, 10.0): 7.0, (0, 20.0): 0.0, (1, 10.0): 0.0, (1, 20.0): 3.0}
    (tmp_path / "none.json").write_text(json.dumps({"success": False, "data": None}))
    assert files.read_heatmap(spark, str(tmp_path / "none.json"))[0].count() == 0


def test_raw_features_and_results(spark, tmp_path):
    bars = src.hourly(spark, SF)
    at = f"file://{tmp_path}"
    files.save_raw(bars, f"{at}/raw")
    files.save_raw(bars.where("symbol = 'view'").limit(3), f"{at}/raw")
    assert files.load_raw(spark, f"{at}/raw", "view").count() == 3 and files.load_raw(spark, f"{at}/raw", "click").count() == bars.where("symbol = 'click'").count()
    for name in ("one", "two"):
        files.write_features(bars.select("symbol", "ts", F.lit(name).alias("x")), f"{at}/features", name)
    assert files.read_features(spark, f"{at}/features", "one", "view").first().x == "one" and files.read_features(spark, f"{at}/features", "two").count() == bars.count()
    meta = files.read_metadata(spark, f"{at}/features").orderBy("group").collect()
    assert [(r.group, r.rows) for r in meta] == [("one", bars.count()), ("two", bars.count())]
    bars.where("symbol = 'view'").drop("symbol").limit(5).coalesce(1).write.option("header", True).csv(f"{at}/csv")
    part = next(p for p in (tmp_path / "csv").iterdir() if p.suffix == ".csv")
    part.rename(tmp_path / "csv" / "view.csv")
    assert {r.symbol for r in files.csv_by_file(spark, f"{at}/csv/view.csv").collect()} == {"view"}
    files.write_results(bars.select("symbol", "ts"), bars.select("symbol", F.create_map(F.lit("a"), "close").alias("params")), bars.groupBy("symbol").count(), f"{at}/results")
    assert spark.read.option("header", True).csv(f"{at}/results/state_history").count() == bars.count() and spark.read.json(f"{at}/results/metrics").count() == 5
    entries = analytics.catalog_entries(bars, f"{at}/raw")
    assert analytics.load_source(entries, "view").count() == 3
    with pytest.raises(KeyError):
        analytics.load_source(entries, "nothing")


def test_settings_files(spark, tmp_path):
    (tmp_path / "s.yaml").write_text("# run\nbacktest:\n  symbol: 'A'\n  time:\n    trading_hours: [9, 16]  # hours\n    allow: true\nexecution:\n  fee: 0.5\n")
    assert files.read_settings(str(tmp_path / "s.yaml")) == {"backtest": {"symbol": "A", "time": {"trading_hours": [9, 16], "allow": True}}, "execution": {"fee": 0.5}}
    (tmp_path / "l.yaml").write_text("a:\n  days:\n    - monday\n    - 'friday'\n  n: 1\nb:\n- 1\n- 2.5\n- x y\nc: [1]\nd:\n")
    assert files.read_settings(str(tmp_path / "l.yaml")) == {"a": {"days": ["monday", "friday"], "n": 1}, "b": [1, 2.5, "x y"], "c": [1], "d": {}}
    tree = {"events": {"economic": {"JOBS": "first_friday", "RATES": ["2024-01-31"]}, "halvings": ["2024-04-20"]}, "time_features": {"sessions": {"asia": ["22:00", "07:30"]}}}
    (tmp_path / "s.json").write_text(json.dumps(tree))
    assert files.read_settings(str(tmp_path / "s.json")) == tree
    assert {(r.category, r.name, str(r.date), r.rule) for r in files.event_table(spark, tree).collect()} == {("economic", "JOBS", "None", "first_friday"), ("economic", "RATES", "2024-01-31", None), ("halvings", "halvings", "2024-04-20", None)}
    assert [tuple(r) for r in files.session_table(spark, tree).collect()] == [("asia", 1320, 450)]


def test_periods_and_names():
    assert [periods.seconds(p) for p in ("30s", "5m", "4h", "1D", "2w")] == [30, 300, 14400, 86400, 1209600]
    assert [periods.kind(p) for p in ("4h", 24, "session_asia", "alltime", "hour")] == ["fixed", "numeric", "categorical", "alltime", "categorical"]
    assert periods.window_rows("1d", "1h") == 24
    periods.check_window("alltime", "expanding")
    for bad in ("h4", "4x", "", None, "0h"):
        with pytest.raises(ValueError):
            periods.seconds(bad)
    with pytest.raises(ValueError):
        periods.check_window("4h", "developing")
    assert names.feature_name("macd", "1h", "hist", (12, 26, 9), 168) == "macd_1h_12_26_9_hist_zscore_168"
    assert names.feature_name("bands", "4h", "upper", (1.5,)) == "bands_4h_1p5_upper" and names.short_symbol("BTCUSDT") == "btc"


def test_registry_and_driver(spark, tmp_path):
    assert groups.Groups.find("Volume-Metrics").name == "volume_metrics" and "macd" in groups.Groups.names()
    with pytest.raises(KeyError):
        groups.Groups.find("nothing")
    bars = src.hourly(spark, SF).where("symbol in ('view', 'click')")
    with pytest.raises(groups.MissingColumns, match="close"):
        groups.Groups.find("rsi").apply(bars.drop("close"))

    def sink(frame, name):
        files.write_features(frame, f"file://{tmp_path}/f", name)
        return files.read_features(spark, f"file://{tmp_path}/f", name)

    out, report = groups.run_groups(bars, ["rsi", "market_structure"], sink=sink)
    assert out.count() == bars.count() and [r["group"] for r in report] == ["rsi", "market_structure"]
    assert sum(c.startswith("rsi_1h_14_") for c in out.columns) == sum(c.startswith("rsi_1h_7_") for c in out.columns) > 3
    assert len(groups.slowest(report, 1)) == 1 and set(bars.columns) <= set(out.columns)
    wide = groups.group_features(bars, groups.Groups.find("rsi"), 4, ({"period": 7},))
    assert any(c.startswith("rsi_4h_28_") for c in wide.columns)


class Range:
    """A group of one's own."""

    name, required = "range", ("high", "low")
    sets = ({"power": 1}, {"power": 2})

    def apply(self, bars, power=1):
        return bars.select("symbol", "ts", F.pow(F.col("high") - F.col("low"), F.lit(power)).alias("spread"))


class OfFeatures:
    name, required, uses_features = "sum", ("range_1h_1_spread",), True

    def apply(self, bars):
        return bars.select("symbol", "ts", (F.col("range_1h_1_spread") + F.col("range_1h_2_spread")).alias("both"))


def test_groups_of_ones_own(spark):
    bars = src.hourly(spark, SF).where("symbol in ('view', 'click')")
    out, report = groups.run_groups(bars, [Range(), "cycle", OfFeatures()])
    assert [r["group"] for r in report] == ["range", "cycle", "sum"] and [r["features"] for r in report] == [2, 3, 1]
    row = out.where("high > low").first()
    assert row.range_1h_2_spread == pytest.approx(row.range_1h_1_spread**2) and row.sum_1h_both == pytest.approx(row.range_1h_1_spread + row.range_1h_2_spread)
    with pytest.raises(groups.MissingColumns, match="range_1h_1_spread"):
        groups.run_groups(bars, [OfFeatures()])
    for name in ("regimes", "relationship", "index", "fear_greed", "cycle", "time_ranges"):
        assert groups.Groups.find(name).name == name
    against = groups.group_features(bars, groups.Groups.find("relationship"), sets=({"benchmark": "view"},))
    assert {r.symbol for r in against.select("symbol").distinct().collect()} == {"click"}


def test_catalog_versions(spark, tmp_path):
    bars, at = src.hourly(spark, SF), f"file://{tmp_path}/catalog"
    with pytest.raises(FileNotFoundError):
        analytics.load_catalog(spark, at)
    entries = analytics.catalog_entries(bars, "raw").withColumn("nickname", F.concat(F.lit("binance_"), "nickname"))
    assert analytics.save_catalog(entries, at) == 1
    more = entries.limit(1).withColumns({"source_id": F.lit("vix_daily"), "nickname": F.lit("vix_daily")})
    assert analytics.save_catalog(analytics.upsert(analytics.load_catalog(spark, at), more), at) == 2
    (tmp_path / "catalog" / "version=3").mkdir()  # a version that was cut off
    assert analytics.load_catalog(spark, at).count() == entries.count() + 1 and analytics.load_catalog(spark, at, 1).count() == entries.count()
    kinds = analytics.source_priorities(spark)
    status = {r.source_type: r for r in analytics.collection_status(analytics.load_catalog(spark, at), kinds).collect()}
    assert status["binance"].sources == entries.count() and status["vix"].collected and not status["deribit"].collected and status["deribit"].start is None
    assert [r.timing for r in analytics.catalog_report(analytics.load_catalog(spark, at), kinds).collect()] == ["t-1"] * (entries.count() + 1)
