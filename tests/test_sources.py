"""Paged reading in both directions, catalogs from footers, events by table."""

import datetime as dt
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewright.operators import events
from tidewright.sources import bars as src
from tidewright.sources import files, footers, paged

SF = "/root/testdata/sf0.001"
HOUR = 3_600_000


def write_lines(path, rows, end="\n"):
    path.write_text("\n".join(json.dumps(r) for r in rows) + (end if rows else ""))


class Counted(pa.PythonFile):
    """A file that counts the bytes that are read of it."""

    read_bytes = 0

    def read(self, n=None):
        out = super().read(n)
        self.read_bytes += len(out)
        return out


@pytest.mark.parametrize("end", ["\n", ""])
@pytest.mark.parametrize("seed", range(3))
def test_lines_by_time(tmp_path, monkeypatch, seed, end):
    """Any range, forward and back, with ties, gaps and long lines, as a plain filter gives it."""
    monkeypatch.setattr(paged, "LINE_BYTES", 64)
    rng, rows, time = random.Random(seed), [], 0
    for i in range(120):
        time += rng.choice([0, 0, 1, 5, 400])
        rows.append({"time": time, "i": i, "pad": "x" * rng.randrange(150)})
    write_lines(tmp_path / "a.json", rows, end)
    file = paged.LineFile(pa.OSFile(str(tmp_path / "a.json")))
    for _ in range(40):
        a, b = sorted((rng.randrange(-5, time + 5), rng.randrange(-5, time + 5)))
        want = [r["i"] for r in rows if a <= r["time"] < b]
        bounds = file.place(a), file.place(b)
        assert [json.loads(x)["i"] for _, x in file.forward(*bounds)] == want
        back = list(file.back(*bounds))
        assert [json.loads(x)["i"] for _, x in back] == want[::-1] and [o for o, _ in back] == sorted((o for o, _ in back), reverse=True)


@pytest.mark.parametrize("direction", ["forward", "backward"])
def test_pages(spark, tmp_path, direction):
    """Ties across pages, gaps longer than a slice, an empty file, a symbol without file."""
    times = [0, 1, 1, 1, 1, 2, 50, 50, 51, 300, 300, 300, 399]
    write_lines(tmp_path / "A.json", [{"time": t, "close": float(i)} for i, t in enumerate(times)])
    write_lines(tmp_path / "B.json", [])
    got = paged.paged(spark, str(tmp_path), ["A", "B", "C"], 1, 399, 100, "symbol string, time long, close double, at long, level int", page=2, direction=direction).collect()
    assert sorted((r.time, r.close) for r in got) == [(t, float(i)) for i, t in enumerate(times) if 1 <= t < 399]
    assert {r.symbol for r in got} == {"A"} and {r.level for r in got} == {0} and len({r.at for r in got}) == len(got)


def test_no_page_reads_a_file_again(tmp_path):
    rows = [{"time": i, "close": 1.0, "pad": "x" * 200} for i in range(5_000)]
    write_lines(tmp_path / "A.json", rows)
    size = (tmp_path / "A.json").stat().st_size
    for backward in (False, True):
        with open(tmp_path / "A.json", "rb") as f:
            source = Counted(f, "r")
            file = paged.LineFile(source)
            list((file.back if backward else file.forward)(0, size))
            assert source.read_bytes <= size + paged.LINE_BYTES
            source.read_bytes = 0
            bounds = file.place(2_000), file.place(2_100)
            list((file.back if backward else file.forward)(*bounds))
            assert source.read_bytes < 40 * paged.LINE_BYTES


def pages_with_gaps(path, backward):
    """A service whose pages may be empty before the last."""

    def fetch(symbol, start, end, limit, cursor):
        n = cursor or 0
        rows = [{"symbol": symbol, "time": start + n, "close": float(n)}] if n % 3 == 2 and path == "fine" and symbol != "none" else [{"symbol": symbol, "time": start, "close": -1.0}] if path == "coarse" and n == 4 else []
        return rows, n + 1 if n < 9 else None

    return fetch


def test_empty_pages_and_fallback(spark, tmp_path):
    schema = "symbol string, time long, close double, level int"
    got = paged.paged(spark, "fine", ["a", "none"], 0, 40, 20, schema, fetcher=f"{__name__}:pages_with_gaps", fallback="coarse").collect()
    assert sorted(tuple(r) for r in got if r.symbol == "a") == [("a", s + n, float(n), 0) for s in (0, 20) for n in (2, 5, 8)]
    assert sorted(tuple(r) for r in got if r.symbol == "none") == [("none", 0, -1.0, 1), ("none", 20, -1.0, 1)]
    (tmp_path / "h").mkdir(), (tmp_path / "d").mkdir()
    write_lines(tmp_path / "h" / "V.json", [{"time": 24 * HOUR + i * HOUR, "close": 1.0 + i} for i in range(3)])
    write_lines(tmp_path / "d" / "V.json", [{"time": d * 24 * HOUR, "close": 100.0 * (d + 1)} for d in range(3)])
    found = files.index_series(spark, str(tmp_path / "h"), "V", 0, 72 * HOUR, daily=str(tmp_path / "d")).orderBy("ts").collect()
    assert [r.close for r in found] == [100.0, 1.0, 2.0, 3.0, 300.0]


def test_last_row_of_a_time_is_kept_whole(spark):
    """By arrival, not column by column, whatever order rows are read in."""
    rows = [("a", 0, 1.0, None, 5), ("a", 0, None, 7.0, 9), ("a", 0, 3.0, 8.0, 2), ("a", None, 1.0, 1.0, 1), ("b", 0, 2.0, None, 0)]
    for each in (rows, rows[::-1]):
        got = files.at_millis(spark.createDataFrame(each, "symbol string, time long, x double, y double, at long")).orderBy("symbol").collect()
        assert [(r.symbol, r.x, r.y) for r in got] == [("a", None, 7.0), ("b", 2.0, None)] and "at" not in got[0]
        plain = files.at_millis(spark.createDataFrame([r[:4] for r in each], "symbol string, time long, x double, y double")).orderBy("symbol").collect()
        assert (plain[0].x, plain[0].y) == (3.0, 8.0)


def test_catalog_from_footers(spark, tmp_path):
    """As a scan gives it; and no column chunk is read: all bytes but the footers are wiped."""
    bars = src.hourly(spark, SF)
    bars.repartition(3).write.partitionBy("symbol").parquet(f"file://{tmp_path}/tables/bars")
    spark.createDataFrame([(1, None), (2, None)], "a int, ts timestamp_ntz").write.parquet(f"file://{tmp_path}/tables/empty")
    for f in (tmp_path / "tables").rglob("*.parquet"):
        raw = f.read_bytes()
        footer = int.from_bytes(raw[-8:-4], "little") + 8
        f.write_bytes(b"\0" * (len(raw) - footer) + raw[-footer:])
    got = footers.file_catalog(spark, f"file://{tmp_path}/tables").cache()
    by = {r.source: r for r in footers.source_catalog(got, F.regexp_extract("path", r"symbol=([^/]+)/", 1)).collect()}
    for r in bars.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n")).collect():
        s = by[r.symbol]
        assert (s.start, s.end, s.rows) == (r.a, r.b, r.n) and set(s.columns) == set(bars.columns) - {"symbol"}
    assert (by[""].rows, by[""].start, by[""].columns) == (2, None, ["a", "ts"])
    assert sum(r.bytes for r in got.collect()) == sum(f.stat().st_size for f in (tmp_path / "tables").rglob("*.parquet"))


def test_catalog_of_csv(spark, tmp_path):
    (tmp_path / "long.csv").write_text("ts,x\n" + "".join(f"2024-01-01 {h:02}:00:00,{'9' * 9000}\n" for h in range(24)))
    (tmp_path / "one.csv").write_text("x,ts\n1,2024-02-03T04:05:06")
    (tmp_path / "head.csv").write_text("ts,x\n")
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    got = {r.path.split("/")[-1]: (r.start, r.end, r.columns) for r in footers.file_catalog(spark, str(tmp_path)).collect()}
    assert got["long.csv"] == (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 23), ["ts", "x"])
    assert got["one.csv"] == (dt.datetime(2024, 2, 3, 4, 5, 6),) * 2 + (["x", "ts"],)
    assert got["head.csv"] == (None, None, ["ts", "x"]) and "none.csv" not in got and got["other.csv"][2] == ["a", "b"]


def test_events_by_table(spark, monkeypatch):
    moments = [dt.datetime(2024, 1, 5, 23), dt.datetime(2024, 1, 12), dt.datetime(2020, 3, 13, 5), dt.datetime(2024, 5, 1, 9), dt.datetime(2024, 11, 5), None]
    bars = spark.createDataFrame([("a", t) for t in moments], "symbol string, ts timestamp_ntz")
    for limit in (events.BROADCAST_BYTES, 0):
        monkeypatch.setattr(events, "BROADCAST_BYTES", limit)
        made = events.event_flags(bars, events.known_events(spark))
        assert ("Broadcast" in made._jdf.queryExecution().optimizedPlan().toString().title()) == bool(limit)
        got = {r.ts: {c[3:] for c in made.columns if c.startswith("is_") and r[c]} for r in made.collect()}
        assert [got[t] for t in moments] == [{"NFP"}, set(), {"COVID_EMERGENCY"}, {"FOMC"}, {"US_ELECTION"}, set()]
    own = spark.createDataFrame([("x", "both", dt.date(2024, 1, 12), None), ("y", "both", None, "late"), ("x", None, dt.date(2024, 1, 12), None), ("x", "never", None, None)], "category string, name string, date date, rule string")
    found = events.event_flags(bars, own, {"late": F.hour("ts") >= 23}).collect()
    assert {r.ts: (r.is_both, r.is_never) for r in found} == {t: (int(t in (moments[0], moments[1])), 0) for t in moments}
    assert events.event_flags(bars, own.limit(0)).columns == ["symbol", "ts"] and events.event_flags(bars.limit(0), own.limit(1)).count() == 0
    with pytest.raises(ValueError, match="late"):
        events.event_flags(bars, own)
