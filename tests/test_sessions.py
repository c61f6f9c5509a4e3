"""Scans in pieces and session features against plain Python, over bars with gaps, NULLs and sessions that cross pieces."""

import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewright.functions import scans
from tidewright.operators import sessions

from .test_chunks import hours, table

T0 = dt.datetime(2024, 1, 1)


def scanned(df, each, unit):
    return sorted((tuple(r) for r in scans.scan(df, each, unit).collect()), key=lambda r: (str(r[0]), r[1]))


def test_scans_dont_depend_on_pieces(spark):
    """A day, a month and a year for a piece give the same, with a symbol without name, NULLs and gaps."""
    df = table(spark).withColumns({"flag": F.col("x") % 5 == 0, "key": F.when(F.col("x") % 7 != 3, F.floor(F.dayofmonth("ts") / 2)), "sign": F.when(F.col("x") > 60, 1).when(F.col("x") < 30, -1), "one": F.lit(1)}).cache()
    make = lambda: [scans.Since({"since": "flag"}), scans.Sums({"sums": "one"}), scans.Extreme("x", "top", "since_top"), scans.Extreme("x", "low", "since_low", True), scans.Fill("flag", {"last": "x"}), scans.Fill("flag", {"before": "x"}, True), scans.Runs("key", "one", "run"), scans.Runs("sign", "one", "signs", through=True)]
    whole = scanned(df, make(), "year")
    assert scanned(df, make(), "day") == whole and scanned(df, make(), "month") == whole
    columns = scans.scan(df, make(), "day").columns
    rows = [dict(zip(columns, r)) for r in whole if r[0] == "full"]
    top, hit, run = None, None, 0
    for i, r in enumerate(rows):
        hit = i if r["flag"] else hit
        assert r["since"] == (None if hit is None else i - hit) and r["sums"] == i + 1
        top = r["x"] if top is None or r["x"] >= top else top
        assert r["top"] == top and r["since_top"] == i - max(j for j in range(i + 1) if rows[j]["x"] == top)
        same = i and r["key"] is not None and rows[i - 1]["key"] == r["key"]
        run = run + 1 if same else 1
        assert r["run"] == (None if r["key"] is None else run)


def test_states_merge_associatively():
    """However a history is cut and merged, the state is that of the whole."""
    rng = np.random.default_rng(3)
    n = 60
    raw = {"x": [None if rng.random() < 0.2 else float(rng.integers(0, 4)) for _ in range(n)], "f": [bool(rng.random() < 0.2) for _ in range(n)], "k": [None if rng.random() < 0.1 else int(i // 7 + rng.integers(0, 2)) for i in range(n)], "open": rng.random(n).tolist()}
    piece = pa.table(raw | {c: raw["open"] for c in ("high", "low", "close")})
    each = [scans.Moments(["x"], (2,)), scans.Since({"s": "f"}), scans.Sums({"s": "f"}), scans.Extreme("x", "v", "s"), scans.Fill("f", {"v": "x"}), scans.Runs("k", "open", "r"), scans.Runs("k", "open", "r", True), sessions.OpenSession("k", "o_")]
    plain = lambda s: [plain(v) for v in s] if isinstance(s, tuple | list) else s.tolist() if isinstance(s, np.ndarray) else s
    for scan in each:
        whole = plain(scan.summarise(piece))
        for _ in range(20):
            cuts = sorted({0, n, *rng.integers(1, n, 4).tolist()})
            states = [scan.summarise(piece.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])]
            while len(states) > 1:
                i = int(rng.integers(0, len(states) - 1))
                states[i : i + 2] = [scan.merge(states[i], states[i + 1])]
            got = plain(states[0])
            flat = lambda s: [y for v in s for y in flat(v)] if isinstance(s, list) else [s]
            assert len(flat(got)) == len(flat(whole))
            assert all(a == b or a is not None and b is not None and (a != a and b != b or a == pytest.approx(b)) for a, b in zip(flat(got), flat(whole))), (scan, got, whole)


def test_extremes_by_hand(spark):
    bars = hours(spark, 50).cache()
    got = sorted(sessions.extremes(bars, (24, 48), 20).collect(), key=lambda r: (r.symbol, r.ts))
    for symbol in ("a", "b"):
        mine, found = sorted(bars.where(F.col("symbol") == symbol).collect(), key=lambda r: r.ts), [r for r in got if r.symbol == symbol]
        away = []
        for i, r in enumerate(found):
            if not i:
                assert r.ath is None and r.since_ath == len(mine) and r.to_atl is None
                away.append(None)
                continue
            past = mine[:i]
            top, close = max(b.high for b in past), past[-1].close
            assert r.ath == top and r.atl == min(b.low for b in past) and r.to_ath == round((top - close) / close, 4)
            assert r.since_ath == i - 1 - max(j for j, b in enumerate(past) if b.high == top)
            away.append(r.to_ath)
        means = [None if i < 24 else float(np.mean(away[i - 23 : i + 1])) for i in range(len(away))]
        for i in (30, 60, len(found) - 1):
            known = [m for m in means[: i + 1] if m is not None]
            want = (known[-1] - np.mean(known)) / np.std(known, ddof=1) if len(known) >= 20 and np.std(known) > 1e-12 else 0.0
            assert found[i].to_ath_mean_24_z20 == pytest.approx(want, abs=1e-7)


@pytest.mark.parametrize("mode", ["completed", "developing"])
def test_session_figures_by_hand(spark, mode):
    r = random.Random(4)
    bars = hours(spark, 45).where(~((F.dayofmonth("ts") == 3) & (F.hour("ts") > 9))).cache()  # most of a day is missing
    got = {(x.symbol, x.ts): x for x in sessions.session_figures(bars, mode, widths=(5,), least=3).collect()}
    rows = sorted(bars.where("symbol = 'a'").collect(), key=lambda b: b.ts)
    assert len(got) == bars.count()

    def when(name, ts):
        start, end = sessions.SESSIONS[name]
        inside = ts.hour >= start or ts.hour < end if start > end else start <= ts.hour < end
        day = ts.date() - dt.timedelta(days=1) if start > end and ts.hour < end else ts.date()
        return day if inside else None, end

    for name in sessions.SESSIONS:
        for b in r.sample(rows, 60) + rows[:30]:
            day, end = when(name, b.ts)
            before = [(when(name, x.ts)[0], x) for x in rows if x.ts < b.ts]
            if mode == "developing":
                mine = [x for d, x in before if d == day and d is not None]
            else:
                over = lambda d: b.ts >= dt.datetime.combine(d, dt.time()) + dt.timedelta(hours=end + 24 * (name == "asia"))
                ended = {d for d, _ in before if d is not None and over(d)}
                mine = [x for d, x in before if d == max(ended, default=None) and d is not None]
            found = got["a", b.ts].asDict()
            if not mine:
                assert found[f"{name}_high"] is None and found[f"{name}_wick_ratio"] is None
                continue
            h, lo, o, c = max(x.high for x in mine), min(x.low for x in mine), mine[0].open, mine[-1].close
            up, down = (h - c, o - lo) if c >= o else (h - o, c - lo)
            want = (h, lo, h - lo, round((h - lo) / lo, 4), abs(c - o), round(abs(c - o) / o, 4), up, down, round(up / (up + down), 4) if up + down > 0 else 0)
            assert [found[f"{name}_{f}"] for f in sessions.FIGURES] == pytest.approx(want, abs=1e-9)


def test_runs_of_odd_seasons(spark):
    rows = [("a", T0 + dt.timedelta(hours=i), s, float(i)) for i, s in enumerate(["x", "x", None, "x", "y", "y", "y", None, None, "x"])]
    df = spark.createDataFrame([*rows, ("b", T0, None, 1.0), (None, T0, "x", 1.0)], "symbol string, ts timestamp_ntz, season string, v double")
    by = lambda d, c: [r[c] for r in d.where("symbol = 'a'").orderBy("ts").collect()]
    made = {m: sessions.over_runs(df, F.col("season"), {"total": F.sum("v"), "n": F.count("v")}, m) for m in sessions.MODES}
    assert by(made["developing"], "total") == [0, 1, None, 3, 4, 9, 15, None, None, 9]
    assert by(made["whole"], "total") == [1, 1, None, 3, 15, 15, 15, None, None, None]
    assert by(made["projected"], "total") == [0, 1, None, 3, 12, 13.5, 15, None, None, 9]
    assert all(d.count() == 12 for d in made.values())
    assert sessions.over_runs(df.limit(0), F.col("season"), {"n": F.count("v")}).count() == 0
    own = F.arrow_udf(lambda x: float(x.to_numpy().max() * 2), "double", F.ArrowUDFType.GROUPED_AGG) if hasattr(F, "ArrowUDFType") else None
    if own is not None:
        assert by(sessions.over_runs(df, F.col("season"), {"twice": own("v")}), "twice")[:2] == [0, 2]
    with pytest.raises(ValueError):
        sessions.over_runs(df, F.col("season"), {"n": F.count("v")}, "later")
