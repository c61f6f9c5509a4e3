"""Rolling moments are those of each window taken by itself, whatever the width, gaps, offsets and constants."""

import datetime as dt
import math
import random
import statistics

import numpy as np
import pytest

from tidewright.functions.chunks import chunked
from tidewright.functions.rolling import KINDS, Rolled, rolled, window_moments

T0 = dt.datetime(2024, 1, 1)


def plain(x, y, width):
    """Count and KINDS of each window, written from the definitions."""
    for i in range(len(x)):
        pairs = [(a, b) for a, b in zip(x[max(0, i - width + 1) : i + 1], y[max(0, i - width + 1) : i + 1]) if not (math.isnan(a) or math.isnan(b))]
        n = len(pairs)
        xs, ys = [a for a, _ in pairs], [b for _, b in pairs]
        out = dict.fromkeys(KINDS)
        if n:
            mx, my = math.fsum(xs) / n, math.fsum(ys) / n
            xx, yy, xy = math.fsum((a - mx) ** 2 for a in xs), math.fsum((b - my) ** 2 for b in ys), math.fsum((a - mx) * (b - my) for a, b in pairs)
            out |= {"mean": mx, "sum": math.fsum(xs)}
            if n > 1:
                out |= {"var": statistics.variance(xs), "sd": statistics.stdev(xs), "cov": xy / (n - 1)}
            if len(set(ys)) > 1:
                out |= {"beta": xy / yy, "sd_ratio": math.sqrt(xx / yy)}
                if len(set(xs)) > 1:
                    out["corr"] = xy / math.sqrt(xx * yy)
        yield n, out


@pytest.mark.parametrize("width", [1, 2, 3, 7, 24, 64, 300])
@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_moments_are_those_of_each_window(width, offset):
    rng = random.Random(width)
    x = [offset + rng.gauss(0, 3) if rng.random() > 0.2 else math.nan for _ in range(200)]
    y = [offset + 2 * (0 if math.isnan(a) else a - offset) + rng.gauss(0, 1) if rng.random() > 0.1 else math.nan for a in x]
    x[50:90] = [offset + 5.1] * 40  # constant windows
    made = window_moments(np.array(x), np.array(y), width)
    values = {k: f(made) for k, f in KINDS.items()}
    for i, (n, want) in enumerate(plain(x, y, width)):
        assert made.n[i] == n
        for kind, v in want.items():
            got = values[kind][i]
            if v is None:
                assert not n or math.isnan(got), (kind, i)
            else:
                assert got == pytest.approx(v, rel=1e-7, abs=1e-9), (kind, i)


def test_a_constant_window_has_no_variance():
    x = np.r_[np.array([3.0, 9.1, -2.7]), np.full(40, 0.1), np.array([8.0])]
    made = window_moments(x, x, 7)
    assert (made.xx[9:43] == 0).all() and made.xx[8] > 0 and made.xx[43] > 0


def test_an_infinite_value_spoils_only_the_windows_that_hold_it():
    x = np.arange(20.0)
    x[6] = math.inf
    made = window_moments(x, x, 3)
    assert np.isnan(made.x).tolist() == [6 <= i <= 8 for i in range(20)] and made.x[9] == 8.0


def rows():
    out = [("full", T0 + dt.timedelta(hours=i), float(i * i % 97), float(i * 31 % 53)) for i in range(24 * 9)]
    out += [("gaps", T0 + dt.timedelta(hours=17 * i), None if i % 5 == 0 else float(i), 1.0) for i in range(40)]
    return out + [("one", T0, 5.0, None), *[(None, T0 + dt.timedelta(hours=11 * i), float(i % 3), float(i % 7)) for i in range(30)]]


WANTED = {"mean_5": Rolled("mean", 5, "x"), "sd_5": Rolled("sd", 5, "x"), "corr_30": Rolled("corr", 30, "x", "y"), "beta_30": Rolled("beta", 30, "x", "y"), "any_30": Rolled("mean", 30, "x", least=1)}


def test_pieces_equal_whole_histories(spark):
    df = spark.createDataFrame(rows(), "symbol string, ts timestamp_ntz, x double, y double")
    key = lambda r: (str(r.symbol), r.ts)
    whole = sorted(rolled(df, WANTED).collect(), key=key)
    pieces = sorted(chunked(df, lambda d: rolled(d, WANTED), 30, "day").collect(), key=key)
    assert len(whole) == len(pieces) == len(rows())
    for a, b in zip(whole, pieces):
        assert key(a) == key(b)
        for c in ("x", "y", *WANTED):
            assert (a[c] is None and b[c] is None) or a[c] == pytest.approx(b[c], rel=1e-9), (a, b)
    by_hand = {r[1]: r[2] for r in rows() if r[0] == "full"}
    for r in whole:
        if r.symbol == "full":
            last = [v for t, v in by_hand.items() if r.ts - dt.timedelta(hours=5) < t <= r.ts]
            assert r.mean_5 == (pytest.approx(sum(last) / 5) if len(last) == 5 else None)
        if r.symbol == "one":
            assert r.mean_5 is None and r.any_30 == 5.0 and r.corr_30 is None
    assert all(r.beta_30 is None for r in whole if r.symbol == "gaps")  # y is constant there


def test_empty_tables_and_wrong_requests(spark):
    df = spark.createDataFrame(rows(), "symbol string, ts timestamp_ntz, x double, y double")
    empty = rolled(df.where("false"), WANTED)
    assert empty.columns == ["symbol", "ts", "x", "y", *WANTED] and empty.count() == 0
    with pytest.raises(ValueError, match="median"):
        rolled(df, {"m": Rolled("median", 3, "x")})
    with pytest.raises(ValueError, match="width"):
        rolled(df, {"m": Rolled("mean", 0, "x")})
