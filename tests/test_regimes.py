"""Mixtures against plain expectation and maximisation, and the metrics of regimes against plain Python."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import regimes

from .test_chunks import hours

T0 = dt.datetime(2024, 1, 1)


def plain_fit(x, parts, restarts, rounds, tolerance):
    """Each restart by itself, over all values at once; missing ones are the mean. Returns the parts of the best by rising mean."""
    known = x[~np.isnan(x)]
    filled = np.where(np.isnan(x), known.mean(), x)
    floor = max(known.var() * regimes.FLOOR, regimes.LEAST_FLOOR)
    cuts = np.array(regimes.starts(parts, restarts)).reshape(restarts, parts)
    states = [(np.full(parts, 1 / parts), np.quantile(known, c, method="inverted_cdf"), np.full(parts, known.var() / parts + floor), -np.inf) for c in cuts]
    for _ in range(rounds):
        new = []
        for w, m, v, _ in states:
            density = w * np.exp(-((filled[:, None] - m) ** 2) / (2 * v)) / np.sqrt(2 * np.pi * v)
            r = density / density.sum(axis=1, keepdims=True)
            n = r.sum(axis=0) + 10 * np.finfo(float).eps
            mean = (r * filled[:, None]).sum(axis=0) / n
            new.append((n / len(x), mean, (r * (filled[:, None] - mean) ** 2).sum(axis=0) / n + floor, np.log(density.sum(axis=1)).mean()))
        settled = all(abs(a[3] - b[3]) < tolerance for a, b in zip(new, states))
        states = new
        if settled:
            break
    w, m, v, _ = max(states, key=lambda s: s[3])
    order = np.argsort(m)
    return np.column_stack([w, m, v])[order]


def series(spark, seed=5, days=300):
    rng, rows = np.random.default_rng(seed), []
    for symbol in ("a", None):
        x = np.concatenate([rng.normal(0, 1, 4 * days), rng.normal(6, 0.5, 3 * days), rng.normal(20, 2, 3 * days)])
        rng.shuffle(x)
        for i, v in enumerate(x):
            rows.append((symbol, T0 + dt.timedelta(hours=2 * i), None if i < 50 else float(v), float(v) * 100 + 1e6, None, 3.0))
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double, far double, none double, flat double").cache()


@pytest.mark.parametrize("local", [0, 2_990, regimes.LOCAL_VALUES])
def test_mixtures_by_plain_em(spark, monkeypatch, local):
    """All series in rounds, all by one task each, and some this way and some that."""
    monkeypatch.setattr(regimes, "LOCAL_VALUES", local)
    df, names = series(spark), ["x", "far", "none", "flat"]
    got = {}
    for r in regimes.fit_mixtures(df, names, restarts=3).collect():
        got.setdefault((r.symbol, r.series), {})[r.part] = (r.weight, r.mean, r["var"])
    assert set(got) == {(s, c) for s in ("a", None) for c in ("x", "far", "flat")}
    for symbol in ("a", None):
        rows = df.where(F.col("symbol").eqNullSafe(F.lit(symbol))).orderBy("ts").collect()
        for c in ("x", "far"):
            x = np.array([np.nan if r[c] is None else r[c] for r in rows])
            want = plain_fit(x, 3, 3, regimes.ROUNDS, regimes.TOLERANCE)
            found = np.array([got[symbol, c][i] for i in range(3)])
            assert found[:, 1] == pytest.approx(want[:, 1], rel=1e-5) and found[:, 0] == pytest.approx(want[:, 0], rel=1e-4) and found[:, 2] == pytest.approx(want[:, 2], rel=1e-3)
        assert [got[symbol, "flat"][i][1] for i in range(3)] == pytest.approx([3.0] * 3)


def test_saved_series(spark):
    """All values of a series, missing ones as one row of its mean; a column without values has no row."""
    df = series(spark, days=30)
    saved = regimes.saved_series(df, ["x", "none"], "week").where("symbol = 'a'").collect()
    assert {r.series for r in saved} == {"x"} and sum(r.weight * len(r.x) for r in saved) == df.where("symbol = 'a'").count()
    known = [v for r in saved if r.weight == 1 for v in r.x]
    assert [r.x for r in saved if r.weight > 1] == [[pytest.approx(np.mean(known))]] and len(saved) > 2


def test_labels(spark):
    df = series(spark, days=60)
    fitted = regimes.fit_mixtures(df, ["x", "none"], restarts=2)
    parts = [(r.weight, r.mean, r["var"]) for r in fitted.where("symbol = 'a' AND series = 'x'").orderBy("part").collect()]
    for r in regimes.labelled(df, ["x", "none"], fitted).where("symbol = 'a'").collect():
        best = None if r.x is None else max(range(3), key=lambda i: np.log(parts[i][0]) - np.log(parts[i][2]) / 2 - (r.x - parts[i][1]) ** 2 / 2 / parts[i][2])
        assert r.x_regime == best and r.none_regime is None


def metrics_by_hand(values, labels, width):
    out, n = [], len(labels)
    changed = [None if k is None else float(i > 0 and labels[i - 1] is not None and labels[i - 1] != k) for i, k in enumerate(labels)]
    means = {k: np.mean([v for v, x in zip(values, labels) if x == k]) for k in set(labels) - {None}}
    lasted = 0
    for i in range(n):
        k = labels[i]
        lasted = 0 if k is None else lasted + 1 if i and labels[i - 1] == k else 1
        last = changed[max(0, i - width + 1) : i + 1]
        full = len(last) == width and None not in last
        out.append((lasted or None, 1 - np.mean(last) if full else None, None if k is None else (values[i] - means[k]) / means[k], (sum(last[1:]) + 1) / width if full else None))
    return out


def test_group(spark):
    bars = hours(spark, 70).cache()
    got = regimes.regimes(bars, (24, 48, 72))
    assert got.count() == bars.count()
    series = [f"{m}_{w}" for m in regimes.KINDS for w in (24, 48, 72)] + ["composite"]
    for c in series:
        assert {f"{c}_regime", *[f"{c}_regime_{m}" for m in ("duration", "stability", "intensity", "transition_prob")]} <= set(got.columns)
    rows = got.where("symbol = 'a'").orderBy("ts").collect()
    for c in ("tr_24", "parkinson_48", "composite"):
        values, labels = [r[c] for r in rows], [r[f"{c}_regime"] for r in rows]
        assert all((v is None) == (k is None) for v, k in zip(values, labels)) and set(labels) <= {None, 0, 1, 2} and len(set(labels)) > 2
        means = [np.mean([v for v, x in zip(values, labels) if x == k]) for k in sorted(set(labels) - {None})]
        assert means == sorted(means)
        for r, want in zip(rows, metrics_by_hand(values, labels, 12)):
            found = [r[f"{c}_regime_{m}"] for m in ("duration", "stability", "intensity", "transition_prob")]
            assert all(a == b or a == pytest.approx(b, abs=1e-9) for a, b in zip(found, want)), (r.ts, found, want)
    scored = [c for c in got.columns if c.endswith(("_z168", "_z720"))]
    assert len(scored) == 2 * 15 and any(r.tr_24_z168 for r in rows)
    assert regimes.regimes(bars.limit(0), (24, 48, 72)).count() == 0
