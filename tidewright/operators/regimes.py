"""Volatility regimes: normal mixtures of many series fitted at once, each bar's regime in every series, and what regimes do over time."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chunks import chunked, with_z
from ..functions.scans import Runs, scan
from ..functions.stored import written
from ..functions.win import flag, frame, lag, roll
from . import features

PARTS, RESTARTS, ROUNDS = 3, 5, 100
#: Change of the mean log-likelihood below which a fit has settled, and the share of a series' variance that is added to those of its parts.
TOLERANCE, FLOOR, LEAST_FLOOR = 1e-3, 1e-6, 1e-12
SEED = 42
#: Values that a series may have to be fitted by one task: some 57 years of hours, 4 MB.
LOCAL_VALUES = 500_000
KINDS = ("parkinson", "gk", "tr", "weighted")


def starts(parts: int, restarts: int) -> list[float]:
    """Quantiles at which the means of each restart begin: evenly spread at first, then seeded."""
    rng = np.random.default_rng(SEED)
    even = (np.arange(parts) + 0.5) / parts
    return np.concatenate([even, *[np.sort(rng.random(parts)) for _ in range(restarts - 1)]]).tolist()


def saved_series(df: DataFrame, series: list[str], unit: str) -> DataFrame:
    """(symbol, series, weight, x): the values of each column in a piece of time as one row, written once.

    A column's missing values are taken as its mean: one row [mean] whose weight is their number.
    """
    keys = ["symbol", "_piece"]

    def pieces(table: pa.Table) -> pa.Table:
        lists = [table.column(c).combine_chunks().drop_null() for c in series]
        lists = [(c, x) for c, x in zip(series, lists) if len(x)]
        offsets = np.cumsum([0, *[len(x) for _, x in lists]])
        values = pa.concat_arrays([x for _, x in lists]) if lists else pa.array([], pa.float64())
        symbol = table.column("symbol").slice(0, 1).combine_chunks().take(pa.array([0] * len(lists), pa.int64()))
        return pa.Table.from_arrays([symbol, pa.array([c for c, _ in lists], pa.string()), pa.array([1.0] * len(lists), pa.float64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], ["symbol", "series", "weight", "x"])

    kind = df.schema["symbol"].dataType.simpleString()
    rows = df.select("symbol", F.date_trunc(unit, F.col("ts")).cast("timestamp_ntz").alias("_piece"), *[F.col(c).cast("double").alias(c) for c in series])
    full = rows.groupBy(*keys).applyInArrow(pieces, f"symbol {kind}, series string, weight double, x array<double>")
    gaps = df.groupBy("symbol").agg(F.array(*[F.struct(F.lit(c).alias("series"), F.count_if(F.col(c).isNull()).cast("double").alias("weight"), F.avg(c).alias("mean")) for c in series]).alias("g")).select("symbol", F.explode("g").alias("g"))
    gaps = gaps.where("g.weight > 0 AND g.mean IS NOT NULL").select("symbol", "g.series", "g.weight", F.array("g.mean").alias("x"))
    return written(full.unionByName(gaps), "series")


def first_parameters(df: DataFrame, series: list[str], parts: int, restarts: int) -> DataFrame:
    """(symbol, series, theta, bound, floor, settled): for each restart the weights, means and variances to begin with, from quantiles of bounded size."""
    cuts = starts(parts, restarts)
    at = F.array(*map(F.lit, cuts))
    of = [F.struct(F.lit(c).alias("series"), F.percentile_approx(F.col(c).cast("double"), at, F.lit(10_000)).alias("m"), F.var_pop(c).alias("v")) for c in series]
    each = df.groupBy("symbol").agg(F.array(*of).alias("e")).select("symbol", F.explode("e").alias("e")).where("e.m IS NOT NULL")
    n = parts * restarts
    floor = F.greatest(F.col("e.v") * FLOOR, F.lit(LEAST_FLOOR))
    theta = F.concat(F.array_repeat(F.lit(1.0 / parts), n), F.col("e.m"), F.array_repeat(F.col("e.v") / parts + floor, n))
    return each.select("symbol", "e.series", theta.alias("theta"), F.array_repeat(F.lit(float("-inf")), restarts).alias("bound"), floor.alias("floor"), F.lit(False).alias("settled"))


def responsibilities(x: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of values and theta (3, restarts, parts): each part's share of each value (n, restarts, parts), and log-likelihoods (n, restarts)."""
    w, m, v = theta
    logs = np.log(w) - 0.5 * np.log(2 * np.pi * v) - (x[:, None, None] - m) ** 2 / (2 * v)
    top = logs.max(axis=2, keepdims=True)
    shares = np.exp(logs - top)
    total = shares.sum(axis=2, keepdims=True)
    return shares / total, (top + np.log(total))[:, :, 0]


def sums_of(x: np.ndarray, weight: float, theta: np.ndarray) -> np.ndarray:
    """What a round adds up over values, of a size that doesn't depend on them: count, log-likelihoods, and each part's shares, distances and squares around the means so far, so that large values keep their digits."""
    r, logs = responsibilities(x, theta)
    away = x[:, None, None] - theta[1]
    return np.concatenate([[weight * len(x)], weight * logs.sum(axis=0), *[weight * (r * f).sum(axis=0).ravel() for f in (1.0, away, away * away)]])


def improved(total: np.ndarray, theta: np.ndarray, before: np.ndarray, floor: float, tolerance: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """The next theta (3, restarts, parts), the mean log-likelihoods of the one before, and whether all restarts have settled."""
    restarts = theta.shape[1]
    n, bound = total[0], total[1 : 1 + restarts] / total[0]
    s, a, b = total[1 + restarts :].reshape(theta.shape)
    s = s + 10 * np.finfo(float).eps
    var = np.maximum(b / s - (a / s) ** 2, 0.0) + floor
    return np.stack([s / n, theta[1] + a / s, var]), bound, bool((np.abs(bound - before) < tolerance).all())


STATE = ("theta", "bound", "floor")


def _state(table: pa.Table, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, float]:
    theta, bound = (table.column(c)[0].values.to_numpy(zero_copy_only=False) for c in STATE[:2])
    return theta.reshape(shape), bound, table.column("floor")[0].as_py()


def _result(table: pa.Table, theta: np.ndarray, bound: np.ndarray, settled: bool) -> pa.Table:
    return pa.Table.from_arrays([*[table.column(c).slice(0, 1) for c in ("symbol", "series")], pa.array([theta.ravel().tolist()]), pa.array([bound.tolist()]), table.column("floor").slice(0, 1), pa.array([settled])], ["symbol", "series", *STATE, "settled"])


def _with_state(saved: DataFrame, parameters: DataFrame) -> tuple[DataFrame, str]:
    names = parameters.select(F.col("symbol").alias("_symbol"), F.col("series").alias("_series"), *STATE)
    joined = saved.join(names, F.col("symbol").eqNullSafe(F.col("_symbol")) & (F.col("series") == F.col("_series")))
    return joined.select("symbol", "series", "weight", "x", *STATE), f"symbol {parameters.schema['symbol'].dataType.simpleString()}, series string, theta array<double>, bound array<double>, floor double"


def one_round(saved: DataFrame, parameters: DataFrame, parts: int, restarts: int, tolerance: float) -> DataFrame:
    """The next parameters of all series: the saved rows are read once, each giving sums of fixed size, which are added up by series."""
    shape = (3, restarts, parts)
    joined, kind = _with_state(saved, parameters)

    def sums(batches):
        for batch in batches:
            out = [sums_of(x.values.to_numpy(), weight, theta.values.to_numpy().reshape(shape)).tolist() for weight, x, theta in zip(batch.column("weight").to_numpy(), batch.column("x"), batch.column("theta"))]
            yield pa.RecordBatch.from_arrays([batch.column("symbol"), batch.column("series"), *[batch.column(c) for c in STATE], pa.array(out, pa.list_(pa.float64()))], ["symbol", "series", *STATE, "sums"])

    def step(table: pa.Table) -> pa.Table:
        total = np.sum([s.values.to_numpy() for s in table.column("sums").combine_chunks()], axis=0)
        return _result(table, *improved(total, *_state(table, shape), tolerance))

    each = joined.mapInArrow(sums, f"{kind}, sums array<double>")
    return each.groupBy("symbol", "series").applyInArrow(step, f"{kind}, settled boolean")


def all_rounds(saved: DataFrame, parameters: DataFrame, parts: int, restarts: int, rounds: int, tolerance: float) -> DataFrame:
    """The last parameters of series of LOCAL_VALUES values at most, each fitted by one task."""
    shape = (3, restarts, parts)
    joined, kind = _with_state(saved, parameters)

    def fit(table: pa.Table) -> pa.Table:
        rows = [(x.values.to_numpy(), w) for x, w in zip(table.column("x").combine_chunks(), table.column("weight").to_numpy())]
        theta, bound, floor = _state(table, shape)
        for _ in range(rounds):
            theta, bound, settled = improved(np.sum([sums_of(x, w, theta) for x, w in rows], axis=0), theta, bound, floor, tolerance)
            if settled:
                break
        return _result(table, theta, bound, True)

    return joined.groupBy("symbol", "series").applyInArrow(fit, f"{kind}, settled boolean")


def fit_mixtures(df: DataFrame, series: list[str], parts: int = PARTS, restarts: int = RESTARTS, rounds: int = ROUNDS, tolerance: float = TOLERANCE, unit: str = "quarter") -> DataFrame:
    """(symbol, series, part, weight, mean, var): a normal mixture of each column of df for each symbol, parts by rising mean.

    Expectation and maximisation of all restarts at once. A series of LOCAL_VALUES
    values at most is fitted by one task, all such series in one job. Longer ones
    go in rounds over all of them together: a round reads the saved values once and
    adds up sums of fixed size, so no task holds a long history; series that have
    settled are left out of later rounds. Both ways do the same sums. Of the
    restarts the one of largest likelihood is taken. Seeds are fixed, so reruns
    agree. Missing values count as the column's mean; a column without values has
    no rows; one with fewer different values than parts gets parts that are alike.
    """
    saved = saved_series(df, series, unit)
    first = first_parameters(df, series, parts, restarts)
    values = saved.groupBy(F.col("symbol").alias("_s"), F.col("series").alias("_c")).agg(F.sum(F.size("x")).alias("_n"))
    first = first.join(values, F.col("symbol").eqNullSafe(F.col("_s")) & (F.col("series") == F.col("_c"))).drop("_s", "_c")
    first = written(first, "parameters")
    done = written(all_rounds(saved, first.where(F.col("_n") <= LOCAL_VALUES), parts, restarts, rounds, tolerance), "fitted")
    open_ = first.where(F.col("_n") > LOCAL_VALUES).drop("_n")
    for _ in range(rounds):
        if open_.isEmpty():
            break
        new = written(one_round(saved, open_, parts, restarts, tolerance), "parameters")
        done, open_ = done.unionByName(new.where("settled")), new.where("NOT settled")
    found = done.unionByName(open_)
    n = parts * restarts
    best = F.array_position("bound", F.array_max("bound")).cast("int") - 1
    at = lambda k, i: F.get("theta", F.lit(k * n) + best * parts + i)
    parts_of = F.array_sort(F.array(*[F.struct(at(1, F.lit(i)).alias("mean"), at(0, F.lit(i)).alias("weight"), at(2, F.lit(i)).alias("var")) for i in range(parts)]))
    return written(found.select("symbol", "series", F.posexplode(parts_of).alias("part", "p")).select("symbol", "series", "part", "p.weight", "p.mean", "p.var"), "mixtures")


def _by_symbol(df: DataFrame, key: Column, value: Column, out: str) -> DataFrame:
    """(_symbol, out): a map for each symbol, with as many keys as there are series (or series and parts)."""
    return df.groupBy(F.col("symbol").alias("_symbol")).agg(F.map_from_entries(F.collect_list(F.struct(key.alias("k"), value.alias("v")))).alias(out))


def _looked_up(df: DataFrame, maps: DataFrame) -> DataFrame:
    return df.join(maps, F.col("symbol").eqNullSafe(F.col("_symbol")), "left").drop("_symbol")


def labelled(df: DataFrame, series: list[str], fitted: DataFrame) -> DataFrame:
    """Add {series}_regime: the part, by rising mean, that a value most likely comes from; NULL stays NULL."""
    parts = fitted.groupBy("symbol", "series").agg(F.array_sort(F.collect_list(F.struct("part", "weight", "mean", "var"))).alias("parts"))
    joined = _looked_up(df, _by_symbol(parts, F.col("series"), F.col("parts"), "_parts"))

    def of(c: str) -> Column:
        score = lambda p: F.ln(p["weight"]) - 0.5 * F.ln(p["var"]) - (F.col(c) - p["mean"]) * (F.col(c) - p["mean"]) / (2 * p["var"])
        ranked = F.array_max(F.transform(F.try_element_at("_parts", F.lit(c)), lambda p: F.struct(score(p).alias("s"), (-p["part"]).alias("n"))))
        return F.when(F.col(c).isNotNull(), -ranked["n"])

    return joined.withColumns({f"{c}_regime": of(c) for c in series}).drop("_parts")


def regime_metrics(df: DataFrame, series: list[str], width: int = 12, unit: str = "month") -> DataFrame:
    """Of columns and their {series}_regime, add {series}_regime_ and: duration, the rows that the regime has lasted; stability, 1 less the share of changes
    over width rows; intensity, how far the value is from the regime's mean (looks ahead), as a share of it; transition_prob, the share of changes over
    width rows of which the first counts as one. A row without regime ends a run and has NULL. All series share one scan.
    """
    keys, one = {c: f"{c}_regime" for c in series}, "_one"
    changes = {f"_changed_{c}": F.when(F.col(r).isNotNull(), flag(F.col(r) != lag(r)).cast("double")) for c, r in keys.items()}

    def windows(b: DataFrame) -> DataFrame:
        b = b.withColumns(changes)
        out = {}
        for c in series:
            changed = F.col(f"_changed_{c}")
            late = F.sum(changed).over(frame(width - 1))
            out |= {f"{c}_regime_stability": 1 - roll(F.avg, changed, width), f"{c}_regime_transition_prob": F.when(F.count(changed).over(frame(width)) >= width, (late + 1) / width)}
        return b.withColumns(out).drop(*changes)

    long = df.select("symbol", F.explode(F.array(*[F.struct(F.lit(c).alias("series"), F.col(r).alias("regime"), F.col(c).cast("double").alias("x")) for c, r in keys.items()])).alias("e")).where("e.regime IS NOT NULL")
    means = long.groupBy("symbol", "e.series", "e.regime").agg(F.avg("e.x").alias("mean"))
    key = lambda c, r: F.concat_ws("/", c, r.cast("string"))
    s = _looked_up(chunked(df, windows, width + 1, unit), _by_symbol(means, key(F.col("series"), F.col("regime")), F.col("mean"), "_means"))
    mean = lambda c: F.try_element_at("_means", key(F.lit(c), F.col(keys[c])))
    s = s.withColumns({f"{c}_regime_intensity": F.try_divide(F.col(c) - mean(c), mean(c)) for c in series} | {one: F.lit(1)}).drop("_means")
    s = scan(s, [Runs(r, one, f"{c}_regime_duration") for c, r in keys.items()], unit, name="regimes")
    return s.withColumns({f"{c}_regime_duration": F.col(f"{c}_regime_duration").cast("long") for c in series}).drop(one)


def regimes(bars: DataFrame, widths: tuple[int, ...] = (24, 168, 720), width: int = 12, fitted: DataFrame | None = None) -> DataFrame:
    """Mean volatilities of four kinds over three widths and their composite; for each of these 13 series its regime (0 to 2) and regime_metrics; z-scores of the volatilities and of the composite's duration, stability and intensity.

    Regimes come from mixtures fitted to a symbol's whole history (looks ahead), or
    from those given. Every bar has a row; a series is NULL before its first full frame.
    """
    base = written(chunked(bars.select("symbol", "ts", "high", "low", "close", "quote_volume"), lambda b: features._volatility(b, widths), widths[0] + max(widths) + 2, "quarter").drop(*KINDS), "volatility")
    means = [f"{m}_{w}" for m in KINDS for w in widths]
    series = [*means, "composite"]
    found = regime_metrics(labelled(base, series, fit_mixtures(base, series) if fitted is None else fitted), series, width)
    return with_z(found, [*means, *[f"composite_regime_{m}" for m in ("duration", "stability", "intensity")]])
