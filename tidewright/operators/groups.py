"""Feature groups as objects: a registry with lookup, required columns, names with parameters, and a driver that runs many."""

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import feature_name
from . import features, regimes, sessions

KEYS = ["symbol", "ts"]


class MissingColumns(ValueError):
    """A table lacks columns that an operator needs."""


def require_columns(df: DataFrame, columns: list[str], what: str = "this operator") -> DataFrame:
    """df itself, or MissingColumns that names all that are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumns(f"{what} needs {', '.join(missing)}, which the table doesn't have")
    return df


class FeatureGroup(Protocol):
    """What a group of one's own has to offer: bars in, (symbol, ts, features) out.

    It may also have sets, the parameters that it runs with, and scaled(params,
    multiplier), which fits them to a timeframe; without, it runs once as it is.
    One with an attribute uses_features gets the features of the groups before it.
    """

    name: str
    required: tuple[str, ...]

    def apply(self, bars: DataFrame, **params) -> DataFrame: ...


@dataclass(frozen=True)
class Group:
    """A group made of a function; sets are the parameters that it runs with by default."""

    name: str
    description: str
    required: tuple[str, ...]
    make: Callable[..., DataFrame]
    sets: tuple[dict, ...] = field(default=({},))
    #: Parameters counted in bars, which a timeframe multiplies.
    rows: tuple[str, ...] = ()

    def apply(self, bars: DataFrame, **params) -> DataFrame:
        return self.make(require_columns(bars, [*KEYS, *self.required], self.name), **params)

    def scaled(self, params: dict, multiplier: int) -> dict:
        def times(v):
            return tuple(x * multiplier for x in v) if isinstance(v, tuple) else v * multiplier

        return {k: times(v) if k in self.rows else v for k, v in params.items()}


class Groups(Enum):
    """All groups by name."""

    BOLLINGER = Group("bollinger", "bands of mean and deviation, true range and implied volatility", ("high", "low", "close"), features.bollinger, tuple({"period": p} for p in (20, 10, 14, 30)), ("period",))
    MACD = Group("macd", "difference of exponential means", ("close",), features.macd, tuple(dict(zip(("fast", "slow", "signal"), s)) for s in ((12, 26, 9), (8, 21, 5), (21, 55, 9), (5, 35, 5))), ("fast", "slow", "signal"))
    RSI = Group("rsi", "relative strength", ("close",), features.rsi, tuple({"period": p} for p in (14, 7, 21)), ("period",))
    STOCHASTIC = Group("stochastic", "place of the close in the range", ("high", "low", "close"), features.stochastic, tuple({"k": k} for k in (5, 8, 12, 21)), ("k", "d", "smooth"))
    CANDLES = Group("candles", "candle patterns", ("open", "high", "low", "close", "volume"), features.candles, ({"doji": 0.1, "wick": 2.0, "period": 20}, {"doji": 0.15, "wick": 2.5, "period": 30}), ("period",))
    SEASONALITY = Group("seasonality", "calendar flags", (), features.seasonality)
    TIME_RANGES = Group("time_ranges", "extremes so far, distances to them, ranges of sessions", ("open", "high", "low", "close"), sessions.time_ranges, ({"mode": "completed"}, {"mode": "developing"}))
    VOLUME_METRICS = Group("volume_metrics", "rolling volumes", ("quote_volume", "taker_buy_quote_volume"), features.volume_rolling, rows=("widths",))
    VOLUME_SEASONS = Group("volume_seasons", "volumes by season (look ahead)", ("quote_volume", "taker_buy_quote_volume"), features.volume_seasons)
    VOLUME_MOMENTUM = Group("volume_momentum", "changes of volume", ("quote_volume", "taker_buy_quote_volume"), features.volume_momentum, rows=("periods", "widths"))
    VWAP = Group("vwap", "volume-weighted price with bands", ("high", "low", "close", "quote_volume"), features.vwap, tuple({"period": p} for p in (5, 8, 10, 12, 14, 20, 21, 26, 30, 50, 55, 100, 200)), ("period",))
    VOLUME_PROFILE = Group("volume_profile", "volume by price", ("high", "low", "close", "quote_volume"), features.volume_profile, rows=("period",))
    PRICE_LEVELS = Group("price_levels", "levels around the close", ("high", "low", "close"), features.price_levels, rows=("period",))
    MARKET_STRUCTURE = Group("market_structure", "swings and breaks", ("high", "low"), features.market_structure, tuple({"p": p} for p in (5, 10, 20, 50)), ("p",))
    STREAKS = Group("streaks", "runs of rises and falls", ("high", "low", "close", "quote_volume"), features.streaks)
    VOLATILITY = Group("volatility", "range volatility", ("high", "low", "close", "quote_volume"), features.volatility, rows=("widths",))
    RETURNS = Group("returns", "returns over lags", ("close",), features.returns, rows=("widths",))
    REGIMES = Group("regimes", "volatility regimes (look ahead)", ("high", "low", "close", "quote_volume"), regimes.regimes, rows=("widths", "width"))
    RELATIONSHIP = Group("relationship", "against the closes of one symbol, which gets none", ("close",), features.relationship, ({"benchmark": "BTCUSDT"},), ("widths",))
    INDEX = Group("index", "of an index with open, high, low and close", ("open", "high", "low", "close"), features.aux_series, rows=("widths",))
    FEAR_GREED = Group("fear_greed", "of a daily value", ("value",), features.fear_greed_features, rows=("widths",))
    CYCLE = Group("cycle", "year and days of the halving cycle", (), features.cycle)
    FUNDING = Group("funding", "funding rates", ("fundingRate",), features.funding_features, rows=("widths",))

    @classmethod
    def find(cls, name: str) -> Group:
        """By name in any case, with - or blanks for _."""
        key = name.strip().upper().replace("-", "_").replace(" ", "_")
        if key not in cls.__members__:
            raise KeyError(f"no group {name!r}; there are {', '.join(cls.names())}")
        return cls[key].value

    @classmethod
    def names(cls) -> list[str]:
        return [g.value.name for g in cls]


def group_features(bars: DataFrame, group: Group | FeatureGroup, timeframe: int = 1, sets: tuple[dict, ...] | None = None) -> DataFrame:
    """One group with all its parameter sets, a row for each bar; columns are named by group, timeframe, parameters and metric."""
    frames = []
    require_columns(bars, [*KEYS, *group.required], group.name)
    for params in getattr(group, "sets", ({},)) if sets is None else sets:
        scaled = group.scaled(params, timeframe) if hasattr(group, "scaled") else params
        frame = require_columns(group.apply(bars, **scaled), KEYS, f"what {group.name} returns")
        named = [F.col(c).alias(feature_name(group.name, f"{timeframe}h", c, tuple(scaled.values()))) for c in frame.columns if c not in KEYS]
        frames.append(frame.select(*KEYS, *named))
    return reduce(lambda a, b: a.join(b, KEYS, "left"), frames)


def run_groups(bars: DataFrame, wanted: list[str | Group | FeatureGroup], timeframes: tuple[int, ...] = (1,), sink: Callable[[DataFrame, str], DataFrame] | None = None) -> tuple[DataFrame, list[dict]]:
    """Run groups, by name or of one's own, in order. Returns bars with all features, and for each group its columns and the seconds that it took.

    With a sink (such as write_features) each group is written first and read
    back, so that plans stay small and the groups can be used one by one; without
    one the seconds are those of planning and of tables written on the way.
    """
    out, report = bars, []
    for one in wanted:
        group, began = Groups.find(one) if isinstance(one, str) else one, time.time()
        frames = [group_features(out if hasattr(group, "uses_features") else bars, group, t) for t in timeframes]
        frame = reduce(lambda a, b: a.join(b, KEYS, "left"), frames)
        if sink is not None:
            frame = sink(frame, group.name)
        out = join_features(out, frame)
        report.append({"group": group.name, "features": len(frame.columns) - len(KEYS), "seconds": round(time.time() - began, 3)})
    return out, report


def join_features(bars: DataFrame, frame: DataFrame) -> DataFrame:
    """bars with the feature columns of frame by symbol and ts; columns that bars has already are left out of frame."""
    new = [c for c in frame.columns if c not in bars.columns]
    return bars.join(frame.select(*KEYS, *new), KEYS, "left")


def slowest(report: list[dict], n: int = 3) -> list[dict]:
    """The groups that took longest."""
    return sorted(report, key=lambda r: (-r["seconds"], r["group"]))[:n]


def feature_map(df: DataFrame, base: tuple[str, ...] = ("symbol", "ts", "open", "high", "low", "close", "volume")) -> DataFrame:
    """(symbol, ts, features): a map from name to value of all numeric columns that aren't in base, without NULLs."""
    names = [c for c, t in df.dtypes if c not in base and t in ("double", "float", "int", "bigint", "smallint")]
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in names])
    return df.select("symbol", "ts", F.map_from_entries(F.filter(pairs, lambda p: p.value.isNotNull())).alias("features"))
