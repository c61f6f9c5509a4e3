"""Scans over a symbol's history in pieces: each piece is summed up, the sums are merged in order, and each piece goes on from what came before it.

A scan's state is one small value for each piece of time. States merge
associatively, so a history is as many tasks as it has pieces, and only the
states of a symbol (one for each month, say) are ever in one place.
"""

import pickle
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from .stored import written


class Scan(Protocol):
    """What a scan of one's own offers. Pieces come sorted by time; out names the columns that it adds."""

    out: list[StructField]

    def summarise(self, piece: pa.Table) -> Any: ...

    def merge(self, earlier: Any, later: Any) -> Any: ...

    def apply(self, piece: pa.Table, before: Any | None, whole: Any) -> list[pa.Array]:
        """The columns of out for a piece; before is the state of all earlier pieces (None at the first), whole that of the whole history."""


def floats(piece: pa.Table, column: str) -> np.ndarray:
    """A column as doubles with NaN for NULL."""
    return piece.column(column).cast(pa.float64()).combine_chunks().to_numpy(zero_copy_only=False)


def flags(piece: pa.Table, column: str) -> np.ndarray:
    return pc.fill_null(piece.column(column).cast(pa.bool_()), False).combine_chunks().to_numpy(zero_copy_only=False)


def doubles(x: np.ndarray) -> pa.Array:
    return pa.array(x, pa.float64(), mask=np.isnan(x))


def longs(x: np.ndarray, known: np.ndarray | None = None) -> pa.Array:
    return pa.array(x.astype(np.int64), pa.int64(), mask=None if known is None else ~known)


def _fields(names: Sequence[str], kind) -> list[StructField]:
    return [StructField(n, kind) for n in names]


def last_before(hit: np.ndarray) -> np.ndarray:
    """For each row the last row at or before it that is a hit, -1 without one."""
    return np.maximum.accumulate(np.where(hit, np.arange(len(hit)), -1)) if len(hit) else np.zeros(0, np.int64)


@dataclass
class Moments:
    """{name}_z{n}: the expanding z-score with at least n values; 0 where undefined or the deviation is below 1e-12 or 1e-13 of the mean."""

    names: list[str]
    least: tuple[int, ...]
    out: list[StructField] = field(init=False)

    def __post_init__(self):
        self.out = _fields([f"{c}_z{k}" for c in self.names for k in self.least], DoubleType())

    def _values(self, piece):
        return np.array([floats(piece, c) for c in self.names]).reshape(len(self.names), len(piece))

    def summarise(self, piece):
        x = self._values(piece)
        known = ~np.isnan(x)
        n = known.sum(axis=1)
        mean = np.where(known, x, 0.0).sum(axis=1) / np.maximum(n, 1)
        return n, mean, (np.where(known, x - mean[:, None], 0.0) ** 2).sum(axis=1)

    def merge(self, earlier, later):
        (n, mean, square), (m, other, more) = earlier, later
        total = n + m
        share, away = m / np.maximum(total, 1), other - mean
        return total, np.where(n > 0, mean + away * share, other), square + more + np.where((n > 0) & (m > 0), away * away * n * share, 0.0)

    def apply(self, piece, before, whole):
        x = self._values(piece)
        known = ~np.isnan(x)
        n0, mean0, square0 = before if before is not None else (np.zeros(len(x), np.int64), np.zeros(len(x)), np.zeros(len(x)))
        # sums run around the mean so far, or the first value, so that large values with small deviations keep their digits
        first = np.where(known.any(axis=1), np.take_along_axis(x, known.argmax(axis=1)[:, None], 1)[:, 0], 0.0) if x.shape[1] else np.zeros(len(x))
        centre = np.where(n0 > 0, mean0, first)[:, None]
        away = np.where(known, x - centre, 0.0)
        n = n0[:, None] + known.cumsum(axis=1)
        total, square = away.cumsum(axis=1), square0[:, None] + (away * away).cumsum(axis=1)
        mean = centre + total / np.maximum(n, 1)
        deviation = np.sqrt(np.maximum(square - total * total / np.maximum(n, 1), 0.0) / np.maximum(n - 1, 1))
        defined = known & (n > 1) & (deviation >= np.maximum(1e-12, np.abs(mean) * 1e-13))
        z = np.divide(x - mean, deviation, out=np.zeros_like(x), where=defined)
        return [pa.array(np.where(n[i] >= k, z[i], 0.0)) for i in range(len(x)) for k in self.least]


@dataclass
class Since:
    """Rows since each flag last held, NULL before it first does. names: result to flag column."""

    names: dict[str, str]
    out: list[StructField] = field(init=False)

    def __post_init__(self):
        self.out = _fields(list(self.names), LongType())

    def summarise(self, piece):
        return len(piece), [int(last_before(flags(piece, c))[-1]) if len(piece) else -1 for c in self.names.values()]

    def merge(self, earlier, later):
        return earlier[0] + later[0], [earlier[0] + b if b >= 0 else a for a, b in zip(earlier[1], later[1])]

    def apply(self, piece, before, whole):
        start, hits = before if before is not None else (0, [-1] * len(self.names))
        out, row = [], np.arange(len(piece)) + start
        for c, hit in zip(self.names.values(), hits):
            here = last_before(flags(piece, c))
            last = np.where(here >= 0, here + start, hit)
            out.append(longs(row - last, last >= 0))
        return out


@dataclass
class Sums:
    """Running sums of whole numbers, NULL as 0. names: result to column."""

    names: dict[str, str]
    out: list[StructField] = field(init=False)

    def __post_init__(self):
        self.out = _fields(list(self.names), LongType())

    def _values(self, piece):
        return np.array([np.nan_to_num(floats(piece, c)) for c in self.names.values()]).reshape(len(self.names), len(piece)).astype(np.int64)

    def summarise(self, piece):
        return self._values(piece).sum(axis=1)

    def merge(self, earlier, later):
        return earlier + later

    def apply(self, piece, before, whole):
        return [longs(x) for x in self._values(piece).cumsum(axis=1) + (0 if before is None else before[:, None])]


@dataclass
class Extreme:
    """The largest (or smallest) value so far, and rows since a row last had it; before any, NULL and the rows of the whole history."""

    column: str
    value: str
    since: str
    smallest: bool = False
    out: list[StructField] = field(init=False)

    def __post_init__(self):
        self.out = [StructField(self.value, DoubleType()), StructField(self.since, LongType())]

    def _values(self, piece):
        x = floats(piece, self.column) * (-1.0 if self.smallest else 1.0)
        return np.where(np.isnan(x), -np.inf, x)

    def summarise(self, piece):
        x = self._values(piece)
        top = x.max(initial=-np.inf)
        return len(x), top, int(np.flatnonzero(x == top)[-1]) if top > -np.inf else -1

    def merge(self, earlier, later):
        (n, top, at), (m, other, where) = earlier, later
        return (n + m, other, n + where) if where >= 0 and other >= top else (n + m, top, at)

    def apply(self, piece, before, whole):
        start, top, at = before if before is not None else (0, -np.inf, -1)
        x = self._values(piece)
        best = np.maximum(np.maximum.accumulate(x), top) if len(x) else x
        here = last_before((x == best) & (x > -np.inf))
        last = np.where(here >= 0, here + start, at)
        sign = -1.0 if self.smallest else 1.0
        return [pa.array(best * sign, mask=np.isinf(best)), longs(np.where(last >= 0, np.arange(len(x)) + start - last, whole[0]))]


@dataclass
class Fill:
    """Columns as of the last row where marker holds, that row included, or only rows before it if earlier; NULL before there is one. names: result to column of doubles."""

    marker: str
    names: dict[str, str]
    earlier: bool = False
    out: list[StructField] = field(init=False)

    def __post_init__(self):
        self.out = _fields(list(self.names), DoubleType())

    def summarise(self, piece):
        at = last_before(flags(piece, self.marker))
        return [floats(piece, c)[at[-1]] for c in self.names.values()] if len(at) and at[-1] >= 0 else None

    def merge(self, earlier, later):
        return earlier if later is None else later

    def apply(self, piece, before, whole):
        at = last_before(flags(piece, self.marker))
        if self.earlier:
            at = np.r_[-1, at[:-1]] if len(at) else at
        held = before if before is not None else [np.nan] * len(self.names)
        return [doubles(np.where(at >= 0, floats(piece, c)[np.maximum(at, 0)], h)) if len(at) else doubles(np.zeros(0)) for c, h in zip(self.names.values(), held)]


@dataclass
class Runs:
    """Sum of value over the rows of a run of equal keys so far. A row without key ends a run and has NULL; with through it goes on with the run, if there is one, and adds nothing."""

    key: str
    value: str
    name: str
    through: bool = False
    out: list[StructField] = field(init=False)

    def __post_init__(self):
        self.out = [StructField(self.name, DoubleType())]

    def _parts(self, piece, before):
        """Keys, values and for each row where its run begins; a run that began in an earlier piece begins at -1."""
        key, value = floats(piece, self.key), np.nan_to_num(floats(piece, self.value))
        carried = np.nan if before is None else before[0]
        if self.through:
            at = last_before(~np.isnan(key))
            value = np.where(np.isnan(key), 0.0, value)
            key = np.where(at >= 0, key[np.maximum(at, 0)], carried) if len(key) else key
        earlier = np.r_[carried, key[:-1]] if len(key) else key
        fresh = key != earlier  # NaN differs from all, itself too
        return key, value, last_before(fresh)

    def summarise(self, piece):
        key, value, _ = self._parts(piece, None)
        if not len(key) or np.isnan(key).all() and self.through:
            return None
        known = key[~np.isnan(key)]
        same = len(known) == len(key) if not self.through else True
        one = len(known) > 0 and same and bool((known == known[0]).all())
        begins = last_before(np.r_[True, key[1:] != key[:-1]])[-1]
        return key[-1], float(value[begins:].sum()), known[0] if one else None

    def merge(self, earlier, later):
        if later is None or earlier is None:
            return earlier if later is None else later
        key, total, one = later
        goes_on = one is not None and one == earlier[0]
        return key, total + earlier[1] if goes_on else total, one if goes_on and earlier[2] == one else None

    def apply(self, piece, before, whole):
        key, value, begins = self._parts(piece, before)
        running = np.r_[0.0, value.cumsum()]
        total = running[1:] - running[np.maximum(begins, 0)] + np.where(begins < 0, 0.0 if before is None else before[1], 0.0) if len(key) else value
        return [doubles(np.where(np.isnan(key), np.nan, total))]


def scan(df: DataFrame, scans: Sequence[Scan], unit: str = "month", order: Sequence[str] = (), name: str = "scan") -> DataFrame:
    """df with the columns of all scans. Rows of a symbol come by ts and then order; pieces are cut by unit of ts.

    df is written once and read twice: for the states, and for the result.
    """
    if not scans:
        return df
    rows = written(df.withColumn("_piece", F.date_trunc(unit, F.col("ts")).cast("timestamp_ntz")), name)
    keys, by = ["symbol", "_piece"], [("ts", "ascending"), *[(c, "ascending") for c in order]]

    def in_order(piece: pa.Table) -> pa.Table:
        return piece.take(pc.sort_indices(piece, sort_keys=by))

    def summarise(piece: pa.Table) -> pa.Table:
        piece = in_order(piece)
        states = pickle.dumps([s.summarise(piece) for s in scans])
        return pa.Table.from_arrays([*[piece.column(k).slice(0, 1) for k in keys], pa.array([states], pa.binary())], [*keys, "state"])

    def carry(states: pa.Table) -> pa.Table:
        pieces = states.column("_piece").to_pylist()
        at = sorted(range(len(pieces)), key=lambda i: (pieces[i] is not None, pieces[i]))
        each, so_far, before = states.column("state").to_pylist(), None, []
        for i in at:
            before.append(so_far)
            here = pickle.loads(each[i])
            so_far = here if so_far is None else [s.merge(a, b) for s, a, b in zip(scans, so_far, here)]
        return states.select(keys).take(pa.array(at)).append_column("carry", pa.array([pickle.dumps((b, so_far)) for b in before], pa.binary()))

    names = [c for c in rows.columns if c != "_piece"]

    def apply(piece: pa.Table, carried: pa.Table) -> pa.Table:
        piece = in_order(piece)
        before, whole = pickle.loads(carried.column("carry")[0].as_py())
        columns = [x for i, s in enumerate(scans) for x in s.apply(piece, None if before is None else before[i], whole[i])]
        return pa.Table.from_arrays([*[piece.column(c) for c in names], *columns], [*names, *[f.name for s in scans for f in s.out]])

    symbol, when = rows.schema["symbol"], rows.schema["_piece"]
    key = [StructField("symbol", symbol.dataType), StructField("_piece", when.dataType)]
    states = rows.groupBy(*keys).applyInArrow(summarise, StructType([*key, StructField("state", BinaryType())]))
    carries = states.groupBy("symbol").applyInArrow(carry, StructType([*key, StructField("carry", BinaryType())]))
    schema = StructType([*[rows.schema[c] for c in names], *[f for s in scans for f in s.out]])
    return rows.groupBy(*keys).cogroup(carries.groupBy(*keys)).applyInArrow(apply, schema)
