"""Rolling moments whose cost doesn't grow with the width.

A window frame of Spark adds all rows of the frame up again for each row: a mean
of 720 rows costs 720 additions a row. Here a piece of rows is cut into blocks
as long as the width; a window is then the end of one block and the beginning of
the next, and the moments of both are running sums. They are added up around a
value of their own block and merged, never subtracted, so digits don't get lost,
and a constant window has a variance of exactly 0.
"""

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from .scans import doubles, floats


@dataclass(frozen=True)
class Rolled:
    """One of KINDS over the last width rows of x, or of x and y where both are known; NULL below least (width) values."""

    kind: str
    width: int
    x: str
    y: str | None = None
    least: int | None = None


@dataclass
class Moments:
    """Counts, means, and sums of squares and products around the means, of many windows at once."""

    n: np.ndarray
    x: np.ndarray
    y: np.ndarray
    xx: np.ndarray
    yy: np.ndarray
    xy: np.ndarray

    def at(self, rows: np.ndarray, known: np.ndarray | bool = True) -> "Moments":
        picked = [getattr(self, f)[rows] for f in ("n", "x", "y", "xx", "yy", "xy")]
        return Moments(*[np.where(known, v, 0) for v in picked])

    def merged(self, other: "Moments") -> "Moments":
        total = np.maximum(self.n + other.n, 1)
        # an empty side has no mean, so it takes the other's
        dx = np.where((self.n > 0) & (other.n > 0), other.x - self.x, 0.0)
        dy = np.where((self.n > 0) & (other.n > 0), other.y - self.y, 0.0)
        share, both = other.n / total, self.n * other.n / total
        x, y = (np.where(self.n > 0, a + d * share, b) for a, b, d in ((self.x, other.x, dx), (self.y, other.y, dy)))
        return Moments(self.n + other.n, x, y, self.xx + other.xx + dx * dx * both, self.yy + other.yy + dy * dy * both, self.xy + other.xy + dx * dy * both)


def _running(known: np.ndarray, x: np.ndarray, y: np.ndarray) -> Moments:
    """Moments of the rows so far, block by block (axis 0), around each block's first known value."""
    first = known.argmax(axis=1)[:, None]
    cx, cy = np.take_along_axis(x, first, 1), np.take_along_axis(y, first, 1)
    dx, dy = np.where(known, x - cx, 0.0), np.where(known, y - cy, 0.0)
    n, sx, sy = known.cumsum(axis=1), dx.cumsum(axis=1), dy.cumsum(axis=1)
    m = np.maximum(n, 1)
    squares = ((dx * dx, sx * sx), (dy * dy, sy * sy))
    xx, yy = (np.maximum(d.cumsum(axis=1) - s / m, 0.0) for d, s in squares)
    return Moments(n, cx + sx / m, cy + sy / m, xx, yy, (dx * dy).cumsum(axis=1) - sx * sy / m)


def window_moments(x: np.ndarray, y: np.ndarray, width: int) -> Moments:
    """Moments of the last width rows at each row, of pairs without NaN. A window that holds an infinite value has NaN for all but its count."""
    rows = len(x)
    blocks = -(-rows // width)
    known = np.isfinite(x) & np.isfinite(y)

    def cut(values):
        return np.concatenate([values, np.zeros(blocks * width - rows, values.dtype)]).reshape(blocks, width)

    parts = [cut(known), cut(np.where(known, x, 0.0)), cut(np.where(known, y, 0.0))]
    ahead, back = _running(*parts), _running(*[p[:, ::-1] for p in parts])
    flat = lambda m, turn: Moments(*[getattr(m, f)[:, ::turn].ravel() for f in ("n", "x", "y", "xx", "yy", "xy")])
    at = np.arange(rows)
    start = at - width + 1
    out = flat(back, -1).at(np.maximum(start, 0), (start > 0) & (start % width > 0)).merged(flat(ahead, 1).at(at))
    if (np.isinf(x) | np.isinf(y)).any():
        seen = np.r_[0, np.cumsum(np.isinf(x) | np.isinf(y))]
        spoilt = seen[1:] > seen[np.maximum(start, 0)]
        for f in ("x", "y", "xx", "yy", "xy"):
            setattr(out, f, np.where(spoilt, np.nan, getattr(out, f)))
    return out


def _ratio(a, b):
    return np.divide(a, b, out=np.full(len(a), np.nan), where=b != 0)


KINDS = {
    "mean": lambda m: m.x,
    "sum": lambda m: m.x * m.n,
    "var": lambda m: _ratio(m.xx, m.n - 1.0),
    "sd": lambda m: np.sqrt(_ratio(m.xx, m.n - 1.0)),
    "cov": lambda m: _ratio(m.xy, m.n - 1.0),
    "corr": lambda m: _ratio(m.xy, np.sqrt(m.xx) * np.sqrt(m.yy)),
    "beta": lambda m: _ratio(m.xy, m.yy),
    "sd_ratio": lambda m: np.sqrt(_ratio(m.xx, m.yy)),
}


def rolled(df: DataFrame, wanted: Mapping[str, Rolled]) -> DataFrame:
    """df with a column for each of wanted, over the rows of a symbol by ts.

    Var, sd and cov are those of a sample; corr, beta (cov of x and y by var of y) and
    sd_ratio are NULL where they would divide by 0. NaN counts as missing, and a
    window that holds an infinite value has NULL. The rows of a symbol meet in one
    task, so that histories should come in pieces, as functions.chunks.chunked
    gives them; an empty table stays empty. Each width of the same columns is
    made once, whatever is asked of it.
    """
    unknown = {r.kind for r in wanted.values()} - set(KINDS)
    if unknown or any(r.width < 1 for r in wanted.values()):
        raise ValueError(f"no such rolling value: {', '.join(sorted(unknown)) or 'a width below 1'}")
    names = df.columns

    def run(piece: pa.Table) -> pa.Table:
        piece = piece.take(pc.sort_indices(piece, sort_keys=[("ts", "ascending")]))
        made: dict[tuple, Moments] = {}
        out = []
        for r in wanted.values():
            key = (r.x, r.y, r.width)
            if key not in made:
                x = floats(piece, r.x)
                made[key] = window_moments(x, x if r.y is None else floats(piece, r.y), r.width)
            m = made[key]
            enough = m.n >= (r.width if r.least is None else r.least)
            out.append(doubles(np.where(enough & (m.n > 0), KINDS[r.kind](m), np.nan)))
        return pa.Table.from_arrays([*[piece.column(c) for c in names], *out], [*names, *wanted])

    return df.groupBy("symbol").applyInArrow(run, StructType([*df.schema.fields, *[StructField(n, DoubleType()) for n in wanted]]))
