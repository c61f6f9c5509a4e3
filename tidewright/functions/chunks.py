"""Rolling and expanding functions over pieces of a symbol's history, so that a long history is many tasks."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import Moments, Since, scan


def chunked(df: DataFrame, make: Callable[[DataFrame], DataFrame], reach: int, unit: str = "month", ahead: int = 0) -> DataFrame:
    """make(df), where a row of make's result looks at most reach rows of its symbol back and ahead rows forward.

    Time is cut by unit, and each piece gets the reach rows before it and the
    ahead rows after it. make sees (symbol, piece) as symbol, so its windows by
    symbol run within a piece; the rows that only served others are left out at
    the end. make keeps symbol and ts, one row for each of its rows, and must not
    look over all rows so far or across symbols. Only row counts of pieces are
    added up by symbol.
    """
    df = df.withColumn("_piece", F.date_trunc(unit, F.col("ts")).cast("timestamp_ntz"))
    counts = df.groupBy("symbol", "_piece").agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy("symbol").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    others = pieces.select(F.col("symbol").alias("_s"), F.col("_piece").alias("_p"), F.col("_before").alias("_start"), (F.col("_before") + F.col("_rows")).alias("_stop"))
    later = (F.col("_p") > F.col("_piece")) & (F.col("_start") - reach < F.col("_before") + F.col("_rows"))
    sooner = (F.col("_p") < F.col("_piece")) & (F.col("_stop") + ahead > F.col("_before"))
    wanted = pieces.join(others, F.col("symbol").eqNullSafe(F.col("_s")) & (later | sooner))
    # rows of _piece from _from on and before _until are what _p looks at
    wanted = wanted.select("_s", "_piece", "_p", F.when(later, F.col("_start") - F.col("_before") - reach).otherwise(0).alias("_from"), F.when(sooner, F.col("_stop") + ahead - F.col("_before")).otherwise(F.col("_rows")).alias("_until"))
    wanted = wanted.groupBy("_s", F.col("_piece").alias("_of")).agg(F.collect_list(F.struct("_p", "_from", "_until")).alias("_wanted"))
    rows = df.withColumn("_i", F.row_number().over(Window.partitionBy("symbol", "_piece").orderBy("ts")) - 1)
    rows = rows.join(wanted, F.col("symbol").eqNullSafe(F.col("_s")) & (F.col("_piece") == F.col("_of")), "left")
    given_to = F.transform(F.filter(F.coalesce("_wanted", F.array().cast(wanted.schema["_wanted"].dataType)), lambda w: (F.col("_i") >= w["_from"]) & (F.col("_i") < w["_until"])), lambda w: w["_p"])
    rows = rows.withColumn("_piece", F.explode(F.concat(F.array("_piece"), given_to)))
    given = [F.struct("symbol", "_piece").alias("symbol") if c == "symbol" else F.col(c) for c in df.columns if c != "_piece"]
    made = make(rows.select(*given)).where(F.date_trunc(unit, F.col("ts")).cast("timestamp_ntz") == F.col("symbol")["_piece"])
    return made.withColumn("symbol", F.col("symbol")["symbol"])


def with_z(df: DataFrame, names: list[str], least: tuple[int, ...] = (168, 720), since: dict[str, Column] | None = None, unit: str = "month") -> DataFrame:
    """Add {name}_z{n}, the expanding z-score of each column with each least number of values, and rows since each condition last held.

    A z-score is 0 where undefined or where the deviation is below 1e-12 or 1e-13
    of the mean; rows since are NULL before the condition first holds. Conditions
    are of a row's own columns. One scan in pieces of time makes them all: df is
    written once, and all scores of a piece are made together.
    """
    since = since or {}
    marked = df.withColumns({f"_is_{k}": F.coalesce(c, F.lit(False)) for k, c in since.items()})
    found = scan(marked, [Since({k: f"_is_{k}" for k in since}), Moments(names, tuple(least))], unit, name="scores")
    return found.drop(*[f"_is_{k}" for k in since])
