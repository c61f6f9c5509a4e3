"""Running sums over any number of rows without one task that sees a whole group."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows that one window is meant to hold.
BUCKET_ROWS = 2048
#: Hex digits of a bucket's name that one window over bucket sums takes: 4,096 rows.
LEVEL_DIGITS = 3


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[f"_r_{k}"])
    return on


def _bucket_offsets(sums: DataFrame, groups: list[str], digits: int, head: int) -> DataFrame:
    """(groups, _b, _s) with a row for each bucket to the sum of the buckets before it (_o), by levels: windows run within all but the last LEVEL_DIGITS digits."""
    before = lambda keys: Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    if digits <= LEVEL_DIGITS:
        return sums.withColumn("_o", F.coalesce(F.sum("_s").over(before(groups)), F.lit(0))).drop("_s")
    within = sums.withColumn("_p", F.substring("_b", 1, head + digits - LEVEL_DIGITS))
    upper = within.groupBy(*groups, F.col("_p").alias("_b")).agg(F.sum("_s").alias("_s"))
    upper = _bucket_offsets(upper, groups, digits - LEVEL_DIGITS, head)
    upper = upper.select(*[F.col(k).alias(f"_r_{k}") for k in groups], F.col("_b").alias("_r__p"), F.col("_o").alias("_above"))
    within = within.withColumn("_o", F.coalesce(F.sum("_s").over(before([*groups, "_p"])), F.lit(0)))
    keys = [*groups, "_p"]
    return within.join(upper, _same(within, upper, keys), "left").withColumn("_o", F.col("_o") + F.col("_above")).drop("_s", "_p", "_above", *[f"_r_{k}" for k in keys])


def running_sum(df: DataFrame, value: Column, groups: list[str], order: list[Column], out: str = "before", prefix: Column | None = None) -> DataFrame:
    """Add column out: the sum of value over the rows of the same groups that come before a row.

    Rows come in the order of prefix (a short string, if given) and then of the
    MD5 of the order columns, which is a seeded shuffle that never changes. The
    first hex digits cut each group into buckets: a window runs within a bucket,
    and bucket sums, added up level by level, give what lies before it. df should
    be a saved table, as it is read three times. Rows that are equal in order
    share a bucket and come in any order among themselves, so order should tell
    apart whatever differs. Null groups are groups; null values count as 0.
    """
    df = df.withColumns({"_v": F.coalesce(value.cast("long"), F.lit(0)), "_h": F.concat(prefix if prefix is not None else F.lit(""), F.md5(F.concat_ws("/", *[F.coalesce(c.cast("string"), F.lit("")) for c in order])))})
    rows = df.count()
    digits = math.ceil(math.log(rows / BUCKET_ROWS, 16)) if rows > BUCKET_ROWS else 0
    head = int(prefix is not None)
    df = df.withColumn("_b", F.substring("_h", 1, digits + head))
    keys = [*groups, "_b"]
    within = Window.partitionBy(*keys).orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    sums = _bucket_offsets(df.groupBy(*keys).agg(F.sum("_v").alias("_s")), groups, digits, head)
    sums = sums.select(*[F.col(k).alias(f"_r_{k}") for k in keys], "_o")
    left = df.withColumn("_w", F.coalesce(F.sum("_v").over(within), F.lit(0)))
    joined = left.join(sums, _same(left, sums, keys), "left")
    return joined.withColumn(out, F.col("_w") + F.col("_o")).drop("_v", "_h", "_b", "_w", "_o", *[f"_r_{k}" for k in keys])
