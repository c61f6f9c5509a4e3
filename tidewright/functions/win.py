"""Ordered-window functions over (symbol, ts). Missing is NULL, never NaN; a rolling value needs as many values as its width."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_symbol():
    return Window.partitionBy("symbol").orderBy("ts")


def so_far():
    return by_symbol().rowsBetween(Window.unboundedPreceding, 0)


def earlier():
    return by_symbol().rowsBetween(Window.unboundedPreceding, -1)



def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lag(c, n: int = 1) -> Column:
    return F.lag(col(c), n).over(by_symbol())


def frame(n: int):
    return by_symbol().rowsBetween(-(n - 1), 0)


def roll(agg, c, n: int, least: int | None = None) -> Column:
    """agg over the last n rows, NULL below least (n) values."""
    c = col(c)
    return F.when(F.count(c).over(frame(n)) >= (n if least is None else least), agg(c).over(frame(n)))


def zscore(c, least: int) -> Column:
    """Expanding z-score with at least that many values; 0 where undefined or the deviation is below 1e-12."""
    c = col(c)
    sd = F.stddev_samp(c).over(so_far())
    return F.coalesce(F.when((F.count(c).over(so_far()) >= least) & (sd >= 1e-12), (c - F.avg(c).over(so_far())) / sd), F.lit(0.0))


def corr(a: str, b: str, over=None) -> Column:
    """Pearson correlation of pairs without NULL; NULL where one side is constant."""
    a, b = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    parts = [F.covar_samp(a, b), F.stddev_samp(a), F.stddev_samp(b)]
    cov, x, y = parts if over is None else [p.over(over) for p in parts]
    return F.try_divide(cov, x * y)


def diff(c, n: int = 1) -> Column:
    return col(c) - lag(c, n)


def pct_change(c, n: int = 1) -> Column:
    return F.try_divide(col(c), lag(c, n)) - 1


def flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


def time_since(cond: Column) -> Column:
    """Rows since cond last held, NULL before it first does. Needs a column rn (row number)."""
    return F.col("rn") - F.max(F.when(cond, F.col("rn"))).over(so_far())


def numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(by_symbol()))


def cross(a, b) -> Column:
    """1 where a rises above b, -1 where it falls below, else 0."""
    a, b = col(a), col(b)
    up, down = (a > b) & (lag(a) <= lag(b)), (a < b) & (lag(a) >= lag(b))
    return F.when(up, 1).when(down, -1).otherwise(0)


def shifted(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as of the row before, so that features of a row know only earlier bars."""
    return df.select("symbol", "ts", *[lag(c).alias(c) for c in columns])


#: Added before rounding, so that exact halves don't round by the order in which a sum was added up.
NUDGE = 1.3e-8


def near(c, digits: int = 6) -> Column:
    return F.round(col(c) + NUDGE, digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[near(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def ewm(df: DataFrame, value: str, spans: list[int], chunk: Column | None = None, prefix: str = "ewm") -> DataFrame:
    """Add {prefix}_{span}: y += 2 / (span + 1) * (x - y), seeded with the first value; NULLs are skipped.

    The recursion is linear: a chunk (a month; take a shorter one for bars of
    minutes) folded from 0 needs only (1 - alpha)^k times what comes before it. So
    a first pass makes one row for each symbol and chunk, these carries are folded
    by symbol, and a second pass runs the recursion itself in each chunk from its
    carry. All of it is array functions in the JVM, and no task holds more of a
    symbol than a chunk and the carries.
    """
    chunk = F.date_trunc("month", F.col("ts")) if chunk is None else chunk
    alphas = [2.0 / (s + 1) for s in spans]
    row = F.struct("ts", F.col(value).cast("double").alias("x"), *[c for c in df.columns if c not in ("symbol", "ts")])
    chunks = df.groupBy("symbol", chunk.alias("_chunk")).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    ys = lambda make: F.struct(*[make(i, a).alias(f"y{i}") for i, a in enumerate(alphas)])
    known = F.filter("_rows", lambda r: r.x.isNotNull())
    local = F.aggregate(known, ys(lambda i, a: F.lit(0.0)), lambda y, r: ys(lambda i, a: y[f"y{i}"] + a * (r.x - y[f"y{i}"])))
    summary = chunks.select("symbol", "_chunk", F.size(known).alias("k"), F.try_element_at(known, F.lit(1))["x"].alias("first"), local.alias("local"))
    ends = summary.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("_chunk", "k", "first", "local"))).alias("ends"))

    def through(y, e):
        seed = lambda i: F.coalesce(y["y"][f"y{i}"], e["first"])
        new = ys(lambda i, a: F.when(e["k"] > 0, F.pow(F.lit(1 - a), e["k"]) * seed(i) + e["local"][f"y{i}"]).otherwise(y["y"][f"y{i}"]))
        return F.struct(new.alias("y"), F.concat(y["out"], F.array(F.struct(e["_chunk"].alias("c"), y["y"].alias("y")))).alias("out"))

    kind = "struct<" + ",".join(f"y{i}:double" for i in range(len(spans))) + ">"
    none = F.from_json(F.lit("{}"), kind)
    chunk_type = chunks.schema["_chunk"].dataType.simpleString()
    start = F.struct(none.alias("y"), F.array().cast(f"array<struct<c:{chunk_type},y:{kind}>>").alias("out"))
    carries = ends.select("symbol", F.explode(F.aggregate("ends", start, through)["out"]).alias("e")).select(F.col("symbol").alias("_s"), F.col("e.c").alias("_c"), F.col("e.y").alias("_y"))
    joined = chunks.join(carries, F.col("symbol").eqNullSafe(F.col("_s")) & F.col("_chunk").eqNullSafe(F.col("_c")))

    def run(acc, r):
        step = ys(lambda i, a: F.when(r.x.isNull(), acc["y"][f"y{i}"]).otherwise(F.when(acc["y"][f"y{i}"].isNull(), r.x).otherwise(acc["y"][f"y{i}"] + a * (r.x - acc["y"][f"y{i}"]))))
        return F.struct(step.alias("y"), F.concat(acc["out"], F.array(step)).alias("out"))

    out = F.aggregate("_rows", F.struct(F.col("_y").alias("y"), F.array().cast(f"array<{kind}>").alias("out")), run)["out"]
    each = joined.select("symbol", F.explode(F.arrays_zip(F.col("_rows").alias("r"), out.alias("v"))).alias("e"))
    columns = [F.col("symbol") if c == "symbol" else F.col(f"e.r.{c}").alias(c) for c in df.columns]
    return each.select(*columns, *[F.col(f"e.v.y{i}").alias(f"{prefix}_{s}") for i, s in enumerate(spans)])


def row_mean(columns: list[Column]) -> Column:
    """Mean of those that aren't NULL."""
    zero = [F.coalesce(c, F.lit(0.0)) for c in columns]
    return F.try_divide(reduce(lambda a, b: a + b, zero), reduce(lambda a, b: a + b, [c.isNotNull().cast("double") for c in columns]))
