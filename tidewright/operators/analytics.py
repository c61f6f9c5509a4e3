"""Trading statistics, drawdowns, quality of features, correlations, heatmaps, catalog."""

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.chunks import chunked
from ..functions.periods import expected_rows
from ..functions.win import by_symbol, corr, lag, numbered, so_far, time_since


def pnl_frame(bars: DataFrame) -> DataFrame:
    """Position is the sign of the last return; profit is position times price change."""
    s = bars.select("symbol", "ts", "close", F.signum(lag("close") - lag("close", 2)).alias("position"))
    s = s.withColumn("pnl", F.coalesce(F.col("position") * (F.col("close") - lag("close")), F.lit(0.0)))
    return s.withColumn("total", F.sum("pnl").over(so_far()))


def hours_between(start, end) -> Column:
    """Hours from one time to another, to the microsecond."""
    micros = [F.unix_micros((F.col(t) if isinstance(t, str) else t).cast("timestamp")) for t in (start, end)]
    return (micros[1] - micros[0]) / 3.6e9


def drawdowns(frame: DataFrame) -> DataFrame:
    """Largest fall of the running total below its peak, and the longest closed time under one, in hours."""
    s = frame.withColumn("peak", F.max("total").over(so_far())).withColumn("under", F.col("total") < F.col("peak"))
    s = s.withColumn("episode", F.sum(F.when(~F.col("under"), 1).otherwise(0)).over(so_far()))
    runs = s.groupBy("symbol", "episode").agg(F.max(F.col("peak") - F.col("total")).alias("fall"), F.max_by("peak", "ts").alias("p"), F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"))
    nxt = F.lead("a").over(Window.partitionBy("symbol").orderBy("episode"))
    runs = runs.withColumn("hours", F.when((F.col("n") > 1) & nxt.isNotNull(), hours_between("a", nxt)))
    return runs.groupBy("symbol").agg(F.max("fall").alias("max_drawdown"), F.coalesce(F.max("hours"), F.lit(0.0)).alias("longest_hours"))


def trade_stats(frame: DataFrame) -> DataFrame:
    win, loss = F.col("pnl") > 0, F.col("pnl") < 0
    g = frame.groupBy("symbol").agg(F.count(F.when(win | loss, 1)).alias("trades"), F.count(F.when(win, 1)).alias("wins"), F.sum(F.when(win, F.col("pnl"))).alias("gain"), F.sum(F.when(loss, -F.col("pnl"))).alias("lost"), F.max("pnl").alias("best"), F.min("pnl").alias("worst"), F.avg("pnl").alias("mean"), F.stddev_samp("pnl").alias("sd"), F.expr("percentile(pnl, 0.05)").alias("var_95"), F.stddev_samp(F.when(loss, F.col("pnl"))).alias("down"))
    year = math.sqrt(365 * 24)
    return g.select("symbol", "trades", F.try_divide("wins", "trades").alias("win_rate"), F.try_divide("gain", "lost").alias("profit_factor"), "best", "worst", (F.try_divide("mean", "sd") * year).alias("sharpe"), (F.try_divide("mean", "down") * year).alias("sortino"), "var_95")


def equity_metrics(bars: DataFrame) -> DataFrame:
    """Of the close as an equity curve: total and annual return, volatility, largest relative drawdown."""
    s = bars.withColumns({"r": F.try_divide(F.col("close"), lag("close")) - 1, "dd": F.try_divide(F.col("close"), F.max("close").over(so_far())) - 1})
    g = s.groupBy("symbol").agg(F.count("r").alias("n"), (F.try_divide(F.max_by("close", "ts"), F.min_by("close", "ts")) - 1).alias("total_return"), F.stddev_samp("r").alias("sd"), F.min("dd").alias("max_drawdown"))
    return g.select("symbol", "n", "total_return", (F.pow(1 + F.col("total_return"), F.lit(252.0) / F.col("n")) - 1).alias("annual_return"), (F.col("sd") * math.sqrt(252)).alias("volatility"), "max_drawdown")


def risk_windows(frame: DataFrame) -> DataFrame:
    """Trailing volatility over 20 rows, value at risk and expected shortfall over 100. Runs month by month."""
    return chunked(frame.select("symbol", "ts", "pnl"), _risk_windows, 99)


def _risk_windows(frame: DataFrame) -> DataFrame:
    h = by_symbol().rowsBetween(-99, 0)
    s = frame.select("symbol", "ts", "pnl", (F.stddev_pop("pnl").over(by_symbol().rowsBetween(-19, 0)) * math.sqrt(252)).alias("volatility"), F.collect_list("pnl").over(h).alias("x"), F.expr("percentile(pnl, 0.05) over (partition by symbol order by ts rows between 99 preceding and current row)").alias("var_95"))
    low = F.filter("x", lambda v: v <= F.col("var_95"))
    return s.select("symbol", "ts", "volatility", "var_95", F.try_divide(F.aggregate(low, F.lit(0.0), lambda a, v: a + v), F.size(low)).alias("shortfall"))


def feature_quality(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each column: nulls, distinct values, least, greatest, mean, deviation."""
    tall = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("f")).select("f.*")
    return tall.groupBy("feature").agg(F.count_if(F.col("x").isNull()).alias("nulls"), F.count_distinct("x").alias("distinct"), F.min("x").alias("least"), F.max("x").alias("greatest"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of each pair of columns over the rows that have both; one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = df.agg(*[corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def percentiles(df: DataFrame, column: str, at: tuple[float, ...] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    every = F.expr(f"percentile({column}, array({', '.join(map(str, at))}))")
    return df.groupBy("symbol").agg(every.alias("p")).select("symbol", *[F.col("p")[i].alias(f"p{round(100 * a)}") for i, a in enumerate(at)])


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Equal bins, the last one closed on the right; values outside don't count."""
    x = F.col(column)
    i = F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(x.between(low, high)).groupBy("symbol", i.alias("bin")).agg(F.count("*").alias("n"))


def heatmap(events: DataFrame, levels: int = 10, width: float = 10.0) -> DataFrame:
    """Sum of value by day and level; the dense grid has 0 where nothing fell."""
    level = F.least(F.floor(F.col("value") / width), F.lit(levels - 1)).cast("int")
    cells = events.groupBy(F.to_date("ts").alias("day"), level.alias("level")).agg(F.sum("value").alias("v"))
    days = cells.select("day").distinct()
    grid = days.select("day", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    return grid.join(cells, ["day", "level"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def heatmap_filled(dense: DataFrame, least: float) -> DataFrame:
    """Carry each level's last value other than 0 forward; below least counts as 0."""
    w = Window.partitionBy("level").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    v = F.coalesce(F.last(F.when(F.col("v") != 0, F.col("v")), ignorenulls=True).over(w), F.lit(0.0))
    return dense.withColumn("v", v).withColumn("v", F.when(F.col("v") < least, 0.0).otherwise(F.col("v")))


def catalog(bars: DataFrame) -> DataFrame:
    """Start, end, rows and missing hours of each source."""
    g = bars.groupBy(F.col("symbol").alias("source")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"))
    hours = (F.unix_timestamp(F.col("end").cast("timestamp")) - F.unix_timestamp(F.col("start").cast("timestamp"))) / 3600
    return g.withColumn("missing", (hours + 1 - F.col("n")).cast("long"))


def overlap(sources: DataFrame) -> DataFrame:
    """What all sources cover."""
    return sources.agg(F.max("start").alias("start"), F.min("end").alias("end"), F.count("*").alias("sources"))


HOURS_A_YEAR = math.sqrt(365 * 24)


def trading_summary(frame: DataFrame) -> DataFrame:
    """22 statistics of a run by symbol: profit, drawdown and its longest closed time, risk (first return left out, as it is unknown), trades, execution."""
    s = frame.withColumns({"r": F.col("total_pnl") - lag("total_pnl"), "peak": F.max("total_pnl").over(so_far())})
    is_trade = F.col("coin_position_change") != 0
    s = s.withColumns({"trade": is_trade, "previous": F.max(F.when(is_trade, F.col("ts"))).over(by_symbol().rowsBetween(Window.unboundedPreceding, -1))})
    win, loss = F.col("trade") & (F.col("trade_pnl") > 0), F.col("trade") & (F.col("trade_pnl") < 0)
    of = lambda f, cond, c: f(F.when(cond, F.col(c)))
    gap = hours_between("previous", "ts")
    g = s.groupBy("symbol").agg(
        F.max_by("total_pnl", "ts").alias("total_pnl"), F.min(F.col("total_pnl") - F.col("peak")).alias("max_drawdown"),
        F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), of(F.stddev_samp, F.col("r") < 0, "r").alias("down"),
        F.expr("percentile(r, 0.05)").alias("var_95"), F.expr("percentile(r, 0.01)").alias("var_99"),
        F.count_if("trade").alias("total_trades"), F.count_if(win).alias("wins"), of(F.sum, win, "trade_pnl").alias("gain"), of(F.sum, loss, "trade_pnl").alias("lost"),
        of(F.avg, F.col("trade"), "trade_pnl").alias("avg_trade_pnl"), of(F.avg, win, "trade_pnl").alias("avg_winner"), of(F.avg, loss, "trade_pnl").alias("avg_loser"),
        of(F.max, win, "trade_pnl").alias("largest_winner"), of(F.min, loss, "trade_pnl").alias("largest_loser"),
        of(F.sum, F.col("trade"), "maker_trades").alias("makers"), of(F.avg, F.col("trade"), "trade_value").alias("avg_trade_size"),
        F.avg(F.when(F.col("trade"), gap)).alias("avg_trade_spacing"), F.max(F.abs("coin_position")).alias("max_position"),
        F.sum("missed_signals").alias("missed_trades"), of(F.avg, F.col("trade"), "miss_bps").alias("avg_slippage_bps"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    hours = drawdowns(frame.select("symbol", "ts", F.col("total_pnl").alias("total"))).select("symbol", F.col("longest_hours").alias("max_drawdown_hours"))
    return g.join(hours, "symbol").select(
        "symbol", "total_pnl", "max_drawdown", "max_drawdown_hours", zero(F.try_divide("mean", "sd") * HOURS_A_YEAR).alias("sharpe"), zero(F.try_divide("mean", "down") * HOURS_A_YEAR).alias("sortino"),
        (F.col("sd") * HOURS_A_YEAR).alias("volatility"), "var_95", "var_99", "total_trades", zero(F.try_divide("wins", "total_trades") * 100).alias("win_rate"), F.abs(F.try_divide("gain", "lost")).alias("profit_factor"),
        *[zero(F.col(c)).alias(c) for c in ("avg_trade_pnl", "avg_winner", "avg_loser", "largest_winner", "largest_loser")], zero(F.try_divide("makers", "total_trades") * 100).alias("maker_rate"),
        zero(F.col("avg_trade_size")).alias("avg_trade_size"), zero(F.col("avg_trade_spacing")).alias("avg_trade_spacing"), "max_position", "missed_trades", zero(F.col("avg_slippage_bps")).alias("avg_slippage_bps"),
    )


def curve_metrics(curve: DataFrame, value: str = "equity") -> DataFrame:
    """Of an equity curve: total and annual return (by 252 / n), volatility, Sharpe and Sortino by the root of 252 / n, largest drawdown as a positive share, win rate, profit factor."""
    s = curve.withColumns({"r": F.try_divide(F.col(value), lag(value)) - 1, "dd": F.try_divide(F.col(value), F.max(value).over(so_far())) - 1})
    up, down = F.col("r") > 0, F.col("r") < 0
    g = s.groupBy("symbol").agg(F.count("*").alias("n"), (F.try_divide(F.max_by(value, "ts"), F.min_by(value, "ts")) - 1).alias("total_return"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.stddev_samp(F.when(down, F.col("r"))).alias("down"), F.min("dd").alias("dd"), F.count_if(up).alias("ups"), F.count_if(F.col("r") != 0).alias("moves"), F.sum(F.when(up, F.col("r"))).alias("gain"), F.sum(F.when(down, F.col("r"))).alias("lost"))
    a = F.sqrt(F.lit(252.0) / F.col("n"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return g.select("symbol", "total_return", (F.col("total_return") * 252.0 / F.col("n")).alias("annual_return"), (F.col("sd") * a).alias("volatility"), zero(F.try_divide("mean", "sd") * a).alias("sharpe"), zero(F.try_divide("mean", "down") * a).alias("sortino"), F.abs("dd").alias("max_drawdown"), zero(F.try_divide("ups", "moves")).alias("win_rate"), F.abs(F.try_divide("gain", "lost")).alias("profit_factor"))


def run_metrics(states: DataFrame, trades: DataFrame) -> DataFrame:
    """Of the states and trades of a replay by symbol: position, profit, risk and trading figures."""
    s = states.withColumn("r", F.try_divide(F.col("equity"), lag("equity")) - 1)
    last = lambda c: F.max_by(c, "ts")
    g = s.groupBy("symbol").agg(F.avg(F.abs("size")).alias("avg_position"), F.max(F.abs("size")).alias("max_position"), F.avg("leverage").alias("avg_leverage"), F.max("leverage").alias("max_leverage"), F.avg((F.col("size") != 0).cast("double")).alias("time_in_market"), last("realized").alias("realized"), last("unrealized").alias("unrealized"), last("maker_fees").alias("maker_fees"), last("taker_fees").alias("taker_fees"), F.expr("percentile(r, 0.05)").alias("var_95"), (F.stddev_samp("r") * math.sqrt(252)).alias("volatility_annual"), (F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))) * math.sqrt(252)).alias("downside_deviation"))
    low = s.join(g.select("symbol", "var_95"), "symbol").where("r <= var_95").groupBy("symbol").agg(F.avg("r").alias("expected_shortfall"))
    t = trades.groupBy("symbol").agg(F.count("*").alias("trade_count"), F.avg(F.col("is_maker").cast("double")).alias("maker_ratio"), F.avg("size").alias("avg_trade_size"), F.avg("fees").alias("avg_fees"))
    out = g.join(low, "symbol", "left").join(t, "symbol", "left")
    return out.withColumns({"total_pnl": F.col("realized") + F.col("unrealized"), "total_fees": F.col("maker_fees") + F.col("taker_fees")}).fillna(0.0, ["maker_ratio", "avg_trade_size", "avg_fees"]).fillna(0, ["trade_count"])


def risk_metrics(states: DataFrame) -> DataFrame:
    """Of states (symbol, ts, close, size, equity, pnl): volatility of the last 20 returns, value at risk, shortfall and Sharpe of the last 100 and 252, drawdown of profit, concentration, overnight exposure, profit and volatility over 20 rows. Frames that aren't full count as 0."""
    s = states.withColumn("r", F.try_divide(F.col("pnl") - lag("pnl"), F.col("equity")))
    frame = lambda n: by_symbol().rowsBetween(-(n - 1), 0)
    full = lambda n, c: F.when(F.count("r").over(frame(n)) >= n, c).otherwise(0.0)
    s = s.withColumns({"vol": full(20, F.stddev_pop("r").over(frame(20)) * math.sqrt(252)), "var_95": full(100, F.expr("percentile(r, 0.05) over (partition by symbol order by ts rows between 99 preceding and current row)")), "x": F.collect_list("r").over(frame(100)), "sharpe": full(252, F.try_divide(F.avg("r").over(frame(252)), F.stddev_pop("r").over(frame(252))) * math.sqrt(252)), "peak": F.max("pnl").over(so_far()), "total_20": F.when(F.count("*").over(frame(20)) >= 20, F.sum("pnl").over(frame(20))).otherwise(0.0)})
    low = F.filter("x", lambda v: v <= F.col("var_95"))
    worth = F.abs(F.col("size") * F.col("close"))
    return s.select("symbol", "ts", F.col("vol").alias("volatility"), "var_95", full(100, F.try_divide(F.aggregate(low, F.lit(0.0), lambda a, v: a + v), F.size(low))).alias("expected_shortfall"), F.coalesce("sharpe", F.lit(0.0)).alias("sharpe"), (F.col("peak") - F.col("pnl")).alias("max_drawdown"), F.try_divide(worth, F.col("equity")).alias("concentration"), F.when((F.hour("ts") < 9) | (F.hour("ts") >= 16), worth).otherwise(0.0).alias("overnight_exposure"), F.col("total_20").alias("rolling_pnl"), F.col("vol").alias("rolling_volatility"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """How often each value occurs, NULL included."""
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))


def percentile_vector(df: DataFrame, column: str) -> DataFrame:
    """P1 to P99 by symbol, a row each."""
    ranks = ", ".join(f"{i / 100}" for i in range(1, 100))
    p = df.groupBy("symbol").agg(F.expr(f"percentile({column}, array({ranks}))").alias("p"))
    return p.select("symbol", F.posexplode("p").alias("i", "value")).select("symbol", (F.col("i") + 1).alias("percentile"), "value")


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature_quality by symbol, with the first and the last value in time and how many values are missing in percent."""
    tall = df.select("symbol", "ts", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("f")).select("symbol", "ts", "f.*")
    known = F.when(F.col("x").isNotNull(), F.col("ts"))
    return tall.groupBy("symbol", "feature").agg(F.count_if(F.col("x").isNull()).alias("nulls"), (F.count_if(F.col("x").isNull()) * 100.0 / F.count("*")).alias("null_percent"), F.count_distinct("x").alias("distinct"), F.min_by("x", known).alias("first"), F.max_by("x", known).alias("last"))


def top_in_groups(df: DataFrame, by: str, keys: list[str], n: int = 3, largest: bool = True, ties: str = "ts") -> DataFrame:
    """The n rows of each group with the largest (smallest) value, with their rank; ties go to the smaller of the column ties."""
    c = F.col(by).desc() if largest else F.col(by).asc()
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(c, ties))).where(F.col("rank") <= n)


def cumulative(df: DataFrame, value: str) -> DataFrame:
    """Running sum, product, maximum and count of a column."""
    return df.select("symbol", "ts", F.sum(value).over(so_far()).alias("total"), F.product(1 + F.col(value) / 10_000).over(so_far()).alias("growth"), F.max(value).over(so_far()).alias("top"), F.count(value).over(so_far()).alias("n"))


def time_since_capped(df: DataFrame, cond, cap: int) -> DataFrame:
    """Rows since cond last held, cap at most; rows before it first does count as many rows as the symbol has, uncapped only if it never holds."""
    whole = Window.partitionBy("symbol")
    s = numbered(df)
    n = F.count(F.lit(1)).over(whole)
    since = F.coalesce(time_since(cond), n)
    never = F.max(F.when(cond, 1)).over(whole).isNull()
    return s.select("symbol", "ts", F.when(never, n).otherwise(F.least(since, F.lit(cap))).alias("since"))


def developing(df: DataFrame, value: str, season) -> DataFrame:
    """Of each run of rows in one season (such as a session): its number, the sum so far, the sum of the whole run, and the sum so far carried on to the length of the run before."""
    s = df.withColumn("season", season)
    changed = F.coalesce(F.col("season") != F.lag("season").over(by_symbol()), F.lit(True))
    s = s.withColumn("run", F.sum(changed.cast("int")).over(so_far()))
    run = Window.partitionBy("symbol", "run")
    s = s.withColumns({"so_far": F.sum(value).over(run.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)), "at": F.row_number().over(run.orderBy("ts")), "whole": F.sum(value).over(run), "length": F.count("*").over(run)})
    before = s.groupBy("symbol", (F.col("run") + 1).alias("run")).agg(F.first("length").alias("before"))
    return s.join(before, ["symbol", "run"], "left").select("symbol", "ts", "season", "run", "so_far", "whole", (F.col("so_far") * F.try_divide(F.coalesce("before", "at"), F.col("at"))).alias("projected"))


def heatmap_triples(triples: DataFrame, levels: DataFrame, prices: DataFrame, hours: DataFrame) -> DataFrame:
    """Triples (n, x, y, value), levels (y, level), prices (x, ts) and the hours of a chart to a dense (ts, level, value): the hour of a triple's price, the last triple of a cell wins, 0 where there is none. Triples outside the places are left out."""
    placed = triples.join(prices.select("x", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")), "x").join(levels, "y")
    cells = placed.groupBy("ts", "level").agg(F.max_by("value", "n").alias("value"))
    grid = hours.select("ts").distinct().join(levels.agg(F.collect_list("level").alias("levels"))).select("ts", F.explode("levels").alias("level"))  # one row of levels
    return grid.join(cells, ["ts", "level"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def chart_frames(states: DataFrame, trades: DataFrame) -> dict[str, DataFrame]:
    """What the charts of a run draw: equity and drawdown over time, returns in 50 bins, trades by side and kind."""
    s = states.withColumns({"peak": F.max("equity").over(so_far()), "r": F.try_divide(F.col("equity"), lag("equity")) - 1})
    span = s.groupBy("symbol").agg(F.min("r").alias("low"), F.max("r").alias("high"))
    binned = s.join(span, "symbol").where("r is not null").select("symbol", F.least(F.floor(F.try_divide(F.col("r") - F.col("low"), F.col("high") - F.col("low")) * 50), F.lit(49)).cast("int").alias("bin"))
    return {"equity": s.select("symbol", "ts", "equity", "close", "size"), "drawdown": s.select("symbol", "ts", (F.try_divide(F.col("equity"), F.col("peak")) - 1).alias("drawdown")), "returns": binned.groupBy("symbol", "bin").agg(F.count("*").alias("n")), "trades": trades.groupBy("symbol", "side", "is_maker").agg(F.count("*").alias("n"), F.sum("size").alias("size"))}


#: Kinds of sources: order of use, granularity, whether known a bar late or early, and bars of lookback.
PRIORITIES = (("binance", 1, "1h", "t-1", 8760), ("futures", 2, "1h", "t-1", 8760), ("deribit", 3, "1h", "t-1", 720), ("vix", 4, "1d", "t-1", 252), ("fear_greed", 5, "1d", "t+1", 365))


#: Kinds of sources that a table of priorities may have.
MOST_KINDS = 10_000


def source_priorities(spark) -> DataFrame:
    return spark.createDataFrame(PRIORITIES, "source_type string, priority int, granularity string, timing string, lookback int")


def catalog_entries(bars: DataFrame, directory: str, period: str = "1h") -> DataFrame:
    """A row for each source: where it lies, its headers, first and last ts, rows, and rows that are missing."""
    g = bars.groupBy(F.col("symbol").alias("source_id")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"))
    return g.select("source_id", F.lower("source_id").alias("nickname"), F.concat_ws("/", F.lit(directory), F.concat(F.lit("symbol="), "source_id")).alias("directory"), F.lit(period).alias("granularity"), F.lit(",".join(bars.columns)).alias("headers"), "start", "end", "n", (expected_rows("start", "end", period) - F.col("n")).alias("missing"))


def upsert(catalog_rows: DataFrame, rows: DataFrame, key: str = "source_id") -> DataFrame:
    """Rows replace those of the same key, others stay."""
    return catalog_rows.join(rows.select(key), key, "left_anti").unionByName(rows)


def get_source(catalog_rows: DataFrame, source_id: str) -> DataFrame:
    return catalog_rows.where(F.col("source_id") == source_id)


def load_source(catalog_rows: DataFrame, source_id: str) -> DataFrame:
    """The bars of one source, from the directory that the catalog names."""
    found = get_source(catalog_rows, source_id).select("directory").take(1)
    if not found:
        raise KeyError(f"no source {source_id!r}")
    return catalog_rows.sparkSession.read.parquet(found[0].directory).withColumn("symbol", F.lit(source_id))


def missing_sources(catalog_rows: DataFrame, priorities: DataFrame) -> DataFrame:
    """Kinds of sources that no entry's nickname has."""
    return priorities.join(catalog_rows, F.expr("nickname LIKE '%' || source_type || '%'"), "left_anti").select("source_type", "priority")


def collection_status(catalog_rows: DataFrame, priorities: DataFrame) -> DataFrame:
    """For each kind of source: how many entries, their span, and whether there is any. There are few kinds, so entries look theirs up."""
    kinds = F.broadcast(priorities.select("source_type").limit(MOST_KINDS))
    found = catalog_rows.select("nickname", "start", "end").join(kinds, F.expr("nickname LIKE '%' || source_type || '%'"))
    found = found.groupBy("source_type").agg(F.count("nickname").alias("sources"), F.min("start").alias("start"), F.max("end").alias("end"))
    all_ = priorities.select("source_type", "priority").join(found, "source_type", "left").withColumn("sources", F.coalesce("sources", F.lit(0)))
    return all_.withColumn("collected", F.col("sources") > 0)


def save_catalog(catalog_rows: DataFrame, path: str) -> int:
    """Write a catalog as the next version at path; earlier ones stay, so that a reader is never without. Returns the version."""
    spark = catalog_rows.sparkSession
    number = max(catalog_versions(spark, path), default=0) + 1
    catalog_rows.write.parquet(f"{path}/version={number}")
    return number


def catalog_versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of a catalog that are written to their end."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")
    found = done.getFileSystem(conf).globStatus(done)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])


def load_catalog(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The last version of a catalog at path, or the one that is named."""
    versions = catalog_versions(spark, path)
    if not versions or (version is not None and version not in versions):
        raise FileNotFoundError(f"no catalog of version {version or 'any'} at {path}")
    return spark.read.parquet(f"{path}/version={version or versions[-1]}")


def catalog_report(catalog_rows: DataFrame, priorities: DataFrame) -> DataFrame:
    """Entries in order of their kind's priority, with its granularity, timing and lookback; those of no kind come last."""
    kinds = F.broadcast(priorities.select("source_type", "priority", F.col("granularity").alias("expected"), "timing", "lookback").limit(MOST_KINDS))
    joined = catalog_rows.join(kinds, F.expr("nickname LIKE '%' || source_type || '%'"), "left")
    return joined.orderBy(F.col("priority").asc_nulls_last(), "source_id")
