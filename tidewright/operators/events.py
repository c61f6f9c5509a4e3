"""Flags of dated events and rules, taken from a table of events by a join."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import event_table

#: Bytes that the days of events may take to be broadcast; a larger table is joined by a shuffle.
BROADCAST_BYTES = 8 << 20
#: Event names that become columns, at most.
MOST_NAMES = 1_000

# fixed values: dates of events by category
ECONOMIC = {
    "NFP": "first_friday",
    "US_ELECTION": ["2020-11-03", "2024-11-05"],
    "FOMC": [
        "2019-01-30", "2019-03-20", "2019-05-01", "2019-06-19", "2019-07-31", "2019-09-18", "2019-10-30", "2019-12-11",
        "2020-01-29", "2020-03-03", "2020-03-15", "2020-04-29", "2020-06-10", "2020-07-29", "2020-09-16", "2020-11-05", "2020-12-16",
        "2021-01-27", "2021-03-17", "2021-04-28", "2021-06-16", "2021-07-28", "2021-09-22", "2021-11-03", "2021-12-15",
        "2022-01-26", "2022-03-16", "2022-05-04", "2022-06-15", "2022-07-27", "2022-09-21", "2022-11-02", "2022-12-14",
        "2023-02-01", "2023-03-22", "2023-05-03", "2023-06-14", "2023-07-26", "2023-09-20", "2023-11-01", "2023-12-13",
        "2024-01-31", "2024-03-20", "2024-05-01", "2024-06-12", "2024-07-31", "2024-09-18", "2024-11-07", "2024-12-18",
        "2025-01-29", "2025-03-19", "2025-04-30", "2025-06-11", "2025-07-30", "2025-09-17", "2025-11-05", "2025-12-17",
    ],
    "USD_GDP": [
        "2019-01-30", "2019-04-26", "2019-07-26", "2019-10-30", "2020-01-30", "2020-04-29", "2020-07-30", "2020-10-29",
        "2021-01-28", "2021-04-29", "2021-07-29", "2021-10-28", "2022-01-27", "2022-04-28", "2022-07-28", "2022-10-27",
        "2023-01-26", "2023-04-27", "2023-07-27", "2023-10-26", "2024-01-25", "2024-04-25", "2024-07-25", "2024-10-24",
        "2025-01-30", "2025-04-24", "2025-07-24", "2025-10-30",
    ],
}
MAJOR = {
    "COVID_EMERGENCY": ["2020-03-13"],
    "FED_UNLIMITED_QE": ["2020-03-23"],
    "SVB_COLLAPSE": ["2023-03-10"],
    "SIGNATURE_CLOSURE": ["2023-03-12"],
    "CREDIT_SUISSE_DEAL": ["2023-03-19"],
    "RUSSIA_UKRAINE": ["2022-02-24"],
    "FTX_BANKRUPTCY": ["2022-11-11"],
    "CRYPTO_SEC": ["2023-06-13"],
}


def rules() -> dict[str, Column]:
    """Rules by name: columns of ts."""
    return {"first_friday": (F.dayofmonth("ts") <= 7) & (F.weekday("ts") == 4)}


def known_events(spark: SparkSession) -> DataFrame:
    """ECONOMIC and MAJOR as a table of events (category, name, date, rule)."""
    return event_table(spark, {"events": {"economic_events": ECONOMIC, "major_events": MAJOR}})


def days_of(events: DataFrame) -> DataFrame:
    """(_day, _names): the events of each day that has any, broadcast if they are small by a count."""
    days = events.where(F.col("date").isNotNull()).groupBy(F.col("date").alias("_day")).agg(F.collect_set("name").alias("_names"))
    size = days.agg(F.sum(40 + F.aggregate("_names", F.lit(0), lambda a, n: a + F.octet_length(n) + 16))).first()[0] or 0
    return F.broadcast(days) if size <= BROADCAST_BYTES else days


def event_flags(bars: DataFrame, events: DataFrame, more_rules: dict[str, Column] | None = None) -> DataFrame:
    """(symbol, ts, is_{name}): whether a bar lies on a day of each event of a table (category, name, date, rule), the whole day counting, or its rule holds.

    An event may have dates, a rule, or both. Names become columns, in their order,
    so there may be MOST_NAMES at most; dates are joined. A row without date and
    rule names an event that never is; events of the same name in two categories
    are one. A bar without ts has 0.
    """
    known = rules() | (more_rules or {})
    names = [r.name for r in events.where("name IS NOT NULL").select("name").distinct().orderBy("name").limit(MOST_NAMES + 1).collect()]
    if len(names) > MOST_NAMES:
        raise ValueError(f"there are more than {MOST_NAMES} names of events")
    ruled = [(r.name, r.rule) for r in events.where("rule IS NOT NULL AND name IS NOT NULL").select("name", "rule").distinct().limit(MOST_NAMES).collect()]
    if unknown := sorted({rule for _, rule in ruled} - set(known)):
        raise ValueError(f"there is no rule {', '.join(unknown)}; there are {', '.join(sorted(known))}")
    held = bars.select("symbol", "ts").join(days_of(events), F.to_date("ts") == F.col("_day"), "left")
    flags = {}
    for name in names:
        here = F.coalesce(F.array_contains("_names", name), F.lit(False))
        for rule in sorted(r for n, r in ruled if n == name):
            here = here | F.coalesce(known[rule], F.lit(False))
        flags[f"is_{name}"] = here.cast("int")
    return held.select("symbol", "ts", *[v.alias(k) for k, v in flags.items()])
