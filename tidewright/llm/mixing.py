"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions. DataFrame operations only."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import running_sum
from .store import in_boxes, save

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target).

    The sources share the sum of all sizes by weight. None gets more than
    max_epochs times its size; what it can't take goes to the others by weight,
    until all fit. That fixed point is a water level: in ascending order of
    cap / weight a source is capped while its cap lies under the level that the
    sources from it on would get, so one pass over the sorted sources finds it.
    """
    every = Window.partitionBy(F.lit(0))
    named = sources.withColumn("rank", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())))
    named = named.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    named = named.withColumn("cap", F.col("source_size") * max_epochs)
    ratio = F.col("cap").cast("double") / F.col("weight")
    up = every.orderBy(ratio, "rank")
    level = named.withColumns({
        "left": F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "shares": F.sum("weight").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        "place": F.row_number().over(up),
    })
    fits = F.col("cap") * F.col("shares") >= F.col("weight") * F.col("left")
    first = F.struct("place", "left", "shares")
    level = level.withColumn("at", F.min(F.when(fits, first)).over(every))
    free = F.col("place") >= F.col("at.place")
    target = F.when(free, (F.col("weight") * F.col("at.left")).cast("double") / F.col("at.shares").cast("double")).otherwise(F.col("cap").cast("double"))
    return level.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "", carried: tuple[str, ...] = ()) -> DataFrame:
    """Decide how often each document enters the mix.

    Returns doc_id, source, size, source_size, target, repeats,
    taken and the carried columns. Each document of a source enters floor(target /
    source_size) times; those that a seeded shuffle puts first enter once more,
    up to the document whose middle crosses what is left of the target, so a
    source misses its target by half a document at most. size defaults to the
    number of words. The shuffle goes by doc_id, size and the MD5 of the text, so
    rows that tie in it are equal, and reruns agree however the rows are dealt. A
    null text has size 0, a null doc_id is an id like others, a null source is a
    source and comes last, repeated rows count each, an empty table gives an empty
    result, very long texts are read once, and columns that aren't named stay
    unread, whatever their names.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) if size is None else size
    sized = save(docs.select("doc_id", "source", words.cast("long").alias("size"), F.md5("text").alias("_text"), *carried), "mix_sizes")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = save(targets(by_source, weights, max_epochs), "mix_targets").select(F.col("source").alias("_source"), "source_size", "target")
    placed = running_sum(sized, F.col("size"), ["source"], [F.lit(seed), F.col("doc_id"), F.col("size"), F.col("_text")])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - whole * F.col("source_size")
    more = (2 * F.col("before") + F.col("size") <= 2 * rest) & (rest > 0)
    out = placed.join(wanted, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("repeats", (whole + F.when(more, 1).otherwise(0)).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"), *carried)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "") -> DataFrame:
    """The documents of the mix with their own columns, whatever their names, each as many times as it enters.

    A row is known by doc_id, source and a hash of its text; rows that are equal in
    these share what they have together, and which of them gets one more follows
    from a hash of the whole row, so that reruns agree.
    """
    docs = in_boxes(docs, "doc_id", "source", "text").withColumn("_key", F.xxhash64("text"))
    found = mix(docs, weights=weights, max_epochs=max_epochs, seed=seed, carried=("_key",))
    name = [F.col("doc_id").alias("_doc"), F.col("source").alias("_source"), F.col("_key").alias("_hash")]
    times = save(found.groupBy(*name).agg(F.sum("repeats").alias("_all"), F.count("*").alias("_rows")).where("_all > 0"), "mix_repeats")
    on = F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_key") == F.col("_hash"))
    even, odd = times.where("_all % _rows = 0"), times.where("_all % _rows > 0")
    joined = docs.join(even, on).withColumn("_times", F.expr("_all div _rows"))
    if not odd.isEmpty():
        place = F.row_number().over(Window.partitionBy("_doc", "_source", "_hash").orderBy(F.md5(F.to_json("box"))))
        joined = joined.unionByName(docs.join(odd, on).withColumn("_times", F.expr("_all div _rows") + F.when(place <= F.col("_all") % F.col("_rows"), 1).otherwise(0)))
    return joined.where("_times > 0").select("box", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select("box.*")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), named AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM src
), weighed AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM named
), leveled AS (
  SELECT *, sum(source_size) OVER ()::BIGINT - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS remaining,
    sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS shares,
    row_number() OVER (ORDER BY cap::DOUBLE / weight, rank) AS place FROM weighed
), level AS (
  SELECT place, remaining, shares FROM leveled WHERE cap * shares >= weight * remaining ORDER BY place LIMIT 1
), wanted AS (
  SELECT l.source, l.source_size, CASE WHEN l.place >= lv.place THEN (l.weight * lv.remaining)::DOUBLE / lv.shares::DOUBLE ELSE l.cap::DOUBLE END AS target FROM leveled l CROSS JOIN (SELECT max(place) AS place, max(remaining) AS remaining, max(shares) AS shares FROM level) lv
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('/' || coalesce(doc_id::VARCHAR, '') || '/' || size || '/' || coalesce(md5(text), '')) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM sized
), whole AS (
  SELECT p.*, w.source_size, w.target, CASE WHEN w.source_size > 0 THEN floor(w.target / w.source_size) ELSE 0 END AS n FROM placed p JOIN wanted w ON p.source IS NOT DISTINCT FROM w.source
)
SELECT doc_id, size, source_size, target,
  (size * (n + CASE WHEN 2 * before + size <= 2 * (target - n * source_size) AND target - n * source_size > 0 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM whole
"""
