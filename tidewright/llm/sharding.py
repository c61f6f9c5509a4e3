"""Sharding by balanced label propagation. DataFrame operations only."""

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running_sum
from .store import save

SHARDS = 8
#: Into how many parts of the largest room a group is cut that no shard has room for, time after time.
PIECES = (1, 2, 4, 8)


def _totals(df: DataFrame, shards: int) -> list[int]:
    got = {r[0]: r[1] for r in df.groupBy("shard").agg(F.sum("size")).collect()}
    return [int(got.get(i) or 0) for i in range(shards)]


def _by_shard(values: list[float], shard: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), shard.cast("int") + 1)


def propagate(linked: DataFrame, shards: int, room: list[float], name: str) -> DataFrame:
    """Move linked documents (size, link, shard, ...) to their neighbours' shards; adds settled, and takes what moved in from room.

    In each round the documents of a link vote: how many of its bytes lie in each
    shard now. All of a link's documents that haven't settled ask for the shard
    with most of their neighbours' bytes among those with room for the whole link,
    and the shard grants what fits its quota, large links first and else in a
    seeded order. Those that are granted take the new label, which a join brings to
    every document, and the next round votes by the new labels. A round takes a
    third of the room at least where a request is refused, so rounds are few. Ends
    when no shard has room for any link that is left.
    """
    linked = linked.withColumn("settled", F.lit(False))
    held = F.array(*[F.coalesce(F.sum(F.when(F.col("shard") == i, F.col("size"))), F.lit(0)) for i in range(shards)])
    for n in count():
        votes = linked.where("NOT settled").groupBy("link").agg(F.sum("size").alias("need"), held.alias("held"))
        asks = [F.when(F.col("need") <= room[i], F.struct(F.col("held")[i].alias("bytes"), F.xxhash64("link", F.lit(i)).alias("tie"), F.lit(i).alias("to"))) for i in range(shards)]
        asks = save(votes.select("link", "need", F.array_max(F.array(*asks))["to"].alias("to")).where("to IS NOT NULL"), f"{name}_asks{n}")
        if asks.isEmpty():
            return linked
        large = F.char(F.lit(126) - F.floor(F.log2("need")).cast("int"))
        answers = running_sum(asks, F.col("need"), ["to"], [F.col("link")], prefix=large)
        granted = save(answers.where(F.col("before") + F.col("need") <= _by_shard(room, F.col("to"))).select(F.col("link").alias("_link"), "to", "need"), f"{name}_granted{n}")
        for r in granted.groupBy("to").agg(F.sum("need").alias("given")).collect():
            room[r["to"]] -= r["given"]
        joined = linked.join(granted.drop("need"), F.col("link") == F.col("_link"), "left")
        moved = {"shard": F.coalesce("to", "shard"), "settled": F.col("settled") | F.col("to").isNotNull()}
        linked = save(joined.withColumns(moved).drop("_link", "to"), f"{name}_labels{n}")
    return linked


def gather(linked: DataFrame, shards: int, capacity: float) -> DataFrame:
    """Propagate links whole; cut those that no shard has room for, by bytes, whatever ids their rows have.

    Pieces are as large as the largest room, so that a group lies in as few shards
    as can be; what doesn't fit then is cut again, to parts of PIECES of the largest
    room. What is left at last keeps its shard and loses its link.
    """
    room, settled = [float(capacity)] * shards, None
    for n, part in enumerate((0, *PIECES)):
        if part:
            placed = running_sum(left, F.col("size"), ["link"], [F.col("doc_id"), F.col("key")])
            most = max(1.0, max(room) / part)
            piece = F.ceil((F.col("before") + F.col("size")) / most).cast("long")
            left = save(placed.withColumn("link", F.concat_ws("/", "link", piece)).drop("before"), f"shard_pieces{n}")
        else:
            left = linked
        found = propagate(left, shards, room, f"shard_cut{n}")
        done = found.where("settled").drop("settled")
        settled = done if settled is None else settled.unionByName(done)
        left = save(found.where("NOT settled").drop("settled"), f"shard_left{n}")
        if left.isEmpty():
            return settled
    return settled.unionByName(left.withColumn("link", F.lit(None).cast("string")))


def even_out(rows: DataFrame, shards: int, movable: Column, name: str) -> DataFrame:
    """Take what a shard has over the mean, unlinked documents first, and lay it end to end over the gaps of the others."""
    loads = _totals(rows, shards)
    mean = sum(loads) / shards
    over, gaps = [max(0.0, x - mean) for x in loads], [max(0.0, mean - x) for x in loads]
    if sum(over) < 1:
        return rows
    ranked = running_sum(rows.where(movable), F.col("size"), ["shard"], [F.col("doc_id"), F.col("key")], prefix=F.when(F.col("link").isNull(), "0").otherwise("1"))
    ranked = save(ranked.withColumn("leaves", 2 * F.col("before") + F.col("size") <= 2 * _by_shard(over, F.col("shard"))).drop("before"), f"{name}_ranked")
    leaving = running_sum(ranked.where("leaves"), F.col("size"), [], [F.col("doc_id"), F.col("key")])
    middle = F.col("before") + F.col("size") / 2
    to, end = F.lit(max(range(shards), key=gaps.__getitem__)), sum(gaps)
    for i in reversed(range(shards)):
        end -= gaps[i]
        if gaps[i]:
            to = F.when((middle >= end) & (middle <= end + gaps[i]), i).otherwise(to)
    leaving = leaving.withColumn("shard", to.cast("int")).drop("before")
    return save(leaving.unionByName(ranked.where("not leaves")).drop("leaves").unionByName(rows.where(~movable)), name)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Put documents into shards of near equal bytes, equal texts together as far as they fit.

    Returns doc_id, size (UTF-8 bytes and 1), text_crc32 (unsigned), key (MD5 of
    the text), shard and slot (0, 1, ... in each shard). Documents are linked if
    their texts are equal. They start in shards dealt by doc_id; gather() moves
    them by their neighbours' labels, and even_out() then moves mostly unlinked
    documents, large ones first and small ones last, so that sizes end within about
    a small document of each other. A group is cut only if no shard has room for
    it. A null text has size 1 and checksum 0
    and is linked with nothing. Rows without doc_id, and repeated rows, are rows of
    their own; an empty table gives an empty result; other columns are left out.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.md5("text").alias("key"))
    rows = save(rows.withColumn("shard", F.pmod(F.xxhash64(F.lit("start"), "doc_id"), F.lit(shards)).cast("int")), "shard_rows")
    total = sum(_totals(rows, shards))
    groups = save(rows.where("key IS NOT NULL").groupBy("key").count().where("count > 1").select(F.col("key").alias("_key")), "shard_groups")
    rows = save(rows.join(groups, F.col("key") == F.col("_key"), "left").withColumnRenamed("_key", "link"), "shard_links")
    linked = gather(rows.where("link IS NOT NULL"), shards, total / shards)
    rows = save(linked.unionByName(rows.where("link IS NULL")), "shard_gathered")
    mean = total / max(1, rows.count())
    for name, most in (("all", None), ("middling", mean), ("small", mean / 4)):
        rows = even_out(rows, shards, F.lit(True) if most is None else F.col("size") <= most, f"shard_even_{name}")
    return running_sum(rows, F.lit(1), ["shard"], [F.col("doc_id"), F.col("key")], "slot").select("doc_id", "size", "text_crc32", "key", "shard", "slot")


def cut_edges(placed: DataFrame) -> int:
    """Pairs of equal texts that lie in different shards, of what shard() returns; counted by groups, without making pairs."""
    pairs = F.sum(F.col("n") * (F.col("n") - 1) / 2)
    each = placed.where("key IS NOT NULL").groupBy("key", "shard").agg(F.count("*").alias("n"))
    inside, all_ = each.agg(pairs).first()[0], each.groupBy("key").agg(F.sum("n").alias("n")).agg(pairs).first()[0]
    return int((all_ or 0) - (inside or 0))


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    found = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
