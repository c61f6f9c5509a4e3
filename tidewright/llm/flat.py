"""Flat token files: ids one after another with an id at the end of each document and no index, and the scan that finds the documents again."""

import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import tidy
from .encode import encoder, vocabulary_path
from .store import new_path, save, shuffle_partitions
from .tokens import _runs, shard_starts, width
from .warc import open_folder

#: Tokens after which a file is closed, at the end of a run of documents.
FILE_TOKENS = 1 << 26
#: Bytes of a file that are searched at once.
BLOCK_BYTES = 1 << 20
#: Blocks that a task searches, about.
BLOCKS_A_TASK = 64
#: Names of documents that a row of the table of names holds, about.
NAMES = 1 << 15


class FlatFiles(NamedTuple):
    """files (shard, path); names (shard, first, doc_ids): the documents of a shard by ordinal from first on; bits of an id."""

    files: DataFrame
    names: DataFrame
    bits: int


def write_flat(docs: DataFrame, path: str, end_id: int, folder: str | None = None) -> FlatFiles:
    """Encode (doc_id, text) with the vocabulary at path and write little-endian ids of 16 or 32 bits to files in folder; end_id follows each document.

    Documents stand in the order of the input, so nothing is shuffled. The files
    hold ids alone: no lengths, names or offsets, which the scan has to find. Names
    are a table of their own, by ordinal. A null or empty text has only its end id;
    a long one may fill many blocks; an empty table gives no file. A task that runs
    twice leaves a file that nothing names.
    """
    bits = 16 if width(max(encoder(path, True).size, end_id + 1)) <= 16 else 32
    folder = folder or new_path(docs.sparkSession, "flat_files")

    @tidy
    def write(batches):
        system, root = open_folder(folder)
        system.create_dir(root, recursive=True)
        part, seq = TaskContext.get().partitionId(), -1
        out = file = None
        tokens = first = 0
        names: list = []

        def rows():
            columns = [[part], [seq], [file], [first], [names]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int64())))], ["part", "seq", "path", "first", "doc_ids"])

        for run_names, ids, _ in _runs(batches, path, end_id, True):
            if out is None:
                seq, file, tokens, first, names = seq + 1, f"{root}/{uuid.uuid4().hex}.bin", 0, 0, []
                out = system.open_output_stream(file, compression=None)
            out.write(ids.astype(f"<u{bits // 8}").tobytes())
            tokens, names = tokens + len(ids), names + run_names
            full = tokens >= FILE_TOKENS
            if full:
                out.close()
                out = None
            if full or len(names) >= NAMES:
                yield rows()
                first, names = first + len(names), []
        if out is not None:
            out.close()
            if names:
                yield rows()

    each = save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(write, "part int, seq int, path string, first long, doc_ids array<long>"), "flat_names")
    # one row for each file
    files = each.select("part", "seq", "path").distinct().withColumn("shard", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("part", "seq")) - 1)
    files = save(files.select("shard", "path"), "flat_shards")
    named = each.join(files.select("shard", F.col("path").alias("_path")), F.col("path") == F.col("_path")).select("shard", "first", "doc_ids")
    return FlatFiles(files, named, bits)


def blocks_of(files: DataFrame, block_bytes: int) -> DataFrame:
    """(shard, path, block, from, to): the byte ranges of files (shard, path), dealt out evenly."""

    def sizes(batches):
        for batch in batches:
            found = []
            for path in batch.column(1).to_pylist():
                system, inside = open_folder(path)
                found.append(system.get_file_info(inside).size)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], ["shard", "path", "bytes"])

    sized = save(files.select("shard", "path").mapInArrow(sizes, "shard int, path string, bytes long").where("bytes > 0"), "flat_sizes")
    total = sized.agg(F.sum(F.ceil(F.col("bytes") / block_bytes))).first()[0] or 0
    tasks = max(shuffle_partitions(files.sparkSession), -(-int(total) // BLOCKS_A_TASK))
    each = sized.select("shard", "path", "bytes", F.explode(F.sequence(F.lit(0), F.floor((F.col("bytes") - 1) / block_bytes))).alias("block"))
    each = each.select("shard", "path", "block", (F.col("block") * block_bytes).alias("from"), F.least((F.col("block") + 1) * block_bytes, "bytes").alias("to"))
    return each.repartition(tasks)


def separator_scan(files: DataFrame, end_id: int, bits: int = 16) -> DataFrame:
    """Documents of flat token files (shard, path): shard, ordinal and place (at) in the shard, start (at and the tokens of all shards before), n_tokens with the end id.

    Each block is searched on its own for end_id. A prefix scan over the blocks of
    a shard (tokens so far, place of the last end id so far) gives the part of the
    first document that lies in earlier blocks, however many. Tokens after a
    shard's last end id are a document without one. A file that isn't whole ids
    raises ValueError; an empty one has no document. bits is what write_flat gives.
    """
    kind = np.dtype(f"<u{bits // 8}")
    block_bytes = max(kind.itemsize, BLOCK_BYTES // kind.itemsize * kind.itemsize)

    @tidy
    def scan(batches):
        path = source = None
        for batch in batches:
            for name, block, shard, start, stop in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "shard", "from", "to"))):
                if name != path:
                    system, inside = open_folder(name)
                    path, source = name, system.open_input_file(inside)
                if (stop - start) % kind.itemsize:
                    raise ValueError(f"{name} doesn't hold whole ids of {bits} bits")
                source.seek(start)
                ids = np.frombuffer(source.read(stop - start), kind)
                ends = np.flatnonzero(ids == end_id) + 1
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], ["shard", "block", "n_tokens", "ends"])

    found = save(blocks_of(files, block_bytes).mapInArrow(scan, "shard int, block long, n_tokens long, ends array<long>"), "scan")
    order = Window.partitionBy("shard").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    known = found.withColumn("at", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).withColumn("last", F.when(F.size("ends") > 0, F.col("at") + F.element_at("ends", -1)))
    known = known.withColumns({"open": F.coalesce(F.max("last").over(before), F.lit(0)), "done": F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)), "final": F.lead("block").over(order).isNull()})
    stop = F.col("at") + F.col("n_tokens")
    ends = F.transform("ends", lambda e: e + F.col("at"))
    loose = F.col("final") & (F.coalesce("last", "open") < stop)
    cut = known.withColumn("ends", F.when(loose, F.concat(ends, F.array(stop))).otherwise(ends))
    starts = F.concat(F.array("open"), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))))
    each = cut.where(F.size("ends") > 0).select("shard", "done", F.posexplode(F.arrays_zip(starts.alias("s"), F.col("ends").alias("e"))).alias("i", "x"))
    return each.join(shard_starts(found), F.col("shard") == F.col("_shard")).select("shard", (F.col("done") + F.col("i")).alias("ordinal"), F.col("x.s").alias("at"), (F.col("shard_start") + F.col("x.s")).alias("start"), (F.col("x.e") - F.col("x.s")).alias("n_tokens"))


def with_names(found: DataFrame, names: DataFrame) -> DataFrame:
    """Add doc_id to documents of a scan, by shard and ordinal; NULL where names has none."""
    each = names.select(F.col("shard").alias("_s"), "first", F.posexplode("doc_ids").alias("_i", "doc_id")).select("_s", (F.col("first") + F.col("_i")).alias("_o"), "doc_id")
    return found.join(each, (F.col("shard") == F.col("_s")) & (F.col("ordinal") == F.col("_o")), "left").drop("_s", "_o")


def ordered_starts(found: DataFrame) -> DataFrame:
    """Named documents with start as it is when they follow one another by doc_id; null ids first, equal ids by n_tokens.

    Only this table of numbers is put in order. Each of its ranges gets running sums of its own, and the totals of the ranges before are added.
    """
    order = ["doc_id", "n_tokens", "shard", "ordinal"]
    ranged = save(found.drop("start").repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = shard_starts(ranged.select(F.col("range").alias("shard"), "n_tokens"))
    placed = ranged.withColumn("start", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return placed.join(before, F.col("range") == F.col("_shard")).withColumn("start", F.col("shard_start") + F.col("start")).drop("range", "_shard", "shard_start")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    """Id 50256 ends a document; it is taken for ordinary text inside one, so no text makes it.

    start: where a document begins when all follow one another by doc_id, the same however the input was split. shard, ordinal, at: where it stands in the flat files, which keep the input's order.
    """
    flat = write_flat(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path("byte_bpe_50k.json"), 50256)
    found = save(with_names(separator_scan(flat.files, 50256, flat.bits), flat.names), "boundaries")
    return ordered_starts(found).select("doc_id", "start", "n_tokens", "shard", "ordinal", "at")
