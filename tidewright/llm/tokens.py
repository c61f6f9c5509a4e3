"""Token files: documents as bit-packed ids in doc_id order, in blocks that can be unpacked alone."""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import tidy
from .encode import encoded, encoder, vocabulary_path
from .store import save

BLOCK_TOKENS = 1 << 16


def width(vocabulary: int) -> int:
    """Bits that the largest id of a vocabulary needs."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in bits bits each, most significant bit first (whole bytes: little-endian integers)."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    table = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(table[:, 32 - bits :]).tobytes()


def unpack(payload: bytes, bits: int, count: int, first: int = 0) -> np.ndarray:
    """count ids from position first on, as unsigned 32-bit integers. Only the bytes that hold them are read."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", count, first * bits // 8).astype(np.uint32)
    if not count:
        return np.zeros(0, np.uint32)
    begin, end = first * bits, (first + count) * bits
    flat = np.unpackbits(np.frombuffer(payload, np.uint8, (end + 7) // 8 - begin // 8, begin // 8))[begin % 8 :][: count * bits]
    table = np.zeros((count, 32), np.uint8)
    table[:, 32 - bits :] = flat.reshape(count, bits)
    return np.packbits(table, axis=1).view(">u4").ravel().astype(np.uint32)


def _in_order(docs: DataFrame) -> DataFrame:
    """Ascending by doc_id over the partitions and within each; null ids first, equal ids by a hash of the text and then by the text, so that rows of one id, or of none, spread over many tasks."""
    order = ["doc_id", "_hash", "text"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_hash", F.xxhash64("text"))
    return rows.repartitionByRange("doc_id", "_hash").sortWithinPartitions(*order).drop("_hash")


def _runs(batches, path: str, end_id: int, literal: bool) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    for batch in batches:
        names = batch.column(0).to_pylist()
        for first, end, ids, offsets in encoded(batch.column(1), path, end_id, literal):
            yield names[first:end], ids, offsets


BLOCK = "shard int, block long, doc_ids array<long>, lengths array<long>, first_token long, n_tokens long, bits int, payload binary"


def write_packed(docs: DataFrame, path: str, end_id: int, name: str = "tokens") -> DataFrame:
    """Encode (doc_id, text) and write the ids as bit-packed blocks in the shared folder; returns the table of blocks as read back.

    A block holds whole documents, of about BLOCK_TOKENS tokens together, and
    names them, their lengths and where it stands in its shard (first_token), so
    that a range of tokens is found by block and unpacked alone. Shards follow
    one another in doc_id order. A null text has only its end id; a long one makes
    a block larger than others; repeated rows are encoded each; other columns of
    docs are left out, whatever their names; an empty table gives no block.
    """
    bits = width(max(encoder(path).size, end_id + 1))

    @tidy
    def write(batches):
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        names, lengths, parts, held = [], [], [], 0

        def row():
            ids = np.concatenate(parts)
            columns = [[shard], [block], [names], [lengths], [first], [len(ids)], [bits], [pack(ids, bits)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["shard", "block", "doc_ids", "lengths", "first_token", "n_tokens", "bits", "payload"])

        for run_names, ids, offsets in _runs(batches, path, end_id, False):
            at = 0
            while at < len(run_names):
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_TOKENS - held, "right")) - 1)
                names += run_names[at:end]
                lengths += np.diff(offsets[at : end + 1]).tolist()
                parts.append(ids[offsets[at] : offsets[end]])
                held += len(parts[-1])
                at = end
                if held >= BLOCK_TOKENS * 3 // 4:
                    yield row()
                    block, first = block + 1, first + held
                    names, lengths, parts, held = [], [], [], 0
        if parts:
            yield row()

    return save(_in_order(docs).mapInArrow(write, BLOCK), name)


def shard_starts(blocks: DataFrame) -> DataFrame:
    """(shard, shard_start): the tokens of all shards before. One row for each file that was written, so one window takes them."""
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(F.col("shard").alias("_shard"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))


def read_documents(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the ids in the files."""

    @tidy
    def read(batches):
        for batch in batches:
            for b in batch.to_pylist():
                ids = unpack(b["payload"], b["bits"], b["n_tokens"]).astype("<u4").tobytes()
                ends = np.cumsum(b["lengths"])
                starts = ends - b["lengths"]
                crc = [zlib.crc32(ids[4 * a : 4 * e]) for a, e in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([b["shard"]] * len(crc), pa.int32()), pa.array(b["doc_ids"], pa.int64()), pa.array(starts + b["first_token"], pa.int64()), pa.array(b["lengths"], pa.int64()), pa.array(crc, pa.int64())], ["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    found = blocks.mapInArrow(read, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(shard_starts(blocks), F.col("shard") == F.col("_shard")).select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_range(blocks: DataFrame, shard: int, first: int, count: int) -> np.ndarray:
    """The ids at [first, first + count) of a shard. Only the blocks that hold them are read."""
    end = first + count
    rows = blocks.where((F.col("shard") == shard) & (F.col("first_token") < end) & (F.col("first_token") + F.col("n_tokens") > first)).orderBy("block").select("first_token", "n_tokens", "bits", "payload").collect()
    parts = [unpack(r.payload, r.bits, min(end, r.first_token + r.n_tokens) - max(first, r.first_token), max(first, r.first_token) - r.first_token) for r in rows]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def op1_token_ids(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_documents(write_packed(docs, vocabulary_path("byte_bpe_50k.json"), 0))
