"""Best-fit packing by minimum bin slack."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import tidy
from .encode import encoded, vocabulary_path
from .running import running_sum
from .store import save

CAPACITY = 4096


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The fullest combination of available lengths that has the longest one, as {length: number}.

    Bit n of an integer tells whether n is a sum of the lengths so far; a shift
    and an OR add a length. Longer lengths come first and the search ends at a
    full bin, so short ones stay for later bins.
    """
    longest = max(counts)
    room = capacity - longest
    mask, sums, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        most = min(counts[length] - (length == longest), room // length)
        if most <= 0:
            continue
        steps.append((length, most, sums))
        left, by = most, 1
        while left:
            by = min(by, left)
            sums |= sums << (by * length) & mask
            left, by = left - by, by * 2
        if sums >> room & 1:
            break
    total, chosen = sums.bit_length() - 1, {longest: 1}
    for length, most, before in reversed(steps):
        number = next(k for k in range(most + 1) if k * length <= total and before >> (total - k * length) & 1)
        if number:
            chosen[length] = chosen.get(length, 0) + number
            total -= number * length
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Bins for the given numbers of each length: (how many bins, {length: number in each}).

    The fullest combination stays the fullest as long as its lengths last, so it
    is used that many times at once. Work and result grow with the number of
    distinct lengths (at most capacity), not with the number of items.
    """
    counts, bins = {k: v for k, v in counts.items() if v}, []
    while counts:
        chosen = fullest(counts, capacity)
        times = min(counts[k] // n for k, n in chosen.items())
        bins.append((times, chosen))
        for k, n in chosen.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
    return bins


def places(bins: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """By length, rows (first rank, first bin, number in each bin, offset in the bin): where the items of a length, ranked from 0, go."""
    out, rank, first = {}, {}, 0
    for times, chosen in bins:
        offset = 0
        for length, n in chosen.items():
            out.setdefault(length, []).append((rank.get(length, 0), first, n, offset))
            rank[length] = rank.get(length, 0) + n * times
            offset += n * length
        first += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def assign(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a saved table with a column length of 1 to capacity; order names the columns of a seeded order among equal lengths."""
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    where = places(plan(counts, capacity))
    ranked = running_sum(pieces, F.lit(1), ["length"], [F.col(c) for c in order], "rank")
    schema = ranked.schema

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(schema.names.index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            bins, offsets = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            by = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[by], prepend=-1))
            for rows in np.split(by, cuts[1:]) if len(by) else []:
                n = int(length[rows[0]])
                table = where[n]
                at = table[np.searchsorted(table[:, 0], rank[rows], "right") - 1]
                within = rank[rows] - at[:, 0]
                bins[rows] = at[:, 1] + within // at[:, 2]
                offsets[rows] = at[:, 3] + within % at[:, 2] * n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bins), pa.array(offsets)], [*batch.schema.names, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long").drop("rank")


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Encode (doc_id, text), end each document with end_id and cut only what is longer than capacity: doc_id, piece, start, length, ids_crc32 (and ids, little-endian unsigned 32-bit, if asked for)."""

    @tidy
    def cut(batches):
        for batch in batches:
            names = batch.column(0)
            for first, end, ids, offsets in encoded(batch.column(1), path, end_id):
                sizes = np.diff(offsets)
                parts = (sizes + capacity - 1) // capacity
                doc = np.repeat(np.arange(end - first), parts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * capacity
                length = np.minimum(capacity, sizes[doc] - start)
                raw, at = ids.astype("<u4").tobytes(), offsets[:-1][doc] + start
                spans = [raw[4 * a : 4 * b] for a, b in zip(at.tolist(), (at + length).tolist())]
                columns = [names.slice(first, end - first).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(s) for s in spans], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(spans, pa.binary())] * with_ids, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack_documents(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pack documents into few sequences of at most capacity tokens: a row for each piece, with sequence_id and offset.

    For each bin in turn the fullest combination of the lengths that are left is
    found by subset sums over a bitset, and taken. That happens on the histogram
    of lengths (capacity rows at most); items then get their rank among equal
    lengths, and with it a place. A null or empty text is a piece of one token,
    equal rows are packed each, and an empty table gives no row. Equal lengths
    go in a seeded order of doc_id, piece and ids, so runs agree even where ids of
    documents are missing or repeated.
    """
    return assign(save(pieces(docs, path, end_id, capacity, with_ids), "pieces"), ["doc_id", "piece", "ids_crc32"], capacity)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path("word_bpe_49k.json"), 1)
