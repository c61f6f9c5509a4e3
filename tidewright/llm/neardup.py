"""Embedding near-duplicates by randomised-rotation binary codes with correction factors."""

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import give_back, tidy
from .components import components
from .store import broadcast_if_small, save, shuffle_partitions

COSINE = 0.93
#: Standard errors of an estimate within which a pair is recomputed.
SURE = 5.0
#: Vectors that share a code when bands are as long as meant.
BUCKET = 64
#: Largest side of a block of pairs that a task holds at once.
BLOCK = 1024
#: Rows that one group of cells is meant to hold.
GROUP_ROWS = 8192
#: Chance that a linked pair right at the threshold shares no band.
MISS = 0.005
#: Bits of a band at most.
MOST_BITS = 32


@lru_cache(8)
def rotations(dim: int, count: int, seed: int = 7) -> np.ndarray:
    """count random orthonormal matrices of dim x dim."""
    out = []
    for i in range(count):
        q, r = np.linalg.qr(np.random.default_rng([seed, i]).standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.stack(out)


def band_bits(vectors: Column) -> Column:
    """Bits of a band for a label with so many vectors; they grow with its logarithm."""
    return F.when(vectors > 4 * BUCKET, F.greatest(F.lit(2), F.least(F.lit(MOST_BITS), F.round(F.log2(vectors / BUCKET))))).otherwise(1).cast("int")


def band_count(bits: int, cosine: float = COSINE, miss: float = MISS) -> int:
    """A bit of the code is equal with chance 1 - angle / pi; so many bands leave the chance miss that none is equal."""
    same = 1 - math.acos(cosine) / math.pi
    return max(1, math.ceil(math.log(miss) / math.log(1 - same**bits)))


def unit_vectors(embedding: np.ndarray) -> np.ndarray:
    """Vectors of length 1. They are scaled by their largest component first, so that no square over- or underflows."""
    scaled = embedding / np.abs(embedding).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def usable(column: str):
    """Not null or empty, all components there and finite, not all zero."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(column, lambda x: x != 0)


def _block_links(ids, labels, unit, codes, factors, rotated, keys, band, left, right, cosine):
    """Linked pairs of rows left x right of one label whose first common band is this one. The estimate decides which are recomputed."""
    dim = unit.shape[1]
    signs = np.where(codes[left], np.float32(1), np.float32(-1))
    estimate = signs @ rotated[right].T / np.float32(math.sqrt(dim)) / factors[left][:, None]
    error = np.sqrt(np.maximum(0, 1 - factors[left] ** 2)) / factors[left] / math.sqrt(max(1, dim - 1))
    i, j = np.nonzero(estimate + SURE * error[:, None] >= cosine)
    i, j = left[i], right[j]
    once = (ids[i] < ids[j]) & (labels[i] == labels[j])
    i, j = i[once], j[once]
    for b in range(band):
        new = keys[i, b] != keys[j, b]
        i, j = i[new], j[new]
    exact = np.einsum("ij,ij->i", unit[i], unit[j])
    return i[exact >= cosine], j[exact >= cosine]


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node of the links to the smallest that they reach: as many as nodes, not as links."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            return nodes[label], nodes
        label = new


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, embedding, label) to vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null and their cosine in
    double precision is at least cosine. Equal vectors are one node that counts
    its rows. Each vector is rotated at random; the signs are its code, stored as
    bits, and <rotated, code> its stored correction factor, which makes the code's
    inner product with another rotated vector an unbiased estimate of known error.
    Candidates share a band of the codes; those whose estimate may reach the
    threshold are recomputed, so no link lies below it, and a link at the threshold
    is found with chance 1 - MISS, a closer one with more. Bands of larger labels
    have more bits. A large bucket is cut into blocks, and tasks hold pairs of
    blocks. A pair counts in its first common band only. Vectors that are null, empty, zero or hold null or non-finite
    components, and those without a label, have no link and are kept. Vectors of
    different length never link. Rows of equal vec_id are vectors of their own.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"), F.col("label").cast("string").alias("label"))
    named = save(rows.select("vec_id", "label", F.when(usable("embedding") & F.col("label").isNotNull(), F.sha2(F.concat_ws("/", "label", F.to_json(F.struct("embedding"))), 256)).alias("class"), "embedding"), "vectors")
    found = named.where("class is not null").groupBy("class").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"), F.first("label").alias("label"))
    found = found.select("id", "copies", "embedding", F.xxhash64("label").alias("label"), F.xxhash64(F.lit("other"), "label").alias("label_check"), F.size("embedding").alias("dim"), F.xxhash64("class").alias("node"))
    found = save(found, "vector_classes")
    counts = save(found.groupBy(F.col("label").alias("_label"), F.col("dim").alias("_dim")).agg(band_bits(F.count("*")).alias("bits")), "label_bits")
    nodes = found.join(broadcast_if_small(counts), (F.col("label") == F.col("_label")) & (F.col("dim") == F.col("_dim"))).drop("_label", "_dim")

    def stacked(column):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)

    def keys_of(codes, bits):
        count = band_count(bits, cosine)
        return codes[:, : bits * count].reshape(len(codes), count, bits) @ (1 << np.arange(bits, dtype=np.int64))

    names = ["node", "copies", "label", "label_check", "dim", "bits", "embedding"]

    @tidy
    def deal(batches):
        for batch in batches:
            shape = batch.column("dim").to_numpy().astype(np.int64) << 8 | batch.column("bits").to_numpy()
            for each in np.unique(shape).tolist():
                dim, bits = each >> 8, each & 255
                own = batch.filter(pa.array(shape == each))
                unit = unit_vectors(stacked(own.column("embedding")))
                turned = np.einsum("rij,nj->nri", rotations(dim, -(-bits * band_count(bits, cosine) // dim)), unit).reshape(len(unit), -1)
                codes = turned >= 0
                factors = np.abs(turned[:, :dim]).sum(axis=1) / math.sqrt(dim)
                packed = pa.array([x.tobytes() for x in np.packbits(codes, axis=1)], pa.binary())
                keys = keys_of(codes, bits)
                n, count = keys.shape
                at = pa.array(np.repeat(np.arange(n), count))
                columns = [*[own.column(c) for c in names], packed, pa.array(factors)]
                yield pa.RecordBatch.from_arrays([*[c.take(at) for c in columns], pa.array(np.tile(np.arange(count, dtype=np.int32), n)), pa.array(keys.ravel())], [*names, "code", "factor", "band", "key"])

    schema = f"node long, copies long, label long, label_check long, dim int, bits int, embedding array<{kind}>, code binary, factor double, band int, key long"
    dealt = nodes.select(*names).mapInArrow(deal, schema)
    keyed = save(dealt.withColumn("bucket", F.xxhash64("label", "dim", "band", "key")).drop("key", "label"), "bands")
    large = save(keyed.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select(F.col("bucket").alias("_bucket"), "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "large_buckets")
    own = F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int")
    blocked = keyed.join(broadcast_if_small(large.drop("n")), F.col("bucket") == F.col("_bucket"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = blocked.withColumn("other", other)
    cell = F.struct(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    copied = keyed.count() + (large.agg(F.sum(F.col("n") * (F.col("blocks") - 1))).first()[0] or 0)
    groups = max(2 * shuffle_partitions(spark), copied // GROUP_ROWS + 1)
    paired = paired.withColumn("cell", F.xxhash64("bucket", cell)).withColumn("g", F.pmod(F.xxhash64("cell"), F.lit(groups)))

    def link(table: pa.Table) -> pa.Table:
        cells = table.column("cell").to_numpy()
        table = table.take(pa.array(np.argsort(cells, kind="stable")))
        cells = np.sort(cells)
        cuts = np.append(np.flatnonzero(np.diff(cells, prepend=cells[0] - 1 if len(cells) else 0)), len(cells))
        out_node, out_links, edge_a, edge_b = [], [], [], []
        for first, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            part = table.slice(first, end - first)
            if len(part) < 2:
                continue
            dim, band, bits = (part.column(c)[0].as_py() for c in ("dim", "band", "bits"))
            unit = unit_vectors(stacked(part.column("embedding")))
            codes = np.unpackbits(np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(part), -1), axis=1).astype(bool)
            keys, codes = keys_of(codes, bits), codes[:, :dim]
            node, copies, block, labels, factors = (part.column(c).combine_chunks().to_numpy() for c in ("node", "copies", "block", "label_check", "factor"))
            rotated, factors = (unit @ rotations(dim, 1)[0].T).astype(np.float32), factors.astype(np.float32)
            sides = np.unique(block)
            spans = [(np.flatnonzero(block == sides[0]), np.flatnonzero(block == sides[-1]))] + ([(np.flatnonzero(block == sides[1]), np.flatnonzero(block == sides[0]))] if len(sides) > 1 else [])
            found = [_block_links(node, labels, unit, codes, factors, rotated, keys, band, a, b, cosine) for a, b in spans]
            i, j = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            if not len(i):
                continue
            links = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
            hit = np.flatnonzero(links)
            a, b = _spanning(i, j)
            out_node.append(node[hit]), out_links.append(links[hit].astype(np.int64))
            edge_a.append(node[a]), edge_b.append(node[b])
        zero = [np.zeros(0, np.int64)]
        n, c, a, b = (np.concatenate(x or zero) for x in (out_node, out_links, edge_a, edge_b))
        pad = pa.nulls(len(a), pa.int64()), pa.nulls(len(n), pa.int64())
        give_back()
        return pa.table({"node": pa.concat_arrays([pa.array(n), pad[0]]), "links": pa.concat_arrays([pa.array(c), pad[0]]), "a": pa.concat_arrays([pad[1], pa.array(a)]), "b": pa.concat_arrays([pad[1], pa.array(b)])})

    needed = paired.select("g", "cell", "node", "copies", "label_check", "dim", "bits", "band", "block", "code", "factor", "embedding")
    linked = save(needed.groupBy("g").applyInArrow(link, "node long, links long, a long, b long"), "vector_links")
    counts = linked.where("node is not null").groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(linked.where("a is not null").select("a", "b"), "vector_components").select(F.col("node").alias("_node"), "label")
    known = found.select("node", "id", "copies").join(labels, F.col("node") == F.col("_node"), "left").withColumn("root", F.coalesce("label", "node")).join(counts, "node", "left")
    known = save(known.select("node", "id", "root", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector_nodes")
    smallest = known.groupBy("root").agg(F.min("id").alias("component_id"))
    known = save(known.join(smallest, "root").select("node", "n_links", "component_id"), "vector_named")
    out = named.select("vec_id", F.when(F.col("class").isNotNull(), F.xxhash64("class")).alias("_class")).join(known, F.col("_class") == F.col("node"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op10_embedding_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
