"""Labelled documents to learn from, and the fold that is held out."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import give_back, tidy
from .store import save

#: Bytes of sampled texts that go to the driver at most.
SAMPLE_BYTES = 64 << 20


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 on division by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, column: str, rows: int, most_bytes: int = SAMPLE_BYTES) -> tuple[pa.Array, np.ndarray]:
    """Texts and labels (0 or 1) of at most rows labelled documents outside the held-out fold, in a seeded order by doc_id.

    rows and most_bytes bound what comes to the driver: documents are taken in the
    seeded order until their texts would pass most_bytes together. Of a document
    with several labels the largest counts; of several documents with one id the
    text that is least in order. Labels without a document and documents without
    a label are left out.
    """
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(column).cast("int").alias("y"))
    chosen = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows)
    wanted = chosen.select(F.col("doc_id").alias("_doc"), "y")
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(wanted), F.col("doc_id") == F.col("_doc"))  # rows rows at most
    found = save(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")), f"sample_{column}")
    sizes = found.select("doc_id", F.octet_length("text").alias("n"), F.md5(F.col("doc_id").cast("string")).alias("at")).toPandas().sort_values(["at", "doc_id"])
    fits = sizes["n"].cumsum() <= most_bytes
    if not fits.all():
        found = found.where(F.col("doc_id").isin(sizes["doc_id"][fits].tolist()))
    table = found.select("doc_id", "text", "y").toArrow().to_pandas().sort_values("doc_id")
    order = np.random.default_rng(11).permutation(len(table))
    table = table.iloc[order]
    out = pa.array(table["text"], pa.string()), table["y"].to_numpy(np.int64)
    del table, sizes
    give_back()
    return out


def scored(docs: DataFrame, score, threshold: float, keep: list[str] | None = None) -> DataFrame:
    """Add held_out, score and predicted to the columns keep of docs (doc_id if none are named). score takes an array of texts."""
    keep = keep or ["doc_id"]
    names = [*keep, "text"] if "text" not in keep else list(keep)

    @tidy
    def run(batches):
        for batch in batches:
            got = pa.array(score(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], got], [*keep, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    out = docs.select(*names).mapInArrow(run, f"{schema}, score double")
    return out.withColumns({"held_out": held_out(), "predicted": (F.col("score") >= threshold).cast("int")})


def accepted(docs: DataFrame, score, keep) -> DataFrame:
    """The rows of docs, with their own columns, where keep(score of the text) is true."""
    at = docs.columns.index("text")

    @tidy
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(keep(score(batch.column(at)))))

    return docs.mapInArrow(run, docs.schema)
