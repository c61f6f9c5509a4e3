"""A corpus from documents: quality and toxicity filters, near-duplicate removal, a mix of sources, packed sequences."""

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import mixing, packing, quality, shingles, toxicity
from tidewright.llm.encode import vocabulary_path
from tidewright.llm.store import run_and_release


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.admit(docs, _labels(spark, sf_dir))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.admit(docs, _labels(spark, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingles.distinct_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary_path("word_bpe_49k.json"), 1)


STAGES = [("quality", keep_quality), ("toxicity", drop_toxic), ("near copies", drop_near_copies), ("mixing", mix_sources), ("packing", pack_sequences)]

#: SQL can't express the trained models, so the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir; each one's rows are written and read again for the next. What a stage wrote on the way is deleted after it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = run_and_release(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline_{name.replace(' ', '_')}")
    return docs
