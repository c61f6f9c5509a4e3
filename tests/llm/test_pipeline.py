import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql.types import LongType, StringType, StructField, StructType

import corpus_pipeline
from tidewright.llm import mixing, packing, quality, shingles, toxicity
from tidewright.llm.encode import vocabulary_path
from tidewright.llm.labelled import held_out, sample
from tidewright.llm.store import save

from .test_shingles import brute

SF = "/root/testdata/sf0.01"


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_stages(spark):
    docs, _ = tables(spark)
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = docs
        docs = save(stage(spark, docs, SF), "test")
        assert docs.columns == columns
        kept[name] = (before, docs)
    ids = {k: ([r.doc_id for r in a.select("doc_id").collect()], [r.doc_id for r in b.select("doc_id").collect()]) for k, (a, b) in kept.items()}
    assert 0.7 * len(ids["quality"][0]) < len(ids["quality"][1]) < len(ids["quality"][0])
    assert 0.7 * len(ids["toxicity"][0]) < len(ids["toxicity"][1]) < len(ids["toxicity"][0])
    near = brute([(r.doc_id, r.text) for r in kept["near copies"][0].collect()])
    assert sorted(ids["near copies"][1]) == sorted(d for d, _, c in near if d == c)
    repeats = {r.doc_id: r.repeats for r in mixing.mix(kept["mixing"][0]).collect() if r.repeats}
    assert {d: ids["mixing"][1].count(d) for d in set(ids["mixing"][1])} == repeats
    packed = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(ids["mixing"][1])
    assert sum(r.piece == 0 for r in packed) == len(ids["mixing"][1])


def test_classifiers_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    for module, column, least in ((quality, "quality", 0.93), (toxicity, "toxic", 0.93)):
        got = module.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
        assert (got["predicted"] == got[column]).mean() >= least
        assert got["score"].between(0, 1).all()
        assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"])


def test_classifiers_odd_rows(spark):
    _, labels = tables(spark)
    rows = [(1, None, 0.1), (2, "", 0.2), (3, "you idiot " * 20000, 0.3), (None, "x", 0.4), (2, "", 0.2)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, score double")
    for module in (quality, toxicity):
        assert module.classify(odd, labels).count() == 5
        assert module.classify(odd.limit(0), labels.limit(0)).count() == 0
        assert module.admit(odd, labels).columns == odd.columns
    texts, y = sample(odd, labels.withColumn("doc_id", labels.doc_id + 0), "toxic", 10)
    assert len(texts) == len(y)


def test_isotonic_and_trees():
    at, value = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0, 1, 0, 1]))
    assert value.tolist() == [0, 0, 0.5, 0.5, 1, 1] and (np.diff(at) >= 0).all()
    rng = np.random.default_rng(0)
    x = rng.random((500, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(np.int64)
    assert ((toxicity.Boosted(x, y)(x) > 0) == y).mean() > 0.95


def test_features():
    f = toxicity.Features(pa.array([]), np.zeros(0, np.int64))
    a, b, c = f(pa.array(["You are an IDIOT!! really", "a fine day", "such an id1ot"]))
    assert a[0] > 0 and a[5] > 0 and a[7] > 0 and a[10] > 0 and b[0] == 0 and c[13] == 1


def test_distinct_documents(spark):
    rows = [(1, "a b c d e f g", 1), (1, "a b c d e f g", 1), (2, "A b c d e f g", 2), (3, None, 3), (4, "", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    assert sorted(r.doc_id for r in shingles.distinct_documents(docs).collect()) == [1, 3, 4]
    assert docs.where(held_out()).count() == sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in (1, 1, 2, 3, 4))


def test_rows_that_share_or_lack_ids(spark):
    a, b, c, d, e = ("a b c d e f g", "h i j k l m n", "o p q r s t u", "v w x y z a b", "c d e f g h i")
    rows = [(1, a), (None, a), (None, b), (2, c), (2, a), (2, d), (2, c), (None, e), (None, e.upper()), (None, e), (3, None), (3, None)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    got = sorted(((r.doc_id, (r.text or "").lower()) for r in shingles.distinct_documents(docs).collect()), key=repr)
    assert got == sorted([(1, a), (None, b), (2, c), (2, d), (None, e), (3, ""), (3, "")], key=repr)


def test_mixed_rows_that_share_ids(spark):
    rows = [(None if i % 2 else 7, f"{i // 3} " + "w " * (i // 3 % 7), "abc"[i % 3 if i % 10 else 0]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs).collect()
    mixed = mixing.mixed_documents(docs).collect()
    for s in "abc":
        of = [r for r in found if r.source == s]
        taken = sum(len(r.text.split()) for r in mixed if r.source == s)
        assert abs(taken - of[0].target) <= max(r.size for r in of) / 2


HELPERS = ["box", "_key", "_doc", "_hash", "_id", "_times", "_source", "_all", "_rows", "_copy", "_v", "_h", "_b", "key", "n", "size", "set_id", "component_id", "repeats", "before", "a.b", "a`b"]


def test_columns_with_helper_names(spark):
    """Users' columns that have the names of helper columns come out as they went in."""
    rows = [(i % 20 if i % 3 else None, f"{i % 15} " + "some words of a text here " * (i % 15), "ab"[i % 2], *[f"{i} {h}" for h in HELPERS]) for i in range(60)]
    names = ["doc_id", "text", "source", *HELPERS]
    docs = spark.createDataFrame(rows, StructType([StructField("doc_id", LongType())] + [StructField(c, StringType()) for c in names[1:]]))
    for make in (shingles.distinct_documents, mixing.mixed_documents):
        one, two = ([tuple(r) for r in make(docs.repartition(n)).collect()] for n in (1, 5))
        assert sorted(one, key=repr) == sorted(two, key=repr)
        assert make(docs).columns == names and set(one) <= set(rows) and one


def test_packing_doesnt_depend_on_partitions(spark):
    docs = spark.createDataFrame([(7 if i % 2 else None, f"text {i} " * (1 + i % 3)) for i in range(120)], "doc_id long, text string")
    path = vocabulary_path("word_bpe_49k.json")
    one, two = (sorted((tuple(r) for r in packing.pack_documents(docs.repartition(n), path, 1).collect()), key=repr) for n in (1, 7))
    assert one == two
