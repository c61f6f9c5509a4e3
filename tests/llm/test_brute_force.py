"""What SQL can't express, against plain Python; ties and hot keys, large sums, sessions left as they were."""

import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewright.llm import mixing, packing, quality, running, shingles, store, toxicity
from tidewright.llm.labelled import sample

TEXTS = ["You are an IDIOT!! really", "a fine day, Été  là\nplus", None, "", "such an id1ot you", "x" * 70_000 + " end", "AB cd EF", "word " * 300]


def test_mix_agrees_however_rows_are_dealt(spark):
    rng = np.random.default_rng(1)
    rows = [(None if i % 3 else 5, " ".join("w" * rng.integers(1, 40)), "ab"[i % 2]) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kinds = [sorted(map(tuple, mixing.mix(d).select(F.coalesce("doc_id", F.lit(-1)), "size", "source", "taken").collect())) for d in (docs.repartition(3, "text"), docs.orderBy(F.length("text")).coalesce(1))]
    assert kinds[0] == kinds[1]


def test_running_sums_by_levels(spark, monkeypatch):
    monkeypatch.setattr(running, "BUCKET_ROWS", 1)
    monkeypatch.setattr(running, "LEVEL_DIGITS", 1)
    rows = [(i, "ab"[i % 2] if i % 5 else None, i % 7) for i in range(300)]
    df = store.save(spark.createDataFrame(rows, "id long, g string, v long"), "sums")
    for prefix in (None, F.when(F.col("id") < 100, "0").otherwise("1")):
        got = running.running_sum(df, F.col("v"), ["g"], [F.col("id")], prefix=prefix).withColumn("h", F.concat(F.lit("") if prefix is None else prefix, F.md5(F.col("id").cast("string")))).collect()
        for g in ("a", "b", None):
            total = 0
            for r in sorted((r for r in got if r.g == g), key=lambda r: r.h):
                assert r.before == total
                total += r.v


def test_links_without_broadcasts(spark, monkeypatch):
    from .test_shingles import SCHEMA, brute, made

    monkeypatch.setattr(store, "BROADCAST_BYTES", -1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = made(6, 150)
    assert sorted(map(tuple, shingles.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    with pytest.raises(TypeError):
        store.broadcast_if_small(spark.createDataFrame([("x",)], "a string"))


def test_near_copies_of_a_very_long_text_without_ids(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in rng.integers(0, 5000, 60_000)]
    other = list(words)
    other[30_000] = "changed"
    rows = [(None, " ".join(words)), (None, " ".join(other)), (None, "short and unlike any of these others here"), (7, " ".join(words).upper())]
    got = shingles.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in got if r.n_shingles > 100) == [(False, 7), (True, 7), (True, 7)]


def test_a_sample_has_one_text_for_each_id_within_its_bytes(spark):
    docs = spark.createDataFrame([(i % 20, f"{i} " + "x" * 100) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 20, i % 2) for i in range(40)], "doc_id long, quality int")
    texts, y = sample(docs, labels, "quality", 50)
    few, _ = sample(docs, labels, "quality", 50, most_bytes=350)
    assert len(texts) == len(y) == len(set(texts.to_pylist())) and 0 < len(few) == 3 < len(texts)


def grams(text):
    low = re.sub("[ \t\n\x0b\x0c\r]", " ", text or "")
    return [low[i : i + quality.NGRAM] for i in range(len(low) - quality.NGRAM + 1)]


def words_of(text):
    return [w for w in re.split("[ \t\n\x0b\x0c\r]+", text or "") if w]


def test_quality_features_and_scores_by_plain_python():
    model = quality.Model(pa.array(["good text here and there"] * 30 + ["bad @@ junk ## @@"] * 30), np.array([1] * 30 + [0] * 30))
    bucket = lambda s: int(toxicity.word_hash(s) % np.uint64(quality.BUCKETS))

    def plain(text):
        w = words_of(text)
        hashes = [np.uint64(toxicity.word_hash(x)) for x in w]
        with np.errstate(over="ignore"):
            pairs = [int(quality.mix(np.array([a * np.uint64(0x9E3779B97F4A7C15) + b]))[0] % np.uint64(quality.BUCKETS)) for a, b in zip(hashes, hashes[1:])]
        ids = [bucket(x) for x in w] + pairs + [bucket(g) for g in grams(text)]
        return 1 / (1 + np.exp(-(float(np.sum([float(model.weight[i]) for i in ids])) / max(1, len(ids)) + model.bias)))

    got = model.score(pa.array(TEXTS, pa.string()))
    assert got == pytest.approx([plain(t) for t in TEXTS], abs=1e-6)
    assert (model.score(pa.array(["good text here", "junk ## @@"])) > 0.5).tolist() == [True, False]


def test_toxicity_features_by_plain_python():
    f = toxicity.Features(pa.array([]), np.zeros(0, np.int64))
    got = f(pa.array(TEXTS, pa.string()))
    for t, x in zip(TEXTS, got):
        t = t or ""
        low = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[A-Za-z\u0080-\U0010ffff]+", t)]
        n, size = len(low), max(1, len(t.encode()))
        given = [w in toxicity.INSULTS for w in low]
        second = [w in toxicity.SECOND_PERSON for w in low]
        close = [g and any(second[max(0, i - toxicity.NEAR) : i + toxicity.NEAR + 1]) for i, g in enumerate(given)]
        assert x[0] == pytest.approx(sum(given) / max(1, n)) and x[3] == sum(given) and x[5] == pytest.approx(sum(close) / max(1, n)) and x[6] == pytest.approx(sum(second) / max(1, n))
        assert x[7] == pytest.approx(len(re.findall("[A-Z]", t)) / size) and x[9] == pytest.approx(len(re.findall(r"[!-/:-@\[-`{-~]", t)) / size) and x[14] == pytest.approx(np.log1p(n))
        assert x[10] == pytest.approx(len(re.findall("(?<=!)!", t)) / size)


def test_trees_by_plain_python():
    rng = np.random.default_rng(4)
    x = rng.random((300, 4))
    trees = toxicity.Boosted(x, (x[:, 0] + x[:, 2] > 1).astype(np.int64))
    for row, got in zip(x[:20], trees(x[:20])):
        total = trees.base
        for feature, cut, value in trees.trees:
            node = 0
            for level in range(toxicity.DEPTH):
                k = 2**level - 1 + node
                f = feature[k]
                node = 2 * node + int(np.searchsorted(trees.edges[f], row[f], "left") > cut[k])
            total += value[node]
        assert got == pytest.approx(total)


@pytest.mark.parametrize("seed", range(8))
def test_fullest_by_all_subsets(seed):
    rng = np.random.default_rng(seed)
    items = sorted(rng.integers(1, 40, 9).tolist(), reverse=True)
    counts = {k: items.count(k) for k in items}
    best = max(s for n in range(9) for c in itertools.combinations(items[1:], n) if (s := items[0] + sum(c)) <= 60)
    chosen = packing.fullest(counts, 60)
    assert sum(k * n for k, n in chosen.items()) == best and all(n <= counts[k] for k, n in chosen.items()) and chosen[items[0]] >= 1


def test_pieces_meet_in_gapless_sequences_for_null_and_repeated_ids(spark):
    from tidewright.llm.encode import vocabulary_path

    rows = [(None, "a b c " * 10), (None, ""), (4, "x " * 500), (4, "x " * 500), (5, None)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary_path("word_bpe_49k.json"), 1, 128).collect()
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == list(itertools.accumulate([n for _, n in sorted(b)], initial=0))[:-1] and sum(n for _, n in b) <= 128
    assert sum(r.piece == 0 for r in got) == 5


def test_run_releases_what_it_wrote_on_the_way(spark):
    def make():
        return store.save(store.save(spark.range(5), "one").where("id > 1"), "two").where("id > 2")

    before = store.made(spark)
    out = store.run_and_release(make, "result")
    assert out.count() == 2 and len(store.made(spark) - before) == 1
