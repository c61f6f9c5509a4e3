import random
import re

import numpy as np
import pytest

from tidewright.llm import shingles
from tidewright.llm.components import components
from tidewright.llm.shingles import jaccard_components

SCHEMA = "doc_id long, text string, set_id long, label long"


def brute(rows, size=5, percent=80):
    sets = []
    for r in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")
        w = [x for x in re.split("[ \t\n\x0b\x0c\r]+", low) if x]
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], len(sets[i]), least[find(i)]) for i, r in enumerate(rows))


def made(seed, n=260):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=46))
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.5:
            words = (rng.choice(rows[: 1 + len(rows) // 4])[1] or "").split()
            for _ in range(rng.randint(0, max(1, len(words) // 30))):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words)
        elif kind < 0.7:
            text = passage + "\n" + " ".join(rng.choices(vocabulary, k=rng.randint(0, 20)))
        elif kind < 0.75:
            text = rng.choice([None, "", " \n", "A b", "a  B", "one two three four", "one two three four five"])
        else:
            text = " ".join(rng.choices(vocabulary, k=rng.randint(1, 120)))
        rows.append((i, text, 1, 2))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = made(seed)
    got = jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_small_documents_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = jaccard_components(docs).collect()
    assert sorted(map(tuple, got)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(path, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


@pytest.mark.parametrize("share", [1, 3])
def test_shared_and_missing_ids(spark, share):
    """Rows that share a doc_id, or have none, are linked as if each had its own."""
    rows = made(3, 120)
    given = [(None if i % 5 == 0 else i // share,) + r[1:] for i, r in enumerate(rows)]
    want, ids = {}, [r[0] for r in given]
    for (i, n, c) in brute(rows):
        want.setdefault(c, []).append((i, n))
    out = []
    for members in want.values():
        known = [ids[i] for i, _ in members if ids[i] is not None]
        out += [(ids[i], n, min(known) if known and n else ids[i]) for i, n in members]
    got = jaccard_components(spark.createDataFrame(given, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(out, key=repr)


def test_few_frequent_tokens(spark, monkeypatch):
    monkeypatch.setattr(shingles, "FREQUENT_TOKENS", 5)
    docs = spark.createDataFrame([(1, 10 * i, i) for i in range(1, 41)], "n long, docs long, token long")
    tokens, _ = shingles._frequent(docs, 400)
    assert len(tokens) <= 5 and tokens.tolist() == list(range(41 - len(tokens), 41))
    rows = made(4, 120)
    assert sorted(map(tuple, jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)


def test_group_below_threshold(spark, monkeypatch):
    """Documents that all share much of one text, too little to link, meet in few rows and not once for each pair and token."""
    rng = random.Random(5)
    text, rows, met = [f"w{rng.randrange(10**6)}" for _ in range(300)], [], []
    for i in range(40):
        words = text.copy()
        for at in rng.sample(range(0, 300, 6), 10):
            words[at] = f"x{i}"
        rows.append((i, " ".join(words), 1, 2))
    rows += [(100 + i, rows[i][1] + " and more", 1, 2) for i in range(5)]
    made_by = shingles.matches

    def counted(*given):
        out = made_by(*given)
        met.append(out.count())
        return out

    monkeypatch.setattr(shingles, "FREQUENT_TOKENS", 0)  # as in a large table, where a group of 40 isn't frequent
    monkeypatch.setattr(shingles, "matches", counted)
    assert sorted(map(tuple, jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)
    assert sum(met) < 10 * len(rows)


@pytest.mark.parametrize("seed", [6, 7])
def test_all_lists_long(spark, monkeypatch, seed):
    monkeypatch.setattr(shingles, "LONG", 2)
    rows = made(seed)
    assert sorted(map(tuple, jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)


def test_sketches_never_differ_more_than_sets(spark):
    rng = np.random.default_rng(8)
    sets, pairs = [], []
    for n in (1, 3, 31, 32, 33, 63, 64, 65, 200, 1000, 1030, 2000, 2100, 5000):
        one = rng.choice(1 << 48, n, replace=False)
        for share in (1.0, 0.9, 0.5):
            kept = one[: int(n * share)]
            other = np.concatenate([kept, rng.choice(1 << 48, max(1, n // 8), replace=False)])
            sets += [np.sort(one), np.sort(other)]
            pairs.append(len(np.setxor1d(one, other)))
    words, starts = shingles.sketches(np.concatenate(sets).astype(np.uint64), np.cumsum([0, *map(len, sets)]))
    each = [words[a:b].tolist() for a, b in zip(starts, starts[1:])]
    assert max(map(len, each)) == shingles.SKETCH_WORDS and len({(len(a), len(b)) for a, b in zip(each[::2], each[1::2]) if len(a) != len(b)}) > 1
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(each[::2], each[1::2])) if max(len(a), len(b)) <= 2 * min(len(a), len(b))]
    found = spark.createDataFrame(rows, "i long, a array<long>, b array<long>").select("i", shingles.differences("a", "b"), shingles.differences("b", "a"), shingles.differences("a", "a")).collect()
    assert len(found) > 30
    for i, there, back, same in found:
        assert pairs[i] >= there == back and same == 0 and (pairs[i] < 20 or there > pairs[i] // 3)
