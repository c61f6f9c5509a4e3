import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import neardup, topk

SCHEMA = "vec_id long, embedding array<float>, label int, score long"


def made(n=900, dim=16, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((30, dim))
    rows = []
    for i in range(n):
        v = base[rng.integers(30)] + rng.choice([0, 0.1, 0.25, 0.5]) * rng.standard_normal(dim)
        rows.append((i, v.astype(np.float32).tolist(), None if i % 97 == 0 else int(rng.integers(2)), 1))
    odd = [None, [], [0.0] * dim, [None] + [1.0] * (dim - 1), [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1), rows[1][1], rows[1][1], [1.0, 2.0]]
    rows += [(n + i, v, rows[1][2], 2) for i, v in enumerate(odd)]
    return rows + [(1, rows[1][1], rows[1][2], 3)]


def fine(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def test_near_duplicates(spark):
    rows = made()
    got = {}
    for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    good = [i for i, r in enumerate(rows) if fine(r[1]) and any(r[1]) and r[2] is not None]
    unit = {i: np.array(rows[i][1], np.float64) / np.linalg.norm(np.array(rows[i][1], np.float64)) for i in good}
    for x, i in enumerate(good):
        for j in good[:x]:
            if rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    want = {}
    for i, r in enumerate(rows):
        want.setdefault(r[0], []).append((links[i], least[find(i)], r[0] == least[find(i)]))
    found, there = sum(x[0] for v in got.values() for x in v), sum(links)
    assert 0.95 * there <= found <= there and there > 1000
    same = sum(sorted(got[k])[0][1] == sorted(v)[0][1] for k, v in want.items())
    assert set(got) == set(want) and same >= 0.95 * len(want)
    assert all(got[900 + i][0][0] == 0 for i in range(6)) and len(got[1]) == 2


def test_large_bucket_is_exact(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 50)
    rng = np.random.default_rng(2)
    base = rng.standard_normal(16)
    v = (base + 0.05 * rng.standard_normal((300, 16))).astype(np.float32)
    rows = [(i, v[i].tolist(), 1, 1) for i in range(300)]
    got = {r.vec_id: r for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(r.n_links >= 290 and r.component_id == 0 for r in got.values())


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "PAGE_NUMBERS", 256 * 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    monkeypatch.setattr(topk, "LEAF", 20)
    rows = made()
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, k=5).collect()
    whole = [(r[0], np.floor(1024 * np.array(r[1], np.float64)).astype(np.int64)) for r in rows if fine(r[1])]
    want = []
    for q, v in whole:
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for i, w in whole if i != q and len(w) == len(v))[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_points_make_a_tree():
    tree = topk.build(np.arange(900), np.ones((900, 4), np.int64), 4.0)
    found = topk.search(tree, 4.0, np.array([3]), np.ones((1, 4), np.int64), [None], 3)
    assert sorted(found[1].tolist()) == [0, 1, 2]


def test_far_pages_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(topk, "PAGE_NUMBERS", 256 * 8)
    rng = np.random.default_rng(4)
    centres = 50 * rng.standard_normal((12, 8))
    v = centres[rng.integers(12, size=3000)] + 0.01 * rng.standard_normal((3000, 8))
    routes, plain = [], topk.save
    monkeypatch.setattr(topk, "save", lambda df, name: routes.append((name, plain(df, name))) or routes[-1][1])
    got = topk.top_k(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), F.col("vec_id") < 40).collect()
    whole = np.floor(1024 * v).astype(np.int64)
    want = [(q, n + 1, i, -s) for q in range(40) for n, (s, i) in enumerate(sorted((-int(whole[q] @ w), i) for i, w in enumerate(whole) if i != q)[:10])]
    assert sorted(map(tuple, got)) == sorted(want)
    tables = dict(routes)
    pages = tables["topk_trees"].count()
    assert pages >= 12 and tables["topk_rest_queries"].count() < 0.5 * 40 * pages


def test_huge_components_raise_and_large_ones_are_exact(spark):
    table = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        topk.top_k(table([(1, [1e10, 1e10]), (2, [1.0, 1.0])]), F.lit(True)).collect()
    big = [(i, [1e6 + i, 3.0 * i + 0.001]) for i in range(30)]
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in big}
    got = topk.top_k(table(big), F.lit(True), k=4).collect()
    for q in whole:
        best = sorted((-sum(a * b for a, b in zip(whole[q], w)), i) for i, w in whole.items() if i != q)[:4]
        assert sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]


def test_query_rows_of_one_id_ask_for_themselves(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 1, k=1).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(1, 1, 2), (1, 1, 3)]


def brute_links(vectors, labels, cosine=0.93):
    unit = np.array(vectors, np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = (unit @ unit.T >= cosine) & (np.array(labels)[:, None] == np.array(labels))
    np.fill_diagonal(linked, False)
    return linked.sum(axis=1)


def test_recall_near_the_threshold(spark):
    """Pairs with cosines of 0.930 to 0.945 in two labels of unlike size: at least 0.99 of their links are found, and none besides."""
    rng = np.random.default_rng(8)
    n, dim = 6000, 64
    x, y = rng.standard_normal((2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    c = rng.uniform(0.9305, 0.945, (n, 1))
    v = np.concatenate([x, c * x + np.sqrt(1 - c**2) * y]).astype(np.float32)
    labels = ["big" if i % n % 10 else "small" for i in range(2 * n)]
    rows = [(i, v[i].tolist(), labels[i]) for i in range(2 * n)]
    got = {r.vec_id: r.n_links for r in neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")).collect()}
    want = brute_links(v, labels)
    assert all(got[i] <= want[i] for i in range(2 * n))
    assert sum(got.values()) >= 0.99 * want.sum() and want.sum() >= 2 * n


def test_huge_and_tiny_vectors_link(spark):
    rows = [(1, [1e200, 2e200], "a"), (2, [1e-200, 2e-200], "a"), (3, [1.0, 2.0], "a"), (4, [1.0, 2.0], "b"), (5, [2.0, -1.0], "a"), (6, [1.0, 2.0], None)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 4: (0, 4, True), 5: (0, 5, True), 6: (0, 6, True)}
