from itertools import permutations

import duckdb
import pytest

from tidewright.llm import audit

LONG = " ".join(f"w{i}" for i in range(250))
ROWS = [
    (1, LONG, "a", 0), (2, LONG, "a", 0), (3, LONG, "b", 0), (3, LONG, "b", 0), (0, LONG + " #", "b", 0), (None, LONG, "a", 0), (None, LONG, None, 0),
    (4, None, "a", 0), (5, "", "a", 0), (6, " \t\n", "c", 0), (7, "the " * 300, "c", 0), (8, "THE END " * 300, None, 0), (9, "É\x1c " * 200, "c", 0),
    (10, LONG.upper(), "c", 0), (10, LONG.upper(), "d", 0), (10, "another $ text", "d", 0), (11, LONG.upper(), "d", 0), (12, "x | y " * 100_000, "d", 0), (13, LONG + " " + LONG + " w", "d", 0),
]
SCHEMA = "doc_id long, text string, source string, mask int"
LABELS = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 1, None), (7, None, 1), (7, 0, 0), (10, 1, 0), (10, 0, 1), (None, 1, 1), (99, 1, 1)]


def by_hand(rows, labels):
    part = lambda r: r[2] or ""
    text = lambda r: r[1] or ""

    def fails(r):
        t, w = text(r), text(r).encode().split()
        copy = r[0] is not None and any(x[0] is not None and x[0] < r[0] and text(x) == t for x in rows)
        return {c for c, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in t for c in "#$%&*|"), copy)) if bad}

    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    failed = [fails(r) for r in rows]
    out = []
    for p in {part(r) for r in rows}:
        mine = [(r[0], f) for r, f in zip(rows, failed) if part(r) == p]
        shapley = dict.fromkeys("ABCDE", 0)
        lines = []
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, c in enumerate(order, 1):
                gone = [x for x in left if c in x[1]]
                redundant = sum(c in f and bool(f & set(order[: step - 1])) for _, f in mine)
                left = [x for x in left if c not in x[1]]
                shapley[c] += len(gone)
                lines.append((p, order, step, len(left), len(gone), redundant, sum(f == {c} for _, f in mine), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), c))
        out += [(*x[:-1], shapley[x[-1]]) for x in lines]
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def result(spark, rows, parts=1, labels=LABELS):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return sorted(tuple(r) for r in audit.filter_audit(docs, known).select(COLUMNS).collect())


@pytest.mark.parametrize("parts", [1, 6])
def test_against_brute_force(spark, parts):
    assert result(spark, ROWS, parts) == by_hand(ROWS, LABELS)


def test_shared_fingerprints_and_full_chains(spark, monkeypatch):
    class One:
        xxh3_64_intdigest = staticmethod(lambda text: len(text) % 2)

    chains = audit.Chains()
    monkeypatch.setattr(audit, "xxhash", One)
    for text, doc_id in ((b"aa", 3), (b"bb", 2), (b"cc", 1)):
        assert list(chains.add(One.xxh3_64_intdigest(text), text, doc_id, {"p": 1})) == []
    assert [len(c) for c in chains.by_print.values()] == [3]
    assert [(d, p, m & audit.COPY, n) for d, p, m, n in chains.add(0, b"bb", 1, {"q": 2})] == [(2, "p", audit.COPY, 1)]
    assert list(chains.add(0, b"bb", 1, {"p": 1})) == []
    assert sorted((x.text, x.doc_id, x.rows) for _, x in chains.links()) == [(b"aa", 3, {"p": 1}), (b"bb", 1, {"q": 2, "p": 1}), (b"cc", 1, {"p": 1})]
    monkeypatch.undo()
    monkeypatch.setattr(audit, "CHAIN_BYTES", 1)
    assert result(spark, ROWS) == by_hand(ROWS, LABELS)


def test_empty_tables(spark):
    assert result(spark, []) == []
    assert result(spark, ROWS, labels=[]) == by_hand(ROWS, [])


def test_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    want = sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({audit.OP12_SQL})").fetchall())
    got = sorted(tuple(r) for r in audit.op12_filter_audit(spark, "/root/testdata/sf0.001").select(COLUMNS).collect())
    assert got == want and len(got) % 600 == 0 and got
