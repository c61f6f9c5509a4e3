import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidewright.llm import spelling


def near_by_hand(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [x for x in n if x != w and abs(len(x) - len(w)) < 2 and near_by_hand(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def result(spark, rows, parts=2):
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, word int").repartition(parts)
    return sorted(tuple(r) for r in spelling.spelling_variants(docs).select(COLUMNS).collect())


def variants(rng, count, length, letters="abé"):
    """Words at one edit or a few from each other."""
    out = {"".join(rng.choice(letters) for _ in range(length))}
    while len(out) < count:
        w = list(rng.choice(sorted(out)))
        at, kind = rng.randrange(len(w)), rng.randrange(3)
        w[at : at + (kind != 2)] = [rng.choice(letters)] if kind else []
        if 4 < len(w) < length + 6:
            out.add("".join(w))
    return sorted(out)


@pytest.mark.parametrize("seed, limit, length", [(1, 2, 9), (2, 3, 24), (3, 48, 7)])
def test_against_brute_force(spark, monkeypatch, seed, limit, length):
    monkeypatch.setattr(spelling, "BLOCK_WORDS", limit)
    rng = random.Random(seed)
    words = variants(rng, 150, length)
    rows = [(d, rng.choice([" ", "1", ", ", "Ā"]).join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=60)).title()) for d in range(60)]
    rows += [(None, "Chains chain chains chain chains chain chain " * 5 + "cha×ns " * 9), (61, None), (62, ""), (5, rows[5][1]), (5, rows[5][1]), (63, "abababab" * 5_000 + " " + ("abababab" * 5_000)[:-1] + " "), (64, 3 * ("abababab" * 5_000 + " ")), (65, 3 * (("abababab" * 5_000)[:-1] + " "))]
    got = result(spark, rows)
    assert got == by_hand(rows)
    assert any(r[2] not in (r[0], r[1]) for r in got)


def test_one_edit():
    words = ["abc", "abd", "abcd", "bc", "xabc", "abxc", "acb", "abc"]
    a, b = (np.array(x) for x in zip(*[(i, j) for i in range(len(words)) for j in range(len(words)) if 3 <= len(words[i]) and 3 <= len(words[j])]))
    got = spelling.one_edit(words, a, b, 3)
    assert got.tolist() == [near_by_hand(words[i], words[j]) and not len(words[i]) == len(words[j]) == 4 for i, j in zip(a, b)]


def test_empty_table(spark):
    assert result(spark, []) == []


def test_large_blocks_are_cut(spark, monkeypatch):
    """All words share their first half: no block that is compared has more than the limit unless its words differ in one place."""
    monkeypatch.setattr(spelling, "BLOCK_WORDS", 10)
    words = [f"same{a}{b}{c}{d}" for a in "abcd" for b in "abcd" for c in "abcd" for d in "abcd"]
    table = spark.createDataFrame([(w,) for w in words], "word string")
    seen = []
    real = spelling.scan
    monkeypatch.setattr(spelling, "scan", lambda rows: seen.append(rows.where("m - i - j > 1").groupBy(*spelling.SORTED).count().agg({"count": "max"}).first()[0]) or real(rows))
    pairs = spelling.near_pairs(table)
    assert pairs.count() == 256 * 12 and max(x for x in seen if x is not None) <= 10
