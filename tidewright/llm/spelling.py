"""Spelling variants: words that are one edit from a much more frequent word, found in a forward and a reversed sorted dictionary."""

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import tidy
from .store import broadcast_if_small, save, text_batches

RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
CAPITALS = {c: c + 32 for c in range(65, 91)}
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One in so many pairs of a document and a word loses a code point.
TYPO = 97
#: How many times as frequent a word's form is, at least.
FACTOR = 2
#: Different words that a task counts before it passes them on.
COUNTED_WORDS = 200_000
#: Words that a block may have to be compared pair by pair; larger ones are cut.
BLOCK_WORDS = 48
#: Code points that pairs take up when they are compared at once.
PAIR_POINTS = 1 << 22


def lowered(run: str) -> str:
    """A to Z in lower case, all else as it is."""
    return run.lower() if run.isascii() else run.translate(CAPITALS)


def with_typo(doc_id: int | None, word: str) -> str:
    """The word, or without its code point h % length if TYPO divides the crc32 h of `<doc_id>:<word>`; no doc_id is empty there."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    at = h % len(word)
    return word if h % TYPO else word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all runs of letters in docs (doc_id, text), lowered, with typos, of at least LEAST_LENGTH code points and LEAST_COUNT occurrences.

    A task adds up its own words before they are shuffled, so a word that a third
    of all runs are is one row of each task. A null text has none.
    """

    @tidy
    def count(batches):
        total = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = Counter()
                for run, n in Counter(RUN.findall(text.as_py() or "")).items():
                    found[lowered(run)] += n
                for word, n in found.items():
                    word = with_typo(doc_id, word)
                    if len(word) >= LEAST_LENGTH:
                        total[word] += n
                if len(total) >= COUNTED_WORDS:
                    yield out()
                    total.clear()
        if total:
            yield out()

    with text_batches(docs.sparkSession):
        each = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "word string, n long")
        return save(each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT), "words")


def _block(m: Column, i: Column, j: Column, word: Column) -> list[Column]:
    """A word's row in the block of words of m or m + 1 code points that share the first i (head) and the last j (tail, read backwards)."""
    word, tail = word.alias("word"), F.reverse(word)
    return [word, m.cast("int").alias("m"), i.cast("int").alias("i"), j.cast("int").alias("j"), F.substring(word, F.lit(1), i).alias("head"), F.substring(tail, F.lit(1), j).alias("tail")]


def dictionaries(words: DataFrame) -> DataFrame:
    """Rows of the forward dictionary (blocks by the first half) and the reversed one (by the last half).

    Two words of m and m or m + 1 code points that are one edit apart share the
    first half of m, rounded down, or all that follows it at the end. So each word
    stands in both dictionaries with m as its own length and as one less.
    """
    n = F.length("word")
    each = words.select("word", F.explode(F.array(n, n - 1)).alias("m"))
    half, none, m = F.floor(F.col("m") / 2).cast("int"), F.lit(0), F.col("m")
    return each.select(*_block(m, half, none, F.col("word"))).unionByName(each.select(*_block(m, none, m - half, F.col("word"))))


def _halves(rows: DataFrame) -> DataFrame:
    """Rows of the two blocks that a block is cut into: what lies between head and tail has its edit in its second half or in its first."""
    m, i, j, word = (F.col(c) for c in ("m", "i", "j", "word"))
    half = F.floor((m - i - j) / 2).cast("int")
    return rows.select(*_block(m, i + half, j, word)).unionByName(rows.select(*_block(m, i, m - i - half, word)))


def _points(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of words from the left and from the right, 0 beyond them, and lengths."""
    lengths = np.array([len(w) for w in words])
    left, right = np.zeros((2, len(words), width), np.uint32)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left[row, at] = flat
    right[row, lengths[row] - 1 - at] = flat
    return left, right, lengths


def one_edit(words: list[str], a: np.ndarray, b: np.ndarray, m: int) -> np.ndarray:
    """Which pairs (positions a and b in words of m or m + 1 code points) differ by exactly one inserted, deleted or replaced code point; pairs of two longer words are left out, as they are looked at with m + 1."""
    out = np.zeros(len(a), bool)
    step = max(1, PAIR_POINTS // (m + 1))
    for first in range(0, len(a), step):
        x, y = a[first : first + step], b[first : first + step]
        used, where = np.unique(np.concatenate([x, y]), return_inverse=True)
        x, y = where[: len(x)], where[len(x) :]
        left, right, lengths = _points([words[k] for k in used], m + 1)
        same = left[x] == left[y]
        before = np.cumprod(same, axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
        after = np.cumprod(right[x] == right[y], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
        replaced = (lengths[x] == m) & (lengths[y] == m) & ((~same).sum(axis=1) == 1)
        moved = (lengths[x] + lengths[y] == 2 * m + 1) & (before + after >= m)
        out[first : first + step] = replaced | moved
    return out


def near_in_blocks(words: list[str], m: int, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of near words among pairs of the same block; rows of a block follow one another, BLOCK_WORDS at most or of a single place to differ."""
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    sizes = np.diff(np.r_[starts, len(block)])
    found = []
    limit = max(1, PAIR_POINTS // (m + 1))
    held, pairs = [], 0
    for s, n in zip(starts.tolist(), sizes.tolist()):
        if n < 2:
            continue
        for row in range(s, s + n - 1):  # a row against those after it, so that even a large block is compared in parts
            held.append((row, s + n))
            pairs += s + n - row - 1
            if pairs >= limit:
                found.append(_compare(words, m, held))
                held, pairs = [], 0
    if held:
        found.append(_compare(words, m, held))
    if not found:
        return np.zeros((2, 0), np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _compare(words: list[str], m: int, held: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    rows, ends = np.array(held).T
    count = ends - rows - 1
    a = np.repeat(rows, count)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
    near = one_edit(words, a, b, m)
    return a[near], b[near]


SORTED = ["m", "i", "j", "head", "tail"]


def scan(rows: DataFrame) -> DataFrame:
    """(a, b) of near words in blocks that are small enough: the dictionaries are sorted, and blocks are ranges of them that no task shares."""

    @tidy
    def run(batches):
        held: list[pa.RecordBatch] = []

        def pairs(table):
            names = {c: table.column(c) for c in SORTED}
            numbers = [names[c].to_numpy() for c in ("m", "i", "j")]
            changed = np.zeros(len(table), bool)
            changed[0] = True
            for x in numbers:
                changed[1:] |= x[1:] != x[:-1]
            for c in ("head", "tail"):
                x = np.array(names[c].to_pylist(), object)
                changed[1:] |= x[1:] != x[:-1]
            words, block, m = table.column("word").to_pylist(), np.cumsum(changed), numbers[0]
            edges = np.flatnonzero(np.r_[True, m[1:] != m[:-1]]).tolist() + [len(m)]
            for s, e in zip(edges, edges[1:]):
                part = words[s:e]
                a, b = near_in_blocks(part, int(m[s]), block[s:e])
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array([part[k] for k in a.tolist()]), pa.array([part[k] for k in b.tolist()])], ["a", "b"])

        for batch in batches:
            key = [batch.column(c) for c in SORTED]
            # the last block of a batch may go on in the next
            last, at = [c[len(batch) - 1].as_py() for c in key], len(batch) - 1
            while at > 0 and [c[at - 1].as_py() for c in key] == last:
                at -= 1
            if at:
                yield from pairs(pa.Table.from_batches([*held, batch.slice(0, at)]).combine_chunks())
                held = []
            elif held and [held[-1].column(c)[len(held[-1]) - 1].as_py() for c in SORTED] != last:
                yield from pairs(pa.Table.from_batches(held).combine_chunks())
                held = []
            held.append(batch.slice(at))
        if held:
            yield from pairs(pa.Table.from_batches(held).combine_chunks())

    return rows.repartitionByRange(*SORTED).sortWithinPartitions(*SORTED, "word").mapInArrow(run, "a string, b string")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near), both ways: words (word) that differ by exactly one inserted, deleted or replaced code point.

    Blocks of more than BLOCK_WORDS words are cut in the same manner, level by
    level: in what lies between the shared ends, one edit leaves a half intact. A
    block whose words differ in one place is compared whole: it has no more words
    than the alphabet has pairs of letters. So no pair is lost, and no task gets a
    block that grows with the dictionary.
    """
    rows, level, found = save(dictionaries(words), "dictionaries_0"), 0, None
    block = F.xxhash64(*SORTED)
    while True:
        sizes = rows.where("m - i - j > 1").groupBy(block.alias("_block")).count()
        # blocks whose hashes agree are at worst cut without need
        large = save(sizes.where(F.col("count") > BLOCK_WORDS).select("_block"), f"large_blocks_{level}")
        keyed = rows.withColumn("_key", block)
        on = (F.col("_key") == F.col("_block")) & F.expr("m - i - j > 1")
        small = scan(keyed.join(broadcast_if_small(large), on, "left_anti").drop("_key"))
        small = save(small, f"near_{level}")
        found = small if found is None else found.unionByName(small)
        if large.isEmpty():
            break
        level += 1
        rows = save(_halves(keyed.join(broadcast_if_small(large), on, "left_semi")), f"dictionaries_{level}")
    both = found.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(found.select(F.col("b").alias("word"), F.col("a").alias("near")))
    return save(both.distinct(), "near_words")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last word that forms lead to. Each round doubles how far a row looks; counts grow along forms, so there is no circle and rounds are few."""
    at = save(forms.select("word", F.col("form").alias("root")), "roots_0")
    level = 0
    while True:
        level += 1
        on = at.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        joined = at.join(on, F.col("root") == F.col("_word"), "left")
        new = save(joined.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), f"roots_{level}")
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        at = new.drop("moved")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of docs (doc_id, text).

    A word's form is its near word of largest n (of equal ones the smallest in
    code-point order) if that has at least FACTOR times the word's n; its root is
    the last word that forms lead to, itself without one. Null and empty texts
    have no words, rows that are repeated count each, rows without doc_id take
    part with an empty id, and an empty table gives no row.
    """
    words = word_counts(docs)
    near = near_pairs(words)
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = near.join(counts, "near").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), "near")).alias("best"))
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.k")).alias("near_n"))
    much = F.col("near_n") >= FACTOR * F.col("n")
    found = save(found.select("word", F.when(much, F.col("near")).alias("form"), "n", "n_near", F.when(much, F.col("near_n")).alias("form_n")), "forms")
    last = roots(found.where("form IS NOT NULL"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
