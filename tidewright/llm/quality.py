"""Quality classifier: supervised subword embeddings, trained by numpy stochastic gradient descent."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytetext import IS_SEPARATOR, give_back, mix, prefix_sums, range_hash, slices, words
from .labelled import accepted, sample, scored

BUCKETS = 1 << 18
DIM = 12
#: Documents to learn from at most, and passes over them: enough for STEPS steps, within EPOCHS.
TRAIN_ROWS, STEPS, EPOCHS, RATE = 4000, 20_000, (5, 40), 0.4
THRESHOLD = 0.7
NGRAM = 4


def features(column: pa.Array):
    """Yield (first row, end row, word ids, words before each text, n-gram ids, n-grams before each text), ids as hash buckets.

    Words go alone and in pairs. The n-grams are runs of NGRAM characters (not
    bytes); white space, whatever it is, is one kind of character. None spans two texts.
    """
    for first, end, data, offsets in slices(column):
        starts, ends, before = words(data, offsets)
        sums = prefix_sums(np.where(IS_SEPARATOR[data], np.uint8(32), data))
        w = range_hash(sums, starts, ends)
        pair = np.empty(2 * len(w), np.uint64)  # each word, and after it the pair that it makes with the next word of its text
        pair[::2] = w
        pair[1:-1:2] = mix(w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:])
        kept = np.ones(len(pair), bool)
        last = before[1:][np.diff(before) > 0] - 1
        kept[2 * last + 1] = False
        places = np.concatenate([[0], np.cumsum(kept)])
        w, before = (pair[kept] % np.uint64(BUCKETS)).astype(np.int32), places[2 * before]
        lead = np.flatnonzero((data & 0xC0) != 0x80)  # where a character begins
        text = np.searchsorted(lead, offsets)
        n = max(0, len(lead) - NGRAM + 1)
        inside, new = np.ones(n, bool), np.zeros(len(lead) + 1, bool)
        new[text] = True
        for j in range(1, NGRAM):
            inside &= ~new[j : j + n]
        at, stops = np.flatnonzero(inside), np.append(lead, len(data))
        grams = (range_hash(sums, stops[at], stops[at + NGRAM]) % np.uint64(BUCKETS)).astype(np.int32)
        yield first, end, w, before, grams, np.searchsorted(at, text)


def _ids_of(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the distinct buckets of its words and n-grams and their shares."""
    out = []
    for _, _, w, before, grams, grams_before in features(column):
        for i in range(len(before) - 1):
            own = np.concatenate([w[before[i] : before[i + 1]], grams[grams_before[i] : grams_before[i + 1]]])
            ids, counts = np.unique(own, return_counts=True)
            out.append((ids, (counts / max(1, len(own))).astype(np.float32)))
    return out


class Model:
    """A text is the mean of the vectors of its words and character n-grams; a softmax over two classes reads it."""

    def __init__(self, texts: pa.Array, y: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        out, bias = np.zeros((DIM, 2), np.float32), np.log(np.bincount(y, minlength=2) + 1.0).astype(np.float32)
        docs = _ids_of(texts)
        epochs = int(np.clip(STEPS // max(1, len(docs)), *EPOCHS))
        rounds, step = epochs * len(docs), 0
        for _ in range(epochs):
            for i in rng.permutation(len(docs)).tolist():
                ids, share = docs[i]
                rate, step = RATE * (1 - step / rounds), step + 1
                rows = vectors[ids]
                hidden = share @ rows
                z = hidden @ out + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y[i]] -= 1
                back = out @ p
                out -= rate * np.outer(hidden, p)
                bias -= rate * 0.1 * p
                # the share of an n-gram is small, so its vector takes the step for the whole text, as in the public implementation
                vectors[ids] = rows - rate * np.minimum(share * len(share), 8)[:, None] * back
        # the softmax of a mean reads only the mean difference of the classes: one number for each n-gram
        self.weight = (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32)
        self.bias = float(bias[1] - bias[0])

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.empty(len(column))
        for first, end, w, before, grams, grams_before in features(column):
            total, count = np.zeros(end - first), np.zeros(end - first)
            for ids, bounds in ((w, before), (grams, grams_before)):
                sums = np.concatenate([[0.0], np.cumsum(self.weight[ids], dtype=np.float64)])
                total += sums[bounds[1:]] - sums[bounds[:-1]]
                count += bounds[1:] - bounds[:-1]
            out[first:end] = 1 / (1 + np.exp(-(total / np.maximum(count, 1) + self.bias)))
        return out


def quality_model(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most rows labelled documents outside the held-out fold. Without any label every text scores 0.5."""
    try:
        return Model(*sample(docs, labels, "quality", rows))
    finally:
        give_back()


def classify(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Score whole texts: columns keep, held_out, score (chance of label 1), predicted. Null and empty texts score what the labels' shares say; repeated rows and null ids count each; very long texts are scored whole; columns that aren't named stay unread, and an empty table gives no row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(quality_model(docs, labels))
    return scored(docs, lambda texts: shared.value.score(texts), threshold, keep)


def admit(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier doesn't reject, each row by its own text, with their own columns, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(quality_model(docs, labels))
    return accepted(docs, lambda texts: shared.value.score(texts), lambda x: x >= threshold)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
