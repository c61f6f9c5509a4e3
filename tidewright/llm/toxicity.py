"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytetext import LOWER, give_back, prefix_sums, range_hash, slices
from .labelled import accepted, sample, scored

#: Documents to learn from at most.
TRAIN_ROWS = 6000
TREES, DEPTH, BINS, RATE, SMOOTH = 80, 4, 48, 0.15, 2.0
THRESHOLD = 0.3
#: Words of a lexicon that is learned besides the given one, at most.
LEARNED = 300
#: Given lexicon: words that insult, in lower case.
INSULTS = "idiot moron stupid scum trash loser pathetic worthless clown fool dumb garbage disgusting ugly filth vermin imbecile jerk hate kill die".split()
#: Words that address the reader, in the languages of the tables.
SECOND_PERSON = "you your yours yourself tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer usted ustedes ti tus su".split()
NEAR = 4

_WORD = np.zeros(256, bool)
_WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_MASK = np.zeros(256, bool)
_MASK[list(b"0123456789@$*!")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
#: What stands for a letter in a disguised word.
_PLAIN = LOWER.copy()
for _a, _b in zip(b"01345@$!", b"oieasasi"):
    _PLAIN[_a] = _b


def word_hash(text: str) -> int:
    raw = np.frombuffer(text.encode(), np.uint8)
    return int(range_hash(prefix_sums(raw), np.array([0]), np.array([len(raw)]))[0])


def _hash_set(words) -> np.ndarray:
    return np.array(sorted({word_hash(w) for w in words}), np.uint64)


def _member(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(hashes), bool)
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def _runs(flag: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of flagged bytes, none over the edge of a text, and for each text the runs before it."""
    if not len(flag):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(flag) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(flag & (~np.concatenate([[False], flag[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(flag & (~np.concatenate([flag[1:], [False]]) | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _words(data: np.ndarray, offsets: np.ndarray):
    """Hashes of the letter words in lower case; their number before each text; hashes of the words with masked letters put right, and the same."""
    low = LOWER[data]
    starts, ends, before = _runs(_WORD[data], offsets)
    plain = range_hash(prefix_sums(low), starts, ends)
    s, e, b = _runs(_WORD[data] | _MASK[data], offsets)
    masks = np.concatenate([[0], np.cumsum(_MASK[data])])
    mixed = masks[e] - masks[s]
    inner = (mixed > 0) & (mixed < e - s) & (_WORD[data[s]] if len(s) else np.zeros(0, bool)) & (_WORD[data[np.maximum(e - 1, 0)]] if len(e) else np.zeros(0, bool))
    s, e = s[inner], e[inner]
    put_right = range_hash(prefix_sums(_PLAIN[data]), s, e)
    return plain, before, put_right, np.searchsorted(s, offsets), starts


def _sums(flag: np.ndarray, before: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flag)])
    return (total[before[1:]] - total[before[:-1]]).astype(np.float64)


def _close(flag: np.ndarray, other: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Flagged words with an other word at most NEAR words away in the same text."""
    text = np.searchsorted(before, np.flatnonzero(flag), "right") - 1
    at = np.flatnonzero(flag)
    sums = np.concatenate([[0], np.cumsum(other)])
    low, high = np.maximum(at - NEAR, before[text]), np.minimum(at + NEAR + 1, before[text + 1])
    out = np.zeros(len(flag), bool)
    out[at] = sums[high] > sums[low]
    return out


class Features:
    """Dense features of whole texts; the learned lexicon comes from labelled texts."""

    def __init__(self, texts: pa.Array, y: np.ndarray):
        self.given, self.second = _hash_set(INSULTS), _hash_set(SECOND_PERSON)
        words, label = [], []
        row = 0
        for _, _, data, offsets in slices(texts):
            plain, before, *_ = _words(data, offsets)
            for i in range(len(offsets) - 1):
                own = np.unique(plain[before[i] : before[i + 1]])
                words.append(own)
                label.append(np.full(len(own), y[row]))
                row += 1
        self.learned = np.zeros(0, np.uint64)
        if words:
            found, at = np.unique(np.concatenate(words), return_inverse=True)
            label = np.concatenate(label)
            n, hits = np.bincount(at), np.bincount(at, label)
            share = y.mean()
            z = (hits - n * share) / np.sqrt(np.maximum(n * share * (1 - share), 1e-9))
            rate = hits / n
            best = np.flatnonzero((z > 6) & (hits >= 8) & (rate > 2 * share))
            self.learned = np.sort(found[best[np.argsort(-z[best], kind="stable")[:LEARNED]]])

    def __call__(self, texts: pa.Array) -> np.ndarray:
        out = [np.zeros((0, 16))]
        for _, _, data, offsets in slices(texts):
            plain, before, put_right, masked_before, starts = _words(data, offsets)
            given, learned, second = _member(plain, self.given), _member(plain, self.learned), _member(plain, self.second)
            any_ = given | learned
            hidden = _member(put_right, self.given) | _member(put_right, self.learned)
            n, size = np.diff(before).astype(np.float64), np.maximum(1, np.diff(offsets)).astype(np.float64)
            per = np.maximum(1, n)
            bytes_ = lambda flag: _sums(flag[data], offsets) / size
            shout = np.zeros(len(data), bool)
            shout[1:] = (data[1:] == 33) & (data[:-1] == 33)
            upper_word = _sums(_UPPER[data[starts]] & _UPPER[data[np.minimum(starts + 1, len(data) - 1)]], before) if len(data) else n
            hits = _sums(any_, before)
            columns = [_sums(given, before) / per, _sums(learned, before) / per, hits / per, hits, np.log1p(hits), _sums(_close(any_, second, before), before) / per, _sums(second, before) / per, bytes_(_UPPER), upper_word / per, bytes_(_PUNCT), _sums(shout, offsets) / size, bytes_(_MASK), _sums(np.ones(len(put_right)), masked_before) / per, _sums(hidden, masked_before), np.log1p(n), size / per]
            out.append(np.column_stack(columns))
        return np.concatenate(out)


class Boosted:
    """Gradient boosting of logistic loss: trees of one depth over binned features, second-order gains."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T] if len(x) else [np.zeros(0)] * x.shape[1]
        binned = self._binned(x)
        self.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        self.trees, total = [], np.full(len(y), self.base)
        for _ in range(TREES if len(y) and 0 < y.sum() < len(y) else 0):
            p = 1 / (1 + np.exp(-total))
            grad, hess = p - y, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS, np.int64)
            for level in range(DEPTH):
                first, nodes = 2**level - 1, 2**level
                best = np.full(nodes, 1e-6)
                for f in range(x.shape[1]):
                    key = node * BINS + binned[:, f]
                    g = np.bincount(key, grad, nodes * BINS).reshape(nodes, BINS).cumsum(axis=1)
                    h = np.bincount(key, hess, nodes * BINS).reshape(nodes, BINS).cumsum(axis=1)
                    all_g, all_h = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + SMOOTH) + (all_g - g) ** 2 / (all_h - h + SMOOTH) - all_g**2 / (all_h + SMOOTH)
                    gain[(h < 1) | (all_h - h < 1)] = 0
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(nodes), at]
                    better = top > best
                    best[better] = top[better]
                    feature[first : first + nodes][better], cut[first : first + nodes][better] = f, at[better]
                node = 2 * node + (binned[np.arange(len(y)), feature[first + node]] > cut[first + node])
            g, h = np.bincount(node, grad, 2**DEPTH), np.bincount(node, hess, 2**DEPTH)
            value = -RATE * g / (h + SMOOTH)
            total += value[node]
            self.trees.append((feature, cut, value))

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)]) if len(x) else np.zeros(x.shape, np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        binned, total, rows = self._binned(x), np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(DEPTH):
                at = 2**level - 1 + node
                node = 2 * node + (binned[rows, feature[at]] > cut[at])
            total += value[node]
        return total


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest rising step function to y over score (pool adjacent violators), as points to interpolate between."""
    blocks: list[list[float]] = []  # mean, weight, first score, last score
    for s, v in sorted(zip(score.tolist(), y.tolist())):
        blocks.append([v, 1.0, s, s])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            v1, w1, _, last = blocks.pop()
            v0, w0, first, _ = blocks[-1]
            blocks[-1] = [(v0 * w0 + v1 * w1) / (w0 + w1), w0 + w1, first, last]
    at = np.array([x for b in blocks for x in (b[2], b[3])])
    return at, np.array([b[0] for b in blocks for _ in range(2)])


class Model:
    """Trees on three quarters of the sample, calibration on the rest."""

    def __init__(self, texts: pa.Array, y: np.ndarray):
        cut = len(y) * 3 // 4
        self.features = Features(texts[:cut], y[:cut])
        x = self.features(texts)
        self.trees = Boosted(x[:cut], y[:cut])
        held = self.trees(x[cut:])
        self.at, self.value = isotonic(held, y[cut:]) if len(held) else (np.zeros(1), np.full(1, 0.5))

    def score(self, texts: pa.Array) -> np.ndarray:
        raw = self.trees(self.features(texts))
        calibrated = np.interp(raw, self.at, self.value)
        # a trace of the trees' own score keeps the order within the steps
        return np.clip(calibrated * 0.98 + 0.02 / (1 + np.exp(-raw)), 0.0, 1.0)


def toxicity_model(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most rows labelled documents outside the held-out fold. Without any label every text scores about 0.5."""
    try:
        return Model(*sample(docs, labels, "toxic", rows))
    finally:
        give_back()


def classify(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Score whole texts: columns keep, held_out, score (chance of label 1), predicted. Null and empty texts are scored by their (zero) features; repeated rows and null ids count each; very long texts are scored whole; columns that aren't named stay unread, and an empty table gives no row."""
    shared = docs.sparkSession.sparkContext.broadcast(toxicity_model(docs, labels))
    return scored(docs, lambda texts: shared.value.score(texts), threshold, keep)


def admit(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier doesn't reject, each row by its own text, with their own columns, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(toxicity_model(docs, labels))
    return accepted(docs, lambda texts: shared.value.score(texts), lambda x: x < threshold)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
