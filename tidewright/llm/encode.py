"""Whole texts to token ids with the tokenizers library; ids of repeated pieces of text are looked up."""

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from .bytetext import IS_SEPARATOR, prefix_sums, range_hash, slices

#: Pieces kept, 16 bytes each besides their ids; when there are more, the cache starts anew.
CACHED = 500_000
#: Bytes of text encoded at once, about; the arrays over them take some 60 times as much.
ENCODE_BYTES = 1 << 19
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
#: Bytes that don't occur in texts of ASCII and the Latin letters U+00C0 to U+017F.
_ODD_LEAD = np.zeros(256, bool)
_ODD_LEAD[0xC0:0xC3] = _ODD_LEAD[0xC6:] = True


def _byte_characters() -> dict[int, str]:
    """The visible character that byte-level vocabularies write for each byte: its own if it is visible, else the next from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(rest)}


_SPELL = _byte_characters()


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts as tokenizers does, faster where pieces of text recur.

    Both families of pre-tokenizers used here split before white space that
    follows other characters, and between a letter and another visible character
    that is no apostrophe. So a text in ASCII and Latin letters is the
    concatenation of pieces that can be encoded alone. Texts with anything else,
    or with what may be a special token, go to the library whole.
    """

    def __init__(self, path: str, literal_special: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal_special
        vocab = self.tokenizer.get_vocab()
        self.size = max(vocab.values()) + 1
        self.word_ends = any(k.endswith("</w>") for k in vocab)
        self.model = self.tokenizer.model
        self._forget()

    def _forget(self) -> None:
        """known: sorted hashes of pieces; place: where the ids of each stand in flat, and how many, as start * 2**24 + count."""
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 18, np.int32), 0

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, keys: np.ndarray, found: list) -> None:
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum()))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(ids), len(self.flat)), np.int32)])
        self.flat[self.used : self.used + len(ids)] = ids
        at = np.searchsorted(self.known, keys)
        self.known = np.insert(self.known, at, keys)
        self.place = np.insert(self.place, at, ((np.cumsum(counts) - counts + self.used) << 24) + counts)
        self.used += len(ids)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """Where the ids of the pieces stand; -1 for unknown ones."""
        if not len(self.known):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
        return np.where(self.known[at] == keys, self.place[at], -1)

    def _learn_plain(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Encode pieces that are letters after a space or none: one unit for the pre-tokenizers, so the library's model takes them without the steps before it."""
        text = b"\n".join(pieces)
        if self.word_ends:
            text = text.decode().lower().replace(" ", "").encode()
        tokenize = self.model.tokenize
        self._keep(keys, [[t.id for t in tokenize(w)] for w in text.decode("latin-1").translate(_SPELL).split(_SPELL[10])])

    def _learn_whole(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        self._keep(keys, self.whole([p.decode() for p in pieces]))

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after another, and each text's number of ids."""
        n = len(offsets) - 1
        lead = _ODD_LEAD[data]
        c3 = data == 0xC3
        lead[1:] |= c3[:-1] & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        c4 = data == 0xC4
        lead[1:] |= c4[:-1] & ((data[1:] == 0xB0) | (data[1:] == 0xB1))
        lead[1:] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
        before = np.searchsorted(np.flatnonzero(lead), offsets)
        odd = np.flatnonzero(before[1:] > before[:-1])
        space, letter, glued = IS_SEPARATOR[data], _LETTER[data], data == ord("'")
        cut = np.zeros(len(data) + 1, bool)
        if len(data) > 1:
            cut[1:-1] = (space[1:] & ~space[:-1]) | (~space[1:] & ~space[:-1] & (letter[1:] != letter[:-1]) & ~glued[1:] & ~glued[:-1])
        for i in odd.tolist():
            cut[offsets[i] : offsets[i + 1]] = False
        cut[offsets] = True
        cut[-1] = False
        starts = np.flatnonzero(cut)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        ends = np.append(starts[1:], len(data))
        keys = range_hash(prefix_sums(data), starts, ends)
        distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > CACHED:
            self._forget()
        found = self._places(distinct)
        new = np.flatnonzero(found < 0)
        if len(new):
            at = first[new]
            begin, end = starts[at], ends[at]
            letters = np.concatenate([[0], np.cumsum(letter)])
            skip = (data[begin] == 32).astype(np.int64)
            plain = (end - begin > skip) & (letters[end] - letters[np.minimum(begin + skip, end)] == end - begin - skip)
            if len(odd):
                plain &= ~np.isin(begin, offsets[odd])
            raw = data.tobytes()
            for these, learn in ((new[plain], self._learn_plain), (new[~plain], self._learn_whole)):
                if len(these):
                    learn(distinct[these], [raw[a:b] for a, b in zip(starts[first[these]].tolist(), ends[first[these]].tolist())])
            found[new] = self._places(distinct[new])
        begins, lengths = found >> 24, found & 0xFFFFFF
        out = lengths[which]
        done = np.cumsum(out)
        ids = self.flat[np.repeat(begins[which] - (done - out), out) + np.arange(done[-1])]
        total = np.concatenate([[0], done])
        at = np.searchsorted(starts, offsets)
        return ids, total[at[1:]] - total[at[:-1]]


@lru_cache(2)
def encoder(path: str, literal_special: bool = False) -> Encoder:
    """One for each Python worker."""
    return Encoder(path, literal_special)


def encoded(texts: pa.Array, path: str, end_id: int | None, literal_special: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, ids, offsets) for runs of texts. end_id, if any, follows each text's ids."""
    e = encoder(path, literal_special)
    for first, end, data, offsets in slices(texts, ENCODE_BYTES):
        ids, counts = e.encode_bytes(data, offsets)
        if end_id is not None:
            ids = np.insert(ids, np.cumsum(counts), end_id)
            counts = counts + 1
        yield first, end, ids, np.concatenate([[0], np.cumsum(counts)])
