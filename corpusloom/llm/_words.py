"""Words and other strings of many texts at once: numpy over their bytes, and Arrow lookups of distinct strings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are looked at together.
STRETCH = 4 << 20
#: Classes of bytes: ASCII white space, letters (A-Z and composed ones below U+0250), ASCII marks, all else.
SPACE, LETTER, MARK, OTHER = 0, 1, 2, 3


def _byte_classes() -> np.ndarray:
    classes = np.full(256, OTHER, np.uint8)
    classes[[32, *range(9, 14)]] = SPACE
    classes[[c for c in range(33, 127) if not chr(c).isalnum()]] = MARK
    classes[[*range(65, 91), *range(97, 123)]] = LETTER
    return classes


CLASSES = _byte_classes()


def classes_of(x: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class of each byte of UTF-8; the first bytes of the letters of two bytes, and what the table, by code point below 0x250, has for them (not 0)."""
    classes = CLASSES[x]
    far = np.flatnonzero(x >= 0x80)
    lead = far[(x[far] >= 0xC3) & (x[far] <= 0xC9)]
    point = letters[((x[lead].astype(np.int64) & 0x1F) << 6) | (x[lead + 1] & 0x3F)]
    lead, point = lead[point > 0], point[point > 0]
    classes[lead] = classes[lead + 1] = LETTER
    return classes, lead, point


def runs_of(classes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one class, cut where texts begin: where they begin and their classes; the words, which are runs between white space: the first run of each, how many it has, and for each run the word it is in."""
    edge = np.empty(len(classes), bool)
    edge[0], edge[1:] = True, classes[1:] != classes[:-1]
    edge[begins[begins < len(classes)]] = True
    at = np.flatnonzero(edge)
    kind = classes[at]
    text_at = np.zeros(len(classes) + 1, bool)
    text_at[begins] = True
    solid = kind != SPACE
    fresh = solid.copy()
    fresh[1:] &= ~solid[:-1] | text_at[at[1:]]
    first, word = np.flatnonzero(fresh), np.cumsum(fresh) - 1
    return at, kind, first, np.bincount(word[solid], minlength=len(first)), word


def plain_words(kind: np.ndarray, first: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Which words are letters alone, or letters and then marks."""
    second = np.minimum(first + 1, len(kind) - 1)
    return (kind[first] == LETTER) & ((runs == 1) | (runs == 2) & (kind[second] == MARK))


def strings(x: np.ndarray, bounds: np.ndarray) -> pa.BinaryArray:
    """The strings between bounds, without a copy."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(x)])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many of them, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Pool:
    """Ids of remembered strings, found by an Arrow lookup of many strings at once; begun anew beyond `most` strings."""

    def __init__(self, kind: str, most: int) -> None:
        self.kind, self.most = kind, most
        self.clear()

    def clear(self) -> None:
        self.keys = pa.array([], pa.binary())
        self.ids, self.starts, self.lengths = np.empty(0, self.kind), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, keys: pa.BinaryArray, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids])
        self.keys = pa.concat_arrays([self.keys, keys])

    def places(self, wanted: pa.BinaryArray, learn: Callable[[pa.BinaryArray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Where each of the distinct wanted strings stands; `learn` gives ids and their numbers for new ones."""
        if len(self.keys) + len(wanted) > self.most:
            self.clear()
        at = pc.index_in(wanted, self.keys)
        if at.null_count:
            new, known = wanted.filter(at.is_null()), len(self.keys)
            self.add(new, *learn(new))
            at = np.asarray(at.fill_null(-1)).astype(np.int64)
            at[at < 0] = np.arange(known, known + len(new))
            return at
        return np.asarray(at).astype(np.int64)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of texts and where each begins, with the end."""
    texts = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def stretches(x: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, slice, np.ndarray]]:
    """Parts of about `size` bytes: the bytes, the texts that have some there, and where these begin in the part.

    Parts end where a text ends or, in a longer text, after a word.
    """
    begin, n = 0, len(x)
    while begin < n:
        end = n if n - begin <= size else int(offsets[np.searchsorted(offsets, begin + size, "right") - 1])
        if end <= begin:
            last, end = int(offsets[np.searchsorted(offsets, begin + size, "right")]), begin + size
            while end < last:
                space = CLASSES[x[end - 1 : min(end + 65_536, last)]] == SPACE
                after = np.flatnonzero(space[1:] & ~space[:-1])
                if len(after):
                    end += int(after[0])
                    break
                end = min(end + 65_536, last)
        i, j = int(np.searchsorted(offsets, begin, "right")) - 1, int(np.searchsorted(offsets, end, "left"))
        yield x[begin:end], slice(i, j), np.maximum(offsets[i:j] - begin, 0)
        begin = end


def per_text(lengths: np.ndarray, where: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums by text of the lengths of strings that begin at ascending places."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return np.diff(ends[np.append(np.searchsorted(where, begins), len(where))])
