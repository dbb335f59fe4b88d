"""Byte-level BPE by prefix dynamic programming.

Byte-pair encoding of every prefix of a byte string ends in one token that is
valid there: it joins to the last token of what precedes it without changing
either.  Storing this last token for each prefix gives the encoding of any
prefix by following the tokens back, so bytes can be appended exactly, and an
edit needs new states from its place on alone.

A token t may follow s if merging the bytes of both yields s and t again.
`Joins` decides that from the ranks, by looking at how both tokens are split,
and remembers it.  A text is cut by the vocabulary's pattern first; distinct
matches are encoded once and remembered by each worker.

Defined results: a null text is empty and has no tokens; null and repeated
doc_ids keep their rows; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from . import _shared, _words

#: Matches of the pattern and other words whose ids a worker remembers, bytes of the longest of the latter, and pairs of tokens.
REMEMBERED_MATCHES, REMEMBERED_WORDS, LONGEST, REMEMBERED_PAIRS = 1_000_000, 100_000, 64, 1_000_000
#: Bytes of text that are looked at together.
STRETCH = _words.STRETCH
#: White space as the pattern's \\s has it.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Runs that the pattern never matches across: it cuts before a space that precedes a visible character, and after other white space.
_UNITS = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: White space beyond ASCII: its runs with other white space are matched as one.
_WIDE_SPACE = "[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The pattern whose matches are told apart by `pieces`; another pattern runs over all words.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LETTERS = np.array([c >= 0xC0 and chr(c).isalpha() for c in range(0x250)], np.uint16)


class Vocabulary:
    """Tokens by rank, and how each is made of two others."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{_SPACE}\p{{L}}\p{{N}}]").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]"))
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        #: Finds all tokens that end at each byte, the longest first; bytes are characters there.
        self.ends = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.ends.add_word(token.decode("latin-1"), (rank, len(token)))
        self.ends.make_automaton()
        self.longest = max(map(len, self.ranks))
        self.plain = pattern == _PATTERN
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.joins: dict[int, bool] = {}
        self.known, self.others = _words.Pool("<u4", REMEMBERED_MATCHES), _words.Pool("<u4", REMEMBERED_WORDS)

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one last; None for a single byte."""
        if token not in self.parts:
            ids = self._merge(self.bytes[token], self.ranks[self.bytes[token]])
            self.parts[token] = (ids[0], ids[1]) if len(ids) == 2 else None
        return self.parts[token]

    def _merge(self, data: bytes, below: int) -> list[int]:
        """Plain byte-pair merging with tokens under a rank."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], below))
            if self.ranks.get(parts[best] + parts[best + 1], below) >= below:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, stay as they are."""
        key = left << 32 | right
        if (known := self.joins.get(key)) is not None:
            return known
        if len(self.joins) >= REMEMBERED_PAIRS:
            self.joins.clear()
        self.joins[key] = answer = self._stay(left, right)
        return answer

    def _stay(self, left: int, right: int) -> bool:
        """Goes back in time: undoes the later of the two merges at the border, and sees whether a merge across it came first.

        Of merges of equal rank the leftmost comes first: the left token's own, then one across, then the right token's own.
        """
        ranks, data = self.ranks, self.bytes
        before, until = 1 << 60, 1 << 60  # the ranks at which the left and the right edge were merged away
        while True:
            across = ranks.get(data[left] + data[right])
            if across is not None and across < before and across <= until:
                return False
            two, other = self.split(left), self.split(right)
            if two is not None and (other is None or left > right):
                before, left = left, two[1]
            elif other is not None:
                until, right = right, other[0]
            else:
                return True


class Prefixes:
    """The encoding of a growing byte string: the last token of every prefix."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        v, last = self.vocabulary, self.last
        self.data += more
        joins, done = v.joins, len(last) - 1  # bytes that have their token
        if done == len(self.data):
            return
        for end, (token, n) in v.ends.iter(self.data.decode("latin-1"), max(0, done + 1 - v.longest)):
            if end < done:
                continue
            if end > done:
                raise ValueError("a byte isn't in the vocabulary")
            begin = end + 1 - n
            if begin:
                if (stays := joins.get(last[begin] << 32 | token)) is None:
                    stays = v.may_follow(last[begin], token)
                if not stays:
                    continue
            last.append(token)
            done += 1
        if done < len(self.data):
            raise ValueError("a byte isn't in the vocabulary")

    def cut(self, size: int) -> None:
        """Keep the first bytes alone; their states stay valid."""
        self.data, self.last = self.data[:size], self.last[: size + 1]

    def replace(self, begin: int, end: int, by: bytes) -> int:
        """An edit: states before it stay, and those after it are found until they agree with the old ones over the longest token; how many were found.

        From there on each state follows from equal states and equal bytes.
        """
        data, last, most = self.data, self.last, self.vocabulary.longest
        moved, at = begin + len(by) - end, end  # old bytes from `end` on stand `moved` further
        self.cut(begin)
        self.append(by)
        while at < len(data):
            upto = min(at + most, len(data))
            self.append(data[at:upto])
            if upto - at == most and self.last[at + 1 + moved :] == last[at + 1 : upto + 1]:
                self.data += data[upto:]
                self.last += last[upto + 1 :]
                return upto + moved - begin
            at = upto
        return len(self.data) - begin

    def ids(self, size: int | None = None) -> list[int]:
        """The encoding of the first bytes, or of all."""
        at, out = len(self.data) if size is None else size, []
        while at:
            out.append(self.last[at])
            at -= len(self.vocabulary.bytes[self.last[at]])
        return out[::-1]


_vocabularies: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One per worker process."""
    if (path, pattern) not in _vocabularies:
        _vocabularies[path, pattern] = Vocabulary(path, pattern)
    return _vocabularies[path, pattern]


def encode_sorted(v: Vocabulary, matches: list[bytes]) -> Iterator[list[int]]:
    """Encodings of sorted byte strings; the states of what one shares with the next are kept."""
    prefixes = Prefixes(v)
    for new in matches:
        old = prefixes.data
        n = min(len(new), len(old))
        if new[:n] != old[:n]:
            n = next(k for k in range(n) if new[k] != old[k])
        prefixes.cut(n)
        prefixes.append(new[n:])
        yield prefixes.ids()


def _encode_matches(v: Vocabulary, matches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct byte strings, one after another, and how many each has."""
    order = sorted(range(len(matches)), key=matches.__getitem__)
    ids: list[list[int]] = [[]] * len(matches)
    for i, found in zip(order, encode_sorted(v, [matches[i] for i in order]), strict=True):
        ids[i] = found
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), "<u4", int(lengths.sum())), lengths


def _encode_words(v: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The same for strings that the pattern cuts further."""
    matches = [v.pattern.findall(w) for w in words]
    each = list(dict.fromkeys(chain.from_iterable(matches)))
    ids, lengths = _encode_matches(v, [m.encode() for m in each])
    starts, place = np.cumsum(lengths) - lengths, {m: i for i, m in enumerate(each)}
    at = np.fromiter((place[m] for ms in matches for m in ms), np.int64, sum(map(len, matches)))
    ends = np.concatenate([[0], np.cumsum(lengths[at])])
    return ids[_words.ragged(starts[at], lengths[at])], np.diff(ends[np.cumsum([0, *map(len, matches)])])


def pieces(x: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pattern's matches begin in texts with ASCII white space alone, and whether each is one; else it is a word that the pattern cuts further.

    The pattern gives white space before a word its last character, if that is a space, to the word.
    """
    classes, _, _ = _words.classes_of(x, _LETTERS)
    at, kind, first, runs, _ = _words.runs_of(classes, begins)
    plain, mark = _words.plain_words(kind, first, runs), np.zeros(len(x), np.uint8)
    blank = kind == _words.SPACE
    mark[at[blank]] = 1
    text_at = np.zeros(len(x) + 1, bool)
    text_at[begins] = True
    before = np.zeros(len(first), bool)  # words right after white space of their text
    before[first > 0] = blank[first[first > 0] - 1] & ~text_at[at[first[first > 0]]]
    start = at[first] - (before & (x[np.maximum(at[first] - 1, 0)] == 32))
    lone = at[first][before & (start == at[first])] - 1  # white space of its own before a word
    mark[lone] = 1
    mark[start] = np.where(plain, 1, 2)
    two = plain & (runs == 2)
    mark[at[first[two] + 1]] = 1
    place = np.flatnonzero(mark)
    return place, mark[place] == 1


def _stretch(v: Vocabulary, x: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts that begin at these bytes, one after another, and how many each has."""
    place, single = pieces(x, begins)
    every = _words.strings(x, np.append(place, len(x)))
    coded = every.filter(pa.array(single)).dictionary_encode()
    at = v.known.places(coded.dictionary, lambda new: _encode_matches(v, new.to_pylist()))[np.asarray(coded.indices)]
    start, length, pool = np.empty(len(place), np.int64), np.empty(len(place), np.int64), v.known.ids
    start[single], length[single] = v.known.starts[at], v.known.lengths[at]
    if not single.all():
        odd = np.flatnonzero(~single)
        short = np.diff(np.append(place, len(x)))[odd] <= LONGEST
        learn = lambda new: _encode_words(v, new.cast(pa.string()).to_pylist())
        coded = every.take(pa.array(odd[short])).dictionary_encode()
        at = v.others.places(coded.dictionary, learn)[np.asarray(coded.indices)]
        start[odd[short]], length[odd[short]] = len(pool) + v.others.starts[at], v.others.lengths[at]
        ids, n = learn(every.take(pa.array(odd[~short])))
        pool = np.concatenate([pool, v.others.ids, ids])
        start[odd[~short]], length[odd[~short]] = len(pool) - len(ids) + np.cumsum(n) - n, n
    return pool[_words.ragged(start, length)], _words.per_text(length, place, begins)


def encode(v: Vocabulary, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another, and how many each text has; a null text is empty."""
    texts = texts.fill_null("")
    wide = np.asarray(pc.match_substring_regex(texts, _WIDE_SPACE)) if v.plain else np.ones(len(texts), bool)
    counts, parts = np.zeros(len(texts), np.int64), [np.empty(0, "<u4")]
    if wide.any():  # by runs that the pattern never matches across
        units = [_UNITS.findall(t) if v.plain else [t] for t in texts.filter(pa.array(wide)).to_pylist()]
        found = [_encode_words(v, us) for us in units]
        some, n = texts.filter(pa.array(~wide)), np.array([len(f[0]) for f in found])
        rest, counts[~wide] = encode(v, some) if len(some) else (parts[0], 0)
        counts[wide] = n
        out, ends = np.empty(int(counts.sum()), "<u4"), np.cumsum(counts)
        own = np.repeat(wide, counts)
        out[~own] = rest
        out[own] = np.concatenate([f[0] for f in found])
        return out, counts
    x, offsets = _words.bytes_of(texts)
    for part, mine, begins in _words.stretches(x, offsets, STRETCH):
        ids, n = _stretch(v, part, begins)
        parts.append(ids)
        counts[mine] += n
    return np.concatenate(parts), counts


def decode(v: Vocabulary, ids: np.ndarray) -> bytes:
    return b"".join(map(v.bytes.__getitem__, ids.tolist()))


def coded(docs: DataFrame, path: str, pattern: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and decode its ids again: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _shared.slices(whole, rows=whole.num_rows):
                v = vocabulary(path, pattern)
                ids, counts = encode(v, b.column(1))
                ends = np.concatenate([[0], np.cumsum(counts)])
                each = [ids[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
                columns = [
                    b.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in each], pa.string()),
                    pa.array([hashlib.sha256(decode(v, x)).hexdigest() for x in each], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view("<i4"))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return _shared.texts_of(docs, id_col, text_col).mapInArrow(run, schema)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return coded(_shared.read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
