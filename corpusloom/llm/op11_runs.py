"""Periodic runs of words: masked by repeated k-grams, found by Main–Lorentz.

A run is a stretch of words with smallest period q, at least ``LEAST_WORDS`` and
``LEAST_PERIODS`` * q words long, that no neighbouring word extends.  It overlaps
itself, moved by q, in length - q words, so every word of a run stands in a k-gram
that the text holds twice, for k the least such overlap of any period
(`least_overlap`).  Words outside repeated k-grams are masked; each run lies within
one stretch of words that are left, a segment.

Main–Lorentz halves segments.  At each border of two halves it has, for every
period, how far the words on either side go on to equal those a period away; runs
across the border come from that, all others lie in one of the halves.  One level of
halves of all texts at hand is done at once.  How far words are equal is found by
hashes of stretches, which may only say too much: each run is then compared word by
word, and measured by words alone if the hashes were wrong.

Defined results: a null or empty text, or one of white space, has no words and no
runs; a null doc_id keeps its row, and no word of it is replaced; repeated rows are
kept; an empty table gives no rows; extra columns of any name are ignored.  Of runs
of equal length the one of the smallest start, then of the smallest period, is the
greatest.  Texts are never cut: the longest one sets a worker's memory, about 100
bytes a word.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import _shared

LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Pairs of a border and a period looked at together; bytes of text whose words are told apart together.
AT_ONCE, STRETCH = 1 << 19, 1 << 20
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SPACE = b" \t\n\r\x0b\x0c"


def least_overlap(words: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> int:
    """The fewest words in which a run of any period overlaps itself, moved by its period."""
    return min(max(words, periods * q) - q for q in range(1, words + 1))


class Words:
    """Numbers of words: equal words of the texts at hand have equal numbers."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def of(self, text: bytes) -> np.ndarray:
        parts, at = [], 0
        while at < len(text):
            end = at + STRETCH
            while end < len(text) and text[end] not in _SPACE:
                end += 1
            words = text[at:end].split()
            parts.append(np.fromiter((self.known.setdefault(w, len(self.known)) for w in words), np.int32, len(words)))
            at = end
        return np.concatenate(parts) if parts else np.empty(0, np.int32)


def unmasked(x: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words that stand in k-grams which their text, between two bounds, holds twice.

    K-grams are told apart by hashes; of two that share one, words are kept for nothing.
    """
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    whole = np.flatnonzero(text[: max(0, len(x) - k + 1)] == text[k - 1 :])
    if not len(whole):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    grams = text[whole].astype(np.uint64)
    for i in range(k):
        grams = (grams ^ grams >> np.uint64(31)) * _P + x[whole + i].astype(np.uint64) * _Q
    order = np.argsort(grams, kind="stable")
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = grams[order[1:]] == grams[order[:-1]]
    again = whole[order[same[1:] | same[:-1]]]
    depth = np.bincount(again, minlength=len(x) + 1) - np.bincount(again + k, minlength=len(x) + 1)
    held = np.concatenate([[False], np.cumsum(depth)[: len(x)] > 0, [False]])
    # A stretch ends where its text does, even if the next text goes on with one.
    edge = held[1:] != held[:-1]
    cut = bounds[1:-1][held[bounds[1:-1]] & held[bounds[1:-1] + 1]]
    starts, ends = np.flatnonzero(edge & held[1:]), np.flatnonzero(edge & held[:-1])
    return np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))


class Stretches:
    """Hashes of stretches of words, by which two of them are compared at once wherever they stand."""

    def __init__(self, x: np.ndarray) -> None:
        v = x.astype(np.uint64)
        v = (v + np.uint64(1)) * _P
        v = (v ^ v >> np.uint64(29)) * _Q
        self.powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(x), _P, np.uint64))])
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((v ^ v >> np.uint64(32)) * self.powers[:-1])])

    def equal(self, at: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the hashes of n words at a place and q words on are equal."""
        return (self.sums[at + n] - self.sums[at]) * self.powers[q] == self.sums[at + q + n] - self.sums[at + q]

    def onward(self, at: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from a place on equal those q words on, at most so many."""
        low, high = np.zeros_like(at), most.copy()
        while (low < high).any():
            middle = (low + high + 1) >> 1
            good = self.equal(at, q, middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low

    def backward(self, at: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words before a place equal those q words on, at most so many."""
        low, high = np.zeros_like(at), most.copy()
        while (low < high).any():
            middle = (low + high + 1) >> 1
            good = self.equal(at - middle, q, middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low


def least_length(q: np.ndarray) -> np.ndarray:
    return np.maximum(LEAST_WORDS, LEAST_PERIODS * q)


def across_borders(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """What may be runs of segments [lo, hi): starts, ends, periods, places that they pass, whether they go on beyond the halves.

    Some are told often, with multiples of a period, or longer than they are.
    """
    hashes = Stretches(x)
    first, last = lo.copy(), hi.copy()  # of the segment that the halves are from
    found: list[list[np.ndarray]] = [[], [], [], [], []]
    while True:
        big = hi - lo >= LEAST_WORDS
        lo, hi, first, last = lo[big], hi[big], first[big], last[big]
        if not len(lo):
            return tuple(np.concatenate(f) if f else np.empty(0, np.int64) for f in found)
        middle = (lo + hi) >> 1
        most = (hi - lo) // LEAST_PERIODS
        upto = np.cumsum(most)
        for begin in range(0, int(upto[-1]), AT_ONCE):
            pair = np.arange(begin, min(begin + AT_ONCE, int(upto[-1])))
            part = np.searchsorted(upto, pair, "right")
            period = pair - (upto[part] - most[part]) + 1
            half = (least_length(period) - period + 1) >> 1  # one side of the border must have as much of the overlap
            low, high, border = lo[part], hi[part], middle[part]
            for at in (border, border - period):
                ahead, behind = high - at - period, at - low
                good = np.flatnonzero((at >= low) & ((ahead >= half) | (behind >= half)))
                n, place, q = half[good], at[good], period[good]
                right, left = ahead[good] >= n, behind[good] >= n
                keep = np.zeros(len(good), bool)
                keep[right] = hashes.equal(place[right], q[right], n[right])
                rest = left & ~keep
                keep[rest] = hashes.equal(place[rest] - n[rest], q[rest], n[rest])
                good = good[keep]
                place, q = at[good], period[good]
                start = place - hashes.backward(place, q, behind[good])
                end = place + q + hashes.onward(place, q, ahead[good])
                before, after = np.maximum(start - 1, 0), np.minimum(end, len(x) - 1)
                wider = (start == low[good]) & (start > first[part[good]]) & (x[before] == x[before + q])
                wider |= (end == high[good]) & (end < last[part[good]]) & (x[after] == x[after - q])
                run = np.flatnonzero(end - start >= least_length(q))
                for f, v in zip(found, (start[run], end[run], q[run], place[run], wider[run]), strict=True):
                    f.append(v)
        lo, hi = np.concatenate([lo, middle]), np.concatenate([middle, hi])
        first, last = np.concatenate([first, first]), np.concatenate([last, last])


def measured(x: np.ndarray, at: int, q: int, lo: int, hi: int) -> tuple[int, int]:
    """Start and end of the stretch of period q around a place, word by word."""
    start, end = at, at + q
    while start > lo and x[start - 1] == x[start - 1 + q]:
        start -= 1
    while end < hi and x[end] == x[end - q]:
        end += 1
    return start, end


def runs_of(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) by start, then period, of all runs of texts whose words stand in x between bounds."""
    lo, hi = unmasked(x, bounds, least_overlap())
    told = across_borders(x, lo, hi)
    order = np.lexsort((told[2], told[1], told[0]))
    start, end, q, at, wider = (v[order] for v in told)
    fresh = np.ones(len(start), bool)
    fresh[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    least: dict[tuple[int, int], int] = {}
    # If the smallest period of a stretch is right, the others are its multiples.
    for first, after in pairwise([*np.flatnonzero(fresh).tolist(), len(start)]):
        for i in range(first, after):
            s, e, p = int(start[i]), int(end[i]), int(q[i])
            if right := np.array_equal(x[s : e - p], x[s + p : e]):
                if wider[i]:  # a wider pair of halves has it
                    break
            else:
                k = int(np.searchsorted(lo, at[i], "right")) - 1
                s, e = measured(x, int(at[i]), p, int(lo[k]), int(hi[k]))
            if e - s >= max(LEAST_WORDS, LEAST_PERIODS * p):
                least[s, e] = min(p, least.get((s, e), p))
            if right:
                break
    return np.array(sorted((s, p, e) for (s, e), p in least.items()), np.int64).reshape(-1, 3)[:, [0, 2, 1]]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which words stay: those that no run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 1], -1)
    return np.cumsum(depth[:n]) == 0


def _joined(ids: np.ndarray, words: list[bytes]) -> Iterator[bytes]:
    """Words joined by one space, in parts."""
    for at in range(0, len(ids), AT_ONCE):
        yield (b" " if at else b"") + b" ".join([words[i] for i in ids[at : at + AT_ONCE].tolist()])


Rewrite = Callable[[int | None, np.ndarray], np.ndarray]

_FIELDS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def _examined(ids: list[int | None], raws: list[bytes], rewrite: Rewrite | None, texts: bool) -> tuple[list[tuple], list[str | None], list[list[tuple[int, int, int]]]]:
    words = Words()
    each = [words.of(raw) for raw in raws]
    if rewrite is not None:
        each = [rewrite(i, x) for i, x in zip(ids, each, strict=True)]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
    runs = runs_of(np.concatenate([*each, np.empty(0, np.int32)]), bounds)
    cuts = np.searchsorted(runs[:, 0], bounds)
    names = list(words.known)
    rows, collapsed, told = [], [], []
    for k, x in enumerate(each):
        own = runs[cuts[k] : cuts[k + 1]] - [bounds[k], bounds[k], 0]
        listed = [(s, e - s, p) for s, e, p in own.tolist()]
        greatest: tuple = (None,) * 4
        if listed:
            s, n, p = min(listed, key=lambda r: (-r[1], r[0], r[2]))
            greatest = (s, n, p, 1000 * n // p)
            x = x[kept_words(len(x), own)]
        digest, parts = hashlib.sha256(), []
        for part in _joined(x, names):
            digest.update(part)
            if texts:
                parts.append(part)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in listed)
        rows.append((len(listed), *greatest, hashlib.sha256(lines.encode()).hexdigest(), digest.hexdigest()))
        collapsed.append(b"".join(parts).decode() if texts else None)
        told.append(listed)
    return rows, collapsed, told


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Rewrite | None = None, texts: bool = False) -> DataFrame:
    """A row for each document: doc_id, n_runs, the greatest run, digests of all runs and of the words that stay.

    With `texts` also `runs`, all of them as (start, length, period), and `collapsed`, the words that stay
    joined by one space.  `rewrite` gets a doc_id and the numbers of its words and may replace them.
    """
    listed = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _shared.slices(whole):
                rows, collapsed, told = _examined(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), rewrite, texts)
                columns = [pa.array([r[i] for r in rows], pa.int64() if i < 5 else pa.string()) for i in range(7)]
                names = ["doc_id", *_FIELDS]
                if texts:
                    columns += [pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in t] for t in told], listed), pa.array(collapsed, pa.string())]
                    names += ["runs", "collapsed"]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], names)

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    schema += ", runs array<struct<start: long, length: long, period: long>>, collapsed string" if texts else ""
    return _shared.texts_of(docs, id_col, text_col).mapInArrow(run, schema)


def repeating_tail(doc_id: int | None, x: np.ndarray) -> np.ndarray:
    """The words of the contract of `op11_periodic_runs`: of one document in ten, by the crc32 of its id, the tail repeats itself."""
    h, n = (1, 0) if doc_id is None else (zlib.crc32(str(doc_id).encode()), len(x))
    if h % 10 or not n:
        return x
    g = h // 10
    a = g % n
    return np.concatenate([x[:a], np.resize(x[a : a + 1 + (n - a) // (3 + g % 8)], n - a)])


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_runs(_shared.read_table(spark, sf_dir, "documents"), rewrite=repeating_tail)


#: Words of equal 5-grams joined with one another, as far apart as a period may be, and consecutive pairs gathered.
SQL = r"""WITH RECURSIVE k(i, v) AS (SELECT 0, CAST(unnest(range(256)) AS BIGINT)),
bits(n, i, v) AS (SELECT 0, v, v FROM k UNION ALL SELECT n + 1, i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE n < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE n = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda s, c: xor(s >> 8, t[CAST(xor(s, c) & 255 AS INTEGER) + 1])), 4294967295) AS h FROM documents, crc),
e AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
f AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM e WHERE h % 10 = 0 AND n > 0),
x AS (SELECT r, i, CAST(n AS BIGINT) AS n, CASE WHEN i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS w FROM (SELECT r, n, w, a, p, unnest(range(n)) AS i FROM f)
  UNION ALL SELECT r, unnest(range(n)), CAST(n AS BIGINT), unnest(w) FROM e WHERE NOT coalesce(h % 10 = 0, FALSE)),
y AS (SELECT r, i, n, hash(w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS k FROM x WINDOW o AS (PARTITION BY r ORDER BY i) QUALIFY lead(w, 4) OVER o IS NOT NULL),
z AS (SELECT b.r, b.i, c.i - b.i AS q FROM y b JOIN y c ON b.r = c.r AND b.k = c.k AND c.i > b.i AND 4 * (c.i - b.i) <= b.n),
u AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS part FROM z),
v AS (SELECT r, q, min(i) AS s, count(*) + 4 + q AS l FROM u GROUP BY r, q, part HAVING count(*) + 4 + q >= greatest(6, 4 * q)),
runs AS (SELECT r, s, l, min(q) AS q FROM v GROUP BY r, s, l),
top AS (SELECT r, count(*) AS n_runs, first(s ORDER BY l DESC, s, q) AS start, first(l ORDER BY l DESC, s, q) AS length, first(q ORDER BY l DESC, s, q) AS period, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS told FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS t FROM x ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM e LEFT JOIN top USING (r) LEFT JOIN kept USING (r)"""
