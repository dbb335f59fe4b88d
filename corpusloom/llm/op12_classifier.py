"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

A word counts as it stands and by its form: runs of capitals, small letters, digits
and characters beyond ASCII become X, x, 9 and y, other characters stay, and each run of one character is told
once, with a mark for words equal to the one before.  N-grams of up to ``NGRAMS``
words and of forms are hashed into ``1 << BITS`` buckets; a text is the sparse vector
of its buckets' shares of all n-grams, of words and of forms, and its score is
the logistic function of a sparse dot product with the weights.

Weights are learnt from at most ``SAMPLE`` labelled rows and ``MOST_BYTES`` of text,
those of the smallest hash of their id that fit, of either label half as far as it has
so many, in ``PASSES`` passes of
per-coordinate FTRL-proximal updates (``ALPHA``, ``BETA``, ``L1``, ``L2``).  Rows of a
label weigh as the label's share in all labelled rows has it, so scores are
probabilities of the labelled table.  Sampled texts are hashed by tasks; the driver
gets their sparse vectors.  All documents are scored in Arrow batches.

Defined results: a null or empty text, or one of white space, has the score of the
bias alone; labels that are null or other than 0 and 1, or whose document is missing,
aren't used; of several labels of an id the smallest counts, and of several texts the
smallest; with fewer than ``LEAST`` rows of either label nothing is learnt and every
score is the share of label 1 (0.5 without labels); a null doc_id keeps its row and
isn't learnt from; repeated rows are kept; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import _shared

SAMPLE, MOST_BYTES, LEAST = 4_000, 24_000_000, 4
BITS, NGRAMS, LENGTH = 20, 2, 10.0
ALPHA, BETA, L1, L2, PASSES = 1.0, 1.0, 0.05, 0.02, 6
THRESHOLD, FOLDS, HELD_OUT = 0.3, 5, 0
#: Bytes of text that are hashed at once; distinct words that a worker remembers, but for those of such a part.
PART, MOST_KNOWN = 1 << 21, 200_000
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SAME = np.uint64(0xD6E8FEB86659FD93)
_SPACE = b" \t\n\r\x0b\x0c"


def _kinds() -> bytes:
    """Capitals, small letters, digits and bytes beyond ASCII to X, x, 9 and y; all else stays."""
    table = bytearray(range(256))
    for chars, kind in ((range(65, 91), "X"), (range(97, 123), "x"), (range(48, 58), "9"), (range(128, 256), "y")):
        for c in chars:
            table[c] = ord(kind)
    return bytes(table)


KINDS = _kinds()
_RUNS = re.compile(rb"(.)\1+", re.S)


def form_of(word: bytes) -> bytes:
    return _RUNS.sub(rb"\1", word.translate(KINDS))


class Words(dict):
    """Numbers of words; a number's hashes of the word and of its form are at its place in two arrays."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes: list[tuple[int, int]] = []
        self.told = np.empty((0, 2), np.uint64)

    def __missing__(self, word: bytes) -> int:
        self.hashes.append((xxh64_intdigest(word), xxh64_intdigest(form_of(word), 1)))
        self[word] = len(self.hashes) - 1
        return len(self.hashes) - 1

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of words and of their forms."""
        if len(self) > MOST_KNOWN:
            self.clear()
            self.hashes, self.told = [], np.empty((0, 2), np.uint64)
        at = np.array([self[w] for w in words], np.int64)
        if len(self.hashes) > len(self.told):
            self.told = np.concatenate([self.told, np.array(self.hashes[len(self.told) :], np.uint64).reshape(-1, 2)])
        return self.told[at, 0], self.told[at, 1]


def parts_of(texts: list[bytes]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words of texts, some PART bytes at a time, and the number of the text of each; words across a border are whole."""
    words: list[bytes] = []
    of: list[np.ndarray] = []
    size = 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = at + PART
            while end < len(text) and text[end] not in _SPACE:
                end += 1
            new = text[at:end].split()
            words += new
            of.append(np.full(len(new), i))
            size += min(end, len(text)) - at
            at = end
            if size >= PART:
                yield words, np.concatenate(of)
                words, of, size = [], [], 0
    if words:
        yield words, np.concatenate(of)


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * _Q
    return (h >> np.uint64(64 - BITS + 1)).astype(np.int64) + (kind << BITS - 1)


def ngrams(texts: list[bytes], words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """N-grams of words (kind 0, the lower half of all buckets) and of forms (kind 1, the upper half): kind, the text of each, its bucket.

    Words go on from part to part, so none is lost there.
    """
    old = [np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)]
    for part, of in parts_of(texts):
        plain, form = words.of(part)
        k, own = len(old[2]), np.concatenate([old[2], of])
        plain = np.concatenate([old[0], plain])
        same = (np.diff(plain, prepend=plain[:1]) == 0) & (np.diff(own, prepend=-1) == 0)
        form = np.concatenate([old[1], form ^ np.where(same[k:], _SAME, np.uint64(0))])
        for kind, row in enumerate((plain, form)):
            gram = row
            for n in range(1, NGRAMS + 1):
                if n > 1:
                    gram = gram[:-1] * _P + row[n - 1 :] + np.uint64(n)
                first = max(0, k - n + 1)
                whole = own[first : len(own) - n + 1] == own[first + n - 1 :]
                yield kind, own[first + n - 1 :][whole], _bucket(gram[first:][whole], kind)
        old = [r[max(0, len(r) - NGRAMS + 1) :] for r in (plain, form, own)]


def sparse(text: bytes, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text, ascending, and their values: shares of all n-grams of words or of forms, times ``LENGTH``."""
    at, n = np.empty(0, np.int64), np.empty(0, np.int64)
    for _, _, buckets in ngrams([text], words):
        new, count = np.unique(buckets, return_counts=True)
        at, place = np.unique(np.concatenate([at, new]), return_inverse=True)
        n = np.bincount(place, np.concatenate([n, count]), minlength=len(at)).astype(np.int64)
    v, cut = n * float(LENGTH), int(np.searchsorted(at, 1 << BITS - 1))
    for half in (slice(0, cut), slice(cut, None)):
        v[half] /= max(1, n[half].sum())
    return at.astype(np.int32), v.astype(np.float32)


def _logistic(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[bytes], words: Words) -> np.ndarray:
        """Dot products of the weights with the texts' sparse vectors, all texts at once."""
        sums, totals = np.zeros((2, len(texts))), np.zeros((2, len(texts)))
        for kind, of, buckets in ngrams(texts, words):
            sums[kind] += np.bincount(of, self.weights[buckets], minlength=len(texts))
            totals[kind] += np.bincount(of, minlength=len(texts))
        return _logistic(self.bias + (LENGTH * sums / np.maximum(totals, 1)).sum(axis=0))


class Leader:
    """Follow the regularised leader, each coordinate at its own rate: weights follow from sums of gradients (z) and of their squares (n)."""

    def __init__(self, size: int) -> None:
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) > L1, w, 0.0)

    def learn(self, at: np.ndarray, v: np.ndarray, label: int, weight: float) -> None:
        """One row; `at` has distinct places."""
        w = self.weights(at)
        g = (_logistic(float(w @ v)) - label) * weight * v
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, given: tuple[int, int] | None = None) -> Model:
    """Weights from sparse rows; `given` has how many rows of labels 0 and 1 there are in all, if these are some of them."""
    drawn = np.bincount(labels, minlength=2)[:2] if len(labels) else np.zeros(2, np.int64)
    given = np.array(drawn if given is None else given, float)
    if drawn.min() < LEAST:
        share = given[1] / given.sum() if given.sum() else 0.5
        return Model(np.zeros(1 << BITS, np.float32), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    weight = given / np.maximum(drawn, 1)
    weight /= weight[labels].mean()
    leader, dice, last = Leader((1 << BITS) + 1), np.random.default_rng(12), np.array([1 << BITS])
    for _ in range(PASSES):
        for i in dice.permutation(len(rows)):
            at, v = rows[i]
            leader.learn(np.concatenate([at, last]), np.append(v, 1.0), int(labels[i]), float(weight[labels[i]]))
    w = leader.weights(slice(None))
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def _fitting(texts: DataFrame, most_bytes: int) -> list[int]:
    """Ids of sampled rows in the order of their hash, passing over those that no longer fit into half of `most_bytes` for each label."""
    held, ids = {0: 0, 1: 0}, []
    for r in sorted(texts.select("draw", "doc_id", "label", "size").collect()):  # as many rows as the sample at most
        if held[r.label] + r.size <= most_bytes // 2:
            held[r.label] += r.size
            ids.append(r.doc_id)
    return ids


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", learn: Column | None = None, most_bytes: int = MOST_BYTES) -> Model:
    """Fit on at most `sample` rows and `most_bytes` of text, of those for which `learn`, an expression over doc_id, is true."""
    given = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label"))
    given = given.where("doc_id IS NOT NULL AND label IN (0, 1)")
    given = (given if learn is None else given.where(learn)).groupBy("doc_id").agg(F.min("label").alias("label"))
    given = _shared.materialize(given.withColumn("draw", F.xxhash64(F.lit("classifier"), "doc_id")), "classifier-labels")
    counts = {r.label: r["count"] for r in given.groupBy("label").count().collect()}
    parts = [given.where(F.col("label") == k).orderBy("draw", "doc_id").limit(sample) for k in (0, 1)]
    place = F.row_number().over(Window.partitionBy("label").orderBy("draw", "doc_id"))  # `sample` rows of each at most
    chosen = parts[0].unionByName(parts[1]).withColumn("place", place).orderBy("place", "label").limit(sample).drop("place")
    chosen = _shared.materialize(chosen, "classifier-sample")
    texts = _shared.texts_of(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"), F.first("draw").alias("draw"))
    texts = _shared.materialize(texts.withColumn("size", F.octet_length("text")), "classifier-texts")
    fitting = texts.where(F.col("doc_id").isin(_fitting(texts, most_bytes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for whole in batches:
            for b in _shared.slices(whole.select(["text", "label", "draw", "doc_id"]), "text"):
                found = [sparse(t, words) for t in b.column(0).cast(pa.binary()).to_pylist()]
                at, v = [pa.array([x[i].tobytes() for x in found], pa.binary()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([at, v, b.column(1), b.column(2), b.column(3)], ["at", "v", "label", "draw", "doc_id"])

    rows = fitting.mapInArrow(run, "at binary, v binary, label int, draw long, doc_id long").collect()
    rows.sort(key=lambda r: (r.draw, r.doc_id))
    return fit([(np.frombuffer(r["at"], np.int32), np.frombuffer(r["v"], np.float32)) for r in rows], np.array([r.label for r in rows], np.int64), (counts.get(0, 0), counts.get(1, 0)))


def held_out(doc_id: Column) -> Column:
    """Whether the crc32 of the id's digits, none for a null id, leaves ``HELD_OUT`` over modulo ``FOLDS``."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def score_rows(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, held_out, score, predicted."""
    width = 1 << 12  # weights are mostly zero; only blocks with others are sent along
    blocks = {i: b for i, b in enumerate(model.weights.reshape(-1, width)) if b.any()}
    bias = model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(1 << BITS, np.float32)
        for i, b in blocks.items():
            weights[i * width : (i + 1) * width] = b
        own, words = Model(weights, bias), Words()
        for whole in batches:
            for b in _shared.slices(whole):
                found = own.scores(b.column(1).cast(pa.binary()).to_pylist(), words)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    rows = _shared.texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _shared.read_table(spark, sf_dir, "documents"), _shared.read_table(spark, sf_dir, "labels")
    return score_rows(docs, train(docs, labels, learn=~held_out(F.col("doc_id"))))
