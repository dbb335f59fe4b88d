"""Quality rules: counts by rule, and a calibrated logistic regression over hashed n-grams.

The rules count words, symbols, repeated lines and repeated three-word windows of
the whole text.  The classifier hashes word unigrams and bigrams and character
n-grams of ``CHAR_NGRAMS`` code points into a fixed number of buckets; a text's score is the
mean weight of each kind of n-gram, summed.  It is fitted on at most ``SAMPLE``
labelled rows, those with the smallest hash of their id, of either label half as
far as it has so many; of each label, every ``CALIBRATE``-th by that order is left
out of the fit and used for Platt scaling, weighted by the shares of the labels in
all labelled rows.  Every document is scored in Arrow batches, and kept if its calibrated
probability of good quality is at least ``THRESHOLD``.

Defined results: a null text is empty, has no words and so fails the rules;
labels that are null, or whose document is missing, aren't used; of several
labels of an id the smallest counts, and of several texts the smallest;
with fewer than ``LEAST`` rows of either label, in all, nothing can be learnt, and the
rules alone decide; an empty table gives no rows; extra columns are ignored by
`quality_rows` and kept by `keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _shared

SAMPLE, CALIBRATE, LEAST, THRESHOLD = 4_000, 4, 4, 0.5
BITS, CHAR_NGRAMS, EPOCHS, RATE, DECAY = 17, (2, 3, 4), 6, 2.0, 1e-5
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Characters of a text that are hashed at once.
AT_ONCE = 1 << 20
_SPACE, _SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
#: Odd multipliers of the hashes.
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))


def rule_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8."""
    words = raw.split()
    solid = raw.translate(None, _SPACE)
    chars = int((np.frombuffer(solid, np.uint8) & 0xC0 != 0x80).sum())
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACE)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a three-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    first: dict[tuple, int] = {}
    again = [first.setdefault(w, i) for i, w in enumerate(windows)]
    if len(first) == len(windows):
        return 0
    at = np.asarray(again)
    repeats = np.flatnonzero(at != np.arange(len(at)))
    held = np.zeros(len(words), bool)
    for i in (repeats, np.unique(at[repeats])):
        for k in range(3):
            held[i + k] = True
    return int(held.sum())


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > MOST_REPEATED * n_words


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])


_up, _down = _powers(_P, 1 << 12), _powers(_INVERSE, 1 << 12)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _up, _down
    if len(_up) <= n:
        _up, _down = _powers(_P, 2 * n), _powers(_INVERSE, 2 * n)
    return _up, _down


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h * _Q >> np.uint64(64 - BITS)).astype(np.int64)


def hashed_ngrams(text: str) -> Iterator[list[np.ndarray]]:
    """Buckets of the n-grams of each kind: words (unigrams and bigrams), then characters by length.

    A long text comes in parts; words and n-grams that go on past a border are whole all the same.
    """
    most = max(CHAR_NGRAMS)
    open_hash, open_size, before = np.zeros(1, np.uint64), 0, np.empty(0, np.uint64)
    for at in range(0, max(1, len(text)), AT_ONCE):
        x = np.frombuffer(text[at : at + AT_ONCE + most - 1].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        own = x[:AT_ONCE]
        solid = ~((own == 32) | ((own >= 9) & (own <= 13)))
        edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = _grown(len(own) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((own + np.uint64(1)) * up[: len(own)])])
        words = (sums[end] - sums[begin]) * down[begin]
        if open_size and len(begin) and begin[0] == 0:  # the word before the border goes on
            words[:1] = open_hash + words[:1] * np.uint64(pow(int(_P), open_size, 1 << 64))
            begin[0] = -open_size
        elif open_size:
            words = np.concatenate([open_hash, words])
        open_size = 0
        if len(end) and end[-1] == len(own) and at + AT_ONCE < len(text):  # so may the last one
            open_hash, open_size, words = words[-1:], int(end[-1] - begin[-1]), words[:-1]
        row = np.concatenate([before, words])
        pairs = (row[:-1] * _P + row[1:]) * _P + np.uint64(1)
        before = row[-1:]
        out = [_bucket(np.concatenate([words, pairs]))]
        for n in CHAR_NGRAMS:
            size = max(0, min(len(own), len(x) - n + 1))
            g = np.full(size, n, np.uint64)
            for k in range(n):
                g = g * _P + x[k : size + k]
            out.append(_bucket(g))
        yield out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def raw_score(self, raw: bytes) -> float:
        totals, counts = np.zeros(len(self.weights)), np.zeros(len(self.weights))
        for part in hashed_ngrams(raw.decode()):
            for i, b in enumerate(part):
                totals[i] += self.weights[i][b].sum(dtype=np.float64)
                counts[i] += len(b)
        return float(self.bias + (totals / np.maximum(counts, 1)).sum())

    def probability(self, raw: bytes) -> float:
        return float(_sigmoid(self.slope * self.raw_score(raw) + self.offset))


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def sparse(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct positions in the flattened weights and their values, which sum to 1 in each kind."""
    kinds: list[np.ndarray] = [np.zeros(1 << BITS) for _ in range(1 + len(CHAR_NGRAMS))]
    for part in hashed_ngrams(raw.decode()):
        for i, b in enumerate(part):
            kinds[i] += np.bincount(b, minlength=1 << BITS)
    at, values = [], []
    for i, k in enumerate(kinds):
        used = np.flatnonzero(k)
        at.append(used + (i << BITS))
        values.append(k[used] / max(1.0, k.sum()))
    return np.concatenate(at).astype(np.int32), np.concatenate(values).astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, given: tuple[int, int] | None = None) -> Model | None:
    """Logistic regression by adaptive gradients, then Platt scaling on the rows left out; rows come in the order of their hash.

    `given` has how many rows of labels 0 and 1 these were drawn from, if not all were taken.
    """
    if min((labels == 0).sum(), (labels == 1).sum()) < LEAST:
        return None
    left = np.zeros(len(rows), bool)
    for k in (0, 1):
        left[np.flatnonzero(labels == k)[CALIBRATE - 1 :: CALIBRATE]] = True
    w, seen, bias = np.zeros((1 + len(CHAR_NGRAMS)) << BITS, np.float32), None, 0.0
    seen = np.full(len(w), 1e-8, np.float32)
    balance = np.where(labels == 1, 0.5 / (labels == 1).mean(), 0.5 / (labels == 0).mean())
    order, dice = np.flatnonzero(~left), np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in dice.permutation(order):
            at, v = rows[i]
            error = float(_sigmoid(w[at] @ v + bias) - labels[i]) * balance[i]
            g = error * v + DECAY * w[at]
            seen[at] += g * g
            w[at] -= RATE * g / np.sqrt(seen[at]) * 0.1
            bias -= 0.05 * error
    scores = np.array([w[at] @ v + bias for at, v in rows])
    stands = [1.0, 1.0] if given is None else [given[k] / (labels == k).sum() for k in (0, 1)]
    weights = np.where(labels == 1, stands[1], stands[0])
    slope, offset = platt(scores[left], labels[left], (weights / weights.mean())[left])
    return Model(w.reshape(-1, 1 << BITS), bias, slope, offset)


def platt(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability, by Newton steps on smoothed targets; a row counts by its weight."""
    good, bad = int((labels == 1).sum()), int((labels == 0).sum())
    if not good or not bad:
        return 1.0, 0.0
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    theta, x = np.array([1.0, 0.0]), np.stack([scores, np.ones(len(scores))], 1)
    loss = lambda t: -float((weights * (target * np.log(_sigmoid(x @ t) + 1e-12) + (1 - target) * np.log(1 - _sigmoid(x @ t) + 1e-12))).sum())
    for _ in range(50):
        p = _sigmoid(x @ theta)
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (weights * (p - target)))
        size = 1.0
        while size > 1e-4 and loss(theta - size * step) > loss(theta):
            size /= 2
        theta = theta - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """Fit on a bounded sample: `sample` labelled rows at most reach the driver, as hashed counts."""
    given = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label"))
    given = given.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    given = _shared.materialize(given.withColumn("draw", F.xxhash64(F.lit("quality"), "doc_id")), "quality-labels")
    counts = {r.label: r["count"] for r in given.groupBy("label").count().collect()}
    parts = [given.where(F.col("label") == k).orderBy("draw", "doc_id").limit(sample) for k in (0, 1)]
    place = F.row_number().over(Window.partitionBy("label").orderBy("draw", "doc_id"))  # `sample` rows of each at most
    chosen = parts[0].unionByName(parts[1]).withColumn("place", place).orderBy("place", "label").limit(sample).drop("place")
    chosen = _shared.materialize(chosen, "quality-sample")
    texts = _shared.texts_of(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"), F.first("draw").alias("draw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _shared.slices(whole.select(["text", "label", "draw", "doc_id"]), "text"):
                found = [sparse(t) for t in b.column(0).cast(pa.binary()).to_pylist()]
                at, v = [pa.array([x[i].tobytes() for x in found], pa.binary()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([at, v, b.column(1), b.column(2), b.column(3)], ["at", "v", "label", "draw", "doc_id"])

    rows = texts.mapInArrow(run, "at binary, v binary, label int, draw long, doc_id long").collect()
    rows.sort(key=lambda r: (r.draw, r.doc_id))
    return fit([(np.frombuffer(r["at"], np.int32), np.frombuffer(r["v"], np.float32)) for r in rows], np.array([r.label for r in rows]), (counts.get(0, 0), counts.get(1, 0)))


def verdict(raw: bytes, n_words: int, n_repeat_words: int, model: Model | None, threshold: float) -> tuple[bool, bool, float | None]:
    """base_failed, kept, probability (null where the model isn't asked)."""
    if base_failed(n_words, n_repeat_words):
        return True, False, None
    p = None if model is None else model.probability(raw)
    return False, p is None or p >= threshold, p


def quality_rows(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, the counts, base_failed, kept, probability."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _shared.slices(whole):
                raws = b.column(1).cast(pa.binary()).to_pylist()
                counts = [rule_counts(r) for r in raws]
                said = [verdict(r, c[0], c[4], model, threshold) for r, c in zip(raws, counts, strict=True)]
                columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(5)]
                columns += [pa.array([s[i] for s in said], kind) for i, kind in enumerate((pa.bool_(), pa.bool_(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", *names, "base_failed", "kept", "probability"])

    schema = ", ".join(["doc_id long", *(f"{n} long" for n in names), "base_failed boolean", "kept boolean", "probability double"])
    return _shared.texts_of(docs, id_col, text_col).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents that the rules and the model keep, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _shared.slices(whole, text_col):
                kept = []
                for raw in b.column(at).cast(pa.binary()).to_pylist():
                    c = rule_counts(raw or b"")
                    kept.append(verdict(raw or b"", c[0], c[4], model, threshold)[1])
                yield b.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _shared.read_table(spark, sf_dir, "documents"), _shared.read_table(spark, sf_dir, "labels")
    return quality_rows(docs, train(docs, labels))


def quality_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules alone say of every document, which SQL can express."""
    rows = quality_rows(_shared.read_table(spark, sf_dir, "documents"), None)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
h AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM g, range(0, 3) x(k) WHERE n > 1 GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN h USING (r) LEFT JOIN l USING (r))
SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM c"""
