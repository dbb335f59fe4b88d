"""The quality classifier against plain loops, and on rows that it hasn't seen."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from corpusloom.llm import op12_classifier as C

M = (1 << 64) - 1
P, Q, SAME = int(C._P), int(C._Q), int(C._SAME)


def plain_vector(text):
    """Values by bucket, n-gram by n-gram with Python's integers."""
    words, values = text.split(), Counter()
    hashes = [[xxh64_intdigest(w) for w in words], [xxh64_intdigest(C.form_of(w), 1) for w in words]]
    hashes[1] = [f ^ (SAME if i and words[i] == words[i - 1] else 0) for i, f in enumerate(hashes[1])]
    for kind, row in enumerate(hashes):
        grams = row + [(a * P + b + 2) & M for a, b in zip(row, row[1:], strict=False)]
        for h in grams:
            values[((h ^ h >> 32) * Q & M) >> (65 - C.BITS) | kind << C.BITS - 1] += C.LENGTH / len(grams)
    return values


TEXTS = [b"", b" \n ", b"One", b"one one one two", "Straße ÉTÉ 9to5 !!! a$$$ b%%%".encode(), b"x " * 50 + b"tail\x0bof it", b"the end"]


def test_vectors():
    for text in TEXTS:
        at, v = C.sparse(text, C.Words())
        want = plain_vector(text)
        assert at.tolist() == sorted(want) and np.allclose(v, [want[k] for k in sorted(want)], rtol=1e-5)


def test_forms():
    assert [C.form_of(w) for w in (b"Word,", b"LOUD!!", b"a$$$", "été42".encode(), b"aB3")] == [b"Xx,", b"X!", b"x$", b"yxy9", b"xX9"]


def test_scores_in_parts(monkeypatch):
    """Scores of many texts at once are the dot products of their vectors, wherever parts end."""
    model = C.Model(np.random.default_rng(1).normal(size=1 << C.BITS).astype(np.float32), 0.3)
    want = [C._logistic(0.3 + sum(model.weights[k] * v for k, v in plain_vector(t).items())) for t in TEXTS]
    for part, known in ((1 << 21, 200_000), (7, 2), (1, 0)):
        monkeypatch.setattr(C, "PART", part)
        monkeypatch.setattr(C, "MOST_KNOWN", known)
        assert np.allclose(model.scores(TEXTS, C.Words()), want, rtol=1e-5)


def test_leader():
    """The updates of one coordinate, step by step."""
    leader, z, n = C.Leader(1), 0.0, 0.0
    for label, x in ((1, 0.5), (0, 2.0), (1, 1.0), (1, 3.0)):
        w = 0.0 if abs(z) <= C.L1 else -(z - math.copysign(C.L1, z)) / ((C.BETA + math.sqrt(n)) / C.ALPHA + C.L2)
        g = (1 / (1 + math.exp(-w * x)) - label) * x
        z, n = z + g - (math.sqrt(n + g * g) - math.sqrt(n)) / C.ALPHA * w, n + g * g
        leader.learn(np.array([0]), np.array([x]), label, 1.0)
        assert math.isclose(leader.z[0], z) and math.isclose(leader.n[0], n)


def test_too_few_labels():
    model = C.fit([C.sparse(b"a", C.Words())] * 3, np.array([1, 1, 0]), (1, 3))
    assert not model.weights.any() and math.isclose(C._logistic(model.bias), 0.75, abs_tol=1e-5)
    assert C._logistic(C.fit([], np.empty(0, np.int64)).bias) == 0.5


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")]


def test_rows_not_learnt_from(spark, tables):
    docs, labels = tables
    got = C.op12_quality_classifier(spark, "/root/testdata/sf0.01")
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    rows = got.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in rows)
    unseen = [r for r in rows if r.held_out]
    bad, good = ([r for r in unseen if r.quality == k] for k in (0, 1))
    assert min(len(bad), len(good)) >= 5
    assert sum(r.predicted for r in good) >= 0.97 * len(good) and sum(r.predicted for r in bad) <= 0.15 * len(bad)


def test_held_out_labels_do_not_matter(spark, tables):
    from pyspark.sql import functions as F

    docs, labels = tables
    learn = ~C.held_out(F.col("doc_id"))
    turned = labels.withColumn("quality", F.when(C.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, other = (C.train(docs, x, learn=learn) for x in (labels, turned))
    assert (one.weights == other.weights).all() and one.bias == other.bias


def test_bounded_sample(spark, tables, monkeypatch):
    """At most `sample` rows and `most_bytes` of text are learnt from, whatever there is."""
    seen = []
    fit = C.fit
    monkeypatch.setattr(C, "fit", lambda rows, labels, given: seen.append((len(rows), sum(labels), given)) or fit(rows, labels, given))
    docs, labels = tables
    C.train(docs, labels, sample=40)
    C.train(docs, labels, most_bytes=40_000)
    assert seen[0][0] == 40 and seen[0][1] == 20 and sum(seen[0][2]) == labels.count()
    assert 8 <= seen[1][0] < 60


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 0), (None, 1), (9, 1), (4, None), (7, 5)], "doc_id long, quality int")
    model = C.train(odd_docs, labels)
    got = C.score_rows(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and {r.score for r in got} == {C._logistic(model.bias)}
    model = C.Model(np.ones(1 << C.BITS, np.float32), -1.0)
    by = {r.doc_id: r for r in C.score_rows(odd_docs, model).collect()}
    assert by[3].score == by[4].score == by[6].score == C._logistic(-1.0) and by[5].score > 0.9 and by[3].predicted == 0
    assert None in by and C.score_rows(no_docs, model).count() == 0 and not C.train(no_docs, labels).weights.any()
