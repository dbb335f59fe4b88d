"""Periodic runs of words against a plain search."""

import hashlib
import random

import numpy as np
import pytest

from corpusloom.llm import op11_runs as R


def plain_runs(x):
    """(start, period, end) of every run, by trying every period at every place."""
    found = {}
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i < len(x) - q:
            j = i
            while j < len(x) - q and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, q, e) for (s, e), q in found.items())


def some_words(dice):
    n, k = dice.choice([0, 1, 5, 6, 7, 12, 40, 90]), dice.choice([1, 2, 3, 5, 30])
    x = [dice.randrange(k) for _ in range(n)]
    if n and dice.random() < 0.6:
        a, p = dice.randrange(n), dice.randint(1, max(1, n // 3))
        x = x[:a] + [x[min(n - 1, a + (i - a) % p)] for i in range(a, n)]
    return x


def found(texts):
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    runs = R.runs_of(np.array(sum(texts, []), np.int32), bounds)
    return [(s, q, e) for s, e, q in runs.tolist()], [(s + b, q, e + b) for x, b in zip(texts, bounds, strict=False) for s, q, e in plain_runs(x)]


def test_runs():
    dice = random.Random(11)
    for _ in range(1500):
        got, want = found([some_words(dice) for _ in range(dice.randint(1, 4))])
        assert got == want


def test_hashes_may_be_wrong(monkeypatch):
    """Stretches of as many odd numbers are taken for equal."""

    def weak(self, x):
        self.powers = np.ones(len(x) + 1, np.uint64)
        self.sums = np.concatenate([[0], np.cumsum(x % 2)]).astype(np.uint64)

    monkeypatch.setattr(R.Stretches, "__init__", weak)
    dice = random.Random(12)
    for _ in range(1500):
        got, want = found([some_words(dice)])
        assert got == want


def test_least_overlap():
    assert R.least_overlap() == 5 and R.least_overlap(6, 2) == 3


def test_masks_leave_little():
    """Words outside repeated k-grams cost no search."""
    x = np.arange(100_000)
    x[500:540] = np.arange(40) % 4
    lo, hi = R.unmasked(x, np.array([0, len(x)]), R.least_overlap())
    assert lo.tolist() == [500] and hi.tolist() == [540]


def test_repeating_tail():
    x = np.arange(50)
    ids = [i for i in range(200) if R.zlib.crc32(str(i).encode()) % 10 == 0]
    assert ids and all((R.repeating_tail(i, x) != x).any() or R.zlib.crc32(str(i).encode()) // 10 % 50 >= 48 for i in ids)
    assert R.repeating_tail(None, x) is x and R.repeating_tail(ids[0], x[:0]) is not None


@pytest.fixture(scope="module")
def odd_runs(spark):
    rows = [(1, "a b a b a b a b c"), (1, "a b a b a b a b c"), (2, None), (3, ""), (4, " \n "), (None, "z " * 9), (5, "x y " * 3 + "q\x0bq q q q\nq"), (6, "tie " * 6 + "- " + "two " * 6)]
    return spark.createDataFrame([(i, t, "k", 3) for i, t in rows], "doc_id long, text string, n_runs string, start int")


def test_odd_rows(odd_runs):
    got = sorted(R.find_runs(odd_runs, texts=True).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.collapsed))
    by = {r.doc_id: r for r in got}
    assert len(got) == 8 and got[0] == got[1]
    assert (by[1].n_runs, by[1].start, by[1].length, by[1].period, by[1].exponent_milli, by[1].collapsed) == (1, 0, 8, 2, 4000, "a b c")
    for i in (2, 3, 4):
        assert (by[i].n_runs, by[i].start, by[i].collapsed, by[i].runs_sha256) == (0, None, "", hashlib.sha256(b"").hexdigest())
    assert (by[None].length, by[None].collapsed) == (9, "z")
    assert by[5].collapsed == "x y x y x y q" and by[5].runs == [(6, 6, 1)]
    assert (by[6].n_runs, by[6].start, by[6].collapsed) == (2, 0, "tie - two")
    assert by[6].runs_sha256 == hashlib.sha256(b"0,6,1\n7,6,1\n").hexdigest()
    assert all(r.collapsed_sha256 == hashlib.sha256(r.collapsed.encode()).hexdigest() for r in got)
    assert R.find_runs(odd_runs.limit(0)).count() == 0


def test_long_texts(spark, monkeypatch):
    """Words that stand across stretches of a text are whole, and parts of what stays are joined alike."""
    monkeypatch.setattr(R, "STRETCH", 7)
    assert R.Words().of(b"aa bbbbbbbbbbbb aa  \ncc bbbbbbbbbbbb").tolist() == [0, 1, 0, 2, 1]
    monkeypatch.setattr(R, "AT_ONCE", 3)
    rows, kept, _ = R._examined([7], [b"one two three four five six seven " * 5], None, True)
    assert rows[0][:5] == (1, 0, 35, 7, 5000) and kept == ["one two three four five six seven"]
