"""Divergence of sources against a plain computation with Python's integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import op13_divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, least=3, top=200):
    """(lang, source, part, item, value, rank) of rows (text, lang, source)."""
    n, holders, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        n[lang, source].update(terms)
        holders[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, k in holders[lang].items() if k >= least)
        share = lambda counts: {t: 1 + 10**9 * (counts[t] + 1) // (sum(counts[x] for x in kept) + len(kept)) for t in kept}  # noqa: B023, E731
        p, q = {s: share(n[lang, s]) for s in sources}, share(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(found, 1) if part == "pair" or i <= top]
    return sorted(out)


def some_rows(seed, k=120):
    dice = random.Random(seed)
    words = ["a", "Ab", "aB", "élan", "ÉLAN", "x\x00y", "don't", "中文", "ﬀ", "9to5", *(f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8))]
    rows = [(" ".join(dice.choices(words[: 8 + 60 * (i % 2)], k=dice.randrange(30))), dice.choice(["en", "de", None]), dice.choice(["s1", "s2", "é", None, "", "Z"])) for i in range(k)]
    rows += [(None, "fr", "only"), ("", "fr", "other"), ("rare words", "it", "a"), ("rare words", "it", "b"), ("123 !?", "pt", "one")]
    return [*rows, rows[0], rows[0]]


def got(spark, rows, **kw):
    docs = spark.createDataFrame([(t, lang, s, 1, "t", 2) for t, lang, s in rows], "text string, lang string, source string, n int, term string, block int")
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in D.divergences(docs, **kw).collect())


def test_against_plain(spark):
    rows = some_rows(1)
    want = plain(rows)
    assert {"pair", "term"} == {r[2] for r in want} and ("it", "a", "pair", "b", 0, 1) in want
    assert got(spark, rows) == want


def test_many_tiles(spark, monkeypatch):
    """Tiles of a few cells, differences and texts in small parts, and counts passed on early."""
    rows = some_rows(2)
    want = plain(rows, top=3)
    for name, value in (("CELLS", 40), ("AT_ONCE", 50), ("STRETCH", 5), ("MOST_TERMS", 7), ("BATCH", 3)):
        monkeypatch.setattr(D, name, value)
    assert got(spark, rows, top=3) == want


def test_no_rows(spark):
    docs = spark.createDataFrame([], "text string, lang string, source string")
    assert D.divergences(docs).count() == 0 and D.divergences(docs).columns == ["lang", "source", "part", "item", "value", "rank"]


def test_terms_across_stretches(monkeypatch):
    monkeypatch.setattr(D, "STRETCH", 4)
    assert [t for part in D.terms_of("Straße, ÀB-c1d".encode()) for t in part] == [t.encode() for t in ("straße", "Àb", "c", "d")]


@pytest.mark.parametrize("total", [10, 10**9, 9 * 10**15])
def test_shares_are_exact(total):
    n = [1, 2, 3, total // 7 + 1, total // 3, total - 1, total]
    assert D.shares(np.array(n), np.array(total)).tolist() == [1 + 10**9 * x // total for x in n]


def test_pairs_and_best():
    p = np.array([[10**9, 1, 7, 7], [1, 10**9, 7, 8], [5, 5, 5, 10**9 + 1]])
    assert D.pair_sums(p).tolist() == [[sum((int(a) - int(b)) ** 2 // int(b) for a, b in zip(x, y, strict=True)) for y in p] for x in p]
    assert D.best(np.array([5, 9, 5, 5, 9, 1]), np.array([1, 1, 1, 1, 1, 0], bool), 3).tolist() == [1, 4, 0]


def test_a_tile_without_terms():
    head = {"lang": ["x"], "block": [1], "source": ["s"], "term": pa.array([None], pa.string()), "n": [0], "terms": [0]}
    assert D.tile_rows(pa.table(head)).num_rows == 0
