"""The stored index of shingles against plain hashing."""

import hashlib
import json
import re
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from corpusloom.operators import corpus as C
from corpusloom.operators import shingles as S

FOX = "the quick brown fox jumps over the lazy dog near the river every morning"


def plain_hashes(text, width):
    """One polynomial for each run of words, from scratch, as signed numbers."""
    words = re.findall("[a-z0-9]+", (text or "").casefold(), re.ASCII)
    h = [int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in words]
    out = []
    for i in range(len(h) - width + 1):
        v = 0
        for x in h[i : i + width]:
            v = (v * 1_000_003 + x) % (1 << 64)
        out.append(v - (1 << 64) if v >> 63 else v)
    return out


TEXTS = [None, "", "two words", FOX, "STRASSE Straße ﬁne İx 9to5 " * 9, "a-b_c\x00d é " * 30, "x " * 200]


@pytest.mark.parametrize("width", [1, 3, 12])
def test_rolled_hashes(monkeypatch, width):
    want = [plain_hashes(t, width) for t in TEXTS]
    for block, together, most in ((1 << 16, 4_000_000, 400_000), (5, 7, 3)):
        for name, value in (("BLOCK", block), ("TOGETHER", together), ("MOST_WORDS", most)):
            monkeypatch.setattr(S, name, value)
        batch = S.pa.record_batch({"text": S.pa.array(TEXTS, S.pa.string())})
        h, row, pos = S._hashed(batch, 0, S.WordHashes(), S.Roller(width))
        got = [[] for _ in TEXTS]
        for x, r, p in zip(h.tolist(), row, pos, strict=True):
            assert p == len(got[r])
            got[r].append(x)
        assert got == want


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index"))
    rows = [(0, FOX), (2, "never " + FOX.upper()), (2, None), (1, "too short"), (0, FOX)]
    return folder, S.publish(spark.createDataFrame(rows, "benchmark int, text string"), folder, 8, ["a", "b", "c"])


def test_stored(spark, built):
    folder, _ = built
    index = S.StoredIndex.open(spark, folder)
    want = {}
    for k, text in ((0, FOX), (2, "never " + FOX)):
        for h in plain_hashes(text, 8):
            want[h] = want.get(h, 0) | 1 << k
    assert {r.hash: r.mask for r in index.rows().collect()} == want
    assert json.loads(open(f"{folder}/report.json").read()) == {"version": 1, "benchmarks": ["a", "b", "c"], "public_rows": {"a": 2, "b": 1, "c": 2}, "shingle_width": 8, "unique_shingles": len(want), "rejection_rule": "at least two exact normalized word shingles from the same benchmark", "includes_answers": False}
    assert {r.benchmark: r.shingles for r in index.shingles().collect()} == {0: len(plain_hashes(FOX, 8)), 2: len(want)}
    hashes, masks = index.arrays()
    assert (np.diff(hashes) > 0).all() and masks.dtype == np.uint8
    for f in Path(folder, "hashes").glob("*.parquet"):
        part = pq.read_table(f).column("hash").to_pylist()
        assert part == sorted(part)


@pytest.mark.parametrize("most", [S.MOST_BYTES, 0])
def test_hits(spark, built, monkeypatch, most):
    """Probed in workers, or joined by a shuffle."""
    monkeypatch.setattr(S, "MOST_BYTES", most)
    folder, index = built
    docs = [(1, "Here: " + FOX + "!"), (2, None), (3, FOX[:30]), (4, "never " + FOX), (4, FOX + " " + FOX), (5, "nothing of it " * 9)]
    masks = {r.hash: r.mask for r in index.rows().collect()}
    want = sorted((i, p, k) for i, t in docs for p, h in enumerate(plain_hashes(t, 8)) for k in range(3) if masks.get(h, 0) >> k & 1)
    got = S.hits(spark.createDataFrame(docs, "row_id long, text string"), index)
    assert sorted(tuple(r) for r in got.select("row_id", "pos", "benchmark").collect()) == want and len(want) > 20


def test_odd_indexes(spark, tmp_path):
    rows = spark.createDataFrame([(0, FOX)], "benchmark int, text string")
    with pytest.raises(ValueError, match="at least 8"):
        S.publish(rows, str(tmp_path / "a"), 7, ["a"])
    with pytest.raises(ValueError, match="no name"):
        S.build(rows, str(tmp_path / "b"), 8, [])
    docs = spark.createDataFrame([(1, FOX)], "row_id long, text string")
    none = S.build(rows.limit(0), str(tmp_path / "c"), 8, [])
    assert none.count == 0 and S.hits(docs, none).count() == 0
    assert C.shingle_hits(docs, C.shingle_index(rows.limit(0), 8), 8).count() == 0
    with pytest.raises(ValueError, match="8 words, not 12"):
        C.shingle_hits(docs, S.build(rows, str(tmp_path / "d"), 8, ["a"]))
