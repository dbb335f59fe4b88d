"""Archives, neighbours, the pipeline and the entry without the subpackage."""

import base64
import hashlib
import random

import numpy as np
import pytest

from corpusloom.llm import op9_warc as W
from corpusloom.llm import op10_neighbours as N

PAGES = [
    (1, "http://www.b.org/x?q=1", "<p>é</p>"),
    (2, "https://a.com:8080/y", "same"),
    (3, "https://a.com:8080/y", "same"),
    (3, None, "same"),
    (None, "http://b.org/ z\n", "same"),
    (4, "not a url", None),
    (5, "http://[bad", ""),
    (6, "http://b.org/long", "h" * 3_000_000),
]


@pytest.mark.parametrize("fan_in", [64, 2])
def test_archive(spark, monkeypatch, fan_in):
    monkeypatch.setattr(W, "FAN_IN", fan_in)
    monkeypatch.setattr(W, "RUN", 3 if fan_in == 2 else 100)
    pages = spark.createDataFrame([(i, u, h, "x", 9) for i, u, h in PAGES], "page_id long, url string, html string, sha string, refers_to int").repartition(5, "url")
    got = W.archive(pages).collect()
    best = {}
    for i, _, h in PAGES:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in PAGES:
        raw, most = (h or "").encode(), best[h or ""]
        refers = most if i is not None and i < most else None
        want.append((-1 if i is None else i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if refers is None else "revisit", refers or -1))
    assert sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in got) == sorted(want)
    order = [(r.url_key, r.timestamp, -1 if r.page_id is None else r.page_id) for r in sorted(got, key=lambda r: (r.part, r.place))]
    assert order == sorted(order)
    assert W.archive(pages.limit(0)).count() == 0
    assert {r.record_type for r in W.archive(pages, least=10**9).collect()} == {"response"}


def test_merges_by_ranges(spark, monkeypatch, tmp_path):
    """Several levels, each by ranges of the key."""
    monkeypatch.setattr(W, "FAN_IN", 2)
    monkeypatch.setattr(W, "RUN", 20)
    dice, every, runs = random.Random(4), [], []
    for k in range(7):
        rows = [dict.fromkeys((f.name for f in W.CAPTURE)) | {"url_key": f"k{dice.randrange(30):02d}", "timestamp": "t", "page_id": i, "path": f"p{k}", "offset": i} for i in range(25)]
        writer = W.RunWriter(f"file://{tmp_path}/{k}.arrow")
        for r in sorted(rows, key=W._key):
            writer.add(r)
        done = writer.close()
        runs.append(W.Run([], 0, []))
        runs[-1].add(**done)
        every += map(W._key, rows)
    merged = W.merge_level(spark, runs, f"file://{tmp_path}")
    assert len(merged) == 4 and max(len(r.pieces) for r in merged) > 1 and sum(r.captures for r in merged) == 7 * 25
    got = sorted(W.merge_runs(spark, runs, f"file://{tmp_path}", 3).collect(), key=lambda r: (r.part, r.place))
    assert [W._key(r.asDict()) for r in got] == sorted(every)


def test_ranges_open_only_pieces_that_overlap(monkeypatch, tmp_path):
    """Three runs of 40 pieces: a range opens the few that hold its keys, through lists of four ranges."""
    monkeypatch.setattr(W, "LISTED", 4)
    blank, runs, every, opened = dict.fromkeys(f.name for f in W.CAPTURE), [], [], []
    for k in range(3):
        runs.append(W.Run([], 0, []))
        for piece in range(40):
            writer = W.RunWriter(f"file://{tmp_path}/{k}-{piece}.arrow")
            for i in range(10):
                row = blank | {"url_key": f"u{piece * 10 + i:04d}", "timestamp": "t", "page_id": k, "path": f"p{k}", "offset": i}
                writer.add(row)
                every.append(W._key(row))
            runs[-1].add(**writer.close())
    read = W.read_run
    monkeypatch.setattr(W, "read_run", lambda path, low, high: opened.append(path) or read(path, low, high))
    rows, got = W.merge_rows(0, runs, 30, f"file://{tmp_path}"), []
    assert len(rows) == 30 and len({r[3] for r in rows}) == 8
    for _, _, bounds, listed in rows:
        opened.clear()
        got += map(W._key, W.merged(bounds, listed))
        assert 3 <= len(opened) <= 9 and len(set(opened)) == len(opened)
    assert got == sorted(every)


def test_ranges_weigh_runs():
    """A long run with few keys counts as much as its captures."""
    long, short = W.Run([], 9000, [(f"a{i}",) for i in range(9)]), W.Run([], 90, [(f"b{i:02d}",) for i in range(90)])
    assert [low for low, _ in W.key_ranges([long, short], 3)] == [None, ("a4",), ("a7",)] and W.key_ranges([], 3) == [(None, None)]


def test_loser_tree():
    dice = random.Random(1)
    for k in (0, 1, 2, 3, 7, 8):
        runs = [sorted(dice.randrange(50) for _ in range(dice.randrange(20))) for _ in range(k)]
        assert list(W.LoserTree([iter([((x,), x) for x in r]) for r in runs])) == sorted(x for r in runs for x in r)


def test_records_in_small_reads(tmp_path):
    raw = [W.record(i, "http://a.b/", W.NO_DATE, b"x" * (i * 1000), None) for i in range(5)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(raw))
    found = list(W.records(f"file://{tmp_path}/a.warc.gz", chunk=64))
    assert [n for _, n, _ in found] == [len(x) for x in raw]
    assert [W.capture("", *r)["payload_bytes"] for r in found] == [i * 1000 for i in range(5)]


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL", 150)
    monkeypatch.setattr(N, "QUERIES", 20)
    dice = np.random.default_rng(3)
    vectors = {i: (dice.normal(size=16) + 3 * dice.normal(size=(5, 16))[i % 5] * 0 + np.eye(16)[i % 5] * 4).astype(np.float32) for i in range(600)}
    for i in range(100, 300, 3):
        vectors[i] = vectors[100]
    rows = [(i, [float(x) for x in v], "c") for i, v in vectors.items()]
    rows += [(1000, None, "c"), (1020, [0.0] * 16, "c"), (1040, [float("nan")] * 16, "c"), (1060, [float("inf")] * 16, "c"), (1080, [], "c"), (None, [1.0] * 16, "c"), (1100, [1.0, 2.0], "c"), (40, [float(x) for x in vectors[40]], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got: dict[int, list] = {}
    for r in N.nearest(df, "vec_id % 20 = 0", k=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in range(0, 600, 20)}
    hits = 0
    ids, x = np.array(list(vectors)), np.stack(list(vectors.values())).astype(float)
    for q, found in got.items():
        found.sort()
        scores = (x * vectors[q].astype(float)).sum(axis=1)
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:20]
        hits += len({int(ids[i]) for i in order} & {i for _, i, _ in found})
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(s == scores[list(ids).index(i)] for _, i, s in found)
    assert hits >= 0.9 * 20 * len(got)
    assert N.nearest(df.limit(0), "vec_id % 20 = 0").count() == 0
    few = N.nearest(df.where("vec_id < 3"), "vec_id = 0").collect()
    assert {r.vec_id for r in few} == {1, 2}


def _cell(x, keep=21):
    norm2 = float((x * x).sum(axis=1).max())
    return N.Cell(N.Cell.build(np.arange(len(x)), x, norm2, keep))


def test_neighbours_walk_the_tree():
    dice = np.random.default_rng(1)
    cell = _cell(dice.normal(size=(1000, 12)))
    q = dice.normal(size=(7, 12))
    p, radius = q @ cell.g, dice.uniform(0, 60, 7)
    which, leaf = cell.walk(p, radius)
    want = [(i, j) for i in range(7) for j in range(1 << cell.levels) if ((cell.points[cell.leaf_bounds[j] : cell.leaf_bounds[j + 1]] - p[i]) ** 2).sum(axis=1).min() <= radius[i]]
    assert set(want) <= set(zip(which.tolist(), leaf.tolist(), strict=True)) and len(which) < 7 << cell.levels
    begin, end = cell.home(p, 22)
    assert (end - begin >= 22).all() and (end - begin < 1000).all()


@pytest.mark.parametrize("spread,share", [(1.0, 0.9), (0.05, 0.2)])
def test_neighbours_stop_early(spread, share):
    """Recall and the share of vectors that are verified, at random directions and in clusters."""
    dice = np.random.default_rng(2)
    x = dice.normal(size=(60, 64))[np.arange(6000) % 60] + dice.normal(size=(6000, 64)) * (spread if spread < 1 else 100)
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32).astype(float)
    cell, asked = _cell(x), np.arange(0, 6000, 20)
    best = [[] for _ in asked]
    cell.search(asked, x[asked], 20, N.stop_ratio(), best)
    hits = 0
    for i, found in zip(asked, best, strict=True):
        scores = (x * x[i]).sum(axis=1)
        nearest = [j for j in np.lexsort((np.arange(6000), -scores)).tolist() if j != i][:20]
        hits += len(set(nearest) & {j for _, j in found})
    assert hits >= 0.9 * 20 * len(asked)
    assert cell.verified < share * len(asked) * 6000


def test_neighbours_load_only_cells_within_reach():
    """Forty far clusters, a cell of two files each: a block reads its own cluster's files, once."""
    dice, loaded = np.random.default_rng(5), []
    middle = dice.normal(size=(40, 32)) * 10
    groups = [m + dice.normal(size=(300, 32)) * 0.05 for m in middle]
    norm2 = max(float((x * x).sum(axis=1).max()) for x in groups)
    files, boxes = {}, []
    for c, x in enumerate(groups):
        for part in (0, 1):
            files[f"{c}-{part}"] = N.Cell.build(np.arange(len(x))[part::2] + 300 * c, x[part::2], norm2, 21)
        boxes.append([side([files[f"{c}-{part}"][name][0] for part in (0, 1)], axis=0) for side, name in ((np.min, "low"), (np.max, "high"))])
    cells = N.Cells(norm2, np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes]), [[f"{c}-0", f"{c}-1"] for c in range(40)])
    longest = int(np.argmax((middle * middle).sum(axis=1)))  # where the largest inner product is the nearest, too
    asked = np.arange(0, 300, 20)
    best, _ = N.search_block({"ids": asked + 300 * longest, "vectors": groups[longest][asked]}, cells, 20, N.stop_ratio(), lambda path: loaded.append(path) or files[path])
    assert {f"{longest}-0", f"{longest}-1"} <= set(loaded) and len(loaded) == len(set(loaded)) <= 8
    every, hits = np.concatenate(groups), 0
    for i, found in zip(asked, best, strict=True):
        scores = every @ groups[longest][i]
        order = [j for j in np.lexsort((np.arange(len(every)), -scores)).tolist() if j != i + 300 * longest][:20]
        hits += len(set(order) & {j for _, j in found})
    assert hits >= 0.9 * 20 * len(asked)


def test_neighbours_split_crowded_cells(spark, monkeypatch):
    """Queries and vectors of one cell are dealt over parts, equal keys together."""
    monkeypatch.setattr(N, "MOST_CELLS", 2)
    rows = spark.range(1000).selectExpr("id AS vec_id", "array(cast(id % 100 AS double)) AS vector", "id % 2 AS cell")
    got = N.deal(rows, 50, "vector").groupBy("cell", "part").agg({"vector": "count", "vec_id": "count"}).collect()
    assert len(got) == 20 and N.deal(rows.limit(0), 50, "vector").count() == 0
    together = N.deal(rows, 50, "vector").groupBy("vector", "cell").agg({"part": "max"}).count()
    assert together == N.deal(rows, 50, "vector").select("vector", "cell", "part").distinct().count()


def test_stages_on_odd_rows(spark, odd_docs, no_docs):
    """Nulls, empty texts, ties, repeated rows, no rows; extra columns go."""
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    for _, stage in P.STAGES[:-1]:
        for docs in (odd_docs, no_docs):
            out = stage(spark, docs, sf)
            assert out.columns == P.COLUMNS
            rows = out.collect()
            assert (len(rows) <= docs.count()) or stage is P.mixing
    assert P.encoding(spark, odd_docs, sf).count() == odd_docs.count() and P.encoding(spark, no_docs, sf).count() == 0
    assert sorted(str(r.doc_id) for r in P.near_duplicates(spark, odd_docs, sf).collect()) == ["1", "3", "5", "7", "7", "8", "None"]


def test_pipeline(spark):
    """Against plain programs, stage by stage."""
    import corpus_pipeline as P
    from corpusloom.llm import _shared, op4_quality

    from .test_documents import classes, print_of, spans

    sf = "/root/testdata/sf0.001"
    docs = _shared.read_table(spark, sf, "documents")
    kept = _shared.materialize(P.quality(spark, docs, sf), "t").collect()
    model = op4_quality.train(docs, _shared.read_table(spark, sf, "labels"))
    said = {r.doc_id for r in op4_quality.quality_rows(docs, model).collect() if r.kept}
    assert {r.doc_id for r in kept} == said and len(said) > 0.4 * docs.count()
    kept_df = spark.createDataFrame(kept, docs.schema)
    unique = _shared.materialize(P.near_duplicates(spark, kept_df, sf), "t")
    want = set(classes({r.doc_id: print_of(r.text) for r in kept}).values())
    assert {r.doc_id for r in unique.collect()} == want and unique.columns == P.COLUMNS
    clean = _shared.materialize(P.secrets(spark, unique, sf), "t")
    texts = {r.doc_id: r.text for r in kept}
    for r in clean.collect():
        out, at = "", 0
        for _, a, b in spans(texts[r.doc_id]):
            if a >= at:
                out += texts[r.doc_id][at:a] + "[SECRET]"
            at = max(at, b)
        assert r.text == out + texts[r.doc_id][at:] and r.n_chars == len(r.text)
    mixed = _shared.materialize(P.mixing(spark, clean, sf), "t")
    assert {r.doc_id for r in mixed.collect()} <= want and mixed.columns == P.COLUMNS
    last = P.encoding(spark, mixed, sf).collect()
    assert len(last) == mixed.count()
    assert sorted(r.doc_id for r in P.run(spark, sf).collect()) == sorted(r.doc_id for r in last)
