"""Operators against plain Python, and the scans and files."""

import gzip
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import corpus as C
from corpusloom.operators import metrics as M
from corpusloom.operators import tokens as K
from corpusloom.operators import verify as V
from corpusloom.plans import prepare
from corpusloom.sources import readers as R
from corpusloom.sources import shard_files as B
from corpusloom.spec import Source

FOX = "the quick brown fox jumps over the lazy dog near the river every morning"


def in_sequence(rows, budget, val_budget):
    """The rule of exact budgets, one document after another; rows: (id, n, coin)."""
    train, val, out = 0, 0, []
    for i, n, coin in rows:
        left_train, left_val = budget - train, val_budget - val
        to_val = left_train > 0 and left_val > 0 and coin
        if left_train <= 0:
            if left_val <= 0:
                break
            to_val = True
        take = min(n, left_val if to_val else left_train)
        train, val = (train, val + take) if to_val else (train + take, val)
        out.append((i, "val" if to_val else "train", take))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_quota_is_sequential(spark, seed):
    dice = random.Random(seed)
    rows = [("s", i, dice.randrange(1, 9)) for i in range(60)]
    df = spark.createDataFrame(rows, "source string, row_id long, n_tokens long").withColumns({"budget": F.lit(dice.randrange(20, 150)).cast("long"), "val_budget": F.lit(dice.randrange(0, 60)).cast("long")})
    coins = {r.row_id: r.c for r in df.select("row_id", (K.coin(3, "source", "row_id") < 0.3).alias("c")).collect()}
    first = df.first()
    got = sorted((r.row_id, r.split, r["take"]) for r in K.quota(df, 0.3, 3).collect())
    assert got == in_sequence([(i, n, coins[i]) for _, i, n in rows], first.budget, first.val_budget)


def test_running_sum_in_blocks(spark):
    df = spark.createDataFrame([("a", i, i % 5) for i in range(100)], "g string, k long, v long")
    got = {r.k: r.s for r in K.running_sum(df, ["g"], "k", {"s": F.col("v")}, block=7).collect()}
    assert got == {i: sum(j % 5 for j in range(i + 1)) for i in range(100)}


@pytest.mark.parametrize("take,want", [(4, [4, 5, 6, 3]), (3, [4, 5, 3]), (1, [3]), (0, [])])
def test_truncation(spark, take, want):
    got = spark.range(1).select(K.truncated(F.array(*map(F.lit, (4, 5, 6, 3))), F.lit(take), 3)).first()[0]
    assert got == want


def test_decontamination(spark):
    bench = spark.createDataFrame([(0, FOX), (1, FOX + " again")], "benchmark int, text string")
    docs = spark.createDataFrame([(1, FOX), (2, "the quick brown fox jumps over the lazy"), (3, "completely unrelated ordinary web content"), (4, ("a b c d e f g h " * 2).strip()), (5, "")], "row_id long, text string")
    index = C.shingle_index(bench, 8)
    assert {(r.row_id, r.benchmark) for r in C.charged(C.shingle_hits(docs, index, 8)).collect()} == {(1, 0)}
    assert {r.row_id for r in C.decontaminate(docs, index, 8).collect()} == {2, 3, 4, 5}


def test_repeated_shingle_counts_by_position(spark):
    index = C.shingle_index(spark.createDataFrame([(2, "a b")], "benchmark int, text string"), 2)
    docs = spark.createDataFrame([(1, "a b x a b"), (2, "a b x")], "row_id long, text string")
    assert {(r.row_id, r.benchmark) for r in C.charged(C.shingle_hits(docs, index, 2)).collect()} == {(1, 2)}


def test_mix_of_sources(spark):
    index = C.shingle_index(spark.createDataFrame([(0, FOX)], "benchmark int, text string"), 8)
    rows = spark.createDataFrame([(1, "one two", "en"), (2, "one two", "en"), (3, "trois", "fr"), (4, None, "en"), (5, " ‍ ", "en"), (6, FOX, "en"), (7, FOX, "en"), (8, "four five six", "en")], "row_id long, text string, language string")
    spec = Source(name="S", dataset="d", token_budget=5, filters={"language": "en"})
    disposed, taken = prepare.mix_sources({"S": rows}, [spec], index, width=8)
    assert {r.row_id: r.disposition for r in disposed.collect()} == {1: "accepted", 2: "duplicate", 3: "filtered", 4: "missing", 5: "empty", 6: "contaminated", 7: "duplicate", 8: "accepted"}
    assert sorted((r.row_id, r["take"]) for r in taken.collect()) == [(1, 3), (8, 2)]
    assert prepare.require_full(taken, {"S": 5}).count() == 1
    with pytest.raises(Exception, match="too few tokens"):
        prepare.require_full(taken, {"S": 6}).collect()


def test_shards_and_files(spark, tmp_path):
    docs = spark.createDataFrame([("train", i, n) for i, n in enumerate((2, 3, 4))], "split string, row_id long, take long")
    pieces = K.shard_pieces(docs, ["split"], 4)
    assert sorted((r.shard_index, r.token_count) for r in K.shards(pieces, ["split"]).collect()) == [(0, 4), (1, 4), (2, 1)]
    ids = pieces.withColumn("ids", F.transform(F.sequence(F.lit(0), F.col("tokens") - 1), lambda i: F.col("row_id") * 10 + F.col("doc_offset") + i))
    written = B.write(ids, str(tmp_path)).withColumn("entry_no", F.col("shard_index"))
    entries = spark.createDataFrame(written.collect(), written.schema)
    back = [x for r in sorted(B.read(spark, str(tmp_path), entries).collect(), key=lambda r: r.entry_no) for x in r.ids]
    assert back == [0, 1, 10, 11, 12, 20, 21, 22, 23]
    disk, found = B.sizes(spark, str(tmp_path)), B.read(spark, str(tmp_path), entries)
    assert V.passed(V.shard_violations(entries, disk, found, 100, {"train": 9}))
    bad = {(r.problem) for r in V.shard_violations(entries.where("shard_index < 2"), disk, found, 20, {"train": 9}).collect()}
    assert bad == {"unlisted file", "id out of range", "wrong total"}
    np.array([1, 2, 3], "<u2").tofile(tmp_path / "train" / "shard_000000.bin")
    with pytest.raises(Exception, match="bytes for"):
        B.read(spark, str(tmp_path), entries).collect()


def test_batches_wrap(spark):
    stream = spark.range(24).select(F.col("id").alias("pos"), F.col("id").cast("int").alias("token"))
    assert K.batches(stream, 1, 24).first().targets == [*range(1, 24), 0]
    two = sorted(K.batches(stream, 1, 7).collect(), key=lambda r: r.batch)
    assert [r.inputs for r in two] == [list(range(k, k + 7)) for k in (0, 7, 14)]


def test_windows_and_continuations(spark):
    ids = F.array(*map(F.lit, range(10, 15)))
    got = spark.range(1).select(K.rolling_windows(ids, 4, 2)).first()[0]
    assert [(w.tokens, w.score_start) for w in got] == [([2, 10, 11, 12], 1), ([2, 12, 13, 14], 2)]
    few = spark.range(1).select(K.continuation(ids, F.array(F.lit(7)), 4, 2).alias("s")).first().s
    assert (few.tokens, few.score_start) == ([2, 13, 14, 7], 3)
    none = spark.range(1).select(K.continuation(ids, F.array().cast("array<int>"), 4, 2).alias("s")).first().s
    assert (none.tokens, none.score_start) == ([2], 1)


def test_scans(spark, tmp_path):
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        f.write('{"text": "one"}\n\n{"text": "two"}\n')
    assert R.local(spark, str(tmp_path / "a.json.gz")).count() == 2
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("one\n\n  two  \n")
    (tmp_path / "d" / "b.jsonl").write_text('{"text": " three "}\n"four"\n{"text": null}\n')
    (tmp_path / "d" / "c.json").write_text('[{"text": "five"}, "six", " "]')
    assert sorted(r.text for r in R.directory(spark, str(tmp_path / "d")).collect()) == ["five", "four", "one", "six", "three", "two"]
    (tmp_path / "e.txt").write_text("first\nline<|endoftext|>\n second <|endoftext|> ")
    assert sorted(r.text for r in R.local(spark, str(tmp_path / "e.txt")).collect()) == ["first\nline", "second"]
    (tmp_path / "bad.jsonl").write_text('{"text": "  "}\n')
    with pytest.raises(Exception, match="isn't blank"):
        R.json_lines(spark, str(tmp_path / "bad.jsonl")).collect()
    with pytest.raises(ValueError):
        R.local(spark, "x.csv")
    with pytest.raises(FileNotFoundError):
        R.parquet(spark, [])
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "p"))
    assert sorted(r.row_id for r in R.parquet(spark, str(tmp_path / "p")).collect()) == [0, 1, 2, 3, 4]


def test_remote_rows_resume(spark, tmp_path, monkeypatch):
    (tmp_path / "flaky_rows.py").write_text(
        "calls = []\ndef open_rows(dataset, config, split, start):\n    calls.append(start)\n    for i in range(start, 5):\n        if i == 3 and len(calls) == 1:\n            raise OSError('gone')\n        yield {'i': i}\n"
    )
    monkeypatch.syspath_prepend(str(tmp_path))
    reader = R._RemoteReader({"module": "flaky_rows", "dataset": "x", "backoff": "0"})
    assert [n for n, _ in reader.read(reader.partitions()[0])] == [1, 2, 3, 4, 5]


def test_manifest_and_metrics(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"train_shards": [{"path": "sources/a-b/train/x.bin", "token_count": 3}], "val_shards": []}))
    e = R.manifest_entries(R.manifest(spark, str(tmp_path / "m.json")))
    assert R.source_entries(e, "A b", "train").count() == 1 and R.source_entries(e, "a-b", "train").first().path.endswith("x.bin")
    with pytest.raises(ValueError, match="no val shards"):
        R.source_entries(e, "A b", "val")
    (tmp_path / "metrics.jsonl").write_text('{"step": 1, "train_loss": 4.2}\nbroken\n{"step": 2, "train_loss": 3.8}\n')
    assert [r.step for r in R.metrics(spark, str(tmp_path / "metrics.jsonl"), "step long, train_loss double", 1).collect()] == [2]
    B.write_json(str(tmp_path / "o.json"), {"b": 1, "a": 2})
    assert json.loads((tmp_path / "o.json").read_text()) == {"a": 2, "b": 1}


def test_results_do_not_depend_on_partitions(spark):
    from corpusloom.plans.queries import QUERIES

    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(tuple, QUERIES["exact_quota"](spark, "/root/testdata/sf0.001").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


def test_tokenizers(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    from corpusloom.operators import tokenize as T

    df = spark.createDataFrame([("a literal <unk> here",), (None,), ("中文 🙂",)], "t string")
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        path = tokenizers.path(name)
        got = [r[0] for r in df.select(T.encode(F.col("t"), path)).collect()]
        end = T.load(path).special["eos"]
        assert got[1] is None and got[0][-1] == end and T.load(path).special["unk"] not in got[0]
    vocabulary = json.load(open(tokenizers.path("byte_bpe_50k.json")))["model"]["vocab"]
    report = T.audit(T.vocabulary(spark, vocabulary), spark.createDataFrame([(5, 3)], "id long, n long")).first()
    assert report.single_bytes == 256 and report.learned > 40_000


def test_trailing_averages_at_every_record(spark):
    rows = [(r, i, i * 7.5 % 400 if i % 11 else None, float(i % 4) if i % 6 else None) for r in ("a", None) for i in range(80)]
    got = M.trailing_each(spark.createDataFrame(rows, "run string, i long, at double, v double"), "run", "at", "v", (10, 60)).collect()
    assert len(got) == len(rows)
    for x in got:
        for s in (10, 60):
            near = [v for r, _, at, v in rows if r == x.run and at is not None and x.at is not None and x.at - s <= at <= x.at and v]
            assert (x[f"avg_{s}s"] is None and not near) or abs(x[f"avg_{s}s"] - sum(near) / len(near)) < 1e-9


def test_perplexity_scores_each_token_once(spark):
    from corpusloom.operators import evaluate as E

    docs = spark.createDataFrame([("a", "1 2 3 4 5 6 7"), ("a", None), ("b", ""), ("b", "8")], "g string, text string")
    ids = F.filter(F.transform(F.split("text", " "), lambda x: F.try_to_number(x, F.lit("99")).cast("int")), lambda x: x.isNotNull())
    total = lambda tokens, first: -F.aggregate(F.slice(tokens, first + 1, F.size(tokens)), F.lit(0.0), lambda a, x: a + x)
    rows = E.window_scores(docs, ids, total, 4, 0, ["g"]).orderBy("g", "ll").collect()
    assert sorted((r.g, -(r.ll or 0), r.tokens, r.words, r.bytes) for r in rows) == [("a", 6, 3, 7, 13), ("a", 7, 1, 0, 0), ("a", 15, 3, 0, 0), ("b", 0, 0, 1, 0), ("b", 8, 1, 1, 1)]
    by = {r.g: r for r in E.rolling_perplexity(docs, ids, total, 4, 0, ["g"]).collect()}
    assert abs(by["a"].word_perplexity - np.exp(28 / 7)) < 1e-9 and abs(by["b"].bits_per_byte - 8 / np.log(2)) < 1e-9
