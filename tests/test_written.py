"""Corpora, mixes, assemblies and global mixes on disk."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import corpus as C
from corpusloom.operators import metrics as M
from corpusloom.operators import runs as U
from corpusloom.operators import tokenize as Z
from corpusloom.plans import prepare as P
from corpusloom.plans import written as W
from corpusloom.spec import Source, load_assembly
from corpusloom.streaming import streams as T

FOX = "the quick brown fox jumps over the lazy dog near the river every morning"


def by_length(most=16):
    """One id for a text, 4 and its length modulo 3, then 3."""
    return W.Encoder(lambda c: F.array((F.length(c) % 3 + 4).cast("int"), F.lit(3)), most, 3, None, "lengths", "0" * 64)


@pytest.fixture(scope="module")
def index(spark):
    return C.shingle_index(spark.createDataFrame([(0, FOX), (1, "never " + FOX)], "benchmark int, text string"), 8)


@pytest.fixture(scope="module")
def mixed(spark, index, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("mix"))
    a = spark.createDataFrame([(i, f"text {'x' * i} of a" if i != 5 else FOX, "fr" if i % 4 == 3 else "en") for i in range(40)] + [(90, None, "en"), (91, "text  of a", "en")], "row_id long, text string, language string")
    b = spark.createDataFrame([(i, f"why {i}", f"so {i}" if i % 5 else " ") for i in range(60)], "row_id long, question string, answer string")
    specs = [Source(name="B two", dataset="d", token_budget=30, text_template="{question}? {answer}"), Source(name="A", dataset="d", token_budget=40, filters={"language": "en"})]
    return folder, W.write_mix({"A": a, "B two": b}, specs, index, W.Encoder.of_words(), folder, val_ratio=0.25, shard_tokens=7, width=8), specs, {"A": a, "B two": b}


def stored(folder, entries):
    return [np.fromfile(f"{folder}/{e['path']}", "<u2").tolist() for e in entries]


def test_a_document_is_cut_to_the_budget(spark, index, tmp_path):
    rows = spark.createDataFrame([(1, "a", "en"), (2, "bb", "en"), (3, "ccc", "fr"), (4, "dddd", "en")], "row_id long, text string, language string")
    m = W.write_mix({"s": rows}, [Source(name="s", dataset="d", token_budget=5, filters={"language": "en"})], index, by_length(), str(tmp_path), shard_tokens=3, width=8)
    assert stored(tmp_path, m["train_shards"]) == [[5, 3, 6], [3, 3]] and m["val_shards"] == []
    told = m["statistics"]["source_statistics"]["s"]
    assert (m["train_token_count"], told["filtered"], told["raw"], told["train_tokens"]) == (5, 1, 4, 5)
    with pytest.raises(Exception, match="too few tokens"):
        W.write_mix({"s": rows}, [Source(name="s", dataset="d", token_budget=50)], index, by_length(), str(tmp_path / "b"), shard_tokens=3, width=8)
    with pytest.raises(Exception, match="out of range"):
        W.write_mix({"s": rows}, [Source(name="s", dataset="d", token_budget=5)], index, by_length(5), str(tmp_path / "c"), shard_tokens=3, width=8)


def test_mix(spark, mixed):
    folder, m, specs, _ = mixed
    assert [s["name"] for s in m["sources"]] == ["B two", "A"] and (m["train_token_count"], m["val_token_count"]) == (70, 18)
    assert [e["path"].rpartition("/")[0] for e in m["train_shards"]] == ["sources/b-two/train"] * 5 + ["sources/a/train"] * 6
    assert [e["token_count"] for e in m["train_shards"]] == [7, 7, 7, 7, 2] + [7] * 5 + [5]
    told = m["statistics"]["source_statistics"]
    assert told["A"]["missing"] == 1 and told["A"]["filtered"] == 10 and told["A"]["duplicate"] == 1 and told["A"]["contaminated"] == 1 and told["A"]["benchmark_hits"] == {"0": 7, "1": 7}
    assert told["B two"]["missing"] == 12 and sum(t["count"] for t in m["statistics"]["token_frequency_top_100"]) == 88
    assert W.verify(spark, f"{folder}/manifest.json")["passed"] and W.record_of(f"{folder}/manifest.json", "A")["actual_val_tokens"] == 10
    with pytest.raises(ValueError):
        W.record_of(f"{folder}/manifest.json", "C")
    assert json.loads((Path(folder) / "manifest.json").read_text())["sources"][0]["requested_token_budget"] == 30


def test_global_mix(spark, mixed, tmp_path):
    folder, before, _, _ = mixed
    m = W.mix_chunks(spark, f"{folder}/manifest.json", str(tmp_path), chunk_tokens=3, shard_tokens=10, seed=5)
    assert [e["token_count"] for e in m["train_shards"]] == [10] * 7 and [e["token_count"] for e in m["val_shards"]] == [10, 8]
    for split in ("train", "val"):
        chunks = sorted(tuple(x[i : i + 3]) for x in stored(folder, before[f"{split}_shards"]) for i in range(0, len(x), 3))
        stream = [t for x in stored(tmp_path, m[f"{split}_shards"]) for t in x]
        assert sorted(stream) == sorted(t for c in chunks for t in c) and len(chunks) == m["mixing"][split]["chunks"]
    assert m["mixing"]["train"]["source_chunk_counts"] == {"a": 17, "b-two": 13} and len(m["mixing"]["train"]["first_32_sources"]) == 30
    report = json.loads((tmp_path / "verification.json").read_text())
    assert report["passed"] and report["mixing"]["seed"] == 5
    again = W.mix_chunks(spark, f"{folder}/manifest.json", str(tmp_path / "again"), chunk_tokens=3, shard_tokens=10, seed=5)
    assert stored(tmp_path, m["train_shards"]) == stored(tmp_path / "again", again["train_shards"])


def test_assembly(spark, mixed, index, tmp_path):
    folder, m, _, rows = mixed
    (tmp_path / "c.yaml").write_text(json.dumps({"name": "x", "target_train_tokens": 12 + 20 + 70, "shard_tokens": 7, "sources": [
        {"name": "Part", "kind": "existing_source", "manifest": "manifest.json", "source_name": "A", "token_budget": 12},
        {"name": "A", "kind": "hf", "dataset": "d", "token_budget": 20},
        {"name": "All", "kind": "tokenized_manifest", "manifest": f"{folder}/manifest.json", "category": "c"}]}))
    config = load_assembly(tmp_path / "c.yaml")
    out = W.assemble(spark, config, W.Encoder.of_words(), str(tmp_path / "o"), rows, index, base=folder, width=8)
    assert out["train_token_count"] == 102 and [s["actual_train_tokens"] for s in out["sources"]] == [12, 20, 70]
    source = [t for x in stored(folder, [e for e in m["train_shards"] if "/a/" in e["path"]]) for t in x]
    assert stored(tmp_path / "o", out["train_shards"][:2]) == [source[:7], source[7:12]]
    assert W.verify(spark, f"{tmp_path}/o/manifest.json", out["tokenizer_hash"])["passed"]
    (tmp_path / "o" / out["train_shards"][0]["path"]).write_bytes(b"")  # begun again: two sources are taken over, one is not whole
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "o").rglob("*.bin")}
    assert W.assemble(spark, config, W.Encoder.of_words(), str(tmp_path / "o"), rows, index, base=folder, width=8)["train_shards"] == out["train_shards"]
    assert {p.parent.parent.name for p, t in before.items() if p.stat().st_mtime_ns != t} == {"part"} and stored(tmp_path / "o", out["train_shards"][:1]) == [source[:7]]
    with pytest.raises(ValueError, match="another configuration"):
        W.assemble(spark, {**config.settings, "target_train_tokens": 7, "sources": []}, W.Encoder.of_words(), str(tmp_path / "o"))
    with pytest.raises(ValueError, match="train tokens, not 103"):
        W.assemble(spark, {**config.settings, "target_train_tokens": 103, "sources": list(config.sources)}, W.Encoder.of_words(), str(tmp_path / "p"), rows, index, base=folder, width=8)
    with pytest.raises(ValueError, match="fewer than 1000"):
        W.taken_over(spark, f"{folder}/manifest.json", "sources/x", str(tmp_path / "q"), 1000)
    with pytest.raises(ValueError, match="another tokenizer"):
        W.assemble(spark, config, by_length(), str(tmp_path / "r"), rows, index, base=folder, width=8)


def test_corpus_with_a_real_tokenizer(spark, tmp_path):
    tokenizers = pytest.importorskip("public_tokenizers")
    encoder = W.Encoder.of(tokenizers.path("byte_bpe_50k.json"))
    texts = ["one  text", "one text", "another\ttext", "", None, "中文 text 🙂"]
    docs = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    m = W.write_corpus(docs, encoder, str(tmp_path), shard_tokens=5)
    wanted = [t for x in ("one text", "another text", "中文 text 🙂") for t in Z.load(encoder.name).encode([x])[0]]
    assert [t for x in stored(tmp_path, m["train_shards"]) for t in x] == wanted and m["vocab_size"] == 50_257
    told = m["statistics"]
    assert (told["raw_document_count"], told["empty_document_count"], told["duplicate_document_count"], told["train_document_count"], told["en_like_document_count"]) == (6, 2, 1, 3, 2)
    kept = W.write_corpus(docs, encoder, str(tmp_path / "all"), deduplicate=False)
    assert kept["statistics"]["train_document_count"] == 4 and kept["statistics"]["duplicate_filtering"] == "disabled"


def test_problems_are_told(spark, mixed, tmp_path):
    import shutil

    folder, m, _, _ = mixed
    shutil.copytree(folder, tmp_path / "m")
    path = f"{tmp_path}/m/manifest.json"
    (tmp_path / "m" / m["train_shards"][0]["path"]).unlink()
    np.array([1, 2], "<u2").tofile(tmp_path / "m" / m["train_shards"][1]["path"])
    np.array([1], "<u2").tofile(tmp_path / "m" / "sources" / "extra.bin")
    np.array([2_000] * 7, "<u2").tofile(tmp_path / "m" / m["train_shards"][2]["path"])
    report = W.verify(spark, path, tokenizer_hash="another")
    assert not report["passed"] and {e.split(":")[0] for e in report["errors"]} == {"missing file", "wrong size", "unlisted file", "id out of range", "the tokenizer's hash differs"}
    assert W.release_problems(path, {"train_token_count": 70, "mixing.chunk_tokens": 3}) == ["mixing.chunk_tokens is None, not 3"]
    hashes = spark.createDataFrame([("a", "1", "1"), ("b", "1", "2"), ("c", None, "3")], "path string, sha256 string, wanted string")
    assert W.release_problems(path, {}, hashes) == ["b has another hash", "c has another hash"]


def test_register_of_runs(spark):
    ids = spark.createDataFrame([("r1",), ("r2",)], "run_id string")
    status = spark.createDataFrame([("r1", "done", 5)], "run_id string, status string, step int")
    r = {x.run_id: x for x in U.register(ids, {"status": status}, spark.createDataFrame([("r1", "b"), ("r1", "a")], "run_id string, path string"), "r2").collect()}
    assert (r["r1"].status.step, r["r1"].checkpoints, r["r1"].selected) == (5, ["a", "b"], False) and (r["r2"].status, r["r2"].checkpoints, r["r2"].selected) == (None, [], True)


def test_trailing_without_times(spark):
    rows = [("a", i, float(i), None if i == 12 else float(i)) for i in range(13)] + [("b", 1, 7.0, 3.0)]
    df = spark.createDataFrame(rows, "run string, step long, value double, elapsed double")
    got = {r.run: (r.avg_60s, r.avg_300s) for r in M.trailing(df, "run", "elapsed", "value", "step", (60, 300)).collect()}
    assert got == {"a": (11.5, 11.5), "b": (7.0, 7.0)}  # two of twelve values that aren't zero


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.jsonl").write_text('{"step": 1, "train_loss": 4.5}\nbroken\n{}\n')
    tail = T.metrics_tail(spark, str(tmp_path / "in"), "step long, train_loss double")
    assert [tuple(r) for r in T.run_once(tail, str(tmp_path / "tail")).collect()] == [(1, 4.5)]
    (tmp_path / "in" / "2.jsonl").write_text('{"step": 2, "train_loss": 4.25}\n')
    assert sorted(r.step for r in T.run_once(tail, str(tmp_path / "tail")).collect()) == [1, 2]
    spark.createDataFrame([("s", "x", 1), ("s", " x ", 2), ("t", "x", 3)], "source string, text string, at int").select("source", "text", F.timestamp_seconds("at").alias("ts")).write.parquet(str(tmp_path / "docs"))
    docs = spark.readStream.schema("source string, text string, ts timestamp").parquet(str(tmp_path / "docs"))
    first = T.first_copies(docs, ["source"], time_col="ts")
    assert sorted(r.source for r in T.run_once(first, str(tmp_path / "first")).collect()) == ["s", "t"]


def test_metadata_and_sample(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("byte_bpe_50k.json")
    told = Z.metadata(path, source="x")
    assert told["actual_vocab_size"] == 50_257 and len(told["model_sha256"]) == 64 and told["source"] == "x"
    texts = ["one two  three " * 40, None, "", "end"]
    sample, counts = Z.sample_statistics(spark.createDataFrame([(t,) for t in texts], "text string"), path, 100)
    got, lines = sample.first(), [x[i : i + 100] for t in texts if t for x in [" ".join(t.split())] for i in range(0, len(x), 100)]
    ids = [i for x in Z.load(path).encode(lines, eos=False) for i in x]
    assert (got.documents, got.lines, got.chars, got.tokens, got.unknown) == (2, len(lines), sum(map(len, lines)), len(ids), 0)
    assert {r.id: r.n for r in counts.collect()} == {i: ids.count(i) for i in ids}


def without_time(m):
    return {k: v for k, v in m.items() if k != "created_at"}


def test_a_shared_table_is_read_once(spark, index, tmp_path):
    """Sources of one table, of unequal fields and filters, give what they give from tables of their own."""
    rows = [(i, ("A", "B", "C", "D")[i % 4], f"text {'x' * i}", f"why {i}", "fr" if i % 5 == 0 else "en") for i in range(120)]
    table = spark.createDataFrame(rows, "row_id long, origin string, text string, question string, language string")
    specs = [Source(name="B", dataset="d", token_budget=20, text_template="{question}? {text}"), Source(name="A", dataset="d", token_budget=20, filters={"language": "en"}, min_text_chars=9), Source(name="C", dataset="d", token_budget=20, filters={"language": "en"}, min_text_chars=9)]
    own = {s.name: table.where(F.col("origin") == s.name).drop("origin") for s in specs}
    one = W.write_mix(P.Shared(table, "origin"), specs, index, W.Encoder.of_words(), str(tmp_path / "a"), 1.0, 0.2, shard_tokens=7, width=8)
    two = W.write_mix(own, specs, index, W.Encoder.of_words(), str(tmp_path / "b"), 1.0, 0.2, shard_tokens=7, width=8)
    assert without_time(one) == without_time(two) and stored(tmp_path / "a", one["train_shards"]) == stored(tmp_path / "b", two["train_shards"])
    plan = P.all_rows(P.Shared(table.sparkSession.read.schema(table.schema).parquet(written(table, tmp_path)), "origin"), specs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def written(table, tmp_path):
    table.write.parquet(str(tmp_path / "table"))
    return str(tmp_path / "table")


def test_a_mix_goes_on_where_it_broke_off(spark, index, tmp_path, monkeypatch):
    """Sources that are committed aren't read again; half-written ones are written anew."""
    for n in "AB":
        spark.createDataFrame([(i, f"text {'x' * i} of {n}") for i in range(30)], "row_id long, text string").write.parquet(str(tmp_path / "in" / n))
    specs = [Source(name=n, dataset="d", token_budget=40) for n in "BA"]

    def mix(**more):
        inputs = {n: spark.read.schema("row_id long, text string").parquet(str(tmp_path / "in" / n)) for n in "AB"}
        return W.write_mix(inputs, specs, index, W.Encoder.of_words(), str(tmp_path / "out"), 1.0, 0.2, shard_tokens=7, width=8, **more)

    prepared, seen = W._prepared, []

    def breaks(rows, some, *more):
        seen.append([s.name for s in some])
        if len(seen) == 2:
            folder = tmp_path / "out" / "sources" / "a" / "train"
            folder.mkdir(parents=True)
            (folder / "shard_000000.bin").write_bytes(b"half")
            raise RuntimeError("broken off")
        return prepared(rows, some, *more)

    monkeypatch.setattr(W, "_prepared", breaks)
    with pytest.raises(RuntimeError, match="broken off"):
        mix()
    assert seen == [["B"], ["A"]] and not (tmp_path / "out" / "manifest.json").exists()
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("b/*/*.bin")}
    want = mix()
    shards = stored(tmp_path / "out", want["train_shards"])
    assert seen[2:] == [["A"]] and before and all(p.stat().st_mtime_ns == t for p, t in before.items())
    assert (want["train_token_count"], want["val_token_count"]) == (80, 16) and W.verify(spark, str(tmp_path / "out" / "manifest.json"))["passed"]
    next(iter(before)).write_bytes(b"")  # a committed source that is no longer whole
    assert without_time(mix()) == without_time(want) and seen[3:] == [["B"]] and stored(tmp_path / "out", want["train_shards"]) == shards
    with pytest.raises(ValueError, match="another configuration"):
        mix(strict=False)
    spark.createDataFrame([(500, "more of it")], "row_id long, text string").write.mode("append").parquet(str(tmp_path / "in" / "A"))
    with pytest.raises(ValueError, match="another configuration"):
        mix()


def test_what_can_not_be_mixed(spark, mixed, tmp_path):
    folder, m, _, _ = mixed
    path = f"{folder}/manifest.json"
    with pytest.raises(FileExistsError):
        W.mix_chunks(spark, path, folder)
    with pytest.raises(ValueError, match="a token"):
        W.mix_chunks(spark, path, str(tmp_path / "a"), chunk_tokens=0)
    (tmp_path / "t.json").write_text("{}")
    with pytest.raises(ValueError, match="another tokenizer"):
        W.mix_chunks(spark, path, str(tmp_path / "a"), tokenizer=str(tmp_path / "t.json"))
    (tmp_path / "m.json").write_text(json.dumps(m | {"dtype": "uint32"}))
    with pytest.raises(ValueError, match="uint32"):
        W.mix_chunks(spark, str(tmp_path / "m.json"), str(tmp_path / "a"))
    assert not (tmp_path / "a").exists()


def test_an_assembly_compares_tokenizers_before_it_copies(spark, mixed, tmp_path):
    folder, _, _, _ = mixed
    config = {"sources": [{"name": "All", "kind": "tokenized_manifest", "manifest": f"{folder}/manifest.json"}], "target_train_tokens": 70}
    with pytest.raises(ValueError, match="another tokenizer"):
        W.assemble(spark, config, by_length(), str(tmp_path / "o"))
    assert not list(tmp_path.rglob("*.bin"))
