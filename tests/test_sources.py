"""Scans: row ids over files and folders, mixed kinds, folders of sources, manifests' paths."""

import gzip
import json

import pytest

from corpusloom.sources import readers as R


def test_row_ids_of_equal_names(spark, tmp_path):
    """Folders and files of equal base names: every row has its own id, in the order of whole paths."""
    for k, folder in enumerate(("b", "a x", "c/d")):
        for part in range(2):
            spark.range(10 * k + 100 * part, 10 * k + 100 * part + 5).coalesce(1).write.parquet(str(tmp_path / folder / f"part-{part}"))
    folders = [str(tmp_path / f / f"part-{p}") for f in ("b", "a x", "c/d") for p in (1, 0)]
    rows = R.parquet(spark, folders).collect()
    assert len({r.row_id for r in rows}) == len(rows) == 30
    assert [r.id for r in sorted(rows, key=lambda r: r.row_id)] == [10 * k + 100 * p + i for k in (1, 0, 2) for p in (0, 1) for i in range(5)]
    again = R.parquet(spark, folders[::-1] + folders[:1]).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_row_ids_of_lines(spark, tmp_path):
    """Blocks of a file may be read anywhere; ids follow the lines."""
    for name in ("b", "a"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.jsonl").write_text("".join(json.dumps({"n": i, "name": name}) + "\n" + "\n" * (i % 3) for i in range(300)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    rows = R.local(spark, [str(tmp_path / n / "x.jsonl") for n in ("b", "a")]).collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len({r.row_id for r in rows}) == 600
    assert [(r.name, r.n) for r in sorted(rows, key=lambda r: r.row_id)] == [(n, i) for n in ("a", "b") for i in range(300)]


def test_mixed_kinds(spark, tmp_path):
    with gzip.open(tmp_path / "b.json.gz", "wt") as f:
        f.write('{"text": "one", "k": 1}\n')
    (tmp_path / "a.txt").write_text("two<|endoftext|>three<|endoftext|>")
    (tmp_path / "c.md").write_text("four")
    rows = R.local(spark, [str(tmp_path / n) for n in ("b.json.gz", "c.md", "a.txt")]).collect()
    assert [(r.text, r.k) for r in sorted(rows, key=lambda r: r.row_id)] == [("two", None), ("three", None), ("one", 1), ("four", None)]
    spark.range(1).write.parquet(str(tmp_path / "d.parquet"))
    for bad in (["a.txt", "d.parquet"], ["a.txt", "e.csv"]):
        with pytest.raises(ValueError, match="unsupported"):
            R.local(spark, [str(tmp_path / n) for n in bad])
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\nno json\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        R.json_rows(spark, str(tmp_path / "bad.jsonl")).collect()


def test_folders_of_sources(spark, tmp_path):
    (tmp_path / "my-source").mkdir()
    (tmp_path / "my-source" / "1 a.jsonl").write_text('{"text": "x"}\n')
    (tmp_path / "my-source" / "b.jsonl").write_text('{"text": "y"}\n')
    (tmp_path / "my-source" / "skip.txt").write_text("z")
    rows = R.source_folder(spark, str(tmp_path), "My source", pattern="*.jsonl").collect()
    assert [r.text for r in sorted(rows, key=lambda r: r.row_id)] == ["x", "y"]
    for name, pattern in (("My source", "*.parquet"), ("other", "*.jsonl")):
        with pytest.raises(FileNotFoundError):
            R.source_folder(spark, str(tmp_path), name, pattern=pattern)


def test_benchmark_sets(spark, tmp_path):
    for split in ("train", "test"):
        (tmp_path / f"q-{split}.jsonl").write_text(json.dumps({"question": f"{split}?", "hint": "", "answer": "no"}) + "\n")
    (tmp_path / "other.jsonl").write_text('{"goal": "g", "sol": null}\n{"goal": null, "sol": "s"}\n')
    rows = R.benchmark_rows(spark, {"q": ([str(tmp_path / f"q-{s}.jsonl") for s in ("train", "test")], ["question", "hint"]), "o": ([str(tmp_path / "other.jsonl")], ["goal", "sol"])})
    assert sorted(map(tuple, rows.collect())) == [(0, "test?"), (0, "train?"), (1, "g"), (1, "s")]


def test_paths_of_entries(spark):
    entries = spark.createDataFrame([("/abs/x.bin",), ("train/x.bin",), ("elsewhere\\y.bin",), ("s3://b/z.bin",)], "path string")
    assert [r.uri for r in R.resolved(entries, "/m/manifest.json").collect()] == ["/abs/x.bin", "/m/train/x.bin", "/m/elsewhere/y.bin", "s3://b/z.bin"]
    disk = spark.createDataFrame([("/m/train/x.bin",), ("/m/val/y.bin",), ("/m/train/x.bin",)], "uri string")
    got = {r.path: r.uri for r in R.resolved(entries, "/m/manifest.json", disk).collect()}
    assert got["train/x.bin"] == "/m/train/x.bin" and got["elsewhere\\y.bin"] == "/m/val/y.bin" and len(got) == 4


def test_last_records(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text("".join(json.dumps({"step": i}) + "\n" for i in range(500)) + "broken\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    rows = R.metrics(spark, str(tmp_path / "m.jsonl"), "step long", 7).collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r.from_end: r.step for r in rows} == {i + 1: 499 - i for i in range(7)}


def test_remote_documents(spark, tmp_path, monkeypatch):
    (tmp_path / "few_rows.py").write_text("def open_rows(dataset, config, split, start):\n    for i in range(start, 6):\n        yield {'body': None if i == 1 else ' ' if i == 2 else f'{dataset} {i} '}\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    monkeypatch.setenv("PYTHONPATH", str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "few_rows.py"))
    rows = R.remote_documents(spark, "few_rows", "set", text_field="body", max_documents=3)
    assert [(r.row_no, r.text) for r in rows.collect()] == [(1, "set 0"), (4, "set 3"), (5, "set 4")]
    parts = R.remote_documents(spark, "few_rows", "set", text_field="body", rows="6", partitions="4")
    assert sorted(r.row_no for r in parts.collect()) == [1, 4, 5, 6] and parts.rdd.getNumPartitions() == 4


def test_run_files(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"run{k}").mkdir()
        (tmp_path / f"run{k}" / "status.json").write_text(json.dumps({"step": k}))
    assert sorted((r.run_id, r.step) for r in R.run_files(spark, str(tmp_path), "status.json").collect()) == [("run1", 1), ("run2", 2)]


def test_remote_stream(spark, tmp_path):
    """A query that breaks off before a batch is committed, and a set that grows: each row once."""
    from corpusloom.streaming import streams as T


    def look(count, there=None):
        (tmp_path / "count").write_text(str(count))
        (tmp_path / "there").write_text(str(count if there is None else there))
        stream = R.remote_stream(spark, "tests.remote_set", str(tmp_path), partitions="3", backoff="0.01")
        return sorted((r.row_no, json.loads(r.row)["i"]) for r in T.run_once(stream, str(tmp_path / "out")).collect())

    assert look(7) == [(i + 1, i) for i in range(7)]
    for f in (tmp_path / "out" / "state" / "commits").glob("*0*"):
        f.unlink()
    assert look(12) == [(i + 1, i) for i in range(7)]  # the batch that wasn't committed is run again first
    assert look(12) == [(i + 1, i) for i in range(12)]
    with pytest.raises(Exception, match="ended at row"):
        look(20, there=15)
    assert look(20) == [(i + 1, i) for i in range(20)]
    with pytest.raises(Exception, match="fewer than"):
        look(3)
