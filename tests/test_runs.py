"""Checkpoints, hashes, progress and cursors."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import runs
from corpusloom.sources.progress import Cursor, Progress, broken


def test_checkpoints_and_hashes(spark, tmp_path):
    paths = spark.createDataFrame([("r/step_2",), ("r/step_10",), ("r/tokens_1m",), ("r/step_7",)], "path string")
    listed = runs.checkpoints(paths)
    assert [r.step for r in listed.collect()] == [10, 7, 2] and [r.step for r in runs.prunable(listed, 1).collect()] == [7, 2]
    (tmp_path / "a").write_bytes(b"abc")
    assert runs.file_hashes(spark, str(tmp_path / "a")).first().sha256.startswith("ba7816bf")
    assert runs.canonical_hash({"b": 1, "a": [2]}) == runs.canonical_hash({"a": [2], "b": 1})
    assert runs.same_json('{"a":1,"b":2}', '{"b": 2, "a": 1}')
    m = spark.range(1).select(F.create_map(F.lit("d"), F.lit("1"), F.lit("model_name"), F.lit("x")).alias("a"), F.create_map(F.lit("model_name"), F.lit("y"), F.lit("d"), F.lit("1")).alias("b"))
    assert m.select(runs.compatible(F.col("a"), F.col("b"))).first()[0]
    runs.write_csv([spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(3,)], "c int")], str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["a", "b", "c"]
    assert runs.known_columns(m, ["z", "a"]).columns == ["a"]


def test_progress(tmp_path):
    path = str(tmp_path / "p.json")
    Progress.load(path, {"x": 1}).finish("A", {"tokens": 5})
    assert Progress.load(path, {"x": 1}).open(["A", "B"]) == ["B"]
    with pytest.raises(ValueError):
        Progress.load(path, {"x": 2})


def test_broken_shards(spark):
    entries = spark.createDataFrame([("a", 2), ("b", 2), ("c", 1)], "path string, token_count long")
    disk = spark.createDataFrame([("a", 4), ("b", 3)], "path string, bytes long")
    assert {r.path for r in broken(entries, disk).collect()} == {"b", "c"}


def test_cursor(spark):
    stream = spark.range(10).select(F.col("id").alias("pos"), F.col("id").alias("token"))
    c = Cursor("m", "train", 10)
    assert [r.token for r in c.read(stream, 7).collect()] == list(range(7))
    again = Cursor.resume(c.state(), "m", "train", 10)
    assert [r.token for r in again.read(stream, 6).collect()] == [7, 8, 9, 0, 1, 2] and (again.epoch, again.pos) == (1, 3)
    with pytest.raises(ValueError):
        Cursor.resume(c.state(), "other", "train", 10)
