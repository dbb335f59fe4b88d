"""The reader of shards against plain lists."""

import hashlib

import numpy as np
import pytest

from corpusloom.sources import shard_files as B
from corpusloom.sources.training import TokenReader


@pytest.fixture(scope="module")
def shards(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shards")
    sizes = {"train/s0.bin": 7, "train/s1.bin": 3, "train/s2.bin": 1, "train/s3.bin": 12, "val/v.bin": 5}
    data, at = {}, 0
    for path, n in sizes.items():
        (folder / path).parent.mkdir(exist_ok=True)
        data[path] = list(range(at, at + n))
        np.array(data[path], "<u2").tofile(folder / path)
        at += n
    listed = {s: [{"path": p, "token_count": n} for p, n in sizes.items() if p.startswith(s)] for s in ("train", "val")}
    B.write_json(str(folder / "manifest.json"), {"dtype": "uint16", "train_shards": listed["train"], "val_shards": listed["val"]})
    return str(folder / "manifest.json"), data


def stream(data, seed, epochs, shuffle=True):
    out = []
    for e in range(epochs):
        paths = sorted(p for p in data if p.startswith("train"))
        if shuffle:
            paths.sort(key=lambda p: hashlib.md5(f"{seed + e}|{p}".encode()).hexdigest()[:15])
        out += [x for p in paths for x in data[p]]
    return out


def rows(df):
    return [(r.batch, r.row, list(r.inputs), list(r.targets)) for r in df.orderBy("batch", "row").collect()]


def expected(tokens, begin, n, height, width):
    place = lambda k, i: begin + (k * height + i) * width
    return [(k, i, tokens[place(k, i) : place(k, i) + width], tokens[place(k, i) + 1 : place(k, i) + width + 1]) for k in range(n) for i in range(height)]


@pytest.mark.parametrize("shuffle", [True, False])
def test_batches_over_epochs(spark, shards, shuffle):
    """Inputs go on over shards and epochs without a gap; the last target of an epoch is the first token of the next."""
    path, data = shards
    reader = TokenReader(spark, path, shuffle=shuffle, seed=5)
    tokens = stream(data, 5, 8, shuffle)
    assert reader.total == 23
    assert rows(reader.batches(3, 2, 4)) == expected(tokens, 0, 3, 2, 4)
    assert rows(reader.batches(2, 1, 11)) == expected(tokens, 24, 2, 1, 11)  # ends where the second epoch ends
    assert reader.position == 46 and reader.state()["epoch"] == 2 and reader.state()["offset_in_shard"] == 0
    assert rows(reader.batches(1, 1, 60)) == expected(tokens, 46, 1, 1, 60)
    assert [x for r in sorted(reader.read(9).collect()) for x in r.ids] == tokens[106:115]


def test_resume(spark, shards):
    path, data = shards
    reader = TokenReader(spark, path)
    reader.batches(3, 3, 3)
    state = reader.state()
    other = TokenReader(spark, path).resume(state)
    assert other.position == 27 and rows(other.batches(2, 2, 5)) == rows(reader.batches(2, 2, 5)) == expected(stream(data, 1337, 3), 27, 2, 2, 5)
    for change, words in (({"manifest_hash": "0"}, "manifest_hash"), ({"split": "val"}, "split"), ({"shuffle_shards": False}, "shuffle"), ({"shuffle_seed": 1}, "seed"), ({"order_position": 99}, "order"), ({"shard_index": state["shard_index"] + 1}, "order"), ({"offset_in_shard": 99}, "beyond")):
        with pytest.raises(ValueError, match=words):
            TokenReader(spark, path).resume(state | change)


def test_what_can_not_be_read(spark, shards, tmp_path):
    path, _ = shards
    with pytest.raises(ValueError, match="positive"):
        TokenReader(spark, path).batches(1, 0, 3)
    assert TokenReader(spark, path, split="val").total == 5
    np.zeros(1, "<u2").tofile(tmp_path / "a.bin")
    one = {"train_shards": [{"path": "a.bin", "token_count": 1}]}
    B.write_json(str(tmp_path / "manifest.json"), one)
    with pytest.raises(ValueError, match="fewer than two"):
        TokenReader(spark, str(tmp_path / "manifest.json"))
    B.write_json(str(tmp_path / "manifest.json"), one | {"dtype": "uint32"})
    with pytest.raises(ValueError, match="uint32"):
        TokenReader(spark, str(tmp_path / "manifest.json"))
    B.write_json(str(tmp_path / "manifest.json"), {"train_shards": [{"path": "a.bin", "token_count": 4}]})
    with pytest.raises(Exception, match="2 bytes for 4 tokens"):
        TokenReader(spark, str(tmp_path / "manifest.json")).batches(1, 1, 2).collect()
