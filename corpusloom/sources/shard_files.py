"""Binary token shards: headerless little-endian 16-bit files, with their manifest."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_ID = 65_535
#: Ids of a slice of a shard; slices or shards that a task reads one after another; tasks that read at most.
SLICE, TOGETHER, MOST_TASKS = 1 << 18, 64, 10_000


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri) if re.match("[A-Za-z][A-Za-z0-9+.-]+:/", uri) else f"file://{os.path.abspath(uri)}")


def write_bytes(folder: str, name: str, data: bytes) -> None:
    """Under a name of its own first and then renamed, so that a repeated task does no harm."""
    store, base = filesystem(folder)
    store.create_dir(f"{base}/{name}".rpartition("/")[0], recursive=True)
    own = f"{base}/{name}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(own) as out:
        out.write(data)
    store.move(own, f"{base}/{name}")


def _write_file(folder: str, name: str, ids: np.ndarray) -> None:
    if len(ids) and (ids.min() < 0 or ids.max() > MOST_ID):
        raise ValueError("an id doesn't fit 16 bits")
    write_bytes(folder, name, ids.astype("<u2").tobytes())


def write(tokens: DataFrame, folder: str) -> DataFrame:
    """Write rows (split, shard_index, shard_offset, ids) as one file for each shard; rows (prefix, split, shard_index, path, token_count), to be kept in a manifest.

    Files are named <prefix>/shard_<index>.bin; rows without a prefix have their split
    for one.  Shards are of a fixed size, so a group is bounded by it.
    """

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        prefix, split, index = key
        ids = np.concatenate([np.asarray(x, np.int64) for x in rows.sort_values("shard_offset").ids])
        name = f"{prefix}/shard_{index:06d}.bin"
        _write_file(folder, name, ids)
        return pd.DataFrame([(prefix, split, index, name, len(ids))], columns=["prefix", "split", "shard_index", "path", "token_count"])

    prefix = F.col("prefix") if "prefix" in tokens.columns else F.col("split").alias("prefix")
    rows = tokens.select(prefix, "split", "shard_index", "shard_offset", "ids")
    return rows.groupBy("prefix", "split", "shard_index").applyInPandas(one, "prefix string, split string, shard_index long, path string, token_count long")


def cut(pieces: DataFrame) -> DataFrame:
    """Tokens of pieces (uri, file_tokens, at, tokens, and more) of shards: rows with ids in place of these four; of each shard the span that they cover is read once.

    A file whose size isn't twice its count is an error.
    """
    more = [f for f in pieces.schema.fields if f.name not in ("uri", "file_tokens", "at", "tokens")]

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        low, high = int(rows["at"].min()), int((rows["at"] + rows["tokens"]).max())
        ids = _load(key[0], int(rows.file_tokens.iloc[0]), low, high)
        rows = rows.assign(ids=[ids[a - low : a - low + n].astype(np.int32) for a, n in zip(rows["at"], rows["tokens"], strict=True)])
        return rows[[*(f.name for f in more), "ids"]]

    schema = T.StructType([*more, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return _dealt(pieces, "uri").groupBy("uri").applyInPandas(one, schema)


def copy(entries: DataFrame, folder: str) -> DataFrame:
    """Write the first `take` tokens of each entry (uri, token_count, take, path) to a shard of our own at path; rows (path, take)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for r in rows.itertuples():
                _write_file(folder, r.path, _load(r.uri, r.token_count, 0, r.take))
            yield rows[["path", "take"]]

    return _dealt(entries.select("uri", "token_count", "take", "path"), "path").mapInPandas(run, "path string, take long")


def _load(uri: str, tokens: int, begin: int = 0, end: int | None = None) -> np.ndarray:
    """Ids [begin, end) of a shard of so many tokens; no other bytes are read."""
    store, path = filesystem(uri)
    with store.open_input_file(path) as f:
        if f.size() != 2 * tokens:
            raise ValueError(f"{uri} has {f.size()} bytes for {tokens} tokens")
        return np.frombuffer(f.read_at(2 * ((tokens if end is None else end) - begin), 2 * begin), "<u2")


def read(spark: SparkSession, folder: str, entries: DataFrame, most: int = SLICE) -> DataFrame:
    """Rows (split, entry_no, path, at, ids) of listed shards, in slices of at most so many ids; a file whose size isn't twice its count is an error."""

    def load(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for r in rows.itertuples():
                ids = _load(f"{folder}/{r.path}", r.token_count, r.at, min(r.at + most, r.token_count)).astype(np.int32)
                yield pd.DataFrame({"split": [r.split], "entry_no": [r.entry_no], "path": [r.path], "at": [r.at], "ids": [ids]})

    last = F.greatest(F.col("token_count") - 1, F.lit(0)).cast("long")
    spans = entries.select("split", F.col("entry_no").cast("long").alias("entry_no"), "path", "token_count", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(most).cast("long"))).alias("at"))
    return _dealt(spans, "path", "at").mapInPandas(load, "split string, entry_no long, path string, at long, ids array<int>")


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows that say what to read, a few bytes each, by key over all cores, and beyond that over a task for every TOGETHER keys, up to MOST_TASKS.

    Their own size tells Spark nothing, and it would give them all to one task.
    """
    n, cores = rows.select(*keys).distinct().count(), rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(1, min(n, max(cores, n // TOGETHER), MOST_TASKS)), *keys)


def sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (path, bytes) of the shards on disk; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").option("recursiveFileLookup", True).load(folder)
    root = folder.rstrip("/").rpartition("/")[2] + "/"
    return files.select(F.substring_index("path", root, -1).alias("path"), F.col("length").alias("bytes"))


def write_json(path: str, value: object) -> None:
    """Sorted keys, two spaces; the file appears whole or not at all."""
    store, place = filesystem(path)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    own = f"{place}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(own) as out:
        out.write(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True).encode())
    store.move(own, place)


def exists(path: str) -> bool:
    store, place = filesystem(path)
    return store.get_file_info(place).type != pafs.FileType.NotFound


def read_json(path: str) -> dict:
    store, place = filesystem(path)
    with store.open_input_stream(place) as f:
        return json.loads(f.read())


def file_hash(path: str) -> str:
    """The sha256 of one file, read in parts."""
    store, place = filesystem(path)
    digest = hashlib.sha256()
    with store.open_input_stream(place) as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def holds_files(folder: str) -> bool:
    store, place = filesystem(folder)
    return any(f.type == pafs.FileType.File for f in store.get_file_info(pafs.FileSelector(place, allow_not_found=True, recursive=True)))
