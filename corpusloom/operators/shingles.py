"""A stored index of benchmark shingles, and its hits in documents.

A shingle's hash is a polynomial of its words' hashes modulo 2^64, rolled along a
text.  The index is a table of distinct hashes, each with a bit for every benchmark
that has it, range-partitioned and sorted, beside a report.  It is built once and
read by whatever looks for hits.  A worker probes it as one sorted array of 8 bytes
a hash, behind a small bitmap, so that documents neither move nor become rows; an
index beyond ``MOST_BYTES`` is joined by a shuffle of hashes instead.

A text without `width` words has no shingles; null texts have none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import storage
from ..sources import shard_files as B

#: The base of the polynomial, the bytes of a word's BLAKE2b hash, least width of a stored index.
BASE, DIGEST_BYTES, LEAST_WIDTH = 1_000_003, 8, 8
#: Bytes of an index that is sent to every worker.
MOST_BYTES = 128_000_000
#: Bytes of text hashed together, words remembered by a worker, hashes rolled together.
TOGETHER, MOST_WORDS, BLOCK = 4_000_000, 400_000, 1 << 16
_LETTERS = bytes(c if 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
_INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])


class WordHashes(dict):
    """Hashes of words, as unsigned numbers."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MOST_WORDS:
            self.clear()
        self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=DIGEST_BYTES).digest(), "little")
        return self[word]

    def of(self, text: str) -> np.ndarray:
        """Of each run of a-z and 0-9 of the folded text."""
        folded, parts, at = text.casefold().encode("utf-8", "replace").translate(_LETTERS), [], 0
        while at < len(folded):
            end = folded.find(b" ", at + TOGETHER)
            words = folded[at : len(folded) if end < 0 else end].split()
            parts.append(np.array([self[w] for w in words], np.uint64))
            at = len(folded) if end < 0 else end
        return np.concatenate(parts) if parts else np.empty(0, np.uint64)


class Roller:
    """Hashes of every run of `width` words, from the hashes of the words."""

    def __init__(self, width: int) -> None:
        self.width, self.up, self.down = width, _powers(BASE, BLOCK + width), _powers(_INVERSE, BLOCK + width)

    def rolled(self, words: np.ndarray) -> np.ndarray:
        out = []
        for at in range(0, len(words) - self.width + 1, BLOCK):
            h = words[at : at + BLOCK + self.width - 1]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.down[: len(h)])])
            n = len(h) - self.width + 1
            out.append((sums[self.width :] - sums[:n]) * self.up[self.width - 1 : self.width - 1 + n])
        return np.concatenate(out) if out else np.empty(0, np.uint64)


def _parts(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Rows of about TOGETHER characters of text, one at least."""
    at, held = 0, 0
    for i, t in enumerate(batch.column(text).to_pylist()):
        n = len(t or "")
        if i > at and held + n > TOGETHER:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if batch.num_rows > at:
        yield batch.slice(at)


def _hashed(batch: pa.RecordBatch, text: int, words: WordHashes, roller: Roller) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all shingles of a batch the hash, the row and the place in its text."""
    each = [words.of(t or "") for t in batch.column(text).to_pylist()]
    sizes = np.array([len(x) for x in each], np.int64)
    row = np.repeat(np.arange(len(each)), sizes)
    hashes = roller.rolled(np.concatenate([*each, np.empty(0, np.uint64)]))
    inside = row[: len(hashes)] == row[roller.width - 1 : roller.width - 1 + len(hashes)]
    at = np.flatnonzero(inside)
    return hashes[at].view(np.int64), row[at], at - (np.cumsum(sizes) - sizes)[row[at]]


@dataclass
class StoredIndex:
    """An index on disk: hashes (hash, mask) and the report beside them."""

    spark: SparkSession
    folder: str
    width: int
    count: int
    benchmarks: list[str]

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> StoredIndex:
        r = B.read_json(f"{folder}/report.json")
        return cls(spark, folder, r["shingle_width"], r["unique_shingles"], r["benchmarks"])

    def rows(self) -> DataFrame:
        return self.spark.read.schema("hash long, mask long").parquet(f"{self.folder}/hashes")

    def report(self) -> dict[str, Any]:
        return B.read_json(f"{self.folder}/report.json")

    def shingles(self) -> DataFrame:
        """Rows (benchmark, shingles): distinct shingles of each."""
        bit = F.explode(F.sequence(F.lit(0), F.lit(len(self.benchmarks) - 1))).alias("benchmark")
        return self.rows().select(bit, "mask").where(F.expr("(mask >> benchmark) & 1 = 1")).groupBy("benchmark").agg(F.count("*").alias("shingles"))

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes and their masks, on the driver; only called below MOST_BYTES."""
        found = self.rows().toArrow()
        hashes, masks = (np.asarray(found[c].combine_chunks()) for c in ("hash", "mask"))
        order = np.argsort(hashes)
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if len(self.benchmarks) <= 8 * np.dtype(k).itemsize)
        return hashes[order], masks[order].astype(kind)


def build(benchmarks: DataFrame, folder: str, width: int, names: list[str]) -> StoredIndex:
    """Store the index of rows (benchmark, a number; text, not cleaned) and its report; `names` are those of the benchmarks by number."""
    if len(names) > 63:
        raise ValueError("an index has a bit for each of at most 63 benchmarks")
    spark = benchmarks.sparkSession
    chosen = benchmarks.select(F.col("benchmark").cast("long").alias("benchmark"), F.col("text").cast("string").alias("text"))
    seen = {r.benchmark: r["count"] for r in chosen.groupBy("benchmark").count().collect()}  # a row for each benchmark
    if set(seen) - set(range(len(names))):
        raise ValueError("a benchmark has no name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, roller = WordHashes(), Roller(width)
        for whole in batches:
            for b in _parts(whole, 1):
                hashes, row, _ = _hashed(b, 1, words, roller)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(hashes)], ["benchmark", "hash"])

    pairs = chosen.mapInArrow(run, "benchmark long, hash long")
    masks = pairs.groupBy("hash").agg(F.bit_or(F.expr("shiftleft(1L, cast(benchmark as int))")).alias("mask"))
    masks.repartitionByRange("hash").sortWithinPartitions("hash").write.mode("overwrite").parquet(f"{folder}/hashes")
    index = StoredIndex(spark, folder, width, spark.read.parquet(f"{folder}/hashes").count(), names)
    report = {
        "version": 1,
        "benchmarks": names,
        "public_rows": {n: seen.get(i, 0) for i, n in enumerate(names)},
        "shingle_width": width,
        "unique_shingles": index.count,
        "rejection_rule": "at least two exact normalized word shingles from the same benchmark",
        "includes_answers": False,
    }
    B.write_json(f"{folder}/report.json", report)
    return index


def publish(benchmarks: DataFrame, folder: str, width: int, names: list[str]) -> StoredIndex:
    """`build` for an index that others rely on: shingles of few words would match at random."""
    if width < LEAST_WIDTH:
        raise ValueError(f"a stored index needs shingles of at least {LEAST_WIDTH} words")
    return build(benchmarks, folder, width, names)


def of_shingles(index: DataFrame, width: int) -> StoredIndex:
    """The stored form of rows (benchmark, shingle), in a folder of its own."""
    spark = index.sparkSession
    top = index.agg(F.max("benchmark")).first()[0]
    return build(index.select("benchmark", F.col("shingle").alias("text")), storage.work_dir(spark, "shingle-index"), width, [str(i) for i in range(0 if top is None else top + 1)])


def hits(docs: DataFrame, index: StoredIndex, keys: tuple[str, ...] = ("row_id",), text_col: str = "text") -> DataFrame:
    """Rows (keys, pos, benchmark): places of documents whose shingle a benchmark has, repeats counted."""
    spark, width = docs.sparkSession, index.width
    rows = docs.select(*keys, F.col(text_col).cast("string").alias("text_"))
    kept = [rows.schema[k] for k in keys]
    n = len(keys)
    small = index.count * (8 + (len(index.benchmarks) + 7) // 8) <= MOST_BYTES
    if small:
        hashes, masks = index.arrays()
        bits = max(10, min(24, len(hashes).bit_length() + 3))
        shared = spark.sparkContext.broadcast((hashes, masks, bits))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        words, roller = WordHashes(), Roller(width)
        for whole in batches:
            for b in _parts(whole, n):
                yield b, *_hashed(b, n, words, roller)

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, masks, bits = shared.value
        there = np.zeros(1 << bits, bool)
        there[hashes.view(np.uint64) >> np.uint64(64 - bits)] = True
        for b, h, row, pos in hashed(batches):
            likely = np.flatnonzero(there[h.view(np.uint64) >> np.uint64(64 - bits)])
            at = np.searchsorted(hashes, h[likely])
            found = np.flatnonzero(hashes[np.minimum(at, len(hashes) - 1)] == h[likely]) if len(hashes) else at[:0]
            place, mask = likely[found], masks[at[found]]
            benchmark = [np.flatnonzero(mask >> k & 1) for k in range(8 * masks.itemsize)]
            which = np.concatenate(benchmark).astype(np.int64)
            number = np.repeat(np.arange(len(benchmark)), [len(x) for x in benchmark])
            yield _batch(b, row[place[which]], pos[place[which]], pa.array(number, pa.int32()), "benchmark")

    def _batch(b: pa.RecordBatch, row: np.ndarray, pos: np.ndarray, last: pa.Array, name: str) -> pa.RecordBatch:
        at = pa.array(row)
        return pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(n)), pa.array(pos, pa.int32()), last], [*keys, "pos", name])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, h, row, pos in hashed(batches):
            yield _batch(b, row, pos, pa.array(h), "hash")

    if small:
        return rows.mapInArrow(probed, T.StructType([*kept, T.StructField("pos", T.IntegerType()), T.StructField("benchmark", T.IntegerType())]))
    places = rows.mapInArrow(told, T.StructType([*kept, T.StructField("pos", T.IntegerType()), T.StructField("hash", T.LongType())]))
    bit = F.explode(F.sequence(F.lit(0), F.lit(len(index.benchmarks) - 1))).alias("benchmark")
    return places.join(index.rows(), "hash").select(*keys, "pos", "mask", bit).where(F.expr("(mask >> benchmark) & 1 = 1")).drop("mask")
