"""Helpers of the training-data operators: the shared folder, files on any store, text batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, shared_root, work_dir

__all__ = ["filesystem", "materialize", "read_table", "shared_root", "shuffle_partitions", "slices", "spread", "texts_of", "work_dir", "write_json", "write_whole"]

#: Rows and text bytes that a Python worker handles at once.
SLICE_ROWS, SLICE_BYTES = 512, 8_000_000


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; a bare path is local."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_whole(uri: str, data: bytes) -> None:
    store, path = filesystem(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path) as out:
        out.write(data)


def write_json(uri: str, value: object) -> None:
    write_whole(uri, json.dumps(value, sort_keys=True, indent=1).encode())


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, n: int) -> DataFrame:
    """Deal a small driver-made table out evenly, one row to a task as far as n goes."""
    return df.coalesce(1).repartition(max(1, n))


def slices(batch: pa.RecordBatch, column: str = "text", rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds at most so many rows and, but for one long row, bytes of text."""
    at, held = 0, 0
    offsets = batch.column(batch.schema.get_field_index(column))
    lengths = pc.binary_length(offsets).fill_null(0).to_pylist()
    for i, n in enumerate(lengths):
        if i > at and (i - at >= rows or held + n > size):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if batch.num_rows > at:
        yield batch.slice(at)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """The needed columns alone, so that extra columns of any name do no harm; a null text is empty."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), *(docs[c] for c in more))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
