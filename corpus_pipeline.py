"""The corpus pipeline: quality, near-duplicates, secrets, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs.  All but the last return the
columns of documents; the last returns the token ids of every document that the
mixture holds, once for each of its copies.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import _shared, op2_secrets, op3_mixing, op4_quality, op5_bpe, op7_simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the classifier reject go.

    Null and empty texts fail the rules.  Rows are judged by their text alone, so null
    ids do no harm and repeated rows fare alike; no rows give none.
    """
    docs = docs.select(*COLUMNS)
    return op4_quality.keep_good(docs, op4_quality.train(docs, _shared.read_table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the row of the smallest id, null ids last.

    Of rows with that id the one of the smallest hash stays, of equal rows one.  Null
    texts and those without words are one group; no rows give none.
    """
    return op7_simhash.keep_one(docs.select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; n_chars follows the text.

    All rows stay, repeated ones too.  A null text stays null and keeps its n_chars.
    """
    clean = op2_secrets.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source gets an equal share by Poisson replication; copies are globally shuffled.

    A null source is one of its own.  Rows of one id draw equal counts, null ids draw
    by their texts; ties of the shuffle go by id, copy and text.  No rows give none.
    """
    return op3_mixing.replicate(docs.select(*COLUMNS)).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and digests of them and of what they decode to: a row for each row.

    Null and empty texts have no ids; no rows give none.
    """
    return op5_bpe.coded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources", mixing),
    ("byte-level BPE", encoding),
]

#: SQL can express neither the classifier nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = _shared.read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = _shared.materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
