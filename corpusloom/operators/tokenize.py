"""Subword tokenizers over Arrow batches, and the audit of a vocabulary."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import storage
from ..functions import text as X
from .stats import id_counts

#: Names that stand for the special ids.
SPECIAL = {"pad": ("<pad>",), "unk": ("<unk>",), "bos": ("<bos>", "<s>", "<|startoftext|>"), "eos": ("<eos>", "</s>", "<|endoftext|>")}
MOST_VOCABULARY = 65_536


class Tokenizer:
    """A tokenizer file: .json by the tokenizers library, anything else by SentencePiece."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path.endswith(".json"):
            from tokenizers import Tokenizer as Fast

            fast = Fast.from_file(path)
            fast.encode_special_tokens = True
            self.size, find = fast.get_vocab_size(), fast.token_to_id
            self.encode_all = lambda texts: [e.ids for e in fast.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            from sentencepiece import SentencePieceProcessor

            piece = SentencePieceProcessor(model_file=path)
            self.size = piece.get_piece_size()
            find = lambda t: piece.piece_to_id(t) if piece.id_to_piece(piece.piece_to_id(t)) == t else None
            self.encode_all = lambda texts: piece.encode(texts, num_threads=1)
        if self.size > MOST_VOCABULARY:
            raise ValueError(f"a vocabulary of {self.size} doesn't fit 16 bits")
        self.special = {k: next((i for n in names if (i := find(n)) is not None), None) for k, names in SPECIAL.items()}

    def encode(self, texts: list[str], bos: bool = False, eos: bool = True) -> list[list[int]]:
        ends = [self.special["bos"]] if bos else [], [self.special["eos"]] if eos else []
        if None in ends[0] + ends[1]:
            raise ValueError("the tokenizer lacks a special token that is asked for")
        return [[*ends[0], *ids, *ends[1]] for ids in self.encode_all(texts)]


_loaded: dict[str, Tokenizer] = {}


def load(path: str) -> Tokenizer:
    """One per worker process."""
    if path not in _loaded:
        _loaded[path] = Tokenizer(path)
    return _loaded[path]


def encode(c: Column, path: str, bos: bool = False, eos: bool = True) -> Column:
    """Ids of a text column; a null text has null ids."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            ids = load(path).encode([t or "" for t in texts], bos, eos)
            yield pd.Series([None if t is None else i for t, i in zip(texts, ids, strict=True)], dtype=object)

    return run(c)


def vocabulary(spark: SparkSession, tokens: dict[str, int]) -> DataFrame:
    """Rows (id, token, raw_hex, text, bytes, valid) of a byte-level vocabulary."""
    rows = spark.createDataFrame(sorted((i, t) for t, i in tokens.items()), "id long, token string")
    rows = rows.withColumn("raw_hex", X.byte_level_hex(F.col("token")))
    raw = F.unhex("raw_hex")
    return rows.select("*", F.try_validate_utf8(raw.cast("string")).alias("text"), F.octet_length(raw).alias("bytes"), F.is_valid_utf8(raw.cast("string")).alias("valid"))


def audit(vocabulary_rows: DataFrame, counts: DataFrame, longest: int = 32, rare: int = 10) -> DataFrame:
    """One row of checks over learned tokens, those of several bytes; counts: (id, n)."""
    v = vocabulary_rows.join(counts, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    text, learned = F.coalesce("text", F.lit("")), F.col("bytes") > 1
    found = {
        "base64_like": X.looks_base64(text),
        "hex_like": X.looks_hex(text),
        "han": X.has_han(text),
        "control": F.rlike("raw_hex", F.lit("^(..)*(0[0-8BCEF]|1.)")),
        "overlong": F.col("bytes") > longest,
        "rare_words": (F.col("n") <= rare) & X.looks_word(text),
    }
    return v.agg(F.count_if(~learned).alias("single_bytes"), F.count_if(learned).alias("learned"), *(F.count_if(learned & c).alias(k) for k, c in found.items()))


def sample_statistics(texts: DataFrame, path: str, most: int = 4_000) -> tuple[DataFrame, DataFrame]:
    """Of texts (text): one row (documents, lines, chars, tokens, unknown, chars_per_token, unknown_rate) and the counts (id, n) of their ids.

    Texts are cleaned, cut to lines of at most so many characters and encoded line by line, without an end mark.
    """
    cleaned = texts.select(X.clean(F.col("text")).alias("t")).where("t <> ''")
    lines = cleaned.select(F.posexplode(X.segments(F.col("t"), most)).alias("k", "line")).select("k", "line", encode(F.col("line"), path, eos=False).alias("ids"))
    lines = storage.materialize(lines.select("k", F.length("line").cast("long").alias("chars"), "ids"), "encoded-lines")
    counts = id_counts(lines, []).withColumnRenamed("token", "id")
    unknown = load(path).special["unk"]
    sizes = lines.agg(F.count_if(F.col("k") == 0).alias("documents"), F.count("*").alias("lines"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"))
    tokens = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.when(F.col("id") == (-1 if unknown is None else unknown), F.col("n"))), F.lit(0)).alias("unknown"))
    both = sizes.join(F.broadcast(tokens))
    return both.withColumns({"chars_per_token": F.col("chars") / F.greatest("tokens", F.lit(1)), "unknown_rate": F.col("unknown") / F.greatest("tokens", F.lit(1))}), counts


def metadata(path: str, **more: Any) -> dict[str, Any]:
    """What is to be kept beside a tokenizer file: kind, size, special ids, its hash, how texts are cleaned, and more."""
    t = load(path)
    with open(path, "rb") as f:
        digest = hashlib.sha256(f.read()).hexdigest()
    kind = "tokenizers" if path.endswith(".json") else "sentencepiece"
    return {"version": 1, "type": kind, "tokenizer": path, "actual_vocab_size": t.size, "special_tokens": dict(t.special), "model_sha256": digest, "text_cleanup": "NFKC; no control, format and private characters; single spaces"} | more
