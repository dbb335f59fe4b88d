"""Likelihoods of texts, from windows to perplexities in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import spaced_parts
from . import stats as A
from . import tokens as K

#: The log-likelihood of the tokens of a window from a place on, given those before them in it.
Scorer = Callable[[Column, Column], Column]


def window_scores(docs: DataFrame, ids: Column, score: Scorer, most: int, start_id: int, groups: list[str], text_col: str = "text") -> DataFrame:
    """Rows (groups, ll, tokens, words, bytes), one for each window of each text; words and bytes stand in its first window alone.

    Every token is scored once.  A null text has no row; one without ids has a row without a score.
    """
    text = F.col(text_col)
    cut = docs.where(text.isNotNull()).select(*groups, spaced_parts(text).alias("words_"), F.octet_length(text).alias("bytes_"), F.posexplode_outer(K.rolling_windows(ids, most, start_id)).alias("no_", "w_"))
    first = F.coalesce(F.col("no_") == 0, F.lit(True))
    scored = F.coalesce(F.size("w_.tokens") - F.col("w_.score_start"), F.lit(0)).cast("long").alias("tokens")
    return cut.select(*groups, score(F.col("w_.tokens"), F.col("w_.score_start")).alias("ll"), scored, *(F.when(first, F.col(f"{c}_")).otherwise(0).cast("long").alias(c) for c in ("words", "bytes")))


def rolling_perplexity(docs: DataFrame, ids: Column, score: Scorer, most: int, start_id: int, groups: list[str], text_col: str = "text") -> DataFrame:
    """A row for each group: tokens, words, bytes, word_perplexity, byte_perplexity and bits_per_byte; windows are summed in each task first."""
    rows = window_scores(docs, ids, score, most, start_id, groups, text_col)
    ll, words, size = F.coalesce(F.col("ll"), F.lit(0.0)), F.col("words"), F.col("bytes")
    sums = [F.sum(c).alias(c) for c in ("tokens", "words", "bytes")]
    return rows.groupBy(*groups).agg(*sums, A.perplexity(ll, words).alias("word_perplexity"), A.perplexity(ll, size).alias("byte_perplexity"), A.bits(ll, size).alias("bits_per_byte"))
