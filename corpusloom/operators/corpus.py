"""Documents: cleaning, length, exact duplicates and benchmark contamination.

Rows carry `row_id`, an order that decides which of equal documents comes first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import storage
from ..functions import text as X
from . import shingles as S

WIDTH, LEAST_HITS = 12, 2


def digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def ranked_copies(docs: DataFrame, scope: list[str], text_col: str = "text", order_col: str = "row_id") -> DataFrame:
    """Adds copy_no, from 1, among equal texts of a scope in row order."""
    w = Window.partitionBy(*scope, digest(F.col(text_col))).orderBy(order_col)
    return docs.withColumn("copy_no", F.row_number().over(w))


def drop_copies(docs: DataFrame, scope: list[str], text_col: str = "text", order_col: str = "row_id") -> DataFrame:
    """The first of equal texts in each scope; Spark cuts each group to one row before the shuffle."""
    return ranked_copies(docs, scope, text_col, order_col).where("copy_no = 1").drop("copy_no")


def shingle_index(benchmarks: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct (benchmark, shingle) of rows (benchmark, text), whose text isn't cleaned."""
    words = X.normalized_words(F.col("text"))
    return benchmarks.select("benchmark", F.explode(X.word_shingles(words, width)).alias("shingle")).distinct()


def index_masks(index: DataFrame) -> DataFrame:
    """One row for each shingle, with a bit for each benchmark that has it."""
    return index.groupBy("shingle").agg(F.bit_or(F.expr("shiftleft(1, benchmark)")).alias("mask"))


def shingle_hits(docs: DataFrame, index: DataFrame | S.StoredIndex, width: int = WIDTH, keys: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Rows (keys, pos, benchmark): positions of documents whose shingle a benchmark has, repeats counted.

    The index is a stored one of this width, or rows (benchmark, shingle), which are stored first.
    """
    stored = index if isinstance(index, S.StoredIndex) else S.of_shingles(index, width)
    if stored.width != width:
        raise ValueError(f"the index has shingles of {stored.width} words, not {width}")
    return S.hits(docs, stored, keys)


def beside(rows: DataFrame, more: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows with the columns of the row of equal keys in more, null where there is none; null keys are equal."""
    other = more.withColumnsRenamed({k: f"{k}_" for k in keys})
    same = reduce(lambda a, b: a & b, (rows[k].eqNullSafe(other[f"{k}_"]) for k in keys))
    return rows.join(other, same, "left").drop(*(f"{k}_" for k in keys))


def hit_counts(hits: DataFrame, keys: tuple[str, ...] = ("row_id",)) -> DataFrame:
    return hits.groupBy(*keys, "benchmark").agg(F.count("*").alias("hits"))


def charged(hits: DataFrame, least: int = LEAST_HITS, keys: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Each contaminated document with the benchmark that reached `least` hits first, by position and then number."""
    w = Window.partitionBy(*keys, "benchmark").orderBy("pos")
    reached = hits.withColumn("n", F.row_number().over(w)).where(F.col("n") == least)
    return reached.groupBy(*keys).agg(F.min(F.struct("pos", "benchmark")).alias("first")).select(*keys, F.col("first.benchmark").alias("benchmark"))


def decontaminate(docs: DataFrame, index: DataFrame | S.StoredIndex, width: int = WIDTH, least: int = LEAST_HITS) -> DataFrame:
    return docs.join(charged(shingle_hits(docs, index, width), least).select("row_id"), "row_id", "left_anti")


def staged(docs: DataFrame, passes: Column, min_chars: int | Column = 0, normalize: bool = True, tokens: Column | None = None) -> DataFrame:
    """Rows (row_id, source, text, early, digest, n_tokens), written once: cleaned texts, and what drops a document before copies are looked for."""
    cleaned = docs.select("row_id", "source", passes.alias("passes"), X.nonblank(F.col("text")).alias("raw"), F.lit(min_chars).alias("least_chars"))
    cleaned = cleaned.withColumn("text", X.clean(F.col("raw"), normalize))
    early = (
        F.when(~F.col("passes"), "filtered")
        .when(F.col("raw").isNull(), "missing")
        .when(F.col("text") == "", "empty")
        .when(F.length("text") < F.col("least_chars"), "short")
    )
    n = F.lit(None).cast("long") if tokens is None else tokens
    out = cleaned.select("row_id", "source", "text", early.alias("early"), F.unhex(digest(F.col("text"))).alias("digest"), n.alias("n_tokens"))
    return storage.materialize(out, "staged")


def verdicts(rows: DataFrame, index: DataFrame | S.StoredIndex, width: int = WIDTH, least: int = LEAST_HITS) -> DataFrame:
    """Rows (row_id, source, n_tokens, disposition, benchmark, hits) of staged documents: what becomes of each, in the order in which things are tried.

    A later copy of a contaminated document is a duplicate.  Only ids, digests and
    hits are shuffled.  `hits` has the hits of a contaminated document by benchmark.
    """
    survivors = rows.where("early IS NULL")
    w = Window.partitionBy("source", "digest").orderBy("row_id")
    ranked = survivors.select("row_id", "source", "n_tokens", "digest").withColumn("copy_no", F.row_number().over(w)).drop("digest")
    keys = ("source", "row_id")
    found = storage.materialize(shingle_hits(survivors.select(*keys, "text"), index, width, keys), "shingle-hits")
    counts = hit_counts(found, keys).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("benchmark", "hits")))).alias("hits"))  # a row per benchmark
    bad = beside(charged(found, least, keys), counts, keys)
    disposition = F.when(F.col("copy_no") > 1, "duplicate").when(F.col("benchmark").isNotNull(), "contaminated").otherwise("accepted")
    first = F.col("copy_no") == 1
    late = beside(ranked, bad, keys).select("row_id", "source", "n_tokens", disposition.alias("disposition"), F.when(first, F.col("benchmark")).cast("int").alias("benchmark"), F.when(first, F.col("hits")).alias("hits"))
    return late.unionByName(rows.where("early IS NOT NULL").select("row_id", "source", "n_tokens", F.col("early").alias("disposition")), allowMissingColumns=True)


def dispositions(docs: DataFrame, passes: Column, index: DataFrame | S.StoredIndex, min_chars: int | Column = 0, width: int = WIDTH, least: int = LEAST_HITS, normalize: bool = True, tokens: Column | None = None) -> DataFrame:
    """`verdicts` of raw documents (row_id, source, text)."""
    return verdicts(staged(docs, passes, min_chars, normalize, tokens), index, width, least)


KINDS = ("filtered", "missing", "empty", "short", "duplicate", "contaminated", "accepted")


def counters(disposed: DataFrame) -> DataFrame:
    """A row for each source: raw and each disposition."""
    return disposed.groupBy("source").agg(F.count("*").alias("raw"), *(F.count_if(F.col("disposition") == k).alias(k) for k in KINDS))
