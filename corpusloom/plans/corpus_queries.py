"""Queries of duplicates, contamination, counters and whole preparations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions import predicates as P
from ..functions import text as X
from ..operators import corpus as C
from ..operators import shingles as H
from ..operators import tokens as K
from . import prepare
from . import sql as S
from .registry import query, table


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select(F.col("doc_id").alias("row_id"), "source", "lang", X.clean(F.col("text")).alias("text"))


def benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select((F.col("item_id") % 4).alias("benchmark"), "text")


_stored: dict[tuple[str, str, str], H.StoredIndex] = {}


def index(spark: SparkSession, sf_dir: str) -> H.StoredIndex:
    """The stored index of the benchmarks, built once for all queries of a session."""
    key = (spark.sparkContext.applicationId, storage.shared_root(spark), sf_dir)
    if key not in _stored:
        _stored[key] = H.publish(benchmarks(spark, sf_dir), storage.work_dir(spark, "benchmark-index"), C.WIDTH, [f"set {i}" for i in range(4)])
    return _stored[key]


def named(df: DataFrame, *columns: str | Column) -> DataFrame:
    return df.select(F.col("row_id").alias("doc_id"), *columns)


@query(f"WITH {S.CLEAN}, {S.UNIQUE} SELECT doc_id, source FROM u")
def dedup_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(C.drop_copies(cleaned(spark, sf_dir).where("text <> ''"), ["source"]), "source")


@query(f"WITH {S.CLEAN} SELECT doc_id, source FROM c WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1")
def dedup_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(C.drop_copies(cleaned(spark, sf_dir).where("text <> ''"), []), "source")


@query(f"WITH {S.INDEX} SELECT shingle, CAST(bit_or(CAST(1 << benchmark AS BIGINT)) AS BIGINT) AS mask FROM x GROUP BY shingle")
def benchmark_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.index_masks(C.shingle_index(benchmarks(spark, sf_dir))).select("shingle", F.col("mask").cast("long").alias("mask"))


@query(f"WITH {S.INDEX} SELECT r.benchmark, rows, shingles FROM (SELECT benchmark, count(*) AS rows FROM b GROUP BY 1) r JOIN (SELECT benchmark, count(*) AS shingles FROM x GROUP BY 1) s USING (benchmark)")
def benchmark_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and distinct shingles of each benchmark, as the stored index and its report have them."""
    stored = index(spark, sf_dir)
    seen = stored.report()["public_rows"]
    rows = spark.createDataFrame([(i, seen[n]) for i, n in enumerate(stored.benchmarks)], "benchmark long, rows long")
    return rows.join(stored.shingles(), "benchmark")


@query(f"WITH {S.CLEAN}, {S.INDEX}, {S.hits('c')} SELECT doc_id, benchmark, count(*) AS hits FROM h GROUP BY ALL")
def benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(C.hit_counts(C.shingle_hits(cleaned(spark, sf_dir), index(spark, sf_dir))), "benchmark", "hits")


@query(f"WITH {S.CLEAN}, {S.INDEX}, {S.hits('c')}, {S.CHARGED} SELECT doc_id, benchmark FROM g")
def contamination_charged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(C.charged(C.shingle_hits(cleaned(spark, sf_dir), index(spark, sf_dir))), "benchmark")


@query(f"WITH {S.CLEAN}, {S.UNIQUE}, {S.INDEX}, {S.hits('u')}, {S.CHARGED} SELECT doc_id, source FROM u ANTI JOIN g USING (doc_id)")
def decontaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "row_id")
    return named(C.dispositions(d, F.lit(True), index(spark, sf_dir)).where("disposition = 'accepted'"), "source")


_DISPOSED = f"""a_ AS (SELECT doc_id, source, lang, nullif({S.strip("text")}, '') AS raw FROM documents),
d_ AS (SELECT doc_id, source, {S.clean("raw")} AS text, CASE WHEN NOT (lang = 'en') OR lang IS NULL THEN 'filtered' WHEN raw IS NULL THEN 'missing' WHEN {S.clean("raw")} = '' THEN 'empty' WHEN length({S.clean("raw")}) < 200 THEN 'short' END AS early FROM a_),
k_ AS (SELECT *, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS copy FROM d_ WHERE early IS NULL),
f_ AS (SELECT * FROM k_ WHERE copy = 1), {S.INDEX}, {S.hits("f_")}, {S.CHARGED},
z AS (SELECT doc_id, source, text, CASE WHEN copy > 1 THEN 'duplicate' WHEN benchmark IS NOT NULL THEN 'contaminated' ELSE 'accepted' END AS disposition FROM k_ LEFT JOIN g USING (doc_id)
  UNION ALL SELECT doc_id, source, text, early FROM d_ WHERE early IS NOT NULL)"""


def disposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "row_id").withColumnRenamed("lang", "language")
    return C.dispositions(d, P.conditions(d, {"language": "en"}), index(spark, sf_dir), 200, tokens=K.word_count(F.col("text")))


@query(f"WITH {_DISPOSED} SELECT source, count(*) AS raw, " + ", ".join(f"count(*) FILTER (disposition = '{k}') AS {k}" for k in C.KINDS) + " FROM z GROUP BY source")
def preparation_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.counters(disposed(spark, sf_dir))


_TRAIN = f"""t_ AS (SELECT doc_id, source, text, {S.TOKENS} AS n FROM z WHERE disposition = 'accepted'),
q_ AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY doc_id) - n AS before FROM t_),
y AS (SELECT doc_id, source, CAST(n AS BIGINT) AS n_tokens, CAST(least(n, 5000 - before) AS BIGINT) AS take FROM q_ WHERE before < 5000)"""


@query(f"WITH {_DISPOSED}, {_TRAIN} SELECT source, count(*) AS documents, CAST(sum(take) AS BIGINT) AS tokens, count(*) FILTER (take < n_tokens) AS truncated FROM y GROUP BY source")
def mixed_preparation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: filter, clean, drop copies and contaminated documents, count tokens, fill each source's budget."""
    return prepare.summary(prepare.mix(disposed(spark, sf_dir), 5000))


def split_sql(rows: str, train: int, val: int) -> str:
    """CTE y: what exact budgets take of rows (doc_id, source, n, c), c being the coin."""
    return f"""s_ AS ({rows}),
v1 AS (SELECT *, coalesce(sum(n) FILTER (c) OVER w, 0) AS vs FROM s_ WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
v2 AS (SELECT *, c AND vs - n < {val} AS v FROM v1),
v3 AS (SELECT *, coalesce(sum(n) FILTER (NOT v) OVER w, 0) AS ts FROM v2 WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
v4 AS (SELECT *, min(CASE WHEN NOT v AND ts >= {train} THEN doc_id END) OVER (PARTITION BY source) AS full_at FROM v3),
v5 AS (SELECT *, v OR coalesce(doc_id > full_at, false) AS tv FROM v4),
v6 AS (SELECT *, coalesce(sum(n) FILTER (tv) OVER w, 0) AS fs FROM v5 WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
y AS (SELECT doc_id, source, CASE WHEN tv THEN 'val' ELSE 'train' END AS split, CAST(n AS BIGINT) AS n_tokens,
  CAST(greatest(0, least(n, CASE WHEN tv THEN {val} - (fs - n) ELSE {train} - (ts - n) END)) AS BIGINT) AS take FROM v6)"""


_SPLIT = split_sql(f"SELECT doc_id, source, {S.TOKENS} AS n, {S.coin(1337, 'source', 'doc_id')} < 0.1 AS c FROM u", 3000, 300)


def split_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    unique = C.drop_copies(cleaned(spark, sf_dir).where("text <> ''"), ["source"])
    counted = unique.select("source", "row_id", K.word_count(F.col("text")).alias("n_tokens"), F.lit(3000).cast("long").alias("budget"), F.lit(300).cast("long").alias("val_budget"))
    return K.quota(counted, 0.1, 1337)


@query(f"WITH {S.CLEAN}, {S.UNIQUE}, {_SPLIT} SELECT doc_id, source, split, n_tokens, take FROM y WHERE take > 0")
def exact_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(split_quota(spark, sf_dir), "source", "split", "n_tokens", "take")


@query(f"SELECT doc_id, {S.coin(1337, 'source', 'doc_id')} < 0.1 AS validation FROM documents")
def validation_coin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", (K.coin(1337, "source", "doc_id") < 0.1).alias("validation"))


@query(
    f"""WITH {S.CLEAN}, g_ AS (SELECT *, {S.TOKENS} AS n, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS k FROM c WHERE text <> ''),
p_ AS (SELECT *, {S.coin(7, "doc_id")} < 0.05 AS v, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 0.7 * greatest(length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')), 1) AS e FROM g_ WHERE k = 1)
SELECT CASE WHEN v THEN 'val' ELSE 'train' END AS split, count(*) AS documents, CAST(sum(n) AS BIGINT) AS tokens, count(*) FILTER (e) AS en_like, round(sum(n) / greatest(count(*), 1), 6) AS average FROM p_ GROUP BY 1"""
)
def single_preparation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One corpus: clean, drop copies, count tokens, split by a coin."""
    return prepare.single(cleaned(spark, sf_dir), 0.05, 7)


@query("SELECT CAST(row_number() OVER (ORDER BY source) - 1 AS INT) AS source_ord, source, count(*) AS documents FROM documents GROUP BY source")
def union_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources one after another, each with its place."""
    d = table(spark, sf_dir, "documents").select("source")
    names = sorted(r.source for r in d.distinct().collect())  # a row for each source
    order = prepare.by_source({n: i for i, n in enumerate(names)})
    return d.groupBy("source").agg(F.count("*").alias("documents")).select(order.alias("source_ord"), "source", "documents")
