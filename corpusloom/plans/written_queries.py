"""Queries that write shards and manifests, read them back and tell what they hold.

Ids are those of `Encoder.of_words`, so that SQL can follow: 4 and the length of
each word, then 3.  `total` weighs each id with its place in its shard.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..operators import corpus as C
from ..operators import stats as A
from ..sources import shard_files as B
from ..sources.training import TokenReader
from ..spec import Source
from . import corpus_queries as Q
from . import prepare as P
from . import sql as S
from . import written as W
from .registry import query, table

SHARD, CHUNK = 700, 256


def _words(most: int = 1_000) -> W.Encoder:
    return W.Encoder.of_words(most)


def english_mix(spark: SparkSession, sf_dir: str, folder: str) -> dict[str, Any]:
    """The flagship preparation, written: English texts of 200 characters or more of every source, up to 5,000 tokens each."""
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "row_id").withColumnRenamed("lang", "language")
    names = sorted(r.source for r in docs.select("source").distinct().collect())  # a row for each source
    specs = [Source(name=n, dataset="documents", token_budget=5000, filters={"language": "en"}, min_text_chars=200) for n in names]
    return W.write_mix(P.Shared(docs), specs, Q.index(spark, sf_dir), _words(), folder, shard_tokens=SHARD, strict=False)


def held(spark: SparkSession, folder: str, splits: tuple[str, ...] = ("train",)) -> DataFrame:
    """Rows (split, path, tokens, least, most, ends, total) of the shards that a manifest lists."""
    entries = W.entries_of(spark, f"{folder}/manifest.json").where(F.col("split").isin(*splits))
    read = storage.materialize(B.read(spark, folder, entries, 500), "slices")
    weighed = F.aggregate(F.transform("ids", lambda x, i: x.cast("long") * (i + 1 + F.col("at"))), F.lit(0).cast("long"), lambda a, x: a + x)
    told = A.shard_statistics(read, 3).join(read.groupBy("path").agg(F.sum(weighed).alias("total")), "path")
    return told.select("split", "path", "tokens", F.col("least").cast("long").alias("least"), F.col("most").cast("long").alias("most"), "ends", "total")


def _ids(text: str, most: int = 1_000) -> str:
    return f"list_append(list_transform(string_split({text}, ' '), lambda x: least(length(x) + 4, {most - 1})), 3)"


_HELD = "split, path, count(*) AS tokens, CAST(min(id) AS BIGINT) AS least, CAST(max(id) AS BIGINT) AS most, count(*) FILTER (id = 3) AS ends, CAST(sum(CAST(id AS BIGINT) * (spot + 1)) AS BIGINT) AS total"
#: tk: every token of the mix with its place in its source; st: with its shard.
_MIXED = f"""{Q._DISPOSED}, {Q._TRAIN},
ids_ AS (SELECT doc_id, source, CASE WHEN take < n_tokens THEN list_append(({_ids("text")})[1:take - 1], 3) ELSE {_ids("text")} END AS x FROM y JOIN z USING (doc_id, source)),
tk AS (SELECT source, x[i] AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) - 1 AS pos FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM ids_)),
st AS (SELECT 'train' AS split, source, 'sources/' || source || '/train/shard_' || lpad(CAST(pos // {SHARD} AS VARCHAR), 6, '0') || '.bin' AS path, pos, pos % {SHARD} AS spot, id FROM tk)"""


@query(f"WITH {_MIXED} SELECT {_HELD} FROM st GROUP BY split, path")
def written_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix as it stands on disk: its shards, found through the manifest."""
    folder = storage.work_dir(spark, "mix")
    english_mix(spark, sf_dir, folder)
    return held(spark, folder)


@query(
    f"""WITH {_MIXED}, c0 AS (SELECT source, count(*) AS raw, {", ".join(f"count(*) FILTER (disposition = '{k}') AS {k}" for k in C.KINDS)} FROM z GROUP BY source),
hb AS (SELECT source, benchmark, count(*) AS n FROM h JOIN (SELECT doc_id FROM g) USING (doc_id) JOIN f_ USING (doc_id) GROUP BY ALL),
hs AS (SELECT source, string_agg(benchmark || ':' || n, ',' ORDER BY benchmark) AS benchmark_hits FROM hb GROUP BY source),
tt AS (SELECT source, count(*) AS train_tokens FROM tk GROUP BY source)
SELECT source, raw, {", ".join(C.KINDS)}, coalesce(train_tokens, 0) AS train_tokens, 0 AS val_tokens, 0 AS unk_tokens, coalesce(benchmark_hits, '') AS benchmark_hits FROM c0 LEFT JOIN tt USING (source) LEFT JOIN hs USING (source)"""
)
def written_mix_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of each source, as the manifest has them."""
    folder = storage.work_dir(spark, "mix")
    told = english_mix(spark, sf_dir, folder)["statistics"]["source_statistics"]
    names = ["raw", *C.KINDS, "train_tokens", "val_tokens", "unk_tokens"]
    rows = [(s, *(int(t[k]) for k in names), ",".join(f"{b}:{n}" for b, n in sorted(t["benchmark_hits"].items()))) for s, t in told.items()]
    return spark.createDataFrame(rows, "source string, " + ", ".join(f"{n} long" for n in names) + ", benchmark_hits string")


@query(f"WITH {_MIXED} SELECT id AS token_id, count(*) AS n FROM tk GROUP BY id ORDER BY n DESC, token_id LIMIT 100")
def written_mix_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent ids, as the manifest has them."""
    folder = storage.work_dir(spark, "mix")
    top = english_mix(spark, sf_dir, folder)["statistics"]["token_frequency_top_100"]
    return spark.createDataFrame([(t["token_id"], t["count"]) for t in top], "token_id int, n long")


@query(
    f"""WITH {_MIXED}, ck AS (SELECT source, path, spot // {CHUNK} * {CHUNK} AS o, count(*) AS n FROM st GROUP BY ALL),
ko AS (SELECT *, sum(n) OVER (ORDER BY CAST('0x' || substr(md5('1337|' || source || '|' || path || '|' || o), 1, 15) AS BIGINT), path, o) - n AS s FROM ck),
gp AS (SELECT 'train' AS split, id, CAST(s + spot - o AS BIGINT) AS p FROM st JOIN ko ON st.path = ko.path AND spot // {CHUNK} * {CHUNK} = o),
gs AS (SELECT split, id, 'train/shard_' || lpad(CAST(p // {SHARD} AS VARCHAR), 6, '0') || '.bin' AS path, p % {SHARD} AS spot FROM gp)
SELECT {_HELD} FROM gs GROUP BY split, path"""
)
def written_global_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards of the mix, cut to chunks, globally shuffled, written and verified."""
    before, after = storage.work_dir(spark, "mix"), storage.work_dir(spark, "global-mix")
    english_mix(spark, sf_dir, before)
    W.mix_chunks(spark, f"{before}/manifest.json", after, CHUNK, SHARD)
    return held(spark, after)


@query(
    f"""WITH {_MIXED}, tn AS (SELECT source, count(*) AS n FROM tk GROUP BY source), one AS (SELECT source, n * 3 // 5 AS cap FROM tn ORDER BY source LIMIT 1),
al AS (SELECT *, row_number() OVER (ORDER BY source, pos) - 1 AS p FROM st), lim AS (SELECT count(*) // 2 AS half FROM st),
ord AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS i FROM (SELECT DISTINCT path FROM al, lim WHERE p < half)),
parts AS (SELECT split, 'sources/some/train/shard_' || lpad(CAST(pos // {SHARD} AS VARCHAR), 6, '0') || '.bin' AS path, spot, id FROM st JOIN one USING (source) WHERE pos < cap
  UNION ALL SELECT split, 'sources/all/train/shard_' || lpad(CAST(i AS VARCHAR), 6, '0') || '.bin', spot, id FROM al JOIN ord USING (path), lim WHERE p < half)
SELECT {_HELD} FROM parts GROUP BY split, path"""
)
def written_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the mix: three fifths of the first source, and half of all train tokens, assembled to an exact total."""
    before, after = storage.work_dir(spark, "mix"), storage.work_dir(spark, "assembly")
    m = english_mix(spark, sf_dir, before)
    first = next(s for s in m["sources"] if s["actual_train_tokens"])
    some, half = first["actual_train_tokens"] * 3 // 5, m["train_token_count"] // 2
    path = f"{before}/manifest.json"
    sources = [
        {"name": "some", "kind": "existing_source", "manifest": path, "source_name": first["name"], "token_budget": some},
        {"name": "all", "kind": "tokenized_manifest", "manifest": path, "target_train_tokens": half},
    ]
    W.assemble(spark, {"sources": sources, "target_train_tokens": some + half, "shard_tokens": SHARD}, _words(), after)
    return held(spark, after)


@query(
    f"""WITH {S.CLEAN}, u_ AS (SELECT *, {_ids("text")} AS x FROM c WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1),
sp AS (SELECT *, CASE WHEN {S.coin(7, "doc_id")} < 0.05 THEN 'val' ELSE 'train' END AS split FROM u_),
tk AS (SELECT split, x[i] AS id, row_number() OVER (PARTITION BY split ORDER BY doc_id, i) - 1 AS pos FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM sp)),
st AS (SELECT split, split || '/shard_' || lpad(CAST(pos // 20000 AS VARCHAR), 6, '0') || '.bin' AS path, pos % 20000 AS spot, id FROM tk)
SELECT {_HELD} FROM st GROUP BY split, path"""
)
def written_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one corpus, split by a coin: its shards on disk."""
    folder = storage.work_dir(spark, "corpus")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")
    W.write_corpus(docs, _words(), folder, 0.05, 7, 20_000)
    return held(spark, folder, ("train", "val"))


BATCH_ROWS, BATCH_COLUMNS = 4, 64


@query(
    f"""WITH {_MIXED}, sz AS (SELECT path, count(*) AS n FROM st GROUP BY path), tot AS (SELECT sum(n) AS t FROM sz),
ep AS (SELECT e, path, sum(n) OVER (PARTITION BY e ORDER BY CAST('0x' || substr(md5((1337 + e) || '|' || path), 1, 15) AS BIGINT), path) - n AS s FROM sz, range(0, 3) x(e)),
sp AS (SELECT CAST(e * t + s + spot AS BIGINT) AS p, id FROM st JOIN ep USING (path), tot),
nx AS (SELECT p, id, lead(id) OVER (ORDER BY p) AS target FROM sp)
SELECT p // {BATCH_ROWS * BATCH_COLUMNS} AS batch, p % {BATCH_ROWS * BATCH_COLUMNS} // {BATCH_COLUMNS} AS row, string_agg(id, ',' ORDER BY p) AS inputs, string_agg(target, ',' ORDER BY p) AS targets
FROM nx, tot WHERE p < 2 * t // {BATCH_ROWS * BATCH_COLUMNS} * {BATCH_ROWS * BATCH_COLUMNS} GROUP BY ALL"""
)
def epoch_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training batches over two epochs of the mix's shards, each in its own order; a third of the way another reader goes on at the first one's state."""
    folder = storage.work_dir(spark, "mix")
    english_mix(spark, sf_dir, folder)
    reader = TokenReader(spark, f"{folder}/manifest.json")
    n = 2 * reader.total // (BATCH_ROWS * BATCH_COLUMNS)
    some = reader.batches(n // 3, BATCH_ROWS, BATCH_COLUMNS)
    rest = TokenReader(spark, f"{folder}/manifest.json").resume(reader.state()).batches(n - n // 3, BATCH_ROWS, BATCH_COLUMNS)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return some.unionByName(rest.withColumn("batch", F.col("batch") + n // 3)).select("batch", "row", text("inputs"), text("targets"))
