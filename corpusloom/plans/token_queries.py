"""Queries of token streams: shards, chunks, shuffles, batches, windows and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats as A
from ..operators import tokens as K
from ..operators import verify as V
from ..sources import readers as R
from . import sql as S
from .corpus_queries import _SPLIT, cleaned, split_quota
from .registry import query, table

_QUOTA = f"{S.CLEAN}, {S.UNIQUE}, {_SPLIT}, k AS (SELECT * FROM y WHERE take > 0)"
_PLACED = f"{_QUOTA}, pl AS (SELECT *, sum(take) OVER (PARTITION BY source, split ORDER BY doc_id) - take AS s FROM k)"
_SHARDS = f"{_PLACED}, pc AS (SELECT source, split, doc_id, s, take, unnest(range(CAST(s // 700 AS BIGINT), CAST((s + take - 1) // 700 AS BIGINT) + 1)) AS i FROM pl), sh AS (SELECT source, split, i AS shard_index, CAST(sum(least(s + take, (i + 1) * 700) - greatest(s, i * 700)) AS BIGINT) AS token_count FROM pc GROUP BY ALL)"


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.shards(K.shard_pieces(split_quota(spark, sf_dir), ["source", "split"], 700), ["source", "split"])


@query(f"WITH {_SHARDS} SELECT * FROM sh")
def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(spark, sf_dir)


@query(f"WITH {_SHARDS}, t AS (SELECT *, sum(token_count) OVER (PARTITION BY source ORDER BY shard_index) - token_count AS b FROM sh WHERE split = 'train') SELECT source, shard_index, CAST(least(token_count, 1500 - b) AS BIGINT) AS take FROM t WHERE b < 1500")
def prefix_of_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shards(spark, sf_dir).where("split = 'train'")
    return K.prefix_take(s, 1500, ["source"], "shard_index").select("source", "shard_index", "take")


_CHUNKS = f"{_SHARDS}, ch AS (SELECT source, split, shard_index, o AS \"offset\", least(256, token_count - o) AS token_count FROM (SELECT *, unnest(range(0, token_count, 256)) AS o FROM sh))"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.chunks(shards(spark, sf_dir), 256)


@query(f"WITH {_CHUNKS} SELECT source, split, count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens FROM ch GROUP BY ALL")
def chunk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).groupBy("source", "split").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))


_KEY = "md5('1337|' || source || '|' || shard_index || '|' || \"offset\")"


@query(f"WITH {_CHUNKS} SELECT source, shard_index, \"offset\", token_count, row_number() OVER (ORDER BY {_KEY}) AS place FROM ch WHERE split = 'train' ORDER BY place LIMIT 1024")
def shuffled_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir).where("split = 'train'")
    return K.first_shuffled(c, 1337, ["source", "shard_index", "offset"], 1024).select("source", "shard_index", "offset", "token_count", F.col("place").cast("long").alias("place"))


@query(
    f"""WITH {_CHUNKS}, o AS (SELECT source, row_number() OVER (ORDER BY {_KEY}) AS place FROM ch WHERE split = 'train' ORDER BY place LIMIT 1024), l AS (SELECT *, lag(source) OVER (ORDER BY place) AS p FROM o)
SELECT count(*) AS chunks, count(*) FILTER (p <> source) AS switches, string_agg(source, ',' ORDER BY place) FILTER (place <= 32) AS first_sources FROM l"""
)
def source_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir).where("split = 'train'")
    return K.switches(K.first_shuffled(c, 1337, ["source", "shard_index", "offset"], 1024))


@query(f"WITH {_SHARDS} SELECT epoch, source, shard_index, row_number() OVER (PARTITION BY epoch ORDER BY md5((1337 + epoch) || '|' || source || '|' || shard_index)) AS place FROM sh, range(0, 2) e(epoch) WHERE split = 'train'")
def epoch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of all train shards in two epochs."""
    s = shards(spark, sf_dir).where("split = 'train'").select("source", "shard_index", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<bigint>")).alias("epoch"))
    keyed = s.withColumn("key", F.md5(F.concat_ws("|", (F.col("epoch") + 1337).cast("string"), "source", F.col("shard_index").cast("string")).cast("binary")))
    return K.placed(keyed, ["epoch"], ["key", "source", "shard_index"]).select("epoch", "source", "shard_index", "place")


@query(f"WITH {_CHUNKS} SELECT source, shard_index, \"offset\", token_count, row_number() OVER (ORDER BY {_KEY}) AS place FROM ch WHERE split = 'train'")
def chunk_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every train chunk in the global shuffle."""
    c = chunks(spark, sf_dir).where("split = 'train'")
    keyed = c.withColumn("key", K.shuffle_key(1337, "source", "shard_index", "offset"))
    return K.placed(keyed, [], ["key", "source", "shard_index", "offset"]).select("source", "shard_index", "offset", "token_count", "place")


@query("SELECT user_id AS stream, event_id AS pos, CAST((event_id * 1103515245 + 7 + user_id) % 16384 AS INT) AS token FROM events")
def synthetic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token that stands at the place of every event, in a stream for each user, seeded by it."""
    places = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("pos"))
    return R.synthetic(places, 16384, F.col("stream") + 7)


_IDS = "t AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL)"


@query(
    f"""WITH {_IDS}, i AS (SELECT doc_id, list_transform(w, lambda x: length(x)) AS x FROM t), s AS (SELECT doc_id, x, unnest(range(0, len(x), 63)) AS s FROM i)
SELECT doc_id, s // 63 AS "window", 1 + s - greatest(s - 1, 0) AS score_start, array_to_string(list_concat([2], x[greatest(s - 1, 0) + 1 : least(len(x), s + 63)]), ',') AS tokens FROM s"""
)
def rolling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.transform(F.split("text", " ", -1), lambda x: F.length(x))
    w = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(K.rolling_windows(ids, 64, 2)).alias("window", "w"))
    return w.select("doc_id", F.col("window").cast("long").alias("window"), F.col("w.score_start").cast("long").alias("score_start"), F.array_join(F.transform("w.tokens", lambda x: x.cast("string")), ",").alias("tokens"))


@query(
    f"""WITH {_IDS}, i AS (SELECT doc_id, list_transform(w[1:len(w) - len(w) // 4], lambda x: length(x)) AS c, list_transform(w[len(w) - len(w) // 4 + 1:], lambda x: length(x)) AS m FROM t),
k AS (SELECT doc_id, CASE WHEN len(m) > 63 THEN m[len(m) - 62:] ELSE m END AS m, CASE WHEN len(m) > 63 THEN [] ELSE c[greatest(len(c) - (64 - len(m) - 1) + 1, 1):] END AS c FROM i)
SELECT doc_id, CASE WHEN len(m) = 0 THEN '2' ELSE array_to_string(list_concat([2], c, m), ',') END AS tokens, CASE WHEN len(m) = 0 THEN 1 ELSE 1 + len(c) END AS score_start FROM k"""
)
def continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.transform(F.split("text", " ", -1), lambda x: F.length(x)).alias("x"))
    n = F.floor(F.size("x") / 4).cast("int")
    d = d.select("doc_id", F.slice("x", 1, F.size("x") - n).alias("c"), F.slice("x", F.size("x") - n + 1, n).alias("m"))
    d = d.select("doc_id", K.continuation(F.col("c"), F.col("m"), 64, 2).alias("s"))
    return d.select("doc_id", F.array_join(F.transform("s.tokens", lambda x: x.cast("string")), ",").alias("tokens"), F.col("s.score_start").cast("long").alias("score_start"))


_WORDS = f"{S.CLEAN}, tw AS (SELECT source, unnest(string_split(text, ' ')) AS token FROM c WHERE text <> '')"


def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir).where("text <> ''").select("source", F.explode(F.split("text", " ")).alias("token"))


@query(f"WITH {_WORDS} SELECT token, count(*) AS n FROM tw GROUP BY token ORDER BY n DESC, token LIMIT 100")
def top_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_source = word_tokens(spark, sf_dir).groupBy("source", "token").agg(F.count("*").alias("n"))
    return A.top(A.added(by_source))


@query(
    f"""WITH {_WORDS}, v AS (SELECT token FROM tw GROUP BY token ORDER BY count(*) DESC, token LIMIT 1000), r AS (SELECT source, count(*) AS tokens, count(*) FILTER (v.token IS NULL) AS unknown FROM tw LEFT JOIN v USING (token) GROUP BY source)
SELECT source, tokens, unknown, round(unknown / greatest(tokens, 1), 9) AS unknown_rate FROM r"""
)
def unknown_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = word_tokens(spark, sf_dir)
    known = A.top(A.frequency(w), 1000).select("token", F.lit(True).alias("known"))
    r = w.join(F.broadcast(known), "token", "left").groupBy("source").agg(F.count("*").alias("tokens"), F.count_if(F.col("known").isNull()).alias("unknown"))
    return r.withColumn("unknown_rate", F.round(A.rate(F.col("unknown"), F.col("tokens")), 9))


@query(f"WITH {S.CLEAN} SELECT source, count(*) AS documents, CAST(sum({S.TOKENS}) AS BIGINT) AS tokens, round(sum({S.TOKENS}) / greatest(count(*), 1), 6) AS average FROM c GROUP BY source")
def average_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = K.word_count(F.col("text"))
    return cleaned(spark, sf_dir).groupBy("source").agg(F.count("*").alias("documents"), F.sum(n).alias("tokens"), F.round(A.rate(F.sum(n), F.count("*")), 6).alias("average"))


@query(
    f"""WITH {S.CLEAN}, k AS (SELECT text FROM c WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 20)
SELECT count(*) AS documents, CAST(sum((length(text) - 1) // 1000 + 1) AS BIGINT) AS lines, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum({S.TOKENS}) AS BIGINT) AS tokens, round(sum(length(text)) / greatest(sum({S.TOKENS}), 1), 6) AS chars_per_token, bool_and(strlen(text) > 0) AS passed FROM k"""
)
def audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cleaned(spark, sf_dir).where("text <> ''")
    from pyspark.sql import Window

    d = d.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("row_id"))).where("n <= 20")
    n, chars = K.word_count(F.col("text")), F.length("text")
    return d.agg(
        F.count("*").alias("documents"),
        F.sum(F.floor((chars - 1) / 1000) + 1).alias("lines"),
        F.sum(chars.cast("long")).alias("chars"),
        F.sum(n).alias("tokens"),
        F.round(A.rate(F.sum(chars), F.sum(n)), 6).alias("chars_per_token"),
        F.every(F.octet_length("text") > 0).alias("passed"),
    )


@query(f"WITH {_WORDS}, f AS (SELECT token, count(*) AS n FROM tw GROUP BY token), v AS (SELECT DISTINCT token FROM tw) SELECT token, coalesce(n, 0) AS n FROM v LEFT JOIN f USING (token)")
def vocabulary_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of all documents with its frequencies over all sources."""
    w = word_tokens(spark, sf_dir)
    return A.counted(w, A.frequency(w))


@query(
    """WITH t AS (SELECT unnest(string_split(text, ' ')) AS token FROM documents WHERE text IS NOT NULL), v AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS token FROM benchmark),
f AS (SELECT token, count(*) AS n FROM t GROUP BY token) SELECT token, coalesce(n, 0) AS n FROM v LEFT JOIN f USING (token)"""
)
def benchmark_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the documents have each word of the benchmarks; many are never seen."""
    words = lambda name: table(spark, sf_dir, name).where("text IS NOT NULL").select(F.explode(F.split("text", " ", -1)).alias("token"))
    return A.counted(words("benchmark"), A.frequency(words("documents")))


@query(f"WITH {_SHARDS} SELECT split, CAST(sum(token_count) AS BIGINT) AS tokens, count(*) AS shards, CAST(sum(token_count) AS BIGINT) <= 66000 AS within FROM sh GROUP BY split")
def assembly_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(spark, sf_dir).groupBy("split").agg(F.sum("token_count").alias("tokens"), F.count("*").alias("shards")).withColumn("within", F.col("tokens") <= 66000)


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.doc_id IS NULL THEN 'extra' ELSE 'both' END AS status FROM (SELECT DISTINCT doc_id FROM documents) a FULL JOIN (SELECT DISTINCT doc_id FROM labels) b ON a.doc_id = b.doc_id")
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with all labels."""
    return V.reconcile(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def listed_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.repeated(table(spark, sf_dir, "documents"), ["text"])


@query("SELECT o_custkey, count(*) AS orders FROM orders ANTI JOIN (SELECT c_custkey FROM customer) ON o_custkey = c_custkey GROUP BY 1")
def unmatched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose customer doesn't exist; none on clean tables."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return V.unmatched(table(spark, sf_dir, "orders"), c, ["o_custkey"]).groupBy("o_custkey").agg(F.count("*").alias("orders"))


@query("SELECT source, count(*) AS documents FROM documents ANTI JOIN labels USING (doc_id) GROUP BY source")
def unlabelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label, by source; about half of them have one."""
    return V.unmatched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).groupBy("source").agg(F.count("*").alias("documents"))


_CORPUS = "st AS (SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS pos, token FROM (SELECT doc_id, unnest(x) AS token, unnest(range(0, len(x))) AS i FROM (SELECT doc_id, list_append(list_transform(string_split(text, ' '), lambda x: 4 + length(x)), 3) AS x FROM documents WHERE text IS NOT NULL)))"


def corpus_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents: 4 and the length of each word, then 3 as the end mark."""
    ids = F.concat(F.transform(F.split("text", " ", -1), lambda x: F.length(x) + 4), F.array(F.lit(3)))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("row_id"), ids.alias("ids"))


@query(f"WITH {_CORPUS} SELECT pos // 1000 AS shard, min(token) AS least, max(token) AS most, count(*) FILTER (token = 3) AS ends, count(*) AS tokens FROM st GROUP BY 1")
def shard_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.scanned(corpus_ids(spark, sf_dir), 1000, 3)


@query(
    f"""WITH {_CORPUS}, n AS (SELECT *, coalesce(lead(token) OVER (ORDER BY pos), (SELECT token FROM st WHERE pos = 0)) AS target FROM st)
SELECT pos // 128 AS batch, pos % 128 // 32 AS row, string_agg(token, ',' ORDER BY pos) AS inputs, string_agg(target, ',' ORDER BY pos) AS targets FROM n GROUP BY ALL HAVING count(*) = 32"""
)
def packed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = K.packed(corpus_ids(spark, sf_dir), 4, 32)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return b.select("batch", "row", text("inputs"), text("targets"))
