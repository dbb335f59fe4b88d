"""Queries of run metrics, trials, evaluation scores and event streams.

`events` stands for the records of a run: its ids are steps, its values losses or speeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..operators import evaluate as E
from ..operators import metrics as M
from ..operators import stats as A
from ..streaming import streams as T
from . import sql as S
from .corpus_queries import split_sql
from .registry import query, table

_RUNS = "r AS (SELECT user_id % 7 AS run, event_id AS step, value, event_id * 512 AS tokens_seen, CAST(event_id % 5000 AS DOUBLE) AS elapsed FROM events)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("run"), F.col("event_id").alias("step"), "value", (F.col("event_id") * 512).alias("tokens_seen"), (F.col("event_id") % 5000).cast("double").alias("elapsed"))


#: A value counts 0.05 times 0.95 for each later one, the first one 1 times that; beyond 900 values that is below 1e-20.
@query(
    f"""WITH {_RUNS}, n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS k FROM r)
SELECT a.run, a.step, round(sum(b.value * CASE WHEN b.k = 1 THEN 1.0 ELSE 0.05 END * pow(0.95, a.k - b.k)) + 1e-9, 6) AS smoothed FROM n a JOIN n b ON a.run = b.run AND b.k <= a.k AND b.k > a.k - 900 GROUP BY a.run, a.step"""
)
def smoothed_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run over all of its records."""
    return M.smooth(runs(spark, sf_dir), "run", "step", "value").select("run", "step", F.round(F.col("smoothed") + 1e-9, 6).alias("smoothed"))


@query(
    f"""WITH {_RUNS}, l AS (SELECT run, arg_max(elapsed, step) AS latest FROM r GROUP BY run)
SELECT run, round(avg(value) FILTER (latest - elapsed <= 60), 6) AS avg_60s, round(avg(value) FILTER (latest - elapsed <= 300), 6) AS avg_300s, round(avg(value) FILTER (latest - elapsed <= 1800), 6) AS avg_1800s FROM r JOIN l USING (run) WHERE value <> 0 GROUP BY run"""
)
def trailing_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = M.trailing(runs(spark, sf_dir), "run", "elapsed", "value", "step")
    return t.select("run", *(F.round(f"avg_{s}s", 6).alias(f"avg_{s}s") for s in M.TRAILING))


@query(
    f"""WITH {_RUNS}, f AS (SELECT *, coalesce(value <= lag(value) OVER w * 1.01, false) AS flat FROM r WINDOW w AS (PARTITION BY run ORDER BY step)),
g AS (SELECT *, flat AND coalesce(lag(flat) OVER w, false) AS stop FROM f WINDOW w AS (PARTITION BY run ORDER BY step)),
h AS (SELECT *, coalesce(sum(CAST(stop AS INT)) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM g)
SELECT run, step, value FROM h WHERE over = 0"""
)
def stagnating_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.stagnation(runs(spark, sf_dir), ["run"], "step", "value").select("run", "step", "value")


@query(f"WITH {_RUNS}, m AS (SELECT run, step, tokens_seen // 100000 AS milestone, coalesce(lag(tokens_seen // 100000) OVER (PARTITION BY run ORDER BY step), 0) AS was FROM r) SELECT run, step, milestone FROM m WHERE milestone > was")
def checkpoint_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.milestones(runs(spark, sf_dir), "run", "step", "tokens_seen", 100_000).select("run", "step", "milestone")


@query(
    f"""WITH {_RUNS} SELECT step, round(CASE WHEN tokens_seen < 200000 THEN 0.003 * tokens_seen / 200000 ELSE 0.0003 + 0.0027 * 0.5 * (1 + cos(pi() * least(1.0, greatest(0.0, (tokens_seen - 200000) / 1800000)))) END, 9) AS rate FROM r"""
)
def learning_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of every record."""
    rate = M.learning_rate(F.col("tokens_seen"), 0.003, 0.0003, 200_000, 2_000_000)
    return runs(spark, sf_dir).select("step", F.round(rate, 9).alias("rate"))


@query(f"WITH {_RUNS} SELECT step, CASE WHEN value > 0 THEN round(greatest(4000000 - tokens_seen, 0) / value, 6) END AS eta, round(100.0 * tokens_seen / 4000000, 6) AS progress FROM r")
def eta_and_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, seen = F.lit(4_000_000), F.col("tokens_seen")
    return runs(spark, sf_dir).select("step", F.round(M.eta(target, seen, F.col("value")), 6).alias("eta"), F.round(M.progress(seen, target), 6).alias("progress"))


@query(
    f"""WITH {_RUNS} SELECT 'train_loss' AS trace, CAST(tokens_seen AS DOUBLE) AS x, value AS y FROM r UNION ALL SELECT 'validation_loss', CAST(tokens_seen AS DOUBLE), value * 2 FROM r WHERE step % 50 = 0"""
)
def loss_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir).select("tokens_seen", F.col("value").alias("train_loss"), F.lit(None).cast("double").alias("smoothed_loss"), F.when(F.col("step") % 50 == 0, F.col("value") * 2).alias("validation_loss"))
    return M.series(r, "tokens")


@query(f"WITH {_RUNS} SELECT run, step, value FROM r QUALIFY row_number() OVER (PARTITION BY run ORDER BY step DESC) <= 20")
def last_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.last(runs(spark, sf_dir), ["run"], "step", 20).select("run", "step", "value")


@query(f"WITH {_RUNS} SELECT run, step, value FROM r QUALIFY row_number() OVER (PARTITION BY run ORDER BY value DESC, step) = 1")
def best_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.best(runs(spark, sf_dir), ["run"], "value", ["step"]).select("run", "step", "value")


@query("SELECT event_type, count(*) AS calls, round(sum(value), 4) AS total FROM events WHERE event_type LIKE 'c%' OR event_type LIKE 'p%' GROUP BY event_type ORDER BY total DESC, event_type LIMIT 50")
def named_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the events whose names have one of two beginnings, the largest first."""
    r = A.named_ranges(table(spark, sf_dir, "events"), "event_type", ["value"], ("c", "p"), 50)
    return r.select("event_type", "calls", F.round("value", 4).alias("total"))


@query(f"WITH {_RUNS}, l AS (SELECT run, max(step) AS step, max(tokens_seen) AS tokens, count(*) AS records FROM r GROUP BY run) SELECT run * CAST(0.0001 AS DOUBLE) AS learning_rate, tokens, records, value AS final_loss, value = min(value) OVER () AS best FROM l JOIN r USING (run, step)")
def sweep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sweep of learning rates: the last record of each run, and which run ends with the least loss."""
    r = runs(spark, sf_dir).withColumn("learning_rate", F.col("run") * 0.0001)
    return M.sweep(r, "learning_rate", "step", "value", "tokens_seen").select("learning_rate", "tokens", "records", "final_loss", "best")


@query(
    f"""WITH {_RUNS}, l AS (SELECT run, max(step) AS step, arg_max(value, step) AS loss, arg_max(tokens_seen, step) AS seen, arg_max(elapsed, step) AS latest FROM r GROUP BY run)
SELECT l.run, l.step, loss, seen, round(100.0 * seen / 4000000, 6) AS progress, round(avg(value) FILTER (latest - elapsed <= 60 AND value <> 0), 6) AS avg_60s, round(avg(value) FILTER (latest - elapsed <= 300 AND value <> 0), 6) AS avg_300s,
  round(avg(value) FILTER (latest - elapsed <= 1800 AND value <> 0), 6) AS avg_1800s FROM l JOIN r ON r.run = l.run GROUP BY ALL"""
)
def run_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a monitor shows of each run: its last record, progress and trailing speeds."""
    r = runs(spark, sf_dir).select("run", "step", F.col("value").alias("train_loss"), F.col("value").alias("tokens_per_sec"), "tokens_seen", F.lit(4_000_000).alias("tokens_target"), F.col("elapsed").alias("elapsed_time"))
    m = M.overview(r, "run")
    return m.select("run", "step", F.col("train_loss").alias("loss"), F.col("tokens_seen").alias("seen"), F.round("progress", 6).alias("progress"), *(F.round(f"avg_{x}s", 6).alias(f"avg_{x}s") for x in M.TRAILING))


@query("SELECT event_type, round(avg(value), 6) AS mean, max(value) AS most, round(sum(value), 4) AS total FROM events GROUP BY event_type ORDER BY total DESC, event_type LIMIT 50")
def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"), F.round(F.sum("value"), 4).alias("total"))
    return e.orderBy(F.desc("total"), "event_type").limit(50)


_SCORES = f"sc AS (SELECT doc_id, source, -1.5 * (doc_id % 17) AS ll, len(string_split_regex(text, '{S.SPACE}+')) AS words, strlen(text) AS bytes FROM documents WHERE text IS NOT NULL)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import spaced_parts

    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", "source", (F.col("doc_id") % 17 * -1.5).cast("double").alias("ll"), spaced_parts(F.col("text")).alias("words"), F.octet_length("text").alias("bytes"))


@query(f"WITH {_SCORES} SELECT round(exp(-sum(ll) / sum(words)), 9) AS word_perplexity, round(exp(-sum(ll) / sum(bytes)), 9) AS byte_perplexity, round(-sum(ll) / (sum(bytes) * ln(2)), 9) AS bits_per_byte FROM sc")
def weighted_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ll, words, size = F.col("ll"), F.col("words"), F.col("bytes")
    return scores(spark, sf_dir).agg(F.round(A.perplexity(ll, words), 9).alias("word_perplexity"), F.round(A.perplexity(ll, size), 9).alias("byte_perplexity"), F.round(A.bits(ll, size), 9).alias("bits_per_byte"))


@query(
    f"""WITH t AS (SELECT source, text, list_transform(string_split(text, ' '), lambda w: length(w)) AS x FROM documents WHERE text IS NOT NULL),
k AS (SELECT source, len(x) AS tokens, len(string_split_regex(text, '{S.SPACE}+')) AS words, strlen(text) AS bytes,
  list_sum(list_transform(x, lambda v, i: -ln(1 + abs(v - CASE WHEN i = 1 THEN 2 ELSE x[i - 1] END)))) AS ll FROM t)
SELECT source, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(words) AS BIGINT) AS words, CAST(sum(bytes) AS BIGINT) AS bytes,
  round(exp(-sum(ll) / sum(words)), 6) AS word_perplexity, round(exp(-sum(ll) / sum(bytes)), 6) AS byte_perplexity, round(-sum(ll) / (sum(bytes) * ln(2)), 6) AS bits_per_byte FROM k GROUP BY source"""
)
def rolling_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexities of all texts, from windows of 64 ids on, under a stand-in for a model that asks for the id before each one."""

    def score(tokens: Column, first: Column) -> Column:
        steps = F.transform(F.sequence(first, F.size(tokens) - 1), lambda i: -F.log(1.0 + F.abs(F.get(tokens, i) - F.get(tokens, i - 1))))
        return F.aggregate(F.when(F.size(tokens) > first, steps), F.lit(0.0), lambda a, x: a + x)

    ids = F.transform(F.split("text", " ", -1), lambda x: F.length(x))
    got = E.rolling_perplexity(table(spark, sf_dir, "documents"), ids, score, 64, 2, ["source"])
    return got.select("source", "tokens", "words", "bytes", *(F.round(c, 6).alias(c) for c in ("word_perplexity", "byte_perplexity", "bits_per_byte")))


@query(f"WITH {_SCORES}, m AS (SELECT source, avg(-ll) AS loss FROM sc GROUP BY source) SELECT source, round(loss, 6) AS loss, round(exp(least(20, loss)), 3) AS perplexity FROM m")
def evaluation_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = scores(spark, sf_dir).groupBy("source").agg(F.avg(-F.col("ll")).alias("loss"))
    return m.select("source", F.round("loss", 6).alias("loss"), F.round(A.capped_perplexity(F.col("loss")), 3).alias("perplexity"))


@query("SELECT doc_id, CAST(sum(i + length(text)) AS BIGINT) AS score FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 100 + 1)) AS i FROM documents WHERE length(text) > 0) GROUP BY doc_id")
def window_score_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    spans = table(spark, sf_dir, "documents").where(n > 0).select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / 100).cast("int"))).alias("i"))
    return spans.groupBy("doc_id").agg(F.sum(F.col("i") + F.col("n")).alias("score"))


@query(
    """SELECT configuration, depth, d_model, 16384 * d_model AS embedding, depth * (2 * d_model * d_model + 2 * d_model * d_model // 4 + 2 * d_model * 3 * d_model + 2 * d_model + 2) AS blocks
FROM (SELECT o_orderkey AS configuration, 4 + o_orderkey % 4 AS depth, 64 * (4 + o_custkey % 5) AS d_model FROM orders)"""
)
def parameter_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of every configuration of a sweep over shapes: embeddings, and projections, gates and norms of the blocks."""
    shapes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("configuration"), (F.col("o_orderkey") % 4 + 4).alias("depth"), ((F.col("o_custkey") % 5 + 4) * 64).alias("d_model"))
    d = F.col("d_model")
    block = 2 * d * d + F.floor(2 * d * d / 4) + 2 * d * 3 * d + 2 * d + 2
    return shapes.select("configuration", "depth", "d_model", (16384 * d).alias("embedding"), (F.col("depth") * block).cast("long").alias("blocks"))


@query("WITH r AS (SELECT user_id, max(event_id) AS last_event, count(*) AS n FROM events GROUP BY user_id) SELECT user_id, n, event_type AS last_type FROM r JOIN events USING (user_id) WHERE event_id = last_event")
def run_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run with its size and its last record."""
    e = table(spark, sf_dir, "events")
    sizes = e.groupBy("user_id").agg(F.count("*").alias("n"))
    return sizes.join(A.last(e, ["user_id"], "event_id"), "user_id", "left").select("user_id", "n", F.col("event_type").alias("last_type"))


@query(
    f"""WITH {_RUNS} SELECT run, step, {", ".join(f"round(avg(nullif(value, 0)) OVER (PARTITION BY run ORDER BY elapsed RANGE BETWEEN {s} PRECEDING AND CURRENT ROW) + 1e-9, 6) AS avg_{s}s" for s in M.TRAILING)} FROM r"""
)
def trailing_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing averages at every record of every run, moved by 1e-9 before rounding, as exact ties depend on the order of a sum."""
    runs = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("run"), F.col("event_id").alias("step"), "value", (F.col("event_id") % 5000).cast("double").alias("elapsed"))
    return M.trailing_each(runs, "run", "elapsed", "value").select("run", "step", *(F.round(F.col(f"avg_{s}s") + 1e-9, 6).alias(f"avg_{s}s") for s in M.TRAILING))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.windowed(table(spark, sf_dir, "events"))


@query(
    """WITH l AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 30 MINUTE, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.sessions(table(spark, sf_dir, "events"))


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table as a stream of files, be it one file or a folder of them; a pattern, as a stream takes a plain path for a folder."""
    whole = table(spark, sf_dir, name)
    return spark.readStream.schema(whole.schema).parquet(f"{sf_dir}/{{{name}.parquet}}")


def _once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    return T.run_once(stream, storage.work_dir(stream.sparkSession, f"stream-{name}"), mode)


@query(f"WITH {S.CLEAN} SELECT DISTINCT source, sha256(text) AS digest FROM c WHERE text <> ''")
def streamed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir, "documents").where("text IS NOT NULL")
    return _once(T.first_copies(rows, ["source"]), "dedup").where(F.col("digest") != F.sha2(F.lit("").cast("binary"), 256)).select("source", "digest")


@query(f"SELECT event_type, sha256({S.clean('props')}) AS digest FROM events WHERE props IS NOT NULL GROUP BY ALL")
def streamed_recent_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text of an event type once; state is dropped 60 days after a text was first seen, longer than the table spans."""
    rows = _stream(spark, sf_dir, "events").where("props IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
    kept = _once(T.first_copies(rows, ["event_type"], "props", time_col="ts", late="60 days"), "recent")
    return kept.select("event_type", "digest")


@query(f"""WITH {split_sql(f"SELECT doc_id, source, n_chars AS n, {S.coin(1337, 'source', 'doc_id')} < 0.2 AS c FROM documents", 20_000, 4_000)} SELECT source, doc_id AS row_id, n_tokens, split, take FROM y WHERE take > 0""")
def streamed_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train and validation budgets for every source, filled in the order of a stream that comes in three parts, each read by a query of its own."""
    rows = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("row_id"), F.col("n_chars").alias("n_tokens"))
    sources = [r.source for r in rows.select("source").distinct().collect()]  # a row for each source
    third = (rows.agg(F.max("row_id")).first()[0] or 0) // 3 + 1
    files, out = storage.work_dir(spark, "arriving"), storage.work_dir(spark, "budgets")
    for k in range(3):
        rows.where((F.col("row_id") >= k * third) & (F.col("row_id") < (k + 1) * third)).write.mode("append").parquet(files)
        T.fill_budgets(spark.readStream.schema(rows.schema).parquet(files), dict.fromkeys(sources, 20_000), out, dict.fromkeys(sources, 4_000), 0.2)
    return T.taken_rows(spark, out).drop("batch")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(T.windowed(_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))), "windows", "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))
