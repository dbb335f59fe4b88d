"""Structured Streaming: metrics tails, duplicates, quotas and event windows."""

from __future__ import annotations

from collections.abc import Mapping

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean
from ..operators import tokens as K
from ..sources.growing import growing_lines
from ..sources.shard_files import filesystem


def metrics_tail(spark: SparkSession, folder: str, schema: str, pattern: str = "*.jsonl") -> DataFrame:
    """Records of the growing files of a folder, each once; broken lines are skipped, and a file that began anew is read from its start."""
    rows = growing_lines(spark, folder, pattern).select(F.from_json("value", schema).alias("r"))
    return rows.where("r IS NOT NULL AND NOT (to_json(r) = '{}')").select("r.*")


def first_copies(stream: DataFrame, scope: list[str], text_col: str = "text", normalize: bool = True, time_col: str | None = None, late: str = "1 day") -> DataFrame:
    """Each cleaned text of a scope once, whichever copy comes first.

    With a time column, copies that come within `late` of the first are left out and
    older state is dropped; without one every digest is kept, 32 bytes a text.
    """
    rows = stream if time_col is None else stream.withWatermark(time_col, late)
    rows = rows.withColumn("digest", F.sha2(clean(F.col(text_col), normalize).cast("binary"), 256))
    return rows.dropDuplicates([*scope, "digest"]) if time_col is None else rows.dropDuplicatesWithinWatermark([*scope, "digest"])


def fill_budgets(stream: DataFrame, budgets: Mapping[str, int], folder: str, val_budgets: Mapping[str, int] | None = None, val_ratio: float = 0.0, seed: int = 1337, keep_running: bool = False) -> None:
    """Take documents (source, row_id, n_tokens) of a stream up to each source's budgets, in the order of arrival and then row_id, as `tokens.quota` does for a table.

    What each batch takes goes to rows/batch=<number> in the folder, and what is used up
    after it to used/batch=<number>, a row for each source.  A batch goes on from what
    the one before has used, and one that is run again replaces itself, so the query
    may break off anywhere.  Running sums have two levels, so no worker holds a source.
    Sources without a budget, and those that are full, give nothing.
    """
    given = {s: (int(n), int((val_budgets or {}).get(s, 0))) for s, n in budgets.items()}

    def put(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        used = _used(spark, folder, batch)
        start = spark.createDataFrame([(s, *n) for s, n in given.items()], "source string, budget long, val_budget long")
        left = start.join(used, "source", "left") if used is not None else start.withColumns({"train_used": F.lit(0), "val_used": F.lit(0)})
        left = left.select("source", *((F.col(b) - F.coalesce(u, F.lit(0))).cast("long").alias(b) for b, u in (("budget", "train_used"), ("val_budget", "val_used"))))
        rows = df.select("source", "row_id", "n_tokens").join(F.broadcast(left.where("budget > 0 OR val_budget > 0")), "source")  # a row for each source that has a budget
        taken = K.quota(rows, val_ratio, seed).select("source", "row_id", "n_tokens", "split", "take")
        taken.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")
        added = spark.read.schema(taken.schema).parquet(f"{folder}/rows/batch={batch}").groupBy("source").agg(*(F.sum(F.when(F.col("split") == s, F.col("take")).otherwise(0)).alias(f"{s}_used") for s in ("train", "val")))
        both = added if used is None else added.unionByName(used).groupBy("source").agg(F.sum("train_used").alias("train_used"), F.sum("val_used").alias("val_used"))
        both.coalesce(1).write.mode("overwrite").parquet(f"{folder}/used/batch={batch}")

    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").foreachBatch(put)
    (writer if keep_running else writer.trigger(availableNow=True)).start().awaitTermination()


def _used(spark: SparkSession, folder: str, batch: int) -> DataFrame | None:
    """What is used up after the last batch before this one, or none."""
    store, base = filesystem(folder)
    whole = [int(f.path.rpartition("batch=")[2].partition("/")[0]) for f in store.get_file_info(pafs.FileSelector(f"{base}/used", allow_not_found=True, recursive=True)) if f.base_name == "_SUCCESS"]
    before = max((n for n in whole if n < batch), default=None)
    return None if before is None else spark.read.schema("source string, train_used long, val_used long").parquet(f"{folder}/used/batch={before}")


def taken_rows(spark: SparkSession, folder: str) -> DataFrame:
    """All that `fill_budgets` has taken, with the batch that took it."""
    return spark.read.schema("source string, row_id long, n_tokens long, split string, take long, batch long").parquet(f"{folder}/rows")


def windowed(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Counts and sums of a value in time windows; rows later than the watermark are left out of a stream."""
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return kept.groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", by: str = "user_id") -> DataFrame:
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    return kept.groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), "n")


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Everything there is now, through the stream, as a table in a shared folder with its checkpoint; run again, it goes on from there.

    Rows are appended by the file sink; a complete result replaces the one before.  After
    a batch that broke off, a source of our own runs that again, and comes to what is
    new when it is called next.
    """
    spark, rows = stream.sparkSession, f"{folder}/rows"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", rows).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(rows)
    writer.foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{rows}/{batch}")).start().awaitTermination()
    last = spark.read.format("text").load(f"{folder}/state/commits").select(F.max(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).cast("long"))).first()[0]
    return spark.read.schema(stream.schema).parquet(f"{rows}/{last}")
