"""Queries of growing files and logs: tables written as files of lines, followed by streams and read back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..sources import growing as G
from ..sources import shard_files as B
from .registry import query, table

#: Records of a run's file; one record in so many is broken off in the middle.
RUN, BROKEN = 2_000, 97


def write_runs(events: DataFrame, folder: str, part: str) -> None:
    """A file of JSON lines for each RUN events: the first three fifths of its bytes, all of it, or its second half alone for every third run."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("event_id")
        lines = [x[: len(x) // 2] if i % BROKEN == 0 else x for i, x in zip(rows.event_id, rows.line, strict=True)]
        if part == "later" and key[0] % 3 == 0:  # this run began anew
            lines = lines[len(lines) // 2 :]
        blob = "".join(x + "\n" for x in lines).encode()
        B.write_bytes(folder, f"run-{key[0]:06d}/metrics.jsonl", blob[: len(blob) * 3 // 5] if part == "sooner" else blob)
        return pd.DataFrame({"run": [key[0]]})

    line = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    rows = events.select(F.floor(F.col("event_id") / RUN).alias("run"), "event_id", line.alias("line"))
    rows.groupBy("run").applyInPandas(one, "run long").count()


@query(
    f"""WITH r AS (SELECT event_id // {RUN} AS run, event_id, user_id, event_type, value, row_number() OVER (PARTITION BY event_id // {RUN} ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_id // {RUN}) AS n FROM events)
SELECT run, event_id, user_id, event_type, value FROM r WHERE event_id % {BROKEN} <> 0 AND (run % 3 <> 0 OR i >= n // 2)"""
)
def tailed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of run files that grew between two looks, were cut in the middle of a line, or began anew: each whole one once."""
    files, out = storage.work_dir(spark, "runs"), storage.work_dir(spark, "tail")
    events = table(spark, sf_dir, "events")
    for part in ("sooner", "later"):
        write_runs(events, files, part)
        G.tail_into(G.growing_lines(spark, files, "run-*/metrics.jsonl"), out)
    got = G.current_records(spark, out, "event_id long, user_id long, event_type string, value double", keep=None)
    return got.select(F.regexp_extract("path", "run-([0-9]+)/", 1).cast("long").alias("run"), "event_id", "user_id", "event_type", "value")


@query("SELECT event_id, user_id, event_type, value FROM events")
def logged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events through a stream into a log of JSON lines, and back."""
    out = storage.work_dir(spark, "log")
    whole = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(whole.schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    G.append_json(stream.select("event_id", "user_id", "event_type", "value"), f"{out}/log", f"{out}/state")
    return G.logged(spark, f"{out}/log", "event_id long, user_id long, event_type string, value double").drop("batch")
