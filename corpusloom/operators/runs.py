"""Run folders, checkpoints, configurations and their hashes."""

from __future__ import annotations

import hashlib
import json
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, sha256) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def canonical_hash(value: Any) -> str:
    """Of a value as compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def same_json(a: str, b: str) -> bool:
    """Whether two JSON texts say the same."""
    return json.loads(a) == json.loads(b)


def known_columns(df: DataFrame, known: list[str]) -> DataFrame:
    return df.select(*(c for c in known if c in df.columns))


def compatible(a: Column, b: Column, besides: tuple[str, ...] = ("model_name",)) -> Column:
    """Whether two maps agree on all keys but these."""
    rest = lambda m: F.array_sort(F.map_entries(F.map_filter(m, lambda k, _: ~k.isin(*besides))))
    return rest(a).eqNullSafe(rest(b))


def checkpoints(paths: DataFrame) -> DataFrame:
    """Rows (path, step) of the paths that end in step_<n>, the latest first."""
    step = F.regexp_extract("path", r"step_(\d+)/?$", 1)
    return paths.where(step != "").select("path", step.cast("long").alias("step")).orderBy(F.desc("step"))


def prunable(listed: DataFrame, keep: int) -> DataFrame:
    """Checkpoints beyond the last ones of each folder."""
    w = Window.partitionBy(F.regexp_extract("path", "^(.*?)/?[^/]+/?$", 1)).orderBy(F.desc("step"))
    return listed.withColumn("n_", F.row_number().over(w)).where(F.col("n_") > keep).drop("n_")


def register(run_ids: DataFrame, parts: dict[str, DataFrame], checkpoints: DataFrame, selected: str) -> DataFrame:
    """Every run with what there is of it: a struct for each of the parts (run_id and more), its checkpoints (run_id, path), and whether it is the selected one."""
    out = run_ids.select("run_id").distinct()
    for name, part in parts.items():
        others = [c for c in part.columns if c != "run_id"]
        out = out.join(part.select("run_id", F.struct(*others).alias(name)), "run_id", "left")
    kept = checkpoints.groupBy("run_id").agg(F.array_sort(F.collect_list("path")).alias("checkpoints"))
    none = F.array().cast("array<string>")
    return out.join(kept, "run_id", "left").withColumn("checkpoints", F.coalesce("checkpoints", none)).withColumn("selected", F.col("run_id") == selected)


def stacked(parts: list[DataFrame]) -> DataFrame:
    """Rows of several tables under the union of their columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_csv(parts: list[DataFrame], path: str) -> None:
    stacked(parts).write.mode("overwrite").option("header", True).csv(path)
