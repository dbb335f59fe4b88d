"""Reconciliation and verification: violations as rows, none if all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reconcile(listed: DataFrame, found: DataFrame, key: str = "path") -> DataFrame:
    """Rows (key, status): what is listed alone is missing, what is found alone is extra."""
    a, b = listed.select(key).distinct().withColumn("l_", F.lit(True)), found.select(key).distinct().withColumn("f_", F.lit(True))
    status = F.when(F.col("f_").isNull(), "missing").when(F.col("l_").isNull(), "extra").otherwise("both")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left_anti")


def required(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """The rows, after an error if one breaks the condition."""
    return df.where(F.assert_true(condition, message).isNull())


def shard_violations(entries: DataFrame, disk: DataFrame, ids: DataFrame, vocabulary: int, totals: dict[str, int]) -> DataFrame:
    """Rows (problem, path) of entries (split, path, token_count) against files (path, bytes) and read ids (path, ids)."""
    problem = lambda df, name: df.select(F.lit(name).alias("problem"), "path")
    both = entries.join(disk, "path")
    outside = ids.where((F.array_min("ids") < 0) | (F.array_max("ids") >= vocabulary))
    counted = entries.groupBy("split").agg(F.sum("token_count").alias("n"))
    expected = reduce(lambda a, b: a | b, [(F.col("split") == s) & (F.col("n") != n) for s, n in totals.items()], F.lit(False))
    return reduce(
        DataFrame.unionByName,
        [
            problem(unmatched(entries, disk, ["path"]), "missing file"),
            problem(unmatched(disk, entries, ["path"]), "unlisted file"),
            problem(both.where("bytes <> 2 * token_count"), "wrong size"),
            problem(outside, "id out of range"),
            problem(repeated(entries, ["path"]), "listed twice"),
            problem(counted.where(expected).withColumnRenamed("split", "path"), "wrong total"),
        ],
    )


def passed(violations: DataFrame) -> bool:
    return violations.limit(1).count() == 0
