"""Statistics of tokens, shards, trials, runs and scores."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frequency(tokens: DataFrame, column: str = "token") -> DataFrame:
    return tokens.groupBy(column).agg(F.count("*").alias("n"))


def id_counts(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Rows (groups, token, n): how often each id occurs in the arrays `ids`, counted in each task first."""
    names = [*groups, "token", "n"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for b in parts:
            keys = list(zip(*(b.column(i).to_pylist() for i in range(len(groups))), strict=True)) or [()] * b.num_rows
            for key in dict.fromkeys(keys):
                mine = b.column(len(groups)).filter(pa.array([k == key for k in keys]))
                n = np.bincount(np.asarray(mine.flatten()).astype(np.int64))
                old = held.get(key, np.empty(0, np.int64))
                held[key] = np.pad(old, (0, max(0, len(n) - len(old)))) + np.pad(n, (0, max(0, len(old) - len(n))))
        for key, n in held.items():
            at = np.flatnonzero(n)
            columns = [pa.array([k] * len(at)) for k in key] + [pa.array(at, pa.int64()), pa.array(n[at], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names)

    kinds = "".join(f"{g} {dict(rows.dtypes)[g]}, " for g in groups)
    counted = rows.select(*groups, "ids").mapInArrow(run, f"{kinds}token long, n long")
    return counted.groupBy(*groups, "token").agg(F.sum("n").alias("n"))


def shard_statistics(slices: DataFrame, end: int | None) -> DataFrame:
    """Rows (split, path, least, most, ends, tokens) of read shards, of their slices (split, path, ids)."""
    ends = F.size(F.filter("ids", lambda x: x == (-1 if end is None else end))).cast("long")
    each = slices.select("split", "path", F.array_min("ids").alias("least"), F.array_max("ids").alias("most"), ends.alias("ends"), F.size("ids").cast("long").alias("tokens"))
    return each.groupBy("split", "path").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("ends").alias("ends"), F.sum("tokens").alias("tokens"))


def added(histograms: DataFrame, column: str = "token") -> DataFrame:
    """Histograms of several sources as one."""
    return histograms.groupBy(column).agg(F.sum("n").alias("n"))


def counted(vocabulary: DataFrame, histogram: DataFrame, column: str = "token") -> DataFrame:
    """Every entry of a vocabulary with its frequency, 0 where it wasn't seen."""
    return vocabulary.select(column).distinct().join(histogram, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def top(histogram: DataFrame, n: int = 100, column: str = "token") -> DataFrame:
    """The most frequent, of equal counts the smaller token."""
    return histogram.where("n > 0").orderBy(F.desc("n"), column).limit(n)


def named_ranges(df: DataFrame, name: str, sums: list[str], beginnings: tuple[str, ...], n: int) -> DataFrame:
    """Calls and totals of the names with one of these beginnings, the largest by the first total."""
    mine = reduce(lambda a, b: a | b, (F.col(name).startswith(x) for x in beginnings))
    totals = df.where(mine).groupBy(name).agg(F.count("*").alias("calls"), *(F.sum(c).alias(c) for c in sums))
    return totals.orderBy(F.desc(sums[0]), name).limit(n)


def rate(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def best(df: DataFrame, groups: list[str], measure: str, columns: list[str]) -> DataFrame:
    """The row of the largest measure of each group, of equal ones the smallest by columns."""
    w = Window.partitionBy(*groups).orderBy(F.desc(measure), *columns)
    return df.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")


def last(df: DataFrame, groups: list[str], order: str, n: int = 1) -> DataFrame:
    w = Window.partitionBy(*groups).orderBy(F.desc(order))
    return df.withColumn("n_", F.row_number().over(w)).where(F.col("n_") <= n).drop("n_")


def perplexity(score: Column, weight: Column) -> Column:
    return F.exp(-F.sum(score) / F.sum(weight))


def bits(score: Column, size: Column) -> Column:
    return -F.sum(score) / (F.sum(size) * F.log(F.lit(2.0)))


def capped_perplexity(loss: Column) -> Column:
    return F.exp(F.least(F.lit(20.0), loss))
