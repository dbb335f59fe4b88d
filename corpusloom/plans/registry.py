"""Queries by name, each with the SQL that DuckDB checks it by, if SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


#: Bytes of a table of texts for each core below which its rows are dealt out anew: it may be one row group, which one task reads.
SMALL = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; a small one of texts is spread over all cores, a large one has splits enough."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name not in ("documents", "pages"):
        return df
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL else df
