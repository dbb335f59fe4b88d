"""Analytics of training runs: smoothing, trailing averages, stagnation, milestones, schedules, series."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values.
KEEP, TRAILING = 0.95, (60, 300, 1800)
AXES = {"step": "step", "tokens": "tokens_seen", "wall time": "elapsed_time"}
SERIES = ("train_loss", "smoothed_loss", "validation_loss")
#: Steps of one block of a run that is smoothed.
BLOCK = 50_000


def smooth(df: DataFrame, run: str, order: str, value: str, keep: float = KEEP, block: int = BLOCK) -> DataFrame:
    """Adds smoothed, the exponential average of each run's values in the order of a number, which begins with the first.

    In two levels, so that no task holds a whole run: what each block of the order adds to the average,
    the average before each block, then the rows of a block from there.  Missing values don't count.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("smoothed", T.DoubleType())])
    df = df.withColumn("block_", F.floor(F.col(order) / block))

    def averages(values: pd.Series, before: float) -> pd.Series:
        """From the average before the values; from the first of them if that is missing."""
        return pd.concat([pd.Series([before]), values.astype(float)]).ewm(alpha=1 - keep, adjust=False, ignore_na=True).mean().iloc[1:]

    def added(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        values = rows.sort_values(order)[value]
        known = values.dropna()
        first = known.iloc[0] if len(known) else None
        return pd.DataFrame({"run_": [key[0]], "at_": [key[1]], "n_": [len(known)], "first_": [first], "added_": [averages(values, 0.0).iloc[-1]]})

    def carried(rows: pd.DataFrame) -> pd.DataFrame:
        rows, now, before = rows.sort_values("at_"), None, []
        for n, first, more in zip(rows["n_"], rows["first_"], rows["added_"], strict=True):
            before.append(now)
            if n:
                now = (first if now is None else now) * keep ** int(n) + more
        return rows[["run_", "at_"]].assign(before_=pd.Series(before, rows.index, dtype=float))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        return rows.assign(smoothed=averages(rows[value], rows["before_"].iloc[0]).to_numpy())[schema.names]

    keys = T.StructType([T.StructField("run_", df.schema[run].dataType), T.StructField("at_", T.LongType())])
    totals = T.StructType([*keys.fields, T.StructField("n_", T.LongType()), T.StructField("first_", T.DoubleType()), T.StructField("added_", T.DoubleType())])
    blocks = df.select(run, order, value, "block_").groupBy(run, "block_").applyInPandas(added, totals)
    before = blocks.groupBy("run_").applyInPandas(carried, T.StructType([*keys.fields, T.StructField("before_", T.DoubleType())]))
    joined = df.join(before, df[run].eqNullSafe(before["run_"]) & df["block_"].eqNullSafe(before["at_"]), "left").drop("run_", "at_")
    return joined.groupBy(run, "block_").applyInPandas(one, schema)


def trailing_each(df: DataFrame, run: str, elapsed: str, value: str, spans: tuple[int, ...] = TRAILING) -> DataFrame:
    """Adds to every record the averages over the last seconds of its run up to it: avg_<seconds>s; zero and missing values don't count.

    A run is cut into stretches as long as the longest span, each with the one before for
    context, so that no task holds a run.  Records without a time have no averages.
    """
    names = [f"avg_{s}s" for s in spans]
    own = F.floor(F.col(elapsed) / max(spans))
    # A record stands in its own stretch, and for context in the next one.
    spread = df.where(F.col(elapsed).isNotNull()).withColumn("own_", own).withColumn("block_", F.explode(F.array(F.col("own_"), F.col("own_") + 1)))
    near = Window.partitionBy(run, "block_").orderBy(elapsed)
    counted = F.nullif(F.col(value), F.lit(0))
    timed = spread.withColumns({n: F.avg(counted).over(near.rangeBetween(-s, 0)) for n, s in zip(names, spans, strict=True)}).where("block_ = own_")
    return timed.drop("own_", "block_").unionByName(df.where(F.col(elapsed).isNull()), allowMissingColumns=True)


def trailing(df: DataFrame, run: str, elapsed: str, value: str, order: str, spans: tuple[int, ...] = TRAILING) -> DataFrame:
    """Averages over the last seconds before a run's last record; zero and missing values don't count, missing times do.

    Where the last record has no time, each average is that of the last sixth of the values, one at least.
    """
    latest = df.groupBy(run).agg(F.max(F.struct(order, F.col(elapsed).alias("at"))).alias("latest_")).select(run, F.col("latest_.at").alias("latest_"))
    near = df.join(latest, run).where((F.col(value) != 0) & F.col(value).isNotNull())
    ago = F.col("latest_") - F.coalesce(F.col(elapsed), F.col("latest_"))
    timed = near.where("latest_ IS NOT NULL").groupBy(run).agg(*(F.avg(F.when(ago <= s, F.col(value))).alias(f"avg_{s}s") for s in spans))
    rest = near.where("latest_ IS NULL")
    sizes = rest.groupBy(run).agg(F.greatest(F.lit(1), F.floor(F.count("*") / 6)).alias("n_"))
    last = rest.withColumn("k_", F.row_number().over(Window.partitionBy(run).orderBy(F.desc(order)))).join(sizes, run).where("k_ <= n_")
    return timed.unionByName(last.groupBy(run).agg(*(F.avg(value).alias(f"avg_{s}s") for s in spans)))


def overview(df: DataFrame, run: str, order: str = "step") -> DataFrame:
    """What a monitor shows of each run: its last record, progress and trailing speeds of records as a run writes them."""
    names = [c for c in df.columns if c != run]
    last = df.groupBy(run).agg(F.max_by(F.struct(*names), order).alias("last_")).select(run, "last_.*")
    told = last.withColumn("progress", progress(F.coalesce("tokens_seen", F.lit(0)), F.coalesce("tokens_target", F.lit(0))))
    return told.join(trailing(df, run, "elapsed_time", "tokens_per_sec", order), run, "left")


def sweep(df: DataFrame, setting: str, order: str, loss: str, tokens: str) -> DataFrame:
    """Rows (setting, tokens, records, final_loss, best): how each setting of a sweep ends; `best` are those with the least final loss."""
    ends = df.groupBy(setting).agg(F.max_by(loss, order).alias("final_loss"), F.max(tokens).alias("tokens"), F.count("*").alias("records"))
    least = ends.agg(F.min("final_loss").alias("least_"))
    return ends.join(F.broadcast(least)).withColumn("best", F.col("final_loss").eqNullSafe(F.col("least_"))).drop("least_")


def stagnation(df: DataFrame, groups: list[str], order: str, value: str, gain: float = 1.01, times: int = 2) -> DataFrame:
    """Trials up to the one that is the `times`-th in a row without a gain of over 1 %."""
    w = Window.partitionBy(*groups).orderBy(order)
    flat = df.withColumn("flat_", F.coalesce(F.col(value) <= F.lag(value).over(w) * gain, F.lit(False)))
    runs = [F.coalesce(F.lag("flat_", k).over(w), F.lit(False)) for k in range(1, times)]
    stop = F.col("flat_")
    for r in runs:
        stop = stop & r
    flat = flat.withColumn("stop_", stop.cast("int"))
    before = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return flat.withColumn("over_", F.coalesce(F.sum("stop_").over(before), F.lit(0))).where("over_ = 0").drop("flat_", "stop_", "over_")


def milestones(df: DataFrame, run: str, order: str, tokens: str, interval: int) -> DataFrame:
    """Records at which the tokens pass a multiple of the interval."""
    w = Window.partitionBy(run).orderBy(order)
    reached = F.floor(F.col(tokens) / interval)
    return df.withColumn("milestone", reached).withColumn("was_", F.coalesce(F.lag("milestone").over(w), F.lit(0))).where("milestone > was_").drop("was_")


def learning_rate(tokens: Column, peak: float, least: float, warmup: int, total: int) -> Column:
    """Linear up to the peak, then a cosine down to the least."""
    seen = F.greatest(tokens, F.lit(0))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (seen - warmup) / float(max(1, total - warmup))))
    decay = least + (peak - least) * 0.5 * (1 + F.cos(math.pi * share))
    return F.when(seen < warmup, peak * seen / float(warmup)).otherwise(decay) if warmup else decay


def eta(target: Column, seen: Column, per_second: Column) -> Column:
    return F.when(per_second > 0, F.greatest(target - seen, F.lit(0)) / per_second)


def progress(seen: Column, target: Column) -> Column:
    return F.when(target > 0, 100.0 * seen / target).otherwise(0.0)


def series(df: DataFrame, axis: str = "tokens") -> DataFrame:
    """Rows (trace, x, y) of the loss traces; points without a value are left out, a missing x is 0."""
    x = F.coalesce(F.col(AXES.get(axis, "tokens_seen")).cast("double"), F.lit(0.0))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("trace"), F.col(k).cast("double").alias("y")) for k in SERIES)))
    return df.select(x.alias("x"), each.alias("p")).select("p.trace", "x", "p.y").where("y IS NOT NULL")
