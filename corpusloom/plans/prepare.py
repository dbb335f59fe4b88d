"""Preparations as plans: the documents of one corpus or of a mix of sources, and how many tokens of each are taken."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as X
from ..operators import corpus as C
from ..operators import stats as A
from ..operators import tokens as K
from ..operators.runs import canonical_hash
from ..spec import Source, scaled_budget, val_target


def mix(verdicts: DataFrame, budget: int | Column, val_budget: int | Column = 0, val_ratio: float = 0.0, seed: int = 1337) -> DataFrame:
    """Accepted documents up to each source's budget, with split and take."""
    accepted = verdicts.where("disposition = 'accepted'")
    counted = accepted.select("source", "row_id", "n_tokens", F.lit(budget).cast("long").alias("budget"), F.lit(val_budget).cast("long").alias("val_budget"))
    return K.quota(counted, val_ratio, seed)


def summary(taken: DataFrame) -> DataFrame:
    return taken.groupBy("source").agg(F.count("*").alias("documents"), F.sum("take").alias("tokens"), F.count_if(F.col("take") < F.col("n_tokens")).alias("truncated"))


def source_rows(rows: DataFrame, spec: Source) -> DataFrame:
    """Raw rows of one source as (row_id, source, text, passes, min_chars)."""
    fields = {f: P.field(rows, f) for f in rows.columns}
    text = X.render(spec.text_template, fields) if spec.text_template else P.field(rows, spec.text_field)
    return rows.select("row_id", F.lit(spec.name).alias("source"), text.alias("text"), P.conditions(rows, spec.filters).alias("passes"), F.lit(spec.min_text_chars).alias("min_chars"))


@dataclass(frozen=True)
class Shared:
    """One table that holds many sources, told apart by a column; it is read once for all of them."""

    rows: DataFrame
    column: str = "source"


def shared_rows(shared: Shared, specs: list[Source]) -> DataFrame:
    """`source_rows` of all sources in one pass; sources of equal fields, filters and least lengths share an expression."""
    rows, source = shared.rows, F.col(shared.column)
    fields = {f: P.field(rows, f) for f in rows.columns}
    alike: dict[str, list[Source]] = {}
    for s in specs:
        alike.setdefault(canonical_hash([s.text_template, s.text_field, dict(s.filters), s.min_text_chars]), []).append(s)

    def chosen(value: Callable[[Source], Column]) -> Column:
        parts = [(source.isin([s.name for s in group]), value(group[0])) for group in alike.values()]
        return parts[0][1] if len(parts) == 1 else reduce(lambda c, p: c.when(*p), parts[1:], F.when(*parts[0]))

    text = chosen(lambda s: X.render(s.text_template, fields) if s.text_template else P.field(rows, s.text_field))
    passes = chosen(lambda s: P.conditions(rows, s.filters))
    named = rows.where(source.isin([s.name for s in specs]))
    return named.select("row_id", source.alias("source"), text.alias("text"), passes.alias("passes"), chosen(lambda s: F.lit(s.min_text_chars)).alias("min_chars"))


def all_rows(rows: Mapping[str, DataFrame] | Shared, specs: list[Source]) -> DataFrame:
    if isinstance(rows, Shared):
        return shared_rows(rows, specs)
    return reduce(DataFrame.unionByName, (source_rows(rows[s.name], s) for s in specs))


def by_source(values: Mapping[str, int]) -> Column:
    """The value of each row's source."""
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[F.col("source")]


def budgets(specs: list[Source], scale: float, val_ratio: float) -> tuple[dict[str, int], dict[str, int]]:
    """Train and validation budgets by source."""
    train = {s.name: scaled_budget(s.token_budget, scale) for s in specs}
    return train, {k: val_target(n, val_ratio) for k, n in train.items()}


def mix_sources(rows: Mapping[str, DataFrame] | Shared, specs: list[Source], index: DataFrame, scale: float = 1.0, val_ratio: float = 0.0, seed: int = 1337, width: int = C.WIDTH) -> tuple[DataFrame, DataFrame]:
    """All sources of a mix, counted in words: the disposition of every raw row, and what is taken of the accepted ones.

    A source that falls short of its budget is an error where `require_full` is applied to what is taken.
    """
    judged = C.dispositions(all_rows(rows, specs), F.col("passes"), index, F.col("min_chars"), width, tokens=K.word_count(F.col("text")))
    train, val = budgets(specs, scale, val_ratio)
    return judged, mix(judged, by_source(train), by_source(val), val_ratio, seed)


def require_full(taken: DataFrame, budgets: Mapping[str, int]) -> DataFrame:
    """Train tokens by source; an error if one falls short of its budget."""
    spark = taken.sparkSession
    wanted = spark.createDataFrame(list(budgets.items()), "source string, budget long")
    got = taken.where("split = 'train'").groupBy("source").agg(F.sum("take").alias("tokens"))
    joined = wanted.join(got, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    return joined.where(F.assert_true(F.col("tokens") >= F.col("budget"), F.concat(F.lit("too few tokens: "), "source")).isNull())


def single(cleaned: DataFrame, val_ratio: float, seed: int) -> DataFrame:
    unique = C.drop_copies(cleaned.where("text <> ''"), [])
    rows = unique.select(
        F.when(K.coin(seed, "row_id") < val_ratio, "val").otherwise("train").alias("split"), K.word_count(F.col("text")).alias("n"), X.mostly_ascii_letters(F.col("text")).alias("en")
    )
    return rows.groupBy("split").agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"), F.count_if("en").alias("en_like"), F.round(A.rate(F.sum("n"), F.count("*")), 6).alias("average"))
