"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's repetition rate is its share of the wanted rows divided by its own
rows.  Each document draws a uniform number from a hash of the seed and its id,
and the inverted Poisson distribution with that rate as its mean gives its
number of copies, which may be none.  Each copy then draws a 60-bit key, by its
number, its id and its text, that is its place in the global shuffle; `position`
is the rank of that key.  Rows of one id, or of none, are thus spread by their texts.

Large rates are drawn in parts of ``PART`` at most, whose counts are summed, as
sums of Poisson numbers are Poisson numbers.  The rates are a row per source;
they are broadcast while there are ``MOST_BROADCAST`` sources at most and joined
by a shuffle, whose large partitions Spark splits, beyond that.  Copies are
dealt out by ranges of the key, so neither a large source nor a document with
many copies meets in one task.

Defined results: a null source is the source named ''; sources missing from
given weights have weight 0 and are left out; documents with a null id draw by
the hash of their text; rows with equal ids draw equal counts; those equal in id
and text, too, are placed by a hash of all their columns; null and empty
texts are documents like any other; an empty table gives no rows.  All columns
of the input are kept; `replica` (from 1) and `position` (from 1) are added, in
place of columns of these names if there are any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _shared

SEED, PART, MOST_BROADCAST = 17, 16.0, 2_000
#: The distribution function of a part is listed to here; what lies beyond has a probability below 1e-18.
LISTED = 80
#: Ranges of the shuffle key for each shuffle partition.
RANGES = 4
_KEY_BITS = 60


def _hash_bits(bits: int, *key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *key).cast("binary")), 1, bits // 4), 16, 10).cast("long")


def uniform(*key: Column) -> Column:
    """In [0, 1), from 52 bits of a hash of the key's parts."""
    return _hash_bits(52, *key).cast("double") / float(1 << 52)


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", size: float = 1.0) -> DataFrame:
    """Rows (mix_source, parts, cdf): the number of equal parts of the rate and the distribution function of one.

    weights: wanted shares by source, of any sum; None: equal shares.  size: wanted rows for each row of the input.
    """
    spark = docs.sparkSession
    counts = docs.groupBy(F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("mix_source")).agg(F.count("*").alias("n"))
    counts = _shared.materialize(counts, "source-counts")
    if weights is None:
        weighed = counts.withColumn("weight", F.lit(1.0))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items() if v > 0], "mix_source string, weight double")
        weighed = counts.join(given, "mix_source")
    rows = counts.agg(F.sum("n")).first()[0] or 0
    whole = weighed.agg(F.sum("weight")).first()[0] or 1.0
    rated = weighed.withColumn("rate", F.col("weight") / whole * rows * size / F.col("n"))
    rated = rated.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int"))
    rated = rated.withColumn("mean", F.col("rate") / F.col("parts"))
    none = F.exp(-F.col("mean"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * F.col("mean") / k
        return F.struct(p.alias("p"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + p)).alias("cdf"))

    start = F.struct(none.alias("p"), F.array(none).alias("cdf"))
    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(LISTED)), start, step, lambda s: s["cdf"])
    return rated.select("mix_source", "parts", cdf.alias("cdf"))


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = SEED, size: float = 1.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Each document as often as its Poisson number says, globally shuffled."""
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("replica", "position")]
    rates = _shared.materialize(repetition_rates(docs, weights, source_col, size), "source-rates")
    few = rates.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST

    def copies(columns: list[Column]) -> DataFrame:
        who = F.coalesce(docs[id_col].cast("string"), F.md5(docs[text_col].cast("binary")), F.lit(""))
        hashed = F.md5(F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary"))
        keyed = docs.select(*columns, who.alias("mix_who"), hashed.alias("mix_text"), F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("mix_source"))
        keyed = keyed.join(F.broadcast(rates) if few else rates, "mix_source")
        seeded = F.lit(str(seed))

        def drawn(part: Column) -> Column:
            u = uniform(seeded, F.lit("count"), part.cast("string"), F.col("mix_who"))
            return F.size(F.filter("cdf", lambda c: c <= u))

        count = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda n, part: n + drawn(part))
        keyed = keyed.withColumn("mix_count", count).where("mix_count > 0")
        keyed = keyed.withColumn("replica", F.explode(F.sequence(F.lit(1), F.col("mix_count"))))
        key = _hash_bits(_KEY_BITS, seeded, F.lit("place"), F.col("replica").cast("string"), F.col("mix_who"), F.col("mix_text"))
        ranges = RANGES * _shared.shuffle_partitions(spark)
        keyed = keyed.withColumn("mix_key", key)
        half = _KEY_BITS // 2
        return keyed.withColumn("mix_range", F.shiftright(F.shiftright("mix_key", half) * ranges, half))

    packed = F.struct(*(docs[c].alias(f"c{i}") for i, c in enumerate(kept))).alias("mix_row")
    sizes = copies([]).groupBy("mix_range").agg(F.count("*").alias("n"))
    # A row for each range of the key, whose number the session's settings fix.
    before = F.sum("n").over(Window.orderBy("mix_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = _shared.materialize(sizes.select("mix_range", F.coalesce(before, F.lit(0)).alias("mix_before")), "range-starts")
    tie = F.xxhash64(*(F.to_json(F.struct(docs[c])) if "map<" in kind else docs[c] for c, kind in docs.dtypes if c in kept)).alias("mix_tie")
    dealt = copies([packed, tie]).repartitionByRange(_shared.shuffle_partitions(spark), "mix_range")
    text = F.col("mix_row").getField(f"c{kept.index(text_col)}")
    within = F.row_number().over(Window.partitionBy("mix_range").orderBy("mix_key", "mix_who", "replica", text, "mix_tie"))
    placed = dealt.withColumn("mix_within", within).join(F.broadcast(starts), "mix_range")
    return placed.select(
        *(F.col("mix_row").getField(f"c{i}").alias(c) for i, c in enumerate(kept)),
        F.col("replica"),
        (F.col("mix_before") + F.col("mix_within")).cast("long").alias("position"),
    )


def op3_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate(_shared.read_table(spark, sf_dir, "documents"))


SQL = f"""WITH d AS (SELECT *, coalesce(source, '') AS src, coalesce(CAST(doc_id AS VARCHAR), md5(text), '') AS who FROM documents),
n AS (SELECT src, count(*) AS n FROM d GROUP BY src),
r AS (SELECT src, (1.0 / (SELECT count(*) FROM n)) * (SELECT count(*) FROM d) / n AS rate FROM n),
p AS (SELECT src, CAST(greatest(1, ceil(rate / {PART})) AS INT) AS parts, rate / greatest(1, ceil(rate / {PART})) AS mean FROM r),
t AS (SELECT src, parts, k, exp(-mean + k * ln(mean) - lgamma(k + 1)) AS p FROM p, range(0, {LISTED + 1}) AS x(k)),
f AS (SELECT src, parts, k, sum(p) OVER (PARTITION BY src ORDER BY k) AS c FROM t),
u AS (SELECT d.*, j, CAST(CAST('0x' || substr(md5('{SEED}|count|' || j || '|' || who), 1, 13) AS BIGINT) AS DOUBLE) / {1 << 52} AS u
  FROM d JOIN p USING (src), range(1, 1000) AS y(j) WHERE j <= parts),
c AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, u.who, count(*) AS copies
  FROM u JOIN f ON f.src = u.src AND f.c <= u.u GROUP BY ALL),
e AS (SELECT *, CAST(unnest(range(1, copies + 1)) AS INT) AS replica FROM c),
h AS (SELECT *, CAST('0x' || substr(md5('{SEED}|place|' || replica || '|' || who || '|' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS key FROM e)
SELECT doc_id, text, lang, source, n_chars, replica, row_number() OVER (ORDER BY key, who, replica, text) AS position FROM h"""
