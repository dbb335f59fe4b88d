"""How far the sources of a language are from one another, and by which terms: dense tiles of groups by terms.

Terms are runs of letters A-Z, lower-cased, and of characters beyond ASCII.  Each
task counts the terms of its documents and how many documents hold them, by language
and source, before anything is shuffled.  The terms that a language keeps are dealt
by their hash into blocks so that a tile, all sources of a language by the terms of a
block, has about ``CELLS`` cells.  A tile is a dense numpy matrix of 64-bit integers.
Broadcasting gives the divergence of every pair of its rows, in parts of
``AT_ONCE`` cells, and the ``TOP`` best terms of each row against the language.  Spark
sums the matrices of pairs over all tiles and merges the best terms of each row; both
are combined within tasks before they are shuffled.

Every number is an exact integer; counts up to 9e15 are safe.

Defined results: null text, lang and source are ''; repeated rows count as often as
they stand there; a group without terms has all other sources of its language as
pairs, with the shares of a group that holds no kept term; a language that keeps no
term has pairs of value 0 and no terms; an empty table gives no rows; extra columns
are ignored.  Ties go by the bytes of the item.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _shared

SCALE, LEAST_DOCUMENTS, TOP = 1_000_000_000, 3, 200
#: Cells of a tile; cells of the differences of pairs that are held at once; bytes of text cut up together.
CELLS, AT_ONCE, STRETCH = 1 << 20, 1 << 21, 1 << 20
#: Terms that a task counts before it passes its counts on; rows of a batch of them.
MOST_TERMS, BATCH = 300_000, 1 << 16


def _folding() -> bytes:
    """A-Z to a-z, other ASCII to a space."""
    table = bytearray(range(256))
    for c in range(128):
        table[c] = ord(chr(c).lower()) if chr(c).isalpha() else 32
    return bytes(table)


FOLDING = _folding()


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in parts; terms across a border are whole."""
    at = 0
    while at < len(text):
        end = at + STRETCH
        while end < len(text) and FOLDING[text[end]] != 32:
            end += 1
        yield text[at:end].translate(FOLDING).split()
        at = end


def partial_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows (lang, source, term, n, held) of each task: occurrences, documents that hold the term; the term '' tells that the group occurs."""
    names = ["lang", "source", "term", "n", "held"]

    def told(counts: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, held) in counts.items():
            terms = [b"", *n]
            for at in range(0, len(terms), BATCH):
                part = terms[at : at + BATCH]
                columns = [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string())]
                columns += [pa.array([c[t] for t in part], pa.int64()) for c in (n, held)]
                yield pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for whole in batches:
            for b in _shared.slices(whole):
                for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    n, held = counts.setdefault((lang, source), (Counter(), Counter()))
                    distinct: set[bytes] = set()
                    for part in terms_of(text):
                        n.update(part)
                        distinct.update(part)
                    held.update(distinct)
                if sum(len(n) for n, _ in counts.values()) > MOST_TERMS:
                    yield from told(counts)
                    counts = {}
        yield from told(counts)

    columns = [F.coalesce(docs[c].cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    return docs.select(*columns).mapInArrow(run, "lang string, source string, term string, n long, held long")


def kept_counts(partial: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """Rows (lang, source, term, n, first): the terms that a language keeps, one row of each term being the first; and the term '' of each group.

    One shuffle, by language and term: a term has at most one row from each task and source.
    """
    each = partial.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))
    term = Window.partitionBy("lang", "term")
    each = each.withColumn("holders", F.sum("held").over(term)).withColumn("first", (F.row_number().over(term.orderBy("source")) == 1).cast("long"))
    return each.where((F.col("holders") >= least) | (F.col("term") == "")).select("lang", "source", "term", "n", (F.col("first") * (F.col("term") != "").cast("long")).alias("first"))


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * n / total) for n <= total, by long division in three steps of 1000, so that nothing overflows."""
    found, rest = np.zeros_like(n), n
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        found = found * 1000 + digit
    return found + 1


def pair_sums(p: np.ndarray) -> np.ndarray:
    """For all pairs of rows the sum of floor((p - q)^2 / q) over the columns: row i has p, column j has q."""
    sums = np.zeros((len(p), len(p)), np.int64)
    rows = max(1, AT_ONCE // max(1, len(p)))
    for at in range(0, p.shape[1], rows):
        q = p[:, at : at + rows]
        step = max(1, AT_ONCE // max(1, q.size))
        for i in range(0, len(p), step):
            d = q[i : i + step, None, :] - q[None, :, :]
            d *= d
            d //= q[None, :, :]
            sums[i : i + step] += d.sum(axis=2)
    return sums


def best(values: np.ndarray, allowed: np.ndarray, top: int) -> np.ndarray:
    """Places of the `top` greatest allowed values, greatest first, ties to smaller places."""
    at = np.flatnonzero(allowed)
    if len(at) > top:
        at = at[values[at] >= np.partition(values[at], len(at) - top)[len(at) - top]]
    return at[np.argsort(-values[at], kind="stable")][:top]


def tile_rows(table: pa.Table, top: int = TOP) -> pa.Table:
    """What a tile adds: rows (lang, source, part, item, value) of all its pairs, and of each group's best terms.

    Rows without a term are the groups of the language, with their totals and its number of terms.
    """
    head = table.filter(pc.is_null(table["term"]))
    head = head.take(pc.sort_indices(head["source"].cast(pa.binary())))
    body = table.filter(pc.is_valid(table["term"]))
    lang, block, sources = head["lang"][0].as_py(), head["block"][0].as_py(), head["source"].combine_chunks()
    out: dict[str, list] = {"source": [], "part": [], "item": [], "value": []}
    size = len(sources)
    if body.num_rows or block == 0:
        sums = np.zeros((size, size), np.int64)
        if body.num_rows:
            coded = body["term"].combine_chunks().dictionary_encode()
            order = pc.sort_indices(coded.dictionary.cast(pa.binary()))
            terms, place = coded.dictionary.take(order), np.empty(len(order), np.int64)
            place[np.asarray(order)] = np.arange(len(order))
            row = np.asarray(pc.index_in(body["source"], sources))
            n = np.zeros((size, len(terms)), np.int64)
            n[row, place[np.asarray(coded.indices)]] = np.asarray(body["n"])
            totals, kept = np.asarray(head["n"]), head["terms"][0].as_py()
            p = shares(n + 1, (totals + kept)[:, None])
            whole = shares(n.sum(axis=0) + 1, totals.sum() + kept)
            sums = pair_sums(p)
            for g in range(size):
                values = (p[g] - whole) ** 2 // whole
                at = best(values, (n[g] > 0) & (p[g] > whole), top)
                out["source"].append(pa.repeat(sources[g], len(at)))
                out["part"].append(pa.repeat("term", len(at)))
                out["item"].append(terms.take(pa.array(at)))
                out["value"].append(pa.array(values[at]))
        i, j = np.nonzero(~np.eye(size, dtype=bool))
        out["source"].append(sources.take(pa.array(i)))
        out["part"].append(pa.repeat("pair", len(i)))
        out["item"].append(sources.take(pa.array(j)))
        out["value"].append(pa.array(sums[i, j]))
    columns = {k: pa.chunked_array(v, pa.int64() if k == "value" else pa.string()) for k, v in out.items()}
    return pa.table({"lang": pa.repeat(lang, len(columns["value"])), **columns})


def divergences(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows (lang, source, part, item, value, rank): for each group its divergence from all other sources of its language, and its `top` terms."""
    kept = _shared.materialize(kept_counts(partial_counts(docs, text_col, lang_col, source_col), least), "kept-terms")
    lang = Window.partitionBy("lang")
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("first").alias("terms"))
    groups = _shared.materialize(groups.withColumn("terms", F.sum("terms").over(lang)).withColumn("groups", F.count("*").over(lang)), "groups")
    blocks = groups.agg(F.max(F.ceil(F.col("terms") * F.col("groups") / CELLS))).first()[0]
    blocks = max(1, blocks or 1)

    heads = groups.select("lang", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "source", F.lit(None).cast("string").alias("term"), "n", "terms")
    block = F.pmod(F.xxhash64("lang", "term"), F.lit(blocks)).cast("int")
    body = kept.where("term <> ''").select("lang", block.alias("block"), "source", "term", "n", F.lit(None).cast("long").alias("terms"))
    tiles = heads.unionByName(body).groupBy("lang", "block")
    rows = _shared.materialize(tiles.applyInArrow(lambda t: tile_rows(t, top), "lang string, source string, part string, item string, value long"), "tiles")

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    pairs = rows.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    terms = rows.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(_shared.read_table(spark, sf_dir, "documents"))


SQL = rf"""WITH d AS (SELECT row_number() OVER () AS r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM w GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
x AS (SELECT lang, g.source, k.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY lang, g.source) AS total, v.v, k.n AS lang_n, v.total AS lang_total
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + {SCALE} * (n + 1) // CAST(total + v AS HUGEINT) AS p, 1 + {SCALE} * (lang_n + 1) // CAST(lang_total + v AS HUGEINT) AS q FROM x),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM o QUALIFY part = 'pair' OR rank <= {TOP}"""
