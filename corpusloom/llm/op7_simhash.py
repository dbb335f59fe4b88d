"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits are cut into ``SEGMENTS`` halves.  Of two fingerprints at
``MOST_BITS`` or fewer differing bits, one half differs in at most
``MOST_BITS // SEGMENTS`` bits; so a table holds each distinct fingerprint under
each of its halves, every fingerprint fetches the keys in the Hamming balls of
that radius around its halves, and the complete distance is checked for what the
table gives.  Copies share a fingerprint, so the search runs over distinct
fingerprints and never pairs copies with one another.

Links are joined to components by contraction: each round points every
fingerprint to its smallest neighbour, follows the pointers, and puts roots in
the place of nodes in the links.  Tables are written to the shared folder
between rounds; the driver sees counts alone.

Defined results: a null text is empty, and texts without words have fingerprint
zero, which links like any other; null doc_ids keep their rows but are never a
component's id, which is null only if all ids are; repeated rows are kept; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import _shared

SEED, SHINGLE, MOST_BITS, SEGMENTS = 42, 3, 3, 2
#: Shingle hashes whose bits are counted at once.
AT_ONCE = 1 << 16


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of a text's words, A-Z lower-cased, repeats included."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < shingle:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.fromiter((xxh64_intdigest(s, SEED) for s in joined), np.uint64, len(words) - shingle + 1)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The bits set in over half the hashes, as a signed number; 0 without words."""
    hashes = shingle_hashes(text, shingle)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), AT_ONCE):
        part = hashes[at : at + AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, row_hash: Column | None = None) -> DataFrame:
    """Rows (doc_id, row_hash, fp); row_hash is null unless an expression for it is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _shared.slices(whole):
                found = [fingerprint(t, shingle) for t in b.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.int64())], ["doc_id", "row_hash", "fp"])

    text = F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")
    row = F.lit(None).cast("long") if row_hash is None else row_hash
    return docs.select(docs[id_col].cast("long").alias("doc_id"), text, row.alias("row_hash")).mapInArrow(run, "doc_id long, row_hash long, fp long")


def _ball(width: int, radius: int) -> list[int]:
    """Masks of at most radius of width bits."""
    masks = {0}
    for _ in range(radius):
        masks |= {m ^ 1 << i for m in masks for i in range(width)}
    return sorted(masks)


def near_pairs(distinct: DataFrame, most: int = MOST_BITS, segments: int = SEGMENTS) -> DataFrame:
    """Pairs (a, b), a < b, of the column fp at a distance of at most `most` bits; a pair may come more than once."""
    width = 64 // segments

    def segment(i: int) -> Column:
        return F.shiftrightunsigned("fp", i * width).bitwiseAND((1 << width) - 1)

    def keys(masks: list[int]) -> Column:
        each = [F.transform(F.array(*(F.lit(m).cast("long") for m in masks)), lambda m: segment(i).bitwiseXOR(m).bitwiseOR(F.lit(i << width).cast("long"))) for i in range(segments)]  # noqa: B023
        return F.explode(F.concat(*each))

    table = distinct.select(F.col("fp").alias("b"), keys([0]).alias("key"))
    probes = distinct.select(F.col("fp").alias("a"), keys(_ball(width, most // segments)).alias("key"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most
    return probes.join(table, (probes["key"] == table["key"]) & (F.col("a") < F.col("b")) & near).select("a", "b")


def _follow(pointers: DataFrame, label: str) -> DataFrame:
    """Point every node to the end of its path; pointers (node, root) have no cycles, and a node points once."""
    while True:
        onward = pointers.select(F.col("node").alias("root"), F.col("root").alias("onward"))
        joined = pointers.join(onward, "root", "left")
        pointers = _shared.materialize(joined.select("node", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), label)
        moved = pointers.where("moved").limit(1).count()
        pointers = pointers.drop("moved")
        if not moved:
            return pointers


def components(pairs: DataFrame) -> DataFrame:
    """Rows (node, root) for each node of the pairs (a, b) but the roots; a root is the smallest node of its component."""
    edges = _shared.materialize(pairs.select("a", "b").distinct(), "edges")
    pointers = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("a").alias("b"), F.col("b").alias("a")))
        least = both.groupBy("a").agg(F.min("b").alias("root")).where("root < a").select(F.col("a").alias("node"), "root")
        stars = _follow(_shared.materialize(least, "pointers"), "pointers")
        pointers = pointers.unionByName(stars)
        for end in ("a", "b"):
            to = stars.select(F.col("node").alias(end), F.col("root").alias("to"))
            edges = edges.join(to, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        edges = _shared.materialize(edges.where("a <> b").distinct(), "edges")
    return _follow(_shared.materialize(pointers, "pointers"), "pointers")


def _rooted(printed: DataFrame, most: int) -> DataFrame:
    """Rows (fp, least, root): distinct fingerprints, their smallest doc_id and the smallest fingerprint that links reach."""
    least = _shared.materialize(printed.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(near_pairs(least, most))
    return least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, most: int = MOST_BITS) -> DataFrame:
    """A row for each document: doc_id, fingerprint, component_id (the smallest doc_id that links reach)."""
    printed = _shared.materialize(fingerprints(docs, id_col, text_col, shingle).drop("row_hash"), "fingerprints")
    rooted = _rooted(printed, most)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # Written first, so that both sides of the last join are plain exchanges, whose large partitions Spark splits.
    classes = _shared.materialize(rooted.join(named, "root").select("fp", "component_id"), "classes")
    return printed.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, most: int = MOST_BITS) -> DataFrame:
    """The documents without near-duplicates: of each component the row of the smallest id stays, null ids last, with all its columns.

    Of rows with that id the one of the smallest hash stays, and of equal rows one.
    """
    packed = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        docs[text_col].alias("text"),
        F.xxhash64(*(_hashable(docs, c) for c in docs.columns)).alias("row_hash"),
        F.struct(*(docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("row"),
    )
    printed = _shared.materialize(fingerprints(packed, "doc_id", "text", shingle, F.col("row_hash")), "fingerprints")
    classes = _shared.materialize(_rooted(printed, most).select("fp", "root"), "classes")
    first = printed.join(classes, "fp").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash")).alias("kept"))
    repeats = printed.groupBy(F.col("doc_id").alias("kept_id"), F.col("row_hash").alias("kept_hash")).agg(F.count("*").alias("n"))
    kept = first.select("kept.doc_id", "kept.row_hash")
    kept = kept.join(repeats, kept["doc_id"].eqNullSafe(repeats["kept_id"]) & (F.col("row_hash") == F.col("kept_hash"))).select("kept_id", "kept_hash", "n")
    kept = _shared.materialize(kept, "kept")
    joined = packed.join(kept, (F.col("row_hash") == F.col("kept_hash")) & F.col("doc_id").eqNullSafe(F.col("kept_id")))
    again = joined.where("n > 1").groupBy("kept_hash", "kept_id").agg(F.first("row").alias("row")).select("row")
    rows = joined.where("n = 1").select("row").unionByName(again)
    return rows.select(*(F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def _hashable(docs: DataFrame, column: str) -> Column:
    """The column itself, or its JSON if there are maps in it, which Spark doesn't hash."""
    return F.to_json(F.struct(docs[column].alias("x"))) if "map<" in dict(docs.dtypes)[column] else docs[column]


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_shared.read_table(spark, sf_dir, "documents"))
