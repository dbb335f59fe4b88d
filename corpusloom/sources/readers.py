"""Scans of corpora, benchmarks, manifests and run folders."""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator, Mapping
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.text import nonblank, source_slug, strip

#: Fixed values.
DELIMITER = "<|endoftext|>"
LINE_SUFFIXES, JSON_LINE_SUFFIXES = (".txt", ".text", ".md", ".markdown"), (".jsonl", ".ndjson")
ROW_BITS = 40
#: Files whose numbers are broadcast, a few hundred bytes each.
MOST_LISTED = 100_000


def _paths(paths: list[str] | str) -> list[str]:
    found = sorted({paths} if isinstance(paths, str) else set(paths))
    if not found:
        raise FileNotFoundError("no files to read")
    return found


def _plain(path: Column) -> Column:
    """A file's URI with one slash after its scheme, however Spark spells it."""
    return F.regexp_replace(path, "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")


def file_numbers(df: DataFrame, listed: list[str] | None = None) -> DataFrame:
    """Rows (file_, file_no): the files that Spark lists for a scan, or those of several scans, in the order of their whole paths.

    The driver holds a path for each file, as Spark itself does for any scan.
    """
    spark = df.sparkSession
    rows = [(p, i) for i, p in enumerate(sorted(set(df.inputFiles() if listed is None else listed)))]
    return spark.createDataFrame(rows, "path string, file_no long").select(_plain(F.col("path")).alias("file_"), "file_no")


def _joined(df: DataFrame, listed: list[str] | None = None) -> DataFrame:
    """Adds file_no to rows with file_; the list is broadcast up to MOST_LISTED files and joined by a shuffle beyond."""
    numbers = file_numbers(df, listed)
    few = len(df.inputFiles() if listed is None else listed) <= MOST_LISTED
    return df.join(F.broadcast(numbers) if few else numbers, "file_")


def with_row_id(df: DataFrame, listed: list[str] | None = None) -> DataFrame:
    """Adds row_id to a scan of Parquet: the number of its file in the order of whole paths, then the place of the row in it."""
    rows = df.select("*", _plain(F.col("_metadata.file_path")).alias("file_"), F.col("_metadata.row_index").alias("at_"))
    return _joined(rows, listed or df.inputFiles()).withColumn("row_id", F.col("file_no") * (1 << ROW_BITS) + F.col("at_")).select(*df.columns, "row_id")


def with_line_id(df: DataFrame, listed: list[str] | None = None) -> DataFrame:
    """Adds row_id to a scan of one text column, in the order of files and then of lines.

    A line takes a byte at least, so the first byte of its block plus the lines
    before it in the block is less than the first byte of the next block.
    """
    place = [F.col("_metadata.file_path").alias("file_"), F.col("_metadata.file_block_start").alias("block_")]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n = None, 0
        for b in batches:
            at = []
            for key in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                now, n = (now, n + 1) if key == now else (key, 0)
                at.append(key[1] + n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.int64())], ["value", "file_", "at_"])

    counted = df.select("value", *place).mapInArrow(number, "value string, file_ string, at_ long").withColumn("file_", _plain(F.col("file_")))
    return _joined(counted, listed or df.inputFiles()).select("value", (F.col("file_no") * (1 << ROW_BITS) + F.col("at_")).alias("row_id"))


def parquet(spark: SparkSession, paths: list[str] | str, listed: list[str] | None = None) -> DataFrame:
    """Parquet files; row_id is the place of a row over all files in path order."""
    return with_row_id(spark.read.parquet(*_paths(paths)), listed)


def json_rows(spark: SparkSession, paths: list[str] | str, listed: list[str] | None = None) -> DataFrame:
    """JSON lines, compressed or not, with row_id; a line that is no object is an error."""
    found = _paths(paths)
    schema = spark.read.option("mode", "FAILFAST").json(found).schema
    rows = with_line_id(spark.read.text(found), listed).where(strip(F.col("value")) != "")
    return rows.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), "row_id").select("r.*", "row_id")


def delimited(spark: SparkSession, paths: list[str] | str, delimiter: str = DELIMITER, listed: list[str] | None = None) -> DataFrame:
    """Documents that a delimiter ends, stripped, without empty ones, with row_id; every delimiter counts, also several on a line."""
    rows = with_line_id(spark.read.option("lineSep", delimiter).text(_paths(paths)), listed)
    return rows.select(nonblank(F.col("value")).alias("text"), "row_id").where("text IS NOT NULL")


def lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """A document for each line that isn't blank."""
    return spark.read.text(_paths(paths)).select(nonblank(F.col("value")).alias("text")).where("text IS NOT NULL")


def _checked(v: Column, field: str) -> Column:
    """The text of a JSON object's field or of a bare string; null stays null, anything else is an error."""
    kind = F.schema_of_variant(v)
    inner = F.when(kind.startswith("OBJECT"), F.try_variant_get(v, f"$['{field}']", "variant")).otherwise(v)
    found = F.schema_of_variant(inner)
    text = F.variant_get(inner, "$", "string")
    bad = F.raise_error(F.lit(f"a document's {field!r} must be text that isn't blank"))
    return F.when(inner.isNull() | (found == "VOID"), F.lit(None).cast("string")).when((found == "STRING") & (strip(text) != ""), strip(text)).otherwise(bad)


def json_lines(spark: SparkSession, paths: list[str] | str, field: str = "text") -> DataFrame:
    """Documents of JSON lines, each an object with the field or a bare string."""
    rows = spark.read.text(_paths(paths)).where(strip(F.col("value")) != "")
    return rows.select(_checked(F.parse_json("value"), field).alias("text")).where("text IS NOT NULL")


def json_documents(spark: SparkSession, paths: list[str] | str, field: str = "text") -> DataFrame:
    """Documents of whole JSON files: a string, an object with the field, or an array of these."""
    v = F.parse_json("value")
    rows = spark.read.option("wholetext", True).text(_paths(paths)).select(v.alias("v"))
    many = F.schema_of_variant("v").startswith("ARRAY")
    items = F.when(many, F.variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
    one = rows.select(F.explode(items).alias("v"))
    inner = F.when(F.schema_of_variant("v").startswith("OBJECT"), F.try_variant_get("v", f"$['{field}']", "string")).otherwise(F.try_variant_get("v", "$", "string"))
    return one.select(nonblank(inner).alias("text")).where("text IS NOT NULL")


def local(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Rows of local files by their suffix, with a row_id over all of them; Parquet alone, or JSON lines and text mixed."""
    found = _paths(paths)
    kinds = {p: "parquet" if p.endswith(".parquet") else "json" if p.endswith((".json.gz", *JSON_LINE_SUFFIXES)) else "text" if p.endswith(LINE_SUFFIXES) else "" for p in found}
    if "" in kinds.values() or "parquet" in kinds.values() and len(set(kinds.values())) > 1:
        raise ValueError(f"unsupported files: {[p for p, k in kinds.items() if k in ('', 'parquet')][:5]}")
    readers = {"parquet": parquet, "json": json_rows, "text": lambda s, p, listed: delimited(s, p, listed=listed)}
    listed = spark.read.format("binaryFile").load(found).inputFiles()
    parts = [readers[k](spark, [p for p in found if kinds[p] == k], listed=listed) for k in sorted(set(kinds.values()))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def directory(spark: SparkSession, path: str, field: str = "text") -> DataFrame:
    """Documents of all text, JSON-line and JSON files under a folder."""
    kinds = {LINE_SUFFIXES: lines, JSON_LINE_SUFFIXES: lambda s, p: json_lines(s, p, field), (".json",): lambda s, p: json_documents(s, p, field)}
    listed = sorted(map(unquote, spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).inputFiles()))
    mine = {endings: [p for p in listed if p.endswith(endings)] for endings in kinds}
    odd = [p for p in listed if not p.endswith(tuple(e for endings in kinds for e in endings))]
    if odd or not listed:
        raise ValueError(f"unsupported or no files: {odd[:5]}")
    return reduce(DataFrame.unionByName, [kinds[k](spark, p) for k, p in mine.items() if p])


def source_folder(spark: SparkSession, root: str, name: str, subdir: str | None = None, pattern: str = "*.parquet") -> DataFrame:
    """The files of one source under a root that a pattern of their names picks, by `local`; an error if there are none."""
    folder = subdir or source_slug(name)
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(f"{root}/{folder}").inputFiles()
        files = list(map(unquote, files))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        files = []
    if not files:
        raise FileNotFoundError(f"no files of {name!r} match {root}/{folder}/{pattern}")
    return local(spark, files)


def benchmark_rows(spark: SparkSession, sets: Mapping[str, tuple[list[str], list[str]]]) -> DataFrame:
    """Rows (benchmark, text) of benchmark sets: for each name the files of its configurations and splits, and the fields to join.

    Benchmarks are numbered in the order of the mapping; empty fields are left out.
    """
    out = []
    for i, (paths, fields) in enumerate(sets.values()):
        rows = local(spark, paths)
        text = F.concat_ws(" ", *(F.nullif(rows[f].cast("string"), F.lit("")) for f in fields))
        out.append(rows.select(F.lit(i).alias("benchmark"), text.alias("text")))
    return reduce(DataFrame.unionByName, out)


MANIFEST_ENTRY = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("token_count", T.LongType())]))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def manifest_entries(m: DataFrame) -> DataFrame:
    """Rows (split, entry_no, path, token_count) of a manifest, in its order."""
    each = []
    for split in ("train", "val"):
        if f"{split}_shards" in m.columns:
            entries = F.from_json(F.to_json(f"{split}_shards"), MANIFEST_ENTRY)
            each.append(m.select(F.lit(split).alias("split"), F.posexplode(entries).alias("entry_no", "e")))
    if not each:
        raise ValueError("the manifest lists no shards")
    rows = each[0] if len(each) == 1 else each[0].unionByName(each[1])
    return rows.select("split", "entry_no", "e.path", "e.token_count")


def source_entries(entries: DataFrame, source: str, split: str) -> DataFrame:
    """The entries of one source, by the prefix of their path; an error if there are none."""
    prefix = F.lit(f"sources/{source_slug(source)}/{split}/")
    found = entries.where((F.col("split") == split) & F.replace("path", F.lit("\\"), F.lit("/")).startswith(prefix))
    if found.isEmpty():
        raise ValueError(f"the manifest has no {split} shards of {source!r}")
    return found


def resolved(entries: DataFrame, manifest_path: str, disk: DataFrame | None = None) -> DataFrame:
    """Entries with `uri`: an absolute path as it stands, another under the manifest's folder.

    With the paths of files on disk (uri), an entry that isn't there is looked for
    by its name in the folder `val` beside the manifest.
    """
    folder = manifest_path.rpartition("/")[0] or "."
    path = F.replace("path", F.lit("\\"), F.lit("/"))
    absolute = F.rlike(path, F.lit("^(/|[A-Za-z]:/|[A-Za-z][A-Za-z0-9+.-]+://?)"))
    out = entries.withColumn("uri", F.when(absolute, path).otherwise(F.concat(F.lit(f"{folder}/"), path)))
    if disk is None:
        return out
    there = disk.select(F.col("uri").alias("there_")).distinct()
    aside = F.concat(F.lit(f"{folder}/val/"), F.element_at(F.split("path", r"[/\\]"), -1))
    known = out.join(there, out["uri"] == there["there_"], "left")
    return known.withColumn("uri", F.when(F.col("there_").isNull(), aside).otherwise(F.col("uri"))).drop("there_")


def metrics(spark: SparkSession, path: str, schema: str, keep: int = 50_000) -> DataFrame:
    """Records of metrics files, the last ones of each; broken lines are skipped."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block_"))
    # Within a block rows come in order, so the running id orders them; blocks of a file may go to any task.
    rows = rows.withColumn("line_", F.monotonically_increasing_id())
    parsed = rows.select("path", "block_", "line_", F.from_json("value", schema).alias("r")).where("r IS NOT NULL AND NOT (to_json(r) = '{}')")
    w = Window.partitionBy("path").orderBy(F.desc("block_"), F.desc("line_"))
    return parsed.withColumn("from_end", F.row_number().over(w)).where(F.col("from_end") <= keep).select("path", "from_end", "r.*")


def run_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One JSON file of each run folder, with run_id."""
    return spark.read.option("multiLine", True).option("mode", "PERMISSIVE").json(f"{root}/*/{name}").withColumn("run_id", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def synthetic(places: DataFrame, vocabulary: int, seed: Column) -> DataFrame:
    """Tokens of repeatable streams at any places (a column `pos`); streams of equal seeds are the same."""
    token = F.pmod(F.col("pos") * F.lit(1103515245) + seed, F.lit(vocabulary))  # fixed multiplier
    return places.withColumn("token", token.cast("int"))


class _Rows(InputPartition):
    def __init__(self, start: int, end: int | None) -> None:
        self.start, self.end = start, end


class RemoteRows(DataSource):
    """A stream of rows from a remote set, resumed at a row number after a failure.

    Options: module (of a function open_rows(dataset, config, split, start) that
    yields mappings), dataset, config, split, start, retries, backoff.  Where `rows`
    says how many there are, `partitions` ranges are read at once.  Errors of
    access are not tried again; waits double up to a minute.

    As a stream it reads on as the set grows: the module's count_rows(dataset, config,
    split) says how many rows there are by now, and the query commits the row it has
    reached, so one that breaks off goes on there.
    """

    DENIED = ("401", "403", "gated", "authentication", "not authorized", "unauthorized", "forbidden")

    @classmethod
    def name(cls) -> str:
        return "remote_rows"

    def schema(self) -> str:
        return "row_no long, row string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _RemoteReader(self.options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _RemoteStream(self.options)


class _RemoteReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        start, rows = int(self.options.get("start", "0")), self.options.get("rows")
        if rows is None:
            return [_Rows(start, None)]
        n = max(1, min(int(self.options.get("partitions", "1")), int(rows) - start))
        bounds = [start + max(0, int(rows) - start) * i // n for i in range(n + 1)]
        return [_Rows(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def read(self, partition: _Rows) -> Iterator[tuple[int, str]]:
        return _remote_rows(self.options, partition)


class _RemoteStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)

    def initialOffset(self) -> dict:
        return {"row": int(self.options.get("start", "0"))}

    def latestOffset(self) -> dict:
        o = self.options
        return {"row": int(importlib.import_module(o["module"]).count_rows(o["dataset"], o.get("config"), o.get("split", "train")))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b = start["row"], end["row"]
        if b < a:
            raise ValueError(f"the remote set has {b} rows, fewer than the {a} that were read")
        n = max(1, min(int(self.options.get("partitions", "1")), b - a))
        bounds = [a + (b - a) * i // n for i in range(n + 1)]
        return [_Rows(x, y) for x, y in zip(bounds[:-1], bounds[1:], strict=True) if x < y]

    def read(self, partition: _Rows) -> Iterator[tuple[int, str]]:
        at = partition.start
        for at, row in _remote_rows(self.options, partition):
            yield at, row
        if at != partition.end:  # the batch would be committed without its last rows
            raise OSError(f"the remote set ended at row {at}, before {partition.end}")


def _remote_rows(o: dict[str, str], partition: _Rows) -> Iterator[tuple[int, str]]:
    """Rows of a range, numbered from 1; after a failure the set is opened again at the row that is wanted next."""
    open_rows = importlib.import_module(o["module"]).open_rows
    at, failures = partition.start, 0
    while at != partition.end:
        try:
            for row in open_rows(o["dataset"], o.get("config"), o.get("split", "train"), at):
                if not isinstance(row, Mapping):
                    raise TypeError("a row must be a mapping")
                at, failures = at + 1, 0
                yield at, json.dumps(row)
                if at == partition.end:
                    return
            return
        except TypeError:
            raise
        except Exception as e:
            failures += 1
            if failures > int(o.get("retries", "5")) or any(d in str(e).lower() for d in RemoteRows.DENIED):
                raise
            time.sleep(min(60.0, float(o.get("backoff", "5")) * 2 ** (failures - 1)))


def remote_stream(spark: SparkSession, module: str, dataset: str, **options: str) -> DataFrame:
    """The rows of a remote set (row_no, row as JSON) as a stream that goes on as the set grows."""
    spark.dataSource.register(RemoteRows)
    return spark.readStream.format("remote_rows").options(module=module, dataset=dataset, **options).load()


def remote_documents(spark: SparkSession, module: str, dataset: str, text_field: str = "text", max_documents: int | None = None, **options: str) -> DataFrame:
    """Texts of a remote set that aren't blank, in its order, with row_no; up to so many documents."""
    spark.dataSource.register(RemoteRows)
    rows = spark.read.format("remote_rows").options(module=module, dataset=dataset, **options).load()
    texts = rows.select("row_no", nonblank(F.get_json_object("row", f"$['{text_field}']")).alias("text")).where("text IS NOT NULL")
    return texts if max_documents is None else texts.orderBy("row_no").limit(max_documents)
