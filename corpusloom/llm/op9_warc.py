"""WARC archives and an index of them by external merge.

Writing: of pages with equal payloads the one with the largest page_id becomes a
response record and the others revisit records that refer to it; each task
writes compressed archives of ``ROLL`` bytes.  Payload digests decide equality,
and what is joined for it is (page_id, digest) alone.

Reading: each archive is read back record by record, digests are checked, and
its captures are sorted by (URL key, timestamp, page_id) into runs, files with
the first key of each block.  Runs are merged by a loser tree: groups of
``FAN_IN`` into longer runs while there are more than that, and at last all of
them.  Every merge goes by ranges of the key of about ``RUN`` captures, which
samples of the runs mark off.  A merged run is a row of pieces, a file for each
range, whose first and last keys the driver keeps.  They are listed in files for
``LISTED`` ranges each, and a range opens only pieces that overlap it.  The
parts in order are the capture histories of all URLs.

Files count once a task has returned their paths, so those of lost or repeated
tasks are never read.

Defined results: a null html is an empty payload; a null url has the key '-'; a
page with a null id is always a response; pages that share the largest id of
equal payloads are all responses; payloads under `least` bytes are all
responses; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate, chain, islice
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared

ROLL, FAN_IN, BLOCK, SAMPLES = 256_000_000, 64, 4096, 64
#: Captures that are sorted in memory; an archive with more of them gives several runs.
RUN = 100_000
#: Ranges of a merge that share a list of pieces.
LISTED = 64
#: The date of captures that carry none.
NO_DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the archive format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = pa.schema(
    [("url_key", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("path", pa.string()), ("offset", pa.int64())]
    + [("length", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)
CAPTURE_DDL = "url_key string, timestamp string, page_id long, path string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str | None) -> str:
    """Host labels from the last to the first, then port, path and query: captures of a site lie together."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url
    labels = host.removeprefix("www.").split(".")
    return ",".join(reversed(labels)) + (f":{port}" if port else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def _header(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, date: str, payload: bytes, refers_to: int | None) -> bytes:
    """One compressed record; a revisit leaves the payload out but states its length."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-Id: {refers_to}"]
    c = zlib.compressobj(4, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + c.flush()


def records(uri: str, chunk: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """Offset, compressed length and bytes of each record of an archive, read in order."""
    store, path = _shared.filesystem(uri)
    with store.open_input_stream(path, compression=None) as f:  # else a name in .gz would be unpacked already
        data, offset = f.read(chunk), 0
        while data:
            d, parts, length = zlib.decompressobj(31), [], 0
            while not d.eof:
                if not data and not (data := f.read(chunk)):
                    raise ValueError(f"{uri} ends within a record")
                parts.append(d.decompress(data))
                length += len(data) - len(d.unused_data)
                data = d.unused_data
            yield offset, length, b"".join(parts)
            offset += length
            data = data or f.read(chunk)


def capture(uri: str, offset: int, length: int, raw: bytes) -> dict:
    """What the index says of a record; its payload is held against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != stated or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"{uri}: the record at {offset} is damaged")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "url_key": url_key(fields.get("WARC-Target-URI")),
        "timestamp": fields["WARC-Date"],
        "page_id": number("X-Page-Id"),
        "path": uri,
        "offset": offset,
        "length": length,
        "payload_bytes": stated,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number("X-Refers-To-Page-Id"),
    }


def mark(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date_col: str | None = None) -> DataFrame:
    """Rows (page_id, url, date, payload, refers_to): which are responses and to which the others refer."""
    date = pages[date_col].cast("string") if date_col else F.lit(None).cast("string")
    rows = pages.select(
        pages[id_col].cast("long").alias("page_id"),
        pages[url_col].cast("string").alias("url"),
        F.coalesce(date, F.lit(NO_DATE)).alias("date"),
        F.coalesce(pages[payload_col].cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    keys = rows.select("page_id", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("size")).where(F.col("page_id").isNotNull() & (F.col("size") >= least))
    shared = keys.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("other")).where("other < refers_to")
    # Written first, so that both sides of the join are plain exchanges, whose large partitions Spark splits.
    shared = _shared.materialize(shared.select("sha", "refers_to"), "shared-payloads")
    revisits = keys.join(shared, "sha").where("page_id < refers_to").select("page_id", "sha", "refers_to").distinct()
    return rows.withColumn("sha", F.sha1("payload")).join(_shared.materialize(revisits, "revisits"), ["page_id", "sha"], "left").select("page_id", "url", "date", "payload", "refers_to")


def write_archives(marked: DataFrame, folder: str, roll: int = ROLL) -> list[tuple[str, int]]:
    """Paths of the archives and how many records each holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, uri, size, n, done = None, "", 0, 0, []
        for b in batches:
            for i in range(b.num_rows):
                row = [b.column(k)[i].as_py() for k in range(5)]
                if out is None:
                    uri, size, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    store, path = _shared.filesystem(uri)
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(path, compression=None)
                data = record(*row)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= roll:
                    out.close()
                    done.append({"path": uri, "records": n})
                    out = None
        if out is not None:
            out.close()
            done.append({"path": uri, "records": n})
        if done:
            yield pa.RecordBatch.from_pylist(done)

    return [(r.path, r.records) for r in marked.mapInArrow(run, "path string, records long").collect()]


def _key(row: dict) -> tuple:
    return row["url_key"], row["timestamp"], -1 if row["page_id"] is None else row["page_id"], row["path"], row["offset"]


class RunWriter:
    """A sorted run: blocks of captures, then the first key of each."""

    def __init__(self, uri: str) -> None:
        self.uri, self.n, self.first, self.last, self.held = uri, 0, [], None, []
        store, path = _shared.filesystem(uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = store.open_output_stream(path)
        self.file = ipc.new_file(self.out, CAPTURE)

    def add(self, row: dict) -> None:
        self.held.append(row)
        self.n += 1
        if len(self.held) == BLOCK:
            self._block()

    def _block(self) -> None:
        self.first.append(_key(self.held[0]))
        self.last = _key(self.held[-1])
        self.file.write_batch(pa.RecordBatch.from_pylist(self.held, CAPTURE))
        self.held = []

    def close(self, samples: int = SAMPLES) -> dict:
        """Path, number, last key and about so many keys from the first on."""
        if self.held:
            self._block()
        self.file.close()
        self.out.close()
        _shared.write_json(f"{self.uri}.keys", self.first)
        step = -(-len(self.first) // samples)
        return {"path": self.uri, "captures": self.n, "sample": json.dumps(self.first[:: max(1, step)]), "last": json.dumps(self.last)}


def read_run(uri: str, low: tuple | None, high: tuple | None) -> Iterator[tuple[tuple, dict]]:
    """Keys and captures of a run from low on and below high."""
    store, path = _shared.filesystem(f"{uri}.keys")
    with store.open_input_stream(path) as f:
        first = [tuple(k) for k in json.loads(f.read())]
    store, path = _shared.filesystem(uri)
    with store.open_input_file(path) as f:
        blocks = ipc.open_file(f)
        for i in range(0 if low is None else max(0, bisect_right(first, low) - 1), len(first)):
            if high is not None and first[i] >= high:
                return
            for row in blocks.get_batch(i).to_pylist():
                key = _key(row)
                if high is not None and key >= high:
                    return
                if low is None or key >= low:
                    yield key, row


class LoserTree:
    """Merges sorted iterators of (key, value): each inner node keeps the loser of its match, and a new key replays one path."""

    def __init__(self, sources: list[Iterator[tuple[tuple, dict]]]) -> None:
        self.sources, self.k = sources, max(1, len(sources))
        self.heads = [next(s, None) for s in sources] or [None]
        self.losers = [0] * self.k
        self.winner = self._build(1)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x[0], a) < (y[0], b)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        a, b = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = b
        return a

    def __iter__(self) -> Iterator[dict]:
        while (head := self.heads[self.winner]) is not None:
            yield head[1]
            w = self.winner
            self.heads[w] = next(self.sources[w], None)
            node = (w + self.k) // 2
            while node:
                if self._beats(self.losers[node], w):
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.winner = w


def _per_row(spark: SparkSession, rows: list[tuple], schema: str, work: Callable[[dict], Iterator[pa.RecordBatch]], out: str) -> DataFrame:
    """Run work on each of a few driver-made rows, in a task of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                yield from work(row)

    return _shared.spread(spark.createDataFrame(rows, schema), len(rows)).mapInArrow(run, out)


_RUN = "place long, path string, captures long, sample string, last string"


@dataclass
class Piece:
    """A file of sorted captures: the first and the last key in it."""

    path: str
    first: tuple
    last: tuple


@dataclass
class Run:
    """Sorted captures in pieces that follow one another, and some of their keys."""

    pieces: list[Piece]
    captures: int
    sample: list[tuple]

    def add(self, path: str, captures: int, sample: str, last: str) -> None:
        """Append a file; one without captures holds nothing to merge."""
        if captures:
            keys = [tuple(k) for k in json.loads(sample)]
            self.pieces.append(Piece(path, keys[0], tuple(json.loads(last))))
            self.captures += captures
            self.sample += keys

    def within(self, low: tuple | None, high: tuple | None) -> list[Piece]:
        """The pieces with keys from low on and below high."""
        start = 0 if low is None else bisect_left(self.pieces, low, key=lambda p: p.last)
        stop = len(self.pieces) if high is None else bisect_left(self.pieces, high, key=lambda p: p.first)
        return self.pieces[start:stop]


def index_runs(spark: SparkSession, archives: list[str], folder: str) -> list[Run]:
    """Read archives back; sorted runs of captures for each."""

    def work(row: dict) -> Iterator[pa.RecordBatch]:
        found = (capture(row["archive"], *r) for r in records(row["archive"]))
        while some := sorted(islice(found, RUN), key=_key):
            writer = RunWriter(f"{folder}/run-{uuid.uuid4().hex}.arrow")
            for x in some:
                writer.add(x)
            yield pa.RecordBatch.from_pylist([{"place": 0, **writer.close()}])

    runs = []
    for r in _per_row(spark, [(a,) for a in archives], "archive string", work, _RUN).collect():
        runs.append(Run([], 0, []))
        runs[-1].add(r.path, r.captures, r.sample, r.last)
    return runs


def key_ranges(runs: list[Run], parts: int) -> list[tuple[tuple | None, tuple | None]]:
    """Ranges of the key that hold about as many captures each, by the samples of runs: each key stands for its share of its run."""
    sample = sorted((k, r.captures / len(r.sample)) for r in runs for k in r.sample)
    before = list(accumulate((w for _, w in sample), initial=0.0))
    bounds = sorted({sample[min(len(sample) - 1, bisect_left(before, before[-1] * i / parts))][0] for i in range(1, parts)}) if sample else []
    return list(zip([None, *bounds], [*bounds, None], strict=True))


def merge_rows(group: int, runs: list[Run], parts: int, folder: str) -> list[tuple[int, int, str, str]]:
    """A row (group, range, bounds, list) for each range; the list is a file that names the pieces of LISTED ranges by run."""
    ranges, rows = key_ranges(runs, parts), []
    for i in range(0, len(ranges), LISTED):
        some = ranges[i : i + LISTED]
        uri = f"{folder}/pieces-{uuid.uuid4().hex}.json"
        overlap = [[(p.path, p.first, p.last) for p in r.within(some[0][0], some[-1][1])] for r in runs]
        _shared.write_json(uri, [x for x in overlap if x])
        rows += [(group, i + j, json.dumps(bounds), uri) for j, bounds in enumerate(some)]
    return rows


def merged(bounds: str, uri: str) -> Iterator[dict]:
    """Captures of a range of the key, merged by a loser tree from the listed pieces that overlap it."""
    low, high = (None if x is None else tuple(x) for x in json.loads(bounds))
    store, path = _shared.filesystem(uri)
    with store.open_input_stream(path) as f:
        listed = json.loads(f.read())
    runs = [Run([Piece(p, tuple(a), tuple(b)) for p, a, b in each], 0, []).within(low, high) for each in listed]
    return iter(LoserTree([chain.from_iterable(read_run(p.path, low, high) for p in pieces) for pieces in runs if pieces]))


def _ranges_of(runs: list[Run]) -> int:
    return max(1, -(-sum(r.captures for r in runs) // RUN))


_RANGE = "group long, range long, bounds string, list string"


def merge_level(spark: SparkSession, runs: list[Run], folder: str) -> list[Run]:
    """Merge each FAN_IN runs to one; no task merges more than a range."""
    groups = [runs[i : i + FAN_IN] for i in range(0, len(runs), FAN_IN)]
    rows = [row for g, group in enumerate(groups) for row in merge_rows(g, group, _ranges_of(group), folder)]

    def work(row: dict) -> Iterator[pa.RecordBatch]:
        writer = RunWriter(f"{folder}/run-{uuid.uuid4().hex}.arrow")
        for x in merged(row["bounds"], row["list"]):
            writer.add(x)
        # A key or a few of each piece: about SAMPLES of a run of few pieces, and the first of each of many.
        yield pa.RecordBatch.from_pylist([{"place": row["group"] << 32 | row["range"], **writer.close(max(1, SAMPLES // FAN_IN))}])

    out = [Run([], 0, []) for _ in groups]
    for r in sorted(_per_row(spark, rows, _RANGE, work, _RUN).collect()):
        out[r.place >> 32].add(r.path, r.captures, r.sample, r.last)
    return out


def merge_runs(spark: SparkSession, runs: list[Run], folder: str, parts: int) -> DataFrame:
    """All captures in the order of their keys, as rows (part, place, capture); parts, so many at least, follow one another."""
    while len(runs) > FAN_IN:
        runs = merge_level(spark, runs, folder)
    rows = merge_rows(0, runs, max(parts, _ranges_of(runs)), folder)

    def last(row: dict) -> Iterator[pa.RecordBatch]:
        held, place = [], 0
        for x in merged(row["bounds"], row["list"]):
            held.append(x | {"part": row["range"], "place": place})
            place += 1
            if len(held) == BLOCK:
                yield pa.RecordBatch.from_pylist(held, _PLACED)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, _PLACED)

    return _per_row(spark, rows, _RANGE, last, f"part long, place long, {CAPTURE_DDL}")


_PLACED = pa.schema([("part", pa.int64()), ("place", pa.int64()), *CAPTURE])


def archive(pages: DataFrame, folder: str | None = None, least: int = 0, **columns: str) -> DataFrame:
    """Write archives, read them back and index them; rows of the index in its order, a row for each page."""
    spark = pages.sparkSession
    folder = folder or _shared.work_dir(spark, "archives")
    archives = write_archives(mark(pages, least, **columns), folder)
    if not archives:
        return spark.createDataFrame([], f"part long, place long, {CAPTURE_DDL}")
    runs = index_runs(spark, [a for a, _ in archives], folder)
    if sum(r.captures for r in runs) != sum(n for _, n in archives):
        raise ValueError("the index doesn't hold all records")
    return merge_runs(spark, runs, folder, _shared.shuffle_partitions(spark))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archive(_shared.read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Five bits of the digest give a letter; 20 bits are five digits in hexadecimal.
_BASE_32 = """array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1)), '')"""
SQL = f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS most FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE_32} AS payload_digest, CASE WHEN page_id < most THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < most THEN most END AS refers_to FROM m"""
