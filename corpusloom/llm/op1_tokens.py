"""Token-id files: canonical length-limited Huffman codes from global counts.

Encoding takes one pass with a subword tokenizer.  The counts of all ids (one
row per id of the vocabulary) give code lengths by package-merge, limited to
``MAX_BITS``; codes are canonical, so the codebook is the list of lengths.
Documents are range-partitioned by id, and each partition becomes one file:

    magic | blocks | footer | footer length (8 bytes, little-endian) | magic

A block holds ``BLOCK`` ids of one bit stream, and documents may straddle
blocks.  The footer lists the documents (id, ids), the blocks (byte offset,
bytes, ids) and, for every ``STEP`` ids, the bit offset in its block.  A reader
can start at any of these checkpoints; `decode_blocks` decodes all of them in
lockstep by table.  A file counts once its path stands in the manifest, so files
of lost or repeated tasks are never read.

Defined results: a null text is an empty one; a null doc_id sorts first; rows of
the same doc_id come in the order of a hash of their ids; an empty table gives
no files and no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared, _words

MAGIC = b"LHUF0001"
MAX_BITS, BLOCK, STEP = 20, 65_536, 512
#: Blocks that are decoded at once.
LANES = 32
#: Bytes of text that are looked at together, and bytes of the longest word whose ids a worker remembers.
STRETCH, LONGEST = _words.STRETCH, 64
#: Pieces of words, and other words, whose ids a worker remembers.
REMEMBERED_PIECES, REMEMBERED_WORDS = 800_000, 100_000
#: What a tokenizer file must say for its words to be cut into letters and the marks after them.
_CUTS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pattern": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
}


def _lower_cases() -> tuple[np.ndarray, np.ndarray]:
    """The lower case of each byte of ASCII and, by code point below 0x250, of the composed letters, else 0."""
    lower, wide = np.arange(256, dtype=np.uint8), np.zeros(0x250, np.uint16)
    lower[65:91] += 32
    for c in range(0xC0, 0x250):
        low = chr(c).lower()
        if chr(c).isalpha() and len(low) == 1 and 0xC0 <= ord(low) < 0x250:
            wide[c] = ord(low)
    return lower, wide


_LOWER, _WIDE = _lower_cases()


class WordEncoder:
    """Ids of whole texts by a tokenizer that lower-cases, drops white space and never joins across it.

    Such a tokenizer gives a text the ids of its words one after another.  Words
    are told apart by numpy over the bytes of many texts at once.  A word of
    letters with marks at its end is two pieces, as the tokenizer's own pattern
    cuts there; pieces need no normalizing, many words share them, and each
    distinct one is encoded once.  All other words go through the tokenizer as
    they stand, special tokens in them included.  Should a file have other rules
    than `_CUTS`, every text goes through its tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, "rb") as f:
            said = json.load(f)
        self.size = self.tokenizer.get_vocab_size()
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        self.words = self._cuts(said)
        if self.words:
            self.pieces = Tokenizer(self.tokenizer.model)
            self.pieces.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.last = np.zeros(self.size, bool)
            self.last[[i for t, i in said["model"]["vocab"].items() if t.endswith(said["model"]["end_of_word_suffix"])]] = True
            self.known, self.others = _words.Pool(self.kind, REMEMBERED_PIECES), _words.Pool(self.kind, REMEMBERED_WORDS)

    @staticmethod
    def _cuts(said: dict) -> bool:
        steps = (said.get("pre_tokenizer") or {}).get("pretokenizers", [])
        model = said["model"]
        return (
            said.get("normalizer") == _CUTS["normalizer"]
            and said.get("post_processor") is None
            and [s["type"] for s in steps] == ["Split", "ByteLevel"]
            and (steps[0]["pattern"], steps[0]["behavior"], steps[0]["invert"]) == ({"Regex": _CUTS["pattern"]}, "Removed", True)
            and not steps[1]["add_prefix_space"]
            and not steps[1]["use_regex"]
            and (model["type"], bool(model["end_of_word_suffix"]), model["dropout"]) == ("BPE", True, None)
            and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or re.fullmatch(r"\w*[!-/:-@\[-`{-~]*", t["content"]) for t in said["added_tokens"])
        )

    def _learn_pieces(self, new: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces are encoded many at once; each ends with the only id that closes a word."""
        each = 4000
        lists = pa.ListArray.from_arrays(pa.array([*range(0, len(new), each), len(new)], pa.int32()), new.cast(pa.string()))
        joined = pc.binary_join(lists, " ").to_pylist()
        ids = np.concatenate([np.asarray(self.pieces.encode_batch_fast([t])[0].ids, self.kind) for t in joined])
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(new) or ends[-1] != len(ids):
            raise ValueError("a piece doesn't end with an id that closes a word")
        return ids, np.diff(ends, prepend=0)

    def _learn_words(self, new: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(new.cast(pa.string()).to_pylist(), add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), self.kind, int(lengths.sum())), lengths

    def _stretch(self, x: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts that begin at these bytes, one after another, and how many each has."""
        classes, lead, point = _words.classes_of(x, _WIDE)
        low = _LOWER[x]
        low[lead], low[lead + 1] = 0xC0 | point >> 6, 0x80 | point & 0x3F
        at, kind, first, runs, word = _words.runs_of(classes, begins)
        if not len(first):
            return np.empty(0, self.kind), np.zeros(len(begins), np.int64)
        solid, plain = kind != _words.SPACE, _words.plain_words(kind, first, runs)
        bounds = np.append(at, len(x))
        whole = _words.strings(low, bounds)
        of_plain = np.zeros(len(at), bool)
        of_plain[solid] = plain[word[solid]]
        coded = whole.filter(pa.array(of_plain)).dictionary_encode()
        place = self.known.places(coded.dictionary, self._learn_pieces)
        taken = np.flatnonzero(of_plain)
        place = place[np.asarray(coded.indices)]
        where, start, length = taken, self.known.starts[place], self.known.lengths[place]
        pool = self.known.ids
        if not plain.all():
            odd = np.flatnonzero(~plain)
            left, right = bounds[first[odd]], bounds[first[odd] + runs[odd]]
            between = np.stack([left, right], 1).reshape(-1)
            words = _words.strings(x, between).take(pa.array(np.arange(0, len(between) - 1, 2)))
            o_start, o_length, o_pool = self._other_words(words, right - left)
            where = np.concatenate([where, first[odd]])
            start, length = np.concatenate([start, len(pool) + o_start]), np.concatenate([length, o_length])
            pool = np.concatenate([pool, o_pool])
            order = np.argsort(where, kind="stable")
            where, start, length = where[order], start[order], length[order]
        return pool[_words.ragged(start, length)], _words.per_text(length, at[where], begins)

    def _other_words(self, words: pa.BinaryArray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place and number of ids of each word, and the ids; very long words aren't remembered."""
        short, start, length = sizes <= LONGEST, np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        coded = words.filter(pa.array(short)).dictionary_encode()
        place = self.others.places(coded.dictionary, self._learn_words)
        place = place[np.asarray(coded.indices)]
        start[short], length[short] = self.others.starts[place], self.others.lengths[place]
        ids, n = self._learn_words(words.filter(pa.array(~short)))
        start[~short], length[~short] = len(self.others.ids) + np.cumsum(n) - n, n
        return start, length, np.concatenate([self.others.ids, ids])

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each text has; a null text is empty."""
        if not self.words:
            return self._learn_words(texts.fill_null("").cast(pa.binary()))
        x, offsets = _words.bytes_of(texts)
        counts, parts = np.zeros(len(texts), np.int64), [np.empty(0, self.kind)]
        for part, mine, begins in _words.stretches(x, offsets, STRETCH):
            ids, n = self._stretch(part, begins)
            parts.append(ids)
            counts[mine] += n
        return np.concatenate(parts), counts


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """One per worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> pa.BinaryArray:
    """Ids of each text as bytes, with end_id after them."""
    ends = np.cumsum(counts + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, end_id, ids.dtype)
    inside = np.ones(len(out), bool)
    inside[ends - 1] = False
    out[inside] = ids
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(np.concatenate([[0], ends * out.itemsize]).astype(np.int32)), pa.py_buffer(out)])


def encode_table(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, ids): ids with end_id appended, little-endian, of the width of the tokenizer's kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _shared.slices(whole, rows=whole.num_rows):
                yield pa.RecordBatch.from_arrays([b.column(0), with_end(*word_encoder(tokenizer).encode(b.column(1)), end_id)], ["doc_id", "ids"])

    return _shared.texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def count_ids(encoded: DataFrame, size: int, kind: str) -> np.ndarray:
    """How often each id below size occurs; what reaches the driver is one row per id at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), kind), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for row in encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row.id] = row.n
    return counts


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most limit bits (package-merge); 0 where the count is 0."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    coins = counts[order]
    row, leaf, levels = coins, np.ones(len(coins), bool), []
    for _ in range(limit):
        levels.append(leaf)
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([coins, pairs])
        by = np.argsort(both, kind="stable")
        row, leaf = both[by], by < len(coins)
    take = 2 * len(coins) - 2
    for leaf in reversed(levels):
        taken = int(leaf[:take].sum())
        lengths[order[:taken]] += 1
        take = 2 * (take - taken)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.flatnonzero(lengths)
    order = order[np.lexsort((order, lengths[order]))]
    code, last = 0, 0
    for i in order.tolist():
        n = int(lengths[i])
        code = code + 1 << n - last if last else 0
        codes[i], last = code, n
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each value of the next bits: the id and the bits it takes; and how many bits to look at."""
    bits = max(1, int(lengths.max(initial=1)))
    ids, taken = np.zeros(1 << bits, np.uint32), np.ones(1 << bits, np.uint8)
    codes = canonical_codes(lengths)
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    if len(used):
        n = lengths[used].astype(np.int64)
        each = 1 << (bits - n)
        if int(codes[used[0]]) != 0 or int(each.sum()) > 1 << bits:
            raise ValueError("these lengths aren't those of a prefix code")
        ids[: each.sum()], taken[: each.sum()] = np.repeat(used, each), np.repeat(n, each)
    return ids, taken, bits


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bits of the ids, high bit first, and the bit offset of every STEP-th id."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    word, value = starts >> 5, codes[ids] << (64 - (starts & 31) - n).astype(np.uint64)
    size = int(ends[-1] if len(ends) else 0) + 31 >> 5
    high = np.bincount(word, weights=(value >> np.uint64(32)).astype(np.float64), minlength=size + 1)
    low = np.bincount(word + 1, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=size + 2)
    words = high[:size] + low[:size]  # bits don't overlap, so the sums are exact
    return words.astype(np.uint64).astype(">u4").tobytes(), starts[::STEP].astype(np.uint32)


def decode_blocks(data: bytes, bit_starts: np.ndarray, counts: np.ndarray, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """Ids of all segments, the i-th from bit bit_starts[i] with counts[i] ids, decoded in lockstep."""
    ids, taken, bits = table
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(8, np.uint8)]).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    at, steps = bit_starts.astype(np.int64), int(counts.max(initial=0))
    out = np.empty((steps, len(at)), np.uint32)
    mask, last = (1 << bits) - 1, len(window) - 1
    for k in range(steps):
        v = window[np.minimum(at >> 3, last)] >> (32 - bits - (at & 7)).astype(np.uint32) & np.uint32(mask)
        out[k] = ids[v]
        at += taken[v]
    if steps and (counts == steps).all():
        return out.T.reshape(-1)
    return out.T[np.arange(steps)[None, :] < counts[:, None]]


class FileWriter:
    """Writes one file; ids are buffered up to a block."""

    def __init__(self, uri: str, codes: np.ndarray, lengths: np.ndarray) -> None:
        self.uri, self.codes, self.lengths = uri, codes, lengths
        store, path = _shared.filesystem(uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = store.open_output_stream(path)
        self.out.write(MAGIC)
        self.offset, self.parts, self.held = len(MAGIC), [], 0
        self.doc_ids: list[int | None] = []
        self.doc_sizes: list[int] = []
        self.blocks: list[tuple[int, int, int]] = []
        self.checkpoints: list[np.ndarray] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.doc_sizes.append(len(ids))
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            ids = np.concatenate(self.parts)
            whole = len(ids) // BLOCK * BLOCK
            for at in range(0, whole, BLOCK):
                self._block(ids[at : at + BLOCK])
            self.parts, self.held = [ids[whole:]], len(ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        data, checkpoints = pack(ids, self.codes, self.lengths)
        self.out.write(data)
        self.blocks.append((self.offset, len(data), len(ids)))
        self.checkpoints.append(checkpoints)
        self.offset += len(data)

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.parts))
        known = np.asarray([x is not None for x in self.doc_ids], np.uint8)
        arrays = [
            np.asarray([x or 0 for x in self.doc_ids], "<i8"),
            known,
            np.asarray(self.doc_sizes, "<i8"),
            np.asarray(self.blocks, "<i8").reshape(-1),
            np.concatenate([np.empty(0, np.uint32), *self.checkpoints]).astype("<u4"),
        ]
        footer = struct.pack("<5q", *map(len, arrays)) + b"".join(x.tobytes() for x in arrays)
        self.out.write(footer + struct.pack("<q", len(footer)) + MAGIC)
        self.out.close()


class FileReader:
    """Reads one file; any run of blocks can be decoded by itself."""

    def __init__(self, uri: str, lengths: np.ndarray) -> None:
        store, path = _shared.filesystem(uri)
        self.file, self.table = store.open_input_file(path), decode_table(lengths)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} isn't whole")
        n = struct.unpack("<q", tail[:8])[0]
        footer, arrays, at = self.file.read_at(n, size - 16 - n), [], 40
        for kind, k in zip(("<i8", "u1", "<i8", "<i8", "<u4"), struct.unpack("<5q", footer[:40]), strict=True):
            arrays.append(np.frombuffer(footer, kind, k, at))
            at += arrays[-1].nbytes
        self.doc_ids, self.known, self.doc_sizes, blocks, self.checkpoints = arrays
        self.blocks = blocks.reshape(-1, 3)

    def blocks_from(self, first: int, last: int) -> np.ndarray:
        """Ids of the blocks from first to last, last excluded."""
        part = self.blocks[first:last]
        begin = int(part[0, 0])
        data = self.file.read_at(int(part[-1, :2].sum()) - begin, begin)
        each = BLOCK // STEP
        starts = self.checkpoints[first * each : min(last * each, len(self.checkpoints))].astype(np.int64)
        segments = -(-part[:, 2] // STEP)
        starts += np.repeat((part[:, 0] - begin) * 8, segments)
        counts = np.full(len(starts), STEP)
        ends = np.cumsum(segments) - 1
        counts[ends] = part[:, 2] - (segments - 1) * STEP
        return decode_blocks(data, starts, counts, self.table)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        rest, block = np.empty(0, np.uint32), 0
        for doc_id, known, n in zip(self.doc_ids.tolist(), self.known.tolist(), self.doc_sizes.tolist(), strict=True):
            while len(rest) < n:
                rest = np.concatenate([rest, self.blocks_from(block, min(block + LANES, len(self.blocks)))])
                block += LANES
            yield doc_id if known else None, rest[:n]
            rest = rest[n:]
        self.file.close()


def write_files(encoded: DataFrame, size: int, kind: str, folder: str, parts: int) -> dict:
    """Write rows (doc_id, ids) in ascending doc_id order; returns the manifest, which is written last."""
    lengths = code_lengths(count_ids(encoded, size, kind))
    codes = canonical_codes(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, total = TaskContext.get().partitionId(), None, 0
        for b in batches:
            for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if writer is None:
                    writer = FileWriter(f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.lhuf", codes, lengths)
                ids = np.frombuffer(raw, kind)
                writer.add(doc_id, ids)
                total += len(ids)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": writer.uri, "docs": len(writer.doc_ids), "tokens": total}])

    keyed = encoded.withColumn("tie", F.xxhash64("ids"))
    ranged = keyed.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "ids")
    files = sorted(ranged.mapInArrow(run, "part long, path string, docs long, tokens long").collect())  # a row per file
    starts = list(accumulate((f.tokens for f in files), initial=0))
    manifest = {
        "files": [{"path": f.path, "docs": f.docs, "tokens": f.tokens, "start": s} for f, s in zip(files, starts[:-1], strict=True)],
        "tokens": starts[-1],
        "lengths": lengths.tolist(),
    }
    _shared.write_json(f"{folder}/manifest.json", manifest)
    return manifest


def read_manifest(folder: str) -> dict:
    store, path = _shared.filesystem(f"{folder}/manifest.json")
    with store.open_input_stream(path) as f:
        return json.loads(f.read())


def read_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Documents of the files of a manifest: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    manifest = read_manifest(folder)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    if not manifest["files"]:
        return spark.createDataFrame([], schema)
    lengths = np.asarray(manifest["lengths"], np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in b.to_pylist():
                rows: list[tuple] = []
                at, held = f["start"], 0
                for doc_id, ids in FileReader(f["path"], lengths).documents():
                    rows.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *([ids.tolist()] if with_ids else ())))
                    at += len(ids)
                    held += len(ids)
                    if len(rows) >= 4096 or with_ids and held > 1_000_000:
                        yield _rows(rows, with_ids)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows, with_ids)

    paths = spark.createDataFrame([(f["path"], f["start"]) for f in manifest["files"]], "path string, start long")
    return _shared.spread(paths, len(manifest["files"])).mapInArrow(run, schema)


def _rows(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, write the files to folder (default: one in the shared folder) and read them back."""
    spark = docs.sparkSession
    folder = folder or _shared.work_dir(spark, "token-files")
    encoded = _shared.materialize(encode_table(docs, tokenizer, end_id, id_col, text_col), "token-ids")
    write_files(encoded, max(word_encoder(tokenizer).size, end_id + 1), word_encoder(tokenizer).kind, folder, _shared.shuffle_partitions(spark))
    return read_files(spark, folder)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files(_shared.read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)
