"""Preparations end to end: shards of token ids on disk, their manifests, and the check of both.

A manifest is a JSON object with `train_shards` and `val_shards`, lists of path
(under the manifest's folder) and token_count, totals, the tokenizer and its hash,
and what the preparation reports.  The driver holds a row for each shard and source.

Files get names that follow from their place, and the manifest is written last, so
a preparation that broke off can simply be run again; a mix and an assembly take over
the sources that they had finished, if their shards are whole.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Mapping
from dataclasses import asdict
from functools import reduce
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions import text as X
from ..operators import corpus as C
from ..operators import shingles as H
from ..operators import stats as A
from ..operators import tokenize as Z
from ..operators import tokens as K
from ..operators import verify as V
from ..operators.runs import canonical_hash
from ..sources import progress as G
from ..sources import readers as R
from ..sources import shard_files as B
from ..spec import Assembly, Source
from . import prepare as P

#: The sizes and the seed that manifests have unless they are told otherwise.
SHARD_TOKENS, CHUNK_TOKENS, SEED = 4_194_304, 8_192, 1337
#: Bits of the key of a global shuffle, and of its part that numbers the blocks of the running sum.
KEY_BITS, BLOCK_BITS = 60, 16


class Encoder:
    """Ids of a cleaned text, with an end mark, as a column; and what a manifest says of them."""

    def __init__(self, ids: Callable[[Column], Column], size: int, end: int, unknown: int | None, name: str, digest: str) -> None:
        self.ids, self.size, self.end, self.unknown, self.name, self.digest = ids, size, end, unknown, name, digest

    @classmethod
    def of(cls, path: str) -> Encoder:
        """A tokenizer file."""
        t = Z.load(path)
        with open(path, "rb") as f:
            digest = hashlib.sha256(f.read()).hexdigest()
        return cls(lambda c: Z.encode(c, path), t.size, t.special["eos"], t.special["unk"], path, digest)

    @classmethod
    def of_words(cls, most: int = 1_000) -> Encoder:
        """A stand-in that needs no file: 4 and the length of each word, up to `most`, then 3."""
        ids = lambda c: F.concat(F.transform(F.split(c, " "), lambda w: F.least(F.length(w) + 4, F.lit(most - 1))), F.array(F.lit(3)))
        return cls(ids, most, 3, None, f"word lengths under {most}", hashlib.sha256(str(most).encode()).hexdigest())


def _with_tokens(rows: DataFrame, judged: DataFrame, encoder: Encoder) -> DataFrame:
    """Rows (source, row_id, ids) of the accepted documents, written once."""
    accepted = judged.where("disposition = 'accepted'").select("source", "row_id")
    texts = rows.where("early IS NULL").select("source", "row_id", "text").join(accepted, ["source", "row_id"], "left_semi")
    return storage.materialize(texts.select("source", "row_id", encoder.ids(F.col("text")).alias("ids")), "token-ids")


def _cut_taken(tokens: DataFrame, taken: DataFrame, encoder: Encoder, shard_tokens: int) -> DataFrame:
    """Rows (source, split, shard_index, shard_offset, ids) of what is taken (source, row_id, split, take): joined to its ids once, cut where shards end, and written."""
    pieces = K.shard_pieces(taken, ["source", "split"], shard_tokens, keep=("take",))
    ids = K.truncated(F.col("ids"), F.col("take"), encoder.end)
    fit = F.coalesce(F.array_max(ids) < encoder.size, F.lit(True)) & F.coalesce(F.array_min(ids) >= 0, F.lit(True))
    cut = V.required(pieces.join(tokens, ["source", "row_id"]), fit, "an id is out of range")
    part = F.slice(ids, (F.col("doc_offset") + 1).cast("int"), F.col("tokens").cast("int"))
    return storage.materialize(cut.select("source", "split", "shard_index", "shard_offset", part.alias("ids")), "pieces")


def _write_pieces(pieces: DataFrame, folder: str, prefix: Column) -> DataFrame:
    """Write pieces as shards under prefix, by source and split; their entries."""
    return storage.materialize(B.write(pieces.select(prefix.alias("prefix"), "split", "shard_index", "shard_offset", "ids"), folder), "entries")


def _source_prefix() -> Column:
    return F.concat(F.lit("sources/"), X.slug(F.col("source")), F.lit("/"), F.col("split"))


def _frequencies(pieces: DataFrame) -> DataFrame:
    """Rows (source, split, token, n) of what is taken."""
    return A.id_counts(pieces.select("source", "split", "ids"), ["source", "split"])


def _top(counts: DataFrame, n: int = 100) -> list[dict[str, int]]:
    return [{"token_id": r.token, "count": r.n} for r in A.top(A.added(counts), n).collect()]


def _statistics(judged: DataFrame, counts: DataFrame, encoder: Encoder, names: list[str]) -> dict[str, dict[str, Any]]:
    """The counters of each source: raw rows, dispositions, tokens of both splits, unknown ones, and hits by benchmark."""
    zero = dict.fromkeys(("train_tokens", "val_tokens", "unk_tokens", *("raw", *C.KINDS)), 0)
    out: dict[str, dict[str, Any]] = {n: zero | {"benchmark_hits": {}} for n in names}
    for r in C.counters(judged).collect():
        out[r.source] |= {k: r[k] for k in ("raw", *C.KINDS)}
    for r in judged.where("hits IS NOT NULL AND disposition = 'contaminated'").select("source", F.explode("hits")).groupBy("source", "key").agg(F.sum("value").alias("n")).collect():
        out[r.source]["benchmark_hits"][str(r.key)] = r.n
    unknown = F.sum(F.when(F.col("token") == (-1 if encoder.unknown is None else encoder.unknown), F.col("n")).otherwise(0))
    for r in counts.groupBy("source", "split").agg(F.sum("n").alias("n"), unknown.alias("unknown")).collect():
        out[r.source][f"{r.split}_tokens"] = r.n
        out[r.source]["unk_tokens"] += r.unknown
    return out


def manifest(entries: list[Any], encoder: Mapping[str, Any], shard_tokens: int, kind: str, **more: Any) -> dict[str, Any]:
    """The common part of all manifests, and more; entries (split, path, token_count) in their order."""
    out: dict[str, Any] = {"version": 1, "created_at": time.strftime("%Y-%m-%dT%H:%M:%S%z"), "dtype": "uint16", "shard_token_target": shard_tokens, **encoder}
    for split in ("train", "val"):
        mine = [{"path": e["path"], "token_count": e["token_count"]} for e in entries if e["split"] == split]
        out |= {f"{split}_shards": mine, f"{split}_token_count": sum(e["token_count"] for e in mine)}
    out["total_token_count"] = out["train_token_count"] + out["val_token_count"]
    return out | {"dataset": {"type": kind}, "source": {"type": kind}} | more


def _told(encoder: Encoder) -> dict[str, Any]:
    return {"tokenizer": encoder.name, "tokenizer_hash": encoder.digest, "vocab_size": encoder.size}


def _in_order(entries: DataFrame, names: list[str]) -> list[dict[str, Any]]:
    """Entries as the sources are listed, then by split and shard."""
    place = {f"sources/{R.source_slug(n)}/{s}": (i, s) for i, n in enumerate(names) for s in ("train", "val")}
    rows = sorted(entries.collect(), key=lambda r: (place[r.prefix], r.shard_index))
    return [{"split": r.split, "path": r.path, "token_count": r.token_count} for r in rows]


def write_corpus(docs: DataFrame, encoder: Encoder, folder: str, val_ratio: float = 0.0, seed: int = SEED, shard_tokens: int = SHARD_TOKENS, deduplicate: bool = True, normalize: bool = True) -> dict[str, Any]:
    """One corpus (row_id, text) without budgets: clean, drop copies, split by a coin, write shards and the manifest."""
    rows = C.staged(docs.withColumn("source", F.lit("corpus")), F.lit(True), normalize=normalize)
    first = rows.where("early IS NULL")
    if deduplicate:
        keep = C.drop_copies(first.select("row_id", F.col("digest").cast("string").alias("text")), []).select("row_id")
        first = first.join(keep, "row_id", "left_semi")
    split = F.when(K.coin(seed, "row_id") < val_ratio, "val").otherwise("train")
    tokens = storage.materialize(first.select("source", "row_id", split.alias("split"), X.mostly_ascii_letters(F.col("text")).alias("en"), encoder.ids(F.col("text")).alias("ids")), "token-ids")
    taken = storage.materialize(tokens.select("source", "row_id", "split", "en", F.size("ids").cast("long").alias("take")), "taken")
    pieces = _cut_taken(tokens.select("source", "row_id", "ids"), taken, encoder, shard_tokens)
    entries = _write_pieces(pieces, folder, F.col("split"))
    counts = storage.materialize(_frequencies(pieces), "frequencies")
    sizes = {r.split: r for r in taken.groupBy("split").agg(F.count("*").alias("n"), F.sum("take").alias("tokens"), F.count_if("en").alias("en")).collect()}
    documents, total = sum(r.n for r in sizes.values()), sum(r.tokens for r in sizes.values())
    unknown = counts.where(F.col("token") == (-1 if encoder.unknown is None else encoder.unknown)).agg(F.sum("n")).first()[0] or 0
    raw = {r.early: r["count"] for r in rows.groupBy("early").count().collect()}
    statistics = {
        "raw_document_count": sum(raw.values()),
        "empty_document_count": raw.get("empty", 0) + raw.get("missing", 0),
        "duplicate_document_count": raw.get(None, 0) - documents,
        **{f"{s}_document_count": sizes[s].n if s in sizes else 0 for s in ("train", "val")},
        "en_like_document_count": sum(r.en for r in sizes.values()),
        "average_document_tokens": total / max(1, documents),
        "unk_rate": unknown / max(1, total),
        "unk_token_count": unknown,
        "token_frequency_top_100": _top(counts),
        "duplicate_filtering": "enabled" if deduplicate else "disabled",
    }
    listed = [r.asDict() for r in sorted(entries.collect(), key=lambda r: (r.split, r.shard_index))]
    out = manifest(listed, _told(encoder), shard_tokens, "corpus", val_ratio=val_ratio, statistics=statistics)
    B.write_json(f"{folder}/manifest.json", out)
    return out


def inputs_hash(rows: DataFrame) -> str:
    """Of the files that a table is read from: their paths, sizes and times.  Contents aren't read."""
    files = [unquote(f) for f in rows.inputFiles()]
    if not files:
        return canonical_hash(rows.schema.jsonValue())
    listed = rows.sparkSession.read.format("binaryFile").load(files).select(F.xxhash64("path", "modificationTime", "length").alias("h"))
    told = listed.agg(F.count("*").alias("n"), F.bit_xor("h").alias("h")).first()
    return canonical_hash([told.n, told.h])


def _prepared(rows: DataFrame, specs: list[Source], index: DataFrame | H.StoredIndex, encoder: Encoder, folder: str, scale: float, val_ratio: float, seed: int, shard_tokens: int, width: int, strict: bool) -> dict[str, Any]:
    """Prepare some sources in one pass and write their shards: for each its entries, counters and where its frequencies are."""
    staged = C.staged(rows, F.col("passes"), F.col("min_chars"))
    judged = storage.materialize(C.verdicts(staged, index, width), "verdicts")
    tokens = _with_tokens(staged, judged, encoder)
    train, val = P.budgets(specs, scale, val_ratio)
    counted = tokens.select("source", "row_id", F.size("ids").cast("long").alias("n_tokens"), P.by_source(train).cast("long").alias("budget"), P.by_source(val).cast("long").alias("val_budget"))
    taken = storage.materialize(K.quota(counted, val_ratio, seed), "taken")
    if strict:
        P.require_full(taken, train).collect()  # a row for each source
    pieces = _cut_taken(tokens, taken, encoder, shard_tokens)
    entries = _write_pieces(pieces, folder, _source_prefix())
    kept = f"progress/frequencies-{canonical_hash([s.name for s in specs])[:16]}"
    _frequencies(pieces).write.mode("overwrite").parquet(f"{folder}/{kept}")
    counts = rows.sparkSession.read.schema("source string, split string, token long, n long").parquet(f"{folder}/{kept}")
    names = [s.name for s in specs]
    told = _statistics(judged, counts, encoder, names)
    listed = _in_order(entries, names)
    prefixes = {n: f"sources/{R.source_slug(n)}/" for n in names}
    return {n: {"entries": [e for e in listed if e["path"].startswith(prefixes[n])], "statistics": told[n], "frequencies": kept} for n in names}


def _all_frequencies(spark: SparkSession, folder: str, done: Mapping[str, Any]) -> DataFrame:
    """Frequencies of all sources; of tables that hold a source twice the one counts that its record names."""
    tables: dict[str, list[str]] = {}
    for name, told in done.items():
        tables.setdefault(told["frequencies"], []).append(name)
    each = [spark.read.schema("source string, split string, token long, n long").parquet(f"{folder}/{path}").where(F.col("source").isin(names)) for path, names in tables.items()]
    return reduce(DataFrame.unionByName, each)


def write_mix(
    rows: Mapping[str, DataFrame] | P.Shared,
    specs: list[Source],
    index: DataFrame | H.StoredIndex,
    encoder: Encoder,
    folder: str,
    scale: float = 1.0,
    val_ratio: float = 0.0,
    seed: int = SEED,
    shard_tokens: int = SHARD_TOKENS,
    width: int = C.WIDTH,
    strict: bool = True,
    name: str = "mix",
    at_once: int | None = None,
    progress: str = "mix_progress.json",
) -> dict[str, Any]:
    """A mix of sources up to exact budgets: shards by source and split, and the manifest with the counters of each source.

    Sources of one shared table are prepared in one pass, or `at_once` at a time; others
    one by one.  What was prepared together is committed together, to a progress file.  A
    mix that broke off and is begun again takes over the sources that are committed and
    whole, and doesn't read them; shards of others are written anew.  Another
    configuration, tokenizer, index or input in that folder is an error, and so is a
    source short of its budget if strict.
    """
    shared = isinstance(rows, P.Shared)
    spark = rows.rows.sparkSession if shared else next(iter(rows.values())).sparkSession
    hashed = canonical_hash([asdict(s) | {"filters": dict(s.filters)} for s in specs])
    read = {"all": inputs_hash(rows.rows)} if shared else {s.name: inputs_hash(rows[s.name]) for s in specs}
    against = canonical_hash(index.report()) if isinstance(index, H.StoredIndex) else index.schema.simpleString()
    settings = {"sources": hashed, "scale": scale, "val_ratio": val_ratio, "seed": seed, "shard_tokens": shard_tokens, "width": width, "strict": strict, "tokenizer": encoder.digest, "index": against, "inputs": read}
    done = G.Progress.load(f"{folder}/{progress}", settings)
    names = [s.name for s in specs]
    whole = {n for n in done.done if _whole(spark, folder, done.done[n]["entries"])}
    left = [s for s in specs if s.name not in whole]
    size = 1 if not shared else max(1, len(left) if at_once is None else at_once)
    for at in range(0, len(left), size):
        some = left[at : at + size]
        done.finish_all(_prepared(P.all_rows(rows, some), some, index, encoder, folder, scale, val_ratio, seed, shard_tokens, width, strict))
    told = {n: done.done[n]["statistics"] for n in names}
    train, _ = P.budgets(specs, scale, val_ratio)
    listed = [asdict(s) | {"filters": dict(s.filters), "requested_token_budget": s.token_budget, "target_train_tokens": train[s.name], "actual_train_tokens": told[s.name]["train_tokens"], "actual_val_tokens": told[s.name]["val_tokens"]} for s in specs]
    total = sum(t["train_tokens"] + t["val_tokens"] for t in told.values())
    statistics = {"source_statistics": told, "unk_rate": sum(t["unk_tokens"] for t in told.values()) / max(1, total), "token_frequency_top_100": _top(_all_frequencies(spark, folder, {n: done.done[n] for n in names})), "duplicate_filtering": "enabled"}
    entries = [e for n in names for e in done.done[n]["entries"]]
    out = manifest(entries, _told(encoder), shard_tokens, "mix", mix_config=name, mix_config_sha256=hashed, sources=listed, scale=scale, val_ratio=val_ratio, statistics=statistics)
    B.write_json(f"{folder}/manifest.json", out)
    return out


def entries_of(spark: SparkSession, manifest_path: str) -> DataFrame:
    """Entries (split, entry_no, path, token_count, uri) of a manifest, their files looked up on disk."""
    listed = R.manifest_entries(R.manifest(spark, manifest_path))
    folder = manifest_path.rpartition("/")[0]
    files = B.sizes(spark, folder).select(F.concat(F.lit(f"{folder}/"), "path").alias("uri"))
    return R.resolved(listed, manifest_path, files)


def taken_over(spark: SparkSession, manifest_path: str, prefix: str, folder: str, limit: int | None = None, source: str | None = None) -> list[dict[str, Any]]:
    """Copy the train shards of a manifest, or of one source in it, up to so many tokens; the entries under prefix.

    No end mark is added where a shard is cut; fewer tokens than asked for are an error.
    """
    entries = entries_of(spark, manifest_path)
    mine = R.source_entries(entries, source, "train") if source else entries.where("split = 'train'")
    total = mine.agg(F.sum("token_count")).first()[0] or 0
    if limit is not None and total < limit:
        raise ValueError(f"{manifest_path} has {total} train tokens, fewer than {limit}")
    chosen = K.prefix_take(mine.withColumn("all_", F.lit(0)), total if limit is None else limit, ["all_"], "entry_no")
    chosen = storage.materialize(chosen.select("uri", "entry_no", "token_count", "take"), "chosen")
    order = {r.entry_no: i for i, r in enumerate(sorted(chosen.select("entry_no").collect()))}
    named = spark.createDataFrame([(k, f"{prefix}/train/shard_{i:06d}.bin") for k, i in order.items()], "entry_no int, path string")
    done = B.copy(chosen.join(F.broadcast(named), "entry_no"), folder).collect()
    return [{"split": "train", "path": r.path, "token_count": r["take"]} for r in sorted(done)]


def assemble(spark: SparkSession, config: Mapping[str, Any] | Assembly, encoder: Encoder, folder: str, rows: Mapping[str, DataFrame] | None = None, index: DataFrame | None = None, base: str = ".", width: int = C.WIDTH) -> dict[str, Any]:
    """An assembly of sources of three kinds, in its order: raw rows prepared here, sources of a manifest, and whole manifests.

    The train tokens must be exactly what the assembly asks for.
    """
    if isinstance(config, Assembly):
        config = {**config.settings, "target_train_tokens": config.target_train_tokens, "sources": list(config.sources)}
    done = G.Progress.load(f"{folder}/progress.json", {"assembly": dict(config), "tokenizer": encoder.digest})
    entries: list[dict[str, Any]] = []
    records, statistics, shard_tokens = [], {}, int(config.get("shard_tokens", SHARD_TOKENS))
    for item in config["sources"]:
        name, prefix = item["name"], f"sources/{R.source_slug(item['name'])}"
        asked = item.get("token_budget", item.get("target_train_tokens"))
        if name in done.done and _whole(spark, folder, done.done[name]["entries"]):
            mine, origin = done.done[name]["entries"], done.done[name]["provenance"]
        elif item["kind"] == "hf":
            one = write_mix({name: rows[name]}, [Source.of(item)], index, encoder, folder, 1.0, float(config.get("val_ratio", 0.0)), int(config.get("seed", SEED)), shard_tokens, width, progress=f"{prefix}/progress.json")
            mine = [{"split": s, **e} for s in ("train", "val") for e in one[f"{s}_shards"]]
            told, origin = one["statistics"]["source_statistics"][name], item["dataset"]
            done.finish(name, {"entries": mine, "provenance": origin, "statistics": told})
        else:
            origin = item["manifest"] if item["manifest"].startswith("/") or "://" in item["manifest"] else f"{base}/{item['manifest']}"
            if B.read_json(origin)["tokenizer_hash"] != encoder.digest:
                raise ValueError(f"{origin} is of another tokenizer")
            source = item["source_name"] if item["kind"] == "existing_source" else None
            mine = taken_over(spark, origin, prefix, folder, None if asked is None else int(asked), source)
            done.finish(name, {"entries": mine, "provenance": origin, "statistics": {}})
        statistics[name] = done.done[name]["statistics"]
        counts = {s: sum(e["token_count"] for e in mine if e["split"] == s) for s in ("train", "val")}
        records.append({"name": name, "kind": item["kind"], "category": item.get("category"), "declared_train_tokens": asked, "actual_train_tokens": counts["train"], "actual_val_tokens": counts["val"], "provenance": origin})
        entries += mine
    target, total = int(config.get("target_train_tokens", config.get("target_tokens", 0))), sum(r["actual_train_tokens"] for r in records)
    if total != target:
        raise ValueError(f"the assembly has {total} train tokens, not {target}")
    out = manifest(
        entries, _told(encoder), shard_tokens, "assembly",
        mix_config=config.get("name", "assembly"), mix_config_sha256=canonical_hash(dict(config)), target_train_tokens=target, sources=records, val_ratio=float(config.get("val_ratio", 0.0)), statistics={"source_statistics": statistics},
    )
    B.write_json(f"{folder}/manifest.json", out)
    return out


def _whole(spark: SparkSession, folder: str, entries: list[dict[str, Any]]) -> bool:
    """Whether all shards of the entries are there, of the right size."""
    if not entries:
        return True
    listed = spark.createDataFrame([(e["path"], e["token_count"]) for e in entries], "path string, token_count long")
    return G.broken(listed, B.sizes(spark, folder)).isEmpty()


def record_of(manifest_path: str, name: str) -> dict[str, Any]:
    """What a manifest says of one source; an error unless it lists it once."""
    found = [s for s in B.read_json(manifest_path).get("sources", []) if s["name"] == name]
    if len(found) != 1:
        raise ValueError(f"{manifest_path} lists {name!r} {len(found)} times")
    return found[0]


def chunk_order(chunks: DataFrame, seed: int) -> DataFrame:
    """Adds key_, the 60 bits by which chunks (source, path, offset) are shuffled."""
    key = K.shuffle_key(seed, "source", "path", "offset")
    return chunks.withColumn("key_", F.conv(F.substring(key, 1, KEY_BITS // 4), 16, 10).cast("long"))


def shuffled_pieces(chunks: DataFrame, seed: int, shard_tokens: int) -> DataFrame:
    """Where each part of each chunk (source, path, uri, file_tokens, offset, token_count) goes: rows (shard_index, shard_offset, uri, file_tokens, at, tokens).

    Chunks are rows of a few numbers; their tokens aren't touched yet.
    """
    placed = K.running_sum(chunk_order(chunks, seed), [], "key_", {"end_": F.col("token_count")}, 1 << KEY_BITS - BLOCK_BITS, ("path", "offset"))
    start = F.col("end_") - F.col("token_count")
    spans = placed.withColumn("start_", start).withColumn("shard_index", F.explode(F.sequence(F.floor(start / shard_tokens), F.floor((F.col("end_") - 1) / shard_tokens))))
    first, begin = F.col("shard_index") * shard_tokens, F.greatest(F.col("start_"), F.col("shard_index") * shard_tokens)
    end = F.least(F.col("end_"), first + shard_tokens)
    return spans.select(F.col("shard_index").cast("long").alias("shard_index"), (begin - first).cast("long").alias("shard_offset"), "uri", "file_tokens", (F.col("offset") + begin - F.col("start_")).cast("long").alias("at"), (end - begin).cast("long").alias("tokens"))


def check_input(manifest_path: str, folder: str, chunk_tokens: int, shard_tokens: int, tokenizer: str | None) -> dict[str, Any]:
    """A manifest whose shards can be mixed into an empty folder; an error if its ids aren't of 16 bits or its tokenizer isn't that file."""
    if min(chunk_tokens, shard_tokens) <= 0:
        raise ValueError("chunks and shards must hold a token at least")
    if B.holds_files(folder):
        raise FileExistsError(f"{folder} isn't empty")
    m = B.read_json(manifest_path)
    if m.get("dtype", "uint16") != "uint16":
        raise ValueError(f"only 16-bit shards can be mixed, not {m['dtype']}")
    if tokenizer is not None and m["tokenizer_hash"] != B.file_hash(tokenizer):
        raise ValueError(f"the manifest is of another tokenizer than {tokenizer}")
    return m


def mix_chunks(spark: SparkSession, manifest_path: str, folder: str, chunk_tokens: int = CHUNK_TOKENS, shard_tokens: int = SHARD_TOKENS, seed: int = SEED, tokenizer: str | None = None) -> dict[str, Any]:
    """Shuffle all chunks of a manifest's shards globally, write them as new shards into an empty folder, and verify these.

    Places come from numbers alone; then each shard is read once, and its tokens move
    once.  With the tokenizer's file its hash is compared first.
    """
    before = check_input(manifest_path, folder, chunk_tokens, shard_tokens, tokenizer)
    source = F.coalesce(F.nullif(F.regexp_extract(F.replace("path", F.lit("\\"), F.lit("/")), "^sources/([^/]+)/", 1), F.lit("")), F.lit("all"))
    entries = entries_of(spark, manifest_path).withColumn("file_tokens", F.col("token_count"))
    chunks = storage.materialize(K.chunks(entries, chunk_tokens).withColumn("source", source), "chunks")
    listed, told = [], {}
    for split, own in (("train", seed), ("val", seed + 1)):
        mine = chunks.where(F.col("split") == split)
        pieces = storage.materialize(shuffled_pieces(mine, own, shard_tokens).withColumn("split", F.lit(split)), "pieces")
        done = sorted(B.write(B.cut(pieces), folder).collect(), key=lambda r: r.shard_index)  # a row for each shard
        listed += [{"split": split, "path": r.path, "token_count": r.token_count} for r in done]
        first = K.switches(chunk_order(mine, own).orderBy("key_", "path", "offset").limit(1024).withColumn("place", F.row_number().over(K.everything("key_", "path", "offset")))).first()
        told[split] = {
            "chunks": mine.count(),
            "written_tokens": sum(r.token_count for r in done),
            "source_switches_first_1024_chunks": first.switches,
            "first_32_sources": first.first_sources.split(",") if first.first_sources else [],
            "source_chunk_counts": {r.source: r["count"] for r in mine.groupBy("source").count().orderBy("source").collect()},
        }
        wanted = before[f"{split}_token_count"]
        if told[split]["written_tokens"] != wanted:
            raise ValueError(f"{told[split]['written_tokens']} {split} tokens were written of {wanted}")
    mixing = {"mode": "global_chunk_shuffle", "chunk_tokens": chunk_tokens, "seed": seed, "input_manifest": manifest_path, "input_manifest_sha256": canonical_hash(before), **told}
    kept = {k: before[k] for k in ("tokenizer", "tokenizer_hash", "vocab_size")}
    more = {k: before[k] for k in ("sources", "target_train_tokens", "val_ratio") if k in before}
    out = manifest(listed, kept, shard_tokens, "globally_mixed", mixing=mixing, mix_config="global_chunk_shuffle", mix_config_sha256=canonical_hash(mixing), **more)
    B.write_json(f"{folder}/manifest.json", out)
    report = verify(spark, f"{folder}/manifest.json", before["tokenizer_hash"] if tokenizer is None else B.file_hash(tokenizer))
    B.write_json(f"{folder}/verification.json", report | {"mixing": {k: mixing[k] for k in ("mode", "chunk_tokens", "seed")} | {f"{s}_source_switches_first_1024_chunks": told[s]["source_switches_first_1024_chunks"] for s in told}})
    if not report["passed"]:
        raise ValueError(f"the shards don't hold what their manifest says: {report['errors']}")
    return out


def verify(spark: SparkSession, manifest_path: str, tokenizer_hash: str | None = None, most_errors: int = 1_000) -> dict[str, Any]:
    """The report of a manifest and its files: violations, up to so many of them, and what the shards hold."""
    m, folder = B.read_json(manifest_path), manifest_path.rpartition("/")[0]
    listed = entries_of(spark, manifest_path)
    disk = B.sizes(spark, folder)
    under = listed.withColumn("path", F.replace("uri", F.lit(f"{folder}/"), F.lit("")))
    whole = under.join(disk.where("bytes % 2 = 0").select("path", (F.col("bytes") / 2).cast("long").alias("n_")), "path").where("n_ = token_count")
    read = storage.materialize(A.shard_statistics(B.read(spark, folder, whole), end=None), "scan")
    totals = {s: m[f"{s}_token_count"] for s in ("train", "val")}
    bad = V.shard_violations(under, disk, read.select("path", F.array("least", "most").alias("ids")), m["vocab_size"], totals)
    errors = [f"{r.problem}: {r.path}" for r in bad.orderBy("problem", "path").limit(most_errors).collect()]
    if tokenizer_hash is not None and m["tokenizer_hash"] != tokenizer_hash:
        errors.append("the tokenizer's hash differs")
    sums = {r.split: r for r in read.groupBy("split").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("tokens").alias("tokens"), F.count("*").alias("shards")).collect()}
    return {"passed": not errors, "errors": errors, "splits": {s: {"min_token_id": r.least, "max_token_id": r.most, "tokens": r.tokens, "shards": r.shards} for s, r in sums.items()}}


def release_problems(manifest_path: str, expected: Mapping[str, Any], hashes: DataFrame | None = None) -> list[str]:
    """What of a release isn't as expected: values at dotted paths of its manifest, and hashes of files (path, sha256, wanted)."""
    m, out = B.read_json(manifest_path), []
    for place, wanted in expected.items():
        found = reduce(lambda x, k: x.get(k) if isinstance(x, Mapping) else None, place.split("."), m)
        if found != wanted:
            out.append(f"{place} is {found!r}, not {wanted!r}")
    if hashes is not None:
        out += [f"{r.path} has another hash" for r in hashes.where(~F.col("sha256").eqNullSafe(F.col("wanted"))).orderBy("path").collect()]
    return out
