"""Token streams: splits, exact quotas, shards, chunks, shuffles, batches and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import storage
from ..functions.text import bind

#: Rows of one block of a running sum; blocks of a group are summed first, so that no task holds a whole group.
BLOCK = 50_000
#: Ranges of the key of a global order, a power of 16: 10^10 rows give about 150,000 rows each.
RANGES = 65_536


def word_count(c: Column) -> Column:
    """Tokens of a cleaned text for the surrogate tokenizer: its words and an end mark; an empty text has the mark alone."""
    return F.when(c == "", 1).otherwise(F.size(F.split(c, " ")) + 1).cast("long")


def byte_count(c: Column) -> Column:
    """Tokens for the byte tokenizer: the UTF-8 bytes and an end mark."""
    return (F.octet_length(c) + 1).cast("long")


def running_sum(df: DataFrame, groups: list[str], order: str, sums: dict[str, Column], block: int = BLOCK, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds inclusive running sums in the order of a whole number, in two levels: of blocks, then within them; columns may break ties."""
    at = F.floor(F.col(order) / block)
    df = df.withColumn("block_", at)
    totals = df.groupBy(*groups, "block_").agg(*(F.sum(c).alias(f"{k}_before") for k, c in sums.items()))
    w = Window.partitionBy(*groups).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*groups, "block_", *(F.coalesce(F.sum(f"{k}_before").over(w), F.lit(0)).alias(f"{k}_before") for k in sums))
    inside = Window.partitionBy(*groups, "block_").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({k: F.sum(c).over(inside) for k, c in sums.items()}).join(totals, [*groups, "block_"])
    return df.withColumns({k: (F.col(k) + F.col(f"{k}_before")).cast("long") for k in sums}).drop("block_", *(f"{k}_before" for k in sums))


def coin(seed: int, *key: str) -> Column:
    """In [0, 1), from 32 bits of a hash of seed and key."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in key)).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def quota(docs: DataFrame, val_ratio: float = 0.0, seed: int = 1337) -> DataFrame:
    """Exact budgets by source: rows (source, row_id, n_tokens, budget, val_budget) get split and take.

    Documents go to validation by a coin while both budgets are open, to the one
    that is open otherwise (either may be 0), and are cut to what is left of it; what is past both
    is left out.  The three running sums give what this rule gives in sequence;
    what each adds is written, so that the plan doesn't grow with the next.
    """
    docs = storage.materialize(docs, "quota")
    both = docs.withColumn("coin_", (coin(seed, "source", "row_id") < val_ratio) & (F.col("val_budget") > 0))
    n = F.col("n_tokens")
    both = running_sum(both, ["source"], "row_id", {"val_sum": F.when(F.col("coin_"), n).otherwise(0)})
    both = both.withColumn("val_", F.col("coin_") & (F.col("val_sum") - n < F.col("val_budget")))
    both = storage.materialize(running_sum(both, ["source"], "row_id", {"train_sum": F.when(~F.col("val_"), n).otherwise(0)}), "quota")
    full = both.where(~F.col("val_") & (F.col("train_sum") >= F.col("budget"))).groupBy("source").agg(F.min("row_id").alias("full_at"))
    both = both.join(full, "source", "left").withColumn("late_", F.coalesce(F.col("row_id") > F.col("full_at"), F.lit(False)) | (F.col("budget") <= 0))
    both = running_sum(both, ["source"], "row_id", {"fill_sum": F.when(F.col("val_") | F.col("late_"), n).otherwise(0)})
    to_val = F.col("val_") | F.col("late_")
    left = F.when(to_val, F.col("val_budget") - (F.col("fill_sum") - n)).otherwise(F.col("budget") - (F.col("train_sum") - n))
    take = F.greatest(F.lit(0), F.least(n, left)).cast("long")
    chosen = both.withColumn("split", F.when(to_val, "val").otherwise("train")).withColumn("take", take).where("take > 0")
    return chosen.drop("coin_", "val_", "late_", "val_sum", "train_sum", "fill_sum", "full_at")


def truncated(ids: Column, take: Column, end_id: int) -> Column:
    """The first take - 1 ids and the end mark where a document is cut; nothing for 0."""
    cut = F.concat(F.slice(ids, 1, F.greatest(take - 1, F.lit(0)).cast("int")), F.array(F.lit(end_id)))
    return F.when(take <= 0, F.slice(ids, 1, 0)).when(take < F.size(ids), cut).otherwise(ids)


def shard_pieces(docs: DataFrame, groups: list[str], shard_tokens: int, order: str = "row_id", size: str = "take", keep: tuple[str, ...] = ()) -> DataFrame:
    """Cut documents where shards end: rows (groups, order, shard_index, shard_offset, doc_offset, tokens), and columns to keep."""
    placed = running_sum(docs.select(*groups, order, *dict.fromkeys((size, *keep))), groups, order, {"end_": F.col(size)}).withColumn("start_", F.col("end_") - F.col(size))
    placed = placed.where(F.col(size) > 0)
    first, last = F.floor(F.col("start_") / shard_tokens), F.floor((F.col("end_") - 1) / shard_tokens)
    cut = placed.withColumn("shard_index", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("start_"), F.col("shard_index") * shard_tokens)
    end = F.least(F.col("end_"), (F.col("shard_index") + 1) * shard_tokens)
    return cut.select(*groups, order, F.col("shard_index").cast("long").alias("shard_index"), (begin - F.col("shard_index") * shard_tokens).cast("long").alias("shard_offset"), (begin - F.col("start_")).cast("long").alias("doc_offset"), (end - begin).cast("long").alias("tokens"), *keep)


def shards(pieces: DataFrame, groups: list[str]) -> DataFrame:
    return pieces.groupBy(*groups, "shard_index").agg(F.sum("tokens").alias("token_count"))


def prefix_take(entries: DataFrame, limit: int, groups: list[str], order: str) -> DataFrame:
    """The first `limit` tokens over ordered shards: adds take; no end mark is added where a shard is cut."""
    summed = running_sum(entries, groups, order, {"end_": F.col("token_count")})
    take = F.greatest(F.lit(0), F.least(F.col("token_count"), limit - (F.col("end_") - F.col("token_count"))))
    return summed.withColumn("take", take.cast("long")).where("take > 0").drop("end_")


def chunks(entries: DataFrame, chunk_tokens: int) -> DataFrame:
    """Slices of each shard, the last one short: adds offset and token_count to rows with token_count."""
    total = F.col("token_count")
    cut = entries.where(total > 0).withColumn("offset", F.explode(F.sequence(F.lit(0).cast("long"), total - 1, F.lit(chunk_tokens).cast("long"))))
    return cut.withColumn("token_count", F.least(F.lit(chunk_tokens).cast("long"), total - F.col("offset")))


def shuffle_key(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)).cast("binary"))


def first_shuffled(df: DataFrame, seed: int, columns: list[str], n: int) -> DataFrame:
    """The first n of a global shuffle, with their place from 1."""
    top = df.withColumn("key_", shuffle_key(seed, *columns)).orderBy("key_", *columns).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy("key_", *columns))).drop("key_")


def everything(*columns: str) -> Window:
    """A window over all rows, for few of them."""
    return Window.orderBy(*columns)


def placed(df: DataFrame, groups: list[str], order: list[str], place: str = "place", parts: int = RANGES) -> DataFrame:
    """Adds the place of each row in the order of hexadecimal keys, from 1, by group: in two levels, so that no task holds a group.

    The first column of the order is a hash in hexadecimal; `parts` is a power of 16 of ranges of it at most.
    """
    digits = max(1, (parts - 1).bit_length() + 3 >> 2)
    df = df.withColumn("range_", F.substring(order[0], 1, digits))
    sizes = df.groupBy(*groups, "range_").agg(F.count("*").alias("n_"))
    before = F.sum("n_").over(Window.partitionBy(*groups).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*groups, "range_", F.coalesce(before, F.lit(0)).alias("before_"))
    within = F.row_number().over(Window.partitionBy(*groups, "range_").orderBy(*order))
    return df.withColumn("within_", within).join(sizes, [*groups, "range_"]).withColumn(place, (F.col("before_") + F.col("within_")).cast("long")).drop("range_", "within_", "before_")


def switches(first: DataFrame, column: str = "source") -> DataFrame:
    """How often the source changes over a bounded number of ordered chunks, and the first 32."""
    w = Window.orderBy("place")
    changed = first.withColumn("changed", (F.lag(column).over(w) != F.col(column)).cast("int"))
    head = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= 32, F.struct("place", column)))), lambda x: x[column]), ",")
    return changed.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("changed"), F.lit(0)).cast("long").alias("switches"), head.alias("first_sources"))


def batches(stream: DataFrame, rows: int, columns: int) -> DataFrame:
    """Inputs and targets of an ordered stream (pos from 0, token): rows (batch, row, inputs, targets).

    The target of a position is the next token; the last one's is the first of the stream, which begins anew there.
    """
    size = rows * columns
    total = stream.agg(F.count("*").alias("total"))
    ahead = stream.select(((F.col("pos") - 1)).alias("pos"), F.col("token").alias("target"))
    first = stream.where("pos = 0").select(F.col("token").alias("first_token"))
    n = total.first()[0]
    wrap = first.select(F.lit(n - 1).cast("long").alias("pos"), F.col("first_token").alias("target"))
    pairs = stream.join(ahead.where("pos >= 0").unionByName(wrap), "pos")
    at = pairs.select(F.floor(F.col("pos") / size).alias("batch"), F.floor(F.col("pos") % size / columns).alias("row"), F.col("pos"), "token", "target")
    gathered = at.groupBy("batch", "row").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "target"))).alias("x"))  # `columns` at most
    return gathered.where(F.size("x") == columns).select("batch", "row", F.transform("x", lambda x: x["token"]).alias("inputs"), F.transform("x", lambda x: x["target"]).alias("targets"))


def stream_pieces(docs: DataFrame, size: int, order: str = "row_id", ahead: int = 0, block: int = BLOCK) -> DataFrame:
    """Documents (order, ids) as one stream in their order, cut where parts of `size` positions end: rows (part, pos, ids).

    A part also has the first `ahead` positions of the next one.  Slices are made before they become rows, so none holds its whole document.
    """
    sizes = running_sum(docs.select(order, F.size("ids").cast("long").alias("n_")), [], order, {"end_": F.col("n_")}, block)
    placed = docs.join(sizes.select(order, (F.col("end_") - F.col("n_")).alias("start_"), "end_"), order).where("end_ > start_")
    start, end = F.col("start_"), F.col("end_")

    def piece(p: Column) -> Column:
        a, b = F.greatest(start, p * size), F.least(end, (p + 1) * size + ahead)
        return F.struct(p.alias("part"), a.alias("pos"), F.slice("ids", (a - start + 1).cast("int"), (b - a).cast("int")).alias("ids"))

    parts = F.sequence(F.floor(F.greatest(start - ahead, F.lit(0)) / size), F.floor((end - 1) / size))
    return placed.select(F.explode(F.transform(parts, piece)).alias("p")).select("p.*")


def scanned(docs: DataFrame, size: int, end_id: int) -> DataFrame:
    """Least and largest id, end marks and tokens of each shard of a stream of documents (row_id, ids)."""
    s = stream_pieces(docs, size).groupBy(F.col("part").alias("shard"))
    ends = F.size(F.filter("ids", lambda x: x == end_id)).cast("long")
    return s.agg(F.min(F.array_min("ids")).alias("least"), F.max(F.array_max("ids")).alias("most"), F.sum(ends).alias("ends"), F.sum(F.size("ids").cast("long")).alias("tokens"))


def packed(docs: DataFrame, rows: int, columns: int) -> DataFrame:
    """What `batches` gives for the stream of documents (row_id, ids), without a row for each token."""
    whole = docs.where(F.size("ids") > 0).agg(F.sum(F.size("ids").cast("long")).alias("n"), F.min_by(F.slice("ids", 1, 1), "row_id").alias("ids")).where("n > 0")
    wrap = whole.select(F.floor((F.col("n") - 1) / columns).alias("part"), F.col("n").alias("pos"), "ids")
    gathered = stream_pieces(docs, columns, ahead=1).unionByName(wrap).groupBy("part").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("x"))  # `columns` + 1 at most
    x = gathered.select("part", F.flatten(F.transform("x", lambda x: x["ids"])).alias("x")).where(F.size("x") == columns + 1)
    return x.select(F.floor(F.col("part") / rows).alias("batch"), (F.col("part") % rows).alias("row"), F.slice("x", 1, columns).alias("inputs"), F.slice("x", 2, columns).alias("targets"))


def rolling_windows(ids: Column, most: int, start_id: int) -> Column:
    """Windows (tokens, score_start) that score each token once: a start mark, the token before, then up to most - 1 new ones."""
    stride = most - 1

    def cut(x: Column) -> Column:
        starts = F.when(F.size(x) > 0, F.sequence(F.lit(0), F.size(x) - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))

        def window(s: Column) -> Column:
            begin = F.greatest(s - 1, F.lit(0))
            end = F.least(F.size(x), s + stride)
            return F.struct(F.concat(F.array(F.lit(start_id)), F.slice(x, begin + 1, end - begin)).alias("tokens"), (1 + s - begin).alias("score_start"))

        return F.transform(starts, window)

    return bind(ids, cut)


def continuation(context: Column, more: Column, most: int, start_id: int) -> Column:
    """A sequence (tokens, score_start) of a start mark, the end of the context and the continuation, of at most so many."""
    room = most - F.size(more)
    kept = F.when(room < 1, F.slice(more, -(most - 1), most - 1)).otherwise(more)
    tail_size = F.least(F.size(context), room - 1)
    empty = F.slice(context, 1, 0)
    tail = F.when(tail_size >= 1, F.slice(context, F.size(context) - tail_size + 1, F.greatest(tail_size, F.lit(0)))).otherwise(empty)
    whole = F.struct(F.concat(F.array(F.lit(start_id)), tail, kept).alias("tokens"), (1 + F.size(tail)).alias("score_start"))
    return F.when(F.size(more) == 0, F.struct(F.array(F.lit(start_id)).alias("tokens"), F.lit(1).alias("score_start"))).otherwise(whole)
