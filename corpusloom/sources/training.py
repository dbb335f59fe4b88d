"""Written shards as an endless stream of training batches, over permuted epochs.

An epoch reads all shards of a split in an order of its own, by hashes of seed,
epoch and path.  Where each shard begins in it comes from running sums over a table
of one row for each shard; a request for batches finds the parts of shards that it
needs by ranges of positions, so only these bytes are read.  A target is the token
after its input, in the next shard or epoch where one ends.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..operators import tokens as K
from . import readers as R
from . import shard_files as B

#: Bits of a shard's place in an epoch, and of their part that numbers the blocks of the running sum.
KEY_BITS, BLOCK_BITS = 60, 16


@dataclass
class TokenReader:
    """A place in the stream of one split of a manifest; batches move it on, `state` and `resume` keep it."""

    spark: SparkSession
    manifest: str
    split: str = "train"
    shuffle: bool = True
    seed: int = 1337
    position: int = 0
    total: int = field(init=False)
    manifest_hash: str = field(init=False)
    _epochs: dict[int, DataFrame] = field(init=False, default_factory=dict)

    def __post_init__(self) -> None:
        told = B.read_json(self.manifest)
        if told.get("dtype", "uint16") != "uint16":
            raise ValueError(f"only 16-bit shards can be read, not {told['dtype']}")
        self.manifest_hash = B.file_hash(self.manifest)
        listed = R.manifest_entries(R.manifest(self.spark, self.manifest)).where(F.col("split") == self.split)
        disk = B.sizes(self.spark, self.manifest.rpartition("/")[0]).select(F.concat(F.lit(self.manifest.rpartition("/")[0] + "/"), "path").alias("uri"))
        self._entries = storage.materialize(R.resolved(listed, self.manifest, disk).where("token_count > 0"), "reader-entries")
        self.total = self._entries.agg(F.sum("token_count")).first()[0] or 0
        if self.total < 2:
            raise ValueError(f"{self.manifest} has fewer than two {self.split} tokens")

    def epoch(self, number: int) -> DataFrame:
        """Rows (order_no, entry_no, uri, token_count, start, end) of an epoch: its shards and where they stand in it; written once."""
        if number not in self._epochs:
            sums = {"end": F.col("token_count"), "order_no": F.lit(1)}
            if self.shuffle:
                key = F.conv(F.substring(K.shuffle_key(self.seed + number, "path"), 1, KEY_BITS // 4), 16, 10).cast("long")
                summed = K.running_sum(self._entries.withColumn("key_", key), [], "key_", sums, 1 << KEY_BITS - BLOCK_BITS, ("path", "entry_no"))
            else:
                summed = K.running_sum(self._entries, [], "entry_no", sums)
            rows = summed.select((F.col("order_no") - 1).alias("order_no"), "entry_no", "uri", "token_count", (F.col("end") - F.col("token_count")).alias("start"), "end")
            self._epochs[number] = storage.materialize(rows, "epoch")
        return self._epochs[number]

    def parts(self, begin: int, end: int) -> DataFrame:
        """Rows (pos, uri, file_tokens, at, tokens): the parts of shards that make up positions [begin, end) of the stream."""
        out = []
        for e in range(begin // self.total, (end - 1) // self.total + 1):
            base = e * self.total
            mine = self.epoch(e).where((F.col("end") > begin - base) & (F.col("start") < end - base))
            first, last = F.greatest("start", F.lit(begin - base)), F.least("end", F.lit(end - base))
            out.append(mine.select((first + base).alias("pos"), "uri", F.col("token_count").alias("file_tokens"), (first - F.col("start")).alias("at"), (last - first).alias("tokens")))
        return reduce(DataFrame.unionByName, out)

    def read(self, n: int) -> DataFrame:
        """The next n tokens, in pieces (pos, ids)."""
        begin, self.position = self.position, self.position + n
        return B.cut(self.parts(begin, begin + n))

    def batches(self, n: int, rows: int, columns: int) -> DataFrame:
        """The next n batches: rows (batch, row, inputs, targets), the batches numbered from 0."""
        if min(n, rows, columns) <= 0:
            raise ValueError("batches, rows and columns must be positive")
        begin, size = self.position, n * rows * columns
        whole = self.parts(begin, begin + size + 1).withColumn("pos", F.col("pos") - begin)
        last = F.least(F.floor((F.col("pos") + F.col("tokens") - 1) / columns), F.lit(n * rows - 1))
        # Row k needs positions k * columns to (k + 1) * columns, the last of them as a target alone.
        first = F.floor(F.greatest(F.col("pos") - 1, F.lit(0)) / columns)
        spread = whole.withColumn("part", F.explode(F.sequence(first, last)))
        a, b = F.greatest(F.col("pos"), F.col("part") * columns), F.least(F.col("pos") + F.col("tokens"), (F.col("part") + 1) * columns + 1)
        pieces = spread.select("part", a.alias("pos"), "uri", "file_tokens", (F.col("at") + a - F.col("pos")).alias("at"), (b - a).alias("tokens")).where("tokens > 0")
        gathered = B.cut(pieces).groupBy("part").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("x"))  # `columns` + 1 ids at most
        x = gathered.select("part", F.flatten(F.transform("x", lambda p: p["ids"])).alias("x"))
        self.position += size
        return x.select(F.floor(F.col("part") / rows).alias("batch"), (F.col("part") % rows).alias("row"), F.slice("x", 1, columns).alias("inputs"), F.slice("x", 2, columns).alias("targets"))

    def state(self) -> dict[str, Any]:
        """What another reader needs to go on here."""
        number, offset = divmod(self.position, self.total)
        here = self.epoch(number).where((F.col("start") <= offset) & (F.col("end") > offset)).first()
        return {
            "version": 1,
            "manifest_hash": self.manifest_hash,
            "split": self.split,
            "shuffle_shards": self.shuffle,
            "shuffle_seed": self.seed,
            "epoch": number,
            "order_position": here.order_no,
            "shard_index": here.entry_no,
            "offset_in_shard": offset - here.start,
        }

    def resume(self, state: dict[str, Any]) -> TokenReader:
        """Go on at a state; an error if it is that of another stream or doesn't fit this one."""
        for key, mine in (("manifest_hash", self.manifest_hash), ("split", self.split), ("shuffle_shards", self.shuffle), ("shuffle_seed", self.seed)):
            if state.get(key) != mine:
                raise ValueError(f"{key} of the state is {state.get(key)!r}, not {mine!r}")
        here = self.epoch(int(state["epoch"])).where(F.col("order_no") == int(state["order_position"])).first()
        if here is None or here.entry_no != state["shard_index"]:
            raise ValueError("the state has another order of shards")
        if not 0 <= int(state["offset_in_shard"]) <= here.token_count:
            raise ValueError("the state is beyond its shard")
        self.position = int(state["epoch"]) * self.total + here.start + int(state["offset_in_shard"])
        return self
