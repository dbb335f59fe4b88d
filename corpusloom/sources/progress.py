"""Resuming: sources that are done, shards that are whole, and cursors of token streams."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.runs import canonical_hash
from .shard_files import exists, read_json, write_json


@dataclass
class Progress:
    """Which sources of a preparation are done; another configuration's progress is refused."""

    path: str
    configuration: dict[str, Any]
    done: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str, configuration: dict[str, Any]) -> Progress:
        p = cls(path, configuration)
        if exists(path):
            raw = read_json(path)
            if raw["configuration"] != canonical_hash(configuration):
                raise ValueError("the progress is that of another configuration")
            p.done = raw["done"]
        return p

    def open(self, names: list[str]) -> list[str]:
        return [n for n in names if n not in self.done]

    def finish(self, name: str, result: Any) -> None:
        self.finish_all({name: result})

    def finish_all(self, results: dict[str, Any]) -> None:
        """Sources that were prepared together are done together."""
        self.done |= results
        write_json(self.path, {"configuration": canonical_hash(self.configuration), "done": self.done})


def broken(entries: DataFrame, disk: DataFrame) -> DataFrame:
    """Listed shards (path, token_count) that are missing or of another size among files (path, bytes)."""
    return entries.join(disk, "path", "left").where(F.coalesce(F.col("bytes") != 2 * F.col("token_count"), F.lit(True))).select("path")


@dataclass
class Cursor:
    """A place in an endless token stream that begins anew after its last token; `epoch` counts these."""

    manifest: str
    split: str
    total: int
    epoch: int = 0
    pos: int = 0

    def advance(self, n: int) -> list[tuple[int, int]]:
        """Ranges (begin, end) of positions of the next n tokens."""
        out = []
        while n:
            take = min(n, self.total - self.pos)
            out.append((self.pos, self.pos + take))
            self.pos, n = self.pos + take, n - take
            if self.pos == self.total:
                self.epoch, self.pos = self.epoch + 1, 0
        return out

    def read(self, stream: DataFrame, n: int) -> DataFrame:
        """The next n tokens of (pos, token), in order, as (place, token); range conditions reach the scan."""
        out, at = None, 0
        for begin, end in self.advance(n):
            part = stream.where((F.col("pos") >= begin) & (F.col("pos") < end)).select((F.col("pos") - begin + at).alias("place"), "token")
            out, at = part if out is None else out.unionByName(part), at + end - begin
        return out.orderBy("place")

    def state(self) -> dict[str, Any]:
        return asdict(self)

    @classmethod
    def resume(cls, state: dict[str, Any], manifest: str, split: str, total: int) -> Cursor:
        if (state["manifest"], state["split"], state["total"]) != (manifest, split, total) or not 0 <= state["pos"] < total:
            raise ValueError("the state is that of another stream")
        return cls(**state)
