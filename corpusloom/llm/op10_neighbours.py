"""Nearest neighbours by largest inner product, through low-dimensional stable projections.

Vectors are lengthened by one component so that all have the largest norm there
is; the largest inner product is then the smallest Euclidean distance.  All are
projected to ``DIMENSIONS`` dimensions by a Gaussian matrix, and a kd-tree indexes
every projected vector.  The top of the tree is fitted on the projections of at
most ``SAMPLE`` vectors, those with the smallest hash of their id; its leaves are
cells.  Vectors of a cell are counted, and dealt by a hash over files of about
``CELL`` vectors in the shared folder, built once, that hold the rest of the
tree.  So neither a large table nor a crowded cell makes a file grow.

A search goes down to the leaf of its own projection for a first k-th best, and
from there on takes projected neighbours in the order of their distance, walking
only those nodes that the stopping radius reaches, and verifies them on the
original components.  The ratio of a projected squared distance to the true one
is chi-square distributed; so a vector nearer than the k-th found lies beyond the
projected distance at which the test holds with a probability below 1 -
``CONFIDENCE``, and the search stops there.  As better vectors are found the
radius shrinks.

Queries are put in blocks by the cell that they fall in.  A task takes a block
through the cells from the nearest to the farthest, its own first, and carries
the k best found along.  The boxes of all cells are in one file, so cells that
no radius of the block reaches are never read, the others once for the block,
and what a query gives rise to doesn't grow with the number of cells.  The
driver handles a row for each file and block.  Equal vectors are one entry with
its k + 1 smallest ids, since ties go to smaller ids.

Defined results: vectors that are null, empty or zero, or hold null or
non-finite components, and rows without an id take no part; of several vectors
of an id the smallest counts; vectors of different lengths aren't compared; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _shared

DIMENSIONS, LEAF, CONFIDENCE, SEED = 16, 64, 0.9, 5
#: Vectors of a file, about, and the most cells; vectors that the top of the tree is fitted on.
CELL, MOST_CELLS, SAMPLE = 8_192, 4_096, 50_000
#: Queries of a block at most, about.
QUERIES = 256
#: Queries that walk the tree together, and vectors that a search verifies between its first tests; each next step takes as many as all before.
TOGETHER, FIRST = 128, 128


def chi_square(x: float, dimensions: int = DIMENSIONS) -> float:
    """The distribution function for an even number of dimensions."""
    term, total = 1.0, 1.0
    for i in range(1, dimensions // 2):
        term *= x / 2 / i
        total += term
    return 1 - exp(-x / 2) * total if x < 600 else 1.0


def stop_ratio(confidence: float = CONFIDENCE) -> float:
    """The ratio of squared distances at which the distribution reaches the confidence."""
    low, high = 0.0, 600.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle) < confidence else (low, middle)
    return high


def projection(size: int) -> np.ndarray:
    """The Gaussian matrix of lengthened vectors, the same for all of a length."""
    return np.random.default_rng(SEED).standard_normal((size + 1, DIMENSIONS))


def projected(x: np.ndarray, norm2: float) -> np.ndarray:
    """Projections of vectors, lengthened to the squared norm."""
    rest = np.sqrt(np.maximum(0, norm2 - (x * x).sum(axis=1)))
    return np.concatenate([x, rest[:, None]], axis=1) @ projection(x.shape[1])


@dataclass
class Top:
    """Inner nodes of the top of a tree in heap order: the dimension and the value of each split; leaves are cells."""

    dimension: np.ndarray
    value: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, levels: int) -> Top:
        dimension, value = np.zeros((1 << levels) - 1, np.int64), np.zeros((1 << levels) - 1)
        parts = {0: sample}
        for node in range(len(value)):
            p = parts.pop(node)
            if len(p):
                dimension[node] = np.ptp(p, axis=0).argmax()
                value[node] = np.median(p[:, dimension[node]])
            below = p[:, dimension[node]] < value[node]
            parts[2 * node + 1], parts[2 * node + 2] = p[below], p[~below]
        return cls(dimension, value)

    def cells(self, p: np.ndarray) -> np.ndarray:
        node, inner = np.zeros(len(p), np.int64), len(self.value)
        while inner and len(node) and node[0] < inner:
            node = 2 * node + 2 - (p[np.arange(len(p)), self.dimension[node]] < self.value[node])
        return node - inner


class Cell:
    """Vectors of one length in the order of a kd-tree over their projections; nodes are in heap order, halves of their parents."""

    def __init__(self, parts: dict[str, np.ndarray]) -> None:
        self.__dict__.update(parts)
        self.norm2, self.g = float(parts["norm2"]), projection(self.vectors.shape[1])[:-1]
        self.square = (self.points * self.points).sum(axis=1)
        #: Scaled to a length of 1 at most, in single precision: scores of these are within `slack` of the exact ones.
        self.scaled = (self.vectors / np.sqrt(self.norm2)).astype(np.float32)
        self.slack = 3e-7 * self.vectors.shape[1]
        self.levels = (len(self.low) + 1).bit_length() - 2
        self.leaf_bounds = _halves(len(self.vectors), self.levels)
        self.verified = 0

    @staticmethod
    def build(ids: np.ndarray, vectors: np.ndarray, norm2: float, keep: int) -> dict[str, np.ndarray]:
        """The parts of a cell; of equal vectors the `keep` smallest ids stay."""
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        _, first, group = np.unique(vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_index=True, return_inverse=True)
        points = projected(vectors[first].astype(np.float64), norm2)
        levels = max(0, (len(first) - 1) // LEAF).bit_length()
        at, low, high = np.arange(len(first)), [], []
        for level in range(levels + 1):
            bounds = _halves(len(first), level)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                p = points[at[a:b]]
                low.append(p.min(axis=0))
                high.append(p.max(axis=0))
                if level < levels:
                    half = (a + b) // 2 - a
                    at[a:b] = at[a:b][np.argpartition(p[:, int((high[-1] - low[-1]).argmax())], half)]
        place = np.empty(len(at), np.int64)
        place[at] = np.arange(len(at))
        group = place[group]
        by = np.argsort(group, kind="stable")
        kept = by[np.arange(len(by)) - np.searchsorted(group[by], group[by]) < keep]
        return {
            "norm2": np.array(norm2),
            "vectors": vectors[first][at].astype(np.float64),
            "points": points[at],
            "low": np.stack(low),
            "high": np.stack(high),
            "group_ids": ids[kept],
            "starts": np.searchsorted(group[kept], np.arange(len(at) + 1)),
        }

    def _reach(self, node: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Squared distances of projections from the boxes of nodes."""
        gap = np.maximum(0, np.maximum(self.low[node] - p, p - self.high[node]))
        return (gap * gap).sum(axis=-1)

    def home(self, p: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of vectors under the deepest node of at least so many on each projection's way down."""
        node, size = np.zeros(len(p), np.int64), len(self.vectors)
        begin, end = np.zeros(len(p), np.int64), np.full(len(p), size)
        for _ in range(self.levels):
            if size // 2 < least:
                break
            left = self._reach(2 * node + 1, p) <= self._reach(2 * node + 2, p)
            middle = (begin + end) // 2
            begin, end = np.where(left, begin, middle), np.where(left, middle, end)
            node, size = 2 * node + 2 - left, size // 2
        return begin, end

    def walk(self, p: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (projection, leaf) of the leaves within each projection's squared radius, down from the root."""
        which, node = np.arange(len(p)), np.zeros(len(p), np.int64)
        inside = self._reach(node, p) <= radius
        which, node = which[inside], node[inside]
        for _ in range(self.levels):
            which, node = np.concatenate([which, which]), np.concatenate([2 * node + 1, 2 * node + 2])
            inside = self._reach(node, p[which]) <= radius[which]
            which, node = which[inside], node[inside]
        order = np.lexsort((node, which))
        return which[order], node[order] - ((1 << self.levels) - 1)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, ratio: float, best: list[list[tuple[float, int]]]) -> None:
        """Puts the k best (score, id) found here and before, but for the query's own id, in best."""
        for at in range(0, len(queries), TOGETHER):
            q = queries[at : at + TOGETHER]
            size = np.sqrt((q * q).sum(axis=1))
            p, length, scaled = q @ self.g, self.norm2 + size * size, (q / size[:, None]).astype(np.float32)
            unit = size * np.sqrt(self.norm2)  # the score of one scaled
            found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.float32), np.empty(0, np.int64))] * len(q)
            last = np.array([b[-1][0] if len(b) >= k else -np.inf for b in best[at : at + TOGETHER]]) / unit
            begin, end = self.home(p, k + 2)
            for i in np.flatnonzero(last == -np.inf):
                found[i] = self._verify(np.arange(begin[i], end[i]), scaled[i], k, found[i])
                last[i] = self._last(found[i][0], k)
            radius = ratio * np.maximum(length - 2 * unit * last, 1e-12)
            which, leaf = self.walk(p, radius)
            cuts = np.searchsorted(which, np.arange(len(q) + 1))
            for i in range(len(q)):
                seen = (begin[i], end[i]) if len(found[i][0]) else (0, 0)
                radius_at = lambda x: ratio * max(length[i] - 2 * unit[i] * x, 1e-12)  # noqa: B023, E731
                found[i] = self._outward(self._inside(leaf[cuts[i] : cuts[i + 1]], seen), p[i], scaled[i], k, radius_at, last[i], found[i])
                best[at + i] = self._named(int(query_ids[at + i]), q[i], k, found[i][1], best[at + i])

    def _inside(self, leaves: np.ndarray, seen: tuple[int, int]) -> np.ndarray:
        """The vectors of leaves without a range that is verified already."""
        if len(leaves) == len(self.leaf_bounds) - 1:
            at = np.arange(len(self.vectors))
        else:
            at = np.concatenate([np.empty(0, np.int64), *(np.arange(self.leaf_bounds[j], self.leaf_bounds[j + 1]) for j in leaves)])
        return at[(at < seen[0]) | (at >= seen[1])]

    def _outward(self, at: np.ndarray, p: np.ndarray, q: np.ndarray, k: int, radius: Callable[[float], float], last: float, found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Verifies vectors in the order of their projected distance until the stopping test holds."""
        along = (self.points @ p)[at] if 2 * len(at) > len(self.points) else self.points[at] @ p
        far = self.square[at] - 2 * along + p @ p
        inside = far <= radius(last)
        at, far = at[inside], far[inside]
        order = np.argsort(far)
        at, far, done, step = at[order], far[order], 0, FIRST
        while done < len(at) and far[done] <= radius(last):
            found = self._verify(at[done : done + step], q, k, found)
            last = max(last, self._last(found[0], k))
            done, step = done + step, max(FIRST, done + step)
        return found

    def _verify(self, at: np.ndarray, q: np.ndarray, k: int, found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The best k + 1 of those found and these, and what is within rounding of the last of them, for its exact score decides."""
        self.verified += len(at)
        score = self.scaled[at] @ q
        if len(found[0]) > k:
            good = score >= self._last(found[0], k) - 2 * self.slack
            score, at = score[good], at[good]
        score, at = np.concatenate([found[0], score]), np.concatenate([found[1], at])
        if len(score) > k + 1:
            inside = score >= self._last(score, k) - 2 * self.slack
            score, at = score[inside], at[inside]
        return score, at

    @staticmethod
    def _last(score: np.ndarray, k: int) -> float:
        """The (k + 1)-th best, as the query itself may be among them; none yet: minus infinity."""
        return float(np.partition(score, len(score) - k - 1)[len(score) - k - 1]) if len(score) > k else -np.inf

    def _named(self, query_id: int, q: np.ndarray, k: int, at: np.ndarray, before: list[tuple[float, int]]) -> list[tuple[float, int]]:
        exact = (self.vectors[at] * q).sum(axis=1)
        found = [(-float(s), int(x)) for s, j in zip(exact, at, strict=True) for x in self.group_ids[self.starts[j] : self.starts[j + 1]] if x != query_id]
        found += [(-s, x) for s, x in before]
        return [(-s, x) for s, x in sorted(found)[:k]]


def _halves(n: int, level: int) -> np.ndarray:
    """Bounds of the nodes of a level over n vectors, each cut in the middle."""
    bounds = np.array([0, n])
    for _ in range(level):
        middle = (bounds[:-1] + bounds[1:]) // 2
        bounds = np.append(np.stack([bounds[:-1], middle], 1).reshape(-1), n)
    return bounds


def _save(uri: str, **parts: np.ndarray) -> None:
    out = io.BytesIO()
    np.savez(out, **parts)
    _shared.write_whole(uri, out.getvalue())


def _load(uri: str) -> dict[str, np.ndarray]:
    store, path = _shared.filesystem(uri)
    with store.open_input_stream(path) as f, np.load(io.BytesIO(f.read())) as z:
        return dict(z)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, vector, size, norm2) that take part, one for each id."""
    v = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("vector"))
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    v = v.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).where(good)
    v = v.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return v.withColumns({"size": F.size("vector"), "norm2": F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)})


def _matrix(b: pa.RecordBatch | pa.Table, size: int) -> np.ndarray:
    column = b.column("vector")
    return np.asarray((column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()).reshape(-1, size)


@dataclass
class Cells:
    """What searches know of all cells of one length of vectors: their boxes and files."""

    norm2: float
    low: np.ndarray
    high: np.ndarray
    files: list[list[str]]

    def save(self, uri: str) -> None:
        names = np.array([f for each in self.files for f in each])
        _save(uri, norm2=np.array(self.norm2), low=self.low, high=self.high, names=names, sizes=np.array([len(x) for x in self.files]))

    @classmethod
    def load(cls, uri: str) -> Cells:
        parts = _load(uri)
        names, ends = parts["names"].tolist(), np.cumsum(parts["sizes"]).tolist()
        return cls(float(parts["norm2"]), parts["low"], parts["high"], [names[a:b] for a, b in zip([0, *ends], ends, strict=False)])

    def reach(self, p: np.ndarray) -> np.ndarray:
        """Squared distances of projections (rows) from the boxes of cells (columns)."""
        out = np.zeros((len(p), len(self.files)))
        for d in range(p.shape[1]):
            x = p[:, d : d + 1]
            out += np.maximum(0, np.maximum(self.low[:, d] - x, x - self.high[:, d])) ** 2
        return out


def place(rows: DataFrame, size: int, total: int, norm2: float) -> DataFrame:
    """Rows (vec_id, vector, cell) of all vectors of one length."""
    levels = max(0, min(MOST_CELLS, -(-total // CELL)) - 1).bit_length()
    of_size = rows.where(F.col("size") == size).select("vec_id", "vector")
    drawn = of_size.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector") if levels else of_size.limit(0).select("vector")

    def shadows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(projected(_matrix(b, size), norm2).astype(np.float32)), pa.list_(pa.float32()))], ["p"])

    sample = np.array([r.p for r in drawn.mapInArrow(shadows, "p array<float>").collect()], np.float64).reshape(-1, DIMENSIONS)
    top = Top.fit(sample, levels)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(top.cells(projected(_matrix(b, size), norm2)))], ["vec_id", "vector", "cell"])

    return of_size.mapInArrow(placed, "vec_id long, vector array<double>, cell long")


def deal(rows: DataFrame, most: int, key: str) -> DataFrame:
    """Adds part, so that those of a cell and part are about `most` rows; rows of equal keys stay together."""
    counts = rows.groupBy("cell").agg(F.ceil(F.count("*") / most).alias("parts"))  # MOST_CELLS rows at most
    return rows.join(F.broadcast(counts), "cell").withColumn("part", F.pmod(F.xxhash64(key), F.col("parts"))).drop("parts")


def build_cells(placed: DataFrame, size: int, norm2: float, keep: int, folder: str) -> Cells:
    """Index all vectors of one length, given with their cells."""

    def build(group: pa.Table) -> pa.Table:
        uri = f"{folder}/{uuid.uuid4().hex}.npz"
        parts = Cell.build(np.asarray(group["vec_id"]), _matrix(group, size), norm2, keep)
        _save(uri, **parts)
        box = [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (parts["low"][0], parts["high"][0])]
        return pa.table([group["cell"][:1].combine_chunks(), pa.array([uri]), *box], ["cell", "path", "low", "high"])

    # Copies beyond those that can be found are left out before the exchange, so that a frequent vector doesn't fill a file.
    copy = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    entries = placed.withColumn("copy", copy).where(F.col("copy") <= keep).drop("copy")
    built = deal(_shared.materialize(entries, "entries"), CELL, "vector").groupBy("cell", "part").applyInArrow(build, "cell long, path string, low array<double>, high array<double>")
    found: dict[int, list] = {}
    for r in built.collect():  # a row for each file
        found.setdefault(r.cell, []).append(r)
    low, high = (np.array([side([r[name] for r in x], axis=0) for x in found.values()]) for side, name in ((np.min, "low"), (np.max, "high")))
    return Cells(norm2, low, high, [[r.path for r in x] for x in found.values()])


def write_blocks(asked: DataFrame, size: int, folder: str) -> list[str]:
    """Write queries of one length, given with their cells, as files of about QUERIES at most; their paths."""

    def run(group: pa.Table) -> pa.Table:
        uri = f"{folder}/{uuid.uuid4().hex}.npz"
        _save(uri, ids=np.asarray(group["vec_id"]), vectors=_matrix(group, size))
        return pa.table({"path": [uri]})

    return [r.path for r in deal(asked, QUERIES, "vec_id").groupBy("cell", "part").applyInArrow(run, "path string").collect()]


def search_block(queries: dict[str, np.ndarray], cells: Cells, k: int, ratio: float, load: Callable[[str], dict[str, np.ndarray]] = _load) -> tuple[list[list[tuple[float, int]]], int]:
    """The k best of each query over the cells, and how many vectors were verified; only cells that a radius reaches are loaded."""
    ids, vectors, verified = queries["ids"], queries["vectors"], 0
    best: list[list[tuple[float, int]]] = [[] for _ in ids]
    reach = cells.reach(vectors @ projection(vectors.shape[1])[:-1])
    length, last = cells.norm2 + (vectors * vectors).sum(axis=1), np.full(len(ids), -np.inf)
    for c in np.argsort(reach.mean(axis=0), kind="stable").tolist():
        for path in cells.files[c]:
            near = np.flatnonzero(reach[:, c] <= ratio * np.maximum(length - 2 * last, 1e-12))
            if not len(near):
                break
            cell, some = Cell(load(path)), [best[i] for i in near]
            cell.search(ids[near], vectors[near], k, ratio, some)
            for i, b in zip(near.tolist(), some, strict=True):
                best[i] = b
                last[i] = b[-1][0] if len(b) >= k else -np.inf
            verified += cell.verified
    return best, verified


def nearest(vectors: DataFrame, queries: str, k: int = 20, confidence: float = CONFIDENCE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row that the SQL condition `queries` on vec_id picks: query_id, rank, vec_id, score of its k nearest found."""
    spark = vectors.sparkSession
    folder = _shared.work_dir(spark, "vectors")
    rows = _shared.materialize(usable(vectors, id_col, vector_col), "vectors")
    is_query = F.count_if(F.expr(queries)).alias("asked")
    sizes = rows.groupBy("size").agg(F.count("*").alias("total"), F.max("norm2").alias("norm2"), is_query).collect()  # a row for each length of vectors
    ratio, work = stop_ratio(confidence), []
    for s in sorted(sizes):
        if s.asked:
            placed = _shared.materialize(place(rows, s["size"], s.total, s.norm2), "placed")
            listed = f"{folder}/cells-{s['size']}.npz"
            build_cells(placed, s["size"], s.norm2, k + 1, f"{folder}/cells").save(listed)
            work += [(block, listed) for block in write_blocks(placed.where(queries), s["size"], f"{folder}/queries")]
    if not work:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in b.to_pylist():
                queries = _load(w["block"])
                best, _ = search_block(queries, Cells.load(w["cells"]), k, ratio)
                for at in range(0, len(best), 1024):
                    found = [(i, x, s) for i, each in zip(queries["ids"][at : at + 1024].tolist(), best[at : at + 1024], strict=True) for s, x in each]
                    columns = list(zip(*found, strict=True)) or [(), (), ()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    tasks = _shared.spread(spark.createDataFrame(work, "block string, cells string"), len(work))
    found = tasks.mapInArrow(run, "query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_shared.read_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")
