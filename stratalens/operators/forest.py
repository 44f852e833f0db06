"""Random forest of regression trees on small codes of the features.

A histogram of every node that each partition of the rows sends costs more than the rows as soon as trees are deep. Here
trees are dealt out instead: a task streams the stored codes once, in batches, into a scratch file that it maps, and grows
some trees over it, one after another. Nothing is shuffled and no table goes through the driver; a task's memory holds a
chunk, one tree's histograms and some bytes per drawn row, and time grows with rows times trees over cores, up to a core
per tree. What a tree looks like depends on the rows' ids, the seed and the tree's number alone, not on partitions or on
which trees share a task.
"""

from __future__ import annotations

import contextlib
import itertools
import sys
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from math import ceil, exp, factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle, inheritable_thread_target
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need not find this file

#: Intervals of a feature's values that splits tell apart, and values of a chunk that the intervals are read off.
BINS, POINTS = 32, 2048
#: Trees of a task, and rows that are drawn and sorted, and summed up, at once, few enough for the processor's caches.
TASK_TREES, CHUNK_ROWS, SUM_ROWS = 7, 1 << 18, 1 << 11
_NODES = {"feature": np.int16, "left": np.int32, "threshold": float, "value": float, "gain": float}
_STORED = "features int, score string, number int, feature array<int>, left array<int>, threshold array<double>, value array<double>, gain array<double>"


@dataclass
class Growth:
    """How trees grow: split ``features`` by codes down to ``depth``, ``tried`` of them per node, on rows drawn ``share`` times each on average."""

    features: int
    depth: int
    tried: int
    min_leaf: int
    share: float
    seed: int


@dataclass
class Tree:
    """Nodes, the root first, children side by side: ``feature`` -1 where there is no split, codes up to ``code`` go to node ``left``, others to the next."""

    feature: np.ndarray
    code: np.ndarray
    gain: np.ndarray
    value: np.ndarray
    left: np.ndarray | None = None

    def packed(self) -> Tree:
        """From arrays by place, the children of place i at 2 i + 1 and 2 i + 2, only the nodes that there are."""
        split = np.flatnonzero(self.feature >= 0)
        places = np.sort(np.concatenate([[0], 2 * split + 1, 2 * split + 2]))
        left = np.where(self.feature[places] >= 0, np.searchsorted(places, 2 * places + 1), 0).astype(np.int32)
        return Tree(self.feature[places], self.code[places], self.gain[places], self.value[places], left)


def cuts(rows: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """Per feature at most ``BINS`` - 1 of its values: each value but the last of a feature with few, else those at even shares of all rows.

    Every row is read. Sorted chunks leave a task as ``POINTS`` of their values, so a share is met to 1 / ``POINTS``; the points of a feature are merged in
    one group.
    """

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
            if held and (batch is None or sum(x.num_rows for x in held) >= CHUNK_ROWS):
                for j in range(len(features)):
                    x = np.concatenate([b.column(j).to_numpy(zero_copy_only=False) for b in held])
                    x = np.sort(x[~np.isnan(x)])
                    at = np.unique(np.linspace(0, len(x) - 1, POINTS).astype(np.int64)) if len(x) else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([len(x)], pa.int64()), pa.array([x[at]], pa.list_(pa.float64()))], ["feature", "n", "points"])
                held = []

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        values = np.concatenate(group["points"].to_list())
        weights = np.concatenate([np.full(len(x), n / max(1, len(x))) for n, x in zip(group["n"], group["points"])])
        distinct = np.unique(values)
        if len(distinct) > BINS:
            order = np.argsort(values, kind="stable")
            reached = np.cumsum(weights[order])
            distinct = np.unique(values[order][np.searchsorted(reached, reached[-1] * np.arange(1, BINS) / BINS)])
        else:
            distinct = distinct[:-1]
        return pd.DataFrame({"feature": group["feature"].iloc[:1], "cuts": [distinct]})

    found = rows.select(*[F.col(f).cast("double") for f in features]).mapInArrow(points, "feature int, n long, points array<double>")
    by = {r["feature"]: r["cuts"] for r in found.groupBy("feature").applyInPandas(merged, "feature int, cuts array<double>").collect()}
    return [np.array(by.get(j, []), dtype=float) for j in range(len(features))]


def coded(rows: DataFrame, features: Sequence[str], label: str, at: Sequence[np.ndarray]) -> DataFrame:
    """Stored (first, labels, codes) of some thousand rows each: the first row's id, and of each row the label and a byte per feature, the
    number of cuts below the value; ``rows`` without NULL. Read back a few at a time, whatever the session's batch size."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.empty((batch.num_rows, len(at)), np.uint8)
            for j, cut in enumerate(at):
                codes[:, j] = np.searchsorted(cut, batch.column(j + 1).to_numpy(zero_copy_only=False))
            labels = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([labels.tobytes()]), pa.array([codes.tobytes()])], ["first", "labels", "codes"])
            first += batch.num_rows

    spark, schema = rows.sparkSession, "first long, labels binary, codes binary"
    path = f"{shared_folder(spark).rstrip('/')}/codes-{uuid.uuid4().hex}"
    rows.select(F.col(label).cast("double"), *[F.col(f).cast("double") for f in features]).mapInArrow(code, schema).write.parquet(path)
    few = spark.newSession()
    few.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    few.conf.set("spark.sql.parquet.columnarReaderBatchSize", "16")
    return few.read.schema(schema).parquet(path)


def _draws(share: float) -> np.ndarray:
    """Sixteen-bit limits: a row whose hash reaches the first k of them is drawn k times, by Poisson's law."""
    reached = np.cumsum([exp(-share) * share**k / factorial(k) for k in range(24)])
    limits = np.round(reached * 65536)
    return limits[limits < 65536].astype(np.uint16)


def _hashed(ids: np.ndarray, seed: int, number: int) -> np.ndarray:
    """Sixteen even bits of each row for a tree; ``ids`` of 32 bits."""
    x = ids ^ np.random.SeedSequence([seed, number]).generate_state(1)[0]
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    x >>= np.uint32(16)
    return x.astype(np.uint16)


def _held(batches: Iterator[pa.RecordBatch], features: int) -> tuple[np.ndarray, ...]:
    """ids (mixed to 32 bits), labels and codes of all rows, mapped from files that are gone when the arrays are."""
    kinds = (np.uint32, float, np.uint8)
    with contextlib.ExitStack() as stack:
        files = [stack.enter_context(tempfile.TemporaryFile()) for _ in kinds]
        for batch in batches:
            for first, labels, codes in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                ids = np.arange(first, first + len(labels.as_buffer()) // 8)
                for file, x in zip(files, ((ids ^ (ids >> 40) * 0x9E3779B1).astype(np.uint32), labels.as_buffer(), codes.as_buffer())):
                    file.write(x)
        for file in files:
            file.flush()
        ids, labels, codes = (np.asarray(np.memmap(file, kind, "r")) for file, kind in zip(files, kinds))
    return ids, labels, codes.reshape(-1, features)


class _Growing:
    """One tree. A chunk of the table keeps its drawn rows in open nodes: their places, how often they are drawn, and the node's rank among the open ones."""

    def __init__(self, grow: Growth, number: int, ids: np.ndarray, labels: np.ndarray, codes: np.ndarray) -> None:
        self.grow, self.number, self.labels, self.codes = grow, number, labels, codes
        size = 2 ** (grow.depth + 1) - 1
        self.tree = Tree(np.full(size, -1, np.int16), np.full(size, 255, np.uint8), np.zeros(size), np.zeros(size))
        self.open = np.zeros(1, np.int64)
        limits = _draws(grow.share)
        self.held = [self._drawn(ids[a : a + CHUNK_ROWS], limits) for a in range(0, len(ids), CHUNK_ROWS)]

    def _drawn(self, ids: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, ...]:
        hashed = _hashed(ids, self.grow.seed, self.number)
        times = np.zeros(len(ids), np.uint8)
        for limit in limits:
            times += hashed >= limit
        rows = np.flatnonzero(times)
        return rows.astype(np.int32), times.take(rows), np.zeros(len(rows), np.uint16)

    def grown(self) -> Tree:
        for level in range(self.grow.depth):
            if not len(self.open):
                break
            tried = self._tried(level)
            sums = np.zeros(tried.size * BINS, complex)
            cells = np.arange(0, tried.size * BINS, BINS).reshape(tried.shape)
            for k in range(len(self.held)):
                if level:
                    self._descend(k)
                self._add(k, tried, cells, sums)
            self._split(tried, sums.reshape(*tried.shape, BINS))
        return self.tree

    def _tried(self, level: int) -> np.ndarray:
        """The features that each open node looks at, drawn by the node's place."""
        every = np.tile(np.arange(self.grow.features), (2**level, 1))
        drawn = np.random.default_rng([self.grow.seed, self.number, level]).permuted(every, axis=1)[:, : self.grow.tried]
        return np.sort(drawn, axis=1)[self.open - (2**level - 1)]

    def _descend(self, k: int) -> None:
        """Rows of chunk ``k`` go to their child node, rows of a node together; those in closed nodes are left out."""
        rows, times, slots = self.held[k]
        codes = self.codes[k * CHUNK_ROWS : (k + 1) * CHUNK_ROWS].ravel()
        right = codes.take(rows * np.int64(self.grow.features) + self.split_feature.take(slots)) > self.split_code.take(slots)
        slots = self.children.take(slots * 2 + right.astype(np.int64))
        kept = np.flatnonzero(slots >= 0)
        slots = slots.take(kept).astype(np.uint16 if len(self.open) <= 1 << 16 else np.int64)
        order = np.argsort(slots, kind="stable")
        kept = kept.take(order)
        self.held[k] = rows.take(kept), times.take(kept), slots.take(order)

    def _add(self, k: int, tried: np.ndarray, cells: np.ndarray, sums: np.ndarray) -> None:
        """Adds chunk ``k`` to ``sums``: per open node, tried feature and code the drawn rows (real) and their labels (imaginary)."""
        rows, times, slots = self.held[k]
        codes, labels = (x[k * CHUNK_ROWS : (k + 1) * CHUNK_ROWS] for x in (self.codes, self.labels))
        width = self.grow.features
        for a in range(0, len(rows), SUM_ROWS):
            part, slot = rows[a : a + SUM_ROWS], slots[a : a + SUM_ROWS]
            values = np.empty(len(part), complex)
            values.real = times[a : a + SUM_ROWS]
            values.imag = values.real * labels.take(part)
            places = tried.take(slot, axis=0)
            places += np.arange(0, len(part) * width, width)[:, None]
            at = cells.take(slot, axis=0)
            at += codes.take(part, axis=0).ravel().take(places)
            np.add.at(sums, at.ravel(), np.repeat(values, tried.shape[1]))

    def _split(self, tried: np.ndarray, sums: np.ndarray) -> None:
        """Splits each open node where that lowers the squared error most with at least ``min_leaf`` drawn rows on each side; children with rows for a split are open next."""
        tree, least, nodes = self.tree, self.grow.min_leaf, np.arange(len(self.open))
        left = sums.cumsum(axis=2)
        total, left = left[:, :1, -1:], left[:, :, :-1]
        right = total - left
        with np.errstate(divide="ignore", invalid="ignore"):
            before = total.imag**2 / total.real
            gain = left.imag**2 / left.real + right.imag**2 / right.real - before
        gain[~((left.real >= least) & (right.real >= least))] = -np.inf
        best = gain.reshape(len(nodes), -1).argmax(axis=1)
        rank, code = best // (BINS - 1), best % (BINS - 1)
        if self.open[0] == 0 and total[0, 0, 0].real:
            tree.value[0] = total[0, 0, 0].imag / total[0, 0, 0].real
        real = gain[nodes, rank, code] > 1e-12 * before[:, 0, 0]
        nodes, rank, code, place = nodes[real], rank[real], code[real], self.open[real]
        tree.feature[place], tree.code[place], tree.gain[place] = tried[nodes, rank], code, gain[nodes, rank, code]
        sides = np.stack([left[nodes, rank, code], right[nodes, rank, code]], axis=1)
        places = np.stack([2 * place + 1, 2 * place + 2], axis=1)
        tree.value[places] = sides.imag / sides.real
        growing = (sides.real >= 2 * least) & (places < 2**self.grow.depth - 1)
        slots = np.full(places.shape, -1)
        slots[growing] = np.arange(growing.sum())
        self.children = np.full((len(self.open), 2), -1)
        self.children[real] = slots
        self.split_feature, self.split_code = np.maximum(tree.feature[self.open], 0).astype(np.int64), tree.code[self.open]
        self.open = places[growing]


def grown(data: DataFrame, grow: Growth, trees: int) -> list[Tree]:
    """The trees 0, 1, ... over stored ``coded`` rows, as many tasks at once as there are cores."""
    spark = data.sparkSession
    at_once = max(1, spark.sparkContext.defaultParallelism)
    size = max(1, min(TASK_TREES, ceil(trees / at_once)))

    @inheritable_thread_target(spark)
    def some(first: int) -> list[Tree]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = _held(batches, grow.features)
            for number in range(first, min(first + size, trees)):
                tree = _Growing(grow, number, *held).grown().packed()
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in vars(tree).values()], list(vars(tree)))

        found = data.coalesce(1).mapInArrow(run, "feature binary, code binary, gain binary, value binary, left binary").toArrow()
        return [Tree(*(np.frombuffer(x, kind) for x, kind in zip(row.values(), (np.int16, np.uint8, float, float, np.int32)))) for row in found.to_pylist()]

    with ThreadPoolExecutor(at_once) as pool:
        return [tree for own in pool.map(some, range(0, trees, size)) for tree in own]


@dataclass
class Forest:
    """Grown trees with the values of their splits; reads the column ``vector``, and has the names of Spark ML's forest models."""

    features: int
    score: str
    feature: list[np.ndarray]
    left: list[np.ndarray]
    threshold: list[np.ndarray]
    value: list[np.ndarray]
    gain: list[np.ndarray]

    @classmethod
    def of(cls, trees: Sequence[Tree], at: Sequence[np.ndarray], score: str) -> Forest:
        thresholds = [np.array([at[f][c] if f >= 0 else np.nan for f, c in zip(tree.feature, tree.code)]) for tree in trees]
        return cls(len(at), score, [tree.feature for tree in trees], [tree.left for tree in trees], thresholds, [tree.value for tree in trees], [tree.gain for tree in trees])

    @property
    def getNumTrees(self) -> int:  # noqa: N802
        return len(self.feature)

    def getPredictionCol(self) -> str:  # noqa: N802
        return self.score

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        """Shares of each tree's lowered squared error by feature, averaged over the trees."""
        total = np.zeros(self.features)
        for feature, gain in zip(self.feature, self.gain):
            if gain.sum() > 0:
                total += np.bincount(np.maximum(feature, 0), gain, self.features) / gain.sum()
        return DenseVector(total / (total.sum() or 1.0))

    @property
    def toDebugString(self) -> str:  # noqa: N802
        lines = [f"{self.getNumTrees} trees on {self.features} features"]
        for i, feature in enumerate(self.feature):
            splits = [f"{n}: x{feature[n]} <= {self.threshold[i][n]:g}" for n in np.flatnonzero(feature >= 0)]
            lines.append(f"tree {i}: " + ("; ".join(splits) or f"{self.value[i][0]:g}"))
        return "\n".join(lines)

    def transform(self, df: DataFrame) -> DataFrame:
        trees = list(zip(self.feature, self.left, self.threshold, self.value))

        @F.pandas_udf("double")
        def mean(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series(dtype=float)
            x = np.vstack(vectors.to_numpy())
            starts, flat, total = np.arange(0, x.size, x.shape[1]), x.ravel(), np.zeros(len(x))
            for feature, left, threshold, value in trees:
                node, going = np.zeros(len(x), np.int64), np.arange(len(x))
                while len(going := going[feature[node[going]] >= 0]):
                    at = node[going]
                    node[going] = left[at] + ~(flat[starts[going] + feature[at]] <= threshold[at])
                total += value[node]
            return pd.Series(total / len(trees))

        return df.withColumn(self.score, mean(vector_to_array("vector")))

    def save(self, spark: SparkSession, path: str) -> None:
        """One row per tree."""
        nodes = [[x.tolist() for x in getattr(self, c)] for c in _NODES]
        spark.createDataFrame([(self.features, self.score, *row) for row in zip(range(len(self.feature)), *nodes)], _STORED).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        rows = spark.read.schema(_STORED).parquet(path).orderBy("number").collect()
        return cls(rows[0]["features"], rows[0]["score"], *[[np.array(r[c], kind) for r in rows] for c, kind in _NODES.items()])
