"""Random forests for classes, grown from histograms while nodes are large and whole where they fit a task.

Features are cut into bins once, and the training rows become blocks of small integers. How often
a tree draws a row (Poisson, a bootstrap sample) follows from seed, tree and block, so any
task that holds the block knows it. A tree grows in two steps:

1. While a node may hold more than ``LOCAL_BYTES`` of rows, each level of all trees is one job:
   blocks count classes per (tree, node, feature, bin), the counts are added up, and the driver
   keeps one cut per node.
2. The nodes that are left are dealt over tasks, each of which gets the rows its nodes need (once,
   however many trees draw them) and grows them to the end, a level of a node's subtree at a time.

So no histogram is shuffled for the many small nodes deep in a tree, and what is shuffled in step 2 grows
with rows and tasks, not with the number of trees, as long as whole trees fit a task. A node
keeps its counts per class; the class weights turn them into shares.

Every tree is held as compressed bytes. Tasks that score unpack one tree at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearsky.functions.scalars import argmax
from clearsky.operators.boosting import bin_edges
from clearsky.operators.prep import balanced_weights
from clearsky.session import checkpoint_folder

BINS = 32
BLOCK_ROWS = 1 << 13
LOCAL_BYTES = 48 << 20  # rows of one task that grows subtrees
CELLS = 1 << 21  # of a histogram at a time
TASKS_A_CORE = 3
LEAF, OPEN = -1, -2


@dataclass
class Piece:
    """Nodes level by level: the children of the i-th inner node are ``2i + 1`` and ``2i + 2``.

    ``feature`` is ``LEAF`` in leaves and ``OPEN`` where another piece goes on.
    """

    feature: np.ndarray
    cut: np.ndarray  # the last bin that goes left
    counts: np.ndarray  # leaves x classes

    def places(self, bins: np.ndarray) -> np.ndarray:
        """The node each row ends in."""
        inner = self.feature >= 0
        left = 2 * (np.cumsum(inner) - 1) + 1
        at = np.zeros(len(bins), dtype=np.int64)
        going = np.arange(len(bins)) if inner[0] else np.arange(0)
        while len(going):
            node = at[going]
            at[going] = left[node] + (bins[going, self.feature[node]] > self.cut[node])
            going = going[inner[at[going]]]
        return at

    def packed(self) -> bytes:
        parts = (self.feature.astype("<i4"), self.cut.astype("u1"), self.counts.astype("<u4"))
        return zlib.compress(len(self.feature).to_bytes(8, "little") + b"".join(p.tobytes() for p in parts), 1)

    @staticmethod
    def unpacked(data: bytes, classes: int) -> Piece:
        raw = zlib.decompress(data)
        n = int.from_bytes(raw[:8], "little")
        feature = np.frombuffer(raw, "<i4", n, 8)
        cut = np.frombuffer(raw, "u1", n, 8 + 4 * n)
        return Piece(feature, cut, np.frombuffer(raw, "<u4", -1, 8 + 5 * n).reshape(-1, classes))


@dataclass
class Forest:
    """A fitted forest. ``tops`` has one piece per tree, ``rest`` the pieces below by tree and node."""

    edges: list[np.ndarray]  # per feature
    weights: np.ndarray  # per class
    tops: list[bytes]
    rest: list[dict[int, bytes]]
    importances: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        """Mean share of each feature in the trees' loss of impurity, as Spark's forest gives it."""
        return DenseVector(self.importances)

    def getCacheNodeIds(self) -> bool:  # noqa: N802
        """As Spark's forest says it: rows keep the node they have reached, they never walk from the root again."""
        return True

    def binned(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, dtype=np.uint8)
        for j, edges in enumerate(self.edges):
            out[:, j] = np.searchsorted(edges, x[:, j], side="left")
        return out

    def _shares(self, counts: np.ndarray) -> np.ndarray:
        weighted = counts * self.weights
        return weighted / weighted.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        bins, k = self.binned(x), len(self.weights)
        total = np.zeros((len(x), k))

        def add(data: bytes, rows: np.ndarray, below: dict[int, bytes]) -> None:
            piece = Piece.unpacked(data, k)
            at = piece.places(bins[rows])
            leaf = np.cumsum(piece.feature == LEAF) - 1
            done = piece.feature[at] == LEAF
            if len(piece.counts):
                total[rows[done]] += self._shares(piece.counts)[leaf[at[done]]]
            for node in np.unique(at[~done]):
                add(below[int(node)], rows[at == node], {})

        for top, below in zip(self.tops, self.rest, strict=True):
            add(top, np.arange(len(x)), below)
        return total / total.sum(axis=1, keepdims=True)

    def score(self, df: DataFrame, features: str = "features") -> DataFrame:
        """``y_pred`` and ``y_prob`` of each row."""
        model = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def probability(rows: pd.Series) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype="object")
            x = np.stack([np.asarray(r, dtype="float64") for r in rows])
            return pd.Series(list(model.value.probabilities(x)))

        scored = df.withColumn("y_prob", probability(F.col(features).cast("array<double>")))
        return scored.withColumn("y_pred", argmax(F.col("y_prob")))


def feature_edges(df: DataFrame, features: str, width: int, bins: int = BINS) -> list[np.ndarray]:
    """Where each feature is cut: between its values where they are at most ``bins``, else at its quantiles.

    Tasks list up to ``bins + 1`` values of a feature, so ``width * bins`` numbers at most reach the driver.
    """

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: list[np.ndarray] = [np.zeros(0)] * width
        for pdf in batches:
            x = np.stack([np.asarray(r, dtype="float64") for r in pdf["x"]]) if len(pdf) else np.zeros((0, width))
            for j in range(width):
                if len(seen[j]) <= bins:
                    seen[j] = np.unique(np.concatenate([seen[j], x[:, j]]))[: bins + 1]
        yield pd.DataFrame({"j": np.repeat(np.arange(width), [len(s) for s in seen]), "v": np.concatenate(seen)})

    listed = df.select(F.col(features).alias("x")).mapInPandas(values, "j int, v double").distinct().groupBy("j")
    few = listed.agg(F.count(F.lit(1)).alias("n"), F.collect_set("v").alias("v")).where(F.col("n") <= bins).collect()
    edges = [np.unique(q) for q in bin_edges(df, features, width, bins)]
    for r in few:
        v = np.sort(r["v"])
        edges[r["j"]] = (v[:-1] + v[1:]) / 2
    return edges


def _drawn(seed: int, tree: int, number: int, n: int) -> np.ndarray:
    """How often a tree draws each row of a block."""
    return np.random.default_rng([seed, tree, number]).poisson(1.0, n)


def _columns(seed: Sequence[int], nodes: int, width: int, tried: int) -> np.ndarray:
    """The features that each of some nodes tries, in order."""
    order = np.random.default_rng(seed).random((nodes, width))
    return np.sort(np.argpartition(order, tried - 1, axis=1)[:, :tried], axis=1)


def _worth(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weight of the rows less their Gini impurity."""
    weighted = counts * weights
    total = weighted.sum(axis=-1)
    return (weighted * weighted).sum(axis=-1) / np.where(total > 0, total, 1.0)


def _best_cuts(counts: np.ndarray, weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gain, last bin to the left and counts of the left part, for counts by (node, bin, class)."""
    left = counts.cumsum(axis=1)
    total = left[:, -1:, :]
    left = left[:, :-1, :]
    right = total - left
    gain = _worth(left, weights) + _worth(right, weights) - _worth(total, weights)
    gain[(left.sum(axis=2) < least) | (right.sum(axis=2) < least)] = -np.inf
    at = gain.argmax(axis=1)
    nodes = np.arange(len(gain))
    return gain[nodes, at], at, left[nodes, at]


def _histogram(node: np.ndarray, bins: np.ndarray, y: np.ndarray, times: np.ndarray, nodes: int, classes: int) -> np.ndarray:
    cells = (node * BINS + bins) * classes + y
    return np.bincount(cells, times, nodes * BINS * classes).reshape(nodes, BINS, classes)


def grown(
    bins: np.ndarray, y: np.ndarray, times: np.ndarray, weights: np.ndarray, depth: int, least: int, tried: int, seed: Sequence[int]
) -> tuple[Piece, np.ndarray]:
    """The whole tree of some rows, drawn so often, and its loss of impurity per feature."""
    classes, width = len(weights), bins.shape[1]
    rows = np.flatnonzero(times)
    y, times = y.astype(np.int64), times.astype(np.float64)
    node = np.zeros(len(rows), dtype=np.int64)
    counts = np.bincount(y[rows], times[rows], classes)[None, :]
    features, cuts, leaves, lost = [], [], [], np.zeros(width)
    for level in range(depth + 1):
        splits = np.full(len(counts), LEAF)
        cut = np.zeros(len(counts), dtype=np.int64)
        lower = np.zeros((len(counts), classes))
        live = np.flatnonzero((counts.sum(axis=1) >= 2 * least) & ((counts > 0).sum(axis=1) > 1)) if level < depth else np.arange(0)
        if len(live):
            rank = np.full(len(counts), -1)
            rank[live] = np.arange(len(live))
            rows, at = rows[rank[node] >= 0], rank[node][rank[node] >= 0]  # in order of nodes
            columns = _columns([*seed, level], len(live), width, tried)
            size = max(1, CELLS // (BINS * classes))
            for first in range(0, len(live), size):
                last = min(first + size, len(live))
                low, high = np.searchsorted(at, [first, last])
                mine, place = rows[low:high], at[low:high] - first
                best = np.zeros(last - first)
                for slot in range(tried):
                    tried_here = columns[first:last, slot]
                    hist = _histogram(place, bins[mine, tried_here[place]], y[mine], times[mine], last - first, classes)
                    gain, where, left = _best_cuts(hist, weights, least)
                    better = np.flatnonzero(gain > np.maximum(best + 1e-12, 1e-9))
                    best[better] = gain[better]
                    to = live[first + better]
                    splits[to], cut[to], lower[to] = tried_here[better], where[better], left[better]
                np.add.at(lost, splits[live[first:last]].clip(0), best)
            node = live[at]
        inner = splits >= 0
        features.append(splits)
        cuts.append(cut)
        leaves.append(counts[~inner])
        if not inner.any():
            break
        going = inner[node]
        rows, node = rows[going], node[going]
        child = 2 * (np.cumsum(inner) - 1)[node] + (bins[rows, splits[node]] > cut[node])
        order = np.argsort(child, kind="stable")
        rows, node = rows[order], child[order]
        counts = np.stack([lower[inner], counts[inner] - lower[inner]], axis=1).reshape(-1, classes)
    return Piece(np.concatenate(features), np.concatenate(cuts), np.concatenate(leaves)), lost


class _Top:
    """The large nodes of a tree while it is grown on the driver, one cut per node."""

    def __init__(self) -> None:
        self.feature, self.cut, self.counts = [OPEN], [0], []
        self.depth = {0: 0}

    def piece(self, classes: int) -> Piece:
        return Piece(np.array(self.feature), np.array(self.cut), np.zeros((0, classes)))


def fit_forest(
    train: DataFrame, label: str, features: str = "features", trees: int = 500, depth: int = 30, least_rows: int = 5, seed: int = 42
) -> Forest:
    """Class-balanced forest: each node tries the root of the number of features; labels are 0, 1, ...

    ``features`` is an array of one length, without nulls.
    """
    spark = train.sparkSession
    context = spark.sparkContext
    checkpoint_folder(spark)
    rows = balanced_weights(train.select(label, F.col(features).cast("array<double>").alias("_x")), label).persist(StorageLevel.MEMORY_AND_DISK)
    sizes = {int(r[label]): (r["n"], r["w"]) for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.first("weight").alias("w")).collect()}
    if not sizes:
        raise ValueError("no rows to learn from")
    if min(sizes) < 0:
        raise ValueError("labels must be 0 or more")
    classes = max(sizes) + 1
    weights = np.array([sizes[c][1] if c in sizes else 0.0 for c in range(classes)])
    total = sum(n for n, _ in sizes.values())
    width = rows.select(F.size("_x")).first()[0]
    tried = int(np.ceil(np.sqrt(width)))
    local_rows = max(1, LOCAL_BYTES // (width + 8))
    model = Forest(feature_edges(rows, "_x", width), weights, [], [])

    def blocks(part: int, found: Iterator) -> Iterator[tuple]:
        """number, bins, class."""
        waiting: list = []
        number = part << 32

        def block() -> tuple:
            x = np.array([r["_x"] for r in waiting], dtype="float64")
            return number, model.binned(x), np.array([r[label] for r in waiting], dtype=np.int32)

        for row in found:
            waiting.append(row)
            if len(waiting) == BLOCK_ROWS:
                yield block()
                number += 1
                waiting = []
        if waiting:
            yield block()

    # Written once: a draw belongs to a place in a block, so a block must stay as it is.
    data = rows.select(label, "_x").repartition(-(-total // BLOCK_ROWS)).rdd.mapPartitionsWithIndex(blocks).persist(StorageLevel.MEMORY_AND_DISK)
    data.checkpoint()
    data.count()
    rows.unpersist()

    tops = [_Top() for _ in range(trees)]
    live = [[0] if total > local_rows and depth > 0 else [] for _ in range(trees)]
    lost = np.zeros((trees, width))
    while any(live):
        pieces = {t: tops[t].piece(classes) for t in range(trees) if live[t]}

        def counted(block: tuple, pieces=pieces, live=live) -> Iterator[tuple]:
            number, bins, y = block
            for t, piece in pieces.items():
                times, at = _drawn(seed, t, number, len(y)), piece.places(bins)
                for node in live[t]:
                    mine = np.flatnonzero((at == node) & (times > 0))
                    if len(mine):
                        slots = np.tile(np.arange(tried), len(mine))
                        chosen = bins[np.ix_(mine, _columns([seed, t, node, 1], 1, width, tried)[0])].ravel()
                        yield (t, node), _histogram(slots, chosen, y[mine].repeat(tried), times[mine].repeat(tried), tried, classes)

        def cut_of(item: tuple) -> tuple:
            (t, node), counts = item
            gain, where, left = _best_cuts(counts, weights, least_rows)
            slot = int(gain.argmax())
            feature = int(_columns([seed, t, node, 1], 1, width, tried)[0][slot])
            return t, node, float(gain[slot]), feature, int(where[slot]), float(left[slot].sum()), float(counts[0].sum())

        wide = max(1, min(sum(map(len, live)), context.defaultParallelism * TASKS_A_CORE))
        cuts = sorted(data.flatMap(counted).reduceByKey(np.add, wide).map(cut_of).collect())
        live = [[] for _ in range(trees)]
        for t, node, gain, feature, where, left, rows_here in cuts:
            top = tops[t]
            if gain <= 1e-9:
                continue  # stays open: its task finds the same and makes it a leaf
            top.feature[node], top.cut[node] = feature, where
            lost[t, feature] += gain
            for n in (left, rows_here - left):
                child = len(top.feature)
                top.feature.append(OPEN)
                top.cut.append(0)
                top.depth[child] = top.depth[node] + 1
                if n > local_rows and top.depth[child] < depth:
                    live[t].append(child)

    pieces = [top.piece(classes) for top in tops]
    units = [(t, int(node)) for t, piece in enumerate(pieces) for node in np.flatnonzero(piece.feature == OPEN)]
    whole = len(units) == trees  # no tree was begun: tasks take all rows, and several trees each
    tasks = max(1, min(len(units), context.defaultParallelism * TASKS_A_CORE)) if whole else len(units)
    dealt = [units[task::tasks] for task in range(tasks)]
    parts = tasks if whole else max(context.defaultParallelism * TASKS_A_CORE, -(-total * trees // local_rows))

    def wanted(block: tuple) -> Iterator[tuple]:
        number, bins, y = block
        if whole:
            yield from ((task, (number, len(y), None, bins, y)) for task in range(tasks))
            return
        task = 0
        for t, piece in enumerate(pieces):
            at, times = piece.places(bins), _drawn(seed, t, number, len(y))
            for node in np.flatnonzero(piece.feature == OPEN):
                mine = np.flatnonzero((at == node) & (times > 0))
                if len(mine):
                    yield task, (number, len(y), mine, bins[mine], y[mine])
                task += 1

    def finished(items: Iterator[tuple]) -> Iterator[tuple]:
        held: dict[int, list] = {}
        for task, block in items:
            held.setdefault(task, []).append(block)
        for task, found in sorted(held.items()):
            found.sort(key=lambda b: b[0])
            bins, y = np.concatenate([b[3] for b in found]), np.concatenate([b[4] for b in found])
            for t, node in dealt[task]:
                draws = [(_drawn(seed, t, number, n), mine) for number, n, mine, _, _ in found]
                times = np.concatenate([d if mine is None else d[mine] for d, mine in draws])
                piece, gains = grown(bins, y, times, weights, depth - tops[t].depth[node], least_rows, tried, [seed, t, node])
                yield t, node, piece.packed(), gains

    done = data.flatMap(wanted).partitionBy(parts).mapPartitions(finished).collect()
    data.unpersist()
    model.tops = [piece.packed() for piece in pieces]
    model.rest = [{} for _ in range(trees)]
    for t, node, piece, gains in done:
        model.rest[t][node] = piece
        lost[t] += gains
    for t, node in units:  # a tree may draw no row at all: all classes weigh the same there
        if node not in model.rest[t]:
            model.rest[t][node] = Piece(np.array([LEAF]), np.array([0]), np.ones((1, classes))).packed()
    shares = lost / np.where(lost.sum(axis=1, keepdims=True) > 0, lost.sum(axis=1, keepdims=True), 1.0)
    model.importances = shares.sum(axis=0) / max(shares.sum(), 1e-300)
    return model
