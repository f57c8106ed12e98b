"""Boosted trees for several classes at once, grown from histograms of gradients.

Features are cut into bins once, and the training rows become blocks of small integers, one or
more per partition, with the scores that the trees so far give them. A round grows one
tree per class. Each level of all of them is one job: the blocks sum gradients and
curvatures per (tree, node, feature, bin), the sums are added up across blocks in groups of
features, each group names its best cut, and the driver keeps one cut per node. So what
is shuffled per level is as wide as nodes, features and bins, whatever the number of rows, and what
the driver sees is a row per node and group of features.

The loss is the cross-entropy of softmax scores: one model whose probabilities sum to 1.
Rows are sampled per round and columns per tree, both by hashes of numbers, so a block that is made
again draws the same. Scores are kept with the blocks; every ``CHECKPOINT`` rounds they are written to
the shared folder, so that a lost executor repeats few rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearsky.functions.scalars import argmax
from clearsky.operators.prep import balanced_weights
from clearsky.session import shared_folder

BINS = 64
CHECKPOINT = 25
BLOCK_ROWS = 1 << 16
FEATURE_GROUP = 64


@dataclass
class Tree:
    """Nodes by number, children of ``i`` at ``2i + 1`` and ``2i + 2``; ``feature`` is -1 in leaves."""

    feature: np.ndarray
    cut: np.ndarray  # the last bin that goes left
    value: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n))

    def places(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node each row stands in after so many levels."""
        at = np.zeros(len(bins), dtype=np.int64)
        rows = np.arange(len(bins))
        for _ in range(levels):
            f = self.feature[at]
            right = bins[rows, np.maximum(f, 0)] > self.cut[at]
            at = np.where(f < 0, at, 2 * at + 1 + right)
        return at


@dataclass
class BoostedTrees:
    """A fitted model: bin edges per feature and one tree per round and class."""

    classes: list
    edges: np.ndarray  # features x (BINS - 1)
    start: np.ndarray
    trees: list[list[Tree]]
    depth: int

    def binned(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, dtype=np.uint8)
        for j, edges in enumerate(self.edges):
            out[:, j] = np.searchsorted(edges, x[:, j], side="left")
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        scores = np.tile(self.start, (len(x), 1))
        for round_ in self.trees:
            for k, tree in enumerate(round_):
                scores[:, k] += tree.value[tree.places(bins, self.depth)]
        return _softmax(scores)

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
        at = argmax(F.col("y_prob"))
        if self.classes == list(range(len(self.classes))):
            return scored.withColumn("y_pred", at)
        return scored.withColumn("y_pred", F.get(F.array(*[F.lit(c) for c in self.classes]), at))


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _chosen(seed: int, numbers: np.ndarray, share: float) -> np.ndarray:
    """A fixed draw: which of these numbers are taken."""
    x = numbers.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).astype(np.float64) / 2.0**64 < share


def bin_edges(df: DataFrame, features: str, width: int, bins: int = BINS) -> np.ndarray:
    """Quantiles of every feature from mergeable sketches: ``width * (bins - 1)`` numbers reach the driver."""
    names = [f"_{i}" for i in range(width)]
    flat = df.select(*[F.get(features, F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])
    found = flat.approxQuantile(names, [k / bins for k in range(1, bins)], 1.0 / (4 * bins))
    return np.array([q if q else [0.0] * (bins - 1) for q in found])


def _all_but(gain: float) -> float:
    return gain - 1e-9 * (1 + abs(gain)) if np.isfinite(gain) else gain


def _best_cut(sums: np.ndarray, penalty: float, least: float) -> tuple[float, int, int, np.ndarray, np.ndarray]:
    """gain, feature in its group, last bin to the left, sums of the left part and of all."""
    left = sums.cumsum(axis=1)[:, :-1]
    total = sums.sum(axis=1)[:, None]
    right = total - left

    def worth(s: np.ndarray) -> np.ndarray:
        return s[..., 0] ** 2 / (s[..., 1] + penalty)

    gain = worth(left) + worth(right) - worth(total)
    gain[(left[..., 1] < least) | (right[..., 1] < least)] = -np.inf
    # Equal cuts of few rows differ by rounding only: the first of them is taken.
    f, b = np.unravel_index(np.argmax(gain >= _all_but(gain.max())), gain.shape)
    return float(gain[f, b]), int(f), int(b), left[f, b], total[f, 0]


def fit_boosted_trees(
    train: DataFrame,
    label: str,
    features: str = "features",
    rounds: int = 400,
    depth: int = 6,
    rate: float = 0.05,
    rows_share: float = 0.8,
    columns_share: float = 0.8,
    penalty: float = 1.0,
    least_weight: float = 1.0,
    seed: int = 42,
) -> BoostedTrees:
    """Class-balanced boosting; the labels' values are the classes. ``features`` is an array of one length, without nulls."""
    spark = train.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark, "checkpoints"))
    weighted = balanced_weights(train.select(label, F.col(features).alias("_x")), label).select(label, "weight", "_x")
    sizes = dict(train.groupBy(label).count().collect())  # a row per class
    if not sizes:
        raise ValueError("no rows to learn from")
    classes = sorted(sizes)
    parts = -(-sum(sizes.values()) // BLOCK_ROWS)
    width = weighted.select(F.size("_x")).first()[0]
    model = BoostedTrees(classes, bin_edges(weighted, "_x", width), np.zeros(len(classes)), [], depth)
    class_of = {c: k for k, c in enumerate(classes)}

    def blocks(part: int, rows: Iterator) -> Iterator[tuple]:
        """number of the first row, bins, class, weight, scores."""
        waiting: list = []
        number = part << 40

        def block() -> tuple:
            x = np.array([r["_x"] for r in waiting], dtype="float64")
            y = np.array([class_of[r[label]] for r in waiting])
            w = np.array([r["weight"] for r in waiting], dtype="float64")
            return number, model.binned(x), y, w, np.zeros((len(y), len(classes)))

        for row in rows:
            waiting.append(row)
            if len(waiting) == BLOCK_ROWS:
                yield block()
                number += len(waiting)
                waiting = []
        if waiting:
            yield block()

    data = weighted.repartition(parts).rdd.mapPartitionsWithIndex(blocks).persist(StorageLevel.MEMORY_AND_DISK)
    before = None
    for r in range(rounds):
        trees = [Tree.empty(depth) for _ in classes]
        columns = [np.flatnonzero(_chosen(seed + 7919 * (r * len(classes) + k) + 1, np.arange(width), columns_share)) for k in range(len(classes))]
        columns = [c if len(c) else np.arange(width) for c in columns]
        live = [[0] for _ in classes]
        for level in range(depth):

            def summed(block: tuple, trees=trees, columns=columns, live=live, level=level, r=r) -> Iterator[tuple]:
                number, bins, y, w, scores = block
                p = _softmax(scores)
                taken = _chosen(seed + 104729 * r, number + np.arange(len(y)), rows_share)
                for k, tree in enumerate(trees):
                    at = tree.places(bins, level)
                    for node in live[k]:
                        mine = np.flatnonzero(taken & (at == node))
                        if not len(mine):
                            continue
                        g = w[mine] * (p[mine, k] - (y[mine] == k))
                        h = w[mine] * np.maximum(2 * p[mine, k] * (1 - p[mine, k]), 1e-12)
                        for start in range(0, len(columns[k]), FEATURE_GROUP):
                            group = columns[k][start : start + FEATURE_GROUP]
                            cells = (bins[np.ix_(mine, group)] + np.arange(len(group)) * BINS).ravel()
                            sums = [np.bincount(cells, np.repeat(v, len(group)), len(group) * BINS) for v in (g, h)]
                            yield (k, node, start), np.stack(sums, axis=-1).reshape(len(group), BINS, 2)

            cuts = (
                data.flatMap(summed)
                .reduceByKey(np.add, min(parts, len(classes) * 2**level))
                .mapValues(lambda sums: _best_cut(sums, penalty, least_weight))
                .collect()
            )
            if before is not None:  # this round's scores are there now
                before.unpersist()
                before = None
            best: dict[tuple[int, int], tuple] = {}
            for (k, node, start), (gain, f, b, left, total) in sorted(cuts, key=lambda c: c[0]):
                if (k, node) not in best or _all_but(gain) > best[k, node][0]:
                    best[k, node] = (gain, int(columns[k][start + f]), b, left, total)
            live = [[] for _ in classes]
            for (k, node), (gain, f, b, left, total) in best.items():
                tree = trees[k]
                if node == 0:
                    tree.value[0] = -rate * total[0] / (total[1] + penalty)
                if gain > 1e-9:
                    tree.feature[node], tree.cut[node] = f, b
                    for child, s in ((2 * node + 1, left), (2 * node + 2, total - left)):
                        tree.value[child] = -rate * s[0] / (s[1] + penalty)
                        live[k].append(child)
            if not any(live):
                break

        def moved(block: tuple, trees=trees) -> tuple:
            number, bins, y, w, scores = block
            steps = [tree.value[tree.places(bins, depth)] for tree in trees]
            return number, bins, y, w, scores + np.stack(steps, axis=1)

        model.trees.append(trees)
        last = r == rounds - 1
        if not last:
            before, data = data, data.map(moved).persist(StorageLevel.MEMORY_AND_DISK)
            if (r + 1) % CHECKPOINT == 0:
                data.checkpoint()
    data.unpersist()
    return model
