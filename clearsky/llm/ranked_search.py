"""Ranked lexical search for a stated set of items over a tree of document vectors.

1. :func:`vectors` reads each whole text once and keeps its number of terms and
   its *restricted vector*: the terms that some item holds, with their counts. The
   narrow table is written once; the numbers of documents and terms and the
   document frequencies are aggregates over it.
2. Inside a task, blocks of documents become a :class:`Tree`: each vector is a path,
   the most frequent terms first, and equal beginnings share their nodes. Chains of
   single children are one node, and siblings of few documents share a leaf.
   A node holds, for every term, the greatest count below it, and the least ``m``.
3. A score grows with the counts and falls with ``m``, so both give an upper bound for
   all documents below a node. The tree is walked depth-first; an item leaves a node
   when its bound cannot reach what the item already has ten of. Items share the
   walk, each with its own bounds and its own ten best.
4. A task gives at most ``top`` rows an item; Spark ranks these.

Scores: a term's weight is ``floor(1000 ln((2N + 2) / (2 df + 1)))``, a document's ``m``
is ``100 - B + (B n N) div L`` and its score the sum of
``w ((10^9 tf) div (1000 tf + K m))`` over the item's terms, once each.

The items are the query set. They reach the tasks in groups of at most ``ITEM_TERMS``
distinct terms and ``ITEMS`` items; each group is one pass over the documents.

Cases: a null or empty text has no term and is no result; an item without terms gives
no rows; items are told apart by row, so repeated ``item_id`` give their rows each;
equal scores go by ascending ``doc_id``, nulls last; repeated rows are ranked one by
one; an empty table gives no rows; further columns are ignored; a very long text is
one row of at most ``ITEM_TERMS`` terms.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clearsky.llm.base import slices
from clearsky.session import stored

TOP = 10
B = 90
K = 8
ITEM_TERMS = 1 << 15
ITEMS = 1 << 12
BLOCK = 1 << 13
LEAF = 16
SCALE = 10**9
LAST = np.iinfo(np.int64).max

_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and other than ASCII characters, with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, terms, tfs of every document with at least one term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, len(vocabulary))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, 1 << 22):
                n = np.zeros(b - a, dtype=np.int64)
                keys = []
                for i, text in enumerate(texts[a:b]):
                    words = terms_of(text)
                    n[i] = len(words)
                    found = [x for x in map(vocabulary.get, words) if x is not None]
                    keys.append(np.array(found, dtype=np.int64) + i * size)
                distinct, tfs = np.unique(np.concatenate(keys), return_counts=True)
                some = np.flatnonzero(n)
                offsets = np.searchsorted(distinct // size, np.append(some, b - a)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a).take(pa.array(some)),
                        pa.array(n[some]),
                        pa.ListArray.from_arrays(offsets, pa.array((distinct % size).astype(np.int32))),
                        pa.ListArray.from_arrays(offsets, pa.array(tfs.astype(np.int32))),
                    ],
                    ["doc_id", "n", "terms", "tfs"],
                )

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Tree:
    """Vectors of a block of documents as a trie of frequency-ordered paths.

    ``bounds`` cut ``flat`` (places of terms by frequency, ascending in each document)
    and ``tfs`` into documents.
    """

    def __init__(self, ids: np.ndarray, m: np.ndarray, bounds: np.ndarray, flat: np.ndarray, tfs: np.ndarray, width: int):
        keys = flat.astype(">u4").tobytes()
        paths = [keys[4 * a : 4 * b] for a, b in zip(bounds, bounds[1:])]
        order = np.array(sorted(range(len(ids)), key=paths.__getitem__), dtype=np.int64)
        lengths = np.diff(bounds)[order]
        self.ids, self.m = ids[order], m[order]
        self.bounds = np.concatenate(([0], np.cumsum(lengths)))
        at = np.arange(self.bounds[-1]) + np.repeat(bounds[order] - self.bounds[:-1], lengths)
        self.flat, self.tfs, self.width = flat[at], tfs[at], width
        self._grow(self._shared())

    def _shared(self) -> np.ndarray:
        """How many first terms each document shares with the one before."""
        out = np.zeros(len(self.ids), dtype=np.int64)
        bounds, flat = self.bounds.tolist(), self.flat
        for i in range(1, len(out)):
            a, b, c = bounds[i - 1 : i + 2]
            n = min(b - a, c - b)
            differs = flat[a : a + n] != flat[b : b + n]
            first = int(differs.argmax()) if n else 0
            out[i] = first if n and differs[first] else n
        return out

    def _grow(self, shared: np.ndarray) -> None:
        """Nodes in depth-first order: (first document, end, parent)."""
        self.nodes: list[tuple[int, int, int]] = []
        self.children: list[list[int]] = []
        todo = [(0, len(self.ids), -1)]
        while todo:
            a, b, parent = todo.pop()
            at = len(self.nodes)
            self.nodes.append((a, b, parent))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(at)
            if b - a > LEAF:
                inner = shared[a + 1 : b]
                cuts = [a, *(np.flatnonzero(inner == inner.min()) + a + 1).tolist(), b]
                parts, start = [], a
                for end, after in zip(cuts[1:], [*cuts[2:], None]):
                    if after is None or after - start > LEAF:
                        parts.append((start, end, at))
                        start = end
                todo += reversed(parts)
        self.most = np.zeros((len(self.nodes), self.width), dtype=np.int32)
        self.least = np.zeros(len(self.nodes), dtype=np.int64)
        self.first_id = np.zeros(len(self.nodes), dtype=np.int64)
        for at in range(len(self.nodes) - 1, -1, -1):
            a, b, _ = self.nodes[at]
            self.least[at], self.first_id[at] = self.m[a:b].min(), self.ids[a:b].min()
            if self.children[at]:
                self.most[at] = self.most[self.children[at]].max(axis=0)
            else:
                x, y = self.bounds[a], self.bounds[b]
                np.maximum.at(self.most[at], self.flat[x:y], self.tfs[x:y])

    def rows(self, a: int, b: int) -> np.ndarray:
        """Counts of documents a to b, one row each."""
        out = np.zeros((b - a, self.width), dtype=np.int64)
        x, y = self.bounds[a], self.bounds[b]
        out[np.repeat(np.arange(b - a), np.diff(self.bounds[a : b + 1])), self.flat[x:y]] = self.tfs[x:y]
        return out


class Best:
    """The best documents of each item so far, and the branch and bound that finds them."""

    def __init__(self, places: np.ndarray, weights: np.ndarray, starts: np.ndarray, top: int):
        self.places, self.weights, self.starts, self.top = places, weights, starts, top
        self.scores = np.zeros((len(starts), top), dtype=np.int64)
        self.ids = np.full((len(starts), top), LAST, dtype=np.int64)
        self.visited = self.scored = 0

    def totals(self, counts: np.ndarray, m) -> np.ndarray:
        """Scores of all items for each row of counts."""
        parts = (SCALE * counts) // (1000 * counts + K * m)
        return np.add.reduceat(parts[..., self.places] * self.weights, self.starts, axis=-1)

    def walk(self, tree: Tree) -> None:
        todo = [(0, np.arange(len(self.starts)))]
        while todo:
            at, active = todo.pop()
            self.visited += 1
            bound = self.totals(tree.most[at].astype(np.int64), tree.least[at])[active]
            worst = self.scores[active, -1]
            may = (bound > worst) | ((bound == worst) & (bound > 0) & (tree.first_id[at] <= self.ids[active, -1]))
            active = active[may]
            if not len(active):
                continue
            if tree.children[at]:
                todo += [(child, active) for child in reversed(tree.children[at])]
            else:
                self._score(tree, at, active)

    def _score(self, tree: Tree, at: int, active: np.ndarray) -> None:
        a, b, _ = tree.nodes[at]
        self.scored += (b - a) * len(active)
        found = self.totals(tree.rows(a, b), tree.m[a:b, None])[:, active]
        better = (found.max(axis=0) > 0) & (found.max(axis=0) >= self.scores[active, -1])
        for column in np.flatnonzero(better):
            item = active[column]
            some = np.flatnonzero(found[:, column] > 0)
            scores = np.concatenate((self.scores[item], found[some, column]))
            ids = np.concatenate((self.ids[item], tree.ids[a:b][some]))
            kept = np.lexsort((ids, -scores))[: self.top]
            self.scores[item], self.ids[item] = scores[kept], ids[kept]


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    waiting, rows = [], 0
    for batch in batches:
        waiting.append(batch)
        rows += len(batch)
        if rows >= size:
            yield pa.Table.from_batches(waiting)
            waiting, rows = [], 0
    if rows:
        yield pa.Table.from_batches(waiting)


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _search(
    docs: DataFrame, items: list[tuple[object, set[bytes]]], item_type: str, top: int, id_col: str, text_col: str
) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {term: k for k, term in enumerate(sorted(set().union(*(terms for _, terms in items))))}
    kept = stored(vectors(docs, vocabulary, id_col, text_col), "vectors")
    n_docs, n_terms = kept.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = dict(kept.select(F.explode("terms").alias("term")).groupBy("term").count().collect())

    # Terms by falling frequency; those without weight change no score.
    weight = {k: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held.get(k, 0) + 1))) for k in range(len(vocabulary))}
    order = sorted((k for k in held if weight[k] > 0), key=lambda k: (-held[k], k))
    place = np.full(len(vocabulary), -1, dtype=np.int64)
    place[order] = np.arange(len(order))
    of_items = [sorted(k for t in terms if place[k := vocabulary[t]] >= 0) for _, terms in items]
    live = [i for i, ks in enumerate(of_items) if ks]
    ks = np.array([k for i in live for k in of_items[i]], dtype=np.int64)
    starts = np.cumsum([0, *(len(of_items[i]) for i in live)])[:-1]
    places, weights, width = place[ks], np.array([weight[k] for k in ks.tolist()], dtype=np.int64), len(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not live:
            return
        best = Best(places, weights, starts, top)
        for block in _blocks(batches, BLOCK):
            lengths = block.column("terms").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lengths)), lengths)
            at, tfs = place[_flat(block.column("terms"))], _flat(block.column("tfs"))
            row, at, tfs = row[at >= 0], at[at >= 0], tfs[at >= 0]
            by_path = np.lexsort((at, row))
            bounds = np.searchsorted(row, np.arange(len(lengths) + 1))
            m = 100 - B + (B * block.column("n").to_numpy() * n_docs) // n_terms
            ids = block.column("doc_id").combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False)
            best.walk(Tree(ids, m, bounds, at[by_path], tfs[by_path], width))
        item, nth = np.nonzero(best.scores)
        found = best.ids[item, nth]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.array(live, dtype=np.int32)[item]),
                pa.array(found, mask=found == LAST),
                pa.array(best.scores[item, nth]),
            ],
            ["nth_item", "doc_id", "score"],
        )

    ranked = Window.partitionBy("nth_item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    rows = (
        kept.select("doc_id", "n", "terms", "tfs")
        .mapInArrow(run, "nth_item int, doc_id long, score long")
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= top)
    )
    named = spark.createDataFrame([(i, items[i][0]) for i in live], f"nth_item int, item_id {item_type}")
    return rows.join(F.broadcast(named), "nth_item").select("item_id", "rank", "doc_id", "score")


def search(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``top`` highest-scoring documents with a score above 0."""
    kind = items.schema[item_col].dataType.simpleString()
    groups: list[list[tuple[object, set[bytes]]]] = [[]]
    held: set[bytes] = set()
    for name, text in items.select(item_col, item_text_col).toLocalIterator():
        terms = set(terms_of(text))
        if groups[-1] and (len(held | terms) > ITEM_TERMS or len(groups[-1]) >= ITEMS):
            groups.append([])
            held = set()
        groups[-1].append((name, terms))
        held |= terms
    return reduce(DataFrame.unionByName, (_search(docs, g, kind, top, id_col, text_col) for g in groups))
