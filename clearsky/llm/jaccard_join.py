"""Exact n-gram Jaccard self-join in size-banded tiles.

Two documents link when the distinct word shingles of both share at least
``percent`` of a hundred of their union. The steps:

1. Documents of equal shingle sets form one *node*. A node has its set's size, a
   hashed bitmap of two to four bits a shingle (a power of two), and a
   prefix: the shingles that come first in one fixed order, so many that two linked
   nodes share one. The order puts shingles rare in the whole corpus first; its
   counts live in ``1 << 20`` hashed places, whatever the corpus.
2. A *tile* is all nodes with the same prefix shingle, in order of size. Only sizes
   within the band ``percent`` of each other can link, and only if their first shared shingle
   leaves both enough shingles after it.
3. First, each node proposes ``PROPOSALS`` partners: of the ``REACH`` nodes before it in each tile
   those whose bitmaps allow most overlap; exact sorted-array intersection decides. Linked nodes form
   components.
4. Then tiles compare all nodes of *different* components: bits set on one side only
   bound the overlap from above, and pairs within the bound are intersected exactly.
   Groups of copies are mostly one component by then and give few pairs.
5. Components of all links, by alternating hooking and shortcutting.

Step 4 has no reach or cap, so no link between different components is lost; components are exact.
Node numbers are 64 bits of a digest; a second digest is compared and a clash stops
the job with an error.

Cases: null texts, empty texts and blanks have an empty set and link with nothing; fewer
words than a shingle give their whole sequence as one; a null ``doc_id`` gives a component
only its non-null members' smallest id; repeated rows are one node and each give a row; an
empty table gives no rows; further columns are kept by :func:`one_of_each` and ignored by
:func:`components`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearsky.llm.base import fresh, slices
from clearsky.llm.words import sets
from clearsky.session import stored

WORDS = 5
PERCENT = 80
PLACES = 1 << 20
REACH = 256
PROPOSALS = 3
LARGE_TILE = 2048
BLOCK_PAIRS = 1 << 19
BLOCK_BYTES = 1 << 23


def frequencies(docs: DataFrame, k: int, text_col: str = "text") -> np.ndarray:
    """Documents per hashed place of the shingles, for places well above a task's mean; else 0."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(PLACES, dtype=np.int64)
        for batch in batches:
            texts = batch["t"].tolist()
            for a, b in slices(texts):
                found = np.concatenate(sets(texts[a:b], k))
                total += np.bincount((found & np.uint64(PLACES - 1)).astype(np.int64), minlength=PLACES)
        there = np.flatnonzero(total >= 8 + 4 * total.mean())
        yield pd.DataFrame({"place": there.astype(np.int32), "n": total[there]})

    partial = docs.select(F.col(text_col).alias("t")).mapInPandas(counted, "place int, n long")
    rows = partial.groupBy("place").agg(F.sum("n").alias("n")).toPandas()  # PLACES rows at most
    out = np.zeros(PLACES, dtype=np.uint32)
    out[rows["place"]] = np.minimum(rows["n"], (1 << 20) - 1)
    return out


def bitmap(found: np.ndarray) -> np.ndarray:
    width = 64
    while width < 2 * len(found):
        width *= 2
    bits = np.zeros(width, dtype=bool)
    bits[(found & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits)


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    while len(bits) > size:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def signatures(docs: DataFrame, k: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, node, proof, bits, prefix of each row (the last four null for an empty set)."""
    kind = docs.schema[id_col].dataType.simpleString()
    often = docs.sparkSession.sparkContext.broadcast(frequencies(docs, k, text_col))

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["t"].tolist()
            for a, b in slices(texts):
                rows = []
                for found in sets(texts[a:b], k):
                    n = len(found)
                    if not n:
                        rows.append((0, None, None, None, None))
                        continue
                    place = (found & np.uint64(PLACES - 1)).astype(np.int64)
                    order = (often.value[place].astype(np.uint64) << np.uint64(43)) | (found >> np.uint64(21))
                    least = n + percent * n // -100 + 1
                    node, proof = np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), "<i8")
                    prefix = np.sort(np.partition(order, least - 1)[:least]).view(np.int64)
                    rows.append((n, node, proof, bitmap(found).tobytes(), prefix))
                out = pd.DataFrame(rows, columns=["n_shingles", "node", "proof", "bits", "prefix"])
                out["node"] = pd.array([r[1] for r in rows], dtype="Int64")
                out["proof"] = pd.array([r[2] for r in rows], dtype="Int64")
                out.insert(0, "doc_id", batch["i"].iloc[a:b].array)
                yield out

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInPandas(
        signed, f"doc_id {kind}, n_shingles long, node long, proof long, bits binary, prefix array<long>"
    )


def nodes_of(signed: DataFrame) -> DataFrame:
    """One row per distinct set: node, doc_id (the smallest), n, bits, prefix."""
    clash = F.min("proof") != F.max("proof")
    return (
        signed.where("node is not null")
        .groupBy("node")
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.min("n_shingles").alias("n"),
            F.first("bits").alias("bits"),
            F.first("prefix").alias("prefix"),
            F.when(clash, F.raise_error(F.lit("two sets share a digest")).cast("boolean")).otherwise(True).alias("ok"),
        )
        .where("ok")
        .drop("ok")
    )


def tiles_of(nodes: DataFrame, percent: int) -> DataFrame:
    """tile, pos, node, n: rows that could be the first shared shingle with another row of the tile."""

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _by_whole_tiles(batches):
            tile, pos, n = (frame[c].to_numpy() for c in ("tile", "pos", "n"))
            stays = np.zeros(len(n), dtype=bool)
            for x, y in pairs_in_tiles(tile, pos, n, np.arange(len(n)), percent, REACH):
                stays[x] = stays[y] = True
            # Beyond the reach nothing is known of a row, so it stays.
            far = np.flatnonzero(tile[REACH:] == tile[: max(0, len(tile) - REACH)])
            stays[far] = stays[far + REACH] = True
            yield frame[stays]

    rows = nodes.select(F.posexplode("prefix").alias("pos", "tile"), "node", "n").select("tile", "pos", "node", "n")
    sorted_rows = rows.repartition("tile").sortWithinPartitions("tile", "n", "node")
    return sorted_rows.mapInPandas(met, rows.schema)


def _least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """Smallest overlap that links sets whose sizes add up to ``n``."""
    return -(-percent * n // (100 + percent))


def _bound(bits: np.ndarray, n: int, others: np.ndarray, other_n: np.ndarray) -> np.ndarray:
    """The most that the overlap can be: a bit set on one side only stands for a shingle of that side only."""
    mine = n - np.bitwise_count(bits & ~others).sum(axis=1, dtype=np.int64)
    theirs = other_n - np.bitwise_count(others & ~bits).sum(axis=1, dtype=np.int64)
    return np.minimum(mine, theirs)


def margins(bits: list, n: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Most possible overlap less the least that links, for rows ``x`` with smaller (or equal) rows ``y``."""
    out = np.empty(len(x), dtype=np.int64)
    widths = np.fromiter(map(len, bits), dtype=np.int64, count=len(bits))
    for w in np.unique(widths[y]):
        at = np.flatnonzero(widths[y] == w)
        used = np.unique(np.concatenate([x[at], y[at]]))
        rows = np.array([folded(np.frombuffer(bits[k], np.uint8), w) for k in used]).view(np.uint64)
        step = max(1, BLOCK_BYTES // int(w))
        for k in range(0, len(at), step):
            pair = at[k : k + step]
            mine, theirs = rows[np.searchsorted(used, x[pair])], rows[np.searchsorted(used, y[pair])]
            a = n[x[pair]] - np.bitwise_count(mine & ~theirs).sum(axis=1, dtype=np.int64)
            b = n[y[pair]] - np.bitwise_count(theirs & ~mine).sum(axis=1, dtype=np.int64)
            out[pair] = np.minimum(a, b) - _least_overlap(n[x[pair]] + n[y[pair]], percent)
    return out


def pairs_in_tiles(tile: np.ndarray, pos: np.ndarray, n: np.ndarray, group: np.ndarray, percent: int, reach: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows x and smaller rows y of one tile, of different groups, that can link with this shingle as their first.

    Sizes must lie in the band, and after the first shared shingle both prefixes must leave enough.
    They come in blocks of about ``BLOCK_PAIRS``, so that a tile of any size takes bounded memory.
    """
    xs, ys, held = [], [], 0
    x, d = np.arange(len(tile)), 0
    while len(x) and (reach is None or d < reach):
        d += 1
        x = x[x >= d]
        # Rows lie by size: beyond the band at one distance, beyond it at all greater ones.
        x = x[(tile[x] == tile[x - d]) & (n[x - d] * 100 >= percent * n[x])]
        y = x - d
        most = np.minimum(n[x] - pos[x], n[y] - pos[y])
        apart = (group[x] != group[y]) & (most >= _least_overlap(n[x] + n[y], percent))
        xs.append(x[apart])
        ys.append(y[apart])
        held += len(xs[-1])
        if held >= BLOCK_PAIRS:
            yield np.concatenate(xs), np.concatenate(ys)
            xs, ys, held = [], [], 0
    if held:
        yield np.concatenate(xs), np.concatenate(ys)


def compare_tile(node: np.ndarray, pos: np.ndarray, n: np.ndarray, group: np.ndarray, bits: list, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a tile (rows by size) from different groups that size band and bitmaps allow, in blocks."""
    kinds, sizes = np.unique(group, return_counts=True)
    if len(kinds) == 1:
        return
    largest = kinds[np.argmax(sizes)] if sizes.max() * 2 > len(node) else None
    widths = np.fromiter(map(len, bits), dtype=np.int64, count=len(bits))
    matrix = {w: np.frombuffer(b"".join(bits[i] for i in np.flatnonzero(widths == w)), np.uint8).reshape(-1, w) for w in np.unique(widths)}
    row_of = np.empty(len(node), dtype=np.int64)
    for w in matrix:
        row_of[widths == w] = np.arange((widths == w).sum())
    xs, ys, held = [], [], 0
    for r in np.flatnonzero(group != largest) if largest is not None else range(1, len(node)):
        low = np.searchsorted(n, -(-percent * n[r] // 100), side="left")
        # Members of the largest group are not walked themselves, so look beyond this row for them.
        high = np.searchsorted(n, n[r] * 100 // percent, side="right") if largest is not None else r
        others = np.arange(low, high)
        most = np.minimum(n[r] - pos[r], n[others] - pos[others])
        fits = (group[others] != group[r]) & (most >= _least_overlap(n[others] + n[r], percent))
        if largest is not None:
            fits &= (others < r) | (group[others] == largest)
        others = others[fits]
        for w in np.unique(widths[others]):
            some = others[widths[others] == w]
            width = min(w, widths[r])
            mine = folded(matrix[widths[r]][row_of[r]], width)
            theirs = matrix[w][row_of[some]]
            while theirs.shape[1] > width:
                half = theirs.shape[1] // 2
                theirs = theirs[:, :half] | theirs[:, half:]
            ok = _bound(mine, n[r], theirs, n[some]) >= _least_overlap(n[some] + n[r], percent)
            xs.append(np.full(ok.sum(), node[r]))
            ys.append(node[some[ok]])
            held += len(xs[-1])
        if held >= BLOCK_PAIRS:
            yield np.concatenate(xs), np.concatenate(ys)
            xs, ys, held = [], [], 0
    if held:
        yield np.concatenate(xs), np.concatenate(ys)


def _by_whole_tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same rows, cut so that no tile lies in two frames."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        tile = batch["tile"].to_numpy()
        cut = int(np.searchsorted(tile != tile[-1], False)) if tile[0] == tile[-1] else int(np.flatnonzero(tile != tile[-1])[-1]) + 1
        if held and held[-1]["tile"].iloc[-1] != tile[0]:
            yield pd.concat(held, ignore_index=True)
            held = []
        if cut:
            yield pd.concat([*held, batch.iloc[:cut]], ignore_index=True)
            held = []
        held.append(batch.iloc[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


def _in_tiles(tiles: DataFrame, nodes: DataFrame) -> DataFrame:
    rows = tiles.join(nodes.select("node", "bits"), "node")
    return rows.repartition("tile").sortWithinPartitions("tile", "n", "node")


def proposals(tiles: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """a, b: for each node b the most promising node a within reach; ``PROPOSALS`` rows per node at most."""

    def proposed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _by_whole_tiles(batches):
            tile, pos, node, n = (frame[c].to_numpy() for c in ("tile", "pos", "node", "n"))
            bits = frame["bits"].tolist()
            best = pd.DataFrame({"margin": [], "a": [], "b": []}, dtype=np.int64)
            for x, y in pairs_in_tiles(tile, pos, n, np.arange(len(n)), percent, REACH):
                margin = margins(bits, n, x, y, percent)
                ok = margin >= 0
                more = pd.DataFrame({"margin": margin[ok], "a": node[y[ok]], "b": node[x[ok]]})
                best = pd.concat([best, more]).sort_values(["margin", "a"], ascending=False)
                best = best.drop_duplicates(["a", "b"]).groupby("b").head(PROPOSALS)
            yield best

    found = _in_tiles(tiles, nodes).mapInPandas(proposed, "margin long, a long, b long")
    # A node's prefix bounds its proposals before the best are taken.
    best = F.slice(F.sort_array(F.collect_set(F.struct("margin", "a")), asc=False), 1, PROPOSALS)
    tops = found.groupBy("b").agg(best.alias("tops")).select("b", F.explode("tops").alias("top"))
    return tops.select(F.col("top.a").alias("a"), "b")


def across_groups(tiles: DataFrame, nodes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """a, b: all pairs of a tile in different components that size band and bitmaps allow."""
    grouped = tiles.join(labels, "node", "left")
    grouped = grouped.withColumn("group", F.coalesce("root", "node")).drop("root")
    mixed = grouped.groupBy("tile").agg(F.min("group").alias("g"), F.max("group").alias("h")).where("g < h")
    rows = _in_tiles(grouped.join(mixed, "tile", "left_semi"), nodes)

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _by_whole_tiles(batches):
            tile, pos, node, n, group = (frame[c].to_numpy() for c in ("tile", "pos", "node", "n", "group"))
            bits = frame["bits"].tolist()
            edges = np.append(np.flatnonzero(np.append(True, tile[1:] != tile[:-1])), len(tile))
            large = np.repeat(np.diff(edges) > LARGE_TILE, np.diff(edges))
            small = np.flatnonzero(~large)
            for x, y in pairs_in_tiles(tile[small], pos[small], n[small], group[small], percent, None):
                x, y = small[x], small[y]
                pair = pd.DataFrame({"a": np.minimum(node[x], node[y]), "b": np.maximum(node[x], node[y])})
                once = np.flatnonzero(~pair.duplicated().to_numpy())
                yield pair.iloc[once[margins(bits, n, x[once], y[once], percent) >= 0]]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a > LARGE_TILE:
                    for u, v in compare_tile(node[a:b], pos[a:b], n[a:b], group[a:b], bits[a:b], percent):
                        yield pd.DataFrame({"a": np.minimum(u, v), "b": np.maximum(u, v)})

    return rows.mapInPandas(compared, "a long, b long").distinct()


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs that link: exact intersection of sorted arrays, made again from the texts.

    Only texts of a candidate's id are read; the list of ids is a stored table, so that Spark
    knows its size when it chooses between a broadcast and a shuffle of the texts.
    """
    either = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = stored(nodes.join(either, "node", "left_semi").select("node", F.col("doc_id").alias("wanted_id")), "wanted")
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(
        wanted, F.col("i").eqNullSafe(F.col("wanted_id")), "left_semi"
    )

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["t"].tolist()
            for a, b in slices(texts):
                rows = []
                for found in sets(texts[a:b], k):
                    raw = found.tobytes()
                    rows.append((np.frombuffer(hashlib.blake2b(raw, digest_size=16).digest(), "<i8")[0], raw))
                yield pd.DataFrame(rows, columns=["node", "shingles"])

    made = texts.mapInPandas(again, "node long, shingles binary").join(wanted, "node", "left_semi").dropDuplicates(["node"])
    made = stored(made, "shingles")

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    a = made.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    b = made.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(a, "a").join(b, "b").where(linked("x", "y")).select("a", "b")


def connected(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for all nodes with a link but the roots.

    Large and small stars in turn; each round is aggregated before it is joined and
    written to the shared folder, and the distance to the root shrinks by a constant factor.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, before = stored(edges, "edges"), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        edges = stored(small.where("u <> v").distinct(), "edges")


def components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of each row."""
    signed = stored(signatures(docs, k, percent, id_col, text_col), "signed")
    all_nodes = nodes_of(signed)
    nodes = stored(all_nodes.drop("prefix"), "nodes")
    tiles = stored(tiles_of(all_nodes, percent), "tiles")
    proposed = stored(proposals(tiles, nodes, percent), "proposed")
    first = stored(verified(proposed, nodes, docs, k, percent, id_col, text_col), "links")
    rest = stored(across_groups(tiles, nodes, connected(first), percent), "across")
    second = verified(rest, nodes, docs, k, percent, id_col, text_col)
    labels = connected(stored(first.union(second), "links"))

    of_node = nodes.select("node", "doc_id").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = of_node.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    found = of_node.join(least, "root").select("node", "component_id")
    return signed.join(found, "node", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the smallest id of each component, with all its columns.

    Rows without an id stay, since nothing tells them apart; rows with one id are one document.
    """
    (gone,) = fresh(docs, "gone_id")
    found = components(docs, k, percent, id_col, text_col)
    kept = found.where("doc_id = component_id").select("doc_id")
    lost = found.where("doc_id <> component_id").select("doc_id").join(kept, "doc_id", "left_anti")
    lost = stored(lost.distinct().withColumnRenamed("doc_id", gone), "gone")
    return docs.join(lost, docs[id_col] == F.col(gone), "left_anti")

