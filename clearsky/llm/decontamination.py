"""Benchmark decontamination by latent semantic retrieval.

1. Texts become hashed words, written once; document frequencies of ``TERMS`` hashed terms
   are counted over all of them.
2. Passages are runs of two blocks of ``BLOCK`` words, one block apart, over whole texts. A
   distributed randomised SVD of their TF-IDF matrix A (never built) finds ``RANK`` latent
   directions in two passes: Z = A'(A Omega) is summed over the tasks per term, its orthonormal
   basis Q taken, then the small matrix (A Q)'(A Q) gives the directions and singular values.
   What reaches the driver are ``TERMS * RANK`` numbers, whatever the corpus.
3. Passages and benchmark items meet in the whitened latent space; a cosine of ``COSINE`` or
   more makes a candidate. Items go in blocks of ``ITEM_BLOCK`` against all passages. A bitmap of
   rare words (in fewer than a twentieth of the texts) drops candidates that share too few.
4. A candidate is checked on its words: the IDF share of the item's words found near the
   passage, the longest common subsequence, and for paraphrases (a subsequence below
   ``VERBATIM``) the *answer*, the item's last fifth, which must be there nearly whole.

Cases: null and empty texts have no passages; texts shorter than a passage are one; items
without words match nothing; empty tables give no rows; a null ``doc_id`` is reported as null,
but :func:`decontaminate` keeps rows without an id; repeated rows are reported once; further
columns are kept by :func:`decontaminate`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearsky.llm.base import fresh, slices
from clearsky.llm.words import hashed
from clearsky.session import stored

TERMS = 1 << 13
RANK = 32
BLOCK = 16
COSINE = 0.35
ITEM_BLOCK = 4096
RARE_SHARE = 0.3
VERBATIM = 0.8
PARAPHRASE = 0.6


def word_ids(texts: list) -> tuple[np.ndarray, np.ndarray]:
    words, places = hashed([t.lower() if t else t for t in texts], plain=True)
    return (words >> np.uint64(32)).astype(np.uint32), places


def hashed_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and words (32-bit ids) of each text; each task adds a row with its document frequencies."""
    kind = docs.schema[id_col].dataType.simpleString()

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often, rows = np.zeros(TERMS, dtype=np.int64), 0
        for batch in batches:
            texts, names = batch["t"].tolist(), batch["i"]
            for a, b in slices(texts):
                ids, places = word_ids(texts[a:b])
                terms = (ids % TERMS).astype(np.int64)
                owner = np.repeat(np.arange(b - a), np.diff(places))
                often += np.bincount(np.unique(owner * TERMS + terms) % TERMS, minlength=TERMS)
                rows += b - a
                parts = [ids[x:y].tobytes() for x, y in zip(places[:-1], places[1:], strict=True)]
                out = pd.DataFrame({"words": parts, "often": None, "rows": 0})
                out.insert(0, "doc_id", names.iloc[a:b].array)
                yield out
        if rows:
            out = pd.DataFrame({"words": [None], "often": [often], "rows": [rows]})
            out.insert(0, "doc_id", pd.Series([None], dtype=object))
            yield out

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInPandas(
        made, f"doc_id {kind}, words binary, often array<long>, rows long"
    )


def inverse_frequencies(hashed_docs: DataFrame) -> np.ndarray:
    counts = hashed_docs.where("often is not null")
    n = counts.agg(F.sum("rows")).first()[0] or 0
    rows = counts.select(F.posexplode("often")).groupBy("pos").agg(F.sum("col").alias("n")).toPandas()  # TERMS rows
    often = np.zeros(TERMS)
    often[rows["pos"]] = rows["n"]
    return np.log((n + 1) / (often + 1)).astype(np.float32)


class Passages:
    """The passages of several texts, as sums over two neighbouring blocks of words."""

    def __init__(self, ids: np.ndarray, places: np.ndarray) -> None:
        sizes = np.diff(places)
        blocks = -(-sizes // BLOCK)
        self.terms = (ids % TERMS).astype(np.uint16)
        self.doc = np.repeat(np.arange(len(sizes)), blocks)
        first = np.cumsum(blocks) - blocks
        self.start = np.repeat(places[:-1], blocks) + BLOCK * (np.arange(len(self.doc)) - first[self.doc])
        last = np.zeros(len(self.doc), dtype=bool)
        last[(first + blocks - 1)[blocks > 0]] = True
        alone = np.zeros(len(self.doc), dtype=bool)
        alone[first[blocks == 1]] = True
        self.begins = np.flatnonzero(~last | alone)  # blocks where a passage begins
        self.two = (~alone)[self.begins]

    def sums(self, table: np.ndarray) -> np.ndarray:
        """Sum of the table's rows over the words of each passage."""
        if not len(self.start):
            return np.zeros((0, table.shape[1]), dtype=table.dtype)
        block = np.add.reduceat(table[self.terms], self.start, axis=0)
        out = block[self.begins]
        out[self.two] += block[self.begins[self.two] + 1]
        return out

    def masks(self, of_word: np.ndarray) -> np.ndarray:
        """Bits of the words of each passage."""
        block = np.bitwise_or.reduceat(of_word, self.start, axis=0)
        out = block[self.begins]
        out[self.two] |= block[self.begins[self.two] + 1]
        return out

    def spread(self, y: np.ndarray, total: np.ndarray) -> None:
        """Transposed sum: adds the passages' rows to the row of each of their words."""
        if not len(self.start):
            return
        block = np.zeros((len(self.start), y.shape[1]), dtype=y.dtype)
        block[self.begins] += y
        block[self.begins[self.two] + 1] += y[self.two]
        of_word = np.repeat(np.arange(len(self.start)), np.diff(np.append(self.start, len(self.terms))))
        order = np.argsort(self.terms, kind="stable")
        terms = self.terms[order]
        edges = np.flatnonzero(np.append(True, terms[1:] != terms[:-1]))
        total[terms[edges]] += np.add.reduceat(block[of_word[order]], edges, axis=0)


def _batches(batch: pd.DataFrame, most: int = 1 << 16) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of rows with their words put together."""
    words = batch["words"].tolist()
    for a, b in slices(words, most * 4):
        parts = [np.frombuffer(w, np.uint32) for w in words[a:b]]
        places = np.zeros(len(parts) + 1, dtype=np.int64)
        np.cumsum([len(p) for p in parts], out=places[1:])
        yield a, b, np.concatenate(parts), places


def rare_bits(ids: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """One of 512 bits for each rare word, none for the others."""
    out = np.zeros((len(ids), 8), dtype=np.uint64)
    rare = np.flatnonzero(idf[ids % TERMS] >= min(3.0, idf.max() / 2))
    bit = ids[rare] >> np.uint32(13) & np.uint32(511)
    out[rare, bit >> np.uint32(6)] = np.uint64(1) << (bit & np.uint32(63)).astype(np.uint64)
    return out


def directions(hashed_docs: DataFrame, weight: np.ndarray, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """TERMS x rank: latent coordinates of a term, whitened by the singular values.

    ``weight`` is a term's weight in the matrix.
    """
    spark = hashed_docs.sparkSession
    words = hashed_docs.where("words is not null").select("words")
    random = np.random.default_rng(seed).standard_normal((TERMS, rank)).astype(np.float32)
    first = spark.sparkContext.broadcast(weight[:, None] * random)

    def ranged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((TERMS, rank))
        for batch in batches:
            for _, _, ids, places in _batches(batch):
                passages = Passages(ids, places)
                passages.spread(passages.sums(first.value), total)
        there = np.flatnonzero(total.any(axis=1))
        if len(there):
            yield pd.DataFrame({"term": there.astype(np.int32), "z": list(total[there].astype(np.float32))})

    partial = words.mapInPandas(ranged, "term int, z array<float>")
    summed = partial.groupBy("term").agg(F.array(*[F.sum(F.col("z")[j]) for j in range(rank)]).alias("z"))
    z = np.zeros((TERMS, rank))
    for row in summed.toLocalIterator():  # TERMS rows
        z[row.term] = row.z
    basis = np.linalg.qr(z * weight[:, None])[0].astype(np.float32)
    second = spark.sparkContext.broadcast(weight[:, None] * basis)

    def squared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((rank, rank))
        for batch in batches:
            for _, _, ids, places in _batches(batch):
                y = Passages(ids, places).sums(second.value)
                total += y.T.astype(np.float64) @ y
        yield pd.DataFrame({"row": np.arange(rank, dtype=np.int32), "g": list(total)})

    partial = words.mapInPandas(squared, "row int, g array<double>")
    rows = partial.groupBy("row").agg(F.array(*[F.sum(F.col("g")[j]) for j in range(rank)]).alias("g")).collect()
    small = np.zeros((rank, rank))
    for row in rows:  # rank rows
        small[row.row] = row.g
    values, vectors = np.linalg.eigh(small)
    scale = 1 / np.sqrt(np.maximum(values, values.max(initial=0) * 1e-9 + 1e-12))
    return (weight[:, None] * (basis @ (vectors * scale))).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def longest_common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    masks: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b.tolist():
        if mask := masks.get(w):
            hit = row & mask
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _confirmed(item: np.ndarray, region: np.ndarray, idf: np.ndarray) -> float | None:
    """Share of the item in the region's longest common subsequence, if the checks pass."""
    weight = idf[item % TERMS]
    if weight[np.isin(item, region)].sum() < PARAPHRASE * weight.sum():
        return None
    share = longest_common(item, region) / len(item)
    if share >= VERBATIM:
        return share
    answer = item[-max(3, len(item) // 5) :]
    whole = longest_common(answer, region) >= 0.9 * len(answer)
    return share if share >= PARAPHRASE and whole else None


def search(hashed_docs: DataFrame, items: list[tuple[object, str]], coordinates: np.ndarray, idf: np.ndarray, item_type: str) -> DataFrame:
    """doc_id, item_id, cosine, overlap, start, end: the best confirmed place of an item in a text."""
    ids, places = word_ids([text for _, text in items])
    words = [ids[a:b] for a, b in zip(places[:-1], places[1:], strict=True)]
    # Long items are looked up by their parts of a passage's length.
    parts = [
        (k, w[a : a + 2 * BLOCK])
        for k, w in enumerate(words)
        for a in (range(0, len(w), 2 * BLOCK) if len(w) > 4 * BLOCK else [0])
        if len(w)
    ]
    parts = [(k, words[k] if len(words[k]) <= 4 * BLOCK else w) for k, w in parts]
    latent = _unit(np.array([coordinates[w % TERMS].sum(axis=0) for _, w in parts]).reshape(len(parts), coordinates.shape[1]))
    owner = np.array([k for k, _ in parts], dtype=np.int64)
    names = [name for name, _ in items]
    bits = np.array([np.bitwise_or.reduce(rare_bits(w, idf), axis=0) for _, w in parts], dtype=np.uint64).reshape(-1, 8)
    needed = np.ceil(RARE_SHARE * np.bitwise_count(bits).sum(axis=1))
    shipped = hashed_docs.sparkSession.sparkContext.broadcast(
        (words, latent.astype(np.float32), owner, bits, needed, coordinates, idf)
    )
    kind = hashed_docs.schema["doc_id"].dataType.simpleString()

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, latent, owner, bits, needed, coordinates, idf = shipped.value
        for batch in batches:
            rows: list[tuple] = []
            for first, _, ids, places in _batches(batch):
                passages = Passages(ids, places)
                if not len(passages.begins) or not len(latent):
                    continue
                cosines = _unit(passages.sums(coordinates)) @ latent.T
                own_bits = passages.masks(rare_bits(ids, idf))
                p, q = np.nonzero(cosines >= COSINE)
                common = np.bitwise_count(own_bits[p] & bits[q]).sum(axis=1)
                close = common >= needed[q]
                for p, q in zip(p[close], q[close], strict=True):
                    item = words[owner[q]]
                    block = passages.begins[p]
                    doc, start = passages.doc[block], passages.start[block]
                    low = max(places[doc], start - len(item))
                    high = min(places[doc + 1], start + 2 * BLOCK + len(item))
                    share = _confirmed(item, ids[low:high], idf)
                    if share is not None:
                        rows.append(
                            (first + doc, int(owner[q]), float(cosines[p, q]), share, low - places[doc], high - places[doc])
                        )
            out = pd.DataFrame(rows, columns=["row", "item", "cosine", "overlap", "start", "end"])
            out = out.sort_values(["overlap", "cosine"], ascending=False).drop_duplicates(["row", "item"])
            at = out.pop("row").to_numpy(np.int64)
            out["item_id"] = [names[k] for k in out.pop("item")]
            out.insert(0, "doc_id", batch["doc_id"].iloc[at].array)
            yield out

    rows = hashed_docs.where("words is not null").select("doc_id", "words")
    return rows.mapInPandas(found, f"doc_id {kind}, item_id {item_type}, cosine double, overlap double, start long, end long")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    item_block: int = ITEM_BLOCK,
) -> DataFrame:
    """One row for each text and item found in it."""
    hashed_docs = stored(hashed_words(docs, id_col, text_col), "words")
    idf = inverse_frequencies(hashed_docs)
    coordinates = directions(hashed_docs, idf**2)  # squared: what passages share beyond their language
    item_type = benchmark.schema[item_col].dataType.simpleString()
    out, block = None, []
    rows = benchmark.select(item_col, item_text_col).where(F.col(item_text_col).isNotNull())
    for item in rows.toLocalIterator():
        block.append((item[0], item[1]))
        if len(block) == item_block:
            part = search(hashed_docs, block, coordinates, idf, item_type)
            out, block = part if out is None else out.union(part), []
    if block or out is None:
        part = search(hashed_docs, block, coordinates, idf, item_type)
        out = part if out is None else out.union(part)
    best = F.max(F.struct("overlap", "cosine", "start", "end")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows in whose text no item was found."""
    (gone,) = fresh(docs, "gone_id")
    found = contaminated(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(gone)).where(F.col(gone).isNotNull())
    return docs.join(stored(found.distinct(), "gone"), docs[id_col] == F.col(gone), "left_anti")
