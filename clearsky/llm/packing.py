"""Best-fit packing of tokenised documents by exact-complement hashing.

1. :func:`pieces` tokenises whole texts where they lie, cuts only documents
   longer than ``capacity`` (the *first* piece is the short one) and numbers the
   pieces of each length inside their task. The narrow table is written once.
2. The number of pieces of each length - ``capacity`` numbers, whatever the
   data - reaches the driver. :func:`plan` packs these numbers: from the longest
   length down it looks up, in hashed sums of one, two and three lengths, a
   combination that fills the gap exactly and consumes it as often as the
   available numbers allow; what is left goes best-fit, again by numbers.
3. The plan, a list of rank ranges per length, goes to the tasks. Its size is
   bounded: each step uses up a length or a kind of gap.

A piece's rank within its length is the number of such pieces in earlier tasks
plus its number inside the task: no group of equal lengths is sorted or gathered.

Cases: a null or empty text is the single end token; a null ``doc_id`` is carried
through; repeated rows are packed one by one; an empty table gives no rows; further
columns are ignored; a very long text is one row of token ids in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clearsky.llm.base import slices
from clearsky.session import stored

CAPACITY = 1024
END = 2
SPECIAL = {"<|endoftext|>": 50256}

_encoders: dict[str, object] = {}


def encoder(ranks_path: str):
    """A byte-level BPE from a file of ranks, kept per Python worker."""
    if ranks_path not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encoders[ranks_path] = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL
        )
    return _encoders[ranks_path]


def token_ids(text: str | None, ranks_path: str, end: int = END) -> np.ndarray:
    """The ids that the JSON form of the vocabulary gives, then the end token."""
    if not text:
        return np.array([end], dtype="<u4")
    enc = encoder(ranks_path)
    special = "all" if any(s in text for s in SPECIAL) else set()
    try:
        ids = enc.encode_to_numpy(text, allowed_special=special, disallowed_special=())
    except UnicodeEncodeError:  # lone surrogates
        ids = np.array(enc.encode(text, allowed_special=special, disallowed_special=()))
    out = np.empty(len(ids) + 1, dtype="<u4")
    out[:-1] = ids
    out[-1] = end
    return out


def pieces(
    docs: DataFrame,
    ranks_path: str,
    capacity: int = CAPACITY,
    end: int = END,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, task, nth (number among the task's pieces of that length)."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long"
        + ", ids binary" * with_ids
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            texts, names = batch["t"].tolist(), batch["i"]
            for a, b in slices(texts, 1 << 22):
                rows, which = [], []
                for i in range(a, b):
                    ids = token_ids(texts[i], ranks_path, end)
                    first = (len(ids) - 1) % capacity + 1
                    for k, stop in enumerate(range(first, len(ids) + 1, capacity)):
                        start = max(0, stop - capacity)
                        part = ids[start:stop]
                        n = len(part)
                        rows.append(
                            (k, start, n, zlib.crc32(part), task, seen[n]) + ((part.tobytes(),) if with_ids else ())
                        )
                        seen[n] += 1
                        which.append(i)
                out = pd.DataFrame(
                    rows, columns=["piece", "start", "length", "ids_crc32", "task", "nth"] + ["ids"] * with_ids
                )
                out.insert(0, "doc_id", names.iloc[which].array)
                yield out

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInPandas(cut, schema)


def plan(available: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how many such sequences); together they use every piece once."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in available.items():
        left[length] = n
    made: list[tuple[list[int], int]] = []

    def take(lengths: list[int]) -> bool:
        need: dict[int, int] = {}
        for length in lengths:
            need[length] = need.get(length, 0) + 1
        times = int(min(left[length] // n for length, n in need.items()))
        if times:
            for length, n in need.items():
                left[length] -= n * times
            made.append((lengths, times))
        return times > 0

    if left[capacity]:
        take([capacity])
    for long in range(capacity - 1, 0, -1):
        gap = capacity - long
        if left[long] and 0 < gap:
            take([long, gap])
        # Pairs by their sum, the longer part first; then triples that fall back on a pair.
        for a in range(min(gap - 1, long), 0, -1):
            if not left[long]:
                break
            if gap - a <= a and left[a] and left[gap - a]:
                take([long, a, gap - a])
        for a in range(min(gap - 2, long), 0, -1):
            if not left[long]:
                break
            # Every pair of that sum, one after the other, until the gap or its other part is used up.
            for b in _pairs(left, gap - a) if left[a] else ():
                take([long, a, b, gap - a - b])
                if not left[long] or not left[a]:
                    break
    # What is left: longest first into the tightest gap, in groups of equal sequences.
    bins: dict[int, list[list]] = {}
    gaps = np.zeros(capacity + 1, dtype=np.int64)
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            fitting = np.flatnonzero(gaps[length:])
            if len(fitting):
                gap = length + int(fitting[0])
                lengths, times = bins[gap].pop()
                used = min(n, times)
                if times > used:
                    bins[gap].append([lengths, times - used])
                gaps[gap] -= used
                _open(bins, gaps, gap - length, lengths + [length], used)
                n -= used
            else:
                _open(bins, gaps, capacity - length, [length], n)
                n = 0
    made += [(lengths, times) for kinds in bins.values() for lengths, times in kinds]
    return made


def _open(bins: dict, gaps: np.ndarray, gap: int, lengths: list[int], times: int) -> None:
    bins.setdefault(gap, []).append([lengths, times])
    gaps[gap] += times


def _pairs(left: np.ndarray, total: int) -> list[int]:
    """The longer parts of all pairs of available lengths with this sum."""
    half = np.arange((total + 1) // 2, total)
    return half[(left[half] > 0) & (left[total - half] > 0)].tolist()


def ranges(made: list[tuple[list[int], int]], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first sequence, offset) in order of rank."""
    used: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for lengths, times in made:
        offset = 0
        for length in lengths:
            first = used.get(length, 0)
            out.setdefault(length, []).append((first, sequence, offset))
            used[length] = first + times
            offset += length
        sequence += times
    return {length: np.array(rows, dtype=np.int64) for length, rows in out.items()}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``. ``cut`` must be stored (it is read twice)."""
    spark = cut.sparkSession
    sizes = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sizes.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    totals = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows
    found = spark.sparkContext.broadcast(ranges(plan(totals, capacity), capacity))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at, rank = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        for n in np.unique(at):
            mine = at == n
            table = found.value[int(n)]
            k = np.searchsorted(table[:, 0], rank[mine], side="right") - 1
            sequence[mine] = table[k, 1] + rank[mine] - table[k, 0]
            offset[mine] = table[k, 2]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return (
        cut.join(earlier, ["length", "task"])
        .withColumn("placed", place("length", F.col("earlier") + F.col("nth")))
        .select(*[c for c in cut.columns if c not in ("task", "nth")], "placed.sequence_id", "placed.offset")
    )


def pack_documents(docs: DataFrame, ranks_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    return pack(stored(pieces(docs, ranks_path, capacity, with_ids=with_ids), "pieces"), capacity)
