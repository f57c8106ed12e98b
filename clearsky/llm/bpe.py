"""BPE encoding and decoding with a contiguous array of ranks.

A word is held as the list of its parts' boundaries and, beside it, the ranks of
all neighbouring parts. The least rank is looked for by a scan, the boundary
between its two parts is deleted, and the ranks on both sides of the new part are
looked up anew, until no pair has a rank. Words of more than ``SHORT`` characters
take the same merges in the same order from a heap, so a run of a million letters
stays near-linear. Equal ranks merge from the left.

The vocabulary file is one of the ``tokenizers`` library with BPE over byte
characters and an end-of-word suffix. Texts are cut at special tokens, brought to
NFC, lower-cased letter by letter and split into words; texts with characters
younger than Unicode 3.2, whose classes depend on the library's own tables, are
normalised and split by that library. Merging and decoding are done here.

:func:`encode` gives the ids of each row, :func:`decode` the text of each row's ids
(the vocabulary's entries, joined by one space, as the library does for a file
without a decoder), :func:`digests` what both amount to. All three work on rows
where they lie: no shuffle. A worker keeps the ids of at most ``REMEMBERED`` words.

Cases: a null or empty text has no ids and decodes to the empty text; a null
``doc_id`` is carried through; repeated rows are repeated; an empty table gives no
rows; further columns are ignored; a very long text is one row in one task, worked
on in slices of rows; ids that the vocabulary lacks are an error.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearsky.llm.base import slices

SHORT = 256
REMEMBERED = 1 << 19
NONE = 1 << 60

_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_vocabularies: dict[str, Vocabulary] = {}


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Vocabulary:
    """Ids and ranks of a vocabulary file, and the words met so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            self.parts = json.load(file)
        model = self.parts["model"]
        self.path = path
        self.suffix = model["end_of_word_suffix"]
        self.ids = model["vocab"]
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in self.parts["added_tokens"]}
        self.tokens = {i: token for token, i in chain(self.ids.items(), self.special.items())}
        self.between = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.characters = str.maketrans(dict(enumerate(byte_characters())))
        self.known: dict[str, list[int]] = {}
        self.old: set[str] = set()
        self.library = None

    def _young(self, text: str) -> bool:
        """Whether a character of the text came after Unicode 3.2."""
        for c in set(text) - self.old:
            if unicodedata.ucd_3_2_0.category(c) == "Cn":
                return True
            self.old.add(c)
        return False

    def words(self, text: str) -> list[str]:
        if not text.isascii():
            if self._young(text):
                return self._words_of_library(text)
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # str.lower() looks at the letters around it
                text = text.replace("Σ", "σ")
        return _WORD.findall(text.lower())

    def _words_of_library(self, text: str) -> list[str]:
        if self.library is None:
            from tokenizers import Regex, Tokenizer, pre_tokenizers

            split = self.parts["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
            self.library = (
                Tokenizer.from_file(self.path).normalizer,
                pre_tokenizers.Split(Regex(split), "removed", invert=True),
            )
        normaliser, splitter = self.library
        return [word for word, _ in splitter.pre_tokenize_str(normaliser.normalize_str(text))]

    def word_ids(self, word: str) -> list[int]:
        found = self.known.get(word)
        if found is None:
            text = word.encode("utf-8").decode("latin-1").translate(self.characters)
            merge = merged if len(text) <= SHORT else merged_long
            found = [self.ids[part] for part in merge(text, self.suffix, self.ranks)]
            if len(word) <= SHORT:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[word] = found
        return found

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known
        for piece in self.between.split(text) if self.between else (text,):
            if piece in self.special:
                out.append(self.special[piece])
                continue
            words = self.words(piece)
            for word in words:
                found = known.get(word)
                out += self.word_ids(word) if found is None else found
        return out

    def decode(self, ids) -> str:
        return " ".join([self.tokens[i] for i in ids])


def merged(text: str, suffix: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """The parts of a short word: scan for the least rank, delete its boundary, refresh both neighbours."""
    whole = text + suffix
    bounds = [*range(len(text)), len(whole)]

    def rank(k: int) -> int:
        """Of the pair whose boundary is ``bounds[k]``."""
        return ranks.get((whole[bounds[k - 1] : bounds[k]], whole[bounds[k] : bounds[k + 1]]), NONE)

    adjacent = [rank(k) for k in range(1, len(bounds) - 1)]  # adjacent[k - 1] belongs to bounds[k]
    while adjacent:
        least = min(adjacent)
        if least == NONE:
            break
        k = adjacent.index(least) + 1
        del bounds[k], adjacent[k - 1]
        if k > 1:
            adjacent[k - 2] = rank(k - 1)
        if k < len(bounds) - 1:
            adjacent[k - 1] = rank(k)
    return [whole[a:b] for a, b in zip(bounds, bounds[1:])]


def merged_long(text: str, suffix: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """The same parts for a word of any length: boundaries as a linked list, candidates in a heap."""
    whole = text + suffix
    n = len(text)
    ends = [*range(1, n), len(whole)]  # of the part that starts at each place
    before = [*range(-1, n - 1)]

    def candidate(a: int) -> tuple[int, int, int, int] | None:
        b = ends[a]
        if b >= n:
            return None
        rank = ranks.get((whole[a:b], whole[b : ends[b]]))
        return None if rank is None else (rank, a, b, ends[b])

    heap = [c for c in map(candidate, range(n)) if c]
    heapq.heapify(heap)
    gone = bytearray(n)
    while heap:
        _, a, b, end = heapq.heappop(heap)
        if gone[a] or ends[a] != b or gone[b] or ends[b] != end:
            continue
        gone[b] = 1
        ends[a] = end
        if end < n:
            before[end] = a
        for start in (before[a], a):
            if start >= 0 and (c := candidate(start)):
                heapq.heappush(heap, c)
    return [whole[a : ends[a]] for a in range(n) if not gone[a]]


def vocabulary(path: str) -> Vocabulary:
    """Read once per Python worker."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, 1 << 22):
                rows = [np.array(words.encode(t) if t else [], dtype=np.int32) for t in texts[a:b]]
                offsets = np.zeros(len(rows) + 1, dtype=np.int32)
                np.cumsum([len(r) for r in rows], out=offsets[1:])
                ids = pa.ListArray.from_arrays(offsets, np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids], ["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids, decoded: the text of each row's ids; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            ids = batch.column(1)
            lengths = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            start = 0
            while start < len(lengths):  # rows of about a million ids at a time
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + (1 << 20), side="right")))
                cuts = np.concatenate(([before], ends[start:stop]))
                texts = [words.decode(flat[a:b].tolist()) for a, b in zip(cuts, cuts[1:])]
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"]
                )
                start = stop

    kind = encoded.schema[id_col].dataType.simpleString()
    narrow = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return narrow.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the round trip of each row in short."""
    both = decode(encode(docs, path, id_col, text_col), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
