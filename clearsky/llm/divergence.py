"""Divergence of sources within a language, by chunk factorization.

1. :func:`chunk_counts` cuts every whole text at blanks and counts its chunks. A row
   stands for one chunk of one language in one slice of a task: how often each
   source has it, and the row numbers of up to ``min_docs`` documents that hold it.
2. :func:`chunk_terms` deals the rows by chunk and passes over them in order. Where a
   chunk's rows end they are one, and the chunk is tokenized: each globally distinct chunk
   once. Its terms take over its counts and row numbers.
3. :func:`term_counts` deals these by language and term and passes over them in the
   same way. Sets of at most ``min_docs`` row numbers unite to sets of at most as
   many, which is enough to know exactly which terms have so many documents.
4. Each kept term is one row with its counts by source. Tasks turn blocks of
   such rows into shares ``p = 1 + 10^9 (count + 1) div (N + V)`` and sum
   ``(p - q)^2 div q`` over their rows for all pairs of sources of a language; they
   also give the ``top`` terms of each source against its whole language. Spark sums
   and ranks. All numbers are 64-bit integers, quotients by long division.

One language or source may hold any share of the rows: a slice gives a chunk one row for
each language, so the most frequent chunk has as many rows as there are slices, and a pass keeps one
of them. Totals are joined with salted keys. What a task of the last step holds grows with
the square of the number of sources of a language, as the result does.

Cases: a null text, lang or source counts as empty; groups and languages without
terms have shares of no terms, hence distances of 0; row numbers tell documents
apart, so repeated ids and repeated rows count each; an empty table gives no rows;
further columns are ignored; a very long text is one row in one task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from heapq import nsmallest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearsky.session import stored

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}
TOP = 200
SCALE = 10**9
SLICE = 1 << 25
ROWS_OUT = 1 << 16
ROWS_IN = 1 << 17
COUNTED = "rows array<long>, sources array<string>, counts array<long>"


def _narrow(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    def filled(name: str, alias: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(alias)

    return docs.select(filled(lang_col, "lang"), filled(source_col, "source"), filled(text_col, "text"))


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of about ``SLICE`` bytes of text (one row at least)."""
    waiting, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < len(batch):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + SLICE - size, side="right")))
            waiting.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1] - before)
            start = stop
            if size >= SLICE or start < len(batch):
                yield pa.Table.from_batches(waiting)
                waiting, size = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting)


def _begins(*columns: np.ndarray) -> np.ndarray:
    """Places where a run of equal rows begins."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _counted(rows: pa.Table, first_id: int, most: int) -> pa.Table | None:
    """Chunks of a slice; rows are put in the order of their groups first, so one sort serves all."""
    langs = rows.column("lang").combine_chunks().dictionary_encode()
    sources = rows.column("source").combine_chunks().dictionary_encode()
    lang, source = (x.indices.to_numpy().astype(np.int64) for x in (langs, sources))
    order = np.lexsort((source, lang))
    lang, source = lang[order], source[order]
    lists = pc.ascii_split_whitespace(rows.column("text").combine_chunks().take(pa.array(order)))
    chunks = lists.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy(zero_copy_only=False))
    code = chunks.indices.to_numpy().astype(np.int64)
    some = pc.binary_length(chunks.dictionary).to_numpy(zero_copy_only=False)[code] > 0
    pairs, times = np.unique(code[some] * len(rows) + row[some], return_counts=True)
    if not len(pairs):
        return None
    code, row = np.divmod(pairs, len(rows))
    entries = _begins(code, lang[row], source[row])
    heads = _begins(code, lang[row])
    ends = np.append(heads[1:], len(row))
    held = np.minimum(ends - heads, most)
    some = np.repeat(heads - np.cumsum(held) + held, held) + np.arange(held.sum())
    offsets = np.searchsorted(entries, np.append(heads, len(row))).astype(np.int32)
    return pa.table(
        {
            "chunk": chunks.dictionary.take(pa.array(code[heads])),
            "lang": langs.dictionary.take(pa.array(lang[row[heads]])),
            "rows": _lists(held, pa.array(first_id + order[row[some]])),
            "sources": pa.ListArray.from_arrays(offsets, sources.dictionary.take(pa.array(source[row[entries]]))),
            "counts": pa.ListArray.from_arrays(offsets, pa.array(np.add.reduceat(times, entries).astype(np.int64))),
        }
    )


def _lists(lengths: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32), values)


def chunk_counts(
    docs: DataFrame, min_docs: int = 3, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """chunk, lang, rows, sources, counts: a row for each chunk and language of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id = TaskContext.get().partitionId() << 40
        for rows in _sliced(batches):
            found = _counted(rows, next_id, min_docs)
            next_id += len(rows)
            if found is not None:
                yield from found.to_batches(max_chunksize=ROWS_OUT)

    return _narrow(docs, text_col, lang_col, source_col).mapInArrow(run, f"chunk string, lang string, {COUNTED}")


def _joined(table: pa.Table, keys: list[str], most: int) -> pa.Table:
    """Neighbouring rows of equal keys as one: counts by source summed, row numbers united up to ``most``."""
    table = table.combine_chunks()
    codes = [table.column(k).combine_chunks().dictionary_encode().indices.to_numpy() for k in keys]
    begins = _begins(*codes)
    group = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(table))))

    def of_lists(name: str) -> tuple[np.ndarray, pa.Array]:
        lists = table.column(name).combine_chunks()
        return np.repeat(group, lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten()

    owner, ids = of_lists("rows")
    ids = ids.to_numpy(zero_copy_only=False)
    order = np.lexsort((ids, owner))
    owner, ids = owner[order], ids[order]
    new = _begins(owner, ids)
    owner, ids = owner[new], ids[new]
    first = np.searchsorted(owner, owner)
    kept = np.arange(len(owner)) - first < most
    owner, ids = owner[kept], ids[kept]

    holder, names = of_lists("sources")
    names = names.dictionary_encode()
    counts = of_lists("counts")[1].to_numpy(zero_copy_only=False)
    width = max(1, len(names.dictionary))
    pairs = holder * width + names.indices.to_numpy()
    order = np.argsort(pairs, kind="stable")
    new = _begins(pairs[order])
    pairs = pairs[order][new]
    sums = np.add.reduceat(counts[order], new) if len(new) else counts
    n = len(begins)
    out = {k: table.column(k).take(pa.array(begins)) for k in keys}
    out["rows"] = _lists(np.bincount(owner, minlength=n), pa.array(ids))
    lengths = np.bincount(pairs // width, minlength=n)
    out["sources"] = _lists(lengths, names.dictionary.take(pa.array(pairs % width)))
    out["counts"] = _lists(lengths, pa.array(sums))
    return pa.table(out)


def _pass_over(
    rows: DataFrame, keys: list[str], most: int, then: Callable[[pa.Table], pa.Table], schema: str, last_key: str
) -> DataFrame:
    """Deal rows by key, join the rows of each key in order, and hand whole keys to ``then``.

    ``last_key`` (one of the keys) closes a run: rows of its last value wait for the next batch,
    joined to one row per key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        size = 0

        def closed(table: pa.Table, end: bool) -> tuple[pa.Table, pa.Table]:
            table = _joined(table, keys, most)
            if end:
                return table, table.slice(len(table))
            values = table.column(last_key).combine_chunks().dictionary_encode().indices.to_numpy()
            cut = int(_begins(values)[-1]) if len(values) else 0
            return table.slice(0, cut), table.slice(cut)

        for batch in batches:
            waiting.append(pa.Table.from_batches([batch]))
            size += len(batch)
            if size >= ROWS_IN:
                whole, rest = closed(pa.concat_tables(waiting), False)
                waiting, size = [rest], 0
                if len(whole):
                    yield from then(whole).to_batches(max_chunksize=ROWS_OUT)
        if waiting:
            whole, _ = closed(pa.concat_tables(waiting), True)
            if len(whole):
                yield from then(whole).to_batches(max_chunksize=ROWS_OUT)

    return rows.repartition(*keys[: keys.index(last_key) + 1]).sortWithinPartitions(*keys).mapInArrow(run, schema)


def tokenized(chunks: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Terms of distinct chunks, one after the other: term, times in its chunk; and the terms of each chunk."""
    terms, times = [], []
    lengths = np.zeros(len(chunks), dtype=np.int64)
    for k, chunk in enumerate(chunks):
        found = TERM.findall(chunk.translate(FOLD))
        if len(found) > 1:
            counted = Counter(found)
            terms += counted
            times += counted.values()
            lengths[k] = len(counted)
        elif found:
            terms += found
            times.append(1)
            lengths[k] = 1
    return terms, np.array(times, dtype=np.int64), lengths


def chunk_terms(chunks: DataFrame, min_docs: int = 3) -> DataFrame:
    """lang, term, rows, sources, counts: each distinct chunk tokenized once, its terms joined back."""

    def then(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        distinct = table.column("chunk").combine_chunks().dictionary_encode()
        terms, times, lengths = tokenized(distinct.dictionary.to_pylist())
        starts = np.cumsum(lengths) - lengths
        code = distinct.indices.to_numpy()
        each = lengths[code]
        row = np.repeat(np.arange(len(table)), each)
        term = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each) + starts[code[row]]
        out = table.select(["lang", "rows", "sources", "counts"]).take(pa.array(row)).combine_chunks()
        counts = out.column("counts").combine_chunks()
        entries = counts.value_lengths().to_numpy(zero_copy_only=False)
        scaled = counts.flatten().to_numpy(zero_copy_only=False) * np.repeat(times[term], entries)
        return pa.table(
            {
                "lang": out.column("lang"),
                "term": pa.array(terms, pa.string()).take(pa.array(term)),
                "rows": out.column("rows"),
                "sources": out.column("sources"),
                "counts": _lists(entries, pa.array(scaled)),
            }
        )

    return _pass_over(chunks, ["chunk", "lang"], min_docs, then, f"lang string, term string, {COUNTED}", "chunk")


def term_counts(chunks: DataFrame, min_docs: int = 3) -> DataFrame:
    """lang, term, sources, counts of the terms in at least ``min_docs`` documents of the language: one row each."""

    def then(table: pa.Table) -> pa.Table:
        lists = table.column("rows").combine_chunks()
        held = lists.value_lengths().to_numpy(zero_copy_only=False)
        return table.filter(pa.array(held >= min_docs)).select(["lang", "term", "sources", "counts"])

    schema = "lang string, term string, sources array<string>, counts array<long>"
    return _pass_over(chunk_terms(chunks, min_docs), ["lang", "term"], min_docs, then, schema, "term")


def shares(counts: np.ndarray, total: np.ndarray | int, kept: int) -> np.ndarray:
    """``1 + (10^9 (counts + 1)) div (total + kept)``, three decimal digits at a time."""
    below = total + kept
    out, rest = np.divmod(counts + 1, below)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + digits
    return out + 1


class Compared:
    """What the kept terms seen so far give for one language."""

    def __init__(self, sources: list[str], totals: list[int], kept: int, top: int):
        self.sources, self.kept, self.top = sources, kept, top
        self.totals = np.array(totals, dtype=np.int64)
        self.place = pa.array(sources, pa.string())
        self.sums = np.zeros((len(sources), len(sources)), dtype=np.int64)
        self.best: list[list[tuple[int, str]]] = [[] for _ in sources]

    def add(self, terms: list[str], sources: pa.Array, counts: np.ndarray, lengths: np.ndarray) -> None:
        width = len(self.sources)
        dense = np.zeros((len(terms), width), dtype=np.int64)
        column = pc.index_in(sources, value_set=self.place).to_numpy(zero_copy_only=False)
        dense[np.repeat(np.arange(len(terms)), lengths), column] = counts
        p = shares(dense, self.totals, self.kept)
        whole = shares(dense.sum(axis=1), int(self.totals.sum()), self.kept)
        for k in range(width):
            away = p[:, k, None] - p
            self.sums[k] += (away * away // p).sum(axis=0)
            more = np.flatnonzero((dense[:, k] > 0) & (p[:, k] > whole))
            away = p[more, k] - whole[more]
            found = [(-v, terms[i]) for v, i in zip((away * away // whole[more]).tolist(), more.tolist())]
            self.best[k] = nsmallest(self.top, self.best[k] + found)

    def rows(self, lang: str) -> Iterator[tuple[str, str, str, str, int]]:
        for k, source in enumerate(self.sources):
            for j, other in enumerate(self.sources):
                if j != k:
                    yield lang, source, "pair", other, int(self.sums[k, j])
            for value, term in self.best[k]:
                yield lang, source, "term", term, -value


def _values(rows: DataFrame, top: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Compared] = {}
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                at = np.flatnonzero(langs.indices.to_numpy() == k)
                if lang not in found:
                    first = batch.slice(int(at[0]), 1)
                    names, totals, kept = (first.column(c)[0].as_py() for c in ("all_sources", "totals", "kept"))
                    found[lang] = Compared(names, totals, kept, top)
                width = len(found[lang].sources)
                for start in range(0, len(at), step := max(1, (1 << 20) // width)):
                    part = batch.take(pa.array(at[start : start + step]))
                    part = part.filter(part.column("term").is_valid())
                    if len(part):
                        lists = part.column("sources")
                        found[lang].add(
                            part.column("term").to_pylist(),
                            lists.flatten(),
                            part.column("counts").flatten().to_numpy(),
                            lists.value_lengths().to_numpy(zero_copy_only=False),
                        )
        out = [row for lang in found for row in found[lang].rows(lang)]
        for start in range(0, len(out), ROWS_OUT):
            columns = zip(*out[start : start + ROWS_OUT])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in columns], ["lang", "source", "part", "item", "value"]
            )

    return rows.mapInArrow(run, "lang string, source string, part string, item string, value long")


def audit(
    docs: DataFrame,
    min_docs: int = 3,
    top: int = TOP,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: every other source of the language; part ``term``: the ``top`` terms of
    the source that its language has less of. Ranks run from the greatest value, then by item.
    """
    spark = docs.sparkSession
    chunks = chunk_counts(docs, min_docs, text_col, lang_col, source_col)
    terms = stored(term_counts(chunks, min_docs), "terms")
    occurring = _narrow(docs, text_col, lang_col, source_col).select("lang", "source").distinct()
    summed = (
        terms.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("entry"))
        .groupBy("lang", F.col("entry.sources").alias("source"))
        .agg(F.sum("entry.counts").alias("total"))
    )
    group = F.struct("source", F.coalesce("total", F.lit(0).cast("long")).alias("total"))
    langs = (
        occurring.join(summed, ["lang", "source"], "left")
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(group)).alias("groups"))
        .join(terms.groupBy("lang").agg(F.count("*").alias("kept")), "lang", "left")
        .select(
            "lang",
            F.col("groups.source").alias("all_sources"),
            F.col("groups.total").alias("totals"),
            F.coalesce("kept", F.lit(0).cast("long")).alias("kept"),
        )
    )
    langs = stored(langs, "languages")
    # A row without a term brings in languages that keep none.
    none = langs.select(
        "lang",
        F.lit(None).cast("string").alias("term"),
        F.array().cast("array<string>").alias("sources"),
        F.array().cast("array<long>").alias("counts"),
    )
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = terms.unionByName(none).withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int"))
    spread = langs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    values = stored(_values(salted.join(spread, ["lang", "salt"]), top), "values")

    pairs = values.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    best = values.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.unionByName(best).select("lang", "source", "part", "item", "value", "rank")
