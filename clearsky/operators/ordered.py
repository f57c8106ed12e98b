"""Ordered work on groups of any size.

A window over a whole session puts that session into one task. Sessions can
hold a large share of all rows, so everything here works on *chunks*: pieces
of a group that are consecutive in the order. Three building blocks follow:

* ``with_halo``      copies the rows near a chunk border into the neighbour, so
                     a bounded frame never leaves its chunk;
* ``running_sums``   adds the totals of the earlier chunks to a running sum
                     inside the chunk (``row_index`` is the sum of ones);
* ``carry_forward``  hands the last known value of earlier chunks on.

The per-chunk totals are one row per chunk and are windowed per group on their
own, which is small work even for the largest group. Grouping keys and chunk
columns must not be null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import QuantileDiscretizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_SECONDS = 6 * 3600


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp"))


def time_chunk(ts: str | Column, chunk_seconds: float, shift_seconds: float = 0.0) -> Column:
    """Number of the time chunk that holds ``ts`` moved by ``shift_seconds``."""
    moved = micros(ts) + F.lit(int(shift_seconds * 1_000_000))
    return F.floor(moved / F.lit(int(chunk_seconds * 1_000_000))).cast("long")


def with_halo(
    df: DataFrame,
    ts: str,
    chunk_seconds: float,
    before_seconds: float = 0.0,
    after_seconds: float = 0.0,
    chunk: str = "_chunk",
    own: str = "_own",
) -> DataFrame:
    """Copy every row to each chunk whose frames can reach it.

    A frame may look ``before_seconds`` back and ``after_seconds`` ahead. ``own``
    marks the copy that belongs to the chunk; the others are only context and
    are dropped after the window. With chunks much wider than the frame the
    copies are a small share of the rows.
    """
    first = time_chunk(ts, chunk_seconds, -after_seconds)
    last = time_chunk(ts, chunk_seconds, before_seconds)
    return df.withColumn(chunk, F.explode(F.sequence(first, last))).withColumn(
        own, F.col(chunk) == time_chunk(ts, chunk_seconds)
    )


def running(
    df: DataFrame,
    by: Sequence[str],
    chunk: str,
    order: Sequence[str | Column],
    sums: dict[str, Column] | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Running sums and last known values per group, exact across chunks.

    ``sums`` adds inclusive running sums; ``carry`` fills nulls of columns with
    the latest earlier value, however far back. ``chunk`` must not decrease
    along ``order``. Rows with equal ``order`` are taken in an arbitrary
    sequence, so give a full order.

    Two passes over the rows: one aggregate to a row per chunk, and one sorted
    pass inside the chunks that starts from what the earlier chunks left.
    """
    sums = sums or {}
    keys = [*by, chunk]
    per_chunk = df.groupBy(*keys).agg(
        *[F.sum(c).alias(f"_off_{n}") for n, c in sums.items()],
        *[
            F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_carry_{c}")
            for c in carry
        ],
    )
    earlier = Window.partitionBy(*by).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = per_chunk.select(
        *keys,
        *[F.coalesce(F.sum(f"_off_{n}").over(earlier), F.lit(0)).alias(f"_off_{n}") for n in sums],
        *[F.last(f"_carry_{c}", ignorenulls=True).over(earlier).alias(f"_carry_{c}") for c in carry],
    )
    inside = (
        Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    filled = {
        c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_carry_{c}")) for c in carry
    }
    # The rows stay where the window needs them: only the chunk table moves, and no row is sorted for the join.
    return df.join(starts.hint("shuffle_hash"), keys).select(
        *[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns],
        *[
            (F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_off_{n}")).alias(n)
            for n, c in sums.items()
        ],
    )


def running_sums(
    df: DataFrame, by: Sequence[str], chunk: str, order: Sequence[str | Column], sums: dict[str, Column]
) -> DataFrame:
    return running(df, by, chunk, order, sums=sums)


def carry_forward(
    df: DataFrame, by: Sequence[str], chunk: str, order: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    return running(df, by, chunk, order, carry=columns)


def row_index(
    df: DataFrame,
    by: Sequence[str],
    ts: str,
    order: Sequence[str | Column] | None = None,
    chunk_seconds: float = CHUNK_SECONDS,
    name: str = "row_idx",
    tasks: int | None = None,
) -> DataFrame:
    """Add the 1-based position of each row inside its group.

    ``tasks`` says into how many tasks the chunks are dealt (else the session's shuffle partitions):
    large inputs need more.
    """
    chunked = df.withColumn("_chunk", time_chunk(ts, chunk_seconds))
    if tasks:
        chunked = chunked.repartition(tasks, *by, "_chunk")
    return running_sums(chunked, by, "_chunk", order or [ts], {name: F.lit(1).cast("long")}).drop("_chunk")


def row_blocks(
    df: DataFrame, index: str, block_rows: int, before: int = 0, after: int = 0
) -> DataFrame:
    """``with_halo`` for frames counted in rows, over a 1-based ``index`` column."""
    i = F.col(index) - 1
    first = F.floor((i - F.lit(after)) / F.lit(block_rows)).cast("long")
    last = F.floor((i + F.lit(before)) / F.lit(block_rows)).cast("long")
    return df.withColumn("_block", F.explode(F.sequence(first, last))).withColumn(
        "_own", F.col("_block") == F.floor(i / F.lit(block_rows)).cast("long")
    )


def forward_fill(
    df: DataFrame,
    by: Sequence[str],
    ts: str,
    columns: Sequence[str],
    order: Sequence[str] | None = None,
    chunk_seconds: float = CHUNK_SECONDS,
) -> DataFrame:
    """``carry_forward`` along time."""
    chunked = df.withColumn("_chunk", time_chunk(ts, chunk_seconds))
    return carry_forward(chunked, by, "_chunk", list(order or [ts]), columns).drop("_chunk")


def _shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hash_chunk(df: DataFrame, key: str) -> Column:
    """Chunk of a 64-bit hash: even chunks in the hash's order, one per shuffle partition."""
    return F.shiftright(F.shiftright(key, 32) * F.lit(_shuffle_partitions(df)).cast("long"), 32)


def value_chunks(df: DataFrame, value: str, chunk: str = "_chunk") -> DataFrame:
    """Chunks of about equal size over the range of a numeric column.

    There are as many as ``spark.sql.shuffle.partitions``, so they grow with what the
    session is set up for. The edges come from a mergeable quantile sketch (as many numbers
    reach the driver). Equal values always share a chunk; chunks keep the value order.
    The column must be free of nulls and NaN.
    """
    buckets = max(2, _shuffle_partitions(df))
    as_double = df.withColumn("_value", F.col(value).cast("double"))
    fitted = QuantileDiscretizer(
        numBuckets=buckets, inputCol="_value", outputCol=chunk, relativeError=1.0 / (4 * buckets)
    ).fit(as_double)
    return fitted.transform(as_double).withColumn(chunk, F.col(chunk).cast("long")).drop("_value")


def counted_values(
    df: DataFrame, value: str, by: Sequence[str] = (), weights: dict[str, Column] | None = None
) -> DataFrame:
    """Distinct values per group with their counts and running counts.

    ``weights`` names what to add up (default: ``n``, the rows); the running sum
    of ``n`` is ``n_cum``. Copies of one value collapse before the shuffle, so a
    value that fills a third of the table costs one row.
    """
    weights = weights or {"n": F.lit(1)}
    chunked = value_chunks(df.where(F.col(value).isNotNull()), value)
    counts = chunked.groupBy(*by, "_chunk", value).agg(
        *[F.sum(w).cast("long").alias(n) for n, w in weights.items()]
    )
    return running_sums(
        counts, by, "_chunk", [value], {f"{n}_cum": F.col(n) for n in weights}
    ).drop("_chunk")


def exact_quantiles(
    df: DataFrame, value: str, probabilities: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact interpolated quantiles, one row per group (one row without groups).

    Equals ``percentile`` but never holds the values of a group in one task.
    """
    counts = counted_values(df, value, by)
    group_size = (
        df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    )
    sized = counts.join(settled(group_size), list(by)) if by else attach(counts, group_size)
    aggs = []
    for name, p in probabilities.items():
        at = F.lit(float(p)) * (F.col("_rows") - 1)
        low = F.min(F.when(F.col("n_cum") > F.floor(at), F.col(value)))
        high = F.min(F.when(F.col("n_cum") > F.ceil(at), F.col(value)))
        share = F.max(at - F.floor(at))
        aggs.append((low + (high - low) * share).alias(name))
    return sized.groupBy(*by).agg(*aggs)


SMALL_ROWS = 10_000


def settled(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """A small result as a local table, a larger one as it is.

    For totals per class, horizon or session that are joined back to many rows.
    With few groups a shuffled join would put a large share of the rows in one
    task. At most ``most + 1`` rows are fetched to find out; a table within the
    limit then has a known size and is broadcast, a larger one has enough keys
    for a shuffled join.
    """
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        return df
    return df.sparkSession.createDataFrame(rows, df.schema)


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of an ungrouped aggregate (always a single row) to each row."""
    return df.join(F.broadcast(one_row))


def cut_points(df: DataFrame, order: Sequence[str], positions: Sequence[int]) -> list[tuple | None]:
    """The ``order`` keys of the rows at the given 0-based positions of a global sort.

    No row is sorted as a whole: the first key column is located by running
    counts over its distinct values, then the rows that tie on it are looked at
    in the same way for the next column. One key tuple per position reaches the
    driver. Numeric or timestamp columns; positions past the end give ``None``.
    """
    return [_cut_point(df, list(order), int(p)) for p in positions]


def _as_number(df: DataFrame, column: str) -> Column:
    return micros(column) if df.schema[column].dataType.typeName().startswith("timestamp") else F.col(column)


def _cut_point(df: DataFrame, order: list[str], position: int) -> tuple | None:
    key: list = []
    rest, left = df.select(*[_as_number(df, c).alias(c) for c in order]), position
    for level, column in enumerate(order):
        found = (
            counted_values(rest, column)
            .where(F.col("n_cum") > left)
            .agg(F.min_by(F.struct(column, "n", "n_cum"), F.col(column)).alias("hit"))
            .first()
        )["hit"]
        if found is None:
            return None
        value, ties = found[column], found["n"]
        key.append(value)
        left -= found["n_cum"] - ties
        rest = rest.where(F.col(column) == F.lit(value))
        if ties == 1 and order[level + 1 :]:  # a single row is left: its other columns are the rest of the key
            return (*key, *rest.select(*order[level + 1 :]).first())
    return tuple(key)


def before_cut(df: DataFrame, order: Sequence[str], key: tuple | None) -> Column:
    """True where the row sorts before ``key`` (a result of ``cut_points``)."""
    if key is None:
        return F.lit(True)
    result = F.lit(False)
    for column, value in reversed(list(zip(order, key, strict=True))):
        as_number = _as_number(df, column)
        result = (as_number < F.lit(value)) | ((as_number == F.lit(value)) & result)
    return result
