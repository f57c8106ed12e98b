"""Nearest-in-time join of two recordings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clearsky.operators.ordered import CHUNK_SECONDS, micros, time_chunk
from clearsky.schemas import GPS_LEAP_SECONDS


def shift_seconds(df: DataFrame, ts: str, seconds: float) -> DataFrame:
    """Move a time column; ``-18`` turns GPS time into UTC."""
    moved = F.timestamp_micros(micros(ts) + F.lit(int(seconds * 1_000_000)))
    return df.withColumn(ts, moved)


def nearest_asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_ts: str,
    right_ts: str,
    columns: Sequence[str],
    tolerance_seconds: float,
    right_order: Sequence[str] = (),
    chunk_seconds: float = CHUNK_SECONDS,
    distance: str | None = None,
) -> DataFrame:
    """Left outer join of each left row with the right row nearest in time.

    ``columns`` of the right row are added, null when none lies within the
    tolerance (inclusive). At equal distance the earlier row wins. Among right
    rows with one time, the last in ``right_order`` is taken when looking back
    and the first when looking ahead. ``distance`` names an optional column with
    the absolute distance in microseconds.

    Both inputs are stacked and cut into chunks of one group and one stretch of
    time; right rows near a border are copied into the neighbouring chunk. One
    shuffle and two sorted passes (one per direction) give both candidates, so
    the work is linear in the rows: no pairs are formed, however dense a
    stretch of time is.
    """
    tolerance = int(tolerance_seconds * 1_000_000)
    order_names = [f"_ro{i}" for i in range(len(right_order))]

    left_rows = left.select(
        *by,
        # Rows without a time match nothing: null sorts before every right row.
        F.coalesce(time_chunk(left_ts, chunk_seconds), F.lit(0)).alias("_chunk"),
        micros(left_ts).alias("_us"),
        F.struct(*[F.col(c) for c in left.columns]).alias("_left"),
    )
    reach = F.sequence(
        time_chunk(right_ts, chunk_seconds, -tolerance_seconds),
        time_chunk(right_ts, chunk_seconds, tolerance_seconds),
    )
    right_rows = right.select(
        *by,
        F.explode(reach).alias("_chunk"),
        micros(right_ts).alias("_us"),
        F.struct(micros(right_ts).alias("_us"), *[F.col(c) for c in columns]).alias("_right"),
        *[F.col(c).alias(n) for n, c in zip(order_names, right_order, strict=True)],
    )
    stacked = left_rows.unionByName(right_rows, allowMissingColumns=True)
    side = F.col("_left").isNotNull()  # right rows (false) sort first at equal time
    back = (
        Window.partitionBy(*by, "_chunk")
        .orderBy(F.col("_us"), side, *[F.col(n) for n in order_names])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ahead = (
        Window.partitionBy(*by, "_chunk")
        .orderBy(F.col("_us").desc(), side, *[F.col(n).desc() for n in order_names])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = stacked.select(
        "_left",
        "_us",
        F.last("_right", ignorenulls=True).over(back).alias("_before"),
        F.last("_right", ignorenulls=True).over(ahead).alias("_after"),
    ).where(F.col("_left").isNotNull())
    gap_before = F.col("_us") - F.col("_before._us")
    gap_after = F.col("_after._us") - F.col("_us")
    before_ok = gap_before <= F.lit(tolerance)
    after_ok = gap_after <= F.lit(tolerance)
    earlier = before_ok & (gap_after.isNull() | (gap_before <= gap_after))
    match = F.when(earlier, F.col("_before")).when(after_ok, F.col("_after"))
    gap = F.when(earlier, gap_before).when(after_ok, gap_after)
    out = found.withColumn("_match", match)
    extra = [gap.alias(distance)] if distance else []
    return out.select(
        "_left.*", *[F.col(f"_match.{c}").alias(c) for c in columns], *extra
    )


def merge_signal(
    fixes: DataFrame,
    signal: DataFrame | None,
    by: Sequence[str],
    ts: str = "timestamp",
    signal_ts: str = "timestamp",
    leap_seconds: int = GPS_LEAP_SECONDS,
    tolerance_seconds: float = 2.0,
    right_order: Sequence[str] = (),
    chunk_seconds: float = CHUNK_SECONDS,
) -> DataFrame:
    """Attach the mean C/N0 and cycle slips of an observation recording.

    ``signal`` is in GPS time with one row per epoch: ``cnr_list`` and
    ``cycle_slips``. Without it both come from the fixes' own satellite lists.
    """
    if signal is None:
        return own_signal(fixes)
    reduced = shift_seconds(reduce_signal(signal, signal_ts), signal_ts, -leap_seconds)
    kept = fixes.drop("mean_cnr_epoch", "cycle_slips_epoch")
    return nearest_asof_join(
        kept,
        reduced,
        by,
        ts,
        signal_ts,
        ["mean_cnr_epoch", "cycle_slips_epoch"],
        tolerance_seconds,
        right_order=right_order,
        chunk_seconds=chunk_seconds,
    )


def list_mean(column: str):
    """Mean of an array column, null when it is empty or null."""
    total = F.aggregate(column, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(column) > 0, total / F.size(column))


def reduce_signal(signal: DataFrame, ts: str = "timestamp") -> DataFrame:
    """One mean C/N0 and slip count per observation epoch."""
    return signal.withColumns(
        {"mean_cnr_epoch": list_mean("cnr_list"), "cycle_slips_epoch": F.col("cycle_slips").cast("double")}
    )


def own_signal(fixes: DataFrame) -> DataFrame:
    """No second recording: C/N0 from the epoch's own list, no slips known."""
    return fixes.withColumns(
        {"mean_cnr_epoch": list_mean("cnr_list"), "cycle_slips_epoch": F.lit(0.0)}
    )
