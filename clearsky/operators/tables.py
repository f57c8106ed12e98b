"""Projections, filters, unions and tags on epoch and feature tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearsky.functions.scalars import group_of
from clearsky.operators.ordered import micros, row_index, settled
from clearsky.schemas import CLIP_BOUNDS, DOP_DEFAULTS, EPOCH, NOT_FEATURES


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def repaired_splits(df: DataFrame, split: str = "split") -> DataFrame:
    """Labelled table check: required columns, and ``validation`` renamed to ``val``."""
    require_columns(df, ["label", split, "source"])
    return df.withColumn(split, F.when(F.col(split) == "validation", "val").otherwise(F.col(split)))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers are null everywhere; NaN never survives ingestion."""
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select(*[F.nanvl(c, F.lit(None)).alias(c) if c in floats else F.col(c) for c in df.columns])


def as_epochs(df: DataFrame, **constants) -> DataFrame:
    """Project to the epoch schema: absent columns become null, ``constants`` are tags."""
    out = []
    for f in EPOCH.fields:
        if f.name in constants:
            c: Column = F.lit(constants[f.name])
        elif f.name in df.columns:
            c = F.col(f.name)
        else:
            c = F.lit(None)
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out)


def drop_incomplete(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(keys))


def tag(df: DataFrame, **constants) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in constants.items()})


def feature_columns(df: DataFrame, not_features: Sequence[str] = tuple(NOT_FEATURES)) -> list[str]:
    """Model inputs in their fixed order: sorted by name, the C/N0 flag last."""
    flag = "cnr_available"
    names = sorted(c for c in df.columns if c not in not_features and c != flag)
    return [*names, flag] if flag in df.columns else names


def clip(df: DataFrame, bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Limit columns to their physical bounds; nulls stay null."""
    bounds = CLIP_BOUNDS if bounds is None else bounds

    def limited(c: str) -> Column:
        low, high = bounds[c]
        return F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.lit(high)), F.lit(low)))

    return df.withColumns({c: limited(c) for c in bounds if c in df.columns})


def first_rows(
    df: DataFrame, by: Sequence[str], ts: str, n: int, order: Sequence[str] | None = None, chunk_seconds: float = 6 * 3600
) -> DataFrame:
    """The first ``n`` rows of every group in time order (debug runs)."""
    indexed = row_index(df, by, ts, order, chunk_seconds, "_idx")
    return indexed.where(F.col("_idx") <= n).drop("_idx")


def union_sources(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of several tables; columns one of them lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def observation_only_epochs(signal: DataFrame, kind: str | None = None, leap_seconds: int = 18) -> DataFrame:
    """Epochs of a source that has observations but no position fixes.

    Fix quality 1, satellites counted from the C/N0 list, DOPs from the default
    table of ``kind`` (none when the kind is unknown). Times move to UTC.
    """
    pdop, hdop, vdop = DOP_DEFAULTS.get(kind, (None, None, None))
    heard = F.filter("cnr_list", lambda c: c > 0)
    total = F.aggregate("cnr_list", F.lit(0.0), lambda s, x: s + x)
    shifted = F.timestamp_micros(micros("timestamp") - leap_seconds * 1_000_000)
    return signal.withColumns(
        {
            "timestamp": shifted,
            "mean_cnr_epoch": F.when(F.size("cnr_list") > 0, total / F.size("cnr_list")),
            "cycle_slips_epoch": F.col("cycle_slips").cast("double"),
            "fix_quality": F.lit(1),
            "num_satellites": F.size(heard).cast("double"),
            "pdop": F.lit(pdop).cast("double"),
            "hdop": F.lit(hdop).cast("double"),
            "vdop": F.lit(vdop).cast("double"),
        }
    )


def resample_first(
    df: DataFrame, by: Sequence[str], ts: str, columns: Sequence[str], required: str | None = None,
    order: Sequence[str] = (), seconds: float = 1.0,
) -> DataFrame:
    """One row per time bucket: the first non-null value of each column.

    Buckets where ``required`` has no value are dropped. The bucket start
    replaces the time.
    """
    width = int(seconds * 1_000_000)
    bucket = F.timestamp_micros(F.floor(micros(ts) / width) * width)
    at = F.struct(ts, *order)
    out = df.groupBy(*by, bucket.alias("_bucket")).agg(
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns]
    )
    if required:
        out = out.where(F.col(required).isNotNull())
    return out.withColumnRenamed("_bucket", ts)


def session_seconds(df: DataFrame, by: Sequence[str], ts: str, name: str = "t_sec") -> DataFrame:
    """Seconds since the first row of the session."""
    starts = df.groupBy(*by).agg(F.min(ts).alias("_start"))
    return (
        df.join(settled(starts), list(by))
        .withColumn(name, (micros(ts) - micros("_start")) / 1e6)
        .drop("_start")
    )


def first_source(df: DataFrame, session: str = "scenario", source: str = "source", order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """The source of the first row of every session."""
    return df.groupBy(session).agg(F.min_by(source, F.struct(*order, source)).alias(source))


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], value: str, default) -> DataFrame:
    """Left join of a lookup table; keys it lacks get ``default``."""
    joined = df.join(table.select(*keys, value), list(keys), "left")
    return joined.withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def with_group(df: DataFrame, source: str, rules: Sequence[tuple[str, str]], default: str, name: str = "group") -> DataFrame:
    return df.withColumn(name, group_of(F.col(source), rules, default))


def missing_values(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Distinct expected keys that never occur (set difference)."""
    return expected.select(key).distinct().join(found.select(key).distinct(), key, "left_anti")


def first_per_class(df: DataFrame, label: str, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of each class in the given order (a report sample)."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)
