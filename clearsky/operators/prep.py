"""From a labelled feature table to splits, filled and scaled columns, and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearsky.functions.scalars import group_of
from clearsky.operators.ordered import (
    CHUNK_SECONDS,
    attach,
    before_cut,
    cut_points,
    exact_quantiles,
    forward_fill,
    hash_chunk,
    row_blocks,
    row_index,
    running_sums,
    settled,
)
from clearsky.schemas import CNR_FEATURES, HORIZONS, SOURCE_GROUPS, SOURCE_SPLIT_RULES, WINDOW_ROWS

# ---- splits ----------------------------------------------------------------------------------


def temporal_split(
    df: DataFrame, order: Sequence[str], train: float = 0.70, val: float = 0.15, name: str = "split"
) -> DataFrame:
    """First 70 % of the rows by time to train, the next 15 % to val, the rest to test.

    ``order`` must identify rows. The two cut keys are located by counting, so
    the table itself is neither sorted nor shuffled.
    """
    n = df.count()
    first, second = cut_points(df, order, [int(n * train), int(n * (train + val))])
    split = (
        F.when(before_cut(df, order, first), "train")
        .when(before_cut(df, order, second), "val")
        .otherwise("test")
    )
    return df.withColumn(name, split)


def source_split(
    df: DataFrame,
    source: str = "source",
    rules: Sequence[tuple[str, str]] = tuple(SOURCE_SPLIT_RULES),
    default: str = "train",
    name: str = "split",
) -> DataFrame:
    """Split by where the data come from: ordered substring rules on the lower-cased source."""
    return df.withColumn(name, group_of(F.lower(F.col(source)), rules, default))


def split_sizes(n: Column) -> tuple[Column, Column]:
    """(train, validation) sessions of a group of ``n``; the rest is for test."""
    share = F.greatest(F.lit(1), F.bround(n * 0.15).cast("long"))
    train = n - 2 * share
    few = train < 1
    small_train = F.greatest(F.lit(1), n - 1)
    return (
        F.when(few, small_train).otherwise(train),
        F.when(few, F.greatest(F.lit(0), F.floor((n - small_train) / 2))).otherwise(share),
    )


def session_splits(
    sessions: DataFrame,
    session: str = "scenario",
    source: str = "source",
    rules: Sequence[tuple[str, str]] = tuple(SOURCE_GROUPS),
    default_group: str = "other",
    seed: str = "42",
) -> DataFrame:
    """``session, group, split``: whole sessions to splits, 70/15/15 within each group.

    ``sessions`` has one row per session. The order within a group is that of a
    seeded hash, so it does not depend on partitioning.
    """
    grouped = sessions.withColumn("group", group_of(F.col(source), rules, default_group))
    keyed = grouped.withColumn("_key", F.md5(F.concat(F.lit(seed), F.lit(":"), F.col(session))))
    # The hash is uniform, so its first 60 bits, moved to the whole range, cut a group of any size into even chunks.
    head = F.shiftleft(F.conv(F.substring("_key", 1, 15), 16, 10).cast("long") - F.lit(1 << 59), 4)
    chunked = keyed.withColumn("_head", head).withColumn("_chunk", hash_chunk(keyed, "_head"))
    placed = running_sums(chunked, ["group"], "_chunk", ["_key", session], {"_at": F.lit(1).cast("long")})
    sizes = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("_n"))
    train, val = split_sizes(F.col("_n"))
    split = (
        F.when(F.col("_at") <= train, "train")
        .when(F.col("_at") <= train + val, "validation")
        .otherwise("test")
    )
    return placed.join(settled(sizes), "group").select(session, "group", split.alias("split"))


def session_split(df: DataFrame, splits: DataFrame, session: str = "scenario") -> DataFrame:
    """Attach session splits to rows; sessions without one go to train."""
    joined = df.join(settled(splits.select(session, "split")), session, "left")
    return joined.withColumn("split", F.coalesce("split", F.lit("train")))


def leave_one_out_folds(df: DataFrame, group: str, groups: Sequence[str]) -> DataFrame:
    """One copy of the table per held-out group with ``fold, role``.

    ``groups`` is the short list of data sets, so the copies are a projection.
    """
    folds = F.explode(F.array(*[F.lit(g) for g in groups]))
    return df.withColumn("fold", folds).withColumn(
        "role", F.when(F.col("fold") == F.col(group), "test").otherwise("train")
    )


# ---- scaling ---------------------------------------------------------------------------------


def fit_standard(df: DataFrame, columns: Sequence[str], split: str = "split") -> DataFrame:
    """Mean and population deviation of the training rows, one row (nulls count as 0)."""
    train = df.where(F.col(split) == "train")
    aggs = []
    for c in columns:
        filled = F.coalesce(F.col(c), F.lit(0.0))
        std = F.stddev_pop(filled)
        aggs += [
            F.avg(filled).alias(f"mean_{c}"),
            F.when(std > 0, std).otherwise(F.lit(1.0)).alias(f"std_{c}"),
        ]
    return train.agg(*aggs)


def apply_standard(df: DataFrame, params: DataFrame, columns: Sequence[str]) -> DataFrame:
    scaled = {
        c: (F.coalesce(F.col(c), F.lit(0.0)) - F.col(f"mean_{c}")) / F.col(f"std_{c}") for c in columns
    }
    return attach(df, params).withColumns(scaled).drop(*params.columns)


def fit_min_max(df: DataFrame, columns: Sequence[str], split: str = "split") -> DataFrame:
    """Least value and range of the training rows, one row; a constant column has range 1."""
    train = df.where(F.col(split) == "train")
    aggs = []
    for c in columns:
        span = F.max(c) - F.min(c)
        aggs += [
            F.min(c).alias(f"min_{c}"),
            F.when(span > 0, span).otherwise(F.lit(1.0)).alias(f"range_{c}"),
        ]
    return train.agg(*aggs)


def apply_min_max(df: DataFrame, params: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale to the training range; other rows may fall outside 0..1."""
    scaled = {c: (F.col(c) - F.col(f"min_{c}")) / F.col(f"range_{c}") for c in columns}
    return attach(df, params).withColumns(scaled).drop(*params.columns)


def scaler_table(params: DataFrame, columns: Sequence[str], parts: tuple[str, str]) -> DataFrame:
    """Fitted parameters as ``position, column, <part>, <part>`` rows for storage."""
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("column"),
                *[F.col(f"{p}_{c}").cast("double").alias(p) for p in parts],
            )
            for i, c in enumerate(columns)
        ]
    )
    return params.select(F.explode(rows).alias("r")).select("r.*")


# ---- imputation ------------------------------------------------------------------------------

_DOP_FROM_SATELLITES = {  # factor over the root of the satellite count, and its limits
    "pdop": (30.0, 1.0, 30.0),
    "hdop": (20.0, 0.5, 20.0),
    "vdop": (25.0, 0.5, 25.0),
    "gdop": (35.0, 1.0, 50.0),
}
SIGMA_PER_HDOP = 2.5


def flag_and_zero_cnr(df: DataFrame, columns: Sequence[str] = tuple(CNR_FEATURES)) -> DataFrame:
    """``cnr_available`` from the first signal column, then nulls of all of them to 0."""
    flag = F.col(columns[0]).isNotNull().cast("float")
    return df.withColumn("cnr_available", flag).na.fill(0.0, subset=list(columns))


def fill_session_median(df: DataFrame, columns: Sequence[str], session: Sequence[str]) -> DataFrame:
    """Median of the session, 0 where the session has no value at all."""
    out = df
    for c in columns:
        medians = settled(exact_quantiles(df, c, {f"_median_{c}": 0.5}, session))
        out = (
            out.join(medians, list(session), "left")
            .withColumn(c, F.coalesce(F.col(c), F.col(f"_median_{c}"), F.lit(0.0)))
            .drop(f"_median_{c}")
        )
    return out


def column_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact medians of several columns as one row ``median_<column>``."""
    long = df.select(
        F.explode(
            F.array(
                *[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
            )
        ).alias("r")
    ).select("r.*")
    medians = exact_quantiles(long, "value", {"m": 0.5}, ["column"])
    return settled(medians).agg(*[F.max(F.when(F.col("column") == c, F.col("m"))).alias(f"median_{c}") for c in columns])


def fill_geometry(df: DataFrame, satellites: str = "num_satellites") -> DataFrame:
    """Position sigmas from the horizontal DOP, then DOPs from the satellite count.

    Sigmas: ``2.5 * hdop``, else the median of that product. DOPs: a factor over
    the root of the satellite count within limits (no satellites: unknown), else
    the median of the column as measured.
    """
    dops = [c for c in [*_DOP_FROM_SATELLITES, "dop_ratio"] if c in df.columns]
    needed = list(dict.fromkeys([*dops, "hdop"])) if "hdop" in df.columns else dops
    known = attach(df, column_medians(df, needed))
    filled = {}
    if "hdop" in df.columns:
        for c in ("lat_std", "lon_std"):
            if c in df.columns:
                filled[c] = F.coalesce(
                    F.col(c), F.col("hdop") * SIGMA_PER_HDOP, F.col("median_hdop") * SIGMA_PER_HDOP
                )
    n = F.when(F.col(satellites) > 0, F.col(satellites))

    def estimate(name: str) -> Column:
        factor, low, high = _DOP_FROM_SATELLITES[name]
        value = F.lit(factor) / F.sqrt(n)
        return F.when(n.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))

    for c in dops:
        if c == "dop_ratio":
            guess = F.when(n.isNotNull(), estimate("hdop") / estimate("vdop")).otherwise(F.lit(1.0))
        else:
            guess = estimate(c)
        filled[c] = F.coalesce(F.col(c), guess, F.col(f"median_{c}"))
    return known.withColumns(filled).drop(*[f"median_{c}" for c in needed])


def fill_rest(
    df: DataFrame, session: Sequence[str], ts: str, order: Sequence[str] | None = None,
    chunk_seconds: float = CHUNK_SECONDS, columns: Sequence[str] | None = None,
) -> DataFrame:
    """Numbers: the last value of the session, then 0. Texts: ``0.0``."""
    keys = {*session, ts, *(order or [])}
    numeric = [
        f.name
        for f in df.schema.fields
        if f.name not in keys and f.dataType.typeName() in ("double", "float", "integer", "long")
    ]
    targets = list(columns) if columns is not None else numeric
    filled = forward_fill(df, session, ts, targets, order, chunk_seconds)
    return filled.na.fill(0.0, subset=targets).na.fill("0.0")


def impute(
    df: DataFrame, session: Sequence[str], ts: str = "timestamp", order: Sequence[str] | None = None,
    chunk_seconds: float = CHUNK_SECONDS,
) -> DataFrame:
    """All filling rules in their order: signal, altitude, geometry, the rest."""
    out = flag_and_zero_cnr(df)
    if "alt" in out.columns:
        out = fill_session_median(out, ["alt"], session)
    out = fill_geometry(out)
    return fill_rest(out, session, ts, order, chunk_seconds)


# ---- windows ---------------------------------------------------------------------------------


def training_windows(
    df: DataFrame,
    features: Sequence[str],
    session: Sequence[str],
    ts: str = "timestamp",
    label: str = "label",
    order: Sequence[str] | None = None,
    rows: int = WINDOW_ROWS,
    horizons: Sequence[int] = HORIZONS,
    keep: Sequence[str] = (),
    chunk_seconds: float = CHUNK_SECONDS,
    block_rows: int = 20_000,
) -> DataFrame:
    """Windows of ``rows`` consecutive rows with the labels some steps ahead.

    One output row per window: the session, the time and index of its last row,
    ``X`` (rows x features, float) and ``y_<h>s`` per horizon. Windows stay in
    their session; a session needs more rows than window plus longest horizon.
    Sessions are cut into blocks of rows with a halo on both sides, so neither a
    long session nor its windows gather in one task.
    """
    far = max(horizons)
    order = list(order or [ts])
    slim = df.select(
        *dict.fromkeys([*session, ts, *order, label, *keep]),
        F.array(*[F.col(c).cast("float") for c in features]).alias("_x"),
    )
    indexed = row_index(slim, session, ts, order, chunk_seconds, "end_idx")
    blocks = row_blocks(indexed, "end_idx", block_rows, before=rows - 1, after=far + 1)
    ordered = Window.partitionBy(*session, "_block").orderBy("end_idx")
    built = blocks.withColumns(
        {
            "X": F.collect_list("_x").over(ordered.rowsBetween(-(rows - 1), 0)),
            **{f"y_{h}s": F.lead(label, h).over(ordered) for h in horizons},
            "_far": F.lead("end_idx", far).over(ordered),
            "_beyond": F.lead("end_idx", far + 1).over(ordered),
        }
    )
    # The rows looked ahead to tell how long the session is: the first window also
    # needs one row past its longest horizon, later windows have shown it already.
    long_enough = (F.col("end_idx") > rows) | F.col("_beyond").isNotNull()
    return built.where(
        F.col("_own") & (F.col("end_idx") >= rows) & F.col("_far").isNotNull() & long_enough
    ).select(*session, ts, "end_idx", *keep, "X", *[f"y_{h}s" for h in horizons])


def flatten_windows(df: DataFrame, column: str = "X", name: str = "features") -> DataFrame:
    """Rows x features to one array per window."""
    return df.withColumn(name, F.flatten(column))


# ---- classes ---------------------------------------------------------------------------------


def encode_labels(df: DataFrame, label: str, name: str = "label_code") -> DataFrame:
    """Codes 0, 1, ... in alphabetical order of the class names."""
    # One row per class, numbered in a single small task.
    classes = df.select(label).where(F.col(label).isNotNull()).distinct()
    codes = classes.withColumn(name, F.row_number().over(Window.orderBy(label)) - 1)
    return df.join(settled(codes), label, "left")


def balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Row weight: rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    everything = Window.partitionBy()  # over one row per class
    weights = counts.select(
        label,
        (F.sum("_n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("_n"))).alias(name),
    )
    return df.join(settled(weights), label)
