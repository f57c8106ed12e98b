"""Summary tables of recordings, phone logs and labelled data sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearsky.functions.labels import scenario_of
from clearsky.functions.scalars import degrees_to_metres
from clearsky.operators.ordered import attach, exact_quantiles, settled
from clearsky.schemas import FEATURES


def _share(part: Column, whole: Column, factor: float = 100.0) -> Column:
    """``part`` of ``whole`` in percent; nothing of nothing is 0."""
    return F.coalesce(factor * part / F.greatest(whole, F.lit(1)), F.lit(0.0))


def epoch_signal_stats(obs: DataFrame, by: Sequence[str], satellite: str = "satellite", cnr: str = "cnr") -> DataFrame:
    """Mean, least and greatest C/N0 and satellites heard per epoch."""
    return (
        obs.where(F.col(cnr).isNotNull())
        .groupBy(*by)
        .agg(
            F.avg(cnr).alias("mean_cnr"),
            F.min(cnr).alias("min_cnr"),
            F.max(cnr).alias("max_cnr"),
            F.count_distinct(satellite).alias("sat_count"),
        )
    )


def constellation_stats(
    obs: DataFrame, by: Sequence[str], constellation: str = "constellation", satellite: str = "satellite", cnr: str = "cnr"
) -> DataFrame:
    """Mean C/N0 and satellites (heard or not) per epoch and constellation."""
    return obs.groupBy(*by, constellation).agg(
        F.avg(cnr).alias("mean_cnr"), F.count_distinct(satellite).alias("sat_count")
    )


def constellation_matrix(
    obs: DataFrame, by: Sequence[str], constellations: Sequence, constellation: str = "constellation", satellite: str = "satellite"
) -> DataFrame:
    """Satellites per epoch, one column per constellation, 0 where none."""
    return (
        obs.groupBy(*by)
        .pivot(constellation, list(constellations))
        .agg(F.count_distinct(satellite))
        .na.fill(0)
    )


def run_summary(
    obs: DataFrame, by: Sequence[str], seconds: str = "t_sec", cnr: str = "cnr", constellation: str = "constellation",
    constellations: Sequence = (),
) -> DataFrame:
    """Key figures per recording, with the mean C/N0 of each constellation."""
    heard = F.count(cnr)
    base = obs.groupBy(*by).agg(
        F.max(seconds).alias("duration_s"),
        F.count_distinct(seconds).alias("total_epochs"),
        (F.count(F.lit(1)) / F.greatest(F.count_distinct(seconds), F.lit(1))).alias("obs_per_epoch"),
        F.avg(cnr).alias("mean_cnr"),
        F.stddev_samp(cnr).alias("std_cnr"),
        F.min(cnr).alias("min_cnr"),
        _share(F.sum((F.col(cnr) < 30).cast("int")), heard).alias("below_30_pct"),
        _share(F.sum((F.col(cnr) < 25).cast("int")), heard).alias("below_25_pct"),
        *[F.avg(F.when(F.col(constellation) == c, F.col(cnr))).alias(f"mean_cnr_{c}") for c in constellations],
    )
    medians = exact_quantiles(obs, cnr, {"median_cnr": 0.5}, by)
    return base.join(medians, list(by), "left")


def run_trends(obs: DataFrame, run: Sequence[str], seconds: str = "t_sec", cnr: str = "cnr") -> DataFrame:
    """Mean C/N0 per second of each run, for comparison."""
    return (
        obs.where(F.col(cnr).isNotNull()).groupBy(*run, seconds).agg(F.avg(cnr).alias("mean_cnr"))
    )


def run_comparison(obs: DataFrame, run: Sequence[str], seconds: str = "t_sec", cnr: str = "cnr") -> DataFrame:
    """One line per run: duration, mean C/N0, share below 25, epochs."""
    return obs.groupBy(*run).agg(
        F.max(seconds).alias("duration_s"),
        F.avg(cnr).alias("mean_cnr"),
        _share(F.sum((F.col(cnr) < 25).cast("int")), F.count(cnr)).alias("below_25_pct"),
        F.count_distinct(seconds).alias("total_epochs"),
    )


def phone_statistics(fixes: DataFrame, status: DataFrame | None, by: Sequence[str] = ("path",)) -> DataFrame:
    """Statistics per phone recording.

    The radial spread is the mean distance (in degrees) from the mean position:
    two grouped passes, the means joined back to the rows.
    """
    by = list(by)
    centre = fixes.groupBy(*by).agg(F.avg("latitude").alias("_lat"), F.avg("longitude").alias("_lon"))
    radius = F.sqrt(
        F.pow(F.col("latitude") - F.col("_lat"), 2) + F.pow(F.col("longitude") - F.col("_lon"), 2)
    )
    out = (
        fixes.join(settled(centre), by)
        .groupBy(*by)
        .agg(
            F.min("unix_time_ms").alias("start_ms"),
            F.max("unix_time_ms").alias("end_ms"),
            ((F.max("unix_time_ms") - F.min("unix_time_ms")) / 1000).alias("duration_sec"),
            F.count(F.lit(1)).alias("num_fixes"),
            F.avg("accuracy_meters").alias("avg_accuracy"),
            F.min("accuracy_meters").alias("min_accuracy"),
            F.max("accuracy_meters").alias("max_accuracy"),
            F.avg("num_used_signals").alias("avg_satellites"),
            F.min("num_used_signals").alias("min_satellites"),
            F.max("num_used_signals").alias("max_satellites"),
            (F.max("latitude") - F.min("latitude")).alias("latitude_range"),
            (F.max("longitude") - F.min("longitude")).alias("longitude_range"),
            F.avg(radius).alias("position_std"),
        )
        .withColumn("position_std_m", degrees_to_metres(F.col("position_std")))
    )
    if status is None:
        return out.withColumns(
            {
                **{c: F.lit(None).cast("double") for c in ("avg_cn0", "min_cn0", "max_cn0")},
                "total_signals": F.lit(0).cast("long"),
            }
        )
    signals = status.groupBy(*by).agg(
        F.avg("cn0_dbhz").alias("avg_cn0"),
        F.min("cn0_dbhz").alias("min_cn0"),
        F.max("cn0_dbhz").alias("max_cn0"),
        F.count(F.lit(1)).alias("total_signals"),
    )
    return out.join(signals, by, "left").withColumn(
        "total_signals", F.coalesce("total_signals", F.lit(0).cast("long"))
    )


def identify_scenarios(stats: DataFrame) -> DataFrame:
    """Add the test scenario each recording's statistics point to."""
    return stats.withColumn(
        "scenario",
        scenario_of(
            F.col("avg_accuracy"),
            F.col("max_accuracy"),
            F.col("min_satellites"),
            F.col("avg_satellites"),
            F.col("avg_cn0"),
            F.col("duration_sec"),
            F.col("position_std"),
        ),
    )


def location_comparison(fixes: DataFrame, status: DataFrame, by: Sequence[str]) -> DataFrame:
    """Duration, C/N0 and fixes per location; locations lacking either record kind are left out."""
    places = fixes.groupBy(*by).agg(
        ((F.max("unix_time_ms") - F.min("unix_time_ms")) / 1000).alias("duration"),
        F.count(F.lit(1)).alias("num_fixes"),
    )
    signals = status.groupBy(*by).agg(
        F.avg("cn0_dbhz").alias("avg_cn0"),
        F.min("cn0_dbhz").alias("min_cn0"),
        F.max("cn0_dbhz").alias("max_cn0"),
    )
    return places.join(signals, list(by))


def quadratic_trends(
    df: DataFrame, by: Sequence[str], x: str, y: str, points: int = 100, key: str = "step"
) -> DataFrame:
    """Least-squares parabola of ``y`` on ``x`` per group at evenly spaced ``x``.

    Power sums of the centred and scaled ``x`` in one aggregate, then the 3 x 3
    normal equations by determinants. Groups with fewer than three rows, or with
    fewer than three distinct ``x``, have no trend.
    """
    by = list(by)
    usable = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranges = usable.groupBy(*by).agg(
        F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.avg(x).alias("_mid")
    )
    scale = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-12))
    u = (F.col(x) - F.col("_mid")) / scale
    sums = (
        usable.join(settled(ranges), by)
        .withColumn("_u", u)
        .groupBy(*by, "_lo", "_hi", "_mid")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(F.pow("_u", F.lit(k))).alias(f"s{k}") for k in (1, 2, 3, 4)],
            F.sum(y).alias("t0"),
            F.sum(F.col("_u") * F.col(y)).alias("t1"),
            F.sum(F.col("_u") * F.col("_u") * F.col(y)).alias("t2"),
        )
    )
    n, s1, s2, s3, s4 = (F.col(c) for c in ("n", "s1", "s2", "s3", "s4"))
    t0, t1, t2 = F.col("t0"), F.col("t1"), F.col("t2")

    def det(a, b, c, d, e, f, g, h, i):
        return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)

    whole = det(n, s1, s2, s1, s2, s3, s2, s3, s4)
    fitted = sums.where("n > 2").select(
        *by, "_lo", "_hi", "_mid",
        whole.alias("_det"),
        det(t0, s1, s2, t1, s2, s3, t2, s3, s4).alias("_c0"),
        det(n, t0, s2, s1, t1, s3, s2, t2, s4).alias("_c1"),
        det(n, s1, t0, s1, s2, t1, s2, s3, t2).alias("_c2"),
    ).where(F.abs("_det") > 1e-12)
    at = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col(key) / (points - 1)
    v = (F.col(x) - F.col("_mid")) / scale
    value = (F.col("_c0") + F.col("_c1") * v + F.col("_c2") * v * v) / F.col("_det")
    return (
        fitted.withColumn(key, F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn(x, at)
        .select(*by, key, x, value.alias("trend"))
    )


def label_distribution(df: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Rows and share per class; ``rare`` marks a class below 5 %."""
    by = list(by)
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    # One row per class and group from here on.
    total = F.sum("n").over(Window.partitionBy(*by))
    share = 100.0 * F.col("n") / total
    return counts.withColumn("pct", share).withColumn("rare", F.col("pct") < 5.0)


def dataset_summary(df: DataFrame, ts: str = "timestamp", features: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """Rows, sources, time range and feature coverage per scenario and overall.

    ``rollup`` gives the lines per scenario and one line for everything
    (scenario null).
    """
    have = [f for f in features if f in df.columns]
    return df.rollup("scenario").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("source").alias("n_sources"),
        F.min(ts).alias("first_time"),
        F.max(ts).alias("last_time"),
        F.lit(len(have)).alias("features_present"),
    )


def match_report(df: DataFrame, error: str, by: Sequence[str] = ()) -> DataFrame:
    """How many rows found a partner, with mean and 90th percentile of its value."""
    base = df.groupBy(*by).agg(F.count(error).alias("matched"), F.avg(error).alias("mean_error"))
    tail = exact_quantiles(df, error, {"p90_error": 0.9}, by)
    return base.join(tail, list(by), "left") if by else attach(base, tail)


def split_report(df: DataFrame, split: str, label: str, labels: Sequence) -> DataFrame:
    """Rows, share and class counts per split."""
    counts = df.groupBy(split).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum((F.col(label) == v).cast("long")).alias(f"n_{v}") for v in labels],
    )
    share = 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())
    return counts.withColumn("pct", share)


def expected_scenarios(spark, names: Sequence[str], key: str = "scenario") -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], f"{key} string")

