"""Sliding-window signal features, both generations.

``window_features`` looks back 30 seconds including the current row;
``legacy_features`` looks at the 30 rows before the current one. Each uses one
shuffle; all frames share a single partitioning and sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearsky.functions.scalars import code_map
from clearsky.operators.ordered import CHUNK_SECONDS, micros, row_blocks, row_index, with_halo
from clearsky.schemas import (
    FEATURES,
    FIX_TO_CNR,
    FIX_TO_CNR_OTHER,
    FIX_TO_SCORE,
    FIX_TO_SCORE_OTHER,
    MAX_SATELLITES,
    SESSION,
    WINDOW_ROWS,
    WINDOW_SECONDS,
)


class _Frame:
    """Aggregates over one frame."""

    def __init__(self, frame: Window):
        self.frame = frame

    def count(self, c: str | Column) -> Column:
        return F.count(c).over(self.frame)

    def mean(self, c: str | Column) -> Column:
        return F.avg(c).over(self.frame)

    def variance(self, c: str, fewer: int) -> Column:
        return (F.var_samp if fewer else F.var_pop)(c).over(self.frame)

    def deviation(self, c: str, fewer: int) -> Column:
        return (F.stddev_samp if fewer else F.stddev_pop)(c).over(self.frame)

    def least(self, c: str) -> Column:
        return F.min(c).over(self.frame)

    def greatest(self, c: str) -> Column:
        return F.max(c).over(self.frame)

    def slope(self, value: str, position: str) -> Column:
        """Least-squares slope of the non-null values against their position."""
        slope = F.regr_slope(value, position).over(self.frame)
        return F.when(self.count(value) >= 3, F.coalesce(slope, F.lit(0.0))).otherwise(F.lit(0.0))

    def steps(self, c: str) -> Column:
        """Sum without the step that leads into the first row."""
        return F.sum(c).over(self.frame) - F.first(c, ignorenulls=True).over(self.frame)


class _MergedFrames:
    """The same over two frames that do not overlap: earlier times, and the rows of the same time so far.

    Counts and sums add up, extremes are compared, squared deviations are merged with the
    distance of the means. ``order`` numbers the rows.
    """

    def __init__(self, earlier: Window, peers: Window, order: str):
        self.frames = (earlier, peers)
        self.order = order

    def _both(self, c: Column) -> tuple[Column, Column]:
        return tuple(c.over(f) for f in self.frames)

    def _numbers(self, c: Column) -> tuple[Column, Column]:
        return tuple(F.coalesce(x, F.lit(0.0)) for x in self._both(c))

    def count(self, c: str | Column) -> Column:
        a, b = self._both(F.count(c))
        return a + b

    def _sum(self, c: str | Column) -> Column:
        a, b = self._numbers(F.sum(c))
        return a + b

    def mean(self, c: str | Column) -> Column:
        return self._sum(c) / F.nullif(self.count(c), F.lit(0).cast("long"))

    def _products(self, x: Column, y: Column) -> Column:
        """Sum of products of the distances from the means, for rows where both are known."""
        known = F.when(x.isNotNull() & y.isNotNull(), F.lit(1))
        x, y = F.when(known == 1, x), F.when(known == 1, y)
        n_a, n_b = self._both(F.count(known))
        own_a, own_b = self._numbers(F.covar_pop(x, y))
        x_a, x_b = self._numbers(F.avg(x))
        y_a, y_b = self._numbers(F.avg(y))
        between = (x_b - x_a) * (y_b - y_a) * n_a * n_b / F.greatest(n_a + n_b, F.lit(1))
        return own_a * n_a + own_b * n_b + between

    def variance(self, c: str, fewer: int) -> Column:
        n = self.count(c)
        return F.when(n > fewer, self._products(F.col(c), F.col(c)) / F.greatest(n - fewer, F.lit(1)))

    def deviation(self, c: str, fewer: int) -> Column:
        return F.sqrt(self.variance(c, fewer))

    def least(self, c: str) -> Column:
        return F.least(*self._both(F.min(c)))

    def greatest(self, c: str) -> Column:
        return F.greatest(*self._both(F.max(c)))

    def slope(self, value: str, position: str) -> Column:
        v, at = F.col(value), F.col(position).cast("double")
        placed = F.when(v.isNotNull(), at)
        spread = self._products(placed, placed)
        slope = self._products(v.cast("double"), placed) / F.when(spread > 0, spread)
        return F.when(self.count(value) >= 3, F.coalesce(slope, F.lit(0.0))).otherwise(F.lit(0.0))

    def steps(self, c: str) -> Column:
        first = F.coalesce(*self._both(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(self.order)))))
        return self._sum(c) - first


def window_features(
    epochs: DataFrame,
    session: Sequence[str] = tuple(SESSION),
    ts: str = "timestamp",
    tiebreak: Sequence[str] = (),
    window_seconds: float = WINDOW_SECONDS,
    chunk_seconds: float = CHUNK_SECONDS,
    cnr_fallback: bool = True,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The 35 features per epoch over the trailing ``window_seconds``.

    Rows whose window holds a single epoch are not emitted. Epochs of a session
    should have distinct times; when they do not, name ``tiebreak`` columns that
    order the copies, and a window ends at its own row instead of taking in
    later rows of the same time (any number of rows may share a time). ``cnr_fallback=False`` leaves the signal
    columns null where the window has no C/N0, instead of estimating them from
    the fix quality. ``keep`` names further columns to pass through.
    """
    us = micros(ts)
    width_us = int(window_seconds * 1_000_000)
    rows = with_halo(
        epochs.where(F.col(ts).isNotNull()), ts, chunk_seconds, before_seconds=window_seconds
    ).withColumn("_us", us)
    part = Window.partitionBy(*session, "_chunk")
    ordered = part.orderBy("_us", *tiebreak)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    up_to_previous = ordered.rowsBetween(Window.unboundedPreceding, -1)
    if tiebreak:
        rows = rows.withColumn("_rn", F.row_number().over(ordered))
        same = Window.partitionBy(*session, "_chunk", "_us").orderBy(*tiebreak)
        frame = _MergedFrames(
            part.orderBy("_us").rangeBetween(-width_us, -1),
            same.rowsBetween(Window.unboundedPreceding, Window.currentRow),
            "_rn",
        )
    else:
        frame = _Frame(ordered.rangeBetween(-width_us, Window.currentRow))

    # Steps between neighbours. A window must not count the step that leads into
    # its first row, so each sum below takes that first step off again.
    fix0 = F.coalesce(F.col("fix_quality"), F.lit(0))
    prev_sats = F.last("num_satellites", ignorenulls=True).over(up_to_previous)
    prev_age = F.last("solution_age", ignorenulls=True).over(up_to_previous)
    prev_fix = F.lag(fix0).over(ordered)
    stepped = rows.withColumns(
        {
            "_cnr_pos": F.count("mean_cnr_epoch").over(so_far),
            "_drop": F.when(
                F.col("num_satellites").isNotNull(),
                F.coalesce(F.least(F.col("num_satellites") - prev_sats, F.lit(0.0)), F.lit(0.0)),
            ),
            "_age_step": F.when(
                F.col("solution_age").isNotNull(),
                F.coalesce(F.abs(F.col("solution_age") - prev_age), F.lit(0.0)),
            ),
            "_fix_step": F.coalesce((fix0 != prev_fix).cast("double"), F.lit(0.0)),
            "_gbs": F.sqrt(
                F.pow(F.coalesce(F.col("gbs_lat_err"), F.lit(0.0)), 2)
                + F.pow(F.coalesce(F.col("gbs_lon_err"), F.lit(0.0)), 2)
            ),
        }
    )

    framed = stepped.withColumns(
        {
            "_n": frame.count(F.lit(1)),
            "_first_us": frame.least("_us"),
            "_lat_std": frame.mean("lat_sigma"),
            "_lon_std": frame.mean("lon_sigma"),
            "_lat_var": frame.variance("lat_sigma", 1),
            "_lon_var": frame.variance("lon_sigma", 1),
            "_lat_n": frame.count("lat_sigma"),
            "_cnr_mean": frame.mean("mean_cnr_epoch"),
            "_cnr_min": frame.least("mean_cnr_epoch"),
            "_cnr_max": frame.greatest("mean_cnr_epoch"),
            "_cnr_std": frame.deviation("mean_cnr_epoch", 0),
            "_cnr_trend": frame.slope("mean_cnr_epoch", "_cnr_pos"),
            "_sat_mean": frame.mean("num_satellites"),
            "_sat_min": frame.least("num_satellites"),
            "_sat_n": frame.count("num_satellites"),
            "_sat_drop": frame.steps("_drop"),
            "_fix_share": frame.mean((fix0 >= 1).cast("double")),
            "_fix_changes": frame.steps("_fix_step"),
            "_age_n": frame.count("solution_age"),
            "_age_steps": frame.steps("_age_step"),
            "_rms_mean": frame.mean("rms_error"),
            "_rms_std": frame.deviation("rms_error", 1),
            "_rms_n": frame.count("rms_error"),
            "_gbs_n": frame.count("gbs_lat_err"),
            "_gbs_mean": frame.mean("_gbs"),
            "_gbs_std": frame.deviation("_gbs", 1),
        }
    ).where((F.col("_n") >= 2) & F.col("_own"))
    return finish_features(framed, session, ts, keep, cnr_fallback)


def finish_features(framed: DataFrame, session: Sequence[str], ts: str, keep: Sequence[str], cnr_fallback: bool) -> DataFrame:
    """Per-row arithmetic on the window aggregates."""
    col, lit, when = F.col, F.lit, F.when
    n, hdop, pdop, vdop = col("num_satellites"), col("hdop"), col("pdop"), col("vdop")
    fix0 = F.coalesce(col("fix_quality"), lit(0))

    estimate = (
        code_map(fix0, FIX_TO_CNR, FIX_TO_CNR_OTHER) if cnr_fallback else lit(None).cast("double")
    )
    have_cnr = col("_cnr_mean").isNotNull()
    mean_cnr = F.coalesce(col("_cnr_mean"), estimate)
    missing_as = lit(0.0) if cnr_fallback else lit(None).cast("double")
    std_cnr = when(have_cnr, col("_cnr_std")).otherwise(missing_as)
    pos_var = when(col("_lat_n") > 0, col("_lat_var") + col("_lon_var")).otherwise(F.pow(hdop * 2.5, 2))
    span = F.greatest((col("_us") - col("_first_us")) / 1e6, lit(1.0))
    tdop = F.greatest(pdop / F.greatest(n, lit(1.0)), lit(0.5))
    features = {
        "lat": col("lat"),
        "lon": col("lon"),
        "alt": col("alt"),
        "lat_std": col("_lat_std"),
        "lon_std": col("_lon_std"),
        "mean_cnr": mean_cnr,
        "min_cnr": F.coalesce(col("_cnr_min"), estimate),
        "max_cnr": F.coalesce(col("_cnr_max"), estimate),
        "std_cnr": std_cnr,
        "cnr_trend": when(have_cnr, col("_cnr_trend")).otherwise(missing_as),
        "num_satellites": n,
        "sat_mean": F.coalesce(col("_sat_mean"), lit(0.0)),
        "sat_min": F.coalesce(col("_sat_min"), lit(0.0)),
        "sat_visibility": when(n.isNotNull(), F.least(n / MAX_SATELLITES, lit(1.0))),
        "sat_drop_rate": when(col("_sat_n") > 1, col("_sat_drop") / span).otherwise(lit(0.0)),
        "pdop": pdop,
        "hdop": hdop,
        "vdop": vdop,
        "gdop": when(n.isNotNull() & pdop.isNotNull(), F.sqrt(pdop * pdop + tdop * tdop)),
        "dop_ratio": when(vdop > 0, hdop / when(vdop > 0, vdop)).otherwise(hdop),
        "solution_status": code_map(fix0, FIX_TO_SCORE, FIX_TO_SCORE_OTHER),
        "baseline_sats": n,
        "solution_age": col("solution_age"),
        "fix_continuity": col("_fix_share"),
        "fix_transitions": col("_fix_changes"),
        "position_variance": pos_var,
        "cnr_variance": std_cnr * std_cnr,
        "elevation_violations": when(n > 0, F.greatest((n - 20) / 20, lit(0.0))).otherwise(lit(0.0)),
        "multipath": pos_var * (lit(50.0) / F.greatest(mean_cnr, lit(1.0)))
        if cnr_fallback
        else when(mean_cnr.isNotNull(), pos_var * (lit(50.0) / F.greatest(mean_cnr, lit(1.0)))),
        "clock_bias": when(col("_age_n") > 0, col("_age_steps") / when(col("_age_n") > 0, col("_age_n"))),
        "iono_delay": lit(0.0),
        "tropo_delay": F.greatest(
            lit(0.0), lit(2.3) - 0.0116 * F.greatest(F.coalesce(col("alt"), lit(50.0)), lit(0.0))
        ),
        "cycle_slips": col("cycle_slips_epoch").cast("double"),
        "residual_mean": when(col("_rms_n") > 0, col("_rms_mean"))
        .when(col("_gbs_n") > 0, col("_gbs_mean"))
        .otherwise(hdop * 2.0),
        "residual_std": when(col("_rms_n") > 1, col("_rms_std"))
        .when(col("_rms_n") > 0, lit(0.0))
        .when(col("_gbs_n") > 0, col("_gbs_std"))
        .otherwise(std_cnr * 0.1),
    }
    return framed.select(
        ts, *session, *[c for c in keep], *[features[f].cast("double").alias(f) for f in FEATURES]
    )


def legacy_features(
    fixes: DataFrame,
    session: Sequence[str] = ("source",),
    ts: str = "timestamp",
    order: Sequence[str] | None = None,
    window_rows: int = WINDOW_ROWS,
    chunk_seconds: float = CHUNK_SECONDS,
    block_rows: int = 50_000,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The 35 features over the ``window_rows`` rows before the current one.

    Input columns are those of a solver solution (``latitude, longitude,
    altitude, q, ns, sdn, sde, age, ratio``), each optional but the position;
    ``cnr``, the DOPs, ``iono_delay``, ``tropo_delay`` and ``cycle_slips`` are
    used when present. The first ``window_rows`` rows of a session only serve
    as history.
    """
    order = list(order or [ts])
    have = set(fixes.columns)

    def or_default(name: str, value: float | None) -> Column:
        return F.col(name).cast("double") if name in have else F.lit(value).cast("double")

    base = fixes.select(
        *dict.fromkeys([*session, *order, ts, *keep]),
        *[
            or_default(name, value).alias(f"_{name}")
            for name, value in {
                "latitude": None, "longitude": None, "altitude": None,
                "pdop": 2.5, "hdop": 2.0, "vdop": 1.5, "gdop": 3.0,
                "iono_delay": 0.0, "tropo_delay": 0.0, "cycle_slips": 0.0, "age": 0.0,
            }.items()
        ],
        or_default("sdn", 0.05).alias("_sdn"),
        or_default("sde", 0.05).alias("_sde"),
        or_default("ratio", 0.0).alias("_ratio"),
        or_default("q", 5.0).alias("_q"),
        or_default("ns", 8.0).alias("_ns"),
        (F.col("ns").cast("double") if "ns" in have else F.lit(0.0)).alias("_base_ns"),
        (
            F.col("cnr").cast("double")
            if "cnr" in have
            else 50 - 5 * (F.col("q").cast("double") if "q" in have else F.lit(1.0))
        ).alias("_cnr"),
    )
    indexed = row_index(base, session, ts, order, chunk_seconds, "_idx")
    rows = row_blocks(indexed, "_idx", block_rows, before=window_rows)
    ordered = Window.partitionBy(*session, "_block").orderBy("_idx")
    frame = ordered.rowsBetween(-window_rows, -1)

    def over(c: Column) -> Column:
        return c.over(frame)

    stepped = rows.withColumns(
        {
            "_drop": F.coalesce(F.least(F.col("_ns") - F.lag("_ns").over(ordered), F.lit(0.0)), F.lit(0.0)),
            "_rise": F.coalesce((F.col("_q") > F.lag("_q").over(ordered)).cast("double"), F.lit(0.0)),
        }
    )
    framed = stepped.withColumns(
        {
            "lat_std": over(F.avg("_sdn")),
            "lon_std": over(F.avg("_sde")),
            "_var": over(F.var_samp("_sdn")) + over(F.var_samp("_sde")),
            "mean_cnr": over(F.avg("_cnr")),
            "min_cnr": over(F.min("_cnr")),
            "max_cnr": over(F.max("_cnr")),
            "std_cnr": over(F.stddev_samp("_cnr")),
            "cnr_trend": (over(F.last("_cnr")) - over(F.first("_cnr"))) / F.lit(float(window_rows)),
            "sat_mean": over(F.avg("_ns")),
            "sat_min": over(F.min("_ns")),
            "sat_drop_rate": (over(F.sum("_drop")) - over(F.first("_drop"))) / F.lit(float(window_rows)),
            "fix_continuity": over(F.avg(F.coalesce((F.col("_q") == 1).cast("double"), F.lit(0.0)))),
            "fix_transitions": over(F.sum("_rise")) - over(F.first("_rise")),
            "residual_mean": over(F.avg("_ratio")),
            "residual_std": over(F.stddev_samp("_ratio")),
        }
    ).where(F.col("_own") & (F.col("_idx") > window_rows))
    derived = {
        "lat": F.col("_latitude"),
        "lon": F.col("_longitude"),
        "alt": F.col("_altitude"),
        "num_satellites": F.col("_ns"),
        "sat_visibility": F.col("_ns") / 32,
        "pdop": F.col("_pdop"),
        "hdop": F.col("_hdop"),
        "vdop": F.col("_vdop"),
        "gdop": F.col("_gdop"),
        "dop_ratio": F.when(F.col("_vdop") > 0, F.col("_hdop") / F.when(F.col("_vdop") > 0, F.col("_vdop"))).otherwise(F.col("_hdop")),
        "solution_status": F.when(
            F.col("_q").isNotNull(), 1 - (F.least(F.col("_q"), F.lit(5.0)) - 1) / 4
        ),
        "baseline_sats": F.col("_base_ns"),
        "solution_age": F.col("_age"),
        "position_variance": F.col("_var"),
        "cnr_variance": F.col("std_cnr") * F.col("std_cnr"),
        "elevation_violations": F.greatest(8 - F.col("_ns"), F.lit(0.0)) / 8,
        "multipath": F.when(F.col("mean_cnr").isNotNull(), F.col("_var") / F.greatest(F.col("mean_cnr"), F.lit(1.0))),
        "clock_bias": F.col("_age"),
        "iono_delay": F.col("_iono_delay"),
        "tropo_delay": F.col("_tropo_delay"),
        "cycle_slips": F.col("_cycle_slips"),
    }
    return framed.select(
        ts, *session, *keep, *[derived.get(f, F.col(f)).cast("double").alias(f) for f in FEATURES]
    )
