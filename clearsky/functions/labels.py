"""Labelling rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clearsky.functions.scalars import horizontal_error
from clearsky.schemas import CLASS_NAMES


def _yes(condition: Column) -> Column:
    """A condition on a missing value does not hold."""
    return F.coalesce(condition, F.lit(False))


def _any(*conditions: Column) -> Column:
    out = _yes(conditions[0])
    for c in conditions[1:]:
        out = out | _yes(c)
    return out


def _all_available(*conditions: Column) -> Column:
    """Every condition that can be judged holds, and at least one can be judged."""
    held = F.coalesce(conditions[0], F.lit(True))
    judged = conditions[0].isNotNull()
    for c in conditions[1:]:
        held = held & F.coalesce(c, F.lit(True))
        judged = judged | c.isNotNull()
    return held & judged


def label_name(label: Column) -> Column:
    out = None
    for code, name in CLASS_NAMES.items():
        out = F.when(label == code, name) if out is None else out.when(label == code, name)
    return out


def legacy_label(
    lat_std: str | Column = "lat_std",
    lon_std: str | Column = "lon_std",
    mean_cnr: str | Column = "mean_cnr",
    num_satellites: str | Column = "num_satellites",
    solution_status: str | Column = "solution_status",
    fix_continuity: str | Column = "fix_continuity",
) -> Column:
    """First-generation label name; a missing value never meets a condition."""
    lat, lon, cnr, n, status, cont = (
        F.col(c) if isinstance(c, str) else c
        for c in (lat_std, lon_std, mean_cnr, num_satellites, solution_status, fix_continuity)
    )
    err = horizontal_error(lat, lon)
    degraded = _any(err > 5.0, cnr < 30.0, n < 4, status < 0.25, cont < 0.1)
    clean = _yes((err < 2.0) & (cnr > 35.0) & (n >= 6) & (status >= 0.75) & (cont >= 0.7))
    return F.when(degraded, "DEGRADED").when(clean, "CLEAN").otherwise("WARNING")


def quality_label(
    mean_cnr: str | Column = "mean_cnr",
    hdop: str | Column = "hdop",
    pdop: str | Column = "pdop",
    num_satellites: str | Column = "num_satellites",
    solution_status: str | Column = "solution_status",
) -> Column:
    """Second-generation label 0/1/2; conditions on missing values are skipped."""
    cnr, h, p, n, status = (
        F.col(c) if isinstance(c, str) else c
        for c in (mean_cnr, hdop, pdop, num_satellites, solution_status)
    )
    degraded = _any(cnr < 25.0, h > 5.0, p > 8.0, n < 4, status == 0.0)
    clean = _all_available(cnr >= 35.0, h <= 2.5, p <= 4.0, n >= 8, status > 0.0)
    return F.when(degraded, F.lit(2)).when(clean, F.lit(0)).otherwise(F.lit(1))


def sigma_label(
    clean_sigma: float = 3.0,
    degraded_sigma: float = 10.0,
    clean_satellites: int = 5,
    degraded_satellites: int = 3,
    lat_std: str | Column = "lat_std",
    lon_std: str | Column = "lon_std",
    num_satellites: str | Column = "num_satellites",
    solution_status: str | Column = "solution_status",
) -> Column:
    """Label from position sigmas, for sources without C/N0.

    Campus recordings use (2, 5, 1, 0), vehicle recordings the defaults.
    """
    lat, lon, n, status = (
        F.col(c) if isinstance(c, str) else c for c in (lat_std, lon_std, num_satellites, solution_status)
    )
    degraded = _any(status == 0.0, lat > degraded_sigma, lon > degraded_sigma, n < degraded_satellites)
    clean = _all_available(lat < clean_sigma, lon < clean_sigma, n >= clean_satellites)
    return F.when(degraded, F.lit(2)).when(clean, F.lit(0)).otherwise(F.lit(1))


def cnr_rule(mean_cnr: str | Column = "mean_cnr") -> Column:
    """Expert rule on the unscaled window mean: below 30 is 2, below 37 is 1."""
    c = F.col(mean_cnr) if isinstance(mean_cnr, str) else mean_cnr
    return F.when(c < 30.0, F.lit(2)).when(c < 37.0, F.lit(1)).otherwise(F.lit(0))


def cnr_band(cn0: str | Column) -> Column:
    """Display band of a single C/N0 value."""
    c = F.col(cn0) if isinstance(cn0, str) else cn0
    return (
        F.when(c >= 35, "CLEAN").when(c >= 30, "WARNING").when(c >= 25, "DEGRADED")
        .when(c >= 10, "POOR").when(c.isNotNull(), "SEVERE")
    )


def accuracy_band(accuracy: str | Column) -> Column:
    """Display band of a position accuracy in metres."""
    c = F.col(accuracy) if isinstance(accuracy, str) else accuracy
    return (
        F.when(c <= 2, "CLEAN").when(c <= 5, "WARNING").when(c <= 10, "DEGRADED")
        .when(c.isNotNull(), "SEVERE")
    )


def scenario_of(
    avg_accuracy: Column,
    max_accuracy: Column,
    min_satellites: Column,
    avg_satellites: Column,
    avg_cn0: Column,
    duration_sec: Column,
    position_std: Column,
) -> Column:
    """Which test scenario a phone recording shows, from its statistics."""

    def between(c: Column, low: float, high: float) -> Column:
        return (c > low) & (c < high)

    blocked = (min_satellites == 0) & (avg_satellites < 2) & (duration_sec < 60)
    open_sky = (avg_satellites >= 10) & (avg_accuracy < 10) & (avg_cn0 > 38)
    canyon = between(avg_satellites, 5, 10) & between(avg_accuracy, 10, 30) & (avg_cn0 > 28) & (position_std > 0.0001)
    partial = (
        between(avg_satellites, 5, 9) & between(avg_accuracy, 5, 15) & between(avg_cn0, 30, 36)
        & (position_std < 0.00005)
    )
    approach = (
        between(avg_satellites, 5, 11) & between(avg_accuracy, 10, 25) & between(avg_cn0, 25, 35)
        & (position_std > 0.00008)
    )
    return (
        F.when(avg_cn0.isNull() | (avg_cn0 == 0), "UNKNOWN")
        .when(blocked, "SCENARIO_A_INSTANT_BLOCKAGE")
        .when(open_sky, "SCENARIO_D_OPEN_SKY")
        .when(canyon, "SCENARIO_B_URBAN_CANYON")
        .when(partial, "SCENARIO_C_PARTIAL_BLOCKAGE")
        .when(approach, "SCENARIO_E_APPROACHING_BLOCKAGE")
        .when(max_accuracy > 50, "SCENARIO_A_or_E (HIGH_ACCURACY_VARIANCE)")
        .when(avg_satellites < 5, "SCENARIO_A_or_C (LOW_SATELLITES)")
        .when(avg_accuracy < 5, "SCENARIO_D_or_C (GOOD_ACCURACY)")
        .otherwise("UNKNOWN")
    )
