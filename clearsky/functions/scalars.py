"""Scalar functions over columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

METRES_PER_DEGREE = 111000.0
WGS84_A = 6378137.0
WGS84_F = 1.0 / 298.257223563


def number(c: Column, kind: str = "double") -> Column:
    """Number in a text field; null when empty, malformed or NaN."""
    value = F.nullif(F.trim(c), F.lit("")).try_cast(kind)
    return F.nanvl(value, F.lit(None)) if kind in ("double", "float") else value


def numbers(parts: Column) -> Column:
    """All fields of a split line as numbers, null where a field is none.

    One small function applied per field: a projection that spells out a cast
    for each of many fields grows past what the virtual machine compiles. Fields
    that cannot start a number are not tried, as a failing cast is slow.
    """
    return F.transform(
        F.transform(parts, lambda x: F.trim(x)),
        lambda x: F.when((x >= "+") & (x < ":"), F.nanvl(x.try_cast("double"), F.lit(None))),
    )


def field(parts: Column, index: int) -> Column:
    """Field ``index`` (0-based) of a split line, null when absent or empty."""
    return F.nullif(F.get(parts, F.lit(index)), F.lit(""))


def code_map(code: Column, values: dict[int, float], other: float | None = None) -> Column:
    """Value of an integer code, ``other`` for codes not listed."""
    items = iter(values.items())
    key, value = next(items)
    out = F.when(code == key, F.lit(value))
    for key, value in items:
        out = out.when(code == key, F.lit(value))
    return out.otherwise(F.lit(other).cast("double"))


def nmea_date(ddmmyy: Column) -> Column:
    """``DDMMYY`` to a date; two-digit years below 80 lie in the 2000s."""
    ok = F.length(ddmmyy) == 6
    yy = F.substring(ddmmyy, 5, 2).try_cast("int")
    year = F.when(yy < 80, yy + 2000).otherwise(yy + 1900)
    text = F.concat_ws("-", year, F.substring(ddmmyy, 3, 2), F.substring(ddmmyy, 1, 2))
    return F.when(ok & yy.isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))


def nmea_time(hhmmss: Column, date: Column) -> Column:
    """``HHMMSS.SS`` on a date to a UTC timestamp; invalid parts give null."""
    hh = F.substring(hhmmss, 1, 2).try_cast("int")
    mm = F.substring(hhmmss, 3, 2).try_cast("int")
    ss = F.substring(hhmmss, 5, 32).try_cast("double")
    # Microseconds are rounded on their own, as a seconds value of 59.9999999 is not valid time.
    us = F.round((ss - F.floor(ss)) * 1_000_000)
    valid = (
        (F.length(hhmmss) >= 6)
        & hh.between(0, 23)
        & mm.between(0, 59)
        & (ss >= 0)
        & (ss < 60)
        & (us < 1_000_000)
    )
    day_us = F.unix_micros(date.cast("timestamp"))
    of_day = (hh * 3600 + mm * 60).cast("long") * 1_000_000 + F.floor(ss) * 1_000_000 + us.cast("long")
    return F.when(valid, F.timestamp_micros(day_us + of_day))


def nmea_degrees(value: Column, hemisphere: Column, degree_digits: int) -> Column:
    """``DDMM.mmmm`` (2 digits) or ``DDDMM.mmmm`` (3) to signed degrees."""
    degrees = F.substring(value, 1, degree_digits).try_cast("double")
    minutes = F.substring(value, degree_digits + 1, 32).try_cast("double")
    size = degrees + minutes / 60
    return F.when(F.upper(hemisphere).isin("S", "W"), -size).otherwise(size)


def nmea_degrees_legacy(value: Column, hemisphere: Column) -> Column:
    """The older rule: the last 7 characters are minutes, all before are degrees."""
    split_at = F.length(value) - 7
    degrees = F.substring(value, F.lit(1), split_at).try_cast("int")
    minutes = F.substring(value, split_at + 1, F.lit(7)).try_cast("double")
    size = F.when(F.length(value) >= 8, degrees + minutes / 60)
    return F.when(hemisphere.isin("S", "W"), -size).otherwise(size)


def snr_digit_to_cnr(digit: Column, table: str = "formula") -> Column:
    """Signal-strength digit (0-9) to C/N0 in dB-Hz.

    ``formula`` steps by 6 dB from 6 (0 for no signal); ``midpoints`` takes the
    middle of each band (null for no signal).
    """
    if table == "formula":
        return F.when(digit <= 0, F.lit(0.0)).otherwise(((digit - 1) * 6 + 6).cast("double"))
    if table == "midpoints":
        from clearsky.schemas import SNR_MIDPOINTS

        return code_map(digit, SNR_MIDPOINTS)
    raise ValueError(f"unknown table {table!r}")


def epoch_to_timestamp(value: Column) -> Column:
    """Numeric time since 1970 in s, ms, us or ns, told apart by magnitude."""
    size = F.abs(value)
    us = (
        F.when(size < 1e11, value * 1e6)
        .when(size < 1e14, value * 1e3)
        .when(size < 1e17, value.cast("double"))
        .otherwise(value / 1e3)
    )
    return F.timestamp_micros(F.round(us).cast("long"))


def sequence_clock(row: Column, start: str = "2024-01-01", step_seconds: float = 0.01) -> Column:
    """Clock of a recording without usable time: ``row`` is 1-based."""
    start_us = F.unix_micros(F.lit(start).cast("timestamp"))
    return F.timestamp_micros(start_us + ((row - 1) * int(step_seconds * 1_000_000)).cast("long"))


def ecef_to_geodetic(x: Column, y: Column, z: Column, iterations: int = 5) -> tuple[Column, Column, Column]:
    """Earth-centred metres to (latitude, longitude, altitude) on WGS84.

    The fixed iteration is nested as array steps, so the expression stays linear
    in the number of steps.
    """
    e2 = 2 * WGS84_F - WGS84_F**2
    p = F.sqrt(x * x + y * y)

    def step(state: Column, _: Column) -> Column:
        lat = state[0]
        radius = F.lit(WGS84_A) / F.sqrt(1 - F.lit(e2) * F.sin(lat) * F.sin(lat))
        alt = p / F.cos(lat) - radius
        return F.array(F.atan2(z, p * (1 - F.lit(e2) * radius / (radius + alt))), alt)

    start = F.array(F.atan2(z, p * (1 - e2)), F.lit(0.0))
    state = F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, step)
    known = x.isNotNull() & y.isNotNull() & z.isNotNull()
    return (
        F.when(known, F.degrees(state[0])),
        F.when(known, F.degrees(F.atan2(y, x))),
        F.when(known, state[1]),
    )


def horizontal_split(error: Column) -> Column:
    """Share of a horizontal error on one axis."""
    return error / F.sqrt(F.lit(2.0))


def horizontal_error(lat_sigma: Column, lon_sigma: Column) -> Column:
    return F.sqrt(lat_sigma * lat_sigma + lon_sigma * lon_sigma)


def degrees_to_metres(degrees: Column) -> Column:
    return degrees * METRES_PER_DEGREE


def fixed_field(text: Column, index: int | Column, width: int = 16) -> Column:
    """Field ``index`` (0-based) of a fixed-width line; shorter or empty at its end."""
    at = (F.lit(index) if isinstance(index, int) else index) * width + 1
    return F.substring(text, at, F.lit(width))


def digit(text: Column) -> Column:
    """Value of a single-digit text, null for anything else."""
    return F.when(text.rlike("^[0-9]$"), text.try_cast("int"))


def group_of(source: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Group of a source name: the first rule whose text occurs in it."""
    out = None
    for text, group in rules:
        hit = source.contains(text)
        out = F.when(hit, F.lit(group)) if out is None else out.when(hit, F.lit(group))
    return out.otherwise(F.lit(default))


def softmax(scores: Column) -> Column:
    """Class probabilities of an array of scores."""
    top = F.array_max(scores)
    raised = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(raised, F.lit(0.0), lambda a, v: a + v)
    return F.transform(raised, lambda v: v / total)


def argmax(scores: Column) -> Column:
    """0-based position of the largest score, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def focal_loss(probability: Column, weight: Column | float = 1.0, gamma: float = 2.0) -> Column:
    """Loss of one sample from the probability given to its true class."""
    p = F.greatest(probability, F.lit(1e-12))
    w = F.lit(weight) if isinstance(weight, (int, float)) else weight
    return -w * F.pow(1 - p, F.lit(gamma)) * F.log(p)
