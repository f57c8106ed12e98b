"""Position recordings in CSV form."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clearsky.functions.scalars import (
    code_map,
    ecef_to_geodetic,
    epoch_to_timestamp,
    horizontal_split,
    number,
    sequence_clock,
)
from clearsky.operators.asof import nearest_asof_join
from clearsky.operators.ordered import CHUNK_SECONDS, attach, running_sums
from clearsky.schemas import FIX_MODE_TO_STATUS
from clearsky.session import stored
from clearsky.sources.delimited import cell, has, place_of, read_delimited

CAMPUS_GPS_8 = ["utime", "fix_mode", "num_sats", "lat_rad", "lng_rad", "alt_m", "track_deg", "speed_ms"]
CAMPUS_GPS_11 = ["utime", "mode", "num_sats", "lat", "lng", "alt", "track", "speed", "climb", "err_horiz", "err_vert"]
CAMPUS_RTK = ["utime", "x", "y", "z"]
CAMPUS_ERROR = ["utime", "err_m"]


def read_headerless(spark: SparkSession, paths, columns: Sequence[str]) -> DataFrame:
    """CSV without header; unreadable numbers become null."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.read.schema(schema).csv(paths)
    return raw.select(*[number(F.col(c)).alias(c) for c in columns], F.col("_metadata.file_path").alias("path"))


def micros_to_timestamp(us: Column) -> Column:
    return F.timestamp_micros(us.cast("long"))


def campus_fixes(rows: DataFrame) -> DataFrame:
    """Campus receiver rows (8 columns, radians): any fix counts 1, none 0.

    The satellite count of these recordings is not usable and stays null.
    """
    mode = F.col("fix_mode").cast("int")
    return rows.select(
        *[c for c in rows.columns if c not in CAMPUS_GPS_8],
        F.col("utime").cast("long").alias("utime"),
        micros_to_timestamp(F.col("utime")).alias("timestamp"),
        F.degrees("lat_rad").alias("lat"),
        F.degrees("lng_rad").alias("lon"),
        F.col("alt_m").alias("alt"),
        F.coalesce(mode.isin(2, 3), F.lit(False)).cast("int").alias("fix_quality"),
        code_map(mode, FIX_MODE_TO_STATUS, 0.0).alias("solution_status_raw"),
        F.lit(None).cast("double").alias("num_satellites"),
    )


def campus_raw(rows: DataFrame) -> DataFrame:
    """Campus raw rows (11 columns, 1e-7 degrees, millimetres); single-point quality."""
    return rows.dropna(subset=CAMPUS_GPS_11).select(
        *[c for c in rows.columns if c not in CAMPUS_GPS_11],
        (F.col("utime") / 1e6).alias("timestamp_s"),
        (F.col("lat") / 1e7).alias("latitude"),
        (F.col("lng") / 1e7).alias("longitude"),
        (F.col("alt") / 1000.0).alias("altitude"),
        F.lit(5).alias("solution_quality"),
        F.col("num_sats"),
    )


def campus_rtk(rows: DataFrame) -> DataFrame:
    """Campus precise rows (earth-centred metres); best quality."""
    lat, lon, alt = ecef_to_geodetic(F.col("x"), F.col("y"), F.col("z"))
    return rows.dropna(subset=CAMPUS_RTK).select(
        *[c for c in rows.columns if c not in CAMPUS_RTK],
        (F.col("utime") / 1e6).alias("timestamp_s"),
        lat.alias("latitude"),
        lon.alias("longitude"),
        alt.alias("altitude"),
        F.lit(1).alias("solution_quality"),
    )


def campus_error(rows: DataFrame) -> DataFrame:
    """Position error rows; rows without a number are dropped."""
    return rows.select(
        *[c for c in rows.columns if c not in CAMPUS_ERROR],
        F.col("utime").cast("long").alias("utime"),
        micros_to_timestamp(F.col("utime")).alias("error_time"),
        number(F.col("err_m").cast("string")).alias("err_m"),
    ).dropna(subset=["err_m"])


def campus_epochs(
    fixes: DataFrame, errors: DataFrame | None, by: Sequence[str], tolerance_seconds: float = 0.5,
    right_order: Sequence[str] = (), chunk_seconds: float = CHUNK_SECONDS,
) -> DataFrame:
    """Campus fixes with the nearest position error split evenly on both axes."""
    if errors is None:
        joined = fixes.withColumn("err_m", F.lit(None).cast("double"))
    else:
        joined = nearest_asof_join(
            fixes, errors, by, "timestamp", "error_time", ["err_m"], tolerance_seconds,
            right_order=right_order, chunk_seconds=chunk_seconds,
        )
    sigma = horizontal_split(F.col("err_m"))
    return joined.withColumns({"lat_sigma": sigma, "lon_sigma": sigma})


def vehicle_fixes(rows: DataFrame) -> DataFrame:
    """Vehicle receiver CSV with sigmas (microsecond times); every row is a fix."""
    names = {
        "latitude": "lat",
        "longitude": "lon",
        "altitude": "alt",
        "latitude_sigma": "lat_sigma",
        "longitude_sigma": "lon_sigma",
        "altitude_sigma": "alt_sigma",
    }
    out = rows.withColumnsRenamed(names)
    return out.withColumns(
        {"timestamp": micros_to_timestamp(F.col("timestamp")), "fix_quality": F.lit(1)}
    )


def fused_positions(rows: DataFrame, source: str) -> DataFrame:
    """Vehicle position rows from the fused or plain receiver file, one form."""
    return rows.select(
        *[c for c in rows.columns if c in ("path", "run")],
        (F.col("timestamp") / 1e6).alias("timestamp_s"),
        F.col("latitude").cast("double").alias("latitude"),
        F.col("longitude").cast("double").alias("longitude"),
        F.col("altitude").cast("double").alias("altitude"),
        F.lit(2).alias("solution_quality"),
        F.lit(source).alias("source"),
    )


def normalize_header(df: DataFrame) -> DataFrame:
    """Column names in lower case without surrounding blanks."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def first_present(df: DataFrame, candidates: Sequence[str], numeric_fallback: bool = False) -> str | None:
    """First candidate column the table has, else optionally its first numeric one."""
    for name in candidates:
        if name in df.columns:
            return name
    if numeric_fallback:
        for f in df.schema.fields:
            if isinstance(f.dataType, T.NumericType):
                return f.name
    return None


@dataclass(frozen=True)
class TrajectorySpec:
    """How one family of trajectory files names its time column."""

    time_columns: tuple[str, ...] = ("timestamp", "time", "gps_time", "utc_time")
    numeric_fallback: bool = False
    clock_step: float | None = None  # seconds per row when the file has no time column
    sequence_below: float | None = None  # numbers below this are row counters, not times


# The families the readers know.
VEHICLE = TrajectorySpec()
STREET = TrajectorySpec(
    ("timestamp", "time", "gps_time", "utc_time", "epoch", "date"), clock_step=1.0
)
URBAN = TrajectorySpec(
    ("timestamp", "time", "gps_time", "utc_time", "epoch", "index"),
    numeric_fallback=True,
    clock_step=0.01,
    sequence_below=1_000_000,
)


def standard_trajectory(df: DataFrame, spec: TrajectorySpec = VEHICLE, order: Sequence[str] = ()) -> DataFrame:
    """``timestamp, latitude, longitude, altitude`` from loosely named columns.

    Positions come from ``latitude, longitude``, ``lat, lon`` or ``x, y, z``
    (earth-centred metres); rows without position are dropped. ``order`` names
    the columns ``chunk, position`` that number the rows of one file; it is
    needed only when the clock must be made up from the row number.
    """
    table = normalize_header(df)
    time_column = first_present(table, spec.time_columns, spec.numeric_fallback)
    kept = [c for c in ("path", "file_name") if c in table.columns]

    if "latitude" in table.columns and "longitude" in table.columns:
        lat, lon = F.col("latitude"), F.col("longitude")
        alt = F.col("altitude") if "altitude" in table.columns else None
    elif "lat" in table.columns and "lon" in table.columns:
        lat, lon = F.col("lat"), F.col("lon")
        alt_name = first_present(table, ("altitude", "alt"))
        alt = F.col(alt_name) if alt_name else None
    elif {"x", "y", "z"} <= set(table.columns):
        lat, lon, alt = ecef_to_geodetic(*[F.col(c).cast("double") for c in "xyz"])
    else:
        raise ValueError(f"no position columns among {table.columns}")

    def as_double(c: Column | None) -> Column:
        return F.lit(None).cast("double") if c is None else number(c.cast("string"))

    by_row = False
    if time_column is None:
        if spec.clock_step is None:
            raise ValueError(f"no time column among {table.columns}")
        by_row = True
        when = sequence_clock(F.col("_row"), step_seconds=spec.clock_step)
    elif isinstance(table.schema[time_column].dataType, T.NumericType):
        when = epoch_to_timestamp(F.col(time_column))
        if spec.sequence_below is not None:
            # The largest number of a file decides for that file alone.
            files = [c for c in kept if c == "path"]
            counter = F.coalesce(F.max(time_column) < spec.sequence_below, F.lit(False)).alias("_counter")
            tops = table.groupBy(*files).agg(counter)
            if len(order) >= 2 or tops.where("_counter").head(1):
                by_row = True
                table = table.join(tops, files) if files else attach(table, tops)
                made_up = sequence_clock(F.col("_row"), step_seconds=spec.clock_step)
                when = F.when(F.col("_counter"), made_up).otherwise(when)
    else:
        text = F.col(time_column).cast("string")
        when = F.coalesce(F.try_to_timestamp(text), epoch_to_timestamp(number(text)))
    if by_row:
        if len(order) < 2:
            raise ValueError("a made-up clock needs the order columns of the file")
        chunk, *rest = [c.lower() for c in order]
        by = [c for c in kept if c == "path"]
        table = running_sums(table, by, chunk, rest, {"_row": F.lit(1).cast("long")})
    return table.select(
        *kept,
        when.alias("timestamp"),
        as_double(lat).alias("latitude"),
        as_double(lon).alias("longitude"),
        as_double(alt).alias("altitude"),
    ).dropna(subset=["latitude", "longitude"])


def read_trajectory(
    spark: SparkSession, paths, spec: TrajectorySpec = VEHICLE, comment: str = "#", bundled: bool = False
) -> DataFrame:
    """``standard_trajectory`` of delimited files, each by its own header and its own clock.

    A file without a time column or without position columns is an error that names it.
    """
    rows = read_delimited(spark, paths, comment=comment, lower=True, bundled=bundled)
    files = stored(_file_clocks(rows, spec), "clocks")
    known = F.col("time_at").isNotNull() | F.lit(spec.clock_step is not None)
    for what, good in (("time column", known), ("position columns", F.col("placed"))):
        bad = files.where(~good).select("path", "header").limit(1).collect()
        if bad:
            raise ValueError(f"no {what} among {bad[0]['header']} of {bad[0]['path']}")
    rows = rows.join(files.select("path", "time_at", "by_row"), "path")
    timed = rows.where(~F.col("by_row")).withColumn("_row", F.lit(None).cast("long"))
    counted = running_sums(rows.where("by_row"), ["path"], "block", ["pos"], {"_row": F.lit(1).cast("long")})
    text = F.get("cells", (F.col("time_at") - 1).cast("int"))
    clock = F.coalesce(epoch_to_timestamp(number(text)), F.try_to_timestamp(text))
    if spec.clock_step is not None:
        clock = F.when(F.col("by_row"), sequence_clock(F.col("_row"), step_seconds=spec.clock_step)).otherwise(clock)
    geodetic, short = has("latitude", "longitude"), has("lat", "lon")
    lat, lon, alt = ecef_to_geodetic(*[F.col(f"_{c}") for c in "xyz"])
    return (
        timed.unionByName(counted)
        .withColumns({f"_{c}": number(cell(c)) for c in "xyz"})  # read once a row, not once a step
        .select(
            "path",
            "file_name",
            clock.alias("timestamp"),
            F.when(geodetic, number(cell("latitude"))).when(short, number(cell("lat"))).otherwise(lat).alias("latitude"),
            F.when(geodetic, number(cell("longitude"))).when(short, number(cell("lon"))).otherwise(lon).alias("longitude"),
            F.when(geodetic, number(cell("altitude"))).when(short, number(cell("altitude", "alt"))).otherwise(alt).alias("altitude"),
        )
        .dropna(subset=["latitude", "longitude"])
    )


def _file_clocks(rows: DataFrame, spec: TrajectorySpec) -> DataFrame:
    """``path, header, time_at, by_row, placed``: per file its time column, whether its clock
    must be made up from the row number, and whether it has positions.
    """
    placed = has("latitude", "longitude") | has("lat", "lon") | has("x", "y", "z")
    named = rows.groupBy("path").agg(F.any_value("header").alias("header")).withColumns(
        {"time_at": place_of(*spec.time_columns), "placed": placed}
    )
    if spec.numeric_fallback:
        # The first column of numbers only, in files that name no time.
        nameless = rows.join(named.where("time_at is null").select("path"), "path", "left_semi")
        cells = nameless.select("path", F.posexplode("cells").alias("i", "text")).where(F.trim("text") != "")
        numeric = cells.groupBy("path", "i").agg(F.min(number(F.col("text")).isNotNull()).alias("all"))
        first = numeric.where("all").groupBy("path").agg((F.min("i") + 1).cast("long").alias("_first"))
        named = named.join(first, "path", "left").withColumn("time_at", F.coalesce("time_at", "_first")).drop("_first")
    by_row = F.col("time_at").isNull()
    if spec.sequence_below is not None:
        # The largest number of a file decides for that file alone.
        times = rows.join(named.select("path", "time_at"), "path")
        top = F.max(number(F.get("cells", (F.col("time_at") - 1).cast("int"))))
        tops = times.groupBy("path").agg(F.coalesce(top < spec.sequence_below, F.lit(False)).alias("_counter"))
        named = named.join(tops, "path")
        by_row = by_row | F.col("_counter")
    return named.select("path", "header", "time_at", by_row.alias("by_row"), "placed")
