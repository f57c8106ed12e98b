"""Phone logger files: ``Fix`` and ``Status`` records among other lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clearsky.functions.scalars import field, number
from clearsky.sources.lines import LINE_ORDER, read_lines


def _records(lines: DataFrame, kind: str) -> DataFrame:
    line = F.trim("line")
    return lines.where(line.startswith(kind + ",")).withColumn("p", F.split(line, ","))


def _optional(index: int, default: Column) -> tuple[Column, Column]:
    """Value of an optional number, and whether the field is malformed."""
    text = field(F.col("p"), index)
    value = number(text)
    return F.when(text.isNull(), default).otherwise(value), text.isNotNull() & value.isNull()


def fix_records(lines: DataFrame) -> DataFrame:
    """Position records with at least 15 fields, an accuracy and a time.

    Missing optional fields are 0; a missing vertical accuracy is the accuracy.
    Records with a field that is no number are skipped.
    """
    p = F.col("p")
    zero = F.lit(0.0)
    accuracy = number(field(p, 6))
    optional = {
        "altitude": _optional(4, zero),
        "speed_mps": _optional(5, zero),
        "bearing": _optional(7, zero),
        "speed_accuracy": _optional(9, zero),
        "bearing_accuracy": _optional(10, zero),
        "num_used_signals": _optional(14, zero),
        "vertical_accuracy": _optional(12, accuracy),
    }
    bad = F.lit(False)
    for _, malformed in optional.values():
        bad = bad | malformed
    rows = _records(lines, "Fix").where((F.size("p") >= 15) & ~bad).select(
        "path",
        "file_name",
        *LINE_ORDER,
        F.get(p, F.lit(1)).alias("provider"),
        number(field(p, 2)).alias("latitude"),
        number(field(p, 3)).alias("longitude"),
        accuracy.alias("accuracy_meters"),
        number(field(p, 8), "bigint").alias("unix_time_ms"),
        *[v.alias(n) for n, (v, _) in optional.items()],
    )
    return rows.withColumn("num_used_signals", F.col("num_used_signals").cast("int")).dropna(
        subset=["latitude", "longitude", "accuracy_meters", "unix_time_ms"]
    )


def status_records(lines: DataFrame) -> DataFrame:
    """Satellite records; a record with a missing or malformed number is skipped."""
    p = F.col("p")
    return (
        _records(lines, "Status")
        .select(
            "path",
            "file_name",
            *LINE_ORDER,
            number(field(p, 1), "bigint").alias("unix_time_ms"),
            number(field(p, 2), "int").alias("signal_count"),
            F.get(p, F.lit(4)).alias("constellation"),
            number(field(p, 5), "int").alias("svid"),
            number(field(p, 7)).alias("cn0_dbhz"),
            number(field(p, 8)).alias("azimuth"),
            number(field(p, 9)).alias("elevation"),
            F.coalesce(F.lower(F.get(p, F.lit(10))) == "true", F.lit(False)).alias("used_in_fix"),
        )
        .dropna(subset=["unix_time_ms", "signal_count", "svid", "cn0_dbhz", "azimuth", "elevation"])
    )


def read_phone_log(spark: SparkSession, paths, pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(fixes, status)`` of phone logs."""
    lines = read_lines(spark, paths, pattern)
    return fix_records(lines), status_records(lines)
