"""Solver solution files (``.pos``): ``%`` comments, blank-separated columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clearsky.functions.scalars import number, sequence_clock
from clearsky.sources.lines import LINE_ORDER, number_records, read_lines

COLUMNS = ["latitude", "longitude", "altitude", "q", "ns", "sdn", "sde", "sdu", "sdne", "sdeu", "sdun", "age", "ratio"]
DEVIATIONS = ["sd", "sn", "se", "su"]


def solution_time(date: Column, time: Column) -> Column:
    return F.try_to_timestamp(F.concat_ws(" ", date, time), F.lit("yyyy/MM/dd HH:mm:ss.SSSSSS"))


def solution_rows(lines: DataFrame) -> DataFrame:
    """Split data lines; a ``%`` starts a comment."""
    text = F.trim(F.regexp_replace("line", "%.*$", ""))
    return lines.withColumn("t", F.split(text, r"\s+")).where(text != "")


def _numbers(names: Sequence[str], start: int) -> list[Column]:
    return [number(F.get("t", F.lit(start + i))).alias(n) for i, n in enumerate(names)]


def solution_fixes(lines: DataFrame, layout: str = "full") -> DataFrame:
    """Fixes of solution files.

    ``full``      15 columns; rows without time or position are dropped.
    ``drone``     time, position, ``q``, ``ns``; rows with fewer than 19 columns
                  carry no time: position first, and a clock of one row a second.
    ``vehicle``   20 columns: time, position, ``q``, ``ns`` and four deviations,
                  nothing dropped.
    ``position``  time and position of rows with at least 5 columns.
    """
    rows = solution_rows(lines)
    time = solution_time(F.get("t", F.lit(0)), F.get("t", F.lit(1))).alias("timestamp")
    if layout == "full":
        out = rows.select("path", "file_name", *LINE_ORDER, time, *_numbers(COLUMNS, 2))
        return out.dropna(subset=["timestamp", "latitude", "longitude"])
    if layout == "drone":
        names = ["latitude", "longitude", "altitude", "q", "ns"]
        wide = F.size("t") >= 19
        numbered = number_records(rows, {"_row": F.lit(True)})
        timed = numbered.select(
            "path", "file_name", *LINE_ORDER,
            F.when(wide, time).otherwise(sequence_clock(F.col("_row"), step_seconds=1.0)).alias("timestamp"),
            *[
                F.when(wide, number(F.get("t", F.lit(2 + i)))).otherwise(
                    number(F.get("t", F.lit(i))) if i < 3 else F.lit(None).cast("double")
                ).alias(n)
                for i, n in enumerate(names)
            ],
        )
        return timed.dropna(subset=["latitude", "longitude"])
    if layout == "vehicle":
        names = ["latitude", "longitude", "altitude", "q", "ns", *DEVIATIONS]
        return rows.select("path", "file_name", *LINE_ORDER, time, *_numbers(names, 2))
    if layout == "position":
        out = rows.where(F.size("t") >= 5).select(
            "path", "file_name", *LINE_ORDER, time, *_numbers(COLUMNS[:3], 2)
        )
        return out.dropna(subset=["timestamp", "latitude", "longitude", "altitude"])
    raise ValueError(f"unknown layout {layout!r}")


def read_solution(spark: SparkSession, paths, layout: str = "full") -> DataFrame:
    return solution_fixes(read_lines(spark, paths), layout)
