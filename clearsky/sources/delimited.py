"""Delimited files whose columns differ from file to file.

Each file is read by its own header: a first pass keeps the first line of every file, one
row per file, and the rows of all files take their cells by the place their own header
gives a name. One plan serves files of any mix of headers; no types are inferred, and no
file's header holds for another file.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clearsky.functions.scalars import number
from clearsky.session import stored
from clearsky.sources.lines import LINE_ORDER, read_lines


def _cells(line: str, width: int, separator: str) -> Column:
    """The fields of a line as an array, read with the rules of CSV (quotes, escapes)."""
    schema = ", ".join(f"c{i} string" for i in range(width))
    record = F.from_csv(F.col(line), schema, {"sep": separator})
    return F.array(*[record[f"c{i}"] for i in range(width)])


def file_headers(lines: DataFrame, separator: str = ",") -> DataFrame:
    """``path, header, _at``: names in the first line of each file, without blanks around; and its place.

    One row per file, written once. What reaches the driver is the largest number of columns.
    """
    place = F.struct(*LINE_ORDER)
    first = stored(lines.groupBy("path").agg(F.min_by("line", place).alias("line"), F.min(place).alias("_at")), "headers")
    width = first.agg(F.max(F.size(F.split("line", "[" + "".join(f"\\x{ord(c):02x}" for c in separator) + "]")))).first()[0] or 1
    fields = F.filter(_cells("line", width, separator), lambda c: c.isNotNull())
    names = F.transform(fields, lambda c: F.trim(F.translate(c, "﻿", "")))
    return first.select("path", names.alias("header"), "_at", F.lit(width).alias("_width"))


def read_delimited(
    spark: SparkSession,
    paths: str | Sequence[str],
    pattern: str | None = None,
    comment: str | None = None,
    separator: str = ",",
    lower: bool = False,
    bundled: bool = False,
) -> DataFrame:
    """``path, file_name, block, pos, header, cells``: the rows of delimited files with their own header.

    Empty lines and those that start with ``comment`` are passed over. ``lower`` takes the
    header in lower case; for ``bundled`` see ``read_lines``. Values that run over several lines are not supported, so that large
    files stay splittable.
    """
    lines = read_lines(spark, paths, pattern, bundled=bundled).where(F.trim("line") != "")
    if comment:
        lines = lines.where(~F.col("line").startswith(comment))
    headers = file_headers(lines, separator)
    width = (headers.select("_width").first() or [1])[0]
    names = F.transform("header", lambda c: F.lower(c)) if lower else F.col("header")
    return (
        lines.join(headers, "path")
        .where(F.struct(*LINE_ORDER) != F.col("_at"))
        .select("path", "file_name", *LINE_ORDER, names.alias("header"), _cells("line", width, separator).alias("cells"))
    )


def has(*names: str) -> Column:
    """Whether the row's file has all these columns."""
    out = F.lit(True)
    for name in names:
        out = out & F.array_contains("header", name)
    return out


def place_of(*names: str) -> Column:
    """Place (from 1) of the first of these names that the row's header holds, else null."""
    return F.coalesce(*[F.nullif(F.array_position("header", name), F.lit(0).cast("long")) for name in names])


def cell(*names: str) -> Column:
    """The row's text under the first of these names that its header holds."""
    return F.get("cells", (place_of(*names) - 1).cast("int"))


def typed(name: str, kind: str) -> Column:
    """A column as ``kind``; what cannot be read is null."""
    text = cell(name)
    if kind == "string":
        return text
    if kind in ("double", "float", "int", "long", "bigint"):
        return number(text, kind)
    if kind == "timestamp":
        return F.try_to_timestamp(text)
    return text.try_cast(kind)


def columns_of(rows: DataFrame) -> list[str]:
    """All names that occur in the headers, in the order of their first places."""
    named = rows.select("path", "header").groupBy("path").agg(F.any_value("header").alias("header"))
    placed = named.select(F.posexplode("header").alias("at", "name")).groupBy("name").agg(F.min("at").alias("at"))
    return [r["name"] for r in placed.orderBy("at", "name").collect()]


def as_table(rows: DataFrame, types: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """One table of declared columns over all files; a column that a file lacks is null there."""
    return rows.select(*keep, *[typed(name, kind).alias(name) for name, kind in types.items()])
