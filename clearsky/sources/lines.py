"""Text recordings as ordered line tables, and records that markers open."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clearsky.operators.ordered import running

LINE_ORDER = ["block", "pos"]
NO_NAME = "__HIVE_DEFAULT_PARTITION__"  # as Spark names the folder of a null


def read_lines(
    spark: SparkSession, paths: str | Sequence[str], pattern: str | None = None, separator: str | None = None,
    bundled: bool = False,
) -> DataFrame:
    """``path, file_name, block, pos, line`` of text files.

    Large files are read in splits. ``block`` is the byte offset of the split a
    line came from and ``pos`` grows along the lines of a split, so the pair
    orders a file. Only that order is meaningful, not the value of ``pos``.
    ``separator`` stands between lines in place of the line end. ``bundled`` files hold many
    recordings (see ``write_bundles``): ``path`` and ``file_name`` are then the recording's name.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if separator:
        reader = reader.option("lineSep", separator)
    text = reader.text(paths if isinstance(paths, str) else list(paths))
    rows = text.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        F.col("value").alias("line"),
    )
    if not bundled:
        return rows
    # The first line of a file still has the mark that the separator takes off the others.
    mark = (separator or "").lstrip("\r\n")
    line = F.regexp_replace("line", f"^{re.escape(mark)}", "") if mark else F.col("line")
    name = F.substring_index("line", "\t", 1)
    return rows.withColumn("line", line).select(
        name.alias("path"), name.alias("file_name"), *LINE_ORDER, F.substring("line", F.length(name) + 2, F.length("line")).alias("line")
    )


def write_bundles(lines: DataFrame, folder: str, tasks: int, opens: Column | None = None, mark: str = "") -> None:
    """``path, block, pos, line`` written as text in order, many recordings to a file.

    A file per recording costs the same for a short as for a long one (made, renamed, listed, opened), so
    the time follows the number of recordings; here the number of files is ``tasks``. Each line opens with
    the recording's name and a tab. Where ``opens`` is given, only those and the first do, and ``mark``
    stands before the name: for files that are read with a line feed and this mark as separator. A recording
    lies in one file. Lines of equal place stay as they came; those of unknown place stand first.
    """
    name = F.coalesce("path", F.lit(NO_NAME))
    text = F.coalesce("line", F.lit(""))
    bare = F.when(text.startswith(mark), F.substring(text, len(mark) + 1, F.length(text))).otherwise(text) if mark else text
    marked = F.concat(F.lit(mark), F.col("path"), F.lit("\t"), bare)
    opens = F.lit(True) if opens is None else F.coalesce(opens, F.lit(False))
    dealt = (
        lines.select(name.alias("path"), *LINE_ORDER, opens.alias("_opens"), "line")
        .withColumn("_came", F.monotonically_increasing_id())
        .repartition(tasks, "path")
    )
    order = [*LINE_ORDER, "_came"]
    first = F.row_number().over(Window.partitionBy("path").orderBy(*order)) == 1
    (
        dealt.withColumn("_opens", F.col("_opens") | first)
        .sortWithinPartitions("path", *order)
        .select(F.when(F.col("_opens"), marked).otherwise(text).alias("line"))
        .write.text(folder)
    )


def number_records(lines: DataFrame, markers: dict[str, Column], carry: Sequence[str] = ()) -> DataFrame:
    """Running count of marker lines per file: the number of the open record.

    Lines before the first marker get 0. ``carry`` names columns whose last
    known value holds on. Works split by split, so one very large recording is
    not pulled into one task.
    """
    counts = {name: F.when(hit, F.lit(1)).otherwise(F.lit(0)).cast("long") for name, hit in markers.items()}
    return running(lines, ["path"], "block", ["pos"], counts, carry)
