"""Which files to read, what their names say, and tables spread over files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clearsky.schemas import FEATURES
from clearsky.sources.delimited import as_table, columns_of, read_delimited


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, directory, name, length`` of all files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(
        "path",
        F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("directory"),
        F.regexp_extract("path", r"([^/]*)$", 1).alias("name"),
        "length",
    )


def choose_by_priority(
    files: DataFrame, by: Sequence[str], name: str, patterns: Sequence[str], last: bool = False
) -> DataFrame:
    """One file per group: the first pattern that occurs, then the first name.

    ``patterns`` are SQL ``LIKE`` patterns in order of preference (case is
    ignored); groups without any match give no row. ``last`` takes the last name
    among equals, as for recordings with a running number.
    """
    rank = F.lit(None).cast("int")
    for i, pattern in reversed(list(enumerate(patterns))):
        rank = F.when(F.col(name).ilike(pattern), F.lit(i)).otherwise(rank)
    ranked = files.withColumn("priority", rank).where(F.col("priority").isNotNull())
    others = [c for c in files.columns if c not in by]
    if last:
        pick = F.max_by(F.struct(*others, "priority"), F.struct(-F.col("priority"), name))
    else:
        pick = F.min_by(F.struct(*others, "priority"), F.struct("priority", name))
    return ranked.groupBy(*by).agg(pick.alias("f")).select(*by, "f.*")


def log_label(stem: Column) -> tuple[Column, Column]:
    """(label, time token) of a phone log name such as ``Roof_gnss_log_2026_05_01_10_00_00``."""
    marker = "gnss_log_"
    has = stem.contains(marker)
    prefix = F.substring_index(stem, marker, 1)
    suffix = F.substring(stem, F.length(prefix) + len(marker) + 1, F.length(stem))
    label = F.translate(F.trim(prefix, F.lit("_ -")), "_-", "  ")
    tokens = F.split(suffix, "_")
    time = F.when(
        F.size(tokens) >= 3, F.array_join(F.slice(tokens, -3, 3), "_")
    ).otherwise(F.translate(suffix, "_", " "))
    return F.when(has, label).otherwise(F.lit("")), F.when(has, time).otherwise(stem)


def dotted_tail(stem: Column, skip: int) -> Column:
    """Parts of a dotted name after the first ``skip``, joined by ``_``: the receiver.

    A name with no more than ``skip`` parts is returned whole.
    """
    parts = F.split(stem, r"\.")
    tail = F.array_join(F.slice(parts, F.lit(skip + 1), F.size(parts)), "_")
    return F.when(F.size(parts) > skip, tail).otherwise(stem)


def traversal_date(directory: Column) -> Column:
    """The first ten characters of the last folder: its date."""
    return F.substring(F.substring_index(directory, "/", -1), 1, 10)


#: Kinds of the columns that feature files hold; any other column is text.
KINDS = {
    "timestamp": "timestamp", "label": "int", **dict.fromkeys(("source", "scenario", "label_name", "split"), "string"),
    **dict.fromkeys(FEATURES, "double"),
}


def read_tables(
    spark: SparkSession, root: str, pattern: str = "*_features.csv", types: Mapping[str, str] | None = None,
    bundled: bool = False,
) -> DataFrame:
    """All feature files below a folder as one table; columns may differ by file.

    ``types`` declares the columns. Without it the table has every column that some file's
    header names, of the kind that feature tables give it.
    """
    rows = read_delimited(spark, root, pattern, bundled=bundled)
    if types is None:
        names = columns_of(rows)
        if not names:
            raise FileNotFoundError(f"no {pattern} with rows below {root}")
        types = {name: KINDS.get(name, "string") for name in names}
    return as_table(rows, types)
