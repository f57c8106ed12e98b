"""Exact deduplication by skew-safe combining (DataFrame functions only).

Texts are equal when they agree after each run of blanks (space, tab, line
feed, vertical tab, form feed, carriage return) became one space; a null text
counts as empty. Three stages compare the full normalised text, never only its
digest, since the text itself is a grouping key in each:

1. within a task (the partial aggregate in front of the exchange),
2. within ``(digest, salt)``: a group of any size is met by ``salts`` tasks,
3. over the winners of the salts, at most ``salts`` rows for a text.

Two different texts of one SHA-256 digest stop the job with an error.

Cases: a null ``doc_id`` loses against any other; rows that repeat both the
``doc_id`` and the text count each in ``group_size`` and exactly one of them
stays; empty texts form one group; an empty table gives no rows; further
columns are kept by :func:`deduplicate` and ignored by :func:`verdicts`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = normalised(F.col(text_col))
    return docs.select(F.col(id_col).alias("id"), norm.alias("norm")).withColumn("digest", F.sha2("norm", 256))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per distinct text: digest, keep_id (smallest id) and group_size."""
    salted = (
        _keyed(docs, id_col, text_col)
        .withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
        .groupBy("digest", "salt", "norm")
        .agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    return (
        salted.groupBy("digest", "norm")
        .agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        .groupBy("digest")
        .agg(
            F.min("keep_id").alias("keep_id"),
            F.sum("group_size").alias("group_size"),
            F.count("*").alias("texts"),
        )
        .select(
            "digest",
            "keep_id",
            "group_size",
            F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("boolean"))
            .otherwise(F.lit(True))
            .alias("checked"),
        )
        .where("checked")
        .drop("checked")
    )


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The join back reads narrow rows, equal (id, digest) rows already counted;
    a group meets its rows in ``salts`` tasks.
    """
    rows = (
        _keyed(docs, id_col, text_col)
        .groupBy("id", "digest")
        .agg(F.count("*").alias("copies"))
        .withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    )
    shared = groups(docs, id_col, text_col, salts).where("group_size > 1")
    spread = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (
        rows.join(spread, ["digest", "salt"], "left")
        .withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select(
            F.col("id").alias("doc_id"),
            F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
            (
                (F.col("nth") == 1) & (F.col("group_size").isNull() | F.col("id").eqNullSafe(F.col("keep_id")))
            ).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows that stay, with all their columns.

    A text's least row travels with it through the three stages, so nothing is joined back: two
    exchanges of texts, each behind a combination of what a task has. A row carries its own text
    only where it differs from the normalised one. Of rows that repeat both id and text any one stays.
    """
    (text,) = [f.name for f in docs.schema if f.name.lower() == text_col.lower()]
    others = [f.name for f in docs.schema if f.name != text]
    # Inside, all columns but the text are one struct: their names cannot clash with those used here.
    rows = docs.select(
        F.struct(*[docs[f"`{c}`"].alias(f"c{k}") for k, c in enumerate(others)]).alias("rest"),
        docs[f"`{id_col}`"].alias("id"),
        docs[f"`{text}`"].alias("text"),
    ).withColumn("norm", normalised(F.col("text")))
    own = F.when(F.col("text").isNull() | (F.col("text") != F.col("norm")), F.struct("text"))
    keyed = rows.select(
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"),
        "norm",
        F.struct(F.col("id").isNull().alias("last"), "id", F.monotonically_increasing_id().alias("place")).alias("rank"),
        F.struct("rest", own.alias("own")).alias("row"),
    )

    def least(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*by).agg(F.min_by("row", "rank").alias("row"), F.min("rank").alias("rank"))

    kept = least(least(keyed, "digest", "salt", "norm"), "digest", "norm")
    whole = F.when(F.col("row.own").isNotNull(), F.col("row.own.text")).otherwise(F.col("norm"))
    return kept.select(
        *[whole.alias(c) if c == text else F.col(f"row.rest.c{others.index(c)}").alias(c) for c in docs.columns]
    )
