"""Writers: feature tables, splits, windows, scaler parameters and metric reports."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clearsky.schemas import FEATURES

SPLITS = ("train", "val", "test")
FEATURE_TABLE = ["timestamp", "source", "scenario", *FEATURES, "label", "label_name", "split"]


def write_table(df: DataFrame, path: str, columns: Sequence[str] = tuple(FEATURE_TABLE), fmt: str = "parquet") -> None:
    """Table with its columns in a fixed order; columns it lacks are left out."""
    kept = [c for c in columns if c in df.columns]
    writer = df.select(*kept).write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_by_key(df: DataFrame, path: str, key: str, fmt: str = "parquet", rows_per_file: int = 5_000_000) -> None:
    """One folder per value of ``key``.

    The rebalance hint lets adaptive execution gather the rows of small keys and
    split those of a large key over several tasks.
    """
    writer = (
        df.hint("rebalance", key)
        .write.mode("overwrite")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy(key)
    )
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_scenarios(df: DataFrame, path: str, fmt: str = "csv") -> None:
    write_by_key(df, path, "scenario", fmt)


def write_splits(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    write_by_key(df, path, "split", fmt)


def save_windows(windows: DataFrame, path: str) -> None:
    write_by_key(windows, path, "split", rows_per_file=100_000)


def load_windows(spark: SparkSession, path: str, splits: Sequence[str] = SPLITS) -> DataFrame:
    """Stored windows; an error names the splits that are missing."""
    out = spark.read.parquet(path)
    found = {r["split"] for r in out.select("split").distinct().collect()}
    missing = [s for s in splits if s not in found]
    if missing:
        raise FileNotFoundError(f"no windows for {', '.join(missing)} in {path}")
    return out


def save_scaler(table: DataFrame, path: str) -> None:
    """Parameter rows (``position, column`` and two numbers), one line per feature."""
    table.coalesce(1).write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """The fitted parameters as the single row the scaling functions take, and the column order."""
    table = spark.read.parquet(path)
    parts = [c for c in table.columns if c not in ("position", "column")]
    names = [r["column"] for r in table.orderBy("position").select("column").collect()]
    params = table.agg(
        *[F.max(F.when(F.col("column") == c, F.col(p))).alias(f"{p}_{c}") for c in names for p in parts]
    )
    return params, names


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metric table as JSON lines; it has a row per group, so one file will do."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


# ---- stores with a manifest -----------------------------------------------------------------------


def _described(parameters: Mapping[str, object] | None) -> str:
    return json.dumps(dict(parameters or {}), sort_keys=True, default=str)


def _read_or_none(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as err:
        if err.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def reuse_or_build(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    force: bool = False,
    parameters: Mapping[str, object] | None = None,
) -> DataFrame:
    """The stored result if it was made with the same ``parameters``, else build, store and read it back.

    What was stored is told by a manifest beside it, written once all rows are there: an
    interrupted store is built again, and a split without rows is not taken for a missing one.
    """
    manifest = f"{path.rstrip('/')}_manifest"
    wanted = _described(parameters)
    known = None if force else _read_or_none(spark, manifest, "parameters string, schema string, splits array<string>")
    row = known.first() if known is not None else None
    if row is None or row["parameters"] != wanted:
        made = build()
        spark.createDataFrame([], "parameters string, schema string, splits array<string>").write.mode("overwrite").parquet(manifest)
        save_windows(made, path)
        splits = spark.read.schema(made.schema).parquet(path).agg(F.sort_array(F.collect_set("split"))).first()[0]
        row = {"parameters": wanted, "schema": made.schema.json(), "splits": splits}
        stored = spark.createDataFrame([tuple(row.values())], "parameters string, schema string, splits array<string>")
        stored.coalesce(1).write.mode("overwrite").parquet(manifest)
    return spark.read.schema(T.StructType.fromJson(json.loads(row["schema"]))).parquet(path)


def ingest(
    spark: SparkSession,
    root: str,
    path: str,
    read: Callable[[list[str]], DataFrame],
    pattern: str = "*",
    files_per_batch: int = 1000,
    parameters: Mapping[str, object] | None = None,
) -> DataFrame:
    """Let a store grow by the recordings that are new below ``root``; give all of its rows.

    A stream over the names of the files finds what is new and remembers it; ``read`` turns
    the files of a batch (at most ``files_per_batch`` names) into rows with any of the readers.
    A batch writes to its own folder, which a repeated batch replaces, and lists its files last, so
    every file is in the store exactly once, whatever fails. ``batch`` tells which one brought a row.
    A store made with other ``parameters`` is an error.
    """
    wanted = _described(parameters)
    base = path.rstrip("/")
    before = _read_or_none(spark, f"{base}/files")
    if before is not None and before.where(F.col("parameters") != wanted).head(1):
        raise ValueError(f"the store in {base} was made with other parameters")

    def take(batch: DataFrame, number: int) -> None:
        names = [r["path"] for r in batch.select("path").collect()]
        if names:
            read(names).write.mode("overwrite").parquet(f"{base}/rows/batch={number}")
            listed = spark.createDataFrame([(n, wanted) for n in names], "path string, parameters string")
            listed.coalesce(1).write.mode("overwrite").parquet(f"{base}/files/batch={number}")

    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(root)
        .select("path")
    )
    running = (
        files.writeStream.foreachBatch(take).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    listed = _read_or_none(spark, f"{base}/files")
    if listed is None:
        raise FileNotFoundError(f"no {pattern} below {root}")
    whole = listed.select("batch").distinct()
    return spark.read.parquet(f"{base}/rows").join(whole, "batch", "left_semi")


# ---- reports that come from a write ---------------------------------------------------------------


def write_with_class_report(
    df: DataFrame, path: str, label: str = "label", classes: Sequence[int] = (0, 1, 2), rare_below: float = 5.0, **options
) -> DataFrame:
    """Store a labelled table and give its class report, with no second look at the rows.

    ``label, n, pct, rare``: the numbers are observed while the rows are written.
    """
    seen = Observation("classes")
    counts = [F.count(F.when(F.col(label) == c, 1)).alias(f"n_{c}") for c in classes]
    write_table(df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts), path, **options)
    got = seen.get
    rows = [(c, got[f"n_{c}"], 100.0 * got[f"n_{c}"] / got["rows"]) for c in classes if got[f"n_{c}"]]
    report = df.sparkSession.createDataFrame(rows, f"{label} int, n bigint, pct double")
    return report.withColumn("rare", F.col("pct") < rare_below)


def write_with_match_report(df: DataFrame, path: str, error: str, **options) -> DataFrame:
    """Store a joined table and tell how many rows found a partner, and its mean: one row, from the write."""
    seen = Observation("matches")
    watched = df.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count(error).alias("matched"), F.sum(F.col(error).cast("double")).alias("total")
    )
    write_table(watched, path, **options)
    got = seen.get
    mean = got["total"] / got["matched"] if got["matched"] else None
    return df.sparkSession.createDataFrame([(got["rows"], got["matched"], mean)], "n bigint, matched bigint, mean_error double")
