"""Session set-up shared by jobs, tests and the benchmark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "clearsky", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks.

    On a cluster the session comes from the submitter. Jobs depend on the UTC
    session time zone only; dirty text is read with ``try_*`` functions, so
    ANSI mode may stay on.
    """
    cores = 8 if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        # Capturing the Python call site of every column costs more than small queries do.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one the cluster names in ``spark.checkpoint.dir``.

    Where none is named it lies below ``spark.sql.warehouse.dir``, which a
    cluster shares as well.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read again: lineage ends there."""
    folder = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def checkpoint_folder(spark: SparkSession) -> None:
    """Sets the context's checkpoint folder, in the shared folder, where it has none."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "checkpoints"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def tasks_for(df: DataFrame, rows_a_task: int) -> int:
    """As many tasks as give each of them at most about ``rows_a_task`` of these rows.

    For exchanges whose share per task must not grow with the table, whatever
    ``spark.sql.shuffle.partitions`` says. The rows of a stored table are counted from its footers.
    """
    return max(1, -(-df.count() // rows_a_task))
