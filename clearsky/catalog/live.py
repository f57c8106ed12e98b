"""The streaming operators, fed from the events table until it is used up.

Results and checkpoints go to a new folder below ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearsky.catalog.base import DAY, EPOCHS_SQL, FRAME_DAYS, as_epochs, query, rnd, shared_folder, sql_rnd, table
from clearsky.catalog.features import _WINDOW_SQL
from clearsky.functions.labels import quality_label
from clearsky.schemas import FEATURES
from clearsky.streaming import live

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return as_epochs(rows)


def flushed_event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same, with a row of its own session long after the last: the watermark passes all others."""
    schema = table(spark, sf, "events").schema
    given = {"ts": F.lit("2200-01-01").cast(schema["ts"].dataType), "user_id": F.lit(-1).cast(schema["user_id"].dataType)}
    folder = shared_folder(spark, "marker")
    spark.range(1).select(*[given.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in schema]).write.parquet(folder)
    marker = as_epochs(spark.readStream.schema(schema).parquet(folder))
    return event_stream(spark, sf).unionByName(marker)


def run_to_end(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Process all that is there and return what was emitted."""
    folder = shared_folder(spark, "live")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    try:
        running = (
            stream.writeStream.format("parquet")
            .option("checkpointLocation", f"{folder}/state")
            .option("path", f"{folder}/rows")
            .trigger(availableNow=True)
            .start()
        )
        running.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


@query("live_deduplicated_epochs", "SELECT 'u' || user_id AS source, count(*) AS n FROM events GROUP BY user_id")
def live_deduplicated_epochs(spark, sf):
    """Every epoch arrives twice and is kept once."""
    twice = event_stream(spark, sf).select("source", "timestamp", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    kept = run_to_end(spark, live.without_duplicates(twice, ["source"], "timestamp", "1 hour"))
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def _buckets(spark, sf, width: str, slide: str | None) -> DataFrame:
    stream = live.bucket_features(flushed_event_stream(spark, sf), ["source"], "timestamp", width, slide, "1 hour")
    out = run_to_end(spark, stream)
    return out.select(
        "source", F.unix_micros("start").alias("start_us"), "epochs", rnd("mean_cnr").alias("mean_cnr"), "sat_min"
    )


_BUCKET_SQL = f"""WITH {EPOCHS_SQL}
SELECT source, epoch_us(start) AS start_us, count(*) AS epochs, {sql_rnd("avg(mean_cnr_epoch)")} AS mean_cnr,
  min(num_satellites) AS sat_min FROM (SELECT *, date_trunc('day', timestamp) - INTERVAL 1 DAY * n AS start FROM epochs, range(0, $days) r(n))
GROUP BY source, start"""


@query("live_bucket_features", _BUCKET_SQL.replace("$days", "1"))
def live_bucket_features(spark, sf):
    """Day buckets."""
    return _buckets(spark, sf, "1 day", None)


@query("live_sliding_buckets", _BUCKET_SQL.replace("$days", "3"))
def live_sliding_buckets(spark, sf):
    """Buckets of three days that begin every day."""
    return _buckets(spark, sf, "3 days", "1 day")


@query(
    "live_recording_sessions",
    f"""WITH {EPOCHS_SQL},
g AS (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY source ORDER BY timestamp) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS opens FROM epochs),
r AS (SELECT *, sum(opens) OVER (PARTITION BY source ORDER BY timestamp) AS rec FROM g)
SELECT source, epoch_us(min(timestamp)) AS start_us, count(*) AS epochs FROM r GROUP BY source, rec""",
)
def live_recording_sessions(spark, sf):
    """Recordings told apart by pauses of twelve hours."""
    stream = live.recording_sessions(flushed_event_stream(spark, sf), ["source"], "timestamp", "12 hours", "1 hour")
    return run_to_end(spark, stream).select("source", F.unix_micros("start").alias("start_us"), "epochs")


@query(
    "live_trailing_features",
    _WINDOW_SQL
    + " SELECT e.source, epoch_us(e.timestamp) AS us, "
    + ", ".join(f"{sql_rnd(f'f.{c}', 9 if c == 'sat_drop_rate' else 6)} AS {c}" for c in FEATURES)
    + " FROM feats f JOIN epochs e USING (event_id)",
)
def live_trailing_features(spark, sf):
    """The stateful operator gives what the batch windows give."""
    stream = live.trailing_features(event_stream(spark, sf), ["source"], "timestamp", FRAME_DAYS * DAY, "1 hour")
    out = run_to_end(spark, stream)
    return out.select(
        "source", F.unix_micros("timestamp").alias("us"),
        *[rnd(c, 9 if c == "sat_drop_rate" else 6).alias(c) for c in FEATURES],
    )


_CHANGES_SQL = """p AS (SELECT *, lag(label) OVER (PARTITION BY source ORDER BY timestamp) AS label_before FROM l)
SELECT source, epoch_us(timestamp) AS us, label_before, label, (['CLEAN', 'WARNING', 'DEGRADED'])[label + 1] AS alert
FROM p WHERE label_before IS NOT NULL AND label_before <> label"""


def _label_sql(cnr: str, status: str) -> str:
    return f"""CASE
  WHEN coalesce({cnr} < 25, false) OR coalesce(hdop > 5, false) OR coalesce(pdop > 8, false)
    OR coalesce(num_satellites < 4, false) OR {status} = 0 THEN 2
  WHEN coalesce({cnr} >= 35, true) AND coalesce(hdop <= 2.5, true) AND coalesce(pdop <= 4, true)
    AND coalesce(num_satellites >= 8, true) AND {status} > 0 THEN 0 ELSE 1 END AS label"""


def _changes(spark: SparkSession, labelled: DataFrame) -> DataFrame:
    changes = live.class_changes(labelled, ["source"], "timestamp", "10000 days")
    return run_to_end(spark, changes).select("source", F.unix_micros("timestamp").alias("us"), "label_before", "label", "alert")


@query(
    "live_class_changes",
    _WINDOW_SQL
    + f""", l AS (SELECT e.source, e.timestamp, f.label FROM epochs e
  JOIN (SELECT event_id, {_label_sql("mean_cnr", "solution_status")} FROM feats) f USING (event_id)),
"""
    + _CHANGES_SQL,
)
def live_class_changes(spark, sf):
    """An alert where the class of a session's trailing features changes: two stateful operators in a chain."""
    stream = flushed_event_stream(spark, sf)
    features = live.trailing_features(stream, ["source"], "timestamp", FRAME_DAYS * DAY, "1 hour")
    return _changes(spark, live.live_labels(features))


@query(
    "live_class_changes_of_epochs",
    f"WITH {EPOCHS_SQL}, l AS (SELECT source, timestamp, {_label_sql('mean_cnr_epoch', 'fix_quality')} FROM epochs),\n" + _CHANGES_SQL,
)
def live_class_changes_of_epochs(spark, sf):
    """The same for the class of each epoch by itself."""
    label = quality_label("mean_cnr_epoch", "hdop", "pdop", "num_satellites", "fix_quality")
    return _changes(spark, flushed_event_stream(spark, sf).withColumn("label", label).withWatermark("timestamp", "1 hour"))
