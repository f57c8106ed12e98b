"""Registry, rounding and the views of the driver's tables as recordings.

``events`` plays the recordings: one user is one session, an event one epoch,
and the receiver's fields are arithmetic on ``value`` and the number in
``props``. ``lineitem`` plays satellites: a supplier is a recording, a ship
date an epoch, an order line one satellite's observation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clearsky.session import shared_folder  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Both engines round to ``places`` decimals. The tiny shift keeps values that end exactly on a
# half (means of two-decimal numbers often do) away from the rounding edge.
def rnd(c: Column | str, places: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(10.0 ** -(places + 2)), places) + F.lit(0.0)


def sql_rnd(expr: str, places: int = 6) -> str:
    return f"(round(({expr}) + 1e-{places + 2}, {places}) + 0.0)"


def rounded(df: DataFrame, columns: list[str], places: int = 6) -> DataFrame:
    return df.withColumns({c: rnd(c, places) for c in columns})


DAY = 86400
HOUR = 3600
FRAME_DAYS = 5  # events are hours apart, so a frame of days plays the 30 seconds
CHUNK = 10 * DAY


def events_as_epochs(spark: SparkSession, sf: str) -> DataFrame:
    return as_epochs(table(spark, sf, "events"))


def as_epochs(events: DataFrame) -> DataFrame:
    """Epoch columns of a table or stream of events."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    v, u = F.col("value"), F.col("user_id")
    base = events.withColumn("k", k)
    k = F.col("k")
    return base.select(
        "event_id",
        F.concat(F.lit("u"), u).alias("source"),
        F.col("event_type").alias("scenario"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        (30 + v / 1000.0).alias("lat"),
        (120 + k / 1000.0).alias("lon"),
        F.when(k % 4 != 0, v * 3 - 100).alias("alt"),
        (k % 7).alias("fix_quality"),
        F.when(k % 10 != 9, (k % 25).cast("double")).alias("num_satellites"),
        (v / 20.0).alias("hdop"),
        F.when(k % 8 != 3, v / 15.0).alias("pdop"),
        ((k % 5) / 2.0).alias("vdop"),
        F.when(k % 6 != 5, (k % 13) / 2.0).alias("solution_age"),
        F.when((k % 3 != 0) & (u % 5 != 0), v / 40.0).alias("lat_sigma"),
        F.when((k % 3 != 0) & (u % 5 != 0), v / 50.0).alias("lon_sigma"),
        F.when((k % 4 == 1) & (u % 3 == 0), v / 30.0).alias("rms_error"),
        F.when((u % 3 == 1) & (k % 2 == 0), v / 60.0).alias("gbs_lat_err"),
        F.when((u % 3 == 1) & (k % 4 != 0), v / 70.0).alias("gbs_lon_err"),
        F.when((k % 5 != 0) & (u % 7 != 0), F.least(v, F.lit(60.0))).alias("mean_cnr_epoch"),
        (k % 3).cast("double").alias("cycle_slips_epoch"),
    )


EPOCHS_SQL = """
ev AS (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS INT) AS k FROM events),
epochs AS (
  SELECT event_id, 'u' || user_id AS source, event_type AS scenario, ts AS timestamp,
    30 + value / 1000.0 AS lat, 120 + k / 1000.0 AS lon,
    CASE WHEN k % 4 <> 0 THEN value * 3 - 100 END AS alt,
    k % 7 AS fix_quality,
    CASE WHEN k % 10 <> 9 THEN CAST(k % 25 AS DOUBLE) END AS num_satellites,
    value / 20.0 AS hdop,
    CASE WHEN k % 8 <> 3 THEN value / 15.0 END AS pdop,
    (k % 5) / 2.0 AS vdop,
    CASE WHEN k % 6 <> 5 THEN (k % 13) / 2.0 END AS solution_age,
    CASE WHEN k % 3 <> 0 AND user_id % 5 <> 0 THEN value / 40.0 END AS lat_sigma,
    CASE WHEN k % 3 <> 0 AND user_id % 5 <> 0 THEN value / 50.0 END AS lon_sigma,
    CASE WHEN k % 4 = 1 AND user_id % 3 = 0 THEN value / 30.0 END AS rms_error,
    CASE WHEN user_id % 3 = 1 AND k % 2 = 0 THEN value / 60.0 END AS gbs_lat_err,
    CASE WHEN user_id % 3 = 1 AND k % 4 <> 0 THEN value / 70.0 END AS gbs_lon_err,
    CASE WHEN k % 5 <> 0 AND user_id % 7 <> 0 THEN least(value, 60.0) END AS mean_cnr_epoch,
    CAST(k % 3 AS DOUBLE) AS cycle_slips_epoch
  FROM ev)"""


def lineitem_as_observations(spark: SparkSession, sf: str) -> DataFrame:
    """Epoch x satellite rows: recording, seconds (days here), satellite, constellation, C/N0."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("run"),
        F.col("l_shipdate").cast("timestamp").alias("epoch_utc"),
        F.col("l_partkey").alias("satellite"),
        F.col("l_returnflag").alias("constellation"),
        F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("cnr"),
        F.col("l_orderkey"),
        F.col("l_linenumber"),
        F.col("l_partkey"),
        F.col("l_extendedprice"),
    )


OBSERVATIONS_SQL = """
obs0 AS (
  SELECT l_suppkey AS run, l_shipdate AS epoch_utc, l_partkey AS satellite,
    l_returnflag AS constellation, CASE WHEN l_linenumber <> 7 THEN l_quantity END AS cnr,
    l_orderkey, l_linenumber, l_partkey, l_extendedprice
  FROM lineitem),
obs AS (
  SELECT *, CAST(epoch(epoch_utc) - epoch(min(epoch_utc) OVER (PARTITION BY run)) AS DOUBLE) AS t_sec
  FROM obs0)"""
