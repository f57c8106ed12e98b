"""Summary reports on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearsky.catalog.base import (
    DAY,
    EPOCHS_SQL,
    OBSERVATIONS_SQL,
    events_as_epochs,
    lineitem_as_observations,
    query,
    rnd,
    sql_rnd,
    table,
)
from clearsky.functions.labels import accuracy_band, cnr_band
from clearsky.operators import reports
from clearsky.operators.tables import missing_values, session_seconds
from clearsky.schemas import EXPECTED_SCENARIOS
from clearsky.session import tasks_for

CONSTELLATIONS = ["A", "N", "R"]


OBSERVATIONS_A_TASK = 150_000


def observations(spark, sf):
    return session_seconds(lineitem_as_observations(spark, sf), ["run"], "epoch_utc")


def dealt_observations(spark, sf):
    """Dealt by run and time into as many tasks as the observations ask for: aggregates by run, time and
    more need no further exchange, and distinct times of a run are counted where they lie."""
    tasks = tasks_for(table(spark, sf, "lineitem"), OBSERVATIONS_A_TASK)
    return observations(spark, sf).repartition(tasks, "run", "t_sec")


@query(
    "epoch_signal_statistics",
    f"""WITH {OBSERVATIONS_SQL}
SELECT run, t_sec, {sql_rnd("avg(cnr)")} AS mean_cnr, min(cnr) AS min_cnr, max(cnr) AS max_cnr,
  count(DISTINCT satellite) AS sat_count FROM obs WHERE cnr IS NOT NULL GROUP BY run, t_sec""",
)
def epoch_signal_statistics(spark, sf):
    out = reports.epoch_signal_stats(dealt_observations(spark, sf), ["run", "t_sec"])
    return out.select("run", "t_sec", rnd("mean_cnr").alias("mean_cnr"), "min_cnr", "max_cnr", "sat_count")


@query(
    "constellation_statistics",
    f"""WITH {OBSERVATIONS_SQL}
SELECT run, t_sec, constellation, {sql_rnd("avg(cnr)")} AS mean_cnr, count(DISTINCT satellite) AS sat_count
FROM obs GROUP BY run, t_sec, constellation""",
)
def constellation_statistics(spark, sf):
    out = reports.constellation_stats(dealt_observations(spark, sf), ["run", "t_sec"])
    return out.withColumn("mean_cnr", rnd("mean_cnr"))


@query(
    "constellation_matrix",
    f"""WITH {OBSERVATIONS_SQL}
SELECT t_sec, {", ".join(f"count(DISTINCT CASE WHEN constellation = '{c}' THEN satellite END) AS {c}" for c in CONSTELLATIONS)}
FROM obs GROUP BY t_sec""",
)
def constellation_matrix(spark, sf):
    return reports.constellation_matrix(observations(spark, sf), ["t_sec"], CONSTELLATIONS)


@query(
    "run_summary",
    f"""WITH {OBSERVATIONS_SQL}
SELECT run, max(t_sec) AS duration_s, count(DISTINCT t_sec) AS total_epochs,
  {sql_rnd("count(*) / CAST(count(DISTINCT t_sec) AS DOUBLE)")} AS obs_per_epoch, {sql_rnd("avg(cnr)")} AS mean_cnr,
  median(cnr) AS median_cnr, {sql_rnd("stddev_samp(cnr)")} AS std_cnr, min(cnr) AS min_cnr,
  {sql_rnd("100.0 * count(*) FILTER (cnr < 30) / count(cnr)")} AS below_30_pct,
  {sql_rnd("100.0 * count(*) FILTER (cnr < 25) / count(cnr)")} AS below_25_pct,
  {", ".join(sql_rnd(f"avg(cnr) FILTER (constellation = '{c}')") + f" AS mean_cnr_{c}" for c in CONSTELLATIONS)}
FROM obs GROUP BY run""",
)
def run_summary(spark, sf):
    out = reports.run_summary(dealt_observations(spark, sf), ["run"], constellations=CONSTELLATIONS)
    fuzzy = ["obs_per_epoch", "mean_cnr", "std_cnr", "below_30_pct", "below_25_pct", *[f"mean_cnr_{c}" for c in CONSTELLATIONS]]
    return out.withColumns({c: rnd(c) for c in fuzzy})


@query(
    "run_trends",
    f"""WITH {OBSERVATIONS_SQL}
SELECT constellation AS scenario, run, t_sec, {sql_rnd("avg(cnr)")} AS mean_cnr FROM obs WHERE cnr IS NOT NULL GROUP BY ALL""",
)
def run_trends(spark, sf):
    obs = dealt_observations(spark, sf).withColumnRenamed("constellation", "scenario")
    return reports.run_trends(obs, ["scenario", "run"]).withColumn("mean_cnr", rnd("mean_cnr"))


@query(
    "run_comparison",
    f"""WITH {OBSERVATIONS_SQL}
SELECT constellation AS scenario, run, max(t_sec) AS duration_s, {sql_rnd("avg(cnr)")} AS mean_cnr,
  {sql_rnd("100.0 * count(*) FILTER (cnr < 25) / count(cnr)")} AS below_25_pct, count(DISTINCT t_sec) AS total_epochs
FROM obs GROUP BY ALL""",
)
def run_comparison(spark, sf):
    obs = dealt_observations(spark, sf).withColumnRenamed("constellation", "scenario")
    return reports.run_comparison(obs, ["scenario", "run"]).withColumns(
        {"mean_cnr": rnd("mean_cnr"), "below_25_pct": rnd("below_25_pct")}
    )


# ---- phone recordings: a user is a recording, purchases are satellite records, the rest fixes ------


def phone(spark, sf):
    ep = events_as_epochs(spark, sf)
    ms = F.floor(F.unix_micros("timestamp") / 1000).alias("unix_time_ms")
    fixes = ep.where("scenario <> 'purchase'").select(
        F.col("source").alias("path"), ms, F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
        F.col("hdop").alias("accuracy_meters"), F.coalesce("num_satellites", F.lit(0.0)).cast("int").alias("num_used_signals"),
    )
    status = ep.where("scenario = 'purchase' and mean_cnr_epoch is not null").select(
        F.col("source").alias("path"), ms, F.col("mean_cnr_epoch").alias("cn0_dbhz")
    )
    return fixes, status


_PHONE = f"""
WITH {EPOCHS_SQL},
fx AS (SELECT source AS path, epoch_us(timestamp) // 1000 AS ms, lat, lon, hdop AS acc,
    CAST(coalesce(num_satellites, 0) AS INT) AS n FROM epochs WHERE scenario <> 'purchase'),
st AS (SELECT source AS path, epoch_us(timestamp) // 1000 AS ms, mean_cnr_epoch AS cn0 FROM epochs
  WHERE scenario = 'purchase' AND mean_cnr_epoch IS NOT NULL),
c AS (SELECT *, avg(lat) OVER (PARTITION BY path) AS mlat, avg(lon) OVER (PARTITION BY path) AS mlon FROM fx),
fs AS (SELECT path, min(ms) AS start_ms, max(ms) AS end_ms, (max(ms) - min(ms)) / 1000.0 AS duration_sec,
    count(*) AS num_fixes, avg(acc) AS avg_accuracy, min(acc) AS min_accuracy, max(acc) AS max_accuracy,
    avg(n) AS avg_satellites, min(n) AS min_satellites, max(n) AS max_satellites, max(lat) - min(lat) AS latitude_range,
    max(lon) - min(lon) AS longitude_range, avg(sqrt((lat - mlat) ** 2 + (lon - mlon) ** 2)) AS position_std
  FROM c GROUP BY path),
ss AS (SELECT path, avg(cn0) AS avg_cn0, min(cn0) AS min_cn0, max(cn0) AS max_cn0, count(*) AS total_signals FROM st GROUP BY path),
stats AS (SELECT fs.*, avg_cn0, min_cn0, max_cn0, coalesce(total_signals, 0) AS total_signals FROM fs LEFT JOIN ss USING (path))"""

_FUZZY = ["duration_sec", "avg_accuracy", "min_accuracy", "max_accuracy", "avg_satellites", "latitude_range", "longitude_range", "position_std", "avg_cn0"]
_PLAIN = ["path", "start_ms", "end_ms", "num_fixes", "min_satellites", "max_satellites", "min_cn0", "max_cn0", "total_signals"]


@query(
    "phone_statistics",
    _PHONE
    + f" SELECT {', '.join(_PLAIN)}, {', '.join(sql_rnd(c) + ' AS ' + c for c in _FUZZY)}, "
    + f"{sql_rnd('position_std * 111000', 3)} AS position_std_m FROM stats",
)
def phone_statistics(spark, sf):
    stats = reports.phone_statistics(*phone(spark, sf))
    return stats.select(*_PLAIN, *[rnd(c).alias(c) for c in _FUZZY], rnd("position_std_m", 3).alias("position_std_m"))


@query(
    "identified_scenarios",
    _PHONE
    + """
SELECT path, CASE WHEN coalesce(avg_cn0, 0) = 0 THEN 'UNKNOWN'
  WHEN min_satellites = 0 AND avg_satellites < 2 AND duration_sec < 60 THEN 'SCENARIO_A_INSTANT_BLOCKAGE'
  WHEN avg_satellites >= 10 AND avg_accuracy < 10 AND avg_cn0 > 38 THEN 'SCENARIO_D_OPEN_SKY'
  WHEN avg_satellites > 5 AND avg_satellites < 10 AND avg_accuracy > 10 AND avg_accuracy < 30 AND avg_cn0 > 28
    AND position_std > 0.0001 THEN 'SCENARIO_B_URBAN_CANYON'
  WHEN avg_satellites > 5 AND avg_satellites < 9 AND avg_accuracy > 5 AND avg_accuracy < 15 AND avg_cn0 > 30
    AND avg_cn0 < 36 AND position_std < 0.00005 THEN 'SCENARIO_C_PARTIAL_BLOCKAGE'
  WHEN avg_satellites > 5 AND avg_satellites < 11 AND avg_accuracy > 10 AND avg_accuracy < 25 AND avg_cn0 > 25
    AND avg_cn0 < 35 AND position_std > 0.00008 THEN 'SCENARIO_E_APPROACHING_BLOCKAGE'
  WHEN max_accuracy > 50 THEN 'SCENARIO_A_or_E (HIGH_ACCURACY_VARIANCE)'
  WHEN avg_satellites < 5 THEN 'SCENARIO_A_or_C (LOW_SATELLITES)'
  WHEN avg_accuracy < 5 THEN 'SCENARIO_D_or_C (GOOD_ACCURACY)' ELSE 'UNKNOWN' END AS scenario
FROM (SELECT path, avg_accuracy * 4 AS avg_accuracy, max_accuracy, min_satellites, avg_satellites * 0.8 AS avg_satellites,
  avg_cn0, duration_sec, position_std FROM stats)""",
)
def identified_scenarios(spark, sf):
    stats = reports.phone_statistics(*phone(spark, sf))
    # Scaled so that several rules occur in this table.
    scaled = stats.withColumns(
        {"avg_accuracy": F.col("avg_accuracy") * 4, "avg_satellites": F.col("avg_satellites") * 0.8}
    )
    return reports.identify_scenarios(scaled).select("path", "scenario")


@query(
    "scenario_coverage",
    """SELECT name AS scenario FROM (VALUES """
    + ", ".join(f"('{n}')" for n in EXPECTED_SCENARIOS)
    + """) t(name)
EXCEPT
SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'SCENARIO_D_OPEN_SKY' WHEN quality = 0 THEN 'SCENARIO_B_URBAN_CANYON'
  ELSE 'UNKNOWN' END FROM labels""",
)
def scenario_coverage(spark, sf):
    """Expected scenarios none of the recordings shows."""
    q, t = F.col("quality"), F.col("toxic")
    name = F.when((q == 1) & (t == 0), "SCENARIO_D_OPEN_SKY").when(q == 0, "SCENARIO_B_URBAN_CANYON").otherwise("UNKNOWN")
    found = table(spark, sf, "labels").select(name.alias("scenario"))
    return missing_values(reports.expected_scenarios(spark, EXPECTED_SCENARIOS), found, "scenario")


@query(
    "location_comparison",
    _PHONE
    + f""" SELECT path, {sql_rnd("duration_sec")} AS duration, num_fixes, {sql_rnd("avg_cn0")} AS avg_cn0, min_cn0, max_cn0
FROM stats WHERE total_signals > 0""",
)
def location_comparison(spark, sf):
    out = reports.location_comparison(*phone(spark, sf), ["path"])
    return out.select("path", rnd("duration").alias("duration"), "num_fixes", rnd("avg_cn0").alias("avg_cn0"), "min_cn0", "max_cn0")


@query(
    "quadratic_trends",
    f"""WITH {EPOCHS_SQL},
d AS (SELECT source, (epoch_us(timestamp) - min(epoch_us(timestamp)) OVER (PARTITION BY source)) / {DAY}.0e6 AS x, mean_cnr_epoch AS y
  FROM epochs WHERE mean_cnr_epoch IS NOT NULL),
m AS (SELECT source, count(*) AS n, avg(x) AS mx, min(x) AS lo, max(x) AS hi FROM d GROUP BY source HAVING count(*) > 2),
q AS (SELECT source, x - mx AS u, y FROM d JOIN m USING (source)),
-- centred quadratic: regress y and u^2 on u first, then the residuals on each other
r AS (SELECT source, regr_slope(y, u) AS by_, regr_intercept(y, u) AS ay, regr_slope(u * u, u) AS bq, regr_intercept(u * u, u) AS aq
  FROM q GROUP BY source),
c AS (SELECT source, sum((y - ay - by_ * u) * (u * u - aq - bq * u)) / sum((u * u - aq - bq * u) ** 2) AS c2
  FROM q JOIN r USING (source) GROUP BY source),
p AS (SELECT source, unnest(range(0, 100)) AS step, lo, hi, mx FROM m),
z AS (SELECT source, step, lo + (hi - lo) * step / 99.0 AS x, mx FROM p)
SELECT source, CAST(step AS INT) AS step, {sql_rnd("x", 4)} AS x,
  {sql_rnd("ay + by_ * (x - mx) + c2 * ((x - mx) ** 2 - aq - bq * (x - mx))", 4)} AS trend
FROM z JOIN r USING (source) JOIN c USING (source)""",
)
def quadratic_trends(spark, sf):
    known = events_as_epochs(spark, sf).where("mean_cnr_epoch is not null")
    timed = session_seconds(known, ["source"], "timestamp").withColumn("x", F.col("t_sec") / DAY)
    out = reports.quadratic_trends(timed, ["source"], "x", "mean_cnr_epoch")
    return out.select("source", "step", rnd("x", 4).alias("x"), rnd("trend", 4).alias("trend"))


@query(
    "display_bands",
    f"""WITH {EPOCHS_SQL}
SELECT event_id, CASE WHEN mean_cnr_epoch >= 35 THEN 'CLEAN' WHEN mean_cnr_epoch >= 30 THEN 'WARNING'
  WHEN mean_cnr_epoch >= 25 THEN 'DEGRADED' WHEN mean_cnr_epoch >= 10 THEN 'POOR' WHEN mean_cnr_epoch IS NOT NULL THEN 'SEVERE' END AS cn0_band,
  CASE WHEN hdop <= 2 THEN 'CLEAN' WHEN hdop <= 5 THEN 'WARNING' WHEN hdop <= 10 THEN 'DEGRADED' ELSE 'SEVERE' END AS accuracy_band
FROM epochs""",
)
def display_bands(spark, sf):
    return events_as_epochs(spark, sf).select(
        "event_id", cnr_band("mean_cnr_epoch").alias("cn0_band"), accuracy_band("hdop").alias("accuracy_band")
    )


# ---- labelled sets ------------------------------------------------------------------------------------


@query(
    "label_distribution",
    f"""SELECT o_orderpriority, o_orderstatus AS label, count(*) AS n,
  {sql_rnd("100.0 * count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority)")} AS pct,
  100.0 * count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority) < 5.0 AS rare
FROM orders GROUP BY o_orderpriority, o_orderstatus""",
)
def label_distribution(spark, sf):
    out = reports.label_distribution(table(spark, sf, "orders"), "o_orderstatus", ["o_orderpriority"])
    return out.select("o_orderpriority", F.col("o_orderstatus").alias("label"), "n", rnd("pct").alias("pct"), "rare")


@query(
    "dataset_summary",
    f"""WITH {EPOCHS_SQL}
SELECT scenario, count(*) AS n_rows, count(DISTINCT source) AS n_sources, epoch_us(min(timestamp)) AS first_us,
  epoch_us(max(timestamp)) AS last_us, 8 AS features_present
FROM epochs GROUP BY ROLLUP (scenario)""",
)
def dataset_summary(spark, sf):
    out = reports.dataset_summary(events_as_epochs(spark, sf))
    return out.select(
        "scenario", "n_rows", "n_sources", F.unix_micros("first_time").alias("first_us"),
        F.unix_micros("last_time").alias("last_us"), "features_present",
    )


@query(
    "split_report",
    f"""SELECT o_orderpriority AS split, count(*) AS n, {sql_rnd("100.0 * count(*) / sum(count(*)) OVER ()")} AS pct,
  count(*) FILTER (o_orderstatus = 'F') AS "n_F", count(*) FILTER (o_orderstatus = 'O') AS "n_O",
  count(*) FILTER (o_orderstatus = 'P') AS "n_P" FROM orders GROUP BY o_orderpriority""",
)
def split_report(spark, sf):
    out = reports.split_report(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])
    return out.withColumnRenamed("o_orderpriority", "split").withColumn("pct", rnd("pct"))
