"""Window features, ordered operators and labels on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearsky.catalog.base import (
    CHUNK,
    DAY,
    EPOCHS_SQL,
    FRAME_DAYS,
    events_as_epochs,
    query,
    rnd,
    rounded,
    sql_rnd,
    table,
)
from clearsky.functions.labels import cnr_rule, label_name, legacy_label, quality_label, sigma_label
from clearsky.operators.features import legacy_features, window_features
from clearsky.operators.ordered import forward_fill, row_index
from clearsky.operators.reports import label_distribution
from clearsky.operators.tables import session_seconds
from clearsky.schemas import FEATURES

# ---- second generation: trailing time frame -----------------------------------------------------

# The check keeps the rows of each frame as lists and works on those.
_WINDOW_SQL = f"""
WITH {EPOCHS_SQL},
fr AS (
  SELECT *,
    count(*) OVER w AS n_frame,
    epoch_us(timestamp) - epoch_us(min(timestamp) OVER w) AS span_us,
    list(lat_sigma) FILTER (lat_sigma IS NOT NULL) OVER w AS las,
    list(lon_sigma) FILTER (lon_sigma IS NOT NULL) OVER w AS los,
    list(mean_cnr_epoch) FILTER (mean_cnr_epoch IS NOT NULL) OVER w AS cs,
    list(num_satellites) FILTER (num_satellites IS NOT NULL) OVER w AS ns,
    list(coalesce(fix_quality, 0)) OVER w AS fs,
    list(solution_age) FILTER (solution_age IS NOT NULL) OVER w AS ages,
    list(rms_error) FILTER (rms_error IS NOT NULL) OVER w AS rms,
    count(gbs_lat_err) OVER w AS gbs_n,
    list(sqrt(coalesce(gbs_lat_err, 0) ** 2 + coalesce(gbs_lon_err, 0) ** 2)) OVER w AS gbs
  FROM epochs
  WINDOW w AS (PARTITION BY source ORDER BY timestamp
               RANGE BETWEEN INTERVAL {FRAME_DAYS} DAY PRECEDING AND CURRENT ROW)),
a AS (
  SELECT *,
    CASE fix_quality WHEN 4 THEN 48.0 WHEN 5 THEN 35.0 WHEN 1 THEN 40.0 WHEN 2 THEN 42.0
      WHEN 3 THEN 38.0 WHEN 0 THEN 20.0 ELSE 30.0 END AS est,
    len(cs) AS cn, len(ns) AS nn, len(ages) AS an, len(rms) AS rn
  FROM fr WHERE n_frame >= 2),
b AS (
  SELECT *,
    CASE WHEN cn > 0 THEN list_avg(cs) ELSE est END AS mean_cnr,
    CASE WHEN cn > 0 THEN list_min(cs) ELSE est END AS min_cnr,
    CASE WHEN cn > 0 THEN list_max(cs) ELSE est END AS max_cnr,
    CASE WHEN cn > 0 THEN list_stddev_pop(cs) ELSE 0.0 END AS std_cnr,
    CASE WHEN cn >= 3 THEN
      (cn * list_sum(list_transform(range(1, cn + 1), lambda i: (i - 1) * cs[i]))
        - (cn * (cn - 1) / 2.0) * list_sum(cs))
      / (cn * ((cn - 1) * cn * (2 * cn - 1) / 6.0) - (cn * (cn - 1) / 2.0) ** 2)
      ELSE 0.0 END AS cnr_trend,
    CASE WHEN len(las) > 0 THEN list_var_samp(las) + list_var_samp(los)
      ELSE (hdop * 2.5) ** 2 END AS position_variance
  FROM a),
feats AS (
  SELECT event_id, lat, lon, alt, list_avg(las) AS lat_std, list_avg(los) AS lon_std,
    mean_cnr, min_cnr, max_cnr, std_cnr, cnr_trend,
    num_satellites, coalesce(list_avg(ns), 0.0) AS sat_mean, coalesce(list_min(ns), 0.0) AS sat_min,
    CASE WHEN num_satellites IS NOT NULL THEN least(num_satellites / 50.0, 1.0) END AS sat_visibility,
    CASE WHEN nn > 1 THEN
      list_sum(list_transform(range(2, nn + 1), lambda i: least(ns[i] - ns[i - 1], 0.0)))
      / greatest(span_us / 1e6, 1.0) ELSE 0.0 END AS sat_drop_rate,
    pdop, hdop, vdop,
    CASE WHEN num_satellites IS NOT NULL AND pdop IS NOT NULL THEN
      sqrt(pdop ** 2 + greatest(pdop / greatest(num_satellites, 1.0), 0.5) ** 2) END AS gdop,
    CASE WHEN vdop > 0 THEN hdop / vdop ELSE hdop END AS dop_ratio,
    CASE fix_quality WHEN 4 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.85 WHEN 3 THEN 0.7
      WHEN 5 THEN 0.5 WHEN 6 THEN 0.4 WHEN 0 THEN 0.0 ELSE 0.3 END AS solution_status,
    num_satellites AS baseline_sats, solution_age,
    len(list_filter(fs, lambda q: q >= 1)) / CAST(len(fs) AS DOUBLE) AS fix_continuity,
    CAST(len(list_filter(range(2, len(fs) + 1), lambda i: fs[i] <> fs[i - 1])) AS DOUBLE) AS fix_transitions,
    position_variance, std_cnr ** 2 AS cnr_variance,
    CASE WHEN num_satellites > 0 THEN greatest(0.0, (num_satellites - 20) / 20.0) ELSE 0.0 END
      AS elevation_violations,
    position_variance * (50.0 / greatest(mean_cnr, 1.0)) AS multipath,
    CASE WHEN an > 0 THEN
      coalesce(list_sum(list_transform(range(2, an + 1), lambda i: abs(ages[i] - ages[i - 1]))), 0.0) / an
      END AS clock_bias,
    0.0 AS iono_delay,
    greatest(0.0, 2.3 - 0.0116 * greatest(coalesce(alt, 50.0), 0.0)) AS tropo_delay,
    cycle_slips_epoch AS cycle_slips,
    CASE WHEN rn > 0 THEN list_avg(rms) WHEN gbs_n > 0 THEN list_avg(gbs) ELSE hdop * 2.0 END
      AS residual_mean,
    CASE WHEN rn > 1 THEN list_stddev_samp(rms) WHEN rn > 0 THEN 0.0
      WHEN gbs_n > 0 THEN list_stddev_samp(gbs) ELSE std_cnr * 0.1 END AS residual_std
  FROM b)"""


def _events_features(spark, sf):
    return window_features(
        events_as_epochs(spark, sf),
        session=["source"],
        window_seconds=FRAME_DAYS * DAY,
        chunk_seconds=CHUNK,
        keep=["event_id"],
    )


FEATURE_GROUPS = {
    "position": FEATURES[0:5],
    "signal": FEATURES[5:10],
    "satellites": FEATURES[10:15],
    "geometry": FEATURES[15:20],
    "receiver": FEATURES[20:25],
    "temporal": FEATURES[25:30],
    "atmosphere": FEATURES[30:35],
}


def _register_window_group(group: str, columns: list[str]) -> None:
    places = {"sat_drop_rate": 9}
    sql = (
        _WINDOW_SQL
        + "\nSELECT event_id, "
        + ", ".join(f"{sql_rnd(c, places.get(c, 6))} AS {c}" for c in columns)
        + " FROM feats"
    )

    @query(f"window_features_{group}", sql)
    def run(spark, sf):
        feats = _events_features(spark, sf)
        return feats.select("event_id", *[rnd(c, places.get(c, 6)).alias(c) for c in columns])


for _group, _columns in FEATURE_GROUPS.items():
    _register_window_group(_group, _columns)


@query(
    "labelled_classes",
    _WINDOW_SQL
    + """,
lab AS (
  SELECT CASE
    WHEN coalesce(mean_cnr < 25, false) OR coalesce(hdop > 5, false) OR coalesce(pdop > 8, false)
      OR coalesce(num_satellites < 4, false) OR solution_status = 0 THEN 2
    WHEN coalesce(mean_cnr >= 35, true) AND coalesce(hdop <= 2.5, true) AND coalesce(pdop <= 4, true)
      AND coalesce(num_satellites >= 8, true) AND solution_status > 0 THEN 0
    ELSE 1 END AS label FROM feats)
SELECT label, CASE label WHEN 0 THEN 'CLEAN' WHEN 1 THEN 'WARNING' ELSE 'DEGRADED' END AS label_name,
  count(*) AS n, """
    + sql_rnd("100.0 * count(*) / sum(count(*)) OVER ()")
    + """ AS pct,
  100.0 * count(*) / sum(count(*)) OVER () < 5.0 AS rare
FROM lab GROUP BY label""",
)
def labelled_classes(spark, sf):
    """Epochs to features to labels to class shares: the whole first job."""
    labelled = _events_features(spark, sf).select(quality_label().alias("label"))
    counts = label_distribution(labelled)
    return counts.select("label", label_name(F.col("label")).alias("label_name"), "n", rnd("pct").alias("pct"), "rare")


@query(
    "quality_label",
    f"""WITH {EPOCHS_SQL}
SELECT event_id, CASE
  WHEN coalesce(mean_cnr_epoch < 25, false) OR coalesce(hdop > 5, false) OR coalesce(pdop > 8, false)
    OR coalesce(num_satellites < 4, false) OR fix_quality = 0 THEN 2
  WHEN coalesce(mean_cnr_epoch >= 35, true) AND coalesce(hdop <= 2.5, true) AND coalesce(pdop <= 4, true)
    AND coalesce(num_satellites >= 8, true) AND fix_quality > 0 THEN 0
  ELSE 1 END AS label FROM epochs""",
)
def quality_label_rule(spark, sf):
    return events_as_epochs(spark, sf).select(
        "event_id",
        quality_label("mean_cnr_epoch", "hdop", "pdop", "num_satellites", "fix_quality").alias("label"),
    )


@query(
    "legacy_label",
    f"""WITH {EPOCHS_SQL}
SELECT event_id, CASE
  WHEN coalesce(sqrt(lat_sigma ** 2 + lon_sigma ** 2) > 5, false) OR coalesce(mean_cnr_epoch < 30, false)
    OR coalesce(num_satellites < 4, false) OR fix_quality / 6.0 < 0.25 OR vdop / 2.0 < 0.1 THEN 'DEGRADED'
  WHEN coalesce(sqrt(lat_sigma ** 2 + lon_sigma ** 2) < 2 AND mean_cnr_epoch > 35 AND num_satellites >= 6
    AND fix_quality / 6.0 >= 0.75 AND vdop / 2.0 >= 0.7, false) THEN 'CLEAN'
  ELSE 'WARNING' END AS label FROM epochs""",
)
def legacy_label_rule(spark, sf):
    return events_as_epochs(spark, sf).select(
        "event_id",
        legacy_label(
            "lat_sigma", "lon_sigma", "mean_cnr_epoch", "num_satellites",
            F.col("fix_quality") / 6.0, F.col("vdop") / 2.0,
        ).alias("label"),
    )


def _sigma_sql(clean: float, degraded: float, clean_n: int, degraded_n: int) -> str:
    return f"""CASE
  WHEN fix_quality = 0 OR coalesce(lat_sigma > {degraded}, false) OR coalesce(lon_sigma > {degraded}, false)
    OR coalesce(num_satellites < {degraded_n}, false) THEN 2
  WHEN (lat_sigma IS NOT NULL OR lon_sigma IS NOT NULL OR num_satellites IS NOT NULL)
    AND coalesce(lat_sigma < {clean}, true) AND coalesce(lon_sigma < {clean}, true)
    AND coalesce(num_satellites >= {clean_n}, true) THEN 0
  ELSE 1 END"""


@query(
    "sigma_label",
    f"""WITH {EPOCHS_SQL}
SELECT event_id, {_sigma_sql(2, 5, 1, 0)} AS campus_label, {_sigma_sql(3, 10, 5, 3)} AS vehicle_label FROM epochs""",
)
def sigma_label_rule(spark, sf):
    cols = {"lat_std": "lat_sigma", "lon_std": "lon_sigma", "solution_status": "fix_quality"}
    return events_as_epochs(spark, sf).select(
        "event_id",
        sigma_label(2, 5, 1, 0, **cols).alias("campus_label"),
        sigma_label(3, 10, 5, 3, **cols).alias("vehicle_label"),
    )


@query(
    "cnr_rule_on_session_mean",
    f"""WITH {EPOCHS_SQL}
SELECT source, {sql_rnd("avg(mean_cnr_epoch)")} AS mean_cnr,
  CASE WHEN avg(mean_cnr_epoch) < 30 THEN 2 WHEN avg(mean_cnr_epoch) < 37 THEN 1 ELSE 0 END AS label
FROM epochs GROUP BY source""",
)
def cnr_rule_on_session_mean(spark, sf):
    means = events_as_epochs(spark, sf).groupBy("source").agg(F.avg("mean_cnr_epoch").alias("m"))
    return means.select("source", rnd("m").alias("mean_cnr"), cnr_rule("m").alias("label"))


# ---- trailing time frame with ties ----------------------------------------------------------------


@query(
    "window_features_tied_times",
    f"""
WITH li AS (
  SELECT l_suppkey, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_tax,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS rn
  FROM lineitem),
cum AS (SELECT *, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY rn ROWS UNBOUNDED PRECEDING) AS q FROM li),
o AS (SELECT *, rn - min(rn) OVER w + 1 AS n, q - min(q - l_quantity) OVER w AS s FROM cum
  WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW))
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, {sql_rnd("s / n", 4)} AS mean_cnr FROM o WHERE n >= 2""",
)
def window_features_tied_times(spark, sf):
    """Many observations share one time: each frame ends at its own row."""
    li = table(spark, sf, "lineitem")
    null = F.lit(None).cast("double")
    epochs = li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        F.col("l_suppkey").alias("source"), F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        F.col("l_quantity").alias("mean_cnr_epoch"), F.col("l_tax").alias("hdop"),
        F.lit(1).alias("fix_quality"),
        *[null.alias(c) for c in (
            "lat", "lon", "alt", "num_satellites", "pdop", "vdop", "solution_age", "lat_sigma", "lon_sigma",
            "rms_error", "gbs_lat_err", "gbs_lon_err", "cycle_slips_epoch")],
    )
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    feats = window_features(
        epochs, ["source"], "timestamp", keys, window_seconds=30 * DAY, chunk_seconds=365 * DAY / 15, keep=keys
    )
    return feats.select(*keys, rnd("mean_cnr", 4).alias("mean_cnr"))


# ---- first generation: rows before the current one ----------------------------------------------

_LEGACY_SQL = f"""
WITH {EPOCHS_SQL},
s AS (
  SELECT event_id, source, timestamp, lat AS latitude, lon AS longitude, alt AS altitude,
    fix_quality + 1.0 AS q, coalesce(num_satellites, 0) AS ns, lat_sigma AS sdn, lon_sigma AS sde,
    solution_age AS age, hdop AS ratio,
    row_number() OVER (PARTITION BY source ORDER BY timestamp) AS rn
  FROM epochs),
fr AS (
  SELECT *, list(sdn) FILTER (sdn IS NOT NULL) OVER w AS n_, list(sde) FILTER (sde IS NOT NULL) OVER w AS e_,
    list(50 - 5 * q) OVER w AS c, list(ns) OVER w AS sats, list(q) OVER w AS qs, list(ratio) OVER w AS rs
  FROM s WINDOW w AS (PARTITION BY source ORDER BY timestamp ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
feats AS (
  SELECT event_id, latitude AS lat, longitude AS lon, altitude AS alt,
    list_avg(n_) AS lat_std, list_avg(e_) AS lon_std,
    list_avg(c) AS mean_cnr, list_min(c) AS min_cnr, list_max(c) AS max_cnr, list_stddev_samp(c) AS std_cnr,
    (c[30] - c[1]) / 30.0 AS cnr_trend,
    ns AS num_satellites, list_avg(sats) AS sat_mean, list_min(sats) AS sat_min, ns / 32.0 AS sat_visibility,
    list_sum(list_transform(range(2, 31), lambda i: least(sats[i] - sats[i - 1], 0.0))) / 30.0 AS sat_drop_rate,
    2.5 AS pdop, 2.0 AS hdop, 1.5 AS vdop, 3.0 AS gdop, 2.0 / 1.5 AS dop_ratio,
    1 - (least(q, 5) - 1) / 4.0 AS solution_status, ns AS baseline_sats, age AS solution_age,
    len(list_filter(qs, lambda v: v = 1)) / 30.0 AS fix_continuity,
    CAST(len(list_filter(range(2, 31), lambda i: qs[i] > qs[i - 1])) AS DOUBLE) AS fix_transitions,
    list_var_samp(n_) + list_var_samp(e_) AS position_variance,
    list_stddev_samp(c) ** 2 AS cnr_variance, greatest(8 - ns, 0) / 8.0 AS elevation_violations,
    (list_var_samp(n_) + list_var_samp(e_)) / greatest(list_avg(c), 1.0) AS multipath, age AS clock_bias,
    0.0 AS iono_delay, 0.0 AS tropo_delay, 0.0 AS cycle_slips,
    list_avg(rs) AS residual_mean, list_stddev_samp(rs) AS residual_std
  FROM fr WHERE rn > 30)"""


@query(
    "legacy_window_features",
    _LEGACY_SQL + "\nSELECT event_id, " + ", ".join(f"{sql_rnd(c)} AS {c}" for c in FEATURES) + " FROM feats",
)
def legacy_window_features(spark, sf):
    fixes = events_as_epochs(spark, sf).select(
        "event_id", "source", "timestamp",
        F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.col("alt").alias("altitude"),
        (F.col("fix_quality") + 1.0).alias("q"), F.coalesce("num_satellites", F.lit(0.0)).alias("ns"),
        F.col("lat_sigma").alias("sdn"), F.col("lon_sigma").alias("sde"),
        F.col("solution_age").alias("age"), F.col("hdop").alias("ratio"),
    )
    feats = legacy_features(fixes, ["source"], "timestamp", chunk_seconds=CHUNK, block_rows=100, keep=["event_id"])
    return rounded(feats.select("event_id", *FEATURES), list(FEATURES))


# ---- ordered operators ----------------------------------------------------------------------------


@query(
    "seconds_since_start",
    f"""WITH {EPOCHS_SQL}
SELECT event_id, {sql_rnd("(epoch_us(timestamp) - epoch_us(min(timestamp) OVER (PARTITION BY source))) / 1e6")} AS t_sec
FROM epochs""",
)
def seconds_since_start(spark, sf):
    timed = session_seconds(events_as_epochs(spark, sf), ["source"], "timestamp")
    return timed.select("event_id", rnd("t_sec").alias("t_sec"))


@query(
    "forward_fill",
    f"""WITH {EPOCHS_SQL}
SELECT event_id, {", ".join(
    sql_rnd(f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY source ORDER BY timestamp), 0.0)") + f" AS {c}"
    for c in ("rms_error", "lat_sigma", "pdop"))}
FROM epochs""",
)
def forward_fill_in_session(spark, sf):
    cols = ["rms_error", "lat_sigma", "pdop"]
    filled = forward_fill(events_as_epochs(spark, sf), ["source"], "timestamp", cols, chunk_seconds=3 * DAY)
    return filled.select("event_id", *[rnd(F.coalesce(c, F.lit(0.0))).alias(c) for c in cols])


@query(
    "row_numbers",
    f"""WITH {EPOCHS_SQL}
SELECT event_id, row_number() OVER (PARTITION BY source ORDER BY timestamp, event_id) AS row_idx FROM epochs""",
)
def row_numbers(spark, sf):
    numbered = row_index(
        events_as_epochs(spark, sf), ["source"], "timestamp", ["timestamp", "event_id"], chunk_seconds=3 * DAY
    )
    return numbered.select("event_id", "row_idx")
