"""Splits, scaling, imputation and windows on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearsky import sinks
from clearsky.catalog.base import CHUNK, DAY, EPOCHS_SQL, events_as_epochs, query, rnd, sql_rnd, table
from clearsky.catalog.joins import _NAMED, named_sources
from clearsky.operators import prep
from clearsky.operators.ordered import exact_quantiles

LINE_KEY = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]


@query(
    "temporal_split",
    f"""WITH t AS (SELECT {", ".join(LINE_KEY[1:])}, row_number() OVER (ORDER BY {", ".join(LINE_KEY)}) - 1 AS i, count(*) OVER () AS n FROM lineitem)
SELECT {", ".join(LINE_KEY[1:])}, CASE WHEN i < CAST(floor(n * 0.7) AS BIGINT) THEN 'train'
  WHEN i < CAST(floor(n * 0.85) AS BIGINT) THEN 'val' ELSE 'test' END AS split FROM t""",
)
def temporal_split(spark, sf):
    return prep.temporal_split(table(spark, sf, "lineitem"), LINE_KEY).select(*LINE_KEY[1:], "split")


@query(
    "source_split",
    f"""WITH {_NAMED}, l AS (SELECT event_id, lower(source) AS s FROM named)
SELECT event_id, CASE WHEN regexp_matches(s, 'scenario_[a-e]|supervisor_vehicle|supervisor_drone') THEN 'train'
  WHEN s LIKE '%nclt%' THEN 'val' WHEN regexp_matches(s, 'urbannav|oxford|kaist') THEN 'test' ELSE 'train' END AS split FROM l""",
)
def source_split(spark, sf):
    return prep.source_split(named_sources(spark, sf)).select("event_id", "split")


_SESSION_SPLITS = f"""
WITH {_NAMED},
ses AS (SELECT DISTINCT 'user' || user_id AS scenario, source FROM named),
g AS (SELECT *, CASE WHEN source LIKE '%scenario%' THEN 'scenarios' WHEN source LIKE '%supervisor%' THEN 'supervisor'
  WHEN source LIKE '%drone%' THEN 'drone' WHEN source LIKE '%urbannav_tunnel%' THEN 'urbannav_tunnel'
  WHEN source LIKE '%urbannav%' THEN 'urbannav_medium' WHEN source LIKE '%tokyo%' THEN 'tokyo'
  WHEN source LIKE '%nclt%' THEN 'nclt' WHEN source LIKE '%oxford%' THEN 'oxford' ELSE 'other' END AS grp FROM ses),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY md5('42:' || scenario), scenario) AS place, count(*) OVER (PARTITION BY grp) AS n FROM g),
s AS (SELECT *, greatest(1, CAST(round_even(n * 0.15, 0) AS BIGINT)) AS share FROM r),
z AS (SELECT *, CASE WHEN n - 2 * share < 1 THEN greatest(1, n - 1) ELSE n - 2 * share END AS tr,
  CASE WHEN n - 2 * share < 1 THEN greatest(0, (n - greatest(1, n - 1)) // 2) ELSE share END AS va FROM s),
splits AS (SELECT scenario, grp, CASE WHEN place <= tr THEN 'train' WHEN place <= tr + va THEN 'validation' ELSE 'test' END AS split FROM z)
"""


def _sessions(spark, sf):
    named = named_sources(spark, sf)
    return named.select(F.concat(F.lit("user"), F.col("user_id")).alias("scenario"), "source").distinct()


@query("session_splits", _SESSION_SPLITS + ' SELECT scenario, grp AS "group", split FROM splits')
def session_splits(spark, sf):
    return prep.session_splits(_sessions(spark, sf))


@query(
    "session_split_rows",
    _SESSION_SPLITS
    + " SELECT e.event_id, s.split FROM events e JOIN splits s ON s.scenario = 'user' || e.user_id",
)
def session_split_rows(spark, sf):
    rows = named_sources(spark, sf).withColumn("scenario", F.concat(F.lit("user"), F.col("user_id")))
    return prep.session_split(rows, prep.session_splits(_sessions(spark, sf))).select("event_id", "split")


@query(
    "leave_one_out_folds",
    """SELECT f.s AS fold, CASE WHEN f.s = c.c_mktsegment THEN 'test' ELSE 'train' END AS role, count(*) AS n
FROM customer c CROSS JOIN (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']) AS s) f GROUP BY ALL""",
)
def leave_one_out_folds(spark, sf):
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    folds = prep.leave_one_out_folds(table(spark, sf, "customer").select("c_mktsegment"), "c_mktsegment", segments)
    return folds.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


# ---- scaling: embedding components as features, vectors of labels 0-6 train ----------------------

_DIMS = [f"e{i}" for i in range(64)]


def _vectors(spark, sf):
    emb = table(spark, sf, "embeddings")
    split = F.when(F.col("label") < 7, "train").when(F.col("label") < 9, "val").otherwise("test")
    # e5 is made constant and e6 has nulls, to meet both special cases.
    cols = {
        "e5": F.lit(2.0),
        "e6": F.when(F.col("label") % 2 == 0, F.get("embedding", F.lit(6)).cast("double")),
    }
    return emb.select(
        "vec_id", split.alias("split"),
        *[cols.get(d, F.get("embedding", F.lit(i)).cast("double")).alias(d) for i, d in enumerate(_DIMS)],
    )


_VECTORS = (
    "WITH v AS (SELECT vec_id, CASE WHEN label < 7 THEN 'train' WHEN label < 9 THEN 'val' ELSE 'test' END AS split, "
    + ", ".join(
        "2.0::DOUBLE AS e5" if d == "e5"
        else "CASE WHEN label % 2 = 0 THEN embedding[7]::DOUBLE END AS e6" if d == "e6"
        else f"embedding[{i + 1}]::DOUBLE AS {d}"
        for i, d in enumerate(_DIMS)
    )
    + " FROM embeddings)"
)


def _scaled_sql(center: str, width: str, value: str) -> str:
    params = ", ".join(f"{center.format(c=d)} AS a_{d}, {width.format(c=d)} AS b_{d}" for d in _DIMS)
    out = ", ".join(
        sql_rnd(f"({value.format(c=d)} - a_{d}) / CASE WHEN b_{d} > 1e-12 THEN b_{d} ELSE 1.0 END", 5) + f" AS {d}" for d in _DIMS
    )
    return f"{_VECTORS}, p AS (SELECT {params} FROM v WHERE split = 'train') SELECT vec_id, split, {out} FROM v, p"


@query("standard_scaled", _scaled_sql("avg(coalesce({c}, 0))", "stddev_pop(coalesce({c}, 0))", "coalesce({c}, 0)"))
def standard_scaled(spark, sf):
    v = _vectors(spark, sf)
    out = prep.apply_standard(v, prep.fit_standard(v, _DIMS), _DIMS)
    return out.select("vec_id", "split", *[rnd(d, 5).alias(d) for d in _DIMS])


@query("min_max_scaled", _scaled_sql("min({c})", "max({c}) - min({c})", "{c}"))
def min_max_scaled(spark, sf):
    v = _vectors(spark, sf)
    out = prep.apply_min_max(v, prep.fit_min_max(v, _DIMS), _DIMS)
    return out.select("vec_id", "split", *[rnd(d, 5).alias(d) for d in _DIMS])


@query(
    "scaler_parameters",
    _VECTORS
    + ", p AS ("
    + " UNION ALL ".join(
        f"SELECT {i} AS position, '{d}' AS \"column\", min({d}) AS mn, max({d}) - min({d}) AS rg FROM v WHERE split = 'train'"
        for i, d in enumerate(_DIMS)
    )
    + f") SELECT position, \"column\", {sql_rnd('mn')} AS min, {sql_rnd('CASE WHEN rg > 0 THEN rg ELSE 1.0 END')} AS range FROM p",
)
def scaler_parameters(spark, sf):
    params = prep.fit_min_max(_vectors(spark, sf), _DIMS)
    out = prep.scaler_table(params, _DIMS, ("min", "range"))
    return out.select("position", "column", rnd("min").alias("min"), rnd("range").alias("range"))


# ---- imputation --------------------------------------------------------------------------------------


def _holes(spark, sf):
    """Epoch columns as a feature table with missing values of every kind."""
    ep = events_as_epochs(spark, sf)
    n, v = F.col("num_satellites"), F.col("hdop")
    return ep.select(
        "event_id", "source", "timestamp", "alt",
        F.col("mean_cnr_epoch").alias("mean_cnr"), (F.col("mean_cnr_epoch") - 1).alias("min_cnr"),
        (F.col("mean_cnr_epoch") + 1).alias("max_cnr"), (F.col("mean_cnr_epoch") / 9).alias("std_cnr"),
        F.col("lat_sigma").alias("cnr_trend"),
        F.col("lat_sigma").alias("lat_std"), F.col("lon_sigma").alias("lon_std"),
        n.alias("num_satellites"),
        F.col("pdop").alias("pdop"), F.when(F.col("fix_quality") > 2, v).alias("hdop"),
        F.when(F.col("vdop") > 0, F.col("vdop")).alias("vdop"), (F.col("pdop") * 1.5).alias("gdop"),
        F.when(F.col("vdop") > 0, v / F.when(F.col("vdop") > 0, F.col("vdop"))).alias("dop_ratio"),
        F.col("rms_error").alias("residual_mean"), F.col("solution_age").alias("solution_age"),
    )


_HOLES = f"""
WITH {EPOCHS_SQL},
h AS (SELECT event_id, source, timestamp, alt, mean_cnr_epoch AS mean_cnr, mean_cnr_epoch - 1 AS min_cnr,
  mean_cnr_epoch + 1 AS max_cnr, mean_cnr_epoch / 9 AS std_cnr, lat_sigma AS cnr_trend, lat_sigma AS lat_std,
  lon_sigma AS lon_std, num_satellites, pdop, CASE WHEN fix_quality > 2 THEN hdop END AS hdop,
  CASE WHEN vdop > 0 THEN vdop END AS vdop, pdop * 1.5 AS gdop, CASE WHEN vdop > 0 THEN hdop / vdop END AS dop_ratio,
  rms_error AS residual_mean, solution_age FROM epochs),
med AS (SELECT median(pdop) AS mp, median(hdop) AS mh, median(vdop) AS mv, median(gdop) AS mg, median(dop_ratio) AS mr FROM h),
alts AS (SELECT source, median(alt) AS ma FROM h GROUP BY source),
s1 AS (SELECT h.*, CASE WHEN num_satellites > 0 THEN num_satellites END AS n, med.*, ma,
  CASE WHEN mean_cnr IS NOT NULL THEN 1.0 ELSE 0.0 END AS cnr_available FROM h JOIN alts USING (source), med),
s2 AS (SELECT event_id, source, timestamp, cnr_available, coalesce(alt, ma, 0.0) AS alt,
  {", ".join(f"coalesce({c}, 0.0) AS {c}" for c in ("mean_cnr", "min_cnr", "max_cnr", "std_cnr", "cnr_trend"))},
  coalesce(lat_std, hdop * 2.5, mh * 2.5) AS lat_std, coalesce(lon_std, hdop * 2.5, mh * 2.5) AS lon_std, num_satellites,
  coalesce(pdop, least(greatest(30 / sqrt(n), 1), 30), mp) AS pdop,
  coalesce(hdop, least(greatest(20 / sqrt(n), 0.5), 20), mh) AS hdop,
  coalesce(vdop, least(greatest(25 / sqrt(n), 0.5), 25), mv) AS vdop,
  coalesce(gdop, least(greatest(35 / sqrt(n), 1), 50), mg) AS gdop,
  coalesce(dop_ratio, least(greatest(20 / sqrt(n), 0.5), 20) / least(greatest(25 / sqrt(n), 0.5), 25), 1.0) AS dop_ratio,
  residual_mean, solution_age, n FROM s1)
"""
# least/greatest skip nulls in both engines, so the check blanks estimates without satellites.
for _c in ("30 / sqrt(n), 1), 30)", "20 / sqrt(n), 0.5), 20)", "25 / sqrt(n), 0.5), 25)", "35 / sqrt(n), 1), 50)"):
    _HOLES = _HOLES.replace(f"least(greatest({_c}", f"(CASE WHEN n IS NOT NULL THEN least(greatest({_c} END)")


@query(
    "flagged_signal",
    _HOLES + f"SELECT event_id, cnr_available, {sql_rnd('mean_cnr')} AS mean_cnr, {sql_rnd('std_cnr')} AS std_cnr FROM s2",
)
def flagged_signal(spark, sf):
    out = prep.flag_and_zero_cnr(_holes(spark, sf))
    return out.select("event_id", F.col("cnr_available").cast("double").alias("cnr_available"), rnd("mean_cnr").alias("mean_cnr"), rnd("std_cnr").alias("std_cnr"))


@query("session_median_fill", _HOLES + f"SELECT event_id, {sql_rnd('alt')} AS alt FROM s2")
def session_median_fill(spark, sf):
    return prep.fill_session_median(_holes(spark, sf), ["alt"], ["source"]).select("event_id", rnd("alt").alias("alt"))


_GEOMETRY = ["lat_std", "lon_std", "pdop", "hdop", "vdop", "gdop", "dop_ratio"]


@query("geometry_fill", _HOLES + f"SELECT event_id, {', '.join(sql_rnd(c) + ' AS ' + c for c in _GEOMETRY)} FROM s2")
def geometry_fill(spark, sf):
    return prep.fill_geometry(_holes(spark, sf)).select("event_id", *[rnd(c).alias(c) for c in _GEOMETRY])


_IMPUTED = ["alt", "mean_cnr", "cnr_trend", *_GEOMETRY, "num_satellites", "residual_mean", "solution_age"]


@query(
    "imputed_features",
    _HOLES
    + "SELECT event_id, cnr_available, "
    + ", ".join(
        sql_rnd(f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY source ORDER BY timestamp), 0.0)") + f" AS {c}"
        for c in _IMPUTED
    )
    + " FROM s2",
)
def imputed_features(spark, sf):
    """All filling rules in a row."""
    out = prep.impute(_holes(spark, sf), ["source"], "timestamp", chunk_seconds=CHUNK)
    return out.select("event_id", F.col("cnr_available").cast("double").alias("cnr_available"), *[rnd(c).alias(c) for c in _IMPUTED])


@query(
    "exact_quantiles_by_group",
    f"""SELECT l_returnflag, {sql_rnd("quantile_cont(l_extendedprice, 0.1)")} AS p10, {sql_rnd("median(l_extendedprice)")} AS p50,
  {sql_rnd("quantile_cont(l_extendedprice, 0.999)")} AS p999 FROM lineitem GROUP BY l_returnflag""",
)
def exact_quantiles_by_group(spark, sf):
    probs = {"p10": 0.1, "p50": 0.5, "p999": 0.999}
    out = exact_quantiles(table(spark, sf, "lineitem"), "l_extendedprice", probs, ["l_returnflag"])
    return out.select("l_returnflag", *[rnd(p).alias(p) for p in probs])


# ---- windows ---------------------------------------------------------------------------------------------


def _windows_sql(rows: int, horizons: tuple[int, ...]) -> str:
    far = max(horizons)
    leads = ", ".join(f"lead(y, {h}) OVER (PARTITION BY source ORDER BY timestamp) AS y_{h}s" for h in horizons)
    return f"""WITH {EPOCHS_SQL},
s AS (SELECT source, timestamp, event_id, hdop::FLOAT AS a, fix_quality::FLOAT AS b, fix_quality % 3 AS y,
  row_number() OVER (PARTITION BY source ORDER BY timestamp) AS end_idx, count(*) OVER (PARTITION BY source) AS n FROM epochs),
w AS (SELECT *, {leads}, list(a) OVER f AS la, list(b) OVER f AS lb
  FROM s WINDOW f AS (PARTITION BY source ORDER BY timestamp ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW))
SELECT event_id, end_idx, {", ".join(f"y_{h}s" for h in horizons)}, 2 * len(la) AS n_values,
  {sql_rnd("la[1]", 4)} AS first_value, {sql_rnd(f"lb[{rows}]", 4)} AS last_value,
  {sql_rnd(f"list_sum(list_transform(range(1, {rows + 1}), lambda i: (2 * i - 1) * la[i]::DOUBLE + 2 * i * lb[i]::DOUBLE))", 3)} AS weighted_sum
FROM w WHERE end_idx >= {rows} AND end_idx + {far} <= n AND n > {rows + far}"""


def _window_query(rows: int, horizons: tuple[int, ...], stored: str | None = None):
    def run(spark, sf):
        ep = events_as_epochs(spark, sf).withColumn("label", F.col("fix_quality") % 3)
        w = prep.training_windows(
            ep, ["hdop", "fix_quality"], ["source"], rows=rows, horizons=horizons, keep=["event_id"],
            chunk_seconds=3 * DAY, block_rows=40,
        )
        if stored is not None:
            sinks.save_windows(w.withColumn("split", F.lit("train")), stored)
            w = sinks.load_windows(spark, stored, ["train"]).drop("split")
        flat = prep.flatten_windows(w)
        x = F.col("features")
        weighted = F.aggregate(
            F.transform(x, lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0), lambda s, v: s + v
        )
        return flat.select(
            "event_id", "end_idx", *[f"y_{h}s" for h in horizons], F.size(x).cast("long").alias("n_values"),
            rnd(F.get(x, F.lit(0)).cast("double"), 4).alias("first_value"),
            rnd(F.get(x, F.size(x) - 1).cast("double"), 4).alias("last_value"),
            rnd(weighted, 3).alias("weighted_sum"),
        )

    return run


# The reference setting leaves sessions of more than 60 rows; a short one covers all users.
query("training_windows", _windows_sql(30, (5, 15, 30)))(_window_query(30, (5, 15, 30)))
query("training_windows_short", _windows_sql(10, (1, 3, 6)))(_window_query(10, (1, 3, 6)))


# ---- classes ----------------------------------------------------------------------------------------------


@query(
    "encoded_labels",
    "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INT) AS label_code FROM orders",
)
def encoded_labels(spark, sf):
    return prep.encode_labels(table(spark, sf, "orders"), "o_orderpriority").select("o_orderkey", "label_code")


@query(
    "balanced_weights",
    f"""WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT vec_id, {sql_rnd("(SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n)")} AS weight FROM embeddings JOIN c USING (label)""",
)
def balanced_weights(spark, sf):
    out = prep.balanced_weights(table(spark, sf, "embeddings").select("vec_id", "label"), "label")
    return out.select("vec_id", rnd("weight").alias("weight"))
