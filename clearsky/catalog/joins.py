"""As-of joins, lookups, tags, set operations and row selection on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearsky.catalog.base import CHUNK, DAY, EPOCHS_SQL, events_as_epochs, query, rnd, sql_rnd, table
from clearsky.functions.scalars import code_map
from clearsky.operators.asof import merge_signal, nearest_asof_join, own_signal
from clearsky.operators.reports import match_report
from clearsky.operators.tables import (
    clip,
    drop_incomplete,
    feature_columns,
    first_per_class,
    first_rows,
    first_source,
    lookup,
    missing_values,
    observation_only_epochs,
    repaired_splits,
    resample_first,
    tag,
    union_sources,
    with_group,
)
from clearsky.schemas import CLIP_BOUNDS, FIX_TO_CNR, FIX_TO_CNR_OTHER, FIX_TO_SCORE, FIX_TO_SCORE_OTHER, SOURCE_GROUPS
from clearsky.sources.trajectory import campus_epochs


def _nearest_sql(left: str, right: str, on: str, l_us: str, r_us: str, tol_us: int, order: str, pick: str, keys: str) -> str:
    """Nearest partner by ranking all partners within the tolerance."""
    return f"""
SELECT {keys}, {pick} FROM (
  SELECT l.*, r.*, row_number() OVER (PARTITION BY {keys} ORDER BY
      abs({r_us} - {l_us}) NULLS LAST, CASE WHEN {r_us} <= {l_us} THEN 0 ELSE 1 END, {order}) AS rk
  FROM {left} l LEFT JOIN {right} r ON {on} AND abs({r_us} - {l_us}) <= {tol_us})
WHERE rk = 1"""


_TIES = """
WITH l AS (SELECT l_suppkey AS k, epoch_us(l_shipdate) AS us, l_orderkey AS a, l_linenumber AS b, l_partkey AS c,
    l_extendedprice AS d FROM lineitem WHERE l_linestatus = 'F'),
r AS (SELECT *, row_number() OVER (PARTITION BY k, r_us ORDER BY r_a, r_b, r_c, r_d) AS up,
    row_number() OVER (PARTITION BY k, r_us ORDER BY r_a DESC, r_b DESC, r_c DESC, r_d DESC) AS down
  FROM (SELECT l_suppkey AS k, epoch_us(l_shipdate) AS r_us, l_orderkey AS r_a, l_linenumber AS r_b,
    l_partkey AS r_c, l_extendedprice AS r_d FROM lineitem WHERE l_linestatus = 'O'))
SELECT a, b, c, d, r_a AS match_order, CAST(r_us - us AS BIGINT) AS gap_us FROM (
  SELECT l.*, r.r_a, r.r_us, row_number() OVER (PARTITION BY l.k, a, b, c, d ORDER BY abs(r.r_us - l.us) NULLS LAST,
      CASE WHEN r.r_us <= l.us THEN 0 ELSE 1 END) AS rk
  FROM l LEFT JOIN r ON l.k = r.k AND abs(r.r_us - l.us) <= 259200000000
    AND ((r.r_us <= l.us AND r.down = 1) OR (r.r_us > l.us AND r.up = 1)))
WHERE rk = 1"""


@query("nearest_asof_join_with_ties", _TIES)
def nearest_asof_join_with_ties(spark, sf):
    """Order lines of one status to the nearest in time of the other; times repeat on both sides."""
    li = table(spark, sf, "lineitem").withColumn("t", F.col("l_shipdate").cast("timestamp"))
    left = li.where("l_linestatus = 'F'").select(
        F.col("l_suppkey").alias("k"), "t", F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"),
        F.col("l_partkey").alias("c"), F.col("l_extendedprice").alias("d"),
    )
    right = li.where("l_linestatus = 'O'").select(
        F.col("l_suppkey").alias("k"), F.col("t").alias("rt"), F.col("l_orderkey").alias("match_order"),
        "l_linenumber", "l_partkey", "l_extendedprice",
    )
    out = nearest_asof_join(
        left, right, ["k"], "t", "rt", ["match_order", "rt"], 3 * DAY,
        right_order=["match_order", "l_linenumber", "l_partkey", "l_extendedprice"], chunk_seconds=180 * DAY,
    )
    gap = F.unix_micros("rt") - F.unix_micros("t")
    return out.select("a", "b", "c", "d", "match_order", gap.alias("gap_us"))


_SIGNAL = f"""
WITH {EPOCHS_SQL},
l AS (SELECT event_id, source, epoch_us(timestamp) AS us FROM epochs WHERE scenario <> 'purchase'),
r AS (SELECT source AS rs, epoch_us(timestamp) - 18000000 AS r_us, (hdop + pdop_) / 2 AS m, cycle_slips_epoch AS slips
  FROM (SELECT *, coalesce(pdop, 1.0) AS pdop_ FROM epochs WHERE scenario = 'purchase'))
"""


@query(
    "merge_signal",
    _SIGNAL
    + _nearest_sql("l", "r", "l.source = r.rs", "us", "r_us", 2 * DAY * 1_000_000, "r_us",
                   f"{sql_rnd('m')} AS mean_cnr_epoch, slips AS cycle_slips_epoch", "event_id"),
)
def merge_fixes_and_signal(spark, sf):
    """Fixes and observations of one session, the latter 18 s ahead (GPS time)."""
    ep = events_as_epochs(spark, sf)
    fixes = ep.where("scenario <> 'purchase'").select("event_id", "source", "timestamp")
    signal = ep.where("scenario = 'purchase'").select(
        "source",
        F.col("timestamp").alias("gps_time"),
        F.array("hdop", F.coalesce("pdop", F.lit(1.0))).alias("cnr_list"),
        F.col("cycle_slips_epoch").alias("cycle_slips"),
    )
    out = merge_signal(
        fixes, signal, ["source"], signal_ts="gps_time", tolerance_seconds=2 * DAY, chunk_seconds=CHUNK
    )
    return out.select("event_id", rnd("mean_cnr_epoch").alias("mean_cnr_epoch"), "cycle_slips_epoch")


@query(
    "own_signal",
    f"""WITH {EPOCHS_SQL}
SELECT event_id, CASE WHEN pdop IS NOT NULL THEN {sql_rnd("(hdop + pdop) / 2")} END AS mean_cnr_epoch,
  0.0 AS cycle_slips_epoch FROM epochs""",
)
def own_signal_only(spark, sf):
    ep = events_as_epochs(spark, sf)
    lists = ep.withColumn("cnr_list", F.when(F.col("pdop").isNotNull(), F.array("hdop", "pdop")).otherwise(F.array().cast("array<double>")))
    return own_signal(lists).select("event_id", rnd("mean_cnr_epoch").alias("mean_cnr_epoch"), "cycle_slips_epoch")


_CAMPUS = f"""
WITH {EPOCHS_SQL},
l AS (SELECT event_id, source, epoch_us(timestamp) AS us FROM epochs WHERE scenario <> 'error'),
r AS (SELECT source AS rs, epoch_us(timestamp) AS r_us, hdop AS err FROM epochs WHERE scenario = 'error'),
m AS ({_nearest_sql("l", "r", "l.source = r.rs", "us", "r_us", DAY * 500_000, "r_us", "err", "event_id, source")})
"""


def _campus(spark, sf):
    ep = events_as_epochs(spark, sf)
    fixes = ep.where("scenario <> 'error'").select("event_id", "source", "timestamp")
    errors = ep.where("scenario = 'error'").select(
        "source", F.col("timestamp").alias("error_time"), F.col("hdop").alias("err_m")
    )
    return campus_epochs(fixes, errors, ["source"], tolerance_seconds=DAY / 2, chunk_seconds=CHUNK)


@query("position_error_split", _CAMPUS + f"SELECT event_id, {sql_rnd('err / sqrt(2)')} AS lat_sigma, {sql_rnd('err / sqrt(2)')} AS lon_sigma FROM m")
def position_error_split(spark, sf):
    return _campus(spark, sf).select("event_id", rnd("lat_sigma").alias("lat_sigma"), rnd("lon_sigma").alias("lon_sigma"))


@query(
    "asof_match_report",
    _CAMPUS
    + f"SELECT source, count(err) AS matched, {sql_rnd('avg(err)')} AS mean_error, "
    + f"{sql_rnd('quantile_cont(err, 0.9)')} AS p90_error FROM m GROUP BY source",
)
def asof_match_report(spark, sf):
    out = match_report(_campus(spark, sf), "err_m", ["source"])
    return out.select("source", "matched", rnd("mean_error").alias("mean_error"), rnd("p90_error").alias("p90_error"))


@query(
    "split_lookup_with_default",
    "SELECT d.doc_id, coalesce(l.quality, 9) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def split_lookup_with_default(spark, sf):
    return lookup(
        table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), ["doc_id"], "quality", 9
    )


# ---- projections and filters ----------------------------------------------------------------------


def _spread_over(low: float, high: float, i: int) -> str:
    """From half the width below the bounds to half above; every seventh value is missing."""
    width = high - low
    return f"CASE WHEN event_id % 7 <> {i % 7} THEN {low - width / 2} + value * {width / 50} END"


@query(
    "clip_to_bounds",
    "SELECT event_id, "
    + ", ".join(
        f"CASE WHEN {x} IS NOT NULL THEN {sql_rnd(f'greatest(least({x}, {high}), {low})')} END AS {c}"
        for i, (c, (low, high)) in enumerate(CLIP_BOUNDS.items())
        for x in [_spread_over(low, high, i)]
    )
    + " FROM events",
)
def clip_to_bounds(spark, sf):
    """All columns that have bounds, with values on both sides of them."""
    made = [F.expr(_spread_over(low, high, i)).cast("double").alias(c) for i, (c, (low, high)) in enumerate(CLIP_BOUNDS.items())]
    out = clip(table(spark, sf, "events").select("event_id", *made))
    return out.select("event_id", *[rnd(c).alias(c) for c in out.columns if c != "event_id"])


@query(
    "code_values",
    f"""WITH {EPOCHS_SQL}
SELECT event_id,
  CASE fix_quality WHEN 4 THEN 48.0 WHEN 5 THEN 35.0 WHEN 1 THEN 40.0 WHEN 2 THEN 42.0 WHEN 3 THEN 38.0
    WHEN 0 THEN 20.0 ELSE 30.0 END AS cnr_estimate,
  CASE fix_quality WHEN 4 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.85 WHEN 3 THEN 0.7 WHEN 5 THEN 0.5
    WHEN 6 THEN 0.4 WHEN 0 THEN 0.0 ELSE 0.3 END AS status FROM epochs""",
)
def code_values(spark, sf):
    fix = F.col("fix_quality")
    return events_as_epochs(spark, sf).select(
        "event_id",
        code_map(fix, FIX_TO_CNR, FIX_TO_CNR_OTHER).alias("cnr_estimate"),
        code_map(fix, FIX_TO_SCORE, FIX_TO_SCORE_OTHER).alias("status"),
    )


@query(
    "complete_rows",
    f"WITH {EPOCHS_SQL} SELECT event_id, 'campus' AS site, 5 AS quality FROM epochs WHERE alt IS NOT NULL AND pdop IS NOT NULL",
)
def complete_rows(spark, sf):
    kept = drop_incomplete(events_as_epochs(spark, sf), ["alt", "pdop"])
    return tag(kept, site="campus", quality=5).select("event_id", "site", "quality")


@query(
    "repaired_split_names",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'train' WHEN o_orderstatus = 'O' THEN 'val'
  ELSE 'test' END AS split FROM orders""",
)
def repaired_split_names(spark, sf):
    status = F.col("o_orderstatus")
    split = F.when(status == "F", "train").when(status == "O", "validation").otherwise("test")
    rows = table(spark, sf, "orders").select(
        "o_orderkey", split.alias("split"), F.lit(0).alias("label"), F.col("o_orderpriority").alias("source")
    )
    return repaired_splits(rows).select("o_orderkey", "split")


@query(
    "feature_column_order",
    f"""WITH {EPOCHS_SQL}, c AS (SELECT count(alt) AS a, count(fix_quality) AS f, count(hdop) AS h, count(pdop) AS p,
  count(vdop) AS v, count(mean_cnr_epoch) AS m FROM epochs)
SELECT unnest([0, 1, 2, 3, 4, 5]) AS position,
  unnest(['alt', 'fix_quality', 'hdop', 'pdop', 'vdop', 'cnr_available']) AS name, unnest([a, f, h, p, v, m]) AS known FROM c""",
)
def feature_column_order(spark, sf):
    """Model inputs in their fixed order, with how many rows know each."""
    df = events_as_epochs(spark, sf).select(
        "timestamp", "source", "lat", "vdop", "alt", F.col("mean_cnr_epoch").alias("cnr_available"),
        "hdop", "pdop", "fix_quality",
    )
    names = feature_columns(df)
    known = df.agg(*[F.count(c).alias(c) for c in names])
    rows = F.array(
        *[F.struct(F.lit(i).alias("position"), F.lit(c).alias("name"), F.col(c).alias("known")) for i, c in enumerate(names)]
    )
    return known.select(F.explode(rows).alias("r")).select("r.*")


@query(
    "first_rows_per_source",
    f"""WITH {EPOCHS_SQL}
SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY source ORDER BY timestamp, event_id) AS r FROM epochs)
WHERE r <= 20""",
)
def first_rows_per_source(spark, sf):
    ep = events_as_epochs(spark, sf)
    return first_rows(ep, ["source"], "timestamp", 20, ["timestamp", "event_id"], chunk_seconds=CHUNK).select("event_id")


@query(
    "observation_only_epochs",
    f"""WITH {EPOCHS_SQL}
SELECT event_id, epoch_us(timestamp) - 18000000 AS utc_us,
  {sql_rnd("(hdop + (value - 50)) / 2")} AS mean_cnr_epoch, cycle_slips_epoch, 1 AS fix_quality,
  CAST((CASE WHEN hdop > 0 THEN 1 ELSE 0 END) + (CASE WHEN value - 50 > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS num_satellites,
  3.5 AS pdop, 2.5 AS hdop, 2.0 AS vdop
FROM (SELECT e.*, v.value FROM epochs e JOIN events v USING (event_id))""",
)
def observation_only(spark, sf):
    ep = events_as_epochs(spark, sf)
    signal = ep.select(
        "event_id", "timestamp", F.array("hdop", F.col("hdop") * 20 - 50).alias("cnr_list"),
        F.col("cycle_slips_epoch").alias("cycle_slips"),
    )
    out = observation_only_epochs(signal, "city")
    return out.select(
        "event_id", F.unix_micros("timestamp").alias("utc_us"), rnd("mean_cnr_epoch").alias("mean_cnr_epoch"),
        "cycle_slips_epoch", "fix_quality", "num_satellites", "pdop", "hdop", "vdop",
    )


@query(
    "resample_first_value",
    f"""WITH {EPOCHS_SQL}
SELECT source, epoch_us(date_trunc('day', timestamp)) AS day_us,
  {", ".join(sql_rnd(f"arg_min({c}, timestamp) FILTER ({c} IS NOT NULL)") + f" AS {c}" for c in ("alt", "pdop", "lat_sigma"))}
FROM epochs GROUP BY source, date_trunc('day', timestamp) HAVING count(alt) > 0""",
)
def resample_first_value(spark, sf):
    """One row per session and day: the first known value of each column."""
    cols = ["alt", "pdop", "lat_sigma"]
    out = resample_first(events_as_epochs(spark, sf), ["source"], "timestamp", cols, "alt", seconds=DAY)
    return out.select("source", F.unix_micros("timestamp").alias("day_us"), *[rnd(c).alias(c) for c in cols])


@query(
    "first_source_of_session",
    f"WITH {EPOCHS_SQL} SELECT scenario, arg_min(source, timestamp) AS source FROM epochs GROUP BY scenario",
)
def first_source_of_session(spark, sf):
    return first_source(events_as_epochs(spark, sf))


# ---- sorts, set operations, groups -----------------------------------------------------------------


@query(
    "union_of_sources",
    """SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier
UNION ALL SELECT 'part', p_partkey, NULL, NULL FROM part""",
)
def union_of_sources(spark, sf):
    c = table(spark, sf, "customer").select(
        F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    s = table(spark, sf, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id")
    )
    p = table(spark, sf, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"))
    return union_sources([c, s, p])


@query(
    "missing_keys",
    "SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
)
def missing_keys(spark, sf):
    """Expected minus found: customers without a pending order."""
    expected = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    found = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key"))
    return missing_values(expected, found, "key")


@query(
    "sorted_by_time",
    "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS place FROM events",
)
def sorted_by_time(spark, sf):
    """Global position in time, from counts per stretch of time rather than one big sort."""
    from clearsky.operators.ordered import running_sums, time_chunk

    ep = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    chunked = ep.withColumn("_chunk", time_chunk("ts", DAY))
    return running_sums(chunked, [], "_chunk", ["ts", "event_id"], {"place": F.lit(1).cast("long")}).select(
        "event_id", "place"
    )


@query(
    "top_scores",
    "SELECT l_partkey, CAST(sum(l_quantity) AS DOUBLE) AS score FROM lineitem GROUP BY 1 ORDER BY score DESC, l_partkey LIMIT 15",
)
def top_scores(spark, sf):
    """The 15 highest scores (a report)."""
    scores = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("score"))
    return scores.orderBy(F.desc("score"), "l_partkey").limit(15)


@query(
    "first_samples_per_class",
    """SELECT label, vec_id, r AS rank FROM (SELECT label, vec_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS INT) AS r
FROM embeddings) WHERE r <= 3""",
)
def first_samples_per_class(spark, sf):
    return first_per_class(table(spark, sf, "embeddings").select("label", "vec_id"), "label", ["vec_id"], 3)


@query("distinct_scenarios", "SELECT DISTINCT source, lang FROM documents")
def distinct_scenarios(spark, sf):
    return table(spark, sf, "documents").select("source", "lang").distinct()


_NAMED = """
named AS (SELECT event_id, user_id, (['scenario_a','Supervisor','drone_x','urbannav_tunnel_k','urbannav_hk','tokyo_o',
  'nclt_12','oxford_14','elsewhere'])[CAST(user_id % 9 AS INT) + 1] AS source FROM events)"""


def named_sources(spark, sf):
    names = ["scenario_a", "Supervisor", "drone_x", "urbannav_tunnel_k", "urbannav_hk", "tokyo_o", "nclt_12", "oxford_14", "elsewhere"]
    source = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("user_id") % 9 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", "user_id", source.alias("source"))


@query(
    "source_groups",
    f"""WITH {_NAMED}
SELECT event_id, CASE WHEN source LIKE '%scenario%' THEN 'scenarios' WHEN source LIKE '%supervisor%' THEN 'supervisor'
  WHEN source LIKE '%drone%' THEN 'drone' WHEN source LIKE '%urbannav_tunnel%' THEN 'urbannav_tunnel'
  WHEN source LIKE '%urbannav%' THEN 'urbannav_medium' WHEN source LIKE '%tokyo%' THEN 'tokyo'
  WHEN source LIKE '%nclt%' THEN 'nclt' WHEN source LIKE '%oxford%' THEN 'oxford' ELSE 'other' END AS "group" FROM named""",
)
def source_groups(spark, sf):
    return with_group(named_sources(spark, sf), "source", SOURCE_GROUPS, "other").select("event_id", "group")
