"""Ordered operators, features and as-of joins against plain Python and pandas."""

import math
import statistics
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from sessions import COLUMNS, make_sessions, same, to_spark

from clearsky.operators.asof import merge_signal, nearest_asof_join
from clearsky.operators.evaluate import lead_times
from clearsky.operators.features import legacy_features, window_features
from clearsky.operators.ordered import (
    before_cut,
    cut_points,
    exact_quantiles,
    forward_fill,
    row_index,
    running_sums,
)
from clearsky.operators.prep import temporal_split, training_windows
from clearsky.operators.tables import first_rows, resample_first
from clearsky.schemas import FEATURES

KEYS = ["source", "scenario"]


def val(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else v


def known(rows, c):
    return [r[c] for r in rows if val(r[c]) is not None]


def brute_features(session: list[dict]) -> dict:
    """A few features of each kind, straight from their definitions."""
    out = {}
    for i, cur in enumerate(session):
        rows = [r for r in session[: i + 1] if r["timestamp"] >= cur["timestamp"] - timedelta(seconds=30)]
        if len(rows) < 2:
            continue
        cs, ns, ages, rms = (known(rows, c) for c in ("mean_cnr_epoch", "num_satellites", "solution_age", "rms_error"))
        fixes = [r["fix_quality"] for r in rows]
        span = max((rows[-1]["timestamp"] - rows[0]["timestamp"]).total_seconds(), 1.0)
        gbs = [math.hypot(val(r["gbs_lat_err"]) or 0.0, val(r["gbs_lon_err"]) or 0.0) for r in rows]
        estimate = {4: 48.0, 5: 35.0, 1: 40.0, 2: 42.0, 3: 38.0, 0: 20.0}.get(cur["fix_quality"], 30.0)
        sigma_rows = len(known(rows, "lat_sigma"))
        variances = [statistics.variance(known(rows, c)) if len(known(rows, c)) > 1 else None for c in ("lat_sigma", "lon_sigma")]
        pos_var = (None if None in variances else sum(variances)) if sigma_rows else (cur["hdop"] * 2.5) ** 2
        std = statistics.pstdev(cs) if cs else 0.0
        out[cur["timestamp"]] = {
            "mean_cnr": statistics.fmean(cs) if cs else estimate,
            "std_cnr": std,
            "cnr_trend": float(np.polyfit(range(len(cs)), cs, 1)[0]) if len(cs) >= 3 else 0.0,
            "sat_drop_rate": sum(min(b - a, 0) for a, b in zip(ns, ns[1:])) / span if len(ns) > 1 else 0.0,
            "fix_transitions": float(sum(a != b for a, b in zip(fixes, fixes[1:]))),
            "fix_continuity": sum(f >= 1 for f in fixes) / len(fixes),
            "clock_bias": sum(abs(b - a) for a, b in zip(ages, ages[1:])) / len(ages) if ages else None,
            "position_variance": pos_var,
            "residual_mean": statistics.fmean(rms) if rms else statistics.fmean(gbs) if known(rows, "gbs_lat_err") else cur["hdop"] * 2,
            "residual_std": (statistics.stdev(rms) if len(rms) > 1 else 0.0)
            if rms
            else statistics.stdev(gbs)
            if known(rows, "gbs_lat_err")
            else std * 0.1,
        }
    return out


@pytest.mark.parametrize("chunk", [35, 6 * 3600])
def test_window_features_equal_brute_force(spark, chunk):
    pdf = make_sessions(3)
    got = {
        (r["scenario"], r["timestamp"].replace(tzinfo=timezone.utc)): r
        for r in window_features(to_spark(spark, pdf), KEYS, chunk_seconds=chunk).collect()
    }
    total = 0
    for (_, scenario), g in pdf.groupby(KEYS):
        rows = g.sort_values("timestamp").to_dict("records")
        for at, feats in brute_features(rows).items():
            total += 1
            for name, want in feats.items():
                assert same(got[(scenario, at.to_pydatetime())][name], want, 1e-8), (scenario, at, name)
    assert total == len(got)


def test_no_cnr_fallback_leaves_null(spark):
    pdf = make_sessions(3)
    pdf.loc[pdf["scenario"] == "c4", "mean_cnr_epoch"] = np.nan
    out = window_features(to_spark(spark, pdf), KEYS, cnr_fallback=False)
    assert out.where("mean_cnr is null and std_cnr is null and multipath is null and scenario = 'c4'").count() == 59
    assert out.where("mean_cnr = 20.0 and std_cnr = 0").count() == 0


def test_tied_times_end_at_their_own_row(spark):
    t = datetime(2024, 1, 1, tzinfo=timezone.utc)
    pdf = make_sessions(5, (40,))
    pdf["timestamp"] = [t + timedelta(seconds=i // 4) for i in range(40)]
    pdf["mean_cnr_epoch"] = np.arange(40, dtype=float)
    df = to_spark(spark, pdf).withColumn("id", F.col("mean_cnr_epoch").cast("int"))
    got = {r["id"]: r["max_cnr"] for r in window_features(df, KEYS, tiebreak=["id"], keep=["id"]).collect()}
    assert got == {i: float(i) for i in range(1, 40)}


def test_tied_times_equal_brute_force(spark):
    pdf = make_sessions(9, (50, 120)).sort_values(["scenario", "timestamp"]).reset_index(drop=True)
    start = pdf["timestamp"].min()
    pdf["timestamp"] = [start + timedelta(seconds=i // 5 * 4) for i in range(len(pdf))]  # five rows share a time
    columns = [c for c in pdf.columns if c not in (*KEYS, "timestamp")]
    df = to_spark(spark, pdf).orderBy(F.rand(3))
    unique = F.xxhash64(*[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in columns])
    df = df.withColumn("id", unique)
    got = {(r["scenario"], r["timestamp"], r["id"]): r for r in window_features(df, KEYS, tiebreak=["id"], keep=["id"], chunk_seconds=50).collect()}
    total = 0
    for scenario, rows in pd.DataFrame([r.asDict() for r in df.collect()]).groupby("scenario"):
        rows = rows.sort_values(["timestamp", "id"]).to_dict("records")
        for i in range(len(rows)):
            # Its own row last: the brute force keys by time, so it is asked for one row at a time.
            feats = brute_features(rows[: i + 1]).get(rows[i]["timestamp"]) if i else None
            if feats:
                total += 1
                r = got[(scenario, rows[i]["timestamp"].to_pydatetime(), rows[i]["id"])]
                for name, want in feats.items():
                    assert same(r[name], want, 1e-7), (scenario, i, name, r[name], want)
    assert total == len(got)


def test_any_number_of_rows_may_share_a_time(spark):
    n = 1_000_000
    rows = spark.range(n).select(
        "id", F.lit("a").alias("source"), F.lit("b").alias("scenario"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("timestamp"),
        F.lit(4).alias("fix_quality"),
        *[F.when(F.col("id") >= 0, F.lit(1.0)).alias(c) for c in COLUMNS if c not in ("fix_quality", "mean_cnr_epoch")],
        F.col("id").cast("double").alias("mean_cnr_epoch"),
    )
    out = window_features(rows, KEYS, tiebreak=["id"], keep=["id"]).select("id", "mean_cnr", "max_cnr")
    r = out.agg(F.count(F.lit(1)), F.max(F.abs(F.col("mean_cnr") - F.col("id") / 2)), F.max(F.abs(F.col("max_cnr") - F.col("id")))).first()
    assert r[0] == n - 1 and r[1] < 1e-3 and r[2] == 0


def test_legacy_features(spark):
    rng = np.random.default_rng(2)
    rows = []
    for source, n in (("a", 29), ("b", 31), ("c", 95)):
        for i in range(n):
            rows.append((source, datetime(2024, 1, 1) + timedelta(seconds=i), 1.0, 2.0, 3.0, float(rng.integers(1, 6)), float(rng.integers(3, 12)), float(rng.random()), float(rng.random()), 0.5, float(rng.random())))
    df = spark.createDataFrame(rows, "source string, timestamp timestamp, latitude double, longitude double, altitude double, q double, ns double, sdn double, sde double, age double, ratio double")
    got = {(r["source"], r["timestamp"]): r for r in legacy_features(df, block_rows=37, chunk_seconds=20).collect()}
    assert len(got) == 1 + 65
    pdf = pd.DataFrame(rows, columns=df.columns)
    for source, g in pdf.groupby("source"):
        g = g.reset_index(drop=True)
        for i in range(30, len(g)):
            w, cur = g.iloc[i - 30 : i], g.iloc[i]
            r = got[(source, cur["timestamp"].to_pydatetime())]
            proxy = 50 - 5 * w["q"]
            assert same(r["std_cnr"], proxy.std()) and same(r["cnr_trend"], (proxy.iloc[-1] - proxy.iloc[0]) / 30)
            diff = w["ns"].diff().fillna(0)
            assert same(r["sat_drop_rate"], diff[diff < 0].sum() / 30)
            assert same(r["fix_transitions"], float((w["q"].diff().fillna(0) > 0).sum()))
            assert same(r["position_variance"], w["sdn"].var() + w["sde"].var())
            assert r["hdop"] == 2.0 and r["gdop"] == 3.0 and same(r["solution_status"], 1 - (min(cur["q"], 5) - 1) / 4)


@pytest.mark.parametrize("chunk", [3, 60])
def test_nearest_join_equals_merge_asof(spark, chunk):
    """Ties on both sides, equal distances, exact matches, borders of chunks, nulls."""
    rng = np.random.default_rng(1)
    t0 = pd.Timestamp("2024-01-01")
    left = pd.DataFrame({"k": rng.choice(["a", "b"], 240), "t": t0 + pd.to_timedelta(rng.integers(0, 400, 240) / 2, unit="s")})
    left["id"] = range(len(left))
    right = pd.DataFrame({"k": rng.choice(["a", "b"], 90), "rt": t0 + pd.to_timedelta(rng.integers(0, 400, 90) / 2, unit="s")})
    right["v"] = range(len(right))
    want = pd.merge_asof(
        left.sort_values(["t", "id"]), right.sort_values(["rt", "v"]), left_on="t", right_on="rt", by="k",
        tolerance=pd.Timedelta("2s"), direction="nearest",
    ).set_index("id")["v"]
    ls = spark.createDataFrame([(r.k, r.t.to_pydatetime(), int(r.id)) for r in left.itertuples()] + [("a", None, 999)], "k string, t timestamp, id int")
    rs = spark.createDataFrame([(r.k, r.rt.to_pydatetime(), int(r.v)) for r in right.itertuples()], "k string, rt timestamp, v int")
    out = nearest_asof_join(ls, rs, ["k"], "t", "rt", ["v"], 2, right_order=["v"], chunk_seconds=chunk)
    got = {r["id"]: r["v"] for r in out.collect()}
    assert got.pop(999) is None
    assert got == {i: None if pd.isna(v) else int(v) for i, v in want.items()}


def test_merge_signal_moves_gps_time(spark):
    fix = spark.createDataFrame([("s", datetime(2024, 1, 1, 0, 0, 10), [40.0, 50.0])], "source string, timestamp timestamp, cnr_list array<double>")
    obs = spark.createDataFrame([("s", datetime(2024, 1, 1, 0, 0, 29), [30.0, 32.0], 3)], "source string, timestamp timestamp, cnr_list array<double>, cycle_slips int")
    row = merge_signal(fix, obs, ["source"]).first()
    assert (row["mean_cnr_epoch"], row["cycle_slips_epoch"]) == (31.0, 3.0)
    own = merge_signal(fix, None, ["source"]).first()
    assert (own["mean_cnr_epoch"], own["cycle_slips_epoch"]) == (45.0, 0.0)


def test_running_sums_and_index_across_chunks(spark):
    rng = np.random.default_rng(0)
    rows = [(str(g), int(c), int(i), int(rng.integers(0, 9))) for i, (g, c) in enumerate(sorted((rng.integers(0, 3), rng.integers(0, 5)) for _ in range(200)))]
    df = spark.createDataFrame(rows, "g string, c long, i long, v long")
    got = {r["i"]: r["s"] for r in running_sums(df, ["g"], "c", ["i"], {"s": F.col("v")}).collect()}
    pdf = pd.DataFrame(rows, columns=df.columns).sort_values(["g", "c", "i"])
    want = dict(zip(pdf["i"], pdf.groupby("g")["v"].cumsum()))
    assert got == want


def test_forward_fill_reaches_over_empty_chunks(spark):
    t = datetime(2024, 1, 1)
    rows = [("a", t, 1.0), ("a", t + timedelta(hours=30), None), ("a", t + timedelta(hours=31), 2.0), ("a", t + timedelta(hours=99), None), ("b", t, None)]
    df = spark.createDataFrame(rows, "g string, t timestamp, v double")
    out = forward_fill(df, ["g"], "t", ["v"]).orderBy("g", "t").collect()
    assert [r["v"] for r in out] == [1.0, 1.0, 2.0, 2.0, None]


def test_quantiles_with_a_hot_value(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([np.full(500, 7.5), rng.normal(0, 5, 900).round(3)])
    rng.shuffle(values)
    groups = rng.choice(["x", "y"], len(values), p=[0.9, 0.1])
    df = spark.createDataFrame([(g, float(v)) for g, v in zip(groups, values)] + [("x", None)], "g string, v double")
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.93, "e": 1.0}
    for r in exact_quantiles(df, "v", probs, ["g"]).collect():
        mine = values[groups == r["g"]]
        for name, p in probs.items():
            assert same(r[name], float(np.quantile(mine, p)), 1e-9)
    r = exact_quantiles(df, "v", {"c": 0.5}).first()
    assert same(r["c"], float(np.median(values)))


def test_cut_points_with_ties(spark):
    rng = np.random.default_rng(5)
    rows = [(datetime(2024, 1, 1) + timedelta(days=int(d)), int(a), i) for i, (d, a) in enumerate(zip(np.minimum(rng.integers(0, 6, 300), 3), rng.integers(0, 4, 300)))]
    df = spark.createDataFrame(rows, "t timestamp, a int, i int")
    order = ["t", "a", "i"]
    want = sorted(rows)
    for p, key in zip((0, 17, 210, 299, 300), cut_points(df, order, [0, 17, 210, 299, 300])):
        assert df.where(before_cut(df, order, key)).count() == p if p < 300 else key is None
        if p < 300:
            assert key[1:] == want[p][1:]
    counts = {r["split"]: r["count"] for r in temporal_split(df, order).groupBy("split").count().collect()}
    assert counts == {"train": 210, "val": 45, "test": 45}


@pytest.mark.parametrize("block", [7, 20_000])
def test_training_windows_lengths(spark, block):
    pdf = make_sessions(9, (1, 30, 60, 61, 75))
    pdf["label"] = np.arange(len(pdf)) % 3
    df = to_spark(spark, pdf)
    labels = spark.createDataFrame(list(zip(pdf["scenario"], [t.to_pydatetime() for t in pdf["timestamp"]], [int(v) for v in pdf["label"]])), "scenario string, timestamp timestamp, label int")
    w = training_windows(df.join(labels, ["scenario", "timestamp"]), ["hdop", "cycle_slips_epoch"], KEYS, block_rows=block, chunk_seconds=25).collect()
    counts = pd.Series([r["scenario"] for r in w]).value_counts().to_dict()
    assert counts == {"c3": 2, "c4": 16}  # 60 rows or fewer give none
    for r in w:
        g = pdf[pdf["scenario"] == r["scenario"]].sort_values("timestamp").reset_index(drop=True)
        end = r["end_idx"]
        x = np.array(r["X"])
        assert x.shape == (30, 2)
        np.testing.assert_allclose(x[:, 0], g["hdop"][end - 30 : end].to_numpy(), rtol=1e-6)
        assert [r[f"y_{h}s"] for h in (5, 15, 30)] == [int(g["label"][end - 1 + h]) for h in (5, 15, 30)]


def test_first_rows_and_resample(spark):
    t = datetime(2024, 1, 1)
    rows = [("a", t + timedelta(milliseconds=200 * i), None if i % 5 == 0 else float(i), None if i // 5 == 1 else 1.0) for i in range(15)]
    df = spark.createDataFrame(rows, "g string, t timestamp, v double, lat double")
    out = resample_first(df, ["g"], "t", ["v", "lat"], required="lat").orderBy("t").collect()
    assert [(r["t"], r["v"]) for r in out] == [(t, 1.0), (t + timedelta(seconds=2), 11.0)]
    assert first_rows(df, ["g"], "t", 4).count() == 4
    assert row_index(df, ["g"], "t", chunk_seconds=1).agg(F.max("row_idx")).first()[0] == 15


def test_feature_list():
    assert len(FEATURES) == 35 and len(set(FEATURES)) == 35


def test_rows_stay_where_they_are_dealt(spark):
    """Numbering deals the rows once, into the tasks asked for; only the chunk table moves to them."""
    rows = [(f"s{i % 3}", datetime(2024, 1, 1) + timedelta(hours=i), i) for i in range(200)]
    df = spark.createDataFrame(rows, "s string, t timestamp, i int")
    numbered = row_index(df, ["s"], "t", ["t", "i"], 86400, "n", tasks=13)
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    assert "_chunk" in plan and ", 13), REPARTITION_BY_NUM" in plan
    seen = sorted((r["s"], r["i"], r["n"]) for r in numbered.collect())
    assert seen == sorted((f"s{i % 3}", i, i // 3 + 1) for i in range(200))


def test_lead_times_dealt_into_tasks(spark):
    rows = [(f"h{i % 2}", i // 2, (i // 2) % 23 // 11, (i * 7) % 3) for i in range(400)]
    df = spark.createDataFrame([(h, i, 2 * y, p) for h, i, y, p in rows], "h string, i long, y_true int, y_pred int")
    found = [sorted(map(tuple, lead_times(df, ["h"], "i", block_rows=30, tasks=t).collect())) for t in (None, 7)]
    assert found[0] and found[0] == found[1]
