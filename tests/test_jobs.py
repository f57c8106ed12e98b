"""Sinks, the jobs end to end, and the driver contract."""

import json
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from sessions import make_sessions, to_spark

from clearsky import sinks
from clearsky.operators.prep import apply_min_max, fit_min_max, scaler_table
from clearsky.plans import legacy, recordings, training
from clearsky.schemas import FEATURES
from clearsky.sources import nmea, rinex
from clearsky.sources.lines import read_lines

SF = "/root/testdata/sf0.001"


def write_recording(folder: Path, seconds: int, level: int) -> None:
    """A receiver folder: fixes at 1 Hz and an observation file 18 s ahead (GPS time)."""
    folder.mkdir(parents=True)
    start = datetime(2026, 5, 4, 10, 0, 0)
    fixes, obs = ["$GPRMC,100000.00,A,,,,,,,040526,,*00"], [
        f"{'G    2 C1C L1C':<60}SYS / # / OBS TYPES ",
        f"{'':<60}END OF HEADER       ",
    ]
    for i in range(seconds):
        at = start + timedelta(seconds=i)
        fixes.append(f"$GPGGA,{at:%H%M%S}.00,3021.5000,N,11958.2500,E,{1 + i % 2},{10 + level},0.8,32.5,M,7.0,M,,*6F")
        fixes.append("$GPGSA,A,3,,,,,,,,,,,,,1.5,0.8,1.2*30")
        gps = at + timedelta(seconds=18)
        obs.append(f"> {gps:%Y %m %d %H %M %S}.0000000  0  1")
        obs.append("G05" + f"{'20000000.125':>14} {level}" + f"{'100.5':>14} {level}")
    (folder / "log_0000.nmea").write_text("\n".join(fixes) + "\n")
    (folder / "SEPT1240.26O").write_text("\n".join(obs) + "\n")


METHODS = ["MajorityClass", "CNR_Threshold", "RandomForest", "BoostedTrees"]


@pytest.fixture(scope="module")
def features(spark, tmp_path_factory):
    """Twelve recordings read, matched, windowed, labelled and split."""
    root = tmp_path_factory.mktemp("raw")
    folders = []
    for i in range(12):
        name = f"run{i}"
        write_recording(root / name, 80, [3, 6, 8][i % 3])
        folders.append((name, f"scenario_{i}", f"case_{i}"))
    rules = spark.createDataFrame(folders, "folder string, source string, scenario string")
    fixes = recordings.tagged_by_folder(nmea.nmea_epochs(read_lines(spark, str(root), "*.nmea")), rules)
    signal = recordings.tagged_by_folder(rinex.observation_epochs(rinex.read_records(spark, str(root), "*.26O")), rules)
    made = recordings.receiver_features(fixes, signal)
    out = str(tmp_path_factory.mktemp("features"))
    sinks.write_table(recordings.combined([made]), out)
    return spark.read.parquet(out)


def test_recordings_to_labelled_table(features):
    assert features.columns == ["timestamp", "source", "scenario", *FEATURES, "label", "label_name", "split"]
    assert features.count() == 12 * 79
    by_level = {r["mean_cnr"]: r["names"] for r in features.groupBy("mean_cnr").agg(F.collect_set("label_name").alias("names")).collect()}
    assert by_level == {18.0: ["DEGRADED"], 36.0: ["CLEAN"], 48.0: ["CLEAN"]}
    assert features.groupBy("scenario").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    splits = {r["split"]: r["n"] for r in features.groupBy("split").agg(F.count_distinct("scenario").alias("n")).collect()}
    assert splits == {"train": 8, "validation": 2, "test": 2}


def test_windows_and_baselines(spark, features, tmp_path):
    # Labels that alternate within each session, so that all classes occur.
    i = F.unix_timestamp("timestamp")
    mixed = features.withColumn("label", F.when(i % 7 == 0, 2).when(i % 3 == 0, 1).otherwise(0))
    path, scaler = str(tmp_path / "windows"), str(tmp_path / "scaler")
    settings = dict(rows=10, horizons=(1, 3), chunk_seconds=600)
    w = training.window_job(mixed, path, scaler_path=scaler, **settings)
    counts = {r["split"]: r["count"] for r in w.groupBy("split").count().collect()}
    per_session = 79 - 10 - 3 + 1
    assert counts["val"] == counts["test"] == 2 * per_session and counts["train"] > 8 * per_session
    train = {r["y_1s"]: r["count"] for r in w.where("split = 'train'").groupBy("y_1s").count().collect()}
    assert len(set(train.values())) == 1 and len(train) == 3
    shape = w.select(F.size("X").alias("t"), F.size(F.get("X", F.lit(0))).alias("f")).distinct().collect()
    assert [tuple(r) for r in shape] == [(10, 34)]
    params, names = sinks.load_scaler(spark, scaler)
    assert names[-1] == "cnr_available" and len(names) == 34 and params.count() == 1
    # Stored windows are reused.
    before = sorted(p.name for p in Path(path).rglob("*.parquet"))
    training.window_job(mixed, path, **settings)
    assert before == sorted(p.name for p in Path(path).rglob("*.parquet"))
    at = names.index("mean_cnr")
    low, width = params.select("min_mean_cnr", "range_mean_cnr").first()
    predictions = training.baseline_predictions(
        w, (1, 3), forest={"trees": 5, "depth": 4}, boosting={"rounds": 3, "depth": 3}, signal=(at, low, width)
    )
    assert {n: df.count() for n, df in predictions.items()} == dict.fromkeys(METHODS, 2 * counts["test"])
    # The rule sees the C/N0 as it was measured: 18, 36 and 48 dB-Hz.
    rule = {r["y_pred"] for r in predictions["CNR_Threshold"].select("y_pred").distinct().collect()}
    assert rule <= {0, 1, 2} and rule
    report = training.evaluation_report(predictions, (1, 3))
    assert report["overall"].count() == 8 and report["per_class"].count() == 24 and report["confusion"].count() == 8 * 9
    assert report["by_source"].count() == 4 * 2 * 2 and report["degraded_recall"].count() == 4 * 2 * 2
    assert report["intervals"].count() == 8 and report["f1_by_horizon"].count() == 4 * 3
    assert {r["method"] for r in report["roc_auc"].collect()} == {"RandomForest", "BoostedTrees"}
    assert report["roc_auc"].count() == 2 * 2 * 3 and report["average_precision"].count() == 2 * 2 * 3
    assert report["calibration"].where("class is null").count() == 0 and report["lead_times"].count() >= 4
    assert report["roc"].where("fpr > 1 or tpr > 1").count() == 0 and report["pr"].count() > 0
    training.write_report({n: report[n] for n in ("confusion", "roc_auc")}, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "confusion")).count() == 72
    assert set(report["comparison"].columns) == {"method", "1s", "3s"}
    sinks.write_metrics(report["overall"], str(tmp_path / "metrics"))
    lines = [json.loads(x) for p in (tmp_path / "metrics").glob("*.json") for x in p.read_text().splitlines()]
    assert {x["method"] for x in lines} == set(METHODS) and all(0 <= x["accuracy"] <= 1 for x in lines)


def test_a_store_grows_exactly_once(spark, tmp_path):
    root, path = tmp_path / "in", str(tmp_path / "store")
    root.mkdir()
    calls = []

    def read(names):
        calls.append(len(names))
        rows = read_lines(spark, names).select("file_name", "line")
        if len(calls) == 1:  # half of a batch is written, and the job is lost
            rows.limit(1).write.parquet(f"{path}/rows/batch=0")
            raise RuntimeError("lost")
        return rows

    with pytest.raises(FileNotFoundError):
        sinks.ingest(spark, str(root), str(tmp_path / "none"), read, "*.txt")
    for name in ("a", "b"):
        (root / f"{name}.txt").write_text(f"{name}1\n{name}2\n")
    with pytest.raises(Exception, match="lost"):
        sinks.ingest(spark, str(root), path, read, "*.txt", parameters={"version": 1})
    grow = lambda: sorted(r["line"] for r in sinks.ingest(spark, str(root), path, read, "*.txt", parameters={"version": 1}).collect())
    assert grow() == ["a1", "a2", "b1", "b2"] == grow()
    (root / "c.txt").write_text("c1\n")
    (root / "c.log").write_text("no\n")
    assert grow() == ["a1", "a2", "b1", "b2", "c1"] and calls == [2, 2, 1]
    with pytest.raises(ValueError, match="other parameters"):
        sinks.ingest(spark, str(root), path, read, "*.txt", parameters={"version": 2})


def test_stores_know_their_parameters(spark, tmp_path):
    path, built = str(tmp_path / "w"), []

    def build(n, lost=False):
        def rows():
            built.append(n)
            made = spark.range(n).select("id", F.lit("train").alias("split"))
            return made.withColumn("x", F.raise_error(F.lit("lost"))) if lost else made

        return rows

    count = lambda n, **p: sinks.reuse_or_build(spark, path, build(n), parameters=p).count()
    assert count(3, t=30) == 3 and count(9, t=30) == 3 and count(5, t=10) == 5 and count(9, t=10) == 5 and built == [3, 5]
    assert sinks.reuse_or_build(spark, path, build(2), True, {"t": 10}).count() == 2
    with pytest.raises(Exception, match="lost"):
        sinks.reuse_or_build(spark, path, build(4, lost=True), parameters={"t": 1})
    assert count(6, t=10) == 6  # what an interrupted store left is not taken
    assert sinks.reuse_or_build(spark, str(tmp_path / "none"), lambda: build(1)().limit(0)).count() == 0
    assert sinks.reuse_or_build(spark, str(tmp_path / "none"), build(8)).count() == 0  # an empty store is a store


def test_reports_come_from_the_write(spark, tmp_path):
    rows = spark.range(100).select("id", F.when(F.col("id") < 3, 2).otherwise(F.col("id") % 2).cast("int").alias("label"), F.when(F.col("id") < 40, F.col("id") * 1.0).alias("err"))
    report = sinks.write_with_class_report(rows, str(tmp_path / "a"), columns=["id", "label"])
    assert [tuple(r) for r in report.orderBy("label").collect()] == [(0, 48, 48.0, False), (1, 49, 49.0, False), (2, 3, 3.0, True)]
    assert spark.read.parquet(str(tmp_path / "a")).count() == 100
    assert tuple(sinks.write_with_match_report(rows, str(tmp_path / "b"), "err", columns=["id", "err"]).first()) == (100, 40, 19.5)
    assert tuple(sinks.write_with_match_report(rows.limit(0), str(tmp_path / "c"), "err", columns=["id", "err"]).first()) == (0, 0, None)
    assert sinks.write_with_class_report(rows.limit(0), str(tmp_path / "d"), columns=["id", "label"]).count() == 0


def test_other_sources(spark):
    pdf = make_sessions(4, (60, 61)).drop(columns=["source", "scenario"])
    pdf["source"], pdf["scenario"] = "nclt", ["a"] * 60 + ["b"] * 61
    fixes = to_spark(spark, pdf).drop("pdop", "hdop", "vdop", "mean_cnr_epoch", "rms_error", "gbs_lat_err", "gbs_lon_err")
    campus = recordings.campus_features(fixes)
    r = campus.first()
    assert (r["hdop"], r["pdop"], r["vdop"]) == (1.5, 2.5, 1.5) and r["label"] in (0, 1, 2)
    assert recordings.vehicle_features(fixes).where("label_name is null").count() == 0
    obs = spark.createDataFrame([("s", "c", datetime(2024, 1, 1, 0, 0, i), [40.0, 0.0], 1) for i in range(20, 25)], "source string, scenario string, timestamp timestamp, cnr_list array<double>, cycle_slips int")
    only = recordings.observation_features(obs, "drone").orderBy("timestamp").collect()
    assert len(only) == 4 and only[0]["timestamp"].second == 3 and only[0]["num_satellites"] == 1.0 and only[0]["pdop"] == 2.0


def test_legacy_job(spark):
    rng = np.random.default_rng(3)
    rows = [("scenario_a", datetime(2024, 1, 1) + timedelta(seconds=i), 1.0, 2.0, 3.0, 1.0 + 4.0 * (i > 150), float(rng.integers(5, 12)), 0.1, 0.2, 0.0, 3.0) for i in range(230)]
    fixes = spark.createDataFrame(rows, "source string, timestamp timestamp, latitude double, longitude double, altitude double, q double, ns double, sdn double, sde double, age double, ratio double")
    labelled = legacy.labelled_solutions(fixes)
    assert labelled.count() == 200
    scaled, params = legacy.scaled_splits(labelled, ["timestamp"])
    assert params.count() == 1
    assert {r["split"]: r["count"] for r in scaled.groupBy("split").count().collect()} == {"train": 140, "val": 30, "test": 30}
    mean = scaled.where("split = 'train'").agg(F.avg("sat_mean")).first()[0]
    assert abs(mean) < 1e-9
    assert legacy.balanced_training_rows(scaled).count() >= 140


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "train", 1.0, 2.0), ("b", "test", 3.0, 4.0)], "scenario string, split string, y double, x double")
    sinks.write_table(df, str(tmp_path / "csv"), ["x", "y", "absent"], "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["x", "y"]
    sinks.write_scenarios(df, str(tmp_path / "by"))
    assert {p.name for p in (tmp_path / "by").iterdir() if p.is_dir()} == {"scenario=a", "scenario=b"}
    sinks.write_splits(df, str(tmp_path / "splits"))
    with pytest.raises(FileNotFoundError, match="val"):
        sinks.load_windows(spark, str(tmp_path / "splits"))
    params = fit_min_max(df, ["x", "y"])
    sinks.save_scaler(scaler_table(params, ["x", "y"], ("min", "range")), str(tmp_path / "scaler"))
    loaded, names = sinks.load_scaler(spark, str(tmp_path / "scaler"))
    assert names == ["x", "y"] and apply_min_max(df, loaded, names).collect() == apply_min_max(df, params, names).collect()


def test_driver_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 120


def test_flagship_matches_its_sql(spark):
    import duckdb

    import __spark_entry__ as entry
    import check

    con = check.connect(SF)
    for name in ("labelled_classes", "nearest_asof_join_with_ties", "training_windows_short"):
        assert check.compare(spark, con, name, SF).startswith("ok"), name
    assert isinstance(con, duckdb.DuckDBPyConnection) and "labelled_classes" in entry.oracle_sql()


def test_observations_are_dealt_by_their_number(spark, tmp_path):
    """A task's share stays the same however few shuffle partitions the session has."""
    from clearsky.catalog import reports

    li = spark.range(400_000).selectExpr(
        "id AS l_orderkey", "id % 7 AS l_partkey", "id % 3 AS l_suppkey", "cast(id % 7 AS int) AS l_linenumber", "1.0D AS l_quantity",
        "1.0D AS l_extendedprice", "'A' AS l_returnflag", "timestamp_seconds(id % 1000) AS l_shipdate",
    )
    li.write.parquet(str(tmp_path / "lineitem.parquet"))
    assert reports.dealt_observations(spark, str(tmp_path)).rdd.getNumPartitions() == 3
    row = reports.run_comparison(spark, str(tmp_path)).where("run = 0").first()
    assert row["total_epochs"] == 1000 and row["mean_cnr"] == 1.0
