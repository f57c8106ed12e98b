import math
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from sessions import COLUMNS, make_sessions, same, to_spark

from clearsky.operators.features import window_features
from clearsky.schemas import FEATURES
from clearsky.streaming import live, trailing
from clearsky.streaming.trailing import FIELDS, Trail

KEYS = ["source", "scenario"]


@pytest.fixture(scope="module")
def stream(spark, tmp_path_factory):
    """Epochs in three files that arrive one after the other."""
    folder = str(tmp_path_factory.mktemp("epochs"))
    pdf = make_sessions(11, (2, 30, 61, 120)).sort_values("timestamp").reset_index(drop=True)
    third = len(pdf) // 3
    for part in (pdf[:third], pdf[third : 2 * third], pdf[2 * third :]):
        to_spark(spark, part.reset_index(drop=True)).coalesce(1).write.mode("append").parquet(folder)
    return folder, pdf


def run(spark, df, tmp_path, mode="append"):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    query = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", check).option("path", out).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.read.schema(df.schema).parquet(out)


def source(spark, folder):
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_trailing_features_equal_batch(spark, stream, tmp_path):
    folder, pdf = stream
    live_rows = run(spark, live.trailing_features(source(spark, folder), KEYS, "timestamp", lateness="1 hour"), tmp_path)
    batch = window_features(spark.read.parquet(folder), KEYS)
    got = {(r["source"], r["scenario"], r["timestamp"]): r for r in live_rows.collect()}
    want = {(r["source"], r["scenario"], r["timestamp"]): r for r in batch.collect()}
    assert got.keys() == want.keys() and len(want) > 150
    for k, row in want.items():
        for f in FEATURES:
            assert same(row[f], got[k][f], 1e-7), (k, f, row[f], got[k][f])


def test_late_epochs_find_their_whole_window(spark, tmp_path):
    folder = str(tmp_path / "in")
    t0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
    fields = ", ".join(f"{c} {'int' if c == 'fix_quality' else 'double'}" for c in [*live.HISTORY, *live.CURRENT])
    schema = f"source string, scenario string, timestamp timestamp, {fields}"
    # Every ten seconds; 75 comes after 100, within the lateness, and 4 far too late.
    arrivals = [*range(0, 101, 10), 75, 110, 4]
    for s in arrivals:
        cells = [4 if c == "fix_quality" else float(s + 1) for c in [*live.HISTORY, *live.CURRENT]]
        row = ("a", "x", t0 + timedelta(seconds=s), *cells)
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = live.trailing_features(source(spark, folder), KEYS, "timestamp", 30, "60 seconds")
    found = {int((r["timestamp"].replace(tzinfo=timezone.utc) - t0).total_seconds()): r["mean_cnr"] for r in run(spark, stream, tmp_path).collect()}
    seen = []
    want = {}
    for s in arrivals[:-1]:
        seen.append(s)
        window = [x + 1 for x in seen if s - 30 <= x <= s]
        if len(window) > 1:
            want[s] = sum(window) / len(window)
    assert found.keys() == want.keys() and 75 in found and 4 not in found
    assert all(abs(found[s] - want[s]) < 1e-9 for s in want)


def test_duplicates_are_dropped(spark, stream, tmp_path):
    folder, pdf = stream
    doubled = source(spark, folder).select(*KEYS, "timestamp", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    out = run(spark, live.without_duplicates(doubled, KEYS, "timestamp", "1 hour"), tmp_path)
    assert out.count() == len(pdf)


def test_buckets_and_sessions(spark, tmp_path):
    folder = str(tmp_path / "in")
    t0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
    # Two recordings with a pause, then a far later row that moves the watermark past both.
    seconds = [0, 1, 2, 29, 30, 300, 301, 5000]
    rows = [("a", "x", t0 + timedelta(seconds=s), float(s), 5.0) for s in seconds]
    schema = "source string, scenario string, timestamp timestamp, mean_cnr_epoch double, num_satellites double"
    for r in rows:
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(folder)
    late = spark.createDataFrame([("a", "x", t0 + timedelta(seconds=3), 99.0, 5.0)], schema)
    late.coalesce(1).write.mode("append").parquet(folder)  # arrives last: too late

    tumbling = run(spark, live.bucket_features(source(spark, folder), KEYS, "timestamp", "30 seconds", None), tmp_path / "t")
    got = {r["start"].replace(tzinfo=timezone.utc): (r["epochs"], r["max_cnr"]) for r in tumbling.collect()}
    assert got[t0] == (4, 29.0) and got[t0 + timedelta(seconds=30)] == (1, 30.0) and got[t0 + timedelta(seconds=300)] == (2, 301.0)
    sliding = run(spark, live.bucket_features(source(spark, folder), KEYS, "timestamp", "30 seconds", "10 seconds"), tmp_path / "s")
    assert sliding.where("epochs = 4").count() == 1
    recordings = run(spark, live.recording_sessions(source(spark, folder), KEYS, "timestamp"), tmp_path / "r")
    assert sorted(r["epochs"] for r in recordings.collect()) == [2, 5]


LABELLED = "source string, timestamp timestamp, label int"


def arrive(spark, folder, rows):
    """Each list of rows is a file of its own, in order."""
    t0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
    for part in rows:
        data = [(key, t0 + timedelta(seconds=s), label) for key, s, label in part]
        spark.createDataFrame(data, LABELLED).coalesce(1).write.mode("append").parquet(folder)


def alerts(spark, folder, tmp_path, lateness="20 seconds", idle="1 hour"):
    labelled = source(spark, folder).withWatermark("timestamp", lateness)
    out = run(spark, live.class_changes(labelled, ["source"], "timestamp", idle), tmp_path)
    t0 = datetime(2024, 1, 1)
    return [(r["source"], int((r["timestamp"].replace(tzinfo=None) - t0).total_seconds()), r["label_before"], r["label"], r["alert"])
            for r in out.orderBy("source", "timestamp").collect()]


def test_class_changes_in_order_of_time(spark, tmp_path):
    folder = str(tmp_path / "in")
    # 3 arrives after 4 and 5, within the lateness; 1 after the watermark; the last row moves it past all.
    arrive(spark, folder, [[("a", 0, 0), ("a", 2, 0)], [("a", 4, 2), ("a", 5, 2)], [("a", 3, 1)], [("b", 100, 0)], [("b", 101, 0)], [("a", 1, 2)], [("b", 9000, 1)], [("c", 90000, 0)]])
    got = alerts(spark, folder, tmp_path, idle="10 days")
    assert got == [("a", 3, 0, 1, "WARNING"), ("a", 4, 1, 2, "DEGRADED"), ("b", 9000, 0, 1, "WARNING")]


def test_an_idle_session_starts_anew(spark, tmp_path):
    folder = str(tmp_path / "in")
    arrive(spark, folder, [[("a", 0, 0)], [("b", 50, 0)], [("b", 9000, 1)], [("a", 9001, 2), ("a", 9002, 0)], [("c", 90000, 0)]])
    got = alerts(spark, folder, tmp_path, idle="1 minute")
    assert got == [("a", 9002, 2, 0, "CLEAN")]  # 0 to 2 lies across the pause, and so does b's change


def test_chained_features_and_alerts(spark, tmp_path, stream):
    folder, pdf = stream
    flushed = str(tmp_path / "flushed")
    spark.read.parquet(folder).orderBy("timestamp").coalesce(1).write.option("maxRecordsPerFile", 70).parquet(flushed)
    end = pdf.tail(1).assign(source="~", timestamp=pdf["timestamp"].max() + timedelta(days=9)).reset_index(drop=True)
    to_spark(spark, end).coalesce(1).write.mode("append").parquet(flushed)  # moves the watermark past all others
    labels = live.live_labels(live.trailing_features(source(spark, flushed), KEYS, "timestamp", lateness="1 hour"))
    got = run(spark, live.class_changes(labels, KEYS, "timestamp", "9 days"), tmp_path)
    batch = live.live_labels(window_features(spark.read.parquet(folder), KEYS))
    before = F.lag("label").over(Window.partitionBy(*KEYS).orderBy("timestamp"))
    want = batch.withColumn("label_before", before).where("label_before <> label")
    columns = [*KEYS, "timestamp", "label_before", "label"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert want.count() > 3


def plain_window(rows, end, window_us):
    """What a summary tells, from the rows themselves: ``rows`` are in the order of their times."""
    us = rows[end][0]
    inside = [r for r in rows[: end + 1] if r[0] >= us - window_us]
    return inside


def check_summaries(rng, rows, window_us, held_us, parts):
    """Feed parts to a trail, as a session's state would, and compare each window."""
    summaries, newest, kept, stored = {}, None, [], {}
    for part in parts:
        part = sorted(part, key=lambda r: r[0])
        trail = Trail(window_us, held_us, summaries, newest, stored.__getitem__)
        found, changed = trail.add(part)
        kept = sorted(kept + part, key=lambda r: r[0])
        place = {id(r): i for i, r in enumerate(kept)}
        for r, summary in zip(part, found, strict=True):
            told = dict(zip(FIELDS, summary, strict=True))
            inside = plain_window(kept, place[id(r)], window_us)
            cnr = [x[1][0] for x in inside if not math.isnan(x[1][0])]
            sats = [x[1][1] for x in inside if not math.isnan(x[1][1])]
            assert told["rows"] == len(inside) and told["first_us"] == inside[0][0]
            assert told["cnr_n"] == len(cnr) and (not cnr or (told["cnr_min"], told["cnr_max"]) == (min(cnr), max(cnr)))
            assert math.isclose(told["cnr_placed"], sum(i * v for i, v in enumerate(cnr)), rel_tol=1e-9, abs_tol=1e-9)
            mean = sum(cnr) / len(cnr) if cnr else 0.0
            assert math.isclose(told["cnr_m2"], sum((v - mean) ** 2 for v in cnr), rel_tol=1e-9, abs_tol=1e-6)
            drops = sum(min(b - a, 0.0) for a, b in zip(sats, sats[1:]))
            assert math.isclose(told["sat_drop"], drops, abs_tol=1e-9)
            fixes = [0.0 if math.isnan(x[1][2]) else x[1][2] for x in inside]
            assert told["fix_changes"] == sum(a != b for a, b in zip(fixes, fixes[1:]))
        for b in trail.expired():
            stored.pop(b, None)
        stored |= {b: trail.open[b].rows for b in changed if b in trail.summaries}
        summaries, newest = trail.summaries, trail.newest
    return len(summaries)


@pytest.mark.parametrize("window_us", [20, 1000, 30_000_000])
def test_summaries_equal_plain_windows(window_us):
    rng = random.Random(window_us)
    cell = lambda: rng.choice([math.nan, float(rng.randint(0, 50)), rng.random() * 50])
    rows, at = [], 10**15
    for _ in range(400):
        at += rng.choice([0, 1, window_us // 40, window_us // 3, window_us * 2])
        rows.append((at, tuple(cell() for _ in range(9))))
    parts = [rows[i : i + rng.randint(1, 40)] for i in range(0, 400, 40)]
    late = [r for r in rows if r[0] > rows[-1][0] - window_us // 2 and not any(r is x for p in parts for x in p)]
    assert check_summaries(rng, rows, window_us, 2 * window_us, [*parts, *([late] if late else [])]) <= 3 * 33


def test_fifty_rows_a_second_take_linear_time():
    """Twice the rate takes about twice the merges, not four times."""
    counts = {}
    for rate in (25, 50):
        merges = 0
        plain = trailing.merge

        def counting(a, b, plain=plain):
            nonlocal merges
            merges += 1
            return plain(a, b)

        trailing.merge = counting
        try:
            trail = Trail(30_000_000, 40_000_000, {}, None, None)
            trail.add([(i * 1_000_000 // rate, (40.0,) * 9) for i in range(rate * 120)])
        finally:
            trailing.merge = plain
        counts[rate] = merges / (rate * 120)
    assert counts[50] <= counts[25] * 1.1 and counts[50] < 8


def test_history_columns_are_known():
    assert set(live.HISTORY) | set(live.CURRENT) == set(COLUMNS)
