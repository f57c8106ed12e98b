"""Splits, imputation, oversampling and metrics against plain Python."""

import math
from collections import Counter
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from sessions import same

from clearsky.functions import labels
from clearsky.operators import evaluate as ev
from clearsky.operators import boosting, forest as forests, models, neighbours, oversample, prep
from clearsky.operators.neighbours import nearest
from clearsky.operators.tables import clip, feature_columns, nan_to_null, repaired_splits
from clearsky.session import shared_folder


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 10, 30, 70])
def test_session_split_sizes(spark, n):
    rows = [(f"s{i}", "scenario_x") for i in range(n)]
    got = Counter(r["split"] for r in prep.session_splits(spark.createDataFrame(rows, "scenario string, source string")).collect())
    share = max(1, round(n * 0.15))
    train, val = n - 2 * share, share
    if train < 1:
        train = max(1, n - 1)
        val = max(0, (n - train) // 2)
    want = Counter({"train": train, "validation": val, "test": n - train - val})
    assert got == +want


def test_session_splits_keep_sessions_whole_and_are_repeatable(spark):
    rows = [(f"s{i}", ["nclt_1", "tokyo_2", "other"][i % 3], j) for i in range(30) for j in range(4)]
    df = spark.createDataFrame(rows, "scenario string, source string, j int")
    sessions = df.select("scenario", "source").distinct()
    a = prep.session_split(df, prep.session_splits(sessions))
    assert a.groupBy("scenario").agg(F.count_distinct("split").alias("n")).where("n <> 1").count() == 0
    b = prep.session_splits(sessions.repartition(5))
    assert sorted(map(tuple, prep.session_splits(sessions).collect())) == sorted(map(tuple, b.collect()))
    other = prep.session_splits(sessions, seed="7")
    assert sorted(map(tuple, other.collect())) != sorted(map(tuple, b.collect()))


def test_scalers_use_training_rows_only(spark):
    rows = [("train", 1.0, None, 5.0), ("train", 3.0, 4.0, 5.0), ("val", 11.0, 8.0, 9.0)]
    df = spark.createDataFrame(rows, "split string, a double, b double, c double")
    z = prep.apply_standard(df, prep.fit_standard(df, ["a", "b", "c"]), ["a", "b", "c"]).orderBy("a").collect()
    assert [r["a"] for r in z] == [-1.0, 1.0, 9.0] and [r["b"] for r in z] == [-1.0, 1.0, 3.0] and z[2]["c"] == 4.0
    m = prep.apply_min_max(df, prep.fit_min_max(df, ["a", "c"]), ["a", "c"]).orderBy("a").collect()
    assert [r["a"] for r in m] == [0.0, 1.0, 5.0] and [r["c"] for r in m] == [0.0, 0.0, 4.0]


def test_imputation_rules_in_order(spark):
    t = datetime(2024, 1, 1)
    schema = "source string, timestamp timestamp, note string, alt double, mean_cnr double, min_cnr double, max_cnr double, std_cnr double, cnr_trend double, lat_std double, lon_std double, num_satellites double, pdop double, hdop double, vdop double, gdop double, dop_ratio double, clock_bias double"
    blank = [None] * 5
    rows = [
        ("a", t, None, 10.0, *blank, None, 1.0, 9.0, None, 4.0, None, None, None, None),
        ("a", t + timedelta(seconds=1), "x", None, 40.0, 38.0, 42.0, 1.0, 0.1, None, None, 0.0, 3.0, None, 2.0, None, None, 0.5),
        ("a", t + timedelta(seconds=2), "x", 30.0, *blank, None, None, 1600.0, None, 2.0, None, None, None, None),
        ("b", t, "x", None, *blank, None, None, None, None, None, None, None, None, None),
    ]
    out = prep.impute(spark.createDataFrame(rows, schema), ["source"]).orderBy("source", "timestamp").collect()
    r0, r1, r2, r3 = out
    assert [r["cnr_available"] for r in out] == [0.0, 1.0, 0.0, 0.0] and r0["mean_cnr"] == 0.0
    assert [r["alt"] for r in out] == [10.0, 20.0, 30.0, 0.0]
    assert r0["lat_std"] == 10.0 and r0["lon_std"] == 1.0
    assert r1["lat_std"] == pytest.approx(2.5 * 3.0)  # median of measured hdop
    assert r0["pdop"] == 10.0 and r0["vdop"] == pytest.approx(25 / 3) and r2["pdop"] == 1.0 and r2["gdop"] == 1.0
    assert r1["hdop"] == 3.0 and r1["pdop"] == 3.0 and r1["dop_ratio"] == 1.0
    assert r0["dop_ratio"] == pytest.approx((20 / 3) / (25 / 3))
    assert [r["clock_bias"] for r in out] == [0.0, 0.5, 0.5, 0.0] and r0["note"] == "0.0"
    assert r3["num_satellites"] == 0.0


def test_small_table_helpers(spark):
    df = spark.createDataFrame([(1.0, float("nan"), "x")], "b double, a double, source string")
    assert nan_to_null(df).first()["a"] is None
    assert feature_columns(df.withColumn("cnr_available", F.lit(1))) == ["a", "b", "cnr_available"]
    with pytest.raises(ValueError, match="label"):
        repaired_splits(df)
    clipped = clip(spark.createDataFrame([(99.0, None)], "mean_cnr double, hdop double")).first()
    assert clipped[:] == (60.0, None)


def test_label_rules_with_missing_values(spark):
    schema = "mean_cnr double, hdop double, pdop double, num_satellites double, solution_status double, lat_std double, lon_std double, fix_continuity double"
    rows = [
        (None, None, None, None, None, None, None, None),
        (40.0, None, None, None, 1.0, None, None, 1.0),
        (24.9, 1.0, 1.0, 20.0, 1.0, 0.1, 0.1, 1.0),
        (30.0, 1.0, 1.0, 20.0, 1.0, 0.1, 0.1, 1.0),
        (40.0, 1.0, 1.0, 20.0, 0.0, 4.0, 4.0, 1.0),
        (40.0, 2.5, 4.0, 8.0, 0.8, 1.0, 1.0, 0.8),
    ]
    df = spark.createDataFrame(rows, schema)
    got = df.select(labels.quality_label().alias("q"), labels.sigma_label().alias("s"), labels.legacy_label().alias("l")).collect()
    assert [r["q"] for r in got] == [1, 0, 2, 1, 2, 0]
    assert [r["s"] for r in got] == [1, 1, 0, 0, 2, 0]
    assert [r["l"] for r in got] == ["WARNING", "WARNING", "DEGRADED", "WARNING", "DEGRADED", "CLEAN"]


# ---- oversampling ------------------------------------------------------------------------------


def make_classes(spark):
    rng = np.random.default_rng(1)
    rows = [(0, rng.normal(size=6)) for _ in range(300)] + [(1, rng.normal(3, 1, size=6)) for _ in range(60)]
    rows += [(2, np.full(6, 5.0)) for _ in range(80)] + [(2, rng.normal(size=6)) for _ in range(20)]
    rows = [(int(y), [float(v) for v in x]) for y, x in rows]
    return rows, spark.createDataFrame(rows, "y int, f array<double>")


@pytest.mark.parametrize("block_rows", [2, 7, 2000])
@pytest.mark.parametrize("pivots", [1, 5, 40])
def test_nearest_rows_are_exact(spark, pivots, block_rows):
    rng = np.random.default_rng(pivots)
    points = [(int(i % 3 > 1), [float(x) for x in rng.normal((i % 4) * 3, 1, size=5).round(1)]) for i in range(150)]
    points += [(0, [1.0] * 5)] * 20 + [(2, [float(i)] * 5) for i in range(3)]  # copies, and a class smaller than k
    rows = [(label, i, v) for i, (label, v) in enumerate(points)]
    df = spark.createDataFrame(rows, "label int, id long, v array<double>").repartition(4)
    got = nearest(df, 4, wanted="id % 2 = 0", pivots=pivots, block_rows=block_rows).collect()
    found = {r["id"]: [(x["d"], x["other"]) for x in r["near"]] for r in got}
    assert len(found) == len(got) and set(found) == {i for _, i, _ in rows if i % 2 == 0}
    for label, i, v in rows:
        if i in found:
            all_d = sorted((((np.array(w) - np.array(v)) ** 2).sum(), j) for other, j, w in rows if other == label and j != i)
            assert [j for _, j in found[i]] == [j for _, j in all_d[:4]]


def test_nearest_rows_of_nothing(spark):
    none = spark.createDataFrame([], "label int, id long, v array<double>")
    assert nearest(none, 3).count() == 0 and nearest(none, 3).columns == ["label", "id", "near"]


def test_visits_are_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART_ROWS", 10)
    rng = np.random.default_rng(3)
    rows = [(0, i, [float(x) for x in rng.normal(size=3)]) for i in range(120)]
    df = spark.createDataFrame(rows, "label int, id long, v array<double>")
    for r in nearest(df, 3, pivots=4, block_rows=20).collect():
        v = np.array(rows[r["id"]][2])
        want = sorted((((np.array(w) - v) ** 2).sum(), j) for _, j, w in rows if j != r["id"])[:3]
        assert [x["other"] for x in r["near"]] == [j for _, j in want]


def test_nearest_rows_in_small_slices(spark, monkeypatch):
    """Slices of queries, pairs and rows change nothing, with copies and classes mixed in a slice."""
    for name, size in (("QUERIES", 3), ("PAIRS", 7), ("SLICE_ROWS", 5)):
        monkeypatch.setattr(neighbours, name, size)
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=(90, 3)), 1)
    v[60:] = v[:30]
    exact = ((v[:, None, :] - v[None, :, :]) ** 2).sum(axis=2)
    ids = np.arange(90)
    found = [r for part in neighbours.nearest_among(ids, v, ids, v, 4, np.full(90, np.inf)) for r in zip(*part)]
    want = [(i, exact[i, j], j) for i in ids for j in [j for j in np.lexsort((ids, exact[i])) if j != i][:4]]
    assert found == want
    rows = [(int(i % 2), int(i), v[i].tolist()) for i in ids]
    df = spark.createDataFrame(rows, "label int, id long, v array<double>")
    for r in nearest(df, 3, pivots=5, block_rows=10).collect():
        near = [j for j in np.lexsort((ids, exact[r["id"]])) if j != r["id"] and j % 2 == r["label"]][:3]
        assert [x["other"] for x in r["near"]] == near


def bytes_below(spark):
    folder = Path(shared_folder(spark, "any").removeprefix("file:")).parent
    return sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())


def test_what_a_search_writes_grows_with_rows_not_with_visits(spark, monkeypatch):
    """Vectors without structure: every query visits every block, and no visit is written."""
    monkeypatch.setattr(neighbours, "PART_ROWS", 100)
    rng, written = np.random.default_rng(6), []
    for n in (400, 1600):
        v = rng.normal(size=(n, 32))
        df = spark.createDataFrame([(0, i, x) for i, x in enumerate(v.tolist())], "label int, id long, v array<double>").cache()
        df.count()
        before = bytes_below(spark)
        found = {r["id"]: [x["other"] for x in r["near"]] for r in nearest(df, 3, pivots=4, block_rows=20).collect()}
        written.append(bytes_below(spark) - before)
        for i in range(0, n, 97):
            assert found[i] == [int(j) for j in np.argsort(((v - v[i]) ** 2).sum(axis=1), kind="stable") if j != i][:3]
        assert len(found) == n
    assert written[1] < 4.5 * written[0]


@pytest.mark.parametrize("part_rows", [3, 8_000])
def test_rows_of_one_id_share_a_list(spark, monkeypatch, part_rows):
    """Copies under one id are no neighbours of each other. Each counts a row of its own block once, and one of
    another block as often as there are copies, whatever the tiles."""
    monkeypatch.setattr(neighbours, "PART_ROWS", part_rows)
    rows = [(0, i, [float(i * i), 0.0]) for i in range(10) for _ in range(1 + (i % 4 == 0))]
    df = spark.createDataFrame(rows, "label int, id long, v array<double>").repartition(3)
    pivot = np.array(df.select("v").orderBy(F.xxhash64("v"), "v").first()["v"])
    order = sorted(rows, key=lambda r: (np.linalg.norm(np.array(r[2]) - pivot), r[1]))
    got = {r["id"]: [(x["d"], x["other"]) for x in r["near"]] for r in nearest(df, 4, pivots=1, block_rows=4).collect()}
    for i in range(10):
        mine = [n for n, r in enumerate(order) if r[1] == i]
        every = []
        for n in mine:
            for m, r in enumerate(order):
                if r[1] != i:
                    every += [((r[2][0] - i * i) ** 2, r[1])] * (1 if m // 4 == n // 4 else len(mine))
        assert got[i] == sorted(every)[:4]


def test_synthetic_rows_lie_between_neighbours(spark):
    rows, df = make_classes(spark)
    sizes = oversample.class_sizes(df, "y")
    out = oversample.synthetic_rows(df, "f", "y", sizes, 5).collect()
    assert Counter(r["y"] for r in out) == {1: 240, 2: 200}
    near = 0
    for r in out:
        mine = np.array([x for y, x in rows if y == r["y"]])
        a, b, u, f = (np.array(r[c]) for c in ("start", "end", "u", "f"))
        assert 0 <= u < 1 and np.allclose(f, a + u * (b - a))
        assert (mine == a).all(axis=1).any() and (mine == b).all(axis=1).any()
        d = np.sort(((mine - a) ** 2).sum(axis=1))
        near += ((b - a) ** 2).sum() <= d[5] + 1e-12  # d[0] is the row itself
    assert near == len(out)
    # Every copy of the hot vector has copies as its nearest rows.
    hot = [r for r in out if r["start"] == [5.0] * 6]
    assert len(hot) == 160 and all(r["end"] == [5.0] * 6 for r in hot)


def test_windows_are_made_once(spark):
    """Oversampling reads its windows several times; what makes them runs once."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    rows = [("train", [[1.0, 2.0], [3.0, float(i)]], int(i > 7), 1, 2) for i in range(10)]
    w = spark.createDataFrame(rows, "split string, X array<array<float>>, y_5s int, y_15s int, y_30s int").mapInPandas(counted, "split string, X array<array<float>>, y_5s int, y_15s int, y_30s int")
    out = oversample.oversample_windows(w, classes=(0, 1))
    assert out.where("synthetic").count() == 6 and out.where("not synthetic").count() == 10
    assert out.where("size(X) = 2 and size(X[0]) = 2").count() == 16 and made.value == 10


def test_oversampling_skips_and_repeats(spark):
    _, df = make_classes(spark)
    flat = df.select("y", *[F.get("f", F.lit(i)).alias(f"c{i}") for i in range(6)])
    names = [f"c{i}" for i in range(6)]
    out = oversample.oversample_rows(flat, names, "y")
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {0: 300, 1: 300, 2: 300}
    assert oversample.oversample_rows(flat.where("y > 0"), names, "y").where("synthetic").count() == 0  # 60 of 100
    again = oversample.oversample_rows(flat.repartition(3), names, "y")
    assert sorted(map(repr, out.where("synthetic").collect())) == sorted(map(repr, again.where("synthetic").collect()))
    w = spark.createDataFrame([("train", [[1.0, 2.0], [3.0, float(i)]], int(i > 7), 1, 2) for i in range(10)] + [("test", [[0.0, 0.0], [0.0, 0.0]], 0, 0, 0)], "split string, X array<array<float>>, y_5s int, y_15s int, y_30s int")
    assert oversample.oversample_windows(w).where("synthetic").count() == 0  # class 2 is absent
    two = oversample.oversample_windows(w, classes=(0, 1))
    made = two.where("synthetic").collect()
    assert len(made) == 6 and all(r["split"] == "train" and r["y_30s"] == r["y_15s"] == r["y_5s"] == 1 for r in made)
    assert all(r["X"][0] == [1.0, 2.0] and 8.0 <= r["X"][1][1] <= 9.0 for r in made)


# ---- metrics --------------------------------------------------------------------------------------


def make_predictions(seed=0, n=400):
    rng = np.random.default_rng(seed)
    y = rng.choice(3, n, p=[0.6, 0.3, 0.1])
    p = np.where(rng.random(n) < 0.6, y, rng.choice(3, n))
    raw = rng.integers(1, 9, (n, 3)) + 4.0 * np.eye(3)[y]
    return y, p, raw / raw.sum(axis=1, keepdims=True)


def plain_metrics(y, p):
    n = len(y)
    c = np.array([[np.sum((y == t) & (p == q)) for q in range(3)] for t in range(3)], dtype=float)
    t, q, hit = c.sum(axis=1), c.sum(axis=0), np.diag(c)
    f1 = [2 * h / (a + b) if a + b else 0.0 for h, a, b in zip(hit, t, q)]
    present = [i for i in range(3) if t[i] + q[i]]
    pe = (t * q).sum() / n**2
    po = hit.sum() / n
    spread = math.sqrt(n**2 - (q**2).sum()) * math.sqrt(n**2 - (t**2).sum())
    return {
        "accuracy": po,
        "macro_f1": sum(f1[i] for i in present) / len(present),
        "weighted_f1": float(np.dot(f1, t) / n),
        "kappa": (po - pe) / (1 - pe) if pe != 1 else None,
        "mcc": (hit.sum() * n - (t * q).sum()) / spread if spread else 0.0,
    }


def test_metrics_and_degenerate_groups(spark):
    y, p, _ = make_predictions()
    rows = [("all", int(a), int(b)) for a, b in zip(y, p)] + [("one", 0, 0)] * 5 + [("wrong", 0, 1)] * 3
    cells = ev.confusion_cells(spark.createDataFrame(rows, "horizon string, y_true int, y_pred int"))
    got = {r["horizon"]: r for r in ev.overall_metrics(cells).collect()}
    for h, (a, b) in {"all": (y, p), "one": (np.zeros(5, int), np.zeros(5, int)), "wrong": (np.zeros(3, int), np.ones(3, int))}.items():
        for name, want in plain_metrics(a, b).items():
            assert same(got[h][name], want), (h, name)
    matrix = ev.confusion_matrix(cells).where("horizon = 'wrong'").collect()
    assert len(matrix) == 9 and sum(r["n"] for r in matrix) == 3 and max(r["share"] for r in matrix) == 1.0


def test_curves_with_equal_scores(spark):
    y, _, prob = make_predictions(3)
    df = spark.createDataFrame([("h", int(a), [float(v) for v in q]) for a, q in zip(y, prob)] + [("g", 0, [0.5, 0.3, 0.2])] * 4, "horizon string, y_true int, y_prob array<double>")
    scores = ev.class_scores(df)
    by = ["horizon", "class"]
    auc = {r["class"]: r["auc"] for r in ev.roc_auc(scores, by).collect() if r["horizon"] == "h"}
    ap = {r["class"]: r["average_precision"] for r in ev.average_precision(scores, by).collect() if r["horizon"] == "h"}
    assert len(ev.roc_auc(scores, by).collect()) == 3  # the one-class group has no curve
    for c in range(3):
        pos, neg = prob[y == c, c], prob[y != c, c]
        won = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
        assert same(auc[c], won / (len(pos) * len(neg)), 1e-12)
        total, before = 0.0, 0.0
        for t in sorted(set(prob[:, c]), reverse=True):
            tp, fp = (pos >= t).sum(), (neg >= t).sum()
            total += (tp / len(pos) - before) * tp / (tp + fp)
            before = tp / len(pos)
        assert same(ap[c], total, 1e-12)
    cal = ev.calibration(scores, by).where("horizon = 'h'").collect()
    for c in range(3):
        s, hit = prob[:, c], (y == c).astype(float)
        place = np.searchsorted(np.percentile(s, np.arange(10, 100, 10)), s)
        want = {b: (s[place == b].mean(), hit[place == b].mean()) for b in set(place)}
        got = {r["bin"]: (r["mean_score"], r["positive_share"]) for r in cal if r["class"] == c}
        assert got.keys() == want.keys() and all(same(got[b][i], float(want[b][i])) for b in got for i in (0, 1))


def plain_lead_times(y, p, skip=15):
    out, i = {}, 0
    while i < len(y):
        if y[i] == 2:
            j = i
            while j >= 0 and p[j] == 0:
                j -= 1
            if j >= 0:
                out[i] = i - j
            i += skip
        else:
            i += 1
    return out


@pytest.mark.parametrize("block", [16, 40, 20_000])
def test_lead_times_equal_a_scan(spark, block):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for s, n in (("a", 400), ("b", 17), ("c", 90)):
        y = rng.choice(3, n, p=[0.7, 0.2, 0.1])
        p = rng.choice(3, n, p=[0.93, 0.05, 0.02])
        rows += [(s, i, int(a), int(b)) for i, (a, b) in enumerate(zip(y, p))]
        want |= {(s, i): v for i, v in plain_lead_times(y, p).items()}
    df = spark.createDataFrame(rows, "s string, i long, y_true int, y_pred int")
    leads = ev.lead_times(df, ["s"], "i", block_rows=block)
    assert {(r["s"], r["event_idx"]): r["lead"] for r in leads.collect()} == want
    summary = ev.lead_time_summary(leads).first()
    assert summary["events"] == len(want) and same(float(summary["median_lead"]), float(np.median(list(want.values()))))


def test_bootstrap_matches_resampling(spark):
    y, p, _ = make_predictions(5, 500)
    cells = ev.confusion_cells(spark.createDataFrame([("h", int(a), int(b)) for a, b in zip(y, p)], "horizon string, y_true int, y_pred int"))
    got = ev.bootstrap_intervals(cells, draws=1000).first()
    rng = np.random.default_rng(0)
    drawn = [plain_metrics(y[i], p[i]) for i in (rng.integers(0, 500, 500) for _ in range(1000))]
    for m in ("macro_f1", "mcc", "kappa"):
        low, high = np.quantile([d[m] for d in drawn], [0.025, 0.975])
        assert abs(got[f"{m}_low"] - low) < 0.02 and abs(got[f"{m}_high"] - high) < 0.02
    assert got == ev.bootstrap_intervals(cells.repartition(4), draws=1000).first()


def test_training_history(spark, tmp_path):
    text = '{"train_loss": [3, 2, 1], "val_loss": [3.5, 2.5, 2.75], ' + ", ".join(f'"{k}_f1_{h}": [0.1, {v}, 0.4]' for k, v in (("train", 0.9), ("val", 0.5)) for h in ("5s", "15s", "30s")) + ', "note": "x"}'
    path = tmp_path / "history.json"
    path.write_text(text)
    history = ev.training_history(spark, str(path))
    assert history.count() == 3
    r = ev.history_summary(history).first()
    assert r["best_epoch"] == 2 and same(r["best_val_f1"], 0.5) and same(r["f1_gap"], 0.4) and same(r["loss_gap"], 0.5)


def test_forest_keeps_the_node_of_each_row(spark):
    df = spark.createDataFrame([(i % 2, [float(i % 2), float(i)]) for i in range(40)], "label int, features array<double>")
    forest = models.random_forest(df, "label", trees=3, depth=12)
    assert forest.getCacheNodeIds() and spark.sparkContext.getCheckpointDir() is not None
    assert [r["y_pred"] == r["label"] for r in models.score(forest, df).collect()] == [True] * 40


def test_forest_of_two_classes_scores_after_an_observed_job(spark):
    seen = Observation("rows")
    spark.range(5).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    df = spark.createDataFrame([(i % 2, [float(i % 2), float(i)]) for i in range(40)], "label int, features array<double>")
    forest = models.random_forest(df, "label", trees=3, depth=4)
    assert seen.get["n"] == 5 and [r["y_pred"] for r in models.score(forest, df).collect()] == [i % 2 for i in range(40)]


def test_models_learn_and_explain(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 4))
    y = (x[:, 1] > 0).astype(int) + (x[:, 1] > 1)
    df = spark.createDataFrame([(i, int(a), [float(v) for v in r]) for i, (a, r) in enumerate(zip(y, x))], "id long, label int, features array<double>").cache()
    names = ["a", "b", "c", "d"]
    forest = models.random_forest(df, "label", trees=10, depth=4)
    scored = models.score(forest, df)
    assert scored.where("label = y_pred").count() > 370
    assert same(scored.select(F.aggregate("y_prob", F.lit(0.0), lambda s, v: s + v)).first()[0], 1.0)
    lost = models.permutation_importance(forest, df, names, "label", "id").collect()
    assert lost[0]["feature"] == "b" and lost[0]["relative"] == 1.0 and all(r["relative"] < 0.2 for r in lost[1:])
    assert models.ensemble_importance(forest, names, df).first()["feature"] == "b"
    boosted = models.boosted_trees(df, "label", rounds=8, depth=3, rate=0.3)
    assert models.score(boosted, df).where("label = y_pred").count() > 360
    stacked = models.score_horizons({"5s": forest, "15s": boosted}, df, {"5s": "label", "15s": "label"}, keep=["id"])
    assert stacked.groupBy("horizon").count().where("count = 400").count() == 2


def plain_tree(bins, y, times, weights, columns, least, depth):
    """Counts per class of the leaves, by plain recursion; ``columns`` are tried in every node."""
    counts = np.bincount(y, times, len(weights))

    def worth(c):
        return ((c * weights) ** 2).sum() / (c * weights).sum()

    best = (1e-9, None)
    for f in columns if depth else []:
        for b in range(forests.BINS - 1):
            low = bins[:, f] <= b
            left, right = (np.bincount(y[m], times[m], len(weights)) for m in (low, ~low))
            if min(left.sum(), right.sum()) >= least:
                gain = worth(left) + worth(right) - worth(counts)
                if gain > best[0] + 1e-12:
                    best = (gain, low)
    if best[1] is None:
        return [tuple(counts)]
    return [leaf for m in (best[1], ~best[1]) for leaf in plain_tree(bins[m], y[m], times[m], weights, columns, least, depth - 1)]


@pytest.mark.parametrize("cells", [forests.CELLS, 200])
def test_subtrees_grow_like_plain_recursion(monkeypatch, cells):
    """A few nodes at a time or all at once; rows drawn 0 times or more; limits on depth and rows of a leaf."""
    monkeypatch.setattr(forests, "CELLS", cells)
    rng = np.random.default_rng(5)
    bins, y, times = rng.integers(0, 32, (600, 3)).astype(np.uint8), rng.integers(0, 3, 600), rng.poisson(1.0, 600)
    weights = np.array([0.5, 1.0, 2.0])
    for depth, least in ((30, 5), (3, 1), (0, 5)):
        piece, lost = forests.grown(bins, y, times, weights, depth, least, 3, [1])
        assert sorted(map(tuple, piece.counts)) == sorted(plain_tree(bins, y, times, weights, range(3), least, depth))
        back = forests.Piece.unpacked(piece.packed(), 3)
        at = back.places(bins)
        assert (back.feature[at] == forests.LEAF).all()
        leaf = (np.cumsum(back.feature == forests.LEAF) - 1)[at]
        held = np.stack([np.bincount(leaf[y == c], times[y == c], len(back.counts)) for c in range(3)], axis=1)
        assert (held == back.counts).all() and (lost > 0).any() == (depth > 0)


def leaves_of(model, x):
    """Rows counted in all leaves of each tree, and how many pieces each has."""
    k = len(model.weights)
    tops = [forests.Piece.unpacked(t, k) for t in model.tops]
    rest = [[forests.Piece.unpacked(p, k) for p in below.values()] for below in model.rest]
    return [sum(p.counts.sum() for p in [top, *below]) for top, below in zip(tops, rest)], [len(below) for below in rest]


@pytest.mark.parametrize("trees", [7, 100])
def test_forest_is_the_same_job_where_rows_fit_no_task(spark, monkeypatch, trees):
    """Large nodes are cut level by level over all blocks, what is left is finished in tasks: no row is lost."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 4)).round(2)
    x[:, 3] = rng.integers(0, 3, 700)
    y = (x[:, 1] > 0).astype(int) + (x[:, 3] > 1)
    rows = [(i, int(a), [float(v) for v in r]) for i, (a, r) in enumerate(zip(y, x))]
    df = spark.createDataFrame(rows, "id long, label int, features array<double>")
    monkeypatch.setattr(forests, "BLOCK_ROWS", 100)
    whole = models.random_forest(df, "label", trees=trees, depth=8)
    monkeypatch.setattr(forests, "LOCAL_BYTES", 12 * 150)  # 150 rows of four features
    cut = models.random_forest(df, "label", trees=trees, depth=8)
    (all_rows, one), (cut_rows, many) = leaves_of(whole, x), leaves_of(cut, x)
    assert one == [1] * trees and min(many) > 3 and all(500 < n < 900 for n in all_rows)
    assert sorted(cut_rows) == pytest.approx(sorted(all_rows), abs=120)  # draws belong to blocks, whose rows may differ
    for model in (whole, cut):
        scored = models.score(model, df).collect()
        assert sum(r["y_pred"] == r["label"] for r in scored) > 670
        assert all(abs(sum(r["y_prob"]) - 1) < 1e-9 and min(r["y_prob"]) >= 0 for r in scored)
        assert model.importances.sum() == pytest.approx(1) and set(np.argsort(model.importances)[2:]) == {1, 3}


def test_forest_cuts_rare_values_and_grows_below_thirty(spark):
    """A value of 6 rows in 200 is no quantile but is cut; Spark's forest refused more than 30 levels."""
    rows = [(int(i < 6), [float(i < 6), 7.0]) for i in range(200)]
    df = spark.createDataFrame(rows, "label int, features array<double>").repartition(3)
    edges = forests.feature_edges(df, "features", 2)
    assert edges[0].tolist() == [0.5] and edges[1].tolist() == []
    model = models.random_forest(df, "label", trees=20, depth=40)
    assert [r["y_pred"] for r in models.score(model, df).collect()] == [r["label"] for r in df.collect()]


def plain_boosting(model, x, y, w, rounds, depth, rate):
    """The same trees from whole arrays, without blocks, groups of features or sampling."""
    bins, k = model.binned(x), len(model.classes)
    scores = np.zeros((len(y), k))
    for _ in range(rounds):
        e = np.exp(scores - scores.max(axis=1, keepdims=True))
        p, step = e / e.sum(axis=1, keepdims=True), np.zeros_like(scores)
        for c in range(k):
            g, h = w * (p[:, c] - (y == c)), w * 2 * p[:, c] * (1 - p[:, c])

            def grow(rows, level, c=c, g=g, h=h, step=step):
                total_g, total_h = g[rows].sum(), h[rows].sum()
                best = (1e-9, None)
                for f in range(x.shape[1] if level < depth else 0):
                    for cut in range(boosting.BINS - 1):
                        left = rows[bins[rows, f] <= cut]
                        gl, hl = g[left].sum(), h[left].sum()
                        gr, hr = total_g - gl, total_h - hl
                        if hl >= 1 and hr >= 1:
                            gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - total_g**2 / (total_h + 1)
                            if gain > best[0] + 1e-9:
                                best = (gain, (f, cut))
                if best[1] is None:
                    step[rows, c] = -rate * total_g / (total_h + 1)
                else:
                    f, cut = best[1]
                    grow(rows[bins[rows, f] <= cut], level + 1)
                    grow(rows[bins[rows, f] > cut], level + 1)

            grow(np.arange(len(y)), 0)
        scores += step
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def test_boosting_equals_plain_trees(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(160, 3)).round(2)
    y = (x[:, 0] + 0.3 * rng.normal(size=160) > 0).astype(int) + 2 * (x[:, 2] > 0.8)
    y = np.minimum(y, 2)
    df = spark.createDataFrame([(int(a), [float(v) for v in r]) for a, r in zip(y, x)], "label int, features array<double>").repartition(3)
    model = boosting.fit_boosted_trees(df, "label", rounds=3, depth=2, rate=0.5, rows_share=2.0, columns_share=2.0)
    w = len(y) / (3 * np.bincount(y)[y])
    np.testing.assert_allclose(model.probabilities(x), plain_boosting(model, x, y, w, 3, 2, 0.5), atol=1e-9)


def test_boosting_in_many_blocks_and_groups(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 7))
    y = np.where(x[:, 6] > 0.5, 7, np.where(x[:, 1] > 0, 3, 5))  # classes need not be 0, 1, 2
    df = spark.createDataFrame([(int(a), [float(v) for v in r]) for a, r in zip(y, x)], "label int, features array<double>").repartition(4)
    edges = np.quantile(x, np.arange(1, boosting.BINS) / boosting.BINS, axis=0).T
    monkeypatch.setattr(boosting, "bin_edges", lambda *_: edges)  # a sketch's quantiles depend on the order of its parts
    whole = boosting.fit_boosted_trees(df, "label", rounds=4, depth=3, rate=0.3, rows_share=2.0)
    for name, value in (("FEATURE_GROUP", 2), ("CHECKPOINT", 2)):
        monkeypatch.setattr(boosting, name, value)
    parts = boosting.fit_boosted_trees(df, "label", rounds=4, depth=3, rate=0.3, rows_share=2.0)
    np.testing.assert_allclose(parts.probabilities(x), whole.probabilities(x), atol=1e-9)
    out = whole.score(df).select("label", "y_pred", "y_prob").toPandas()
    assert set(out["y_pred"]) == {3, 5, 7} and (out["label"] == out["y_pred"]).mean() > 0.95
    assert np.allclose(np.stack(out["y_prob"]).sum(axis=1), 1)


def test_quadratic_trend_equals_polyfit(spark):
    from clearsky.operators.reports import quadratic_trends

    rng = np.random.default_rng(6)
    x = 1.7e9 + np.sort(rng.uniform(0, 3000, 80))
    yv = 40 - 0.002 * (x - x[0]) + rng.normal(0, 1, 80)
    rows = [("a", float(a), float(b)) for a, b in zip(x, yv)] + [("b", 1.0, 2.0), ("b", 2.0, 3.0)] + [("c", 5.0, float(i)) for i in range(9)]
    out = quadratic_trends(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").orderBy("step").collect()
    assert {r["g"] for r in out} == {"a"} and len(out) == 100
    fit = np.poly1d(np.polyfit(x - x[0], yv, 2))
    np.testing.assert_allclose([r["trend"] for r in out], fit(np.linspace(0, x[-1] - x[0], 100)), rtol=1e-6)
    assert pd.Series([r["x"] for r in out]).is_monotonic_increasing
