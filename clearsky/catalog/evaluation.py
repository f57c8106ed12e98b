"""Metrics, baselines and scores on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearsky.catalog.base import EPOCHS_SQL, events_as_epochs, query, rnd, shared_folder, sql_rnd, table
from clearsky.functions.scalars import argmax, focal_loss, softmax
from clearsky.operators import evaluate as ev
from clearsky.operators import models
from clearsky.operators.ordered import row_index
from clearsky.plans import training
from clearsky.session import stored, tasks_for

HORIZON_NAMES = ["5s", "15s", "30s"]
C = [0, 1, 2]


def predictions(spark, sf):
    """Events as predictions: truth, prediction and class scores from ``value`` and ``k``."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    base = table(spark, sf, "events").withColumn("k", k)
    k, v, e = F.col("k"), F.col("value"), F.col("event_type")
    raw = [1 + k % 10, 1 + F.floor(v / 10) % 12, 1 + (k * 7 + F.floor(v)) % 11]
    total = raw[0] + raw[1] + raw[2]
    return base.select(
        "event_id",
        F.concat(F.lit("u"), F.col("user_id")).alias("source"),
        e.alias("scenario"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(e.isin("click", "view"), "5s").when(e.isin("signup", "error"), "15s").otherwise("30s").alias("horizon"),
        (k % 3).alias("y_true"),
        F.when(v < 40, k % 3).when(v < 80, (k + 1) % 3).otherwise((k * 7 + 2) % 3).cast("int").alias("y_pred"),
        F.array(*[r.cast("double") / total for r in raw]).alias("y_prob"),
        F.array(*[r.cast("double") / 4 for r in raw]).alias("scores"),
    )


PRED_SQL = """
b AS (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS INT) AS k, CAST(floor(value) AS BIGINT) AS f FROM events),
b2 AS (SELECT *, 1 + k % 10 AS r0, 1 + CAST(floor(value / 10) AS BIGINT) % 12 AS r1, 1 + (k * 7 + f) % 11 AS r2 FROM b),
p AS (SELECT event_id, 'u' || user_id AS source, event_type AS scenario, ts,
  CASE WHEN event_type IN ('click', 'view') THEN '5s' WHEN event_type IN ('signup', 'error') THEN '15s' ELSE '30s' END AS horizon,
  k % 3 AS y_true, CAST(CASE WHEN value < 40 THEN k % 3 WHEN value < 80 THEN (k + 1) % 3 ELSE (k * 7 + 2) % 3 END AS INT) AS y_pred,
  [r0::DOUBLE / (r0 + r1 + r2), r1::DOUBLE / (r0 + r1 + r2), r2::DOUBLE / (r0 + r1 + r2)] AS y_prob,
  [r0 / 4.0, r1 / 4.0, r2 / 4.0] AS scores FROM b2)"""


@query(
    "confusion_matrix",
    f"""WITH {PRED_SQL}, cl AS (SELECT unnest([0, 1, 2]) AS c), h AS (SELECT DISTINCT horizon FROM p),
n AS (SELECT h.horizon, a.c AS y_true, d.c AS y_pred,
  (SELECT count(*) FROM p WHERE p.horizon = h.horizon AND p.y_true = a.c AND p.y_pred = d.c) AS n FROM h, cl a, cl d)
SELECT horizon, y_true, y_pred, n, {sql_rnd("n::DOUBLE / sum(n) OVER (PARTITION BY horizon, y_true)")} AS share FROM n""",
)
def confusion_matrix(spark, sf):
    out = ev.confusion_matrix(ev.confusion_cells(predictions(spark, sf)))
    return out.withColumn("share", rnd("share"))


_PER_CLASS = """
pc AS (SELECT {by}, cl.c AS class, count(*) FILTER (y_true = c AND y_pred = c) AS tp, count(*) FILTER (y_true = c) AS t,
  count(*) FILTER (y_pred = c) AS q, count(*) AS n FROM p, (SELECT unnest([0, 1, 2]) AS c) cl GROUP BY {by}, cl.c)"""
_F1 = "coalesce(2.0 * tp / nullif(t + q, 0), 0)"


def _overall_sql(by: str) -> str:
    return f"""{_PER_CLASS.format(by=by)},
o AS (SELECT {by}, max(n) AS n, sum(tp) / max(n)::DOUBLE AS accuracy,
  sum({_F1}) / count(*) FILTER (t + q > 0) AS macro_f1, sum({_F1} * t) / max(n) AS weighted_f1,
  (sum(tp) / max(n)::DOUBLE - sum(t * q) / max(n)::DOUBLE ** 2) / nullif(1 - sum(t * q) / max(n)::DOUBLE ** 2, 0) AS kappa,
  coalesce((sum(tp)::DOUBLE * max(n) - sum(t * q)) / nullif(sqrt(max(n)::DOUBLE ** 2 - sum(t * t)) * sqrt(max(n)::DOUBLE ** 2 - sum(q * q)), 0), 0) AS mcc
  FROM pc GROUP BY {by})"""


_OVERALL = ["accuracy", "macro_f1", "weighted_f1", "kappa", "mcc"]
_OVERALL_OUT = ", ".join(f"{sql_rnd(m)} AS {m}" for m in _OVERALL)


@query(
    "class_metrics",
    f"""WITH {PRED_SQL}, {_PER_CLASS.format(by="horizon")}
SELECT horizon, class, {sql_rnd("coalesce(tp::DOUBLE / nullif(q, 0), 0)")} AS precision, {sql_rnd("coalesce(tp::DOUBLE / nullif(t, 0), 0)")} AS recall,
  {sql_rnd(_F1)} AS f1, t AS support FROM pc""",
)
def class_metrics(spark, sf):
    out = ev.class_metrics(ev.confusion_cells(predictions(spark, sf)))
    return out.withColumns({c: rnd(c) for c in ("precision", "recall", "f1")})


@query("overall_metrics", f"WITH {PRED_SQL}, {_overall_sql('horizon')} SELECT horizon, n, {_OVERALL_OUT} FROM o")
def overall_metrics(spark, sf):
    out = ev.overall_metrics(ev.confusion_cells(predictions(spark, sf)))
    return out.withColumns({m: rnd(m) for m in _OVERALL})


@query(
    "metrics_by_source",
    f"WITH {PRED_SQL}, {_overall_sql('source, horizon')} SELECT source, horizon, n, {_OVERALL_OUT} FROM o",
)
def metrics_by_source(spark, sf):
    by = ["source", "horizon"]
    out = ev.overall_metrics(ev.confusion_cells(predictions(spark, sf), by), by)
    return out.withColumns({m: rnd(m) for m in _OVERALL})


@query(
    "label_agreement_metrics",
    f"""WITH p AS (SELECT d.source AS horizon, l.quality AS y_true, l.toxic AS y_pred FROM labels l JOIN documents d USING (doc_id)),
{_overall_sql('horizon')} SELECT horizon, n, {_OVERALL_OUT} FROM o""",
)
def label_agreement_metrics(spark, sf):
    """Two label columns of documents as truth and prediction, by source."""
    pairs = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    df = pairs.select(F.col("source").alias("horizon"), F.col("quality").alias("y_true"), F.col("toxic").alias("y_pred"))
    out = ev.overall_metrics(ev.confusion_cells(df))
    return out.withColumns({m: rnd(m) for m in _OVERALL})


@query(
    "f1_by_horizon",
    f"""WITH {PRED_SQL}, {_PER_CLASS.format(by="horizon")}
SELECT class, {", ".join(f"{sql_rnd(f'max({_F1}) FILTER (horizon = {chr(39)}{h}{chr(39)})')} AS f1_{h}" for h in HORIZON_NAMES)} FROM pc GROUP BY class""",
)
def f1_by_horizon(spark, sf):
    out = ev.f1_table(ev.confusion_cells(predictions(spark, sf)), groups=HORIZON_NAMES)
    return out.select("class", *[rnd(F.col(f"`{h}`")).alias(f"f1_{h}") for h in HORIZON_NAMES])


@query(
    "degraded_recall_by_scenario",
    f"""WITH {PRED_SQL} SELECT scenario, horizon, count(*) FILTER (y_true = 2) AS support,
  {sql_rnd("coalesce(count(*) FILTER (y_true = 2 AND y_pred = 2)::DOUBLE / nullif(count(*) FILTER (y_true = 2), 0), 0)")} AS recall
FROM p GROUP BY scenario, horizon""",
)
def degraded_recall_by_scenario(spark, sf):
    return ev.recall_by(predictions(spark, sf), ["scenario", "horizon"]).withColumn("recall", rnd("recall"))


# ---- scores -----------------------------------------------------------------------------------------

_SCORES = f"""WITH {PRED_SQL},
s AS (SELECT horizon, c AS class, y_prob[c + 1] AS score, CASE WHEN y_true = c THEN 1 ELSE 0 END AS positive
  FROM p, (SELECT unnest([0, 1, 2]) AS c)),
d AS (SELECT horizon, class, score, sum(positive) AS pos, count(*) - sum(positive) AS neg FROM s GROUP BY ALL),
k AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY horizon, class) AS pt,
  sum(neg) OVER (PARTITION BY horizon, class) AS nt
  FROM d WINDOW w AS (PARTITION BY horizon, class ORDER BY score DESC))"""
_BY = ["horizon", "class"]


def _scores(spark, sf):
    return ev.class_scores(predictions(spark, sf))


@query("roc_curve", _SCORES + f" SELECT horizon, class, {sql_rnd('score', 9)} AS score, {sql_rnd('fp / nt::DOUBLE')} AS fpr, {sql_rnd('tp / pt::DOUBLE')} AS tpr FROM k")
def roc_curve(spark, sf):
    out = ev.roc_curve(_scores(spark, sf), _BY)
    return out.withColumns({"score": rnd("score", 9), "fpr": rnd("fpr"), "tpr": rnd("tpr")})


@query(
    "roc_auc",
    _SCORES
    + f""", r AS (SELECT *, rank() OVER (PARTITION BY horizon, class ORDER BY score) + (count(*) OVER (PARTITION BY horizon, class, score) - 1) / 2.0 AS rk FROM s)
SELECT horizon, class, {sql_rnd("(sum(rk) FILTER (positive = 1) - sum(positive) * (sum(positive) + 1) / 2.0) / (sum(positive)::DOUBLE * (count(*) - sum(positive)))")} AS auc
FROM r GROUP BY horizon, class""",
)
def roc_auc(spark, sf):
    return ev.roc_auc(_scores(spark, sf), _BY).withColumn("auc", rnd("auc"))


@query("pr_curve", _SCORES + f" SELECT horizon, class, {sql_rnd('score', 9)} AS score, {sql_rnd('tp::DOUBLE / (tp + fp)')} AS precision, {sql_rnd('tp::DOUBLE / pt')} AS recall FROM k")
def pr_curve(spark, sf):
    out = ev.pr_curve(_scores(spark, sf), _BY)
    return out.withColumns({"score": rnd("score", 9), "precision": rnd("precision"), "recall": rnd("recall")})


@query(
    "average_precision",
    _SCORES
    + f", g AS (SELECT *, tp::DOUBLE / pt - coalesce(lag(tp::DOUBLE / pt) OVER (PARTITION BY horizon, class ORDER BY score DESC), 0) AS dr FROM k) "
    + f"SELECT horizon, class, {sql_rnd('sum(dr * tp / (tp + fp))')} AS average_precision, {sql_rnd('max(pt)::DOUBLE / (max(pt) + max(nt))')} AS prevalence FROM g GROUP BY horizon, class",
)
def average_precision(spark, sf):
    out = ev.average_precision(_scores(spark, sf), _BY)
    return out.withColumns({"average_precision": rnd("average_precision"), "prevalence": rnd("prevalence")})


_EDGES = ", ".join(f"quantile_cont(score, {i / 10}) AS e{i}" for i in range(1, 10))
_PLACE = " + ".join(f"(e{i} < score)::INT" for i in range(1, 10))


@query(
    "calibration",
    _SCORES
    + f""", e AS (SELECT horizon, class, {_EDGES}, avg((score - positive) ** 2) AS brier FROM s GROUP BY horizon, class HAVING sum(positive) >= 5)
SELECT horizon, class, {sql_rnd("any_value(brier)")} AS brier, {_PLACE} AS bin, {sql_rnd("avg(score)")} AS mean_score,
  {sql_rnd("avg(positive)")} AS positive_share, count(*) AS n FROM s JOIN e USING (horizon, class) GROUP BY horizon, class, {_PLACE}""",
)
def calibration(spark, sf):
    out = ev.calibration(_scores(spark, sf), _BY)
    return out.withColumns({c: rnd(c) for c in ("brier", "mean_score", "positive_share")})


@query(
    "softmax_argmax",
    f"""WITH {PRED_SQL}, x AS (SELECT event_id, scores, list_transform(scores, lambda s: exp(s - list_max(scores))) AS ex FROM p)
SELECT event_id, {", ".join(sql_rnd(f"ex[{i + 1}] / list_sum(ex)") + f" AS p{i}" for i in C)},
  CAST(list_position(scores, list_max(scores)) - 1 AS INT) AS y_pred FROM x""",
)
def softmax_argmax(spark, sf):
    probs = predictions(spark, sf).withColumn("q", softmax(F.col("scores")))
    return probs.select("event_id", *[rnd(F.get("q", F.lit(i))).alias(f"p{i}") for i in C], argmax(F.col("scores")).alias("y_pred"))


@query(
    "focal_loss_by_horizon",
    f"""WITH {PRED_SQL}, x AS (SELECT horizon, y_prob[y_true + 1] AS q, ([1.0, 2.0, 3.0])[y_true + 1] AS w FROM p)
SELECT horizon, {sql_rnd("avg(-w * (1 - q) ** 2 * ln(q))")} AS loss FROM x GROUP BY horizon""",
)
def focal_loss_by_horizon(spark, sf):
    q = F.get("y_prob", F.col("y_true"))
    w = F.get(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.col("y_true"))
    return predictions(spark, sf).groupBy("horizon").agg(rnd(F.avg(focal_loss(q, w))).alias("loss"))


# ---- lead time ------------------------------------------------------------------------------------------

# Thinning depends on the event taken before; the check walks each session's events recursively.
_LEAD = f"""
WITH RECURSIVE {PRED_SQL},
s AS (SELECT source, y_true, CASE WHEN y_pred >= 1 AND event_id % 11 = 0 THEN 1 ELSE 0 END AS y_pred,
  row_number() OVER (PARTITION BY source ORDER BY ts) - 1 AS i FROM p),
z AS (SELECT *, max(CASE WHEN y_pred >= 1 THEN i END) OVER (PARTITION BY source ORDER BY i) AS alert FROM s),
d AS (SELECT source, i, alert FROM z WHERE y_true = 2),
walk AS (
  SELECT source, min(i) AS i FROM d GROUP BY source
  UNION ALL
  SELECT w.source, (SELECT min(d.i) FROM d WHERE d.source = w.source AND d.i >= w.i + 15) AS i FROM walk w
  WHERE EXISTS (SELECT 1 FROM d WHERE d.source = w.source AND d.i >= w.i + 15)),
leads AS (SELECT source, d.i AS event_idx, d.i - d.alert AS lead FROM walk JOIN d USING (source, i) WHERE d.alert IS NOT NULL)"""


def _leads(spark, sf):
    p = predictions(spark, sf)
    numbered = row_index(p, ["source"], "timestamp", name="i", chunk_seconds=3 * 86400)
    sparse = F.when(F.col("event_id") % 11 == 0, F.col("y_pred")).otherwise(F.lit(0))
    return ev.lead_times(
        numbered.select("source", (F.col("i") - 1).alias("i"), "y_true", sparse.alias("y_pred")),
        ["source"], "i", block_rows=20,
    )


@query("lead_times", _LEAD + " SELECT source, event_idx, lead FROM leads")
def lead_times(spark, sf):
    return _leads(spark, sf)


@query(
    "lead_time_summary",
    _LEAD + f" SELECT source, count(*) AS events, {sql_rnd('avg(lead)')} AS mean_lead, median(lead)::DOUBLE AS median_lead FROM leads GROUP BY source",
)
def lead_time_summary(spark, sf):
    out = ev.lead_time_summary(_leads(spark, sf), ["source"])
    return out.select("source", "events", rnd("mean_lead").alias("mean_lead"), F.col("median_lead").cast("double").alias("median_lead"))


@query("lead_time_histogram", _LEAD + f" SELECT lead, count(*) AS events, {sql_rnd('count(*)::DOUBLE / sum(count(*)) OVER ()')} AS density FROM leads GROUP BY lead")
def lead_time_histogram(spark, sf):
    return ev.lead_time_histogram(_leads(spark, sf)).withColumn("density", rnd("density"))


# ---- baselines --------------------------------------------------------------------------------------------


@query(
    "majority_class",
    """WITH t AS (SELECT label, count(*) AS n FROM embeddings WHERE vec_id % 2 = 0 GROUP BY label)
SELECT vec_id, label AS y_true, (SELECT label FROM t ORDER BY n DESC, label LIMIT 1) AS y_pred FROM embeddings WHERE vec_id % 2 = 1""",
)
def majority_class(spark, sf):
    """The most frequent class of the even vectors (training) for the odd ones (test)."""
    emb = table(spark, sf, "embeddings").select("vec_id", "label")
    out = models.majority_class(emb.where("vec_id % 2 = 0"), emb.where("vec_id % 2 = 1"), "label")
    return out.select("vec_id", F.col("label").alias("y_true"), "y_pred")


@query(
    "cnr_rule_on_windows",
    f"""WITH {EPOCHS_SQL}, w AS (SELECT event_id, avg(coalesce(mean_cnr_epoch, 0)) OVER (PARTITION BY source ORDER BY timestamp ROWS 29 PRECEDING) AS m,
  row_number() OVER (PARTITION BY source ORDER BY timestamp) AS i, count(*) OVER (PARTITION BY source) AS n FROM epochs)
SELECT event_id, CASE WHEN m < 30 THEN 2 WHEN m < 37 THEN 1 ELSE 0 END AS y_pred FROM w WHERE i >= 30 AND i + 30 <= n AND n > 60""",
)
def cnr_rule_on_windows(spark, sf):
    from clearsky.operators.prep import training_windows

    ep = events_as_epochs(spark, sf).select(
        "event_id", "source", "timestamp", F.coalesce("mean_cnr_epoch", F.lit(0.0)).alias("mean_cnr"),
        F.col("fix_quality").alias("label"),
    )
    w = training_windows(ep, ["mean_cnr"], ["source"], keep=["event_id"], chunk_seconds=5 * 86400)
    return models.cnr_rule_baseline(w, 0).select("event_id", "y_pred")


@query(
    "model_comparison",
    f"""WITH {PRED_SQL}, {_overall_sql('horizon').replace("FROM p,", "FROM p,")},
p2 AS (SELECT horizon, y_true, 0 AS y_pred FROM p),
pc2 AS (SELECT horizon, cl.c AS class, count(*) FILTER (y_true = c AND y_pred = c) AS tp, count(*) FILTER (y_true = c) AS t,
  count(*) FILTER (y_pred = c) AS q FROM p2, (SELECT unnest([0, 1, 2]) AS c) cl GROUP BY horizon, cl.c),
o2 AS (SELECT horizon, sum({_F1}) / count(*) FILTER (t + q > 0) AS macro_f1 FROM pc2 GROUP BY horizon),
u AS (SELECT 'rule' AS method, horizon, macro_f1 FROM o UNION ALL SELECT 'always_clean', horizon, macro_f1 FROM o2)
SELECT method, {", ".join(f"{sql_rnd(f'max(macro_f1) FILTER (horizon = {chr(39)}{h}{chr(39)})')} AS f1_{h}" for h in HORIZON_NAMES)} FROM u GROUP BY method""",
)
def model_comparison(spark, sf):
    p = predictions(spark, sf)
    results = {
        "rule": ev.overall_metrics(ev.confusion_cells(p)),
        "always_clean": ev.overall_metrics(ev.confusion_cells(p.withColumn("y_pred", F.lit(0)))),
    }
    out = ev.model_comparison(results, HORIZON_NAMES)
    return out.select("method", *[rnd(F.col(f"`{h}`")).alias(f"f1_{h}") for h in HORIZON_NAMES])


@query(
    "bootstrap_intervals",
    f"""WITH {PRED_SQL}, {_overall_sql('horizon')} SELECT horizon, {sql_rnd("macro_f1")} AS macro_f1, true AS inside, true AS ordered FROM o""",
)
def bootstrap_intervals(spark, sf):
    """Random draws, so what is compared is the metric itself and that its interval holds it;
    tests check the spread against resampling."""
    cells = ev.confusion_cells(predictions(spark, sf))
    point = ev.overall_metrics(cells).select("horizon", "macro_f1")
    low, high = F.col("macro_f1_low"), F.col("macro_f1_high")
    return ev.bootstrap_intervals(cells).join(point, "horizon").select(
        "horizon", rnd("macro_f1").alias("macro_f1"), F.col("macro_f1").between(low, high).alias("inside"), (low < high).alias("ordered")
    )


def _vectors(spark, sf):
    emb = table(spark, sf, "embeddings")
    split = F.when(F.col("vec_id") % 5 == 0, "test").otherwise("train")
    return emb.select("vec_id", F.col("embedding").alias("features"), (F.col("label") % 3).alias("label"), split.alias("split"))


_SCORES_SQL = """SELECT vec_id, true AS distribution, true AS at_largest FROM embeddings WHERE vec_id % 5 = 0"""


def _checked_scores(scored):
    """Per row: are its probabilities a distribution, and is the class of the largest predicted?"""
    total = F.aggregate("y_prob", F.lit(0.0), lambda s, x: s + x)
    return scored.select(
        "vec_id", ((F.abs(total - 1) < 1e-9) & (F.array_min("y_prob") >= 0)).alias("distribution"),
        (F.get("y_prob", F.col("y_pred").cast("int")) == F.array_max("y_prob")).alias("at_largest"),
    )


@query("random_forest_scores", _SCORES_SQL)
def random_forest_scores(spark, sf):
    """The forest with its own defaults."""
    v = _vectors(spark, sf)
    model = models.random_forest(v.where("split = 'train'"), "label")
    return _checked_scores(models.score(model, v.where("split = 'test'")))


@query("boosted_trees_scores", _SCORES_SQL)
def boosted_trees_scores(spark, sf):
    v = _vectors(spark, sf)
    model = models.boosted_trees(v.where("split = 'train'"), "label", rounds=20)
    return _checked_scores(models.score(model, v.where("split = 'test'")))


@query("permutation_importance", "SELECT 'planted' AS feature, 1.0 AS relative")
def permutation_importance(spark, sf):
    """Among 64 measured features one is planted that tells the class: it must come first."""
    v = _vectors(spark, sf)
    planted = F.concat(F.transform("features", lambda x: x.cast("double")), F.array(F.col("label").cast("double")))
    v = v.withColumn("features", planted)
    model = models.random_forest(v.where("split = 'train'"), "label", trees=100, depth=10)
    names = [*[f"e{i}" for i in range(64)], "planted"]
    found = models.permutation_importance(model, v.where("split = 'test'"), names, "label", row_id="vec_id", top=1)
    return found.select("feature", "relative")


@query(
    "multi_horizon_scores",
    "SELECT h AS horizon, count(*) AS n, count(*) AS distributions, count(*) AS at_largest FROM embeddings, (SELECT unnest(['5s', '15s', '30s']) AS h) WHERE vec_id % 5 = 0 GROUP BY h",
)
def multi_horizon_scores(spark, sf):
    """Three models over one pass of the rows; each score is a distribution whose largest part is predicted."""
    v = _vectors(spark, sf).withColumns({"y_15s": (F.col("vec_id") % 3).cast("int"), "y_30s": (F.col("vec_id") % 2).cast("int")})
    truths = {"5s": "label", "15s": "y_15s", "30s": "y_30s"}
    train, test = v.where("split = 'train'"), v.where("split = 'test'")
    fitted = {h: models.random_forest(train, y, trees=20, depth=8) for h, y in truths.items()}
    out = models.score_horizons(fitted, test, truths, keep=["vec_id"])
    total = F.aggregate("y_prob", F.lit(0.0), lambda s, x: s + x)
    return out.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.abs(total - 1) < 1e-9, 1)).alias("distributions"),
        F.count(F.when(F.get("y_prob", F.col("y_pred").cast("int")) == F.array_max("y_prob"), 1)).alias("at_largest"),
    )


@query(
    "training_history_summary",
    f"""WITH e AS (SELECT row_number() OVER (ORDER BY c_custkey) AS epoch, c_acctbal / 10000.0 AS a, c_nationkey / 25.0 AS b FROM customer),
s AS (SELECT epoch, (a + b + a * b) / 3 AS val_f1, (b + b + a) / 3 AS train_f1, b AS train_loss, a AS val_loss FROM e)
SELECT epoch AS best_epoch, {sql_rnd("val_f1")} AS best_val_f1, {sql_rnd("train_f1 - val_f1")} AS f1_gap, {sql_rnd("val_loss - train_loss")} AS loss_gap
FROM s ORDER BY val_f1 DESC, epoch LIMIT 1""",
)
def training_history_summary(spark, sf):
    """A training log, written as JSON arrays and read back: its best epoch."""
    a, b = F.col("c_acctbal") / 10000.0, F.col("c_nationkey") / 25.0
    values = {"train_loss": b, "val_loss": a, "train_f1_5s": b, "train_f1_15s": b, "train_f1_30s": a, "val_f1_5s": a, "val_f1_15s": b, "val_f1_30s": a * b}
    rows = table(spark, sf, "customer").select("c_custkey", *[v.alias(n) for n, v in values.items()])
    listed = F.sort_array(F.collect_list(F.struct("c_custkey", *values)))
    folder = shared_folder(spark, "history")
    rows.agg(listed.alias("l")).select(*[F.col(f"l.{n}").alias(n) for n in values]).write.json(folder)
    summary = ev.history_summary(ev.training_history(spark, folder))
    return summary.select(F.col("best_epoch").cast("long").alias("best_epoch"), *[rnd(c).alias(c) for c in ("best_val_f1", "f1_gap", "loss_gap")])


@query("evaluation_job", f"WITH {PRED_SQL}, {_overall_sql('horizon')} SELECT 'rule' AS method, horizon, n, {_OVERALL_OUT} FROM o")
def evaluation_job(spark, sf):
    """The whole report of one method, every table written as JSON; the overall metrics are read back."""
    keys = ["horizon", "source", "scenario"]
    rows = predictions(spark, sf)
    tasks = tasks_for(rows, training.ROWS_A_TASK)
    # Many tables are made of the numbered rows: they are numbered once.
    p = stored(row_index(rows, keys, "timestamp", ["timestamp", "event_id"], 10 * 86400, "end_idx", tasks), "predictions")
    folder = shared_folder(spark, "evaluation")
    training.write_report(training.evaluation_report({"rule": p}, scored=["rule"]), folder)
    schema = "method string, horizon string, n bigint, " + ", ".join(f"{m} double" for m in _OVERALL)
    return spark.read.schema(schema).json(f"{folder}/overall").withColumns({m: rnd(m) for m in _OVERALL})
