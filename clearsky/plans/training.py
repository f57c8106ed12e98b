"""Second and third job: labelled table to windows, windows to baselines and metrics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearsky.operators import evaluate as ev
from clearsky.operators import models
from clearsky.operators.oversample import oversample_windows
from clearsky.operators.prep import (
    apply_min_max,
    fit_min_max,
    flatten_windows,
    impute,
    scaler_table,
    training_windows,
)
from clearsky.operators.tables import clip, feature_columns, first_rows, repaired_splits
from clearsky.schemas import HORIZONS, SESSION
from clearsky.session import cut_lineage, tasks_for
from clearsky.sinks import reuse_or_build, save_scaler, write_metrics

ROWS_A_TASK = 100_000  # predictions that are numbered, or searched for lead times, in one task


def prepared(
    labelled: DataFrame,
    session: Sequence[str] = tuple(SESSION),
    ts: str = "timestamp",
    max_rows_per_source: int | None = None,
    scaler_path: str | None = None,
) -> tuple[DataFrame, list[str]]:
    """Filled, clipped and scaled rows with the order of their features."""
    rows = repaired_splits(labelled)
    if max_rows_per_source is not None:
        rows = first_rows(rows, ["source"], ts, max_rows_per_source)
    filled = clip(impute(rows, session, ts))
    names = feature_columns(filled)
    # The filled rows are read twice: to fit the scaler and to apply it.
    filled = cut_lineage(filled)
    params = fit_min_max(filled, names)
    if scaler_path is not None:
        save_scaler(scaler_table(params, names, ("min", "range")), scaler_path)
    return apply_min_max(filled, params, names), names


def window_job(
    labelled: DataFrame,
    path: str,
    session: Sequence[str] = tuple(SESSION),
    ts: str = "timestamp",
    oversampled: bool = True,
    force: bool = False,
    max_rows_per_source: int | None = None,
    scaler_path: str | None = None,
    **windows,
) -> DataFrame:
    """Windows of all splits, stored below ``path``; reused for the same parameters unless ``force``."""

    def build() -> DataFrame:
        rows, names = prepared(labelled, session, ts, max_rows_per_source, scaler_path)
        made = training_windows(rows, names, session, ts, keep=["split"], **windows)
        if not oversampled:
            return made
        return oversample_windows(cut_lineage(made), horizons=windows.get("horizons", HORIZONS))

    parameters = {"session": list(session), "ts": ts, "oversampled": oversampled, "max_rows_per_source": max_rows_per_source, **windows}
    return reuse_or_build(labelled.sparkSession, path, build, force, parameters)


def baseline_predictions(
    windows: DataFrame,
    horizons: Sequence[int] = HORIZONS,
    forest: dict | None = None,
    boosting: dict | None = None,
    signal: tuple[int, float, float] | None = None,
    session: Sequence[str] = tuple(SESSION),
    split: str = "test",
) -> dict[str, DataFrame]:
    """Predictions per method on one split: session, ``end_idx``, ``horizon, y_true, y_pred, y_prob``.

    Majority class, C/N0 rule, random forest and boosted trees. ``signal`` is the place of the mean
    C/N0 among the features, with the least value and the range it was scaled by; without it
    the rule is left out, for its thresholds are in dB-Hz. Probabilities are null where a
    method has none. Each table is cut from its lineage: models are fitted and applied once.
    """
    flat = flatten_windows(windows)
    train, test = flat.where("split = 'train'"), flat.where(F.col("split") == split)
    keep = [c for c in (*session, "end_idx") if c in windows.columns]
    names = [f"{h}s" for h in horizons]
    truths = {name: f"y_{name}" for name in names}
    none = F.lit(None).cast("array<double>").alias("y_prob")

    def stacked(predicted: dict[str, DataFrame]) -> DataFrame:
        parts = [
            df.select(*keep, F.lit(h).alias("horizon"), F.col(truths[h]).alias("y_true"), F.col("y_pred").cast("int").alias("y_pred"), none)
            for h, df in predicted.items()
        ]
        return reduce(lambda a, b: a.unionByName(b), parts)

    out = {"MajorityClass": stacked({h: models.majority_class(train, test, y) for h, y in truths.items()})}
    if signal is not None:
        place, least, width = signal
        unscaled = F.transform("X", lambda step: F.array(F.get(step, F.lit(place)).cast("double") * width + least))
        ruled = models.cnr_rule_baseline(test.withColumn("X", unscaled), 0)
        out["CNR_Threshold"] = stacked({h: ruled for h in names})
    fitted = {
        "RandomForest": {h: models.random_forest(train, y, **(forest or {})) for h, y in truths.items()},
        "BoostedTrees": {h: models.boosted_trees(train, y, **(boosting or {})) for h, y in truths.items()},
    }
    for method, of_horizon in fitted.items():
        scored = models.score_horizons(of_horizon, test, truths, keep=keep)
        out[method] = scored.withColumn("y_pred", F.col("y_pred").cast("int"))
    return {method: cut_lineage(df) for method, df in out.items()}


def metric_report(predictions: dict[str, DataFrame], horizons: Sequence[int] = HORIZONS) -> dict[str, DataFrame]:
    """Overall metrics, intervals and the comparison table of several methods."""
    cells = {name: ev.confusion_cells(df) for name, df in predictions.items()}
    overall = {name: ev.overall_metrics(c) for name, c in cells.items()}
    labels = [f"{h}s" for h in horizons]
    return {
        "overall": _by_method(overall),
        "per_class": _by_method({n: ev.class_metrics(c) for n, c in cells.items()}),
        "intervals": _by_method({n: ev.bootstrap_intervals(c) for n, c in cells.items()}),
        "comparison": ev.model_comparison(overall, labels),
    }


def _by_method(frames: dict[str, DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [d.select(F.lit(n).alias("method"), "*") for n, d in frames.items()])


def evaluation_report(
    predictions: dict[str, DataFrame],
    horizons: Sequence[int] = HORIZONS,
    session: Sequence[str] = tuple(SESSION),
    scored: Sequence[str] = ("RandomForest", "BoostedTrees"),
    history_path: str | None = None,
) -> dict[str, DataFrame]:
    """Everything the evaluation tells, as one table each with a ``method`` column.

    :func:`metric_report` and: confusion matrices, F1 by class and horizon, metrics by source, recall of
    DEGRADED by scenario, lead times with summary and histogram; for the ``scored`` methods ROC and
    precision-recall curves with their areas, and calibration; the training history where there is one.
    """
    labels = [f"{h}s" for h in horizons]
    tasks = {n: tasks_for(df, ROWS_A_TASK) for n, df in predictions.items()}
    cells = {n: ev.confusion_cells(df) for n, df in predictions.items()}
    by_source = {n: ev.overall_metrics(ev.confusion_cells(df, ["horizon", "source"]), ["horizon", "source"]) for n, df in predictions.items()}
    leads = {n: cut_lineage(ev.lead_times(df, ["horizon", *session], "end_idx", tasks=tasks[n])) for n, df in predictions.items()}
    with_scores = {n: cut_lineage(ev.class_scores(predictions[n])) for n in scored if n in predictions}
    by = ["horizon", "class"]
    out = metric_report(predictions, horizons) | {
        "confusion": _by_method({n: ev.confusion_matrix(c) for n, c in cells.items()}),
        "f1_by_horizon": _by_method({n: ev.f1_table(c, groups=labels) for n, c in cells.items()}),
        "by_source": _by_method(by_source),
        "degraded_recall": _by_method({n: ev.recall_by(df, ["horizon", "scenario"]) for n, df in predictions.items()}),
        "lead_times": _by_method({n: ev.lead_time_summary(df, ["horizon"]) for n, df in leads.items()}),
        "lead_histogram": _by_method({n: ev.lead_time_histogram(df) for n, df in leads.items()}),
    }
    for name, table in (
        ("roc", ev.roc_curve), ("roc_auc", ev.roc_auc), ("pr", ev.pr_curve),
        ("average_precision", ev.average_precision), ("calibration", ev.calibration),
    ):
        if with_scores:
            out[name] = _by_method({n: table(df, by) for n, df in with_scores.items()})
    if history_path is not None:
        history = ev.training_history(next(iter(predictions.values())).sparkSession, history_path)
        out |= {"history": history, "history_summary": ev.history_summary(history, labels)}
    return out


def write_report(report: dict[str, DataFrame], path: str) -> None:
    """Every table of a report as JSON below its name."""
    for name, table in report.items():
        write_metrics(table, f"{path.rstrip('/')}/{name}")
