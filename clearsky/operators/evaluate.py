"""Metrics of multi-class, multi-horizon predictions.

Everything starts from one aggregate per report: the confusion cells, or the
counts per distinct score. Predictions are never collected.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clearsky.operators.ordered import counted_values, exact_quantiles, settled
from clearsky.schemas import CLASS_NAMES
from clearsky.session import cut_lineage

CLASSES = tuple(CLASS_NAMES)


def _add(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _ratio(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.when(whole != 0, part / F.when(whole != 0, whole)).otherwise(F.lit(0.0))


def confusion_cells(
    df: DataFrame, by: Sequence[str] = ("horizon",), truth: str = "y_true", pred: str = "y_pred",
    classes: Sequence[int] = CLASSES,
) -> DataFrame:
    """One row per group with the count of every (truth, prediction) pair as ``c_<t>_<p>``."""
    return df.groupBy(*by).agg(
        *[
            F.sum(((F.col(truth) == t) & (F.col(pred) == p)).cast("long")).alias(f"c_{t}_{p}")
            for t in classes
            for p in classes
        ]
    )


def confusion_matrix(cells: DataFrame, by: Sequence[str] = ("horizon",), classes: Sequence[int] = CLASSES) -> DataFrame:
    """``y_true, y_pred, n, share`` with the share within the true class."""
    rows = [
        F.struct(
            F.lit(t).alias("y_true"),
            F.lit(p).alias("y_pred"),
            F.col(f"c_{t}_{p}").alias("n"),
            _ratio(F.col(f"c_{t}_{p}"), _add([F.col(f"c_{t}_{q}") for q in classes])).alias("share"),
        )
        for t in classes
        for p in classes
    ]
    return cells.select(*by, F.explode(F.array(*rows)).alias("r")).select(*by, "r.*")


class _Cells:
    """Sums over the confusion cells, as columns."""

    def __init__(self, classes: Sequence[int]):
        self.classes = list(classes)
        self.total = _add([F.col(f"c_{t}_{p}") for t in classes for p in classes])
        self.hit = {c: F.col(f"c_{c}_{c}") for c in classes}
        self.true = {c: _add([F.col(f"c_{c}_{p}") for p in classes]) for c in classes}
        self.pred = {c: _add([F.col(f"c_{t}_{c}") for t in classes]) for c in classes}

    def precision(self, c: int) -> Column:
        return _ratio(self.hit[c], self.pred[c])

    def recall(self, c: int) -> Column:
        return _ratio(self.hit[c], self.true[c])

    def f1(self, c: int) -> Column:
        return _ratio(2 * self.hit[c], self.true[c] + self.pred[c])


def class_metrics(cells: DataFrame, by: Sequence[str] = ("horizon",), classes: Sequence[int] = CLASSES) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    m = _Cells(classes)
    rows = [
        F.struct(
            F.lit(c).alias("class"),
            m.precision(c).alias("precision"),
            m.recall(c).alias("recall"),
            m.f1(c).alias("f1"),
            m.true[c].alias("support"),
        )
        for c in classes
    ]
    return cells.select(*by, F.explode(F.array(*rows)).alias("r")).select(*by, "r.*")


def overall_metrics(cells: DataFrame, by: Sequence[str] = ("horizon",), classes: Sequence[int] = CLASSES) -> DataFrame:
    """Accuracy, macro and weighted F1, Cohen's kappa and Matthews correlation.

    The macro mean is over classes that occur as truth or prediction.
    """
    m = _Cells(classes)
    n = m.total
    hits = _add([m.hit[c] for c in classes])
    present = _add([((m.true[c] + m.pred[c]) > 0).cast("int") for c in classes])
    chance = _add([m.true[c] * m.pred[c] for c in classes]).cast("double")
    true_sq = _add([m.true[c] * m.true[c] for c in classes]).cast("double")
    pred_sq = _add([m.pred[c] * m.pred[c] for c in classes]).cast("double")
    n2 = n.cast("double") * n
    spread = F.sqrt(n2 - pred_sq) * F.sqrt(n2 - true_sq)
    return cells.select(
        *by,
        n.alias("n"),
        _ratio(hits, n).alias("accuracy"),
        _ratio(_add([m.f1(c) for c in classes]), present).alias("macro_f1"),
        _ratio(_add([m.f1(c) * m.true[c] for c in classes]), n).alias("weighted_f1"),
        F.when(n2 - chance != 0, (hits * n - chance) / F.when(n2 - chance != 0, n2 - chance)).alias("kappa"),
        _ratio(hits * n - chance, spread).alias("mcc"),
    )


def f1_table(cells: DataFrame, by: str = "horizon", groups: Sequence = (), classes: Sequence[int] = CLASSES) -> DataFrame:
    """Class by horizon table of F1."""
    return (
        class_metrics(cells, [by], classes)
        .groupBy("class")
        .pivot(by, list(groups))
        .agg(F.first("f1"))
    )


def recall_by(df: DataFrame, by: Sequence[str], target: int = 2, truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Recall of one class per group; 0 where the class does not occur."""
    there = F.sum((F.col(truth) == target).cast("long"))
    hit = F.sum(((F.col(truth) == target) & (F.col(pred) == target)).cast("long"))
    return df.groupBy(*by).agg(there.alias("support"), _ratio(hit, there).alias("recall"))


# ---- scores ----------------------------------------------------------------------------------


def class_scores(
    df: DataFrame, by: Sequence[str] = ("horizon",), truth: str = "y_true", prob: str = "y_prob",
    classes: Sequence[int] = CLASSES,
) -> DataFrame:
    """One-vs-rest rows ``class, score, positive`` from probability arrays."""
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("class"),
                F.get(prob, F.lit(i)).cast("double").alias("score"),
                (F.col(truth) == c).cast("long").alias("positive"),
            )
            for i, c in enumerate(classes)
        ]
    )
    return df.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


def score_counts(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per distinct score: hits and false alarms when it is the threshold.

    Groups without any positive or without any negative row are left out.
    """
    counts = counted_values(
        scores, "score", by, {"n": F.lit(1), "positives": F.col("positive")}
    )
    totals = scores.groupBy(*by).agg(
        F.sum("positive").alias("p_total"), (F.count(F.lit(1)) - F.sum("positive")).alias("n_total")
    )
    negatives = F.col("n") - F.col("positives")
    below_neg = F.col("n_cum") - F.col("positives_cum") - negatives
    return (
        counts.join(settled(totals), list(by))
        .where("p_total > 0 and n_total > 0")
        .select(
            *by, "score", "positives", negatives.alias("negatives"), "p_total", "n_total",
            below_neg.alias("negatives_below"),
            (F.col("p_total") - F.col("positives_cum") + F.col("positives")).alias("tp"),
            (F.col("n_total") - below_neg).alias("fp"),
        )
    )


def roc_curve(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """``score, fpr, tpr`` per distinct threshold."""
    return score_counts(scores, by).select(
        *by, "score", (F.col("fp") / F.col("n_total")).alias("fpr"), (F.col("tp") / F.col("p_total")).alias("tpr")
    )


def roc_auc(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Area under the ROC curve; equal scores count half."""
    won = F.col("positives") * (F.col("negatives_below") + F.col("negatives") / 2)
    return score_counts(scores, by).groupBy(*by).agg(
        (F.sum(won) / F.first(F.col("p_total").cast("double") * F.col("n_total"))).alias("auc")
    )


def pr_curve(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """``score, precision, recall`` per distinct threshold."""
    return score_counts(scores, by).select(
        *by,
        "score",
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / F.col("p_total")).alias("recall"),
    )


def average_precision(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Average precision, with the prevalence as the line to beat."""
    gain = F.col("positives") / F.col("p_total") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return score_counts(scores, by).groupBy(*by).agg(
        F.sum(gain).alias("average_precision"),
        F.first(F.col("p_total") / (F.col("p_total") + F.col("n_total"))).alias("prevalence"),
    )


def calibration(scores: DataFrame, by: Sequence[str], bins: int = 10, least_positives: int = 5) -> DataFrame:
    """Mean score and share of positives per quantile bin, with the Brier score.

    Bin edges are exact quantiles; a score belongs to the bin after all inner
    edges below it, empty bins do not appear. Groups with too few positive rows
    are left out.
    """
    by = list(by)
    edges = exact_quantiles(scores, "score", {f"_e{i}": i / bins for i in range(1, bins)}, by)
    stats = scores.groupBy(*by).agg(
        F.sum("positive").alias("_p"),
        F.avg(F.pow(F.col("score") - F.col("positive"), 2)).alias("brier"),
    )
    known = settled(edges.join(stats.where(F.col("_p") >= least_positives), by))
    place = _add([(F.col(f"_e{i}") < F.col("score")).cast("int") for i in range(1, bins)])
    return (
        scores.join(known, by)
        .groupBy(*by, "brier", place.alias("bin"))
        .agg(
            F.avg("score").alias("mean_score"),
            F.avg("positive").alias("positive_share"),
            F.count(F.lit(1)).alias("n"),
        )
    )


# ---- lead time -------------------------------------------------------------------------------


def lead_times(
    df: DataFrame,
    session: Sequence[str],
    index: str,
    truth: str = "y_true",
    pred: str = "y_pred",
    skip: int = 15,
    block_rows: int = 20_000,
    tasks: int | None = None,
) -> DataFrame:
    """Steps between a DEGRADED sample and the latest alert before or at it.

    ``index`` numbers the samples of a session without gaps. After an event
    the next ``skip`` samples are passed over, whether or not it had an alert;
    events without any earlier alert give no row.

    The skipping depends on all earlier events of the session. It is resolved
    block by block: each block works out where scanning resumes after it for
    every possible resume point (at most ``skip`` of them), a small table of one
    row per block chains these, and the blocks then mark their events at once.
    ``tasks`` says into how many tasks the blocks are dealt (else the session's shuffle partitions).
    """
    by = list(session)
    block = F.floor(F.col(index) / block_rows).cast("long")
    rows = df.select(
        *by,
        block.alias("_block"),
        F.col(index).cast("long").alias("_i"),
        (F.col(truth) == 2).alias("_event"),
        (F.col(pred) >= 1).alias("_alert"),
    )
    if tasks:
        rows = rows.repartition(tasks, *by, "_block")
    per_block = rows.groupBy(*by, "_block").agg(
        F.array_sort(F.collect_list(F.when(F.col("_event"), F.col("_i")))).alias("_events"),
        F.array_sort(F.collect_list(F.when(F.col("_alert"), F.col("_i")))).alias("_alerts"),
    )
    per_block = cut_lineage(per_block)  # read twice: to chain the blocks and to mark events
    start = F.col("_block") * block_rows

    def resume(first: Column) -> Column:
        return F.aggregate(
            "_events", first, lambda nxt, e: F.when(e >= nxt, e + skip).otherwise(nxt)
        )

    exits = F.transform(
        F.sequence(F.lit(0), F.lit(skip - 1)),
        lambda o: F.greatest(resume(start + o) - (start + block_rows), F.lit(0)).cast("int"),
    )
    chain_in = per_block.select(
        *by, "_block", exits.alias("_exits"), F.get("_alerts", F.size("_alerts") - 1).alias("_last_alert")
    )
    key_types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema.fields)

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session_, offset, known, previous = None, 0, None, None
        for pdf in batches:
            entry, alert = [], []
            keys = zip(*[pdf[c] for c in by], strict=True)
            for key, at, exits_, last in zip(keys, pdf["_block"], pdf["_exits"], pdf["_last_alert"], strict=True):
                if key != session_:
                    session_, offset, known = key, 0, None
                elif at != previous + 1:
                    offset = 0  # a gap in the numbering is longer than any skip
                entry.append(offset)
                alert.append(known)
                offset = int(exits_[offset])
                known = known if pd.isna(last) else int(last)
                previous = at
            out = pdf[[*by, "_block"]].copy()
            out["_entry"] = pd.array(entry, dtype="Int64")
            out["_known"] = pd.array(alert, dtype="Int64")
            yield out

    # Rows of a session follow each other in one partition: one short row per block.
    in_order = chain_in.repartition(*by).sortWithinPartitions(*by, "_block")
    chained = in_order.mapInPandas(chain, f"{key_types}, _block long, _entry long, _known long")
    taken = F.aggregate(
        "_events",
        F.struct(
            (start + F.col("_entry")).cast("long").alias("next"),
            F.array().cast("array<bigint>").alias("hits"),
        ),
        lambda s, e: F.when(
            e >= s["next"],
            F.struct((e + skip).cast("long").alias("next"), F.concat(s["hits"], F.array(e)).alias("hits")),
        ).otherwise(s),
        lambda s: s["hits"],
    )
    events = per_block.join(chained, [*by, "_block"]).select(
        *by, "_alerts", "_known", F.explode(taken).alias("event_idx")
    )
    inside = F.array_max(F.filter("_alerts", lambda a: a <= F.col("event_idx")))
    latest = F.coalesce(inside, F.col("_known"))
    return events.select(*by, "event_idx", (F.col("event_idx") - latest).alias("lead")).where("lead is not null")


def lead_time_summary(leads: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Events, mean and median lead time."""
    base = leads.groupBy(*by).agg(F.count(F.lit(1)).alias("events"), F.avg("lead").alias("mean_lead"))
    median = exact_quantiles(leads, "lead", {"median_lead": 0.5}, by)
    return base.join(median, list(by)) if by else base.join(F.broadcast(median))


def lead_time_histogram(leads: DataFrame) -> DataFrame:
    """Events per lead time with their share."""
    counts = leads.groupBy("lead").agg(F.count(F.lit(1)).alias("events"))
    total = leads.agg(F.count(F.lit(1)).alias("_all"))
    return counts.join(F.broadcast(total)).select("lead", "events", (F.col("events") / F.col("_all")).alias("density"))


# ---- intervals, comparison, history ----------------------------------------------------------


def bootstrap_intervals(
    cells: DataFrame, by: Sequence[str] = ("horizon",), draws: int = 1000, alpha: float = 0.05, seed: int = 42,
    classes: Sequence[int] = CLASSES,
) -> DataFrame:
    """Percentile intervals of macro F1, MCC and kappa.

    Resampling n predictions with replacement only changes the confusion cells,
    whose counts then follow a multinomial law. So every draw is one multinomial
    draw over the cells: the cost does not depend on the number of predictions.
    """
    names = [f"c_{t}_{p}" for t in classes for p in classes]
    numbered = cells.withColumn("_key", F.xxhash64(*by) if by else F.lit(0).cast("long")).withColumn(
        "_draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))
    )

    def resample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            drawn = []
            for key, draw, row in zip(pdf["_key"], pdf["_draw"], pdf[names].to_numpy(), strict=True):
                rng = np.random.default_rng([seed, int(key) & 0xFFFFFFFF, int(draw)])
                total = int(row.sum())
                drawn.append(rng.multinomial(total, row / total) if total else row)
            pdf[names] = np.array(drawn, dtype="int64").reshape(len(pdf), len(names))
            yield pdf

    draws_df = numbered.repartition(*by, "_draw").mapInPandas(resample, numbered.schema)
    metrics = overall_metrics(draws_df, [*by, "_draw"], classes).na.fill(0.0, subset=["kappa"])
    low, high = alpha / 2, 1 - alpha / 2
    # A group holds exactly ``draws`` rows here.
    return metrics.groupBy(*by).agg(
        *[
            F.percentile(m, F.lit(p)).alias(f"{m}_{side}")
            for m in ("macro_f1", "mcc", "kappa")
            for side, p in (("low", low), ("high", high))
        ]
    )


def model_comparison(results: dict[str, DataFrame], horizons: Sequence, by: str = "horizon", metric: str = "macro_f1") -> DataFrame:
    """Method by horizon table of one metric."""
    parts = [df.select(F.lit(name).alias("method"), by, metric) for name, df in results.items()]
    stacked = reduce(lambda a, b: a.unionByName(b), parts)
    return stacked.groupBy("method").pivot(by, list(horizons)).agg(F.first(metric))


def training_history(spark: SparkSession, path: str) -> DataFrame:
    """Epoch rows from a training log of equally long arrays."""
    raw = spark.read.option("multiLine", True).json(path)
    arrays = [f.name for f in raw.schema.fields if f.dataType.typeName() == "array"]
    zipped = raw.select(F.posexplode(F.arrays_zip(*arrays)).alias("epoch", "r"))
    return zipped.select((F.col("epoch") + 1).alias("epoch"), *[F.col(f"r.{a}").cast("double").alias(a) for a in arrays])


def history_summary(history: DataFrame, horizons: Sequence[str] = ("5s", "15s", "30s")) -> DataFrame:
    """Best epoch by mean validation F1, and the gap between training and validation there."""
    val = _add([F.col(f"val_f1_{h}") for h in horizons]) / len(horizons)
    train = _add([F.col(f"train_f1_{h}") for h in horizons]) / len(horizons)
    scored = history.select("epoch", val.alias("val_f1"), train.alias("train_f1"), "train_loss", "val_loss")
    best = F.max_by(F.struct("epoch", "val_f1", "train_f1", "train_loss", "val_loss"), F.struct("val_f1", -F.col("epoch")))
    return scored.agg(best.alias("b")).select(
        F.col("b.epoch").alias("best_epoch"),
        F.col("b.val_f1").alias("best_val_f1"),
        (F.col("b.train_f1") - F.col("b.val_f1")).alias("f1_gap"),
        (F.col("b.val_loss") - F.col("b.train_loss")).alias("loss_gap"),
    )
