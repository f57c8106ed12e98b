"""Baselines: majority class, expert rule, tree ensembles, scoring, importance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearsky.functions.labels import cnr_rule
from clearsky.functions.scalars import argmax, softmax
from clearsky.operators.boosting import BoostedTrees, fit_boosted_trees
from clearsky.operators.forest import Forest, fit_forest
from clearsky.operators.ordered import attach


def majority_class(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Predict the most frequent training class, the lowest one on ties."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.max_by(label, F.struct("n", -F.col(label))).alias("y_pred"))
    return attach(test, top)


def cnr_rule_baseline(windows: DataFrame, position: int, column: str = "X") -> DataFrame:
    """Expert rule on the window mean of the unscaled C/N0 feature at ``position``.

    The same prediction holds for every horizon. Scaled windows must not be
    used: the thresholds are in dB-Hz.
    """
    values = F.transform(column, lambda step: F.get(step, F.lit(position)).cast("double"))
    mean = F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(column)
    return windows.withColumn("y_pred", cnr_rule(mean))


def _assembled(df: DataFrame, features: str) -> DataFrame:
    return df.withColumn("_features", array_to_vector(F.col(features).cast("array<double>")))


def random_forest(
    train: DataFrame, label: str, features: str = "features", trees: int = 500, depth: int = 30, seed: int = 42
) -> Forest:
    """Class-balanced forest with at least five rows per leaf (see ``forest.py``).

    ``features`` is an array column. Spark's forest adds up a full histogram per node and partition, which
    is most of its time where trees are deep; this one finishes nodes whose rows fit a task in one task.
    """
    return fit_forest(train, label, features, trees, depth, least_rows=5, seed=seed)


def boosted_trees(
    train: DataFrame, label: str, features: str = "features", rounds: int = 400, depth: int = 6,
    rate: float = 0.05, seed: int = 42,
) -> BoostedTrees:
    """Class-balanced boosted trees: one model for all classes (see ``boosting.py``)."""
    return fit_boosted_trees(train, label, features, rounds, depth, rate, seed=seed)


def score(model: Transformer | BoostedTrees | Forest, df: DataFrame, features: str = "features") -> DataFrame:
    """``y_pred`` and ``y_prob`` (one number per class) of each row."""
    if isinstance(model, (BoostedTrees, Forest)):
        return model.score(df, features)
    out = model.transform(_assembled(df, features))
    if "probability" in out.columns:
        prob: Column = vector_to_array("probability")
    else:
        prob = softmax(vector_to_array("rawPrediction"))
    return out.withColumn("y_prob", prob).withColumn("y_pred", argmax(F.col("y_prob"))).drop(
        "_features", "probability", "rawPrediction", "prediction"
    )


def score_horizons(
    models: dict[str, Transformer | BoostedTrees | Forest], df: DataFrame, truths: dict[str, str], features: str = "features", keep: Sequence[str] = ()
) -> DataFrame:
    """Predictions of one model per horizon, stacked with ``horizon`` and ``y_true``.

    All models run over one pass of the rows: each adds its scores beside those of the others, and
    the row is then unfolded into one per horizon.
    """
    rows = df.select(*keep, features, *dict.fromkeys(truths[h] for h in models))
    for i, model in enumerate(models.values()):
        rows = score(model, rows, features).withColumnsRenamed({"y_pred": f"_pred_{i}", "y_prob": f"_prob_{i}"})
    each = [
        F.struct(
            F.lit(h).alias("horizon"), F.col(truths[h]).alias("y_true"), F.col(f"_pred_{i}").alias("y_pred"), F.col(f"_prob_{i}").alias("y_prob")
        )
        for i, h in enumerate(models)
    ]
    return rows.select(*keep, F.inline(F.array(*each)))


def ensemble_importance(model: Model | Forest, names: Sequence[str], df: DataFrame, top: int = 15) -> DataFrame:
    """The model's own importances, the ``top`` ones, as a share of the largest."""
    values = [float(v) for v in model.featureImportances.toArray()]
    rows = df.sparkSession.createDataFrame(list(zip(names, values, strict=True)), "feature string, importance double")
    return _top_share(rows, top)


def _top_share(rows: DataFrame, top: int) -> DataFrame:
    largest = rows.agg(F.max("importance").alias("_top"))
    share = F.when(F.col("_top") > 0, F.col("importance") / F.when(F.col("_top") > 0, F.col("_top")))
    related = attach(rows, largest).select("feature", "importance", share.alias("relative"))
    return related.orderBy(F.desc("importance"), "feature").limit(top)


def permutation_importance(
    model: Transformer | BoostedTrees | Forest, df: DataFrame, names: Sequence[str], label: str, row_id: str, features: str = "features",
    top: int = 15, seed: int = 42,
) -> DataFrame:
    """How much accuracy is lost when one feature is shuffled among the rows.

    Rows are numbered twice, in two hashed orders; partner rows of the two
    numberings exchange their features. One pairing serves all features: a
    scoring pass takes the rows once per feature with that value replaced.
    """
    from clearsky.operators.ordered import hash_chunk, running_sums

    def hashed(salt: int, name: str, frame: DataFrame) -> DataFrame:
        key = F.xxhash64(F.lit(seed), F.lit(salt), F.col(row_id))
        keyed = frame.withColumn("_key", key).withColumn("_chunk", hash_chunk(frame, "_key"))
        return running_sums(keyed, [], "_chunk", ["_key", row_id], {name: F.lit(1).cast("long")})

    base = df.select(row_id, features, label)
    left = hashed(1, "_at", base).drop("_key", "_chunk")
    right = hashed(2, "_at", base).select("_at", F.col(features).alias("_other"))
    paired = left.join(right, "_at")
    positions = F.explode(F.sequence(F.lit(-1), F.lit(len(names) - 1)))  # -1: unchanged
    mixed = paired.withColumn("_i", positions).withColumn(
        features,
        F.transform(
            features,
            lambda v, i: F.when(i == F.col("_i"), F.get("_other", i)).otherwise(v),
        ),
    )
    hits = (
        score(model, mixed.drop("_other"), features)
        .groupBy("_i")
        .agg(F.avg((F.col("y_pred") == F.col(label)).cast("double")).alias("_accuracy"))
    )
    plain = hits.where("_i = -1").select(F.col("_accuracy").alias("_plain"))
    name_of = F.get(F.array(*[F.lit(n) for n in names]), F.col("_i"))
    losses = attach(hits.where("_i >= 0"), plain).select(
        name_of.alias("feature"), F.greatest(F.col("_plain") - F.col("_accuracy"), F.lit(0.0)).alias("importance")
    )
    return _top_share(losses, top)
