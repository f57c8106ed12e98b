"""The first-generation job as one graph: solution files to labelled rows to scaled splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from clearsky.functions.labels import legacy_label
from clearsky.operators.features import legacy_features
from clearsky.operators.oversample import oversample_rows
from clearsky.operators.prep import apply_standard, encode_labels, fit_standard, source_split, temporal_split
from clearsky.schemas import FEATURES


def labelled_solutions(fixes: DataFrame, session: Sequence[str] = ("source",), **windows) -> DataFrame:
    """Features over the 30 rows before each fix, with the label name."""
    return legacy_features(fixes, session, **windows).withColumn("label", legacy_label())


def scaled_splits(
    labelled: DataFrame, order: Sequence[str], by_source: bool = False, features: Sequence[str] = tuple(FEATURES)
) -> tuple[DataFrame, DataFrame]:
    """(rows with split and scaled features, fitted parameters)."""
    split = source_split(labelled) if by_source else temporal_split(labelled, order)
    params = fit_standard(split, features)
    return apply_standard(split, params, features), params


def balanced_training_rows(scaled: DataFrame, features: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """Training rows with encoded labels, oversampled when a class is rare."""
    train = encode_labels(scaled.where("split = 'train'"), "label")
    return oversample_rows(train, features, "label_code")
