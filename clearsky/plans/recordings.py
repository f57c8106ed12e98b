"""First job: recordings to a labelled feature table with splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearsky.functions.labels import label_name, quality_label, sigma_label
from clearsky.operators.asof import merge_signal
from clearsky.operators.features import window_features
from clearsky.operators.prep import session_split, session_splits
from clearsky.operators.tables import (
    as_epochs,
    first_source,
    observation_only_epochs,
    resample_first,
    union_sources,
)
from clearsky.schemas import SESSION


def tagged_by_folder(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``source`` and ``scenario`` from a table ``folder, source, scenario``.

    ``folder`` is the last part of the path above the file.
    """
    folder = F.regexp_extract("path", r"([^/]+)/[^/]*$", 1)
    return df.withColumn("folder", folder).join(rules, "folder")


def labelled(features: DataFrame, label: Column | None = None) -> DataFrame:
    """Add ``label`` (the null-aware rule unless given) and ``label_name``."""
    rule = quality_label() if label is None else label
    return features.withColumn("label", rule).withColumn("label_name", label_name(F.col("label")))


def receiver_features(
    fixes: DataFrame, signal: DataFrame | None, session: Sequence[str] = tuple(SESSION), **windows
) -> DataFrame:
    """Receiver recordings: fixes with the observations of the same session, windowed and labelled.

    Both inputs carry the session columns; ``signal`` is in GPS time.
    """
    epochs = merge_signal(fixes, signal, session)
    return labelled(window_features(as_epochs(epochs), session, **windows))


def observation_features(
    signal: DataFrame, kind: str | None, session: Sequence[str] = tuple(SESSION), **windows
) -> DataFrame:
    """Sources with observations only."""
    epochs = observation_only_epochs(signal, kind)
    return labelled(window_features(as_epochs(epochs), session, **windows))


def campus_features(epochs: DataFrame, session: Sequence[str] = tuple(SESSION), **windows) -> DataFrame:
    """Campus fixes with position errors: one row a second, labels from the errors."""
    columns = ["lat", "lon", "alt", "lat_sigma", "lon_sigma", "num_satellites", "fix_quality"]
    seconds = resample_first(epochs, session, "timestamp", columns, required="lat")
    features = window_features(_no_geometry(as_epochs(seconds)), session, **windows)
    return labelled(features, sigma_label(2.0, 5.0, 1, 0))


def vehicle_features(fixes: DataFrame, session: Sequence[str] = tuple(SESSION), **windows) -> DataFrame:
    """Vehicle fixes with sigmas: one row a second, labels from the sigmas."""
    columns = ["lat", "lon", "alt", "lat_sigma", "lon_sigma", "num_satellites", "fix_quality"]
    seconds = resample_first(fixes, session, "timestamp", columns, required="lat")
    features = window_features(_no_geometry(as_epochs(seconds)), session, **windows)
    return labelled(features, sigma_label())


def _no_geometry(epochs: DataFrame) -> DataFrame:
    """Defaults of sources that have no such columns at all."""
    return epochs.withColumns(
        {
            "pdop": F.lit(2.5),
            "hdop": F.lit(1.5),
            "vdop": F.lit(1.5),
            "solution_age": F.lit(0.0),
            "cycle_slips_epoch": F.lit(0.0),
        }
    )


def combined(parts: Sequence[DataFrame], seed: str = "42") -> DataFrame:
    """All sources as one table with whole sessions assigned to splits."""
    rows = union_sources(parts)
    return session_split(rows, session_splits(first_source(rows), seed=seed))
