"""Live epochs: deduplication, time buckets, exact trailing features, sessions, class changes.

Input is a stream of epoch rows with a session key and an event time. Late rows
are bounded by a watermark; state is bounded by the window length. Trailing features
and class changes chain: the event time of the one is that of the other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from clearsky.functions.labels import label_name, quality_label
from clearsky.operators.features import finish_features
from clearsky.operators.ordered import micros
from clearsky.schemas import WINDOW_SECONDS
from clearsky.streaming.trailing import CURRENT, FIELDS, HISTORY, LATEST, TrailingWindow


def without_duplicates(epochs: DataFrame, keys: Sequence[str], ts: str, lateness: str = "10 seconds") -> DataFrame:
    """Drop epochs that arrive again within the lateness."""
    return epochs.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([*keys, ts])


def bucket_features(
    epochs: DataFrame, keys: Sequence[str], ts: str, width: str = "30 seconds", slide: str | None = "1 second",
    lateness: str = "10 seconds",
) -> DataFrame:
    """Signal statistics per time bucket (sliding, or tumbling without ``slide``)."""
    bucket = F.window(ts, width, slide) if slide else F.window(ts, width)
    return (
        epochs.withWatermark(ts, lateness)
        .groupBy(*keys, bucket.alias("bucket"))
        .agg(
            F.count(F.lit(1)).alias("epochs"),
            F.avg("mean_cnr_epoch").alias("mean_cnr"),
            F.min("mean_cnr_epoch").alias("min_cnr"),
            F.max("mean_cnr_epoch").alias("max_cnr"),
            F.avg("num_satellites").alias("sat_mean"),
            F.min("num_satellites").alias("sat_min"),
        )
        .select(*keys, F.col("bucket.start").alias("start"), F.col("bucket.end").alias("end"),
                "epochs", "mean_cnr", "min_cnr", "max_cnr", "sat_mean", "sat_min")
    )


def recording_sessions(
    epochs: DataFrame, keys: Sequence[str], ts: str, gap: str = "60 seconds", lateness: str = "10 seconds"
) -> DataFrame:
    """Recordings told apart by pauses longer than ``gap``."""
    return (
        epochs.withWatermark(ts, lateness)
        .groupBy(*keys, F.session_window(ts, gap).alias("recording"))
        .agg(F.count(F.lit(1)).alias("epochs"), F.avg("mean_cnr_epoch").alias("mean_cnr"))
        .select(*keys, F.col("recording.start").alias("start"), F.col("recording.end").alias("end"), "epochs", "mean_cnr")
    )


# ---- exact trailing features ------------------------------------------------------------------


def _micros_of(df: DataFrame, interval: str) -> int:
    """Microseconds of an interval text, read as Spark reads the watermark's."""
    epoch = F.timestamp_micros(F.lit(0))
    one = df.sparkSession.range(1).select(F.unix_micros(epoch + F.lit(interval).cast("interval")))
    return one.first()[0]


def trailing_features(
    epochs: DataFrame, keys: Sequence[str], ts: str, window_seconds: float = WINDOW_SECONDS, lateness: str = "10 seconds",
    cnr_fallback: bool = True,
) -> DataFrame:
    """The 35 features of each arriving epoch over its trailing window.

    The state hands out the summary of each epoch's window, a row of fixed width; the final
    arithmetic is that of the batch features. ``ts`` stays the event time of what comes after.
    """
    schema = epochs.schema
    slim = epochs.withWatermark(ts, lateness).select(
        *keys, ts, micros(ts).alias("epoch_us"), *[F.col(c).cast("double").alias(c) for c in [*HISTORY, *CURRENT]]
    )
    out_schema = T.StructType(
        [
            schema[ts],
            T.StructField("epoch_us", T.LongType()),
            *[T.StructField(c, T.DoubleType()) for c in [*CURRENT, *LATEST, *FIELDS]],
            *[schema[k] for k in keys],
        ]
    )
    windows = slim.groupBy(*keys).transformWithStateInPandas(
        TrailingWindow(keys, ts, window_seconds, _micros_of(epochs, lateness)),
        out_schema,
        "Append",
        "EventTime",
        eventTimeColumnName=ts,
    )
    col = F.col

    def of(n: str, value: Column, least: int = 1) -> Column:
        return F.when(col(n) >= least, value)

    def sample_variance(name: str, n: str | None = None) -> Column:
        n = n or f"{name}_n"
        return of(n, col(f"{name}_m2") / F.greatest(col(n) - 1, F.lit(1.0)), 2)

    n_cnr = col("cnr_n")
    covered = col("cnr_placed") - (n_cnr - 1) / 2.0 * n_cnr * col("cnr_mean")
    spread = n_cnr * (n_cnr * n_cnr - 1) / 12.0
    framed = windows.where("rows >= 2").select(
        *keys, ts, *CURRENT, "num_satellites", "solution_age", col("fix_quality").cast("int").alias("fix_quality"),
        col("epoch_us").alias("_us"), col("first_us").cast("long").alias("_first_us"),
        of("lat_n", col("lat_mean")).alias("_lat_std"), of("lon_n", col("lon_mean")).alias("_lon_std"),
        sample_variance("lat").alias("_lat_var"), sample_variance("lon").alias("_lon_var"), col("lat_n").alias("_lat_n"),
        of("cnr_n", col("cnr_mean")).alias("_cnr_mean"), of("cnr_n", col("cnr_min")).alias("_cnr_min"),
        of("cnr_n", col("cnr_max")).alias("_cnr_max"),
        of("cnr_n", F.sqrt(col("cnr_m2") / F.greatest(n_cnr, F.lit(1.0)))).alias("_cnr_std"),
        F.when(n_cnr >= 3, covered / F.when(n_cnr >= 3, spread)).otherwise(F.lit(0.0)).alias("_cnr_trend"),
        of("sat_n", col("sat_mean")).alias("_sat_mean"), of("sat_n", col("sat_min")).alias("_sat_min"),
        col("sat_n").alias("_sat_n"), col("sat_drop").alias("_sat_drop"),
        (col("fix_ok") / col("rows")).alias("_fix_share"), col("fix_changes").alias("_fix_changes"),
        col("age_n").alias("_age_n"), col("age_steps").alias("_age_steps"),
        of("rms_n", col("rms_mean")).alias("_rms_mean"), F.sqrt(sample_variance("rms")).alias("_rms_std"), col("rms_n").alias("_rms_n"),
        col("gbs_mean").alias("_gbs_mean"), F.sqrt(sample_variance("gbs", "rows")).alias("_gbs_std"), col("gbs_n").alias("_gbs_n"),
    )
    return finish_features(framed, keys, ts, (), cnr_fallback)


# ---- class changes ------------------------------------------------------------------------------


class ClassChange(StatefulProcessor):
    """Emits a row when the class of a session differs from the one before.

    Rows wait in state until the watermark has passed them, so they are compared in the order
    of their times, however they arrive. One timer stands at the earliest waiting row; once
    nothing waits it stands ``idle_us`` past the latest row, and the session is forgotten then.
    """

    def __init__(self, keys: Sequence[str], ts: str, idle_us: int):
        self.keys, self.ts, self.idle_us = list(keys), ts, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, label int")
        self.last = handle.getValueState("last", "us long, label int")

    def _wake_at(self, us: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, (list, tuple)) else timer)
        self.handle.registerTimer(-(-us // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        self.waiting.appendList([(int(us), int(label)) for us, label in zip(new["epoch_us"], new["label"], strict=True)])
        self._wake_at(min(us for us, _ in self.waiting.get()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get(), key=lambda r: r[0]) if self.waiting.exists() else []
        last = self.last.get() if self.last.exists() else None
        ready = [r for r in rows if r[0] <= passed]
        rest = rows[len(ready) :]
        out = []
        for us, label in ready:
            if last is not None and us - last[0] > self.idle_us:
                last = None  # the session had been forgotten by then
            if last is not None and label != last[1]:
                out.append((*key, pd.Timestamp(us, unit="us"), int(last[1]), int(label)))
            last = (us, label)
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if last is not None and not rest and last[0] + self.idle_us <= passed:
            self.last.clear()
        elif last is not None:
            self.last.update((int(last[0]), int(last[1])))
            self._wake_at(rest[0][0] if rest else last[0] + self.idle_us)
        elif rest:
            self._wake_at(rest[0][0])
        yield pd.DataFrame(out, columns=[*self.keys, self.ts, "label_before", "label"])

    def close(self) -> None:
        pass


def class_changes(labelled: DataFrame, keys: Sequence[str], ts: str, idle: str = "1 hour") -> DataFrame:
    """Alerts from a stream of labelled epochs (``label`` 0/1/2) whose event time is ``ts``.

    ``labelled`` needs a watermark on ``ts``: its own, or the one that :func:`trailing_features`
    hands on. A session without rows for longer than ``idle`` starts anew.
    """
    fields = [
        *[labelled.schema[k] for k in keys],
        labelled.schema[ts],
        T.StructField("label_before", T.IntegerType()),
        T.StructField("label", T.IntegerType()),
    ]
    changes = (
        labelled.select(*keys, ts, micros(ts).alias("epoch_us"), "label")
        .groupBy(*keys)
        .transformWithStateInPandas(
            ClassChange(keys, ts, _micros_of(labelled, idle)),
            T.StructType(fields),
            "Append",
            "EventTime",
        )
    )
    return changes.withColumn("alert", label_name(F.col("label")))


def live_labels(features: DataFrame) -> DataFrame:
    """Quality label of each feature row."""
    return features.withColumn("label", quality_label())
