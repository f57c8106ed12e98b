"""Trailing windows as mergeable summaries in state.

A window of a session is told by a *summary* of fixed width: counts, means, squared
deviations, extremes, sums of steps. Two summaries of neighbouring stretches merge into
that of both, so the summary of a window is merged from stretches:

* the state holds a session's rows in *buckets* of time (the window is ``BUCKETS`` of them
  long) and one summary per bucket;
* inside a bucket running summaries from the left serve the rows that end there, those from
  the right serve windows that begin there;
* the buckets between go through a queue of two stacks.

Each row costs a bounded number of merges, whatever the rate: two for itself, and three
for each bucket entered or left. A late row touches its own bucket only. Buckets that no
window can reach any more leave the state.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from math import hypot, isnan, nan

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

BUCKETS = 32

# Columns whose history the features need, and those of which the current value is enough.
HISTORY = [
    "mean_cnr_epoch", "num_satellites", "fix_quality", "solution_age", "lat_sigma", "lon_sigma",
    "rms_error", "gbs_lat_err", "gbs_lon_err",
]
CURRENT = ["lat", "lon", "alt", "hdop", "pdop", "vdop", "cycle_slips_epoch"]
LATEST = ["num_satellites", "solution_age", "fix_quality"]

FIELDS = [
    "rows", "first_us",
    "cnr_n", "cnr_mean", "cnr_m2", "cnr_min", "cnr_max", "cnr_placed",
    "sat_n", "sat_mean", "sat_min", "sat_drop", "sat_first", "sat_last",
    "fix_ok", "fix_changes", "fix_first", "fix_last",
    "age_n", "age_steps", "age_first", "age_last",
    "lat_n", "lat_mean", "lat_m2", "lon_n", "lon_mean", "lon_m2",
    "rms_n", "rms_mean", "rms_m2", "gbs_mean", "gbs_m2", "gbs_n",
]
Summary = tuple


def single(us: int, cells: Sequence[float]) -> Summary:
    """Summary of one row; NaN marks a missing value."""
    cnr, sat, fix, age, lat, lon, rms, gbs_lat, gbs_lon = cells
    has_cnr, has_sat, has_age, has_lat, has_lon, has_rms = (0.0 if isnan(x) else 1.0 for x in (cnr, sat, age, lat, lon, rms))
    fix = 0.0 if isnan(fix) else fix
    gbs = hypot(0.0 if isnan(gbs_lat) else gbs_lat, 0.0 if isnan(gbs_lon) else gbs_lon)
    known = lambda has, x: x if has else 0.0
    return (
        1.0, float(us),
        has_cnr, known(has_cnr, cnr), 0.0, cnr, cnr, 0.0,
        has_sat, known(has_sat, sat), sat, 0.0, sat, sat,
        float(fix >= 1), 0.0, fix, fix,
        has_age, 0.0, age, age,
        has_lat, known(has_lat, lat), 0.0, has_lon, known(has_lon, lon), 0.0,
        has_rms, known(has_rms, rms), 0.0, gbs, 0.0, 0.0 if isnan(gbs_lat) else 1.0,
    )


def _moments(n1: float, mean1: float, m1: float, n2: float, mean2: float, m2: float) -> tuple[float, float, float]:
    n = n1 + n2
    if not n:
        return 0.0, 0.0, 0.0
    gap = mean2 - mean1
    return n, mean1 + gap * n2 / n, m1 + m2 + gap * gap * n1 * n2 / n


def _least(a: float, b: float) -> float:
    return b if isnan(a) or b < a else a


def _greatest(a: float, b: float) -> float:
    return b if isnan(a) or b > a else a


def merge(a: Summary | None, b: Summary | None) -> Summary | None:
    """Summary of a stretch and the one that follows it."""
    if a is None or b is None:
        return b if a is None else a
    (
        rows_a, first_us, cn_a, cm_a, cs_a, cmin_a, cmax_a, cp_a, sn_a, sm_a, smin_a, sd_a, sf_a, sl_a,
        ok_a, ch_a, ff_a, fl_a, an_a, as_a, af_a, al_a,
        ln_a, lm_a, ls_a, on_a, om_a, os_a, rn_a, rm_a, rs_a, gm_a, gs_a, gn_a,
    ) = a
    (
        rows_b, _, cn_b, cm_b, cs_b, cmin_b, cmax_b, cp_b, sn_b, sm_b, smin_b, sd_b, sf_b, sl_b,
        ok_b, ch_b, ff_b, fl_b, an_b, as_b, af_b, al_b,
        ln_b, lm_b, ls_b, on_b, om_b, os_b, rn_b, rm_b, rs_b, gm_b, gs_b, gn_b,
    ) = b
    sat_step = min(sf_b - sl_a, 0.0) if sn_a and sn_b else 0.0
    age_step = abs(af_b - al_a) if an_a and an_b else 0.0
    rows, gbs_mean, gbs_m2 = _moments(rows_a, gm_a, gs_a, rows_b, gm_b, gs_b)
    sat_n, sat_mean, _ = _moments(sn_a, sm_a, 0.0, sn_b, sm_b, 0.0)
    return (
        rows, first_us,
        *_moments(cn_a, cm_a, cs_a, cn_b, cm_b, cs_b), _least(cmin_a, cmin_b), _greatest(cmax_a, cmax_b),
        cp_a + cp_b + cn_a * cn_b * cm_b,
        sat_n, sat_mean, _least(smin_a, smin_b), sd_a + sd_b + sat_step, sf_a if sn_a else sf_b, sl_b if sn_b else sl_a,
        ok_a + ok_b, ch_a + ch_b + float(ff_b != fl_a), ff_a, fl_b,
        an_a + an_b, as_a + as_b + age_step, af_a if an_a else af_b, al_b if an_b else al_a,
        *_moments(ln_a, lm_a, ls_a, ln_b, lm_b, ls_b), *_moments(on_a, om_a, os_a, on_b, om_b, os_b),
        *_moments(rn_a, rm_a, rs_a, rn_b, rm_b, rs_b), gbs_mean, gbs_m2, gn_a + gn_b,
    )


class TwoStacks:
    """A queue whose merged content is always at hand: amortised three merges per element."""

    def __init__(self) -> None:
        self.front: list[Summary] = []  # merged with all that follows in the front
        self.back: list[Summary] = []
        self.back_total: Summary | None = None

    def push(self, x: Summary) -> None:
        self.back.append(x)
        self.back_total = merge(self.back_total, x)

    def pop(self) -> None:
        if not self.front:
            total = None
            for x in reversed(self.back):
                total = merge(x, total)
                self.front.append(total)
            self.back, self.back_total = [], None
        self.front.pop()

    def total(self) -> Summary | None:
        return merge(self.front[-1] if self.front else None, self.back_total)


class Bucket:
    """Rows of one stretch of time in order, with running summaries from both ends."""

    def __init__(self, rows: list[tuple[int, Sequence[float]]]):
        self.rows = rows
        self.from_left: list[Summary] = []
        self.from_right: list[Summary] | None = None
        self.times: list[int] = []

    def insert(self, rows: list[tuple[int, Sequence[float]]]) -> None:
        """Rows of equal times keep their order, new ones last."""
        self.rows = sorted(self.rows + rows, key=lambda r: r[0])
        self.from_left, self.from_right = [], None

    def _fill(self) -> None:
        total = None
        self.times = [us for us, _ in self.rows]
        for us, cells in self.rows:
            total = merge(total, single(us, cells))
            self.from_left.append(total)

    def upto(self, place: int) -> Summary:
        if not self.from_left:
            self._fill()
        return self.from_left[place]

    def whole(self) -> Summary:
        return self.upto(len(self.rows) - 1)

    def since(self, us: int) -> Summary | None:
        if self.from_right is None:
            self.from_right, total = [], None
            for at, cells in reversed(self.rows):
                total = merge(single(at, cells), total)
                self.from_right.append(total)
            self.from_right.reverse()
            self.times = [at for at, _ in self.rows]
        place = bisect_left(self.times, us)
        return self.from_right[place] if place < len(self.times) else None


class Trail:
    """The held buckets of a session; rows of one call are taken in time order.

    ``load`` gives the rows of a bucket named in ``summaries`` when they are needed.
    """

    def __init__(self, window_us: int, held_us: int, summaries: dict[int, Summary], newest: int | None, load):
        self.window_us, self.held_us = window_us, held_us
        self.width = max(1, window_us // BUCKETS)
        self.summaries, self.newest, self.load = summaries, newest, load
        self.open: dict[int, Bucket] = {}

    def bucket(self, number: int) -> Bucket | None:
        if number not in self.open:
            if number not in self.summaries:
                return None
            self.open[number] = Bucket(self.load(number))
        return self.open[number]

    def add(self, rows: list[tuple[int, Sequence[float]]]) -> tuple[list[Summary], set[int]]:
        """The summary of each row's window, in the order of ``rows`` (sorted by time); and the buckets that changed."""
        arriving: dict[int, list] = {}
        for row in rows:
            arriving.setdefault(row[0] // self.width, []).append(row)
        places: list[tuple[int, int]] = []
        for number, new in arriving.items():
            bucket = self.bucket(number)
            old = [us for us, _ in bucket.rows] if bucket else []
            if bucket:
                bucket.insert(new)
            else:
                self.open[number] = Bucket(new)
            before = 0
            for k, (us, _) in enumerate(new):
                while before < len(old) and old[before] <= us:
                    before += 1
                places.append((number, before + k))
            self.summaries[number] = self.open[number].whole()
        out = self._windows(rows, places)
        self.newest = max(rows[-1][0], rows[-1][0] if self.newest is None else self.newest)
        return out, set(arriving)

    def _windows(self, rows, places) -> list[Summary]:
        order = sorted(self.summaries)
        between = TwoStacks()
        entered = left = bisect_left(order, (rows[0][0] - self.window_us) // self.width + 1)
        out = []
        for (us, _), (number, place) in zip(rows, places, strict=True):
            begin = us - self.window_us
            first = begin // self.width
            while entered < len(order) and order[entered] < number:
                between.push(self.summaries[order[entered]])
                entered += 1
            while left < entered and order[left] <= first:
                between.pop()
                left += 1
            head = self.bucket(first)
            tail = self.open[number]
            if first == number:  # a window shorter than a microsecond per bucket
                total = None
                for at, cells in tail.rows[bisect_left([t for t, _ in tail.rows], begin) : place + 1]:
                    total = merge(total, single(at, cells))
                out.append(total)
                continue
            out.append(merge(merge(head.since(begin) if head else None, between.total()), tail.upto(place)))
        return out

    def expired(self) -> list[int]:
        """Buckets no later window can reach; they are forgotten."""
        gone = [b for b in self.summaries if (b + 1) * self.width <= self.newest - self.held_us]
        for b in gone:
            del self.summaries[b]
        return gone


class TrailingWindow(StatefulProcessor):
    """Emits, per epoch, the summary of the window it closes.

    Rows up to the watermark are accepted; the state holds the window length and the
    lateness, so that a late epoch finds its whole window. An idle session is dropped
    by a timer. An epoch is emitted once: rows that arrive after it do not change its window.
    """

    def __init__(self, keys: Sequence[str], ts: str, window_seconds: float, lateness_us: int):
        self.keys, self.ts = list(keys), ts
        self.window_us = int(window_seconds * 1_000_000)
        self.held_us = self.window_us + lateness_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.index = handle.getValueState("index", "newest long, buckets array<long>, summaries array<double>")
        self.rows = handle.getMapState("rows", "bucket long", "us array<long>, cells array<double>")

    def _load(self, bucket: int) -> list[tuple[int, Sequence[float]]]:
        us, cells = self.rows.getValue((bucket,))
        n = len(HISTORY)
        return [(int(t), tuple(cells[i * n : (i + 1) * n])) for i, t in enumerate(us)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True).sort_values("epoch_us", kind="stable").reset_index(drop=True)
        newest, summaries, n = None, {}, len(FIELDS)
        if self.index.exists():
            newest, buckets, flat = self.index.get()
            summaries = {int(b): tuple(flat[i * n : (i + 1) * n]) for i, b in enumerate(buckets)}
        trail = Trail(self.window_us, self.held_us, summaries, newest, self._load)
        stored = set(summaries)
        cells = new[HISTORY].to_numpy(dtype="float64").tolist()
        found, changed = trail.add(list(zip(new["epoch_us"].tolist(), map(tuple, cells))))

        for bucket in trail.expired():
            if bucket in stored:
                self.rows.removeKey((bucket,))
        for bucket in changed & set(trail.summaries):
            held = trail.open[bucket].rows
            self.rows.updateValue((bucket,), ([us for us, _ in held], [float(x) for _, row in held for x in row]))
        kept = sorted(trail.summaries)
        self.index.update((trail.newest, kept, [x for b in kept for x in trail.summaries[b]]))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, (list, tuple)) else timer)
        self.handle.registerTimer((trail.newest + self.window_us + self.held_us) // 1000)

        frame = pd.concat([new[[self.ts, "epoch_us", *CURRENT, *LATEST]], pd.DataFrame(found, columns=FIELDS)], axis=1)
        for name, value in zip(self.keys, key, strict=True):
            frame[name] = value
        yield frame

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.index.clear()
        self.rows.clear()
        return iter(())

    def close(self) -> None:
        pass
