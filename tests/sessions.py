"""Seeded synthetic sessions: gaps, nulls, no-fix blocks, ties, short and long ones."""

from __future__ import annotations

import math
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd

LENGTHS = (1, 2, 30, 31, 60, 61, 200)
COLUMNS = [
    "lat", "lon", "alt", "fix_quality", "num_satellites", "hdop", "pdop", "vdop", "solution_age", "lat_sigma",
    "lon_sigma", "rms_error", "gbs_lat_err", "gbs_lon_err", "mean_cnr_epoch", "cycle_slips_epoch",
]


def make_sessions(seed: int = 7, lengths=LENGTHS) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    rows = []
    for s, n in enumerate(lengths):
        at = datetime(2024, 5, 4, 23, 59, 0, tzinfo=timezone.utc) + timedelta(seconds=s)
        for i in range(n):
            at += timedelta(seconds=int(rng.choice([1, 1, 1, 2, 3, 40], p=[0.5, 0.2, 0.15, 0.08, 0.06, 0.01])))
            blocked = (i // 10) % 6 == 5
            none = lambda p: rng.random() < p
            rows.append(
                {
                    "source": f"s{s // 2}",
                    "scenario": f"c{s}",
                    "timestamp": at,
                    "lat": None if blocked else 30 + rng.random(),
                    "lon": None if blocked else 120 + rng.random(),
                    "alt": None if none(0.2) else float(rng.normal(50, 80)),
                    "fix_quality": 0 if blocked else int(rng.choice([1, 2, 4, 5, 6, 8])),
                    "num_satellites": None if none(0.1) else float(rng.integers(0, 45)),
                    "hdop": float(rng.uniform(0.5, 6)),
                    "pdop": None if none(0.1) else float(rng.uniform(0.8, 9)),
                    "vdop": float(rng.choice([0.0, 0.9, 1.7])),
                    "solution_age": None if none(0.15) else float(rng.integers(0, 9)),
                    "lat_sigma": None if s % 3 == 0 or none(0.3) else float(rng.uniform(0, 12)),
                    "lon_sigma": None if s % 3 == 0 or none(0.3) else float(rng.uniform(0, 12)),
                    "rms_error": float(rng.uniform(0, 5)) if s % 3 == 1 and none(0.1) else None,
                    "gbs_lat_err": float(rng.uniform(0, 5)) if s % 3 == 2 and none(0.3) else None,
                    "gbs_lon_err": float(rng.uniform(0, 5)) if s % 3 == 2 and none(0.3) else None,
                    "mean_cnr_epoch": None if blocked or none(0.2) else float(rng.uniform(15, 52)),
                    "cycle_slips_epoch": float(rng.integers(0, 4)),
                }
            )
    return pd.DataFrame(rows)


def to_spark(spark, pdf: pd.DataFrame, extra: str = ""):
    types = {c: "double" for c in COLUMNS} | {"fix_quality": "int"}
    schema = "source string, scenario string, timestamp timestamp, " + ", ".join(f"{c} {types[c]}" for c in COLUMNS)
    clean = pdf[["source", "scenario", "timestamp", *COLUMNS]].astype(object).where(pdf.notna(), None)
    rows = [
        tuple(int(v) if c == "fix_quality" and v is not None else v for c, v in zip(clean.columns, r, strict=True))
        for r in clean.itertuples(index=False, name=None)
    ]
    rows = [(*r[:2], r[2].to_pydatetime(), *r[3:]) for r in rows]
    return spark.createDataFrame(rows, schema)


def same(a, b, tolerance=1e-9) -> bool:
    a_none = a is None or (isinstance(a, float) and math.isnan(a))
    b_none = b is None or (isinstance(b, float) and math.isnan(b))
    if a_none or b_none:
        return a_none and b_none
    if isinstance(a, float) or isinstance(b, float):
        return math.isclose(float(a), float(b), rel_tol=tolerance, abs_tol=tolerance)
    return a == b
