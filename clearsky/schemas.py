"""Schemas, fixed values and thresholds of the signal-quality tables."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values ---------------------------------------------------------------------------

GPS_LEAP_SECONDS = 18  # GPS time minus UTC since 2017
MAX_SATELLITES = 50  # satellites a multi-constellation receiver can track
WINDOW_SECONDS = 30
WINDOW_ROWS = 30
HORIZONS = (5, 15, 30)  # steps after the end of a window
CLASS_NAMES = {0: "CLEAN", 1: "WARNING", 2: "DEGRADED"}

SESSION = ["source", "scenario"]

_D = T.DoubleType()

EPOCH = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("scenario", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("lat", _D),
        T.StructField("lon", _D),
        T.StructField("alt", _D),
        T.StructField("fix_quality", T.IntegerType()),
        T.StructField("num_satellites", _D),
        T.StructField("hdop", _D),
        T.StructField("pdop", _D),
        T.StructField("vdop", _D),
        T.StructField("solution_age", _D),
        T.StructField("lat_sigma", _D),
        T.StructField("lon_sigma", _D),
        T.StructField("alt_sigma", _D),
        T.StructField("rms_error", _D),
        T.StructField("gbs_lat_err", _D),
        T.StructField("gbs_lon_err", _D),
        T.StructField("gbs_alt_err", _D),
        T.StructField("gps_sats", T.IntegerType()),
        T.StructField("glo_sats", T.IntegerType()),
        T.StructField("gal_sats", T.IntegerType()),
        T.StructField("bds_sats", T.IntegerType()),
        T.StructField("cnr_list", T.ArrayType(_D)),
        T.StructField("mean_cnr_epoch", _D),
        T.StructField("cycle_slips_epoch", _D),
    ]
)

# The 35 features, by group: position, signal, satellites, geometry, receiver, temporal, atmosphere.
FEATURES = [
    "lat", "lon", "alt", "lat_std", "lon_std",
    "mean_cnr", "min_cnr", "max_cnr", "std_cnr", "cnr_trend",
    "num_satellites", "sat_mean", "sat_min", "sat_visibility", "sat_drop_rate",
    "pdop", "hdop", "vdop", "gdop", "dop_ratio",
    "solution_status", "baseline_sats", "solution_age", "fix_continuity", "fix_transitions",
    "position_variance", "cnr_variance", "elevation_violations", "multipath", "clock_bias",
    "iono_delay", "tropo_delay", "cycle_slips", "residual_mean", "residual_std",
]

# Columns that never enter a model; lat and lon are left out so that places are not learned.
NOT_FEATURES = ["timestamp", "source", "scenario", "lat", "lon", "label", "label_name", "split"]

CNR_FEATURES = ["mean_cnr", "min_cnr", "max_cnr", "std_cnr", "cnr_trend"]

# Physical bounds [low, high] applied before scaling (fixed values).
CLIP_BOUNDS = {
    "mean_cnr": (0.0, 60.0),
    "min_cnr": (0.0, 60.0),
    "max_cnr": (0.0, 60.0),
    "std_cnr": (0.0, 30.0),
    "cnr_trend": (-10.0, 10.0),
    "num_satellites": (0.0, 50.0),
    "sat_mean": (0.0, 50.0),
    "sat_min": (0.0, 50.0),
    "sat_visibility": (0.0, 1.0),
    "sat_drop_rate": (-5.0, 5.0),
    "pdop": (0.0, 30.0),
    "hdop": (0.0, 30.0),
    "vdop": (0.0, 30.0),
    "gdop": (0.0, 50.0),
    "dop_ratio": (0.0, 10.0),
    "solution_status": (0.0, 1.0),
    "baseline_sats": (0.0, 50.0),
    "solution_age": (0.0, 60.0),
    "fix_continuity": (0.0, 1.0),
    "fix_transitions": (0.0, 30.0),
    "position_variance": (0.0, 1e6),
    "cnr_variance": (0.0, 900.0),
    "elevation_violations": (0.0, 1.0),
    "multipath": (0.0, 1e6),
    "clock_bias": (0.0, 60.0),
    "iono_delay": (0.0, 1.0),
    "tropo_delay": (0.0, 50.0),
    "cycle_slips": (0.0, 50.0),
    "residual_mean": (0.0, 1e4),
    "residual_std": (0.0, 1e4),
    "alt": (-100.0, 9000.0),
    "lat_std": (0.0, 200.0),
    "lon_std": (0.0, 200.0),
}

# Code to value (fixed values): fix quality to estimated C/N0, fix quality to score,
# signal-strength digit to the midpoint of its C/N0 band, campus fix mode to status.
FIX_TO_CNR = {4: 48.0, 5: 35.0, 1: 40.0, 2: 42.0, 3: 38.0, 0: 20.0}
FIX_TO_CNR_OTHER = 30.0
FIX_TO_SCORE = {4: 1.0, 1: 0.8, 2: 0.85, 3: 0.7, 5: 0.5, 6: 0.4, 0: 0.0}
FIX_TO_SCORE_OTHER = 0.3
SNR_MIDPOINTS = {1: 10.0, 2: 14.5, 3: 20.5, 4: 26.5, 5: 32.5, 6: 38.5, 7: 44.5, 8: 50.5, 9: 56.0}
FIX_MODE_TO_STATUS = {3: 1.0, 2: 0.5, 1: 0.0}

# Dilution-of-precision defaults for sources that record no DOP: (pdop, hdop, vdop) by kind.
DOP_DEFAULTS = {"drone": (2.0, 1.5, 1.5), "city": (3.5, 2.5, 2.0)}

# Ordered substring rules: the first match gives the group.
SOURCE_GROUPS = [
    ("scenario", "scenarios"),
    ("supervisor", "supervisor"),
    ("drone", "drone"),
    ("urbannav_tunnel", "urbannav_tunnel"),
    ("urbannav", "urbannav_medium"),
    ("tokyo", "tokyo"),
    ("nclt", "nclt"),
    ("oxford", "oxford"),
]
SOURCE_SPLIT_RULES = [
    ("scenario_a", "train"), ("scenario_b", "train"), ("scenario_c", "train"),
    ("scenario_d", "train"), ("scenario_e", "train"),
    ("supervisor_vehicle", "train"), ("supervisor_drone", "train"),
    ("nclt", "val"),
    ("urbannav", "test"), ("oxford", "test"), ("kaist", "test"),
]
EXPECTED_SCENARIOS = [
    "SCENARIO_A_INSTANT_BLOCKAGE",
    "SCENARIO_B_URBAN_CANYON",
    "SCENARIO_C_PARTIAL_BLOCKAGE",
    "SCENARIO_D_OPEN_SKY",
    "SCENARIO_E_APPROACHING_BLOCKAGE",
]
