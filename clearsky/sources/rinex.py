"""RINEX 3 observation and navigation files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clearsky.functions.scalars import digit, fixed_field, number, snr_digit_to_cnr
from clearsky.sources.lines import LINE_ORDER, number_records, read_lines

SYSTEM_NAMES = {"G": "GPS", "R": "GLONASS", "E": "Galileo", "C": "BDS", "J": "QZSS", "S": "SBAS"}

# The 26 orbit parameters of a GPS navigation record, four per line (fixed order).
NAV_FIELDS = [
    "iode", "crs_m", "delta_n", "m0",
    "cuc", "eccentricity", "cus", "sqrt_a",
    "toe", "cic", "omega0", "cis",
    "i0", "crc_m", "omega", "omega_dot",
    "idot", "codes", "gps_week", "l2p_flag",
    "sv_accuracy_m", "sv_health", "tgd", "iodc",
    "transmission_time", "fit_interval",
]


def _label(line: Column) -> Column:
    return F.substring(line, 61, 20)


def read_records(
    spark: SparkSession, paths: str | Sequence[str], pattern: str | None = None, bundled: bool = False
) -> DataFrame:
    """``path, file_name, block, pos, record``: one row per epoch of observation files.

    A line that starts with ``>`` opens an epoch, so the files are cut at
    line feed and ``>`` together: wherever a split begins, an epoch arrives whole in
    one row, without its ``>``. The row that holds the end of the header is the
    header of its file. (A header in which a line starts with ``>`` is not read.)
    """
    return read_lines(spark, paths, pattern, separator="\n>", bundled=bundled).withColumnRenamed("line", "record")


def _is_header(record: Column) -> Column:
    return record.contains("END OF HEADER")


def _lines(record: Column) -> Column:
    return F.split(record, "\r?\n")


def sectioned(lines: DataFrame) -> DataFrame:
    """Add ``body`` (past the header)."""
    ends = F.col("line").contains("END OF HEADER")
    numbered = number_records(lines, {"_ended": ends})
    return numbered.withColumn("body", (F.col("_ended") > 0) & ~ends).drop("_ended")


def observation_codes(records: DataFrame) -> DataFrame:
    """``path, codes``: per file a map from system to its observation codes in column order.

    A header line with a blank system continues the one above.
    """
    rows = F.filter(_lines(F.col("record")), lambda line: _label(line).contains("SYS / # / OBS TYPES"))
    headers = records.where(_is_header(F.col("record"))).select("path", rows.alias("rows"))
    named = F.transform(
        "rows",
        lambda line, i: F.struct(
            F.try_element_at(
                F.filter(
                    F.transform(F.slice("rows", F.lit(1), i + 1), lambda above: F.substring(above, 1, 1)),
                    lambda system: system != " ",
                ),
                F.lit(-1),
            ).alias("system"),
            F.filter(F.split(F.trim(F.substring(line, 8, 53)), r"\s+"), lambda c: c != "").alias("codes"),
        ),
    )
    known = headers.select("path", F.filter(named, lambda row: row["system"].isNotNull()).alias("named"))
    systems = F.array_distinct(F.col("named.system"))
    codes = F.transform(
        systems,
        lambda system: F.flatten(
            F.transform(F.filter("named", lambda row: row["system"] == system), lambda row: row["codes"])
        ),
    )
    return known.select("path", F.map_from_arrays(systems, codes).alias("codes"))


def epoch_time(line: Column) -> Column:
    """Time of an epoch line (``> Y M D h m s``), null when malformed."""
    tokens = F.split(F.trim(F.substring(line, F.lit(2), F.length(line))), r"\s+")
    t = [F.get(tokens, F.lit(i)) for i in range(6)]
    day = F.try_to_timestamp(
        F.concat_ws("-", t[0], F.lpad(t[1], 2, "0"), F.lpad(t[2], 2, "0")), F.lit("yyyy-MM-dd")
    )
    seconds = number(t[5])
    whole = (t[3].try_cast("int") * 3600 + t[4].try_cast("int") * 60 + F.floor(seconds)).cast("long")
    fraction = F.round((seconds - F.floor(seconds)) * 1_000_000).cast("long")
    return F.when(
        F.size(tokens) >= 6, F.timestamp_micros(F.unix_micros(day) + whole * 1_000_000 + fraction)
    )


def epochs(records: DataFrame, systems: str = "GRECJSI") -> DataFrame:
    """``path, file_name, block, pos, timestamp, satellites``: one row per record with a valid time.

    A satellite is ``line, system, data`` and the ``codes`` of its system, in the order of the
    record. Headers, one row a file, come back by a join on the file; epochs stay where they were read.
    """
    body = records.where(~_is_header(F.col("record"))).join(observation_codes(records), "path")
    lines = _lines(F.col("record"))
    wanted = F.filter(
        F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))),
        lambda line: (F.length(line) >= 3) & F.substring(line, 1, 1).isin(*systems),
    )
    satellites = F.transform(
        wanted,
        lambda line: F.struct(
            line.alias("line"),
            F.substring(line, 1, 1).alias("system"),
            F.substring(line, F.lit(4), F.length(line)).alias("data"),
            F.try_element_at("codes", F.substring(line, 1, 1)).alias("codes"),
        ),
    )
    opening = F.concat(F.lit(">"), F.ltrim(F.get(lines, F.lit(0)), F.lit(">")))
    return body.select(
        "path",
        "file_name",
        *LINE_ORDER,
        epoch_time(opening).alias("timestamp"),
        F.filter(satellites, lambda s: s["codes"].isNotNull()).alias("satellites"),
    ).where("timestamp is not null")


def best_cnr(data: Column, codes: Column, mode: str) -> Column:
    """One C/N0 per satellite.

    ``direct_s1c``: the largest S-type value strictly between 0 and 70.
    ``snr_indicator``: the largest digit in column 16 of any field, converted.
    """
    if mode == "direct_s1c":
        fields = F.transform(
            codes,
            lambda c, i: F.when(
                c.startswith("S") & (F.length(fixed_field(data, i)) >= 14),
                number(F.substring(fixed_field(data, i), 1, 14)),
            ),
        )
        return F.array_max(F.filter(fields, lambda v: (v > 0) & (v < 70)))
    if mode == "snr_indicator":
        digits = F.transform(codes, lambda c, i: digit(F.substring(fixed_field(data, i), 16, 1)))
        top = F.array_max(F.filter(digits, lambda d: d > 0))
        return F.when(top > 0, snr_digit_to_cnr(top))
    raise ValueError(f"unknown mode {mode!r}")


def cycle_slips(data: Column, codes: Column) -> Column:
    """Phase observations whose loss-of-lock digit has bit 0 set."""
    flags = F.transform(
        codes, lambda c, i: F.when(c.startswith("L"), digit(F.substring(fixed_field(data, i), 15, 1)))
    )
    return F.coalesce(F.size(F.filter(flags, lambda d: d.bitwiseAND(1) == 1)), F.lit(0))


def observation_epochs(records: DataFrame, mode: str = "snr_indicator") -> DataFrame:
    """``path, timestamp (GPS time), cnr_list, cycle_slips`` per epoch.

    Epochs without any C/N0 are dropped; of two epochs with one time the later
    in the file stays.
    """
    slips = F.transform("satellites", lambda s: cycle_slips(s["data"], s["codes"]))
    cnr = F.transform("satellites", lambda s: best_cnr(s["data"], s["codes"], mode))
    measured = epochs(records).select(
        "path",
        "file_name",
        *LINE_ORDER,
        "timestamp",
        F.filter(cnr, lambda v: v.isNotNull()).alias("cnr_list"),
        F.aggregate(slips, F.lit(0), lambda total, n: total + n).alias("cycle_slips"),
    )
    return (
        measured.where(F.size("cnr_list") > 0)
        .groupBy("path", "file_name", "timestamp")
        .agg(F.max_by(F.struct("cnr_list", "cycle_slips"), F.struct(*LINE_ORDER)).alias("r"))
        .select("path", "file_name", "timestamp", "r.cnr_list", "r.cycle_slips")
    )


def read_observations(spark: SparkSession, paths, mode: str = "snr_indicator") -> DataFrame:
    return observation_epochs(read_records(spark, paths), mode)


def observation_long(records: DataFrame) -> DataFrame:
    """One row per epoch and satellite (G, E, R, C): ``epoch_utc, satellite,
    constellation, cnr, t_sec``.

    The digit of the first phase observation above zero counts, else that of the
    first observation above zero; ``t_sec`` runs from the first epoch of a file
    that has satellites.
    """
    seen = epochs(records, systems="GERC").where(
        F.exists("satellites", lambda s: F.size(s["codes"]) > 0)
    )
    starts = seen.groupBy("path").agg(F.min("timestamp").alias("_start"))

    def cnr(s: Column) -> Column:
        full = F.transform(
            s["codes"],
            lambda c, i: F.struct(
                c.startswith("L").alias("phase"),
                digit(F.substring(fixed_field(s["data"], i), 16, 1)).alias("d"),
            ),
        )
        good = F.filter(full, lambda f: f["d"] > 0)
        first_phase = F.get(F.filter(good, lambda f: f["phase"]), F.lit(0))["d"]
        return snr_digit_to_cnr(F.coalesce(first_phase, F.get(good, F.lit(0))["d"]), "midpoints")

    seconds = (F.unix_micros("epoch_utc") - F.unix_micros("_start")) / 1e6
    return (
        seen.select("path", "file_name", F.col("timestamp").alias("epoch_utc"), F.explode("satellites").alias("s"))
        .where(F.size("s.codes") > 0)
        .join(starts, "path")
        .select(
            "path",
            "file_name",
            "epoch_utc",
            F.trim(F.substring("s.line", 1, 3)).alias("satellite"),
            F.col("s.system").alias("constellation"),
            cnr(F.col("s")).alias("cnr"),
            seconds.alias("t_sec"),
        )
    )


def observation_maps(records: DataFrame) -> DataFrame:
    """Per satellite line a map from observation code to its text value."""
    rows = epochs(records, systems="GRECJS").select(
        "path", "file_name", *LINE_ORDER, F.col("timestamp").alias("epoch_time"), F.posexplode("satellites").alias("nth", "s")
    )
    data, codes = F.col("s.data"), F.col("s.codes")
    count = F.least(F.floor(F.length(data) / 16).cast("int"), F.size(codes))
    used = F.slice(codes, F.lit(1), count)
    values = F.map_from_arrays(used, F.transform(used, lambda c, i: F.trim(fixed_field(data, i))))
    names = F.create_map(*[F.lit(v) for kv in SYSTEM_NAMES.items() for v in kv])
    return rows.select(
        "path",
        "file_name",
        *LINE_ORDER,
        "nth",
        "epoch_time",
        names[F.col("s.system")].alias("constellation"),
        F.trim(F.substring("s.line", 1, 3)).alias("prn"),
        values.alias("observations"),
    )


def navigation_records(lines: DataFrame) -> DataFrame:
    """One row per broadcast ephemeris record: satellite, epoch, clock, 26 orbit fields."""
    body = sectioned(lines).where(F.col("body") & (F.trim("line") != ""))
    opens = F.substring("line", 1, 1) != " "
    records = (
        number_records(body, {"record": opens})
        .where("record > 0")
        .groupBy("path", "file_name", "record")
        .agg(F.array_sort(F.collect_list(F.struct(*LINE_ORDER, "line"))).alias("l"))
        .withColumn("l", F.transform("l", lambda s: s["line"]))
    )

    def at(row: int, start: int, width: int) -> Column:
        text = F.translate(F.substring(F.get("l", F.lit(row)), start, width), "Dd", "Ee")
        return number(text)

    def orbit(i: int) -> Column:
        row, column = i // 4 + 1, i % 4
        start, width = [(4, 20), (24, 19), (43, 19), (62, 19)][column]
        if column < 2:
            return at(row, start, width)
        # A line cut after its second field holds zeros in the others.
        return F.when(F.length(F.get("l", F.lit(row))) >= 79, at(row, start, width)).otherwise(F.lit(0.0))

    first = F.get("l", F.lit(0))
    return records.select(
        "path",
        "file_name",
        "record",
        F.trim(F.substring(first, 1, 3)).alias("satellite"),
        epoch_time(F.concat(F.lit(">"), F.substring(first, 4, 20))).alias("epoch_time"),
        at(0, 24, 19).alias("clock_bias"),
        at(0, 43, 19).alias("clock_drift"),
        at(0, 62, 19).alias("clock_drift_rate"),
        *[orbit(i).alias(name) for i, name in enumerate(NAV_FIELDS)],
    )


def first_observation_date(records: DataFrame) -> DataFrame:
    """``path, first_date`` from the header line TIME OF FIRST OBS."""
    lines = F.filter(_lines(F.col("record")), lambda line: _label(line).contains("TIME OF FIRST OBS"))
    t = F.split(F.trim(F.substring(F.get(lines, F.lit(0)), 1, 60)), r"\s+")
    day = F.try_to_date(
        F.concat_ws("-", F.get(t, F.lit(0)), F.lpad(F.get(t, F.lit(1)), 2, "0"), F.lpad(F.get(t, F.lit(2)), 2, "0")),
        "yyyy-MM-dd",
    )
    found = records.where(_is_header(F.col("record"))).withColumn("first_date", day)
    return found.where(F.size(lines) > 0).groupBy("path").agg(F.min_by("first_date", F.struct(*LINE_ORDER)).alias("first_date"))
