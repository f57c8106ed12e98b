"""NMEA 0183 recordings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clearsky.functions.scalars import (
    field,
    nmea_date,
    nmea_degrees,
    nmea_degrees_legacy,
    nmea_time,
    number,
    numbers,
)
from clearsky.sources.lines import LINE_ORDER, number_records, read_lines

SENTENCES = ["GGA", "GNS", "GSA", "GST", "GBS", "GSV", "RMC"]


def sentences(lines: DataFrame, kinds: Sequence[str] = tuple(SENTENCES)) -> DataFrame:
    """Sentences of the given kinds with ``talker``, ``kind`` and ``parts`` (checksum removed).

    The kind is read off the start of the line, so other lines are never split.
    """
    text = F.trim("line")
    head = F.substring_index(text, ",", 1)
    found = lines.where(
        text.startswith("$") & text.contains(",") & F.right(head, F.lit(3)).isin(*kinds)
    )
    after_star = F.length(F.substring_index(text, "*", -1)) + 1
    body = F.when(text.contains("*"), F.left(text, F.length(text) - after_star)).otherwise(text)
    return found.select(
        *lines.columns,
        F.split(body, ",").alias("parts"),
        F.right(head, F.lit(3)).alias("kind"),
        F.substring(head, F.lit(2), F.greatest(F.length(head) - 4, F.lit(0))).alias("talker"),
    )


def _at(values: Column, index: int) -> Column:
    return F.get(values, F.lit(index))


def _bad(parts: Column, nums: Column, index: int) -> Column:
    """A field that is present but no number."""
    return (F.coalesce(_at(parts, index), F.lit("")) != "") & _at(nums, index).isNull()


def _count(nums: Column, index: int) -> Column:
    return F.coalesce(_at(nums, index), F.lit(0.0)).cast("int")


def gga_fields(parts: Column, nums: Column, date: Column) -> Column:
    """Struct of the position sentence; null when it is short or malformed."""
    malformed = _bad(parts, nums, 6)
    for i in (7, 8, 9, 13):
        malformed = malformed | _bad(parts, nums, i)
    return F.when(
        (F.size(parts) >= 10) & ~malformed,
        F.struct(
            nmea_time(field(parts, 1), date).alias("timestamp"),
            nmea_degrees(field(parts, 2), _at(parts, 3), 2).alias("lat"),
            nmea_degrees(field(parts, 4), _at(parts, 5), 3).alias("lon"),
            _count(nums, 6).alias("fix_quality"),
            _count(nums, 7).alias("num_sats"),
            _at(nums, 8).alias("hdop"),
            _at(nums, 9).alias("alt"),
            F.coalesce(_at(nums, 13), F.lit(0.0)).alias("solution_age"),
        ),
    )


def _fields(parts: Column, nums: Column, least: int, names: dict[str, int], strict: bool = False) -> Column:
    """Struct of numbers at given positions of a sentence with enough fields.

    ``strict``: a malformed one of them makes the sentence void.
    """
    ok = F.size(parts) >= least
    if strict:
        for i in names.values():
            ok = ok & ~_bad(parts, nums, i)
    return F.when(ok, F.struct(*[_at(nums, i).alias(n) for n, i in names.items()]))


def gsa_fields(parts: Column, nums: Column) -> Column:
    return _fields(parts, nums, 18, {"pdop": 15, "hdop": 16, "vdop": 17}, strict=True)


def gst_fields(parts: Column, nums: Column) -> Column:
    return _fields(parts, nums, 9, {"rms_error": 2, "lat_sigma": 6, "lon_sigma": 7, "alt_sigma": 8})


def gbs_fields(parts: Column, nums: Column) -> Column:
    return _fields(parts, nums, 8, {"gbs_lat_err": 2, "gbs_lon_err": 3, "gbs_alt_err": 4})


def gns_count(parts: Column, nums: Column) -> Column:
    """Satellites used; null when the sentence is short or the count malformed."""
    return F.when((F.size(parts) >= 8) & ~_bad(parts, nums, 7), _count(nums, 7))


def gsv_cnr(nums: Column) -> Column:
    """Signal strengths above zero of one satellites-in-view sentence."""
    strengths = F.filter(nums, lambda v, i: (i >= 7) & (i % 4 == 3))
    return F.filter(strengths, lambda v: v > 0)


def nmea_epochs(lines: DataFrame, date_hint: Column | str | None = None, tasks: int | None = None) -> DataFrame:
    """One row per position fix from ordered lines.

    A GGA sentence opens an epoch and closes the one before; other sentences add
    to the open epoch. Satellite and geometry sentences before the first GGA
    count for the first epoch. A malformed GGA closes the record and opens one
    that yields no row. The date is that of the latest RMC sentence, else
    ``date_hint``; without both the time is unknown and the row is dropped, as
    are rows without time of day. Fixes without position are kept. ``tasks`` says into how many
    tasks the epochs are dealt (else the session's shuffle partitions): large inputs need more.
    """
    hint = F.lit(date_hint).cast("date") if isinstance(date_hint, str) or date_hint is None else date_hint
    kinds = sentences(lines).drop("line")
    is_gga = F.col("kind") == "GGA"
    dated = number_records(
        kinds.withColumn("_date", F.when(F.col("kind") == "RMC", nmea_date(field(F.col("parts"), 9)))),
        {"epoch": is_gga},
        carry=["_date"],
    )
    early = (F.col("epoch") == 0) & F.col("kind").isin("GSV", "GSA")
    placed = dated.withColumn("epoch", F.when(early, F.lit(1)).otherwise(F.col("epoch"))).where("epoch > 0")

    parts, at = F.col("parts"), F.struct(*LINE_ORDER)
    date = F.coalesce(F.col("_date"), hint)

    def of(kind: str, value: Column, talker: str | None = None) -> Column:
        hit = F.col("kind") == kind
        if talker is not None:
            hit = hit & (F.col("talker") == talker)
        return F.when(hit, value)

    nums = F.col("nums")
    gns = gns_count(parts, nums)
    read = placed.withColumn("nums", numbers(parts)).select(
        "path", "file_name", "epoch", at.alias("at"),
        of("GGA", gga_fields(parts, nums, date)).alias("gga"),
        of("GSA", gsa_fields(parts, nums)).alias("gsa"),
        of("GST", gst_fields(parts, nums)).alias("gst"),
        of("GBS", gbs_fields(parts, nums)).alias("gbs"),
        of("GNS", gns, "GN").alias("all_sats"),
        of("GNS", gns, "GP").alias("gps_sats"),
        of("GNS", gns, "GL").alias("glo_sats"),
        of("GNS", gns, "GA").alias("gal_sats"),
        of("GNS", gns, "GB").alias("bds_sats"),
        of("GSV", gsv_cnr(nums)).alias("cnr"),
    )
    if tasks:
        read = read.repartition(tasks, "path", "file_name", "epoch")
    heard = F.when(F.col("cnr").isNotNull(), F.struct("at", "cnr"))
    merged = read.groupBy("path", "file_name", "epoch").agg(
        *[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
            for c in ("gga", "gsa", "gst", "gbs", "all_sats", "gps_sats", "glo_sats", "gal_sats", "bds_sats")
        ],
        F.flatten(F.transform(F.array_sort(F.collect_list(heard)), lambda s: s["cnr"])).alias("cnr_list"),
    )
    return merged.where(F.col("gga.timestamp").isNotNull()).select(
        "path",
        "file_name",
        "epoch",
        F.col("gga.timestamp").alias("timestamp"),
        F.col("gga.lat").alias("lat"),
        F.col("gga.lon").alias("lon"),
        F.col("gga.alt").alias("alt"),
        F.col("gga.fix_quality").alias("fix_quality"),
        F.coalesce(F.col("all_sats"), F.col("gga.num_sats")).cast("double").alias("num_satellites"),
        F.col("gga.hdop").alias("hdop"),
        F.col("gsa.pdop").alias("pdop"),
        F.col("gsa.vdop").alias("vdop"),
        F.col("gga.solution_age").alias("solution_age"),
        "gst.lat_sigma",
        "gst.lon_sigma",
        "gst.alt_sigma",
        "gst.rms_error",
        "gbs.gbs_lat_err",
        "gbs.gbs_lon_err",
        "gbs.gbs_alt_err",
        "gps_sats",
        "glo_sats",
        "gal_sats",
        "bds_sats",
        "cnr_list",
    )


def read_nmea(
    spark: SparkSession, paths: str | Sequence[str], date_hint: Column | str | None = None
) -> DataFrame:
    """Epoch table of NMEA files; see ``nmea_epochs``."""
    return nmea_epochs(read_lines(spark, paths), date_hint)


def nmea_fix_pairs(lines: DataFrame) -> DataFrame:
    """Older pairing: a GGA and the first GSA after it make one fix.

    A GGA without GSA before the next GGA yields nothing; RMC sentences between
    the two add ``gps_valid``. The time stays the sentence's text.
    """
    wanted = sentences(lines, ["GGA", "GSA", "RMC"])
    numbered = number_records(wanted, {"epoch": F.col("kind") == "GGA"}).where("epoch > 0")
    parts, at = F.col("parts"), F.struct(*LINE_ORDER)
    gga = F.struct(
        F.get(parts, F.lit(1)).alias("timestamp"),
        nmea_degrees_legacy(F.get(parts, F.lit(2)), F.get(parts, F.lit(3))).alias("latitude"),
        nmea_degrees_legacy(F.get(parts, F.lit(4)), F.get(parts, F.lit(5))).alias("longitude"),
        number(F.get(parts, F.lit(9))).alias("altitude"),
        number(F.get(parts, F.lit(6)), "int").alias("fix_quality"),
        number(F.get(parts, F.lit(7)), "int").alias("num_satellites"),
    )
    gsa = F.struct(
        at.alias("at"),
        number(F.get(parts, F.lit(15))).alias("pdop"),
        number(F.get(parts, F.lit(16))).alias("hdop"),
        number(F.get(parts, F.lit(17))).alias("vdop"),
    )
    rmc = F.when(F.col("kind") == "RMC", F.struct(at.alias("at"), (F.get(parts, F.lit(2)) == "A").alias("ok")))
    grouped = numbered.groupBy("path", "file_name", "epoch").agg(
        F.max(F.when(F.col("kind") == "GGA", gga)).alias("gga"),
        F.min_by(gsa, F.when(F.col("kind") == "GSA", at)).alias("gsa"),
        F.array_sort(F.collect_list(rmc)).alias("rmc"),
    )
    valid = F.filter("rmc", lambda r: r["at"] < F.col("gsa.at"))
    return grouped.where(
        F.col("gsa").isNotNull() & F.col("gga.latitude").isNotNull() & F.col("gga.longitude").isNotNull()
    ).select(
        "path", "file_name", "epoch", "gga.*", "gsa.pdop", "gsa.hdop", "gsa.vdop",
        F.get(valid, F.size(valid) - 1)["ok"].alias("gps_valid"),
    )


def nmea_tables(lines: DataFrame) -> dict[str, DataFrame]:
    """Sentence tables ``GGA``, ``RMC`` and ``GSV`` with all their fields."""
    text = F.regexp_extract("line", r"^\$([^*]*)", 1)
    rows = (
        lines.where(F.col("line").startswith("$"))
        .withColumn("parts", F.split(text, ","))
        .withColumn("kind", F.upper(F.expr("substring(parts[0], 3)")))
    )
    parts, at = F.col("parts"), ["path", "file_name", *LINE_ORDER]

    def raw(i: int, name: str) -> Column:
        return F.get(parts, F.lit(i)).alias(name)

    def num(i: int, name: str) -> Column:
        return number(F.get(parts, F.lit(i))).alias(name)

    gga = rows.where((F.col("kind") == "GGA") & (F.size("parts") >= 14)).select(
        *at, raw(1, "time"), raw(2, "latitude"), raw(3, "lat_direction"), raw(4, "longitude"),
        raw(5, "lon_direction"), num(6, "quality"), num(7, "num_satellites"), num(8, "hdop"),
        num(9, "altitude"), raw(10, "alt_unit"), num(11, "geoidal_sep"), raw(12, "geoidal_sep_unit"),
        F.when(F.size("parts") >= 15, F.get(parts, F.lit(13))).otherwise("").alias("dgps_age"),
        F.when(F.size("parts") >= 16, F.get(parts, F.lit(14))).otherwise("").alias("dgps_station"),
    )
    rmc = rows.where((F.col("kind") == "RMC") & (F.size("parts") >= 10)).select(
        *at, raw(1, "time"), raw(2, "status"), raw(3, "latitude"), raw(4, "lat_direction"),
        raw(5, "longitude"), raw(6, "lon_direction"), num(7, "speed_knots"), num(8, "course"),
        raw(9, "date"), num(10, "magnetic_variation"), field(parts, 11).alias("variation_direction"),
        raw(12, "mode"),
    )
    satellites = F.transform(
        F.when(F.size("parts") >= 8, F.sequence(F.lit(0), F.floor((F.size("parts") - 4) / 4).cast("int") - 1))
        .otherwise(F.array().cast("array<int>")),
        lambda s: F.struct(
            number(F.get(parts, s * 4 + 4)).alias("id"),
            number(F.get(parts, s * 4 + 5)).alias("elevation"),
            number(F.get(parts, s * 4 + 6)).alias("azimuth"),
            number(F.get(parts, s * 4 + 7)).alias("snr"),
        ),
    )
    gsv = rows.where((F.col("kind") == "GSV") & (F.size("parts") >= 4)).select(
        *at, num(1, "total_messages"), num(2, "message_number"), num(3, "satellites_in_view"),
        satellites.alias("satellites"),
    )
    return {"GGA": gga, "RMC": rmc, "GSV": gsv}
