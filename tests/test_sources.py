"""Readers on small text files written here."""

from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from clearsky.functions import scalars as sc
from clearsky.sources import listing, nmea, phone, rinex, solution, trajectory
from clearsky.sources.lines import number_records, read_lines, write_bundles

NMEA = """\
garbage before
$GPGSV,1,1,01,07,50,100,33*70
$GPGSA,A,3,,,,,,,,,,,,,1.5,0.9,1.2*30
$GPGST,1,1,1,1,1,9,9,9*00
$GPGGA,235958.00,3021.5000,N,11958.2500,E,1,08,0.8,32.5,M,7.0,M,,*6F
$GNGNS,235958.00,,,,,,25,,,,*11
$GPGST,235958.00,7.5,1,1,1,1.25,0.75,2.5*6E
$GPGSV,1,1,03,24,73,150,47,20,31,047,,05,30,102,0*78
$GLGSV,1,1,01,83,51,283,40.5*6D
$GPGSA,A,3,,,,,,,,,,,,,2.5,,2.2*30
$GPGSA,A,3,,,,,,,,,,,,,2.8,1.1,*30
$GPGBS,235958.00,4.5,3.25,10.0,68,0.1,3,1*6D
$GPRMC,235959.00,A,3021.5,N,11958.2,E,0.0,,040526,6.1,W,A*04
$GPGGA,235959.20,,,,,0,,,,M,,M,,*6F
$GPGGA,short*00
$GPGST,235959.50,99,1,1,1,99,99,99*6E
$GPGGA,000000.00,3021.5000,S,11958.2500,W,x,08,0.8,32.5,M,7.0,M,,*6F
$GPRMC,000001.00,A,3021.5,N,11958.2,E,0.0,,050526,6.1,W,A*04
$GPGGA,000001.00,3021.5000,S,11958.2500,W,4,12,0.8,32.5,M,7.0,M,1.5,0001*6F
$GPGGA,250001.00,3021.5000,S,11958.2500,W,4,12,0.8,32.5,M,7.0,M,1.5,0001*6F
"""


@pytest.fixture
def put(tmp_path):
    def write(name, text, newline="\n"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.replace("\n", newline).encode("latin-1"))
        return str(path)

    return write


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_nmea_epochs(spark, put, newline):
    path = put("log_0000.nmea", NMEA + "$GPXYZ,\xb0\n", newline)
    rows = nmea.read_nmea(spark, path, "2026-05-04").orderBy("timestamp").collect()
    first, no_fix, last = rows
    assert first["timestamp"].replace(tzinfo=timezone.utc) == datetime(2026, 5, 4, 23, 59, 58, tzinfo=timezone.utc)
    assert first["lat"] == pytest.approx(30 + 21.5 / 60) and first["lon"] == pytest.approx(119 + 58.25 / 60)
    assert (first["fix_quality"], first["num_satellites"], first["hdop"], first["alt"]) == (1, 25.0, 0.8, 32.5)
    assert (first["pdop"], first["vdop"]) == (2.8, None)  # only the last geometry sentence counts
    assert (first["rms_error"], first["lat_sigma"], first["gbs_lon_err"], first["solution_age"]) == (7.5, 1.25, 3.25, 0.0)
    assert first["cnr_list"] == [33.0, 47.0, 40.5]
    assert no_fix["lat"] is None and no_fix["fix_quality"] == 0 and no_fix["num_satellites"] == 0.0
    assert no_fix["rms_error"] is None  # the malformed position sentence took the next one
    assert last["lat"] < 0 and last["lon"] < 0 and last["solution_age"] == 1.5
    assert last["timestamp"] == datetime(2026, 5, 5, 0, 0, 1) and no_fix["timestamp"].microsecond == 200000


def test_nmea_without_any_date_gives_no_rows(spark, put):
    text = "\n".join(line for line in NMEA.splitlines() if "RMC" not in line)
    path = put("a.nmea", text)
    assert nmea.read_nmea(spark, path).count() == 0
    assert nmea.read_nmea(spark, path, "2026-05-04").count() == 3


def test_nmea_split_reading_gives_the_same_epochs(spark, put):
    path = put("big.nmea", NMEA * 40)
    whole = nmea.read_nmea(spark, path, "2026-05-04").drop("path").collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert read_lines(spark, path).select("block").distinct().count() > 10
        parts = nmea.read_nmea(spark, path, "2026-05-04").drop("path").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(repr, whole)) == sorted(map(repr, parts)) and len(whole) == 120


def test_nmea_pairs_and_tables(spark, put):
    lines = read_lines(spark, put("a.nmea", NMEA))
    pairs = nmea.nmea_fix_pairs(lines).collect()
    assert len(pairs) == 1 and (pairs[0]["pdop"], pairs[0]["hdop"], pairs[0]["vdop"]) == (2.5, None, 2.2)
    assert pairs[0]["latitude"] == pytest.approx(30 + 21.5 / 60) and pairs[0]["gps_valid"] is None
    tables = nmea.nmea_tables(lines)
    rmc = tables["RMC"].orderBy("pos").first()
    assert (rmc["date"], rmc["magnetic_variation"], rmc["variation_direction"], rmc["mode"]) == ("040526", 6.1, "W", "A")
    sats = tables["GSV"].orderBy("pos").collect()
    assert [s["id"] for s in sats[1]["satellites"]] == [24.0, 20.0, 5.0] and sats[1]["satellites"][1]["snr"] is None
    gga = tables["GGA"].orderBy("pos").collect()
    assert len(gga) == 5 and gga[0]["geoidal_sep"] == 7.0 and gga[3]["dgps_age"] == "1.5"


def obs_field(value="", lli=" ", snr=" "):
    return f"{value:>14}{lli}{snr}"


RINEX = "\n".join(
    [
        "     3.04           OBSERVATION DATA    M                   RINEX VERSION / TYPE",
        f"{'G    3 C1C L1C S1C':<60}SYS / # / OBS TYPES ",
        f"{'R    4 C1C L1C':<60}SYS / # / OBS TYPES ",
        f"{'       L2C S1C':<60}SYS / # / OBS TYPES ",
        f"{'  2026     5     4    11    23   37.0000000     GPS':<60}TIME OF FIRST OBS   ",
        f"{'':<60}END OF HEADER       ",
        "> 2026 05 04 11 23 37.2000000  0  3",
        "G05" + obs_field("20000000.125", " ", "7") + obs_field("100.5", "1", "6") + obs_field("44.250"),
        "R11" + obs_field("20000000.125", " ", "2") + obs_field("", "3", "0") + obs_field("", "2", "8") + obs_field("71.0"),
        "C07  1.0",
        "> 2026 05 04 11 23 38.0000000  0  1",
        "G05" + obs_field("20000000.125"),
        "> 2026 05 04 11 23 39.0000000  0  1",
        "G05" + obs_field("20000000.125", " ", "1") + obs_field() + obs_field("20.0"),
        "> 2026 05 04 11 23 39.0000000  0  1",
        "G06" + obs_field("20000000.125", " ", "9") + obs_field() + obs_field("30.0"),
        "",
    ]
)


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_rinex_epochs_both_modes(spark, put, newline):
    lines = rinex.read_records(spark, put("x.26O", RINEX, newline))
    digit = rinex.observation_epochs(lines, "snr_indicator").orderBy("timestamp").collect()
    assert [r["cnr_list"] for r in digit] == [[42.0, 48.0], [54.0]]  # later of two equal times
    assert digit[0]["cycle_slips"] == 2 and digit[0]["timestamp"] == datetime(2026, 5, 4, 11, 23, 37, 200000)
    direct = rinex.observation_epochs(lines, "direct_s1c").orderBy("timestamp").collect()
    assert [r["cnr_list"] for r in direct] == [[44.25], [30.0]]  # 71 is out of range
    assert rinex.first_observation_date(lines).first()["first_date"] == date(2026, 5, 4)


def test_rinex_records_across_splits(spark, put):
    epochs = "".join(f"> 2026 05 04 11 {k // 60:02d} {k % 60:02d}.0000000  0  2\nG05{20000000.125:14.3f} 5\nG07{k:14.3f} 7\n" for k in range(400))
    path = put("big.26O", RINEX[: RINEX.index(">")] + epochs)
    plain = rinex.observation_epochs(rinex.read_records(spark, path)).collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        records = rinex.read_records(spark, path)
        assert records.rdd.getNumPartitions() > 50
        split = rinex.observation_epochs(records).collect()
        first = [r["observations"] for r in rinex.observation_maps(records).orderBy("block", "pos", "nth").collect()[1:4:2]]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(split) == 400 and sorted(split) == sorted(plain)
    assert [r["C1C"].split(".")[0] for r in first] == ["0", "1"]


def test_rinex_plan_has_one_exchange_for_equal_times(spark, put):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    records = rinex.read_records(spark, put("x.26O", RINEX))
    text = plan(rinex.observation_epochs(records))
    assert text.count("FileScan text") == 2 and text.count("Exchange hashpartitioning") <= 3
    assert plan(rinex.observation_long(records)).count("FileScan text") <= 4
    assert "Exchange" not in plan(records)


def test_rinex_without_header_or_epochs(spark, put):
    header = RINEX[: RINEX.index(">")]
    for text in ("", header, RINEX[RINEX.index(">") :], header + "> bad\nG05\n"):
        records = rinex.read_records(spark, put("y.26O", text))
        assert rinex.observation_epochs(records).count() == rinex.observation_long(records).count() == 0


def test_rinex_long_and_maps(spark, put):
    lines = rinex.read_records(spark, put("x.26O", RINEX))
    long = {(r["satellite"], r["t_sec"]): r["cnr"] for r in rinex.observation_long(lines).collect()}
    assert long[("G05", 0.0)] == 38.5  # first phase digit
    assert long[("R11", 0.0)] == 50.5
    assert long[("G05", 0.8)] is None and ("C07", 0.0) not in long  # no codes for that system
    maps = rinex.observation_maps(lines).orderBy("pos", "nth").collect()
    assert maps[0]["observations"] == {"C1C": "20000000.125 7", "L1C": "100.516", "S1C": "44.250"}
    assert maps[0]["constellation"] == "GPS" and len(maps) == 5


def test_navigation(spark, put):
    num = lambda v: f"{v:19.12E}"
    record = ["G05 2026 05 04 11 59 44" + num(-2.5e-4) + num(-4.5e-13) + num(0)]
    record += ["    " + "".join(num((-1) ** i * (10 * r + i)) for i in range(4)) for r in range(6)]
    record += ["    " + num(126912) + num(4)]
    text = "\n".join([f"{'':<60}END OF HEADER", *record, *[x.replace("G05", "G10") for x in record], ""])
    rows = rinex.navigation_records(read_lines(spark, put("x.26N", text))).orderBy("record").collect()
    assert [r["satellite"] for r in rows] == ["G05", "G10"]
    r = rows[0]
    assert (r["clock_bias"], r["iode"], r["crs_m"], r["m0"], r["iodc"]) == (-2.5e-4, 0.0, -1.0, -3.0, -53.0)
    assert (r["transmission_time"], r["fit_interval"]) == (126912.0, 4.0)
    assert r["epoch_time"] == datetime(2026, 5, 4, 11, 59, 44)


def test_solution_layouts(spark, put):
    row = "2024/01/02 03:04:05.250 30.5 120.5 10.0 1 9 0.1 0.2 0.3 0 0 0 1.5 99.0"
    text = f"% header\n{row}\nbad/time x 30.5 120.5 1 1 9 0.1 0.2 0.3 0 0 0 1.5 9\n{row.replace('05.250', '01.000')} % tail\n"
    path = put("a.pos", text)
    full = solution.read_solution(spark, path).orderBy("timestamp").collect()
    assert [r["timestamp"].second for r in full] == [1, 5] and full[1]["ratio"] == 99.0 and full[1]["sdn"] == 0.1
    assert solution.read_solution(spark, path, "position").count() == 2
    wide = put("w.pos", row + " 0 0 0 0 7\n")
    assert solution.read_solution(spark, wide, "vehicle").first()["sd"] == 0.1
    assert solution.read_solution(spark, wide, "drone").first()["ns"] == 9.0
    narrow = put("n.pos", "30.1 120.1 5.0 1 9\n30.2 120.2 5.0 1 9\nx 120.3 5.0 1 9\n30.4 120.4 5.0 1 9\n")
    rows = solution.read_solution(spark, narrow, "drone").orderBy("timestamp").collect()
    assert [(r["timestamp"].second, r["latitude"]) for r in rows] == [(0, 30.1), (1, 30.2), (3, 30.4)]


def test_phone_log(spark, put):
    ok = "Fix,GPS,30.5,120.5,,1.0,4.5,,1700000000000,,,,,,"
    text = f"# x\n{ok}\n{ok.replace(',4.5,', ',,')}\nFix,GPS,1\n{ok.replace('30.5', 'abc')}\n"
    text += "Status,1700000000500,9,x,GPS,7,x,41.5,180,45,True\nStatus,1,2,x,GPS,x,x,1,1,1,true\nStatus,1,2,3,4,5,6,7,8,9\n"
    fixes, status = phone.read_phone_log(spark, put("gnss_log_a.txt", text))
    f = fixes.collect()
    assert len(f) == 1 and (f[0]["altitude"], f[0]["vertical_accuracy"], f[0]["num_used_signals"]) == (0.0, 4.5, 0)
    s = status.orderBy(F.desc("unix_time_ms")).collect()
    assert [r["used_in_fix"] for r in s] == [True, False] and s[0]["cn0_dbhz"] == 41.5


def test_trajectory_families(spark, put):
    geo = put("a.csv", " Timestamp ,Lat,LON,altitude\n1700000000,30.5,120.5,1\n1700000001,,120.5,1\n")
    rows = trajectory.read_trajectory(spark, geo).collect()
    assert len(rows) == 1 and rows[0]["timestamp"] == datetime(2023, 11, 14, 22, 13, 20)
    ecef = put("b.csv", "epoch,x,y,z\n1700000000000000000,6378137.0,0,0\n")
    r = trajectory.read_trajectory(spark, ecef, trajectory.STREET).first()
    assert r["latitude"] == pytest.approx(0) and r["altitude"] == pytest.approx(0, abs=1e-6) and r["timestamp"].year == 2023
    seq = put("c.csv", "index,latitude,longitude\n1,1,1\n2,2,2\n3,3,3\n")
    rows = trajectory.read_trajectory(spark, seq, trajectory.URBAN).orderBy("timestamp").collect()
    assert [r["timestamp"].microsecond for r in rows] == [0, 10000, 20000]
    timed = put("timed.csv", "index,latitude,longitude\n1700000000,5,5\n1700000001,6,6\n")
    rows = trajectory.read_trajectory(spark, [seq, timed], trajectory.URBAN).collect()
    at = {r["latitude"]: r["timestamp"] for r in rows}
    assert [at[k].microsecond for k in (1, 2, 3)] == [0, 10000, 20000] and at[1].year == 2024
    assert (at[5], at[6]) == (datetime(2023, 11, 14, 22, 13, 20), datetime(2023, 11, 14, 22, 13, 21))
    untimed = put("d.csv", "latitude,longitude\n1,1\n2,2\n")
    rows = trajectory.read_trajectory(spark, untimed, trajectory.STREET).orderBy("timestamp").collect()
    assert [r["timestamp"].second for r in rows] == [0, 1]
    with pytest.raises(ValueError, match="time column"):
        trajectory.read_trajectory(spark, untimed, trajectory.VEHICLE)
    with pytest.raises(ValueError, match="position"):
        trajectory.read_trajectory(spark, put("e.csv", "time,a\n1,2\n"))


def test_campus_files(spark, put):
    gps = put("gps.csv", "1344096838000000,3,0,0.7379,-1.4607,270.0,1,2\n1344096838200000,1,0,0.7379,-1.4607,270.0,1,2\n")
    fixes = trajectory.campus_fixes(trajectory.read_headerless(spark, gps, trajectory.CAMPUS_GPS_8))
    err = put("err.csv", "1344096838100000,1.5\n1344096838900000,nan\n1344096838950000,oops\n")
    errors = trajectory.campus_error(trajectory.read_headerless(spark, err, trajectory.CAMPUS_ERROR)).drop("path", "utime")
    out = trajectory.campus_epochs(fixes.withColumn("s", F.lit("d")), errors.withColumn("s", F.lit("d")), ["s"]).orderBy("utime").collect()
    assert [r["err_m"] for r in out] == [1.5, 1.5] and [r["fix_quality"] for r in out] == [1, 0]
    assert out[0]["lat_sigma"] == pytest.approx(1.5 / 2**0.5) and out[0]["lat"] == pytest.approx(42.2786, abs=1e-3)
    raw = put("raw.csv", "1344096838000000,3,7,422930000,-837097000,270000,1,2,3,4,5\n1,3,7,,1,1,1,1,1,1,1\n")
    r = trajectory.campus_raw(trajectory.read_headerless(spark, raw, trajectory.CAMPUS_GPS_11)).collect()
    assert len(r) == 1 and (r[0]["latitude"], r[0]["altitude"], r[0]["solution_quality"]) == (42.293, 270.0, 5)


def test_file_choice_and_names(spark, put, tmp_path):
    for name in ("d1/gps.csv", "d1/gps_rtk.csv", "d2/gps.csv", "d3/readme.md", "r/A0.26O", "r/A1.26O"):
        put("tree/" + name, "x\n")
    files = listing.list_files(spark, str(tmp_path / "tree"))
    best = listing.choose_by_priority(files, ["directory"], "name", ["gps_rtk.csv", "gps.csv"]).collect()
    assert {r["directory"].rsplit("/", 1)[1]: r["name"] for r in best} == {"d1": "gps_rtk.csv", "d2": "gps.csv"}
    last = listing.choose_by_priority(files, ["directory"], "name", ["%.26O", "%.25O"], last=True).collect()
    assert [r["name"] for r in last] == ["A1.26O"]
    names = spark.createDataFrame([("gnss_log_2026_05_04_10_11_12",), ("Roof-top_gnss_log_x",), ("other",)], "n string")
    label, time = listing.log_label(F.col("n"))
    got = [tuple(r) for r in names.select(label.alias("a"), time.alias("b")).collect()]
    assert got == [("", "10_11_12"), ("Roof top", "x"), ("", "other")]
    tails = names.select(listing.dotted_tail(F.lit("20210518.tunnel.cht.google.pixel4"), 3)).first()[0]
    assert tails == "google_pixel4"


def test_tables_over_many_files(spark, put, tmp_path):
    put("p/a/x_features.csv", "timestamp,source,mean_cnr\n1,a,2.5\n")
    put("p/b/y_features.csv", "timestamp,source,hdop\n2,b,1.5\n3,b,1.0\n")
    put("p/b/other.csv", "timestamp,source\n9,z\n")
    out = listing.read_tables(spark, str(tmp_path / "p"))
    assert out.count() == 3 and set(out.columns) == {"timestamp", "source", "mean_cnr", "hdop"}
    assert out.where("source = 'b' and mean_cnr is null").count() == 2


def test_each_file_has_its_own_header(spark, put, tmp_path):
    put("t/a.csv", "# made by hand\n\ufeffepoch,x,y,z\n1700000000000000000,6378137.0,0,0\n".encode().decode("latin-1"))
    put("t/b.csv", 'Lon,"Lat",n,index\r\n2.5,1.5,"x, y",7\r\n\r\n,1.5,,8\r\n3.5,1.5,,9,extra\r\n')
    put("t/c.csv", "a,latitude,longitude\n5,1,2\n6,3,4\n")  # no time: its first column of numbers counts rows
    put("t/d.csv", "latitude,longitude,time\n9,9,2024-05-04 01:02:03\n")
    put("t/e.csv", "latitude,longitude,time\n")  # a header and nothing else
    rows = trajectory.read_trajectory(spark, str(tmp_path / "t"), trajectory.URBAN).collect()
    got = sorted((r["file_name"], round(r["latitude"], 6), round(r["longitude"], 6), r["timestamp"]) for r in rows)
    at = datetime(2024, 1, 1)
    tick = lambda n: at + timedelta(microseconds=10000 * n)
    assert got == [
        ("a.csv", 0.0, 0.0, datetime(2023, 11, 14, 22, 13, 20)),
        ("b.csv", 1.5, 2.5, tick(0)), ("b.csv", 1.5, 3.5, tick(2)),
        ("c.csv", 1.0, 2.0, tick(0)), ("c.csv", 3.0, 4.0, tick(1)),
        ("d.csv", 9.0, 9.0, datetime(2024, 5, 4, 1, 2, 3)),
    ]


def test_headers_of_files_read_in_splits(spark, put):
    path = put("long.csv", "latitude,longitude,index\n" + "".join(f"{k % 90},{k % 180},{k}\n" for k in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    try:
        rows = trajectory.read_trajectory(spark, path, trajectory.URBAN)
        got = [(r["timestamp"].second * 100 + r["timestamp"].microsecond // 10000, r["latitude"], r["longitude"]) for r in rows.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(got) == [(k, k % 90, k % 180) for k in range(500)]


def test_markers_in_split_files(spark, put):
    path = put("m.txt", "".join(f"{'>' if i % 3 == 0 else ' '} line {i}\n" for i in range(200)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        lines = read_lines(spark, path)
        out = number_records(lines, {"r": F.col("line").startswith(">")})
        got = {int(r["line"].split()[-1]): r["r"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {i: i // 3 + 1 for i in range(200)}


def test_scalar_edges(spark):
    one = spark.range(1)
    d = F.lit("2024-02-29").cast("date")
    times = {t: one.select(sc.nmea_time(F.lit(t), d)).first()[0] for t in ("235959.999", "240000", "12345", "126000", "12ab00", "000000")}
    assert times["235959.999"] == datetime(2024, 2, 29, 23, 59, 59, 999000) and times["000000"] == datetime(2024, 2, 29)
    assert all(times[t] is None for t in ("240000", "12345", "126000", "12ab00"))
    dates = [one.select(sc.nmea_date(F.lit(t))).first()[0] for t in ("010180", "311279", "310299", "1234", "ab0101")]
    assert dates == [date(1980, 1, 1), date(2079, 12, 31), None, None, None]
    assert one.select(sc.snr_digit_to_cnr(F.lit(7)), sc.snr_digit_to_cnr(F.lit(7), "midpoints")).first()[:] == (42.0, 44.5)
    lat, lon, alt = sc.ecef_to_geodetic(F.lit(-2850000.0), F.lit(4655000.0), F.lit(3288000.0))
    r = one.select(lat, lon, alt).first()
    assert r[0] == pytest.approx(31.2, abs=0.2) and r[1] == pytest.approx(121.5, abs=0.2)
    years = [one.select(sc.epoch_to_timestamp(F.lit(v))).first()[0].year for v in (1.7e9, 1.7e12, 1.7e15, 1.7e18)]
    assert years == [2023] * 4


def test_bundles_keep_the_order_of_each_recording(spark, tmp_path):
    """Many recordings in few files; lines of unknown place first, a null name as Spark names it."""
    rows = [(f"u{i % 300}", i // 300, i, f"{i:05d}") for i in range(6000)]
    rows += [(f"u{i}", -1, 0, "head\tof") for i in range(300)] + [(None, 0, 0, "first"), ("u7", None, None, "unplaced"), ("u7", 0, 0, None)]
    lines = spark.createDataFrame(rows, "path string, block long, pos long, line string").repartition(7, F.rand(1))
    write_bundles(lines, str(tmp_path / "b"), 5)
    assert len(list((tmp_path / "b").glob("*.txt"))) <= 5
    found = {}
    for r in read_lines(spark, str(tmp_path / "b"), bundled=True).orderBy("path", "block", "pos").collect():
        found.setdefault(r["path"], []).append(r["line"])
    assert found.pop("__HIVE_DEFAULT_PARTITION__") == ["first"] and len(found) == 300
    assert all(found[f"u{i}"] == ["head\tof", *[f"{j:05d}" for j in range(i, 6000, 300)]] for i in range(300) if i != 7)
    assert found["u7"][:2] == ["unplaced", "head\tof"] and "" in found["u7"] and len(found["u7"]) == 23


def test_a_row_without_time_does_not_come_before_the_header(spark, tmp_path):
    from clearsky.catalog.recordings import _lines_of_files, as_files

    rows = spark.createDataFrame([("u1", 0, 5, "1,2"), ("u1", None, None, "3,4")], "path string, block long, us long, text string")
    folder = as_files(_lines_of_files(rows, F.lit("lat,lon"), F.col("text")), "x", 2, str(tmp_path / "x"))
    out = listing.read_tables(spark, folder, "*.txt", {"lat": "int", "lon": "int"}, bundled=True)
    assert sorted(map(tuple, out.collect())) == [(1, 2), (3, 4)]


def test_bundled_observation_files_are_cut_at_epochs(spark, tmp_path):
    rows = [(p, 0, i, t) for p in "ab" for i, t in enumerate(["RINEX", "END OF HEADER", f"> 1 {p}", "G01", f"> 2 {p}", "G02"])]
    lines = spark.createDataFrame(rows, "path string, block long, pos long, line string")
    write_bundles(lines, str(tmp_path / "o"), 1, F.col("line").startswith(">"), ">")
    got = [(r["path"], r["record"].strip()) for r in rinex.read_records(spark, str(tmp_path / "o"), bundled=True).orderBy("block", "pos").collect()]
    assert got == [(p, t) for p in "ab" for t in ("RINEX\nEND OF HEADER", f"1 {p}\nG01", f"2 {p}\nG02")]


def test_nmea_epochs_dealt_to_more_tasks_are_the_same(spark, put):
    lines = read_lines(spark, put("a.nmea", NMEA * 5))
    one, many = nmea.nmea_epochs(lines, "2026-05-04"), nmea.nmea_epochs(lines, "2026-05-04", tasks=40)
    assert many.rdd.getNumPartitions() == 40
    assert sorted(map(repr, one.collect())) == sorted(map(repr, many.collect()))
