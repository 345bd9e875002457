import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates, digests, media, names, states


def values(spark, column, rows, schema):
    frame = spark.createDataFrame(rows, schema)
    return [r[0] for r in frame.select(column).collect()]


def test_partial_dates(spark):
    text = ["2019", "2019-06", "2019-06-05", "2019:06:05 10:11:12", "2019-06-05T10:11:12+09:00", "2019-06-05 10:11Z", "2019-06-05 10:11-03:30", "2019-13", "2019-02-30", "soon", "", None]
    got = values(spark, dates.partial_date(F.col("t")), [(t,) for t in text], "t string")
    assert [g and (g["year"], g["month"], g["day"], g["time"], g["offset_min"], g["precision"]) for g in got] == [
        (2019, None, None, None, None, "year"), (2019, 6, None, None, None, "month"), (2019, 6, 5, None, None, "day"), (2019, 6, 5, "10:11:12", None, "time"),
        (2019, 6, 5, "10:11:12", 540, "time"), (2019, 6, 5, "10:11", 0, "time"), (2019, 6, 5, "10:11", -210, "time"), None, None, None, None, None,
    ]


def test_placement(spark):
    rows = [("2020-05-01", "2020-05-31"), ("2020-05-31", "2020-06-01"), (None, "2020-05-01")]
    got = values(spark, dates.placement(F.col("a").cast("date"), F.col("b").cast("date")), rows, "a string, b string")
    assert got == ["Photos/2020/05 - May", "_Needs Placement", "_Needs Placement"]


def test_zones(spark):
    rows = [("1950-07-01 00:00:00", "Asia/Tokyo"), ("2020-07-01 00:00:00", "Asia/Tokyo"), ("2020-07-01 00:00:00", None)]
    got = values(spark, dates.local_time(F.col("t").cast("timestamp_ntz"), F.col("z")).cast("string"), rows, "t string, z string")
    assert got == ["1950-07-01 10:00:00", "2020-07-01 09:00:00", None]


def test_coordinates(spark):
    rows = [("34.5N", None), ("34.5", "S"), ("-34.5", None), ("34,30.0S", None), ("34 30 36 N", None), ("34.5N", "S"), ("-34.5", "S"), ("95N", None), ("181", None), ("x", None), (None, "N")]
    got = values(spark, dates.coordinate(F.col("t"), F.col("r")), rows, "t string, r string")
    assert got == [34.5, -34.5, -34.5, -34.5, pytest.approx(34.51), None, None, None, None, None, None]


def test_names(spark):
    media_names = ["a.jpg", "a(2).jpg", "a_very_long_name_of_a_photo_that_goes_on_and_on_and_on.jpg", None]
    got = values(spark, names.sidecar_name(F.col("n")), [(n,) for n in media_names], "n string")
    assert got[:2] == ["a.jpg.supplemental-metadata.json", "a.jpg.supplemental-metadata(2).json"] and len(got[2]) == 51 and got[2].endswith(".json") and got[3] is None
    assert values(spark, names.camera_number(F.col("n")), [("IMG_0012.JPG",), ("x",), ("DSC1-22b",)], "n string") == [12, None, 22]
    got = values(spark, names.format_family(F.col("n")), [("a/B.JPG",), ("b.heic",), ("c.MKV",), ("d.dng",), ("e.xyz",), ("noending",), (None,)], "n string")
    assert got == ["JPEG", "HEIF", "VIDEO", "RAW", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
    paths = ["a/b.jpg", "../a", "a/../b", "/a", "C:/a", "a\\b", "a//b", "a/./b", "a/", "", None, "a..b/c"]
    assert values(spark, names.unsafe_path(F.col("p")), [(p,) for p in paths], "p string") == [False] + [True] * 10 + [False]
    rows = [("Nara", "29", "Japan"), ("Nara", "Nara", "Japan"), (None, "Nara", "Japan"), (None, "29", None)]
    assert values(spark, names.place_label(*map(F.col, "crn")), rows, "c string, r string, n string") == ["Nara, Japan", "Nara, Japan", "Nara, Japan", None]


def test_states(spark):
    rows = [("passed", "Pillow", "11.0"), ("passed", "Pillow", "unknown"), ("passed", None, "1"), ("failed", None, None), ("odd", "a", "1"), (None, "a", "1")]
    assert values(spark, states.sound_validation(*map(F.col, "svn")), rows, "s string, v string, n string") == [True, False, False, True, False, False]
    gate = states.all_hold(F.col("ok"))
    for rows, want in (([], False), ([(True,)], True), ([(True,), (None,)], False), ([(True,), (False,)], False)):
        assert spark.createDataFrame(rows, "ok boolean").agg(gate).first()[0] is want


def test_digests(spark):
    frame = spark.createDataFrame([("b", "2"), ("a", "1")], "p string, d string")
    assert frame.agg(digests.tree_digest(F.col("p"), F.col("d"))).first()[0] == hashlib.sha256(b"a:1;b:2").hexdigest() == digests.files_digest([("b", "2"), ("a", "1")])
    rows = spark.createDataFrame([(1, None), (1, "x"), (1, None)], "a int, b string").select(digests.signature("a", "b")).collect()
    assert rows[0] == rows[2] != rows[1]
    app = lambda text: b"\xff\xe1" + struct.pack(">H", 2 + len(text)) + text
    scan = b"\xff\xda\x00\x03\x01abc\xff\xd9"
    one, two = (b"\xff\xd8" + app(t) + b"\xff\xdb\x00\x03\x01" + scan for t in (b"old", b"newer"))
    assert digests.jpeg_payload_digest(one) == digests.jpeg_payload_digest(two) != digests.jpeg_payload_digest(one[:-1]) and digests.jpeg_payload_digest(b"GIF") is None


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def movie(handler):
    return box(b"ftyp", b"isom", bytes(4)) + box(b"moov", box(b"trak", box(b"mdia", box(b"hdlr", bytes(8), handler, bytes(13)))))


def test_media():
    assert media.video_streams(movie(b"vide")) == 1 and media.video_streams(movie(b"soun")) == 0 and media.video_streams(b"junk") == 0
    jpeg = b"\xff\xd8\xff\xe1 MotionPhoto=1 \xff\xd9"
    assert media.motion_photo(jpeg) == "claimed" and media.motion_photo(jpeg + movie(b"vide")) == "embedded" and media.motion_photo(jpeg + movie(b"soun")) == "claimed"
    assert media.motion_photo(b"\xff\xd8\xff\xe1 MicroVideoOffset=99 \xff\xd9" + movie(b"vide")) == "offset-only" and media.motion_photo(b"\xff\xd8\xff\xd9") == "none"
    heif = box(b"ftyp", b"heic", bytes(4)) + box(b"meta", b"x")
    assert media.motion_photo(heif + box(b"mpvd", movie(b"vide"))) == "embedded" and media.motion_photo(heif + box(b"mpvd", movie(b"vide")) + box(b"free")) == "none"
    assert media.signature_format(heif) == "HEIF" and media.signature_format(movie(b"vide")) == "VIDEO" and media.signature_format(b"") == "UNKNOWN"


def test_general_brands_are_told_by_the_compatible_ones():
    file = lambda *brands: (16 + 4 * (len(brands) - 1)).to_bytes(4, "big") + b"ftyp" + brands[0] + bytes(4) + b"".join(brands[1:]) + bytes(20)
    told = [media.signature_format(file(*b)) for b in ((b"mif1", b"miaf", b"avif"), (b"mif1", b"heic"), (b"mif1",), (b"msf1", b"avis"), (b"heic", b"avif"), (b"avif", b"heic"))]
    assert told == ["AVIF", "HEIF", "HEIF", "AVIF", "HEIF", "AVIF"]
