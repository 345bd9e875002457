"""Archives by byte ranges, and structural walks of media bytes."""

import hashlib
import os
import struct
import zipfile
import zlib

import pytest

from ledgerloom.functions.walks import Walk
from ledgerloom.sources import ranges


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def chunk(kind, body=b""):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def segment(kind, body=b""):
    return bytes([255, kind]) + struct.pack(">H", len(body) + 2) + body


def png(*middle, pixels=b"pixels"):
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + b"".join(middle) + chunk(b"IDAT", pixels) + chunk(b"IEND")


def jpeg(*middle, pixels=b"ab\xff\x00cd\xff\xd0ef", progressive=False):
    more = segment(0xC4, b"table") + segment(0xDA, b"scan two") + b"more" if progressive else b""
    return b"\xff\xd8" + b"".join(middle) + segment(0xDB, b"table") + segment(0xC0, b"frame") + segment(0xDA, b"scan") + pixels + more + b"\xff\xd9"


def webp(*middle, pixels=b"pix", flags=0):
    body = b"WEBP" + b"VP8X" + struct.pack("<I", 10) + bytes([flags]) + bytes(9) + b"".join(k + struct.pack("<I", len(b)) + b + bytes(len(b) % 2) for k, b in (*middle, (b"VP8 ", pixels)))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def heif(exif=b"Exif data", pixels=b"coded picture", colour=b"nclx", brand=b"heic", extra=0):
    """Two items: the picture and its Exif, the Exif first in the file."""
    items = [(1, b"hvc1", pixels), (2, b"Exif", exif)]
    infe = b"".join(box(b"infe", b"\x02\0\0\0", struct.pack(">HH", i, 0), kind, b"\0") for i, kind, _ in items)
    iinf, iprp = box(b"iinf", bytes(4), struct.pack(">H", 2), infe), box(b"iprp", box(b"ipco", box(b"colr", colour)))
    make = lambda at: box(b"meta", bytes(4), iinf, iprp, box(b"iloc", bytes(4), b"\x44\0", struct.pack(">H", 2), struct.pack(">HHHII", 1, 0, 1, at + len(exif), len(pixels)), struct.pack(">HHHII", 2, 0, 1, at, len(exif))))
    first = box(b"ftyp", brand, bytes(4)) + box(b"free", bytes(extra))
    meta = make(0)
    return first + make(len(first) + len(meta) + 8) + box(b"mdat", exif, pixels)


def movie(handler=b"vide", size=1000):
    return box(b"ftyp", b"isom", bytes(4)) + box(b"mdat", bytes(size)) + box(b"moov", box(b"trak", box(b"mdia", box(b"hdlr", bytes(8), handler, bytes(12)))))


GIF = b"GIF89a" + bytes(4) + b"\x80\0\0" + bytes(6) + b"\x21\xfe\x03abc\0" + b"\x2c" + bytes(9) + b"\x02\x03xyz\0" + b"\x3b"


def walked(data, step=None):
    w = Walk()
    for a in range(0, len(data), step or max(1, len(data))):
        w.feed(data[a : a + (step or len(data))])
    return w.finish()


WHOLE = {"png": png(), "jpeg": jpeg(), "progressive": jpeg(progressive=True), "webp": webp(), "heif": heif(), "avif": heif(brand=b"avif"), "movie": movie(), "gif": GIF}


@pytest.mark.parametrize("name", WHOLE)
def test_whole_and_cut_files(name):
    """Pieces of any size give the same; every shorter file fails."""
    data = WHOLE[name]
    found = walked(data)
    assert found[0] == "passed", found
    assert all(walked(data, step) == found for step in (1, 2, 7, 64))
    for n in range(12, len(data)):
        assert walked(data[:n])[0] != "passed", n


def test_metadata_is_not_in_the_payload_digest():
    same = [
        (png(), png(chunk(b"tEXt", b"a\0b"), chunk(b"eXIf", b"x"), chunk(b"tIME", bytes(7)))), (jpeg(), jpeg(segment(0xE1, b"Exif\0\0"), segment(0xE0, b"JFIF"), segment(0xFE, b"comment"), segment(0xE2, b"MPF\0"), segment(0xED, b"IPTC"))),
        (webp(), webp((b"EXIF", b"abc"), (b"XMP ", b"xyz"), flags=0x0C)), (heif(), heif(exif=b"other Exif, longer", extra=5)), (GIF, GIF.replace(b"\x03abc", b"\x04abcd")),
    ]
    for a, b in same:
        assert walked(a)[0] == walked(b)[0] == "passed" and walked(a)[2] == walked(b)[2] is not None
    other = [
        (png(), png(pixels=b"pixelz")), (png(), png(chunk(b"iCCP", b"profile"))), (png(), png(chunk(b"PLTE", b"abc"))), (jpeg(), jpeg(pixels=b"ab\xff\x00cx\xff\xd0ef")), (jpeg(), jpeg(segment(0xE2, b"ICC_PROFILE\0one"))),
        (jpeg(segment(0xE2, b"ICC_PROFILE\0one")), jpeg(segment(0xE2, b"ICC_PROFILE\0two"))), (jpeg(), jpeg(segment(0xEE, b"Adobe"))), (webp(), webp(pixels=b"pxx")), (webp(), webp((b"ICCP", b"p"))), (webp(), webp(flags=0x10)),
        (heif(), heif(pixels=b"coded pictuRe")), (heif(), heif(colour=b"prof")), (GIF, GIF.replace(b"xyz", b"xyZ")),
    ]
    for a, b in other:
        assert walked(a)[0] == walked(b)[0] == "passed" and walked(a)[2] != walked(b)[2]


def test_verdicts():
    assert walked(movie(b"soun")) == ("failed", "no video track", None, 0) and walked(movie())[3] == 1
    assert walked(png()[:-6] + b"xx" + png()[-4:])[0] == "failed" and walked(b"plain text")[0] == "unavailable" and walked(b"")[0] == "unavailable"
    assert walked(jpeg() + movie())[:2] == ("passed", f"{len(movie())} bytes after the end")
    bad = bytearray(png(pixels=b"pixels"))
    bad[bad.index(b"pixels")] ^= 1
    assert walked(bytes(bad))[:2] == ("failed", "the checksum of IDAT differs")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("exports")
    with zipfile.ZipFile(at / "one.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("Photos/a.png", png())
        z.writestr("Photos/", b"")
        z.writestr("Photos/b.jpg", jpeg(), zipfile.ZIP_STORED)
        with pytest.warns(UserWarning):
            z.writestr("Photos/a.png", png(pixels=b"others"))
        z.writestr("notes/ü.txt", "text " * 1000)
        z.writestr("empty", b"")
        with z.open("Photos/film.mp4", "w", force_zip64=True) as f:  # 100 MB that pack to little
            f.write(box(b"ftyp", b"isom", bytes(4)) + struct.pack(">I4s", 8 + 100 * (1 << 20), b"mdat"))
            for _ in range(100):
                f.write(bytes(1 << 20))
            f.write(movie()[len(box(b"ftyp", b"isom", bytes(4))) + 1008 :])
    with zipfile.ZipFile(at / "commented.zip", "w") as z:
        z.writestr("f", b"data")
        z.comment = b"a comment of some length"
    (at / "commented.zip").write_bytes((at / "commented.zip").read_bytes().replace(b"a comment", b"PK\5\6 here"))
    with zipfile.ZipFile(at / "many.ZIP", "w") as z:
        for i in range(300):
            z.writestr(f"f{i}", os.urandom(2000))
    (at / "corrupt.zip").write_bytes(b"PK\3\4" + os.urandom(3000))
    (at / "empty.zip").write_bytes(b"")
    whole = (at / "many.ZIP").read_bytes()
    hurt = bytearray(whole)
    hurt[40 + 3 * 2040] ^= 255
    (at / "hurt.zip").write_bytes(bytes(hurt))
    (at / "other.txt").write_text("not an archive")
    return str(at)


def test_directory_equals_the_librarys(spark, folder):
    listed = ranges.list_archives(spark, folder).unionByName(spark.createDataFrame([(f"{folder}/empty.zip", 0), (f"{folder}/none.zip", 0)], "archive_path string, archive_size long"))
    rows = ranges.directory(listed).collect()
    by = {}
    for r in rows:
        by.setdefault(r["archive_path"].rpartition("/")[2], []).append(r)
    assert set(by) == {"one.zip", "many.ZIP", "corrupt.zip", "empty.zip", "none.zip", "commented.zip", "hurt.zip"}
    assert all(len(by[k]) == 1 and by[k][0]["problem"] for k in ("corrupt.zip", "empty.zip", "none.zip")) and [r["member_path"] for r in by["commented.zip"]] == ["f"]
    for name in ("one.zip", "many.ZIP"):
        with zipfile.ZipFile(f"{folder}/{name}") as z:
            want = [(i, x.filename, x.CRC, x.compress_size, x.file_size, x.header_offset) for i, x in enumerate(z.infolist()) if not x.is_dir()]
        assert sorted((r["member_ordinal"], r["member_path"], r["crc32"], r["packed_size"], r["size"], r["header_at"]) for r in by[name]) == want
    assert [r["member_ordinal"] for r in by["one.zip"] if r["warning"]] == [3]


def test_members_of_any_size(spark, folder):
    members = ranges.directory(ranges.list_archives(spark, folder))
    read = ranges.read_members(members, inline_bytes=10_000, group_bytes=20_000)
    rows = {(r["archive_path"].rpartition("/")[2], r["member_ordinal"]): r for r in read.collect()}
    for name in ("one.zip", "many.ZIP"):
        with zipfile.ZipFile(f"{folder}/{name}") as z:
            for i, x in enumerate(z.infolist()):
                if not x.is_dir() and x.file_size < 10_000:
                    with z.open(x) as f:
                        data = f.read()
                    r = rows[name, i]
                    assert (r["sha256"], r["size"], bytes(r["content"])) == (hashlib.sha256(data).hexdigest(), len(data), data)
    film = next(r for r in rows.values() if r["member_path"] == "Photos/film.mp4")
    assert film["status"] == "passed" and film["video_streams"] == 1 and film["size"] > 100 << 20 and film["content"] is None and film["validator"] and film["version"]
    status = {r["member_path"]: r["status"] for k, r in rows.items() if k[0] == "one.zip"}
    assert status["Photos/b.jpg"] == "passed" and status["notes/ü.txt"] == status["empty"] == "unavailable"
    hurt = [r for k, r in rows.items() if k[0] == "hurt.zip" and r["problem"]]
    assert len(hurt) == 1 and hurt[0]["status"] == "failed" and "checksum" in hurt[0]["problem"] and len([1 for k in rows if k[0] == "hurt.zip"]) == 300
    assert rows["corrupt.zip", None]["problem"]


def test_one_archive_is_many_tasks(spark, folder):
    from pyspark.sql import functions as F

    members = ranges.directory(ranges.list_archives(spark, folder)).filter("archive_path like '%many.ZIP'")
    tasks = ranges.read_members(members, group_bytes=20_000).withColumn("task", F.spark_partition_id()).agg(F.countDistinct("task")).first()[0]
    assert tasks > 10


def test_filters_come_before_reading(spark, folder):
    """Members that aren't asked for aren't opened: one that is broken does no harm."""
    members = ranges.directory(ranges.list_archives(spark, folder)).filter("archive_path like '%hurt.zip' and member_path in ('f0', 'f1', 'f250')")
    assert [r["problem"] for r in ranges.read_members(members).collect()] == [None] * 3


def test_archive_digests(spark, folder):
    got = {r["archive_path"].rpartition("/")[2]: r["archive_sha256"] for r in ranges.archive_digests(ranges.list_archives(spark, folder)).collect()}
    for name, digest in got.items():
        with open(f"{folder}/{name}", "rb") as f:
            assert digest == hashlib.sha256(f.read()).hexdigest()
