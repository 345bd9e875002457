import json
import os
import sys
import zipfile

import pytest

from ledgerloom.sources import archives, commits, packs, sidecars, tools


@pytest.fixture
def exports(tmp_path):
    folder = tmp_path / "exports"
    folder.mkdir()
    with zipfile.ZipFile(folder / "one.zip", "w") as z:
        z.writestr("Photos/a.jpg", b"\xff\xd8\xff one")
        with pytest.warns(UserWarning):
            z.writestr("Photos/a.jpg", b"\xff\xd8\xff two")
        z.writestr("Photos/big.bin", bytes(5000))
    with zipfile.ZipFile(folder / "two.zip", "w") as z:
        z.writestr("Photos/a.jpg.supplemental-metadata.json", json.dumps({"title": "a", "geoData": {"latitude": 1.5}, "odd": [1]}))
        z.writestr("Photos/b.jpg.supplemental-metadata.json", "not json")
    return str(folder)


def test_archives(spark, exports):
    got = archives.read_archives(spark, exports, inline_bytes=1000)
    rows = {(os.path.basename(r["archive_path"]), r["member_ordinal"]): r for r in got.collect()}
    assert len(rows) == 5 and rows["one.zip", 1]["warning"] and not rows["one.zip", 0]["warning"]
    assert rows["one.zip", 0]["sha256"] != rows["one.zip", 1]["sha256"] and rows["one.zip", 2]["content"] is None and rows["one.zip", 2]["size"] == 5000
    assert got.rdd.getNumPartitions() == 2 and archives.occurrences(got).select("occ_id").distinct().count() == 5
    side = {r["filename"]: r for r in sidecars.sidecars(got).collect()}
    good, bad = side["a.jpg.supplemental-metadata.json"], side["b.jpg.supplemental-metadata.json"]
    assert good["parsed"]["title"] == "a" and good["parsed"]["geoData"]["latitude"] == 1.5 and json.loads(good["raw_json"])["odd"] == [1] and good["folder"] == "Photos"
    assert bad["raw_json"] == "not json" and bad["rest"] is None


def test_validators_fail_closed(spark):
    rows = [("1", "RAW", b"x"), ("2", "JPEG", b"GIF89a"), ("3", "UNKNOWN", b"x"), ("4", "JPEG", None), ("5", "VIDEO", b"\0\0\0\x0cftypisom")]
    got = {r["occ_id"]: r for r in tools.validate(spark.createDataFrame(rows, "occ_id string, family string, content binary")).collect()}
    assert [got[k]["status"] for k in "12345"] == ["unavailable", "failed", "unavailable", "unavailable", "failed"]
    code, _, problem = tools.bounded([sys.executable, "-c", "import time; time.sleep(30)"], 0.5)
    assert code is None and "0.5" in problem
    assert tools.bounded(["/no/such/tool"], 1)[0] is None and not tools.may_write_metadata("13.59", "x")
    with pytest.raises(ValueError):
        tools.bounded(["true"], 0)


def test_metadata_reader(spark, tmp_path):
    tool = tmp_path / "tool"
    tool.write_text('#!/bin/sh\n[ "$1" = -ver ] && echo 13.59 || echo "[{}]"\n')
    tool.chmod(0o755)
    items = spark.createDataFrame([("1", b"x"), ("2", None)], "occ_id string, content binary")
    got = {r["occ_id"]: r for r in tools.MetadataReader(str(tool)).apply(items).collect()}
    assert got["1"]["metadata_json"].strip() == "[{}]" and got["1"]["tool_version"] == "13.59" and got["2"]["metadata_json"] is None
    got = tools.MetadataReader(str(tool), versions=("1.0",)).apply(items).collect()
    assert all(r["metadata_json"] is None and "reviewed" in r["problem"] for r in got)


def test_packs(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("1\tNara\n")
    made = {"role": "places", "version": "1", "source": "s", "license": "l", "attribution": "a", "temporal_scope": "current", "files": [{"path": "t.tsv", "sha256": archives.file_sha256(str(tmp_path / "t.tsv"))}]}
    (tmp_path / "pack.json").write_text(json.dumps(made))
    row = packs.read_pack(spark, str(tmp_path), "t.tsv", "id int, name string").first()
    assert row["name"] == "Nara" and len(row["pack_sha256"]) == 64
    with pytest.raises(ValueError, match="past"):
        packs.read_pack(spark, str(tmp_path), "t.tsv", "id int, name string", historical=True)
    (tmp_path / "t.tsv").write_text("changed")
    with pytest.raises(ValueError):
        packs.verify_pack(str(tmp_path))


def test_mirror_resumes(spark, tmp_path):
    source, target = tmp_path / "s", tmp_path / "t"
    for i in range(12):
        (source / f"d{i % 3}").mkdir(parents=True, exist_ok=True)
        (source / f"d{i % 3}" / f"{i}.bin").write_bytes(str(i).encode() * 100)
    manifest = commits.scan_tree(spark, str(source)).cache()
    for i in range(3):  # an interrupted run left three files
        (target / f"d{i}").mkdir(parents=True, exist_ok=True)
        (target / f"d{i}" / f"{i}.bin").write_bytes(str(i).encode() * 100)
    (target / "extra").write_text("stays")
    commits.format_manifest(str(target), upgrade=True)  # the run that was interrupted had begun with it
    got = commits.materialize(manifest, str(source), str(target), str(tmp_path / "plan1"))
    assert got == {"copied": 9, "reused": 3, "verified": 12, "ok": True} and (target / "extra").exists()
    assert commits.synchronize(manifest, str(source), str(target), str(tmp_path / "plan2")) == {"ok": True, "unsafe_paths": 0, "conflicts": 0, "missing": 0, "leftovers": []}
    (target / "d0" / "0.bin").write_bytes(b"other")
    (target / "d1" / "1.bin").unlink()
    got = commits.synchronize(manifest, str(source), str(target), str(tmp_path / "plan3"))
    assert not got["ok"] and got["conflicts"] == 1 and got["missing"] == 1  # the whole set is checked before any write
    assert (target / "d0" / "0.bin").read_bytes() == b"other"


def test_vault_after_interruption(tmp_path):
    def stop(record):
        raise RuntimeError("power loss")

    items = [({"archive": "a", "ordinal": 0}, b"bytes")]
    with pytest.raises(RuntimeError):
        commits.import_to_vault(items, str(tmp_path), stop)
    assert not (tmp_path / "records").exists()
    assert commits.import_to_vault(items, str(tmp_path)) == ["reused"] and len(list((tmp_path / "records").iterdir())) == 1
    assert commits.import_to_vault(items, str(tmp_path)) == ["reused"] and commits.leftovers(str(tmp_path)) == []


def test_links_and_overwrites_are_refused(tmp_path):
    (tmp_path / "real").mkdir()
    os.symlink(tmp_path / "real", tmp_path / "link")
    with pytest.raises(ValueError, match="link"):
        commits.commit_pieces([b"x"], str(tmp_path), "link/f", "0" * 64)
    with pytest.raises(ValueError, match="planned"):
        commits.commit_pieces([b"x"], str(tmp_path), "real/f", "0" * 64)
    assert commits.leftovers(str(tmp_path)) == [] and not (tmp_path / "real" / "f").exists()
    commits.write_report(str(tmp_path / "r.json"), {"ok": True})
    with pytest.raises(FileExistsError):
        commits.write_report(str(tmp_path / "r.json"), {"ok": False})


def test_format_manifest(tmp_path):
    new = tmp_path / "new"
    assert commits.format_manifest(str(new)) == commits.format_manifest(str(new), upgrade=True)
    old = tmp_path / "old"
    old.mkdir()
    (old / "photo").write_text("x")
    with pytest.raises(ValueError):
        commits.format_manifest(str(old))
    commits.format_manifest(str(old), upgrade=True)
    assert (old / "photo").read_text() == "x"
    (old / commits.MANIFEST).write_text('{"format": "ledgerloom.archive", "version": 99}')
    with pytest.raises(ValueError):
        commits.format_manifest(str(old), upgrade=True)


def test_nothing_is_written_when_a_source_is_gone_or_changed(spark, tmp_path):
    source, target = tmp_path / "s", tmp_path / "t"
    source.mkdir()
    for i in range(6):
        (source / f"{i}.bin").write_bytes(bytes([i]) * 50)
    manifest = spark.createDataFrame(commits.scan_tree(spark, str(source)).collect(), "path string, size long, sha256 string")
    (source / "3.bin").unlink()
    with pytest.raises(ValueError, match="nothing was written"):
        commits.synchronize(manifest, str(source), str(target), str(tmp_path / "plan1"))
    (source / "3.bin").write_bytes(b"other bytes")
    with pytest.raises(ValueError, match="nothing was written"):
        commits.materialize(manifest, str(source), str(target), str(tmp_path / "plan2"))
    assert not [n for _, _, names in os.walk(target) for n in names]


def test_video_signatures(spark):
    from ledgerloom.functions import media

    m2ts = b"".join(bytes(4) + b"\x47" + bytes(187) for _ in range(3))
    movies = [bytes.fromhex("000001ba") + bytes(60), media.ASF + bytes(40), m2ts, (b"\x47" + bytes(187)) * 3, b"\x00\x00\x00\x08wide\x00\x00\x00\x10mdat" + bytes(8), b"\x00\x00\x00\x08moov"]
    assert [media.signature_format(m) for m in movies] == ["VIDEO"] * 6
    rows = [(str(i), "VIDEO", m) for i, m in enumerate([*movies, b"no signature that is known"])]
    got = {r["occ_id"]: r["status"] for r in tools.validate(spark.createDataFrame(rows, "occ_id string, family string, content binary")).collect()}
    assert all(got[str(i)] != "passed" for i in range(7))
    if tools.shutil.which("ffprobe") is None:
        assert [got[str(i)] for i in range(7)] == ["unavailable"] * 4 + ["failed"] * 2 + ["unavailable"]


def test_records_and_placement(spark, tmp_path):
    from ledgerloom.sources import records

    facts = [("ab" * 32, "captured", "2001-02", "original", "exif"), ("ab" * 32, "captured", "2001-02", "confirmed", "user"), ("ab" * 32, "description", 'a < "b" & c', "original", "xmp"), ("ab" * 32, "description", "guess", "suggested", "model"), ("cd" * 32, "captured", "1999", "original", "exif"), ("cd" * 32, "captured", "2000", "original", "json"), ("cd" * 32, "other", None, "original", "x")]
    made = records.records(spark.createDataFrame(facts, "sha256 string, field string, value string, fact_class string, source string"))
    records.write_records(made, str(tmp_path / "a"))
    records.write_records(made, str(tmp_path / "a"))  # a rerun finds exact bytes
    base = tmp_path / "a" / "records"
    xmp = (base / "ab" / ("ab" * 32 + ".xmp")).read_text()
    assert "<photoshop:DateCreated>2001-02<" in xmp and "a &lt; &quot;b&quot; &amp; c" in xmp and "guess" not in xmp
    assert "DateCreated>" not in (base / "cd" / ("cd" * 32 + ".xmp")).read_text()  # disputed
    found = json.loads((base / "ab" / ("ab" * 32 + ".json")).read_text())
    assert [f["field"] for f in found["fields"]] == ["captured", "description"] and len(found["fields"][1]["facts"]) == 2
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "1.jpg").write_bytes(b"x" * 9)
    digest = archives.file_sha256(str(tmp_path / "s" / "1.jpg"))
    items = lambda *rows: spark.createDataFrame(rows, "path string, sha256 string, folder string, name string")
    good = ("1.jpg", digest, "Photos/2001/02 - February", "1.jpg")
    records.place_media(items(good), str(tmp_path / "s"), str(tmp_path / "out"))
    assert (tmp_path / "out" / good[2] / "1.jpg").read_bytes() == b"x" * 9
    for bad in (("2.jpg", digest, "Photos", "2.jpg"), ("1.jpg", "00", "Photos", "2.jpg"), ("1.jpg", digest, "..", "2.jpg"), good):
        with pytest.raises(ValueError, match="nothing was written"):
            records.place_media(items(good, bad), str(tmp_path / "s"), str(tmp_path / "out2"))
    assert not [n for _, _, names in os.walk(tmp_path / "out2") for n in names]


def test_mirrors_need_a_known_format(spark, tmp_path):
    """A new destination gets the manifest with its first write; foreign, unknown and linked ones are left alone."""
    source = tmp_path / "s"
    source.mkdir()
    (source / "a.bin").write_bytes(b"bytes")
    manifest = commits.scan_tree(spark, str(source)).cache()
    new, foreign, future, linked, bad = (tmp_path / n for n in ("new", "foreign", "future", "linked", "bad"))
    assert commits.synchronize(manifest, str(source), str(new), str(tmp_path / "p1"))["ok"] and commits.check_format(str(new))["version"] == 1
    assert commits.synchronize(manifest, str(source), str(new), str(tmp_path / "p2"))["ok"]
    for at in (foreign, future, linked):
        at.mkdir()
    (foreign / "other.bin").write_bytes(b"not ours")
    (future / commits.MANIFEST).write_text('{"format": "ledgerloom.archive", "version": 99}')
    (linked / commits.MANIFEST).symlink_to(new / commits.MANIFEST)
    for k, at in enumerate((foreign, future, linked)):
        before = sorted(os.listdir(at))
        with pytest.raises(ValueError):
            commits.synchronize(manifest, str(source), str(at), str(tmp_path / f"q{k}"))
        assert sorted(os.listdir(at)) == before
    assert commits.synchronize(manifest, str(source), str(foreign), str(tmp_path / "p3"), legacy=True)["ok"] and not (foreign / commits.MANIFEST).exists()
    (source / "a.bin").write_bytes(b"changed")
    with pytest.raises(ValueError, match="nothing was written"):
        commits.synchronize(manifest, str(source), str(bad), str(tmp_path / "p4"))
    assert not os.listdir(bad)
