"""Imports into a vault that end at any point."""

import hashlib
import os

import pytest

from ledgerloom.sources import vault as V
from ledgerloom.sources.commits import STAGING


@pytest.fixture
def archives(spark, tmp_path):
    rows = []
    for i in range(7):
        at = tmp_path / "in" / f"export-{i}.zip"
        at.parent.mkdir(exist_ok=True)
        at.write_bytes(b"bytes" * (i % 5 + 1) * 1000)  # two of them are the same as others
        rows.append((str(at), f"part {i}"))
    return spark.createDataFrame(rows, "archive_path string, label string")


def audited(spark, at):
    return V.audit(spark, str(at)).first().asDict()


def staging(at):
    return [n for n in os.listdir(at) if n.endswith(STAGING)]


def test_import_and_again(spark, archives, tmp_path):
    at = tmp_path / "vault"
    at.mkdir()
    assert audited(spark, at) == {"records": 0, "archives": 0, "problems": 0}
    for _ in range(2):
        V.import_archives(archives, f"file://{at}")
        assert audited(spark, at) == {"records": 7, "archives": 5, "problems": 0} and not staging(at)
    told = V.records(spark, str(at)).collect()
    assert {r["archive_path"] for r in told} == {f"export-{i}.zip" for i in range(7)}
    for r in told:
        data = (at / r["path"]).read_bytes()
        assert hashlib.sha256(data).hexdigest() == r["sha256"] and len(data) == r["size"]


def test_killed_between_object_and_record(spark, archives, tmp_path):
    """Objects without records are seen as such, no record is; the next run makes it whole and copies nothing again."""
    at = tmp_path / "vault"
    at.mkdir()
    (at / "records").write_text("in the way of the commit")
    with pytest.raises(Exception, match="records"):
        V.import_archives(archives, str(at))
    (at / "records").unlink()
    (at / f"run-that-lost-power{STAGING}" / "0-1").mkdir(parents=True)  # what no abort has cleaned up
    (at / f"run-that-lost-power{STAGING}" / "0-1" / "object").write_bytes(b"half an arch")
    assert audited(spark, at) == {"records": 0, "archives": 0, "problems": 5} and len(staging(at)) == 1
    before = {p: os.stat(p).st_ino for p in (at / "objects").rglob("*") if p.is_file()}
    V.import_archives(archives, str(at))
    assert audited(spark, at) == {"records": 7, "archives": 5, "problems": 0}
    assert before == {p: os.stat(p).st_ino for p in (at / "objects").rglob("*") if p.is_file()}
    assert V.sweep(str(at)) == [] and len(V.sweep(str(at), stale_seconds=0)) == 1 and not staging(at)
    assert audited(spark, at)["problems"] == 0


def test_a_failed_task_publishes_nothing(spark, archives, tmp_path):
    at = tmp_path / "vault"
    at.mkdir()
    wrong = archives.unionByName(spark.createDataFrame([(str(tmp_path / "gone.zip"), "none")], archives.schema))
    with pytest.raises(Exception, match="gone.zip"):
        V.import_archives(wrong, str(at))
    assert audited(spark, at)["records"] == 0 and not staging(at)
    V.import_archives(archives, str(at))
    assert audited(spark, at) == {"records": 7, "archives": 5, "problems": 0}


def test_conflicts_and_links_are_refused(spark, archives, tmp_path):
    at = tmp_path / "vault"
    V.import_archives(archives, str(at))
    first = next(p for p in (at / "objects").rglob("*") if p.is_file())
    first.write_bytes(b"other bytes")
    with pytest.raises(Exception, match="other bytes than its name says"):
        V.import_archives(archives, str(at))
    assert audited(spark, at)["problems"] > 0
    other = tmp_path / "linked"
    other.mkdir()
    (tmp_path / "elsewhere").mkdir()
    (other / "objects").symlink_to(tmp_path / "elsewhere")
    with pytest.raises(Exception, match="goes over a link"):
        V.import_archives(archives, str(other))
    assert not os.listdir(tmp_path / "elsewhere")
    with pytest.raises(Exception, match="never overwritten"):
        archives.write.format("archive_vault").mode("overwrite").save(str(at))
