"""Writes that never overwrite: staged, synced, and linked into place; a rerun fills what is missing.

Tasks may run twice, or on several machines; the last step is an exclusive link, so one wins and the other finds
exact bytes.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ledgerloom.operators.integrity import MISSING, mirror_counts, mirror_plan, preflight_passes
from ledgerloom.sources import tree
from ledgerloom.sources.archives import PIECE, file_sha256

#: Staging files have this ending; recovery must leave none.
STAGING = ".staging"
COPIED, REUSED, CONFLICT = "copied", "reused", "conflict"
MANIFEST = "ledgerloom-archive.json"


def has_link(root: str, path: str) -> bool:
    """Whether the path, or a folder between it and the root, is a link."""
    at = os.path.abspath(root)
    for part in os.path.relpath(os.path.abspath(os.path.join(root, path)), at).split(os.sep):
        at = os.path.join(at, part)
        if os.path.islink(at):
            return True
    return False


def _sync_folder(path: str) -> None:
    fd = os.open(path, os.O_RDONLY)
    try:
        os.fsync(fd)
    finally:
        os.close(fd)


def commit_pieces(pieces: Iterable[bytes], root: str, path: str, sha256: str) -> str:
    """Writes bytes with that digest to root/path. copied, reused if exact bytes are there, conflict if others are."""
    target = os.path.join(root, path)
    if has_link(root, path):
        raise ValueError(f"{path} goes over a link")
    if os.path.exists(target):
        return REUSED if file_sha256(target) == sha256 else CONFLICT
    os.makedirs(os.path.dirname(target), exist_ok=True)
    staging = f"{target}.{uuid.uuid4().hex}{STAGING}"
    try:
        found = hashlib.sha256()
        with open(staging, "xb") as f:
            for piece in pieces:
                found.update(piece)
                f.write(piece)
            f.flush()
            os.fsync(f.fileno())
        if found.hexdigest() != sha256:
            raise ValueError(f"{path}: the bytes aren't those that were planned")
        try:
            os.link(staging, target)
        except FileExistsError:
            return REUSED if file_sha256(target) == sha256 else CONFLICT
        _sync_folder(os.path.dirname(target))
        return COPIED
    finally:
        if os.path.exists(staging):
            os.unlink(staging)


def file_pieces(path: str) -> Iterator[bytes]:
    with open(path, "rb") as f:
        while piece := f.read(PIECE):
            yield piece


def leftovers(root: str) -> list[str]:
    """Staging files below root."""
    return sorted(os.path.join(d, n) for d, _, names in os.walk(root) for n in names if n.endswith(STAGING))


def scan_tree(spark, root: str) -> DataFrame:
    """manifest(path, size, sha256) of the files below root; links and what can't be read are refused. Listing and hashing
    are dealt to tasks."""
    found = tree.entries(spark, root)
    bad = found.filter(F.col("kind").isin(tree.LINK, tree.UNREADABLE, tree.OTHER)).select("path", "detail").limit(1).collect()
    if bad:
        raise ValueError(f"{os.path.join(root, bad[0]['path'])} is a link or can't be read: {bad[0]['detail']}")
    files = found.filter((F.col("kind") == tree.FILE) & ~F.col("path").endswith(STAGING)).select("path", "size")

    def run(frames):
        for f in frames:
            yield f.assign(sha256=[file_sha256(os.path.join(root, p)) for p in f["path"]])

    return files.mapInPandas(run, "path string, size long, sha256 string")


def _check_sources(plan: DataFrame, manifest: DataFrame, source: str) -> None:
    """Raises if any file that is to be copied isn't there with the planned bytes, before anything is written."""
    todo = plan.filter(F.col("status") == MISSING).join(manifest, "path").select("path", "sha256")

    def run(frames):
        for f in frames:
            full = [os.path.join(source, p) for p in f["path"]]
            bad = [has_link(source, p) or not os.path.isfile(x) or file_sha256(x) != d for p, x, d in zip(f["path"], full, f["sha256"], strict=True)]
            yield f.loc[bad, ["path"]]

    bad = [r["path"] for r in todo.mapInPandas(run, "path string").limit(5).collect()]
    if bad:
        raise ValueError(f"nothing was written: sources are gone, changed or links, such as {bad}")


def _copy(plan: DataFrame, manifest: DataFrame, source: str, destination: str) -> None:
    todo = plan.filter(F.col("status") == MISSING).join(manifest, "path").select("path", "sha256")

    def run(rows: Iterator[Row]) -> None:
        for r in rows:
            if has_link(source, r["path"]):
                raise ValueError(f"{r['path']} is a link at its source")
            if commit_pieces(file_pieces(os.path.join(source, r["path"])), destination, r["path"], r["sha256"]) == CONFLICT:
                raise ValueError(f"{r['path']}: other bytes have appeared")

    todo.foreachPartition(run)


def _mirror(manifest: DataFrame, source: str, destination: str, plan_path: str, legacy: bool) -> tuple[dict, dict]:
    spark = manifest.sparkSession
    if not legacy:
        check_format(destination)  # planning only reads; the manifest is made with the first write
    os.makedirs(destination, exist_ok=True)
    mirror_plan(manifest, scan_tree(spark, destination)).write.mode("errorifexists").parquet(plan_path)
    plan = spark.read.parquet(plan_path)  # frozen: what is checked is what is done
    counts = mirror_counts(plan).first().asDict()
    if preflight_passes(plan):
        _check_sources(plan, manifest, source)
        if not legacy:
            format_manifest(destination)
        _copy(plan, manifest, source, destination)
    after = mirror_counts(mirror_plan(manifest, scan_tree(spark, destination))).first().asDict()
    return counts, after


def synchronize(manifest: DataFrame, source: str, destination: str, plan_path: str, legacy: bool = False) -> dict:
    """Brings the destination up to the manifest and verifies it by new hashes; nothing is written if anything conflicts,
    and nothing is ever deleted. Returns the verification.

    The destination must be new, or have a format manifest that is known here; a new one gets it. legacy writes to
    archives of earlier days, which have none.
    """
    _, after = _mirror(manifest, source, destination, plan_path, legacy)
    return {"ok": bool(after["ok"] and after["reused"] == after["total"]), "unsafe_paths": after["unsafe_paths"], "conflicts": after["conflicts"], "missing": after["copied"], "leftovers": leftovers(destination)}


def materialize(manifest: DataFrame, source: str, destination: str, plan_path: str, legacy: bool = False) -> dict:
    """synchronize(), told as counts: copied, reused and verified."""
    counts, after = _mirror(manifest, source, destination, plan_path, legacy)
    return {"copied": after["reused"] - counts["reused"], "reused": counts["reused"], "verified": after["reused"], "ok": bool(after["ok"] and after["reused"] == after["total"])}


def import_to_vault(items: Iterable[tuple[dict, bytes]], vault: str, after_object=None) -> list[str]:
    """Commits each object by its digest, then its occurrence record; a rerun reuses exact bytes. after_object is called
    between the two, for tests of interruption."""
    out = []
    for record, data in items:
        digest = hashlib.sha256(data).hexdigest()
        out.append(commit_pieces([data], vault, f"objects/{digest[:2]}/{digest}", digest))
        if after_object:
            after_object(record)
        line = json.dumps(record | {"sha256": digest, "size": len(data)}, sort_keys=True).encode()
        name = hashlib.sha256(line).hexdigest()
        commit_pieces([line], vault, f"records/{name}.json", name)
    return out


def write_report(path: str, report: dict) -> None:
    """Machine-readable, once: an existing report is never replaced."""
    with open(path, "x", encoding="utf-8") as f:
        json.dump(report, f, sort_keys=True, indent=1)


def check_format(root: str, upgrade: bool = False) -> dict | None:
    """The archive's format manifest, None where one may be made; only reads. Raises for links, for formats that aren't
    known here, and for archives of earlier days, which have files and no manifest, unless they are to be upgraded."""
    from ledgerloom.operators.gates import require_format

    path = os.path.join(root, MANIFEST)
    there = [os.path.relpath(os.path.join(d, n), root) for d, folders, names in os.walk(root) for n in [*names, *folders]]
    if any(os.path.islink(os.path.join(root, p)) for p in there):
        raise ValueError("the archive has links")
    if not os.path.exists(path):
        if not upgrade:
            require_format(None, None, not there)
        return None
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    require_format(found.get("format"), found.get("version"), False)
    return found


def format_manifest(root: str, upgrade: bool = False) -> dict:
    """check_format(), and makes the manifest where there may be one: for a new folder, and for an archive of earlier days
    by an explicit upgrade, which changes no other file and may be repeated."""
    if found := check_format(root, upgrade):
        return found
    made = {"format": "ledgerloom.archive", "version": 1}
    line = json.dumps(made).encode()
    os.makedirs(root, exist_ok=True)
    commit_pieces([line], root, MANIFEST, hashlib.sha256(line).hexdigest())
    return made
