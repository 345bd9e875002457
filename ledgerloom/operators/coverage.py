"""What an independent audit covers: each asset's media, portable sidecar, unknown files and blobs of its history, as bits.

Unknown is not covered, and what nothing is said of is not covered either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.states import PASSED, sound_validation
from ledgerloom.operators.gates import SUPPORTED_FORMATS, readiness

#: A class of files each; an asset must have those that are REQUIRED.
MEDIA, SIDECAR, UNKNOWN, HISTORY = CLASSES = ("media", "xmp", "unknown", "blob")
REQUIRED = (MEDIA, SIDECAR)
BITS = {name: 1 << i for i, name in enumerate(CLASSES)}


def _bit(kind: str) -> Column:
    out = F.lit(None)
    for name, bit in BITS.items():
        out = F.when(F.col(kind) == name, F.lit(bit)).otherwise(out)
    return out.cast("int")


def names_of(bits: Column) -> Column:
    return F.filter(F.array(*(F.when(bits.bitwiseAND(F.lit(b)) != 0, F.lit(n)) for n, b in BITS.items())), lambda x: x.isNotNull())


def item_states(expected: DataFrame, found: DataFrame) -> DataFrame:
    """expected (asset_id, kind, path, sha256) and found (path, sha256), by new hashes: adds state, which is verified,
    missing, different or unknown; files that nothing expects are unexpected, with no asset."""
    e = expected.select("asset_id", "kind", "path", "sha256", F.lit(True).alias("_e"))
    f = found.groupBy("path").agg(F.min("sha256").alias("_low"), F.max("sha256").alias("_high"), F.count_if(F.col("sha256").isNull()).alias("_none"))
    both = e.join(f, "path", "full_outer")
    state = (
        F.when(F.col("_e").isNull(), "unexpected").when(F.col("_none").isNull(), "missing").when(F.col("sha256").isNull() | (F.col("_none") > 0) | _bit("kind").isNull(), "unknown")
        .when((F.col("_low") == F.col("sha256")) & (F.col("_high") == F.col("sha256")), "verified").otherwise("different")
    )
    return both.select("asset_id", "kind", "path", "sha256", state.alias("state"))


def coverage(states: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """(asset_id, expected, verified, lacking, covered) of item_states(), a row for each asset, in one aggregate.

    expected and verified are bits of classes; a class is verified if all its files are. lacking names the classes that
    aren't, and the required ones that nothing was expected of; covered: none lacks, and no file's class is unknown.
    """
    bit = _bit("kind")
    zero = F.lit(0)
    bad = F.coalesce(F.bit_or(F.when(F.col("state") != "verified", bit)), zero)
    per = states.filter(F.col("state") != "unexpected").groupBy("asset_id").agg(F.coalesce(F.bit_or(bit), zero).alias("expected"), bad.alias("_bad"), F.count_if(bit.isNull()).alias("_odd"))
    verified = F.col("expected").bitwiseAND(F.bitwise_not("_bad"))
    needed = F.col("expected").bitwiseOR(F.lit(sum(BITS[k] for k in required)))
    lacking = names_of(needed.bitwiseAND(F.bitwise_not(verified)))
    return per.select("asset_id", "expected", verified.alias("verified"), lacking.alias("lacking"), ((F.size(lacking) == 0) & (F.col("_odd") == 0) & F.col("asset_id").isNotNull()).alias("covered"))


def supported_format(name: Column, version: Column, supported: dict[str, tuple[int, ...]] | None = None) -> Column:
    """Whether an archive's format manifest is one that is known here; none is not."""
    out = F.lit(False)
    for known, versions in (supported or SUPPORTED_FORMATS).items():
        out = out | F.coalesce((name == known) & version.isin(*versions), F.lit(False))
    return out


def verify_migration(assets: DataFrame, archives: DataFrame, key: str, legacy_analysis: bool = False) -> DataFrame:
    """A row for each archive: are all its assets covered and validated, and is its format supported?

    assets (key, covered, status, validator, version); archives (key, format, format_version), a row each. An archive
    without assets isn't ready. legacy_analysis looks at archives of earlier days without asking for a format, and says
    so: what it looks at is never ready.
    """
    rows = archives.select(key, "format", "format_version").join(assets.select(key, "covered", "status", "validator", F.col("version").alias("_version"), F.lit(True).alias("_asset")), key, "left")
    sound = (F.col("status") == PASSED) & sound_validation(F.col("status"), F.col("validator"), F.col("_version"))
    gates = {"covered": F.col("covered"), "validated": F.col("_asset") & sound}
    gates |= {"not_legacy_analysis": F.lit(False)} if legacy_analysis else {"format": supported_format(F.col("format"), F.col("format_version"))}
    return readiness(rows, [key], gates).drop("n")
