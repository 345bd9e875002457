"""Three states: what is unknown or in conflict stays so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PASSED, FAILED, UNAVAILABLE = "passed", "failed", "unavailable"
#: Names and versions that say nothing; the vocabulary is this project's own.
PLACEHOLDERS = ("", "unknown", "none", "n/a", "na", "null", "?", "0", "0.0", "0.0.0")


def validation_status(quality: Column) -> Column:
    """passed for 1, failed for any other verdict, unavailable where there is none."""
    return F.when(quality.isNull(), UNAVAILABLE).when(quality == 1, PASSED).otherwise(FAILED)


def has_provenance(validator: Column, version: Column) -> Column:
    """Whether a validator and an actual version are named."""
    named = lambda c: F.coalesce(~F.lower(F.trim(c)).isin(*PLACEHOLDERS), F.lit(False))
    return named(validator) & named(version)


def sound_validation(status: Column, validator: Column, version: Column) -> Column:
    """Whether a record may stand: a known status, and provenance for a pass."""
    known = F.coalesce(status.isin(PASSED, FAILED, UNAVAILABLE), F.lit(False))
    return known & ((status != PASSED) | has_provenance(validator, version))


def all_hold(condition: Column) -> Column:
    """An aggregate: true only if there are rows and the condition holds, known to, for each."""
    return F.coalesce(F.bool_and(F.coalesce(condition, F.lit(False))), F.lit(False))
