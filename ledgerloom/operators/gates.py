"""Gates that fail closed: allow-lists, storage independence, readiness, format versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.states import all_hold

#: Formats and versions that may be written to.
SUPPORTED_FORMATS = {"ledgerloom.archive": (1,)}


def qualified(tools: DataFrame, registry: DataFrame, on: tuple[str, ...] = ("version", "executable_sha256")) -> DataFrame:
    """Tools whose version and bytes are both registered."""
    return tools.join(registry.select(*on).distinct(), list(on), "left_semi")


def denied(tools: DataFrame, allow_list: DataFrame, on: tuple[str, ...] = ("version", "executable_sha256")) -> DataFrame:
    """Tools that aren't on the list; an empty list denies all."""
    return tools.join(allow_list.select(*on).distinct(), list(on), "left_anti")


def storage_independence(copies: DataFrame) -> DataFrame:
    """copies (copy_id, path, volume_id, confirmed): a verdict for each pair. Equal paths or volumes are not independent,
    whatever was confirmed; different volumes alone prove nothing. Copies of one archive are few."""
    a, b = (copies.select(*(F.col(c).alias(f"{c}_{s}") for c in ("copy_id", "path", "volume_id", "confirmed"))) for s in "ab")
    pairs = a.join(b, F.col("copy_id_a") < F.col("copy_id_b"))
    same = F.coalesce(F.col("path_a") == F.col("path_b"), F.lit(False)) | F.coalesce(F.col("volume_id_a") == F.col("volume_id_b"), F.lit(False))
    known = F.coalesce(F.col("confirmed_a") & F.col("confirmed_b") & F.col("volume_id_a").isNotNull() & F.col("volume_id_b").isNotNull(), F.lit(False))
    return pairs.select("copy_id_a", "copy_id_b", F.when(same, "not_independent").when(known, "independent").otherwise("not_proven").alias("verdict"))


def readiness(df: DataFrame, key: list[str], gates: dict[str, Column], complete: Column | None = None, others: tuple[Column, ...] = ()) -> DataFrame:
    """A row for each key: whether each gate holds for all of its rows, whether all do, and those that block.

    Unknown is not passed, and no rows are not passed. `complete` (a migration's end) is told beside it and neither
    makes ready nor blocks. others: more aggregates of the same pass.
    """
    done = () if complete is None else (all_hold(complete).alias("complete"),)
    out = df.groupBy(*key).agg(F.count("*").alias("n"), *(all_hold(c).alias(g) for g, c in gates.items()), *done, *others)
    blockers = F.filter(F.array(*(F.when(~F.col(g), F.lit(g)) for g in gates)), lambda x: x.isNotNull())
    return out.withColumns({"blockers": blockers, "ready": F.size(blockers) == 0})


def require_format(name: str | None, version: int | None, empty_destination: bool, supported: dict[str, tuple[int, ...]] | None = None) -> None:
    """Raises unless the destination has a format that is known here, or is new and empty."""
    if name is None:
        if not empty_destination:
            raise ValueError("the destination isn't empty and has no format manifest")
        return
    if version not in (supported or SUPPORTED_FORMATS).get(name, ()):
        raise ValueError(f"format {name} version {version} isn't supported")
