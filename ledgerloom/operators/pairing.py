"""Pairs: sidecars with media, stills with movies, adjacent rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.names import folder_of, file_name, sidecar_name


def pair_sidecars(media: DataFrame, sidecars: DataFrame) -> DataFrame:
    """media (occ_id, member_path) with sidecars (occ_id, folder, filename): one row for each media file.

    They meet within one logical folder, from whatever part of the export. state: paired, none, or ambiguous if the
    name fits several.
    """
    m = media.select(F.col("occ_id"), folder_of(F.col("member_path")).alias("folder"), sidecar_name(file_name(F.col("member_path"))).alias("filename"))
    s = sidecars.groupBy("folder", "filename").agg(F.count("*").alias("_s"), F.min("occ_id").alias("sidecar_occ_id"))
    n = m.groupBy("folder", "filename").agg(F.count("*").alias("_m"))
    joined = m.join(n, ["folder", "filename"]).join(s, ["folder", "filename"], "left")
    state = F.when(F.col("_s").isNull(), "none").when((F.col("_s") > 1) | (F.col("_m") > 1), "ambiguous").otherwise("paired")
    return joined.select("occ_id", state.alias("state"), F.when(state == "paired", F.col("sidecar_occ_id")).alias("sidecar_occ_id"))


def pair_live_photos(items: DataFrame) -> DataFrame:
    """items (occ_id, content_identifier, kind): stills and movies with one identifier, if exactly one of each has it."""
    g = items.filter("content_identifier is not null").groupBy("content_identifier").agg(F.count_if(F.col("kind") == "still").alias("_s"), F.count_if(F.col("kind") == "movie").alias("_m"), F.count("*").alias("_n"), F.min(F.when(F.col("kind") == "still", F.col("occ_id"))).alias("still_occ_id"), F.min(F.when(F.col("kind") == "movie", F.col("occ_id"))).alias("movie_occ_id"))
    return g.filter("_s = 1 and _m = 1 and _n = 2").select("content_identifier", "still_occ_id", "movie_occ_id")


def pair_adjacent(df: DataFrame, key: list[str], order: str, kind: str, first: str, second: str) -> DataFrame:
    """Rows of kind `first` that the next row of kind `second` follows at once."""
    w = Window.partitionBy(*key).orderBy(order)
    return df.withColumns({"_k": F.lead(kind).over(w), "next_" + order: F.lead(order).over(w)}).filter((F.col(kind) == first) & (F.col("_k") == second)).drop("_k")


def pair_unique(df: DataFrame, digest: Column, source: str, key: str) -> DataFrame:
    """Contents with exactly two occurrences, from two sources."""
    g = df.groupBy(digest.alias("sha256")).agg(F.count("*").alias("_n"), F.countDistinct(source).alias("_s"), F.min(key).alias("first_id"), F.max(key).alias("second_id"))
    return g.filter("_n = 2 and _s = 2").drop("_n", "_s")
