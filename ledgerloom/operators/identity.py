"""Content identity: equal bytes, their occurrences, hints and fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_groups(df: DataFrame, digest: Column, source: str, key: str) -> DataFrame:
    """One row for each content: how many occurrences and sources, and the first occurrence."""
    return df.groupBy(digest.alias("sha256")).agg(F.count("*").alias("n"), F.countDistinct(source).alias("n_sources"), F.min(key).alias("first_id"))


def duplicates(groups: DataFrame) -> DataFrame:
    return groups.filter("n > 1")


def canonical(df: DataFrame, digest: Column, key: str) -> DataFrame:
    """One representative of each content: the occurrence with the least key. Aggregates before it shuffles."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(digest.alias("sha256")).agg(F.min(F.struct(key, *rest)).alias("_r"))
    return best.select("sha256", F.col(f"_r.{key}").alias(key), *(F.col(f"_r.{c}").alias(c) for c in rest))


def hint_multiplicity(df: DataFrame, identity: Column, hint: str) -> DataFrame:
    """Distinct hints of one identity; more than one needs review."""
    out = df.groupBy(identity.alias("identity")).agg(F.count("*").alias("n"), F.countDistinct(hint).alias("n_hints"))
    return out.withColumn("review", F.col("n_hints") > 1)


def field_consensus(df: DataFrame, digest: Column, field: str) -> DataFrame:
    """The field's value where all known ones agree; disputed where they don't; null and undisputed where none is known."""
    out = df.groupBy(digest.alias("sha256")).agg(F.countDistinct(field).alias("n_values"), F.min(field).alias("_v"))
    return out.select("sha256", "n_values", F.when(F.col("n_values") == 1, F.col("_v")).alias("agreed"), (F.col("n_values") > 1).alias("disputed"))


def exports_delta(first: DataFrame, later: DataFrame, key: str) -> DataFrame:
    """How many keys are new, reappear, or weren't exported again."""
    a, b = (x.select(key).distinct().withColumn(n, F.lit(True)) for x, n in ((first, "_a"), (later, "_b")))
    both = a.join(b, key, "full_outer")
    state = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "not_reexported").otherwise("reappeared")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def latest_intake(previous: DataFrame, incoming: DataFrame, key: list[str], signature: Column, run: str) -> DataFrame:
    """Rows of a later export that are a revision: known bytes whose metadata changed, or bytes not known before."""
    last = previous.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(run)))).filter("_n = 1")
    known = last.select(*key, signature.alias("_old"))
    return incoming.withColumn("_new", signature).join(known, key, "left").filter(F.col("_old").isNull() | (F.col("_old") != F.col("_new"))).drop("_old", "_new")


def union_parts(parts: list[DataFrame]) -> DataFrame:
    """All parts of an export as one input; repeated rows stay."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
