"""Append-only ledgers: the current state, and what came before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last revision of each key; order must end in a unique column. An aggregate, so rows are combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    last = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return last.select(*(c if c in key else F.col(f"_r.{c}").alias(c) for c in df.columns))


def effective(df: DataFrame, key: list[str], order: list[str], count: str = "n_prior") -> DataFrame:
    """The latest row of each key and how many came before; the history itself stays in the ledger."""
    rest = [c for c in df.columns if c not in key]
    last = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"), (F.count("*") - 1).alias(count))
    return last.select(*(c if c in key else F.col(f"_r.{c}").alias(c) for c in df.columns), count)


def changes(df: DataFrame, key: list[str], order: list[str], signature: str, previous: str = "previous") -> DataFrame:
    """Rows whose signature differs from the one before; unknown counts as a value of its own."""
    w = Window.partitionBy(*key).orderBy(*order)
    marked = df.withColumns({previous: F.lag(signature).over(w), "_n": F.row_number().over(w)})
    return marked.filter((F.col("_n") > 1) & ~F.col(signature).eqNullSafe(F.col(previous))).drop("_n")


def as_of(left: DataFrame, right: DataFrame, key: list[str], left_time: str, right_time: str, values: list[str], tie: str) -> DataFrame:
    """For each left row the right row at or before its time, of equal times the one with the largest tie.

    Both sides go through one sort: right rows carry their values forward. Left rows without one are left out.
    """
    keep = [c for c in left.columns if c not in key]
    mark = F.struct(F.col(right_time).alias("t"), F.col(tie).alias("i"), *(F.col(v).alias(f"v_{v}") for v in values))
    a = left.select(*key, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*keep).alias("_l"))
    b = right.select(*key, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), mark.alias("_m"), F.col(tie).alias("_i"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy("_t", "_side", "_i").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_m", F.last("_m", ignorenulls=True).over(w)).filter("_side = 1 and _m is not null")
    return found.select(*key, *(F.col(f"_l.{c}").alias(c) for c in keep), F.col("_m.t").alias(f"asof_{right_time}"), *(F.col(f"_m.v_{v}").alias(f"asof_{v}") for v in values))


def neighbours(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """The values before and after: evidence for a suggestion, never a fact."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumns({f"previous_{value}": F.lag(value).over(w), f"next_{value}": F.lead(value).over(w)})


def projection(decisions: DataFrame) -> DataFrame:
    """decisions (asset_id, decision_seq, ts, field, value): the effective value of each field."""
    return effective(decisions, ["asset_id", "field"], ["decision_seq"])
