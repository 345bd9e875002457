"""Independence of stored copies by classes: copies that share a path or a volume, directly or through others, are one.

Classes are found by links to each path's and volume's least copy, so their number grows with the copies, not with pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.shared import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) of links (a, b): root is the least node that can be reached; nodes without links are left out.

    Every round ties each node's larger neighbours to its least one, then each node and its smaller ones to theirs, until
    nothing changes; a chain of n links takes about log n rounds.
    """
    now = stored(links.select("a", "b").filter("a <> b").distinct(), "links")
    mark = None
    while True:
        found = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if found == mark or not found[0]:
            break
        mark = found
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select("a", F.col("m").alias("b")))
        now = stored(small.filter("a <> b").distinct(), "links")
    ends = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(ends)


def copy_classes(copies: DataFrame) -> DataFrame:
    """copies (copy_id, path, volume_id, confirmed) with class_id, the least copy_id of the class. Unknown paths and
    volumes are shared with nothing. copy_id must be unique."""
    links = []
    for shared in ("path", "volume_id"):
        known = copies.filter(F.col(shared).isNotNull())
        least = known.groupBy(shared).agg(F.min("copy_id").alias("b"))
        links.append(known.select(F.col("copy_id").alias("a"), shared).join(least, shared).select("a", "b"))
    roots = components(links[0].unionByName(links[1]))
    return copies.join(roots.withColumnRenamed("node", "copy_id"), "copy_id", "left").withColumn("class_id", F.coalesce("root", "copy_id")).drop("root")


def class_summary(classes: DataFrame) -> DataFrame:
    """(class_id, n_copies, n_volumes, proven): proven if a copy of the class is confirmed to be on a known volume."""
    sure = F.coalesce(F.col("confirmed") & F.col("volume_id").isNotNull(), F.lit(False))
    return classes.groupBy("class_id").agg(F.count("*").alias("n_copies"), F.countDistinct("volume_id").alias("n_volumes"), F.bool_or(sure).alias("proven"))


def redundancy(classes: DataFrame, least: int = 2) -> DataFrame:
    """One row: copies, classes, how many classes are proven, and the verdict. Independent needs as many proven classes;
    fewer classes than that are not independent, whatever was confirmed; else nothing is proven."""
    counts = class_summary(classes).agg(F.coalesce(F.sum("n_copies"), F.lit(0)).alias("copies"), F.count("*").alias("classes"), F.count_if("proven").alias("proven"))
    return counts.withColumn("verdict", F.when(F.col("proven") >= least, "independent").when(F.col("classes") < least, "not_independent").otherwise("not_proven"))


def class_verdicts(classes: DataFrame) -> DataFrame:
    """(class_a, class_b, verdict) of pairs of different classes, on demand: for few classes."""
    s = class_summary(classes).select("class_id", "proven")
    a, b = (s.select(F.col("class_id").alias(f"class_{x}"), F.col("proven").alias(f"_{x}")) for x in "ab")
    return a.join(b, F.col("class_a") < F.col("class_b")).select("class_a", "class_b", F.when(F.col("_a") & F.col("_b"), "independent").otherwise("not_proven").alias("verdict"))
