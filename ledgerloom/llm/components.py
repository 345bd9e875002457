"""Connected components of links between longs, by alternating large-star and small-star rounds.

Each round groups by one end and only keeps a minimum, so a node with very many links needs no task of its own size.
Rows of the most frequent keys, of which there are at most HOT, are joined where they are, the others by their key.
Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.base import staged


#: A key with more than this part of the rows is hot, so there are fewer of them.
HOT = 4096


def looked_up(rows: DataFrame, known: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows with the columns that known has for their key, as in an inner join. known has each key once, with the number
    n of its rows, which add up to total at most; n is left out."""
    hot = known.filter(F.col(n) > total // HOT).drop(n)
    values = [c for c in hot.columns if c != key]
    # Fewer than HOT rows: each stands for more than a part HOT of the total.
    marked = rows.join(F.broadcast(hot.select(key, F.struct(*values).alias("_hot"))), key, "left")
    near = marked.filter("_hot is not null").select(*rows.columns, *(F.col(f"_hot.{c}").alias(c) for c in values))
    far = marked.filter("_hot is null").drop("_hot").join(known.filter(F.col(n) <= total // HOT).drop(n), key)
    return near.unionByName(far)


def _large_star(links: DataFrame, total: int) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    return looked_up(both.filter("b > a"), least, "a", "n", 2 * total).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame, total: int) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    rest = looked_up(down, least, "a", "n", total).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (node, root): root is the least node that can be reached; nodes without links are left out."""
    now = staged(links.select("a", "b").filter("a <> b").distinct(), "links")
    mark = None
    while True:
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == mark or not found[0]:
            break
        mark = found
        now = staged(_small_star(_large_star(now, found[0]), found[0]), "links")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
