"""Mixing sources to target weights, with DataFrame functions only.

A token budget goes down a tree domain - language - source. At each node the children share its budget by weight; a
child that has fewer tokens than its share gives the rest to its siblings, again by weight. A node asks for no more
than all its leaves have, so a shortage only reaches a node's siblings when its own children can't fill it. A leaf may
be read in several epochs, each in its own seeded order; it gives whole epochs and then the prefix of the next one
whose tokens fit into what is left.

Defined results: tokens are runs of characters other than ASCII white space; null texts have none; null languages and
sources are the leaf 'und' and '?'; rows with equal keys are taken or left together; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.base import staged, table

WORD = r"[^\x20\x09-\x0D]+"
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANGUAGE_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}
OTHER_WEIGHT = 1
MAX_EPOCHS = 2
SEED = 17
#: The budget is this part of all tokens.
BUDGET = (3, 4)
#: Hexadecimal digits of the order key by which a leaf is cut into ranges: 16 ** 3 ranges each.
RANGE_DIGITS = 3
TREE = ("domain", "language", "source")


def _weight(name: Column, weights: dict[str, int]) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for k, v in weights.items():
        out = F.when(name == k, F.lit(v)).otherwise(out)
    return out.cast("long")


def share(children: DataFrame, parent: list[str], name: str, weight: Column) -> DataFrame:
    """Adds each child's part of `budget` as `part`; children: (*parent, name, cap, budget), the budget its parent's.

    Children are full in the order of cap / weight. Those before the first that isn't full get cap; the rest share
    what remains.
    """
    node = Window.partitionBy(*parent)
    order = node.orderBy(F.col("cap") / F.col("_w"), name)
    before, through = order.rowsBetween(Window.unboundedPreceding, -1), node
    x = children.withColumn("_w", weight)
    x = x.withColumns({"_cap": F.coalesce(F.sum("cap").over(before), F.lit(0)), "_wb": F.coalesce(F.sum("_w").over(before), F.lit(0)), "_all": F.sum("_w").over(through)})
    x = x.withColumn("_full", (F.col("budget") - F.col("_cap")) * F.col("_w") >= F.col("cap") * (F.col("_all") - F.col("_wb")))
    taken = {k: F.coalesce(F.sum(F.when(F.col("_full"), F.col(v))).over(through), F.lit(0)) for k, v in (("_c", "cap"), ("_v", "_w"))}
    x = x.withColumns(taken)
    rest = F.expr("((budget - _c) * _w) div (_all - _v)")
    return x.withColumn("part", F.when(F.col("_full"), F.col("cap")).otherwise(rest)).drop("_w", "_cap", "_wb", "_all", "_full", "_c", "_v")


def leaf_budgets(leaves: DataFrame, budget: tuple[int, int] = BUDGET, epochs: int = MAX_EPOCHS, domain_weights: dict[str, int] | None = None, language_weights: dict[str, int] | None = None) -> DataFrame:
    """leaves: (domain, language, source, tokens), a row each. Adds leaf_budget, whole_epochs and rest."""
    leaves = leaves.withColumn("cap", F.col("tokens") * epochs)
    tops = leaves.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("_t"))
    all_tokens = Window.partitionBy(F.lit(0))
    tops = tops.withColumn("budget", F.floor(F.sum("_t").over(all_tokens) * budget[0] / budget[1]).cast("long")).drop("_t").withColumn("_root", F.lit(0))
    domains = share(tops, ["_root"], "domain", _weight(F.col("domain"), domain_weights or DOMAIN_WEIGHTS)).select("domain", F.col("part").alias("budget"))
    middle = leaves.groupBy("domain", "language").agg(F.sum("cap").alias("cap")).join(domains, "domain")
    languages = share(middle, ["domain"], "language", _weight(F.col("language"), language_weights or LANGUAGE_WEIGHTS)).select("domain", "language", F.col("part").alias("budget"))
    low = share(leaves.join(languages, ["domain", "language"]), ["domain", "language"], "source", F.lit(OTHER_WEIGHT).cast("long"))
    return low.select(*TREE, "tokens", F.col("part").alias("leaf_budget"), F.coalesce(F.expr("part div nullif(tokens, 0)"), F.lit(0)).alias("whole_epochs"), F.coalesce(F.expr("part % nullif(tokens, 0)"), F.lit(0)).alias("rest"))


def order_key(seed: int = SEED) -> Column:
    """A document's place in the leaf's next epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole_epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))


def with_leaf(docs: DataFrame, domain: Column | None = None) -> DataFrame:
    language, source = F.coalesce(F.col("lang"), F.lit("und")), F.coalesce(F.col("source"), F.lit("?"))
    number = F.expr("try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) as int)")
    if domain is None:
        domain = F.coalesce(F.concat(F.lit("d"), (number % 4).cast("string")), F.lit("d?"))
    return docs.withColumns({"_domain": domain, "_language": language, "_source": source})


def cutoffs(docs: DataFrame, budget: tuple[int, int] = BUDGET, epochs: int = MAX_EPOCHS, seed: int = SEED, **weights) -> tuple[DataFrame, DataFrame]:
    """(slim documents with their leaf and tokens, leaves with whole_epochs and the last order key that still fits).

    A leaf's order keys are cut into ranges; range sums tell in which range the budget ends, and only that range is
    put in order. So a leaf with a third of all rows is never sorted in one task.
    """
    keys = ["_domain", "_language", "_source"]
    tokens = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens")
    slim = staged(with_leaf(docs).select("doc_id", *(F.col(k).alias(n) for k, n in zip(keys, TREE, strict=True)), tokens), "slim")
    leaves = staged(leaf_budgets(slim.groupBy(*TREE).agg(F.sum("n_tokens").alias("tokens")), budget, epochs, **weights), "leaves")
    keyed = slim.join(leaves.filter("rest > 0"), list(TREE)).select(*TREE, "rest", "n_tokens", order_key(seed).alias("key"))
    keyed = keyed.withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    sums = keyed.groupBy(*TREE, "range").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    upto = Window.partitionBy(*TREE).orderBy("range")
    sums = sums.withColumn("through", F.sum("n").over(upto)).filter("through > rest")
    last = sums.groupBy(*TREE).agg(F.min_by(F.struct("range", (F.col("rest") - F.col("through") + F.col("n")).alias("room")), "range").alias("x")).select(*TREE, "x.range", "x.room")
    inside = keyed.join(last, [*TREE, "range"])
    fits = inside.withColumn("through", F.sum("n_tokens").over(Window.partitionBy(*TREE, "range").orderBy("key").rangeBetween(Window.unboundedPreceding, 0)))
    ends = fits.filter("through <= room").groupBy(*TREE).agg(F.max("key").alias("key"))
    ends = last.join(ends, list(TREE), "left").select(*TREE, F.coalesce("key", "range").alias("last_key"))
    return slim, staged(leaves.join(ends, list(TREE), "left"), "cutoffs")


def _chosen(seed: int) -> Column:
    """Epochs of which a row is part, from 0; the prefix's order key decides on the last."""
    n = F.col("whole_epochs") + F.when((F.col("rest") > 0) & (order_key(seed) <= F.col("last_key")), 1).otherwise(0)
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1))


def select_epochs(docs: DataFrame, budget: tuple[int, int] = BUDGET, epochs: int = MAX_EPOCHS, seed: int = SEED, **weights) -> DataFrame:
    """(doc_id, domain, language, source, n_tokens, leaf_budget, epoch): a row for each reading of a document."""
    slim, leaves = cutoffs(docs, budget, epochs, seed, **weights)
    return slim.join(leaves.select(*TREE, "leaf_budget", "whole_epochs", "rest", "last_key"), list(TREE)).select("doc_id", *TREE, "n_tokens", "leaf_budget", F.explode(_chosen(seed)).alias("epoch"))


def mix_documents(docs: DataFrame, budget: tuple[int, int] = BUDGET, epochs: int = 1, seed: int = SEED, **weights) -> DataFrame:
    """The rows of docs that the mixture reads, once for each epoch, with the columns of docs."""
    leaves = cutoffs(docs, budget, epochs, seed, **weights)[1]
    named = leaves.select(*(F.col(n).alias(f"_{n}") for n in TREE), "whole_epochs", "rest", "last_key")
    clash = {c: f"_own_{c}" for c in docs.columns if c in ("whole_epochs", "rest", "last_key")}
    kept = with_leaf(docs.withColumnsRenamed(clash)).join(named, ["_domain", "_language", "_source"])
    return kept.withColumn("_epoch", F.explode(_chosen(seed))).select(*(F.col(clash.get(c, c)).alias(c) for c in docs.columns))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_epochs(table(spark, sf_dir, "documents"))


def _case(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + f" ELSE {OTHER_WEIGHT} END"


def _share_sql(children: str, parent: str, name: str, weight: str) -> str:
    """The same rule in SQL: `children` has parent, name, cap and budget."""
    return f"""(
  WITH w AS (SELECT *, CAST({weight} AS BIGINT) AS w FROM {children}),
  r AS (SELECT *, coalesce(sum(cap) OVER b, 0) AS cb, coalesce(sum(w) OVER b, 0) AS wb, sum(w) OVER (PARTITION BY {parent}) AS wa FROM w
        WINDOW b AS (PARTITION BY {parent} ORDER BY cap / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  f AS (SELECT *, (budget - cb) * w >= cap * (wa - wb) AS is_full FROM r),
  s AS (SELECT *, coalesce(sum(CASE WHEN is_full THEN cap END) OVER (PARTITION BY {parent}), 0) AS fc, coalesce(sum(CASE WHEN is_full THEN w END) OVER (PARTITION BY {parent}), 0) AS fw FROM f)
  SELECT * EXCLUDE (w, cb, wb, wa, is_full, fc, fw), CAST(CASE WHEN is_full THEN cap ELSE ((budget - fc) * w) // nullif(wa - fw, 0) END AS BIGINT) AS part FROM s)"""


def oracle(documents: str = "documents", budget: tuple[int, int] = BUDGET, epochs: int = MAX_EPOCHS, seed: int = SEED) -> str:
    return f"""
WITH slim AS (
  SELECT doc_id, coalesce('d' || CAST(try_cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INT) % 4 AS VARCHAR), 'd?') AS domain, coalesce(lang, 'und') AS language, coalesce(source, '?') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM {documents}),
leaves AS (SELECT domain, language, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {epochs} AS BIGINT) AS cap FROM slim GROUP BY ALL),
tops AS (SELECT 0 AS root, domain, CAST(sum(cap) AS BIGINT) AS cap, (SELECT CAST(floor(sum(tokens) * {budget[0]} / {budget[1]}) AS BIGINT) FROM leaves) AS budget FROM leaves GROUP BY domain),
d AS (SELECT domain, part AS budget FROM {_share_sql("tops", "root", "domain", _case("domain", DOMAIN_WEIGHTS))}),
mid AS (SELECT l.domain, l.language, CAST(sum(l.cap) AS BIGINT) AS cap, any_value(d.budget) AS budget FROM leaves l JOIN d USING (domain) GROUP BY l.domain, l.language),
g AS (SELECT domain, language, part AS budget FROM {_share_sql("mid", "domain", "language", _case("language", LANGUAGE_WEIGHTS))}),
low AS (SELECT l.*, g.budget FROM leaves l JOIN g USING (domain, language)),
b AS (SELECT domain, language, source, part AS leaf_budget, coalesce(part // nullif(tokens, 0), 0) AS whole_epochs, coalesce(part % nullif(tokens, 0), 0) AS rest FROM {_share_sql("low", "domain, language", "source", str(OTHER_WEIGHT))}),
k AS (SELECT s.*, b.leaf_budget, b.whole_epochs, b.rest, md5(concat('{seed}:', CAST(b.whole_epochs AS VARCHAR), ':', coalesce(CAST(s.doc_id AS VARCHAR), 'null'))) AS key FROM slim s JOIN b USING (domain, language, source)),
c AS (SELECT *, CASE WHEN rest > 0 AND sum(n_tokens) OVER (PARTITION BY domain, language, source ORDER BY key RANGE UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS part_of FROM k)
SELECT doc_id, domain, language, source, n_tokens, leaf_budget, CAST(unnest(range(0, CAST(whole_epochs + part_of AS BIGINT))) AS BIGINT) AS epoch FROM c"""
