"""Rows joined with the intervals that hold their time, by equal bins, or with totals of those intervals.

An interval goes to bins about as wide as it is long, two at most, and a time to its bin of each width that is in use. So
the join has equal keys on both sides whatever the intervals' lengths are, and only near misses are left to a filter.

Pairs of rows and intervals grow with the product of both tables. Where only totals are asked for, none is made: an
interval is a few runs of nodes in a tree over the times, and totals go down the tree from each node to its children.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.shared import stored

#: Bins are powers of 2 ** STEP_BITS ticks wide.
STEP_BITS = 3
#: A node of the tree has 2 ** NODE_BITS children; times lie within 2 ** MOST_BITS of their units.
NODE_BITS, MOST_BITS = 4, 60
#: Units that times may be whole multiples of, in microseconds.
UNITS = (86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000, 1_000, 1)


def ticks(df: DataFrame, column: str) -> Column:
    """Whole numbers in the order of a column: seconds of a time without zone, microseconds of an instant, days, or the
    numbers themselves."""
    kind, c = dict(df.dtypes)[column], F.col(column)
    if kind == "timestamp_ntz":
        return F.datediff(c, F.lit("1970-01-01")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    if kind == "timestamp":
        return F.unix_micros(c)
    return (F.datediff(c, F.lit("1970-01-01")) if kind == "date" else F.floor(c)).cast("long")


def interval_join(points: DataFrame, intervals: DataFrame, time: str, start: str, end: str, on: tuple[str, ...] = ()) -> DataFrame:
    """points with each of the intervals whose half-open scope [start, end) holds their time, and the same `on` columns;
    inner. Open ends are null; a null time is in none. Other columns must have different names.

    A width with fewer bins than the session has shuffle partitions is dealt further: its intervals are copied, and each
    point meets one copy. What reaches the driver is a row for each width, and the first and last time.
    """
    spark = points.sparkSession
    lo, hi = points.agg(F.min(ticks(points, time)), F.max(ticks(points, time))).first()
    known = intervals.withColumns({"_a": F.coalesce(ticks(intervals, start), F.lit(lo)), "_b": F.coalesce(ticks(intervals, end), F.lit(hi))})
    known = known.withColumns({"_a": F.greatest("_a", F.lit(lo)), "_b": F.least("_b", F.lit(hi))}).filter("_a <= _b")
    known = known.withColumn("_w", (F.ceil(F.length(F.bin(F.col("_b") - F.col("_a"))) / STEP_BITS) * STEP_BITS).cast("int"))
    widths = sorted(r["_w"] for r in known.select("_w").distinct().collect()) if lo is not None else []
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    copies = {w: 1 if on else max(1, -(-parts // max(1, (hi >> w) - (lo >> w) + 1))) for w in widths}
    of_width = lambda: F.element_at(F.create_map(*(F.lit(v) for w in copies.items() for v in w)), F.col("_w")) if copies else F.lit(1)
    bins = known.withColumn("_bin", F.explode(F.sequence(F.call_function("shiftright", "_a", "_w"), F.call_function("shiftright", "_b", "_w")))).withColumn("_copy", F.explode(F.sequence(F.lit(0), of_width() - 1))).drop("_a", "_b")
    at = points.withColumn("_t", ticks(points, time)).filter("_t is not null")
    at = at.withColumn("_w", F.explode(F.array(*(F.lit(w) for w in widths)).cast("array<int>"))).withColumn("_bin", F.call_function("shiftright", "_t", "_w"))
    at = at.withColumn("_copy", F.pmod(F.xxhash64(*points.columns), of_width().cast("long")).cast("int")).drop("_t")
    inside = (F.col(start).isNull() | (F.col(time) >= F.col(start))) & (F.col(end).isNull() | (F.col(time) < F.col(end)))
    return at.join(bins, [*on, "_w", "_bin", "_copy"]).filter(inside).drop("_w", "_bin", "_copy")


def exact_ticks(df: DataFrame, column: str) -> Column:
    """Whole numbers that tell a column's values apart: microseconds of times, days, or the whole numbers themselves."""
    kind, c = dict(df.dtypes)[column], F.col(column)
    if kind == "timestamp_ntz":
        day = F.datediff(c, F.lit("1970-01-01")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
        return day * 1_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")
    if kind == "timestamp":
        return F.unix_micros(c)
    if kind == "date":
        return F.datediff(c, F.lit("1970-01-01")).cast("long")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return c.cast("long")
    raise ValueError(f"{column} is {kind}; totals need whole numbers, dates or times")


def _runs(first: Column, last: Column, levels: int) -> Column:
    """Runs (level, lo, hi) of nodes, each of one parent's children lo to hi - 1, that hold first to last - 1 once."""
    up = lambda level: F.call_function("shiftright", first + ((1 << NODE_BITS * level) - 1), F.lit(NODE_BITS * level))
    down = lambda level: F.call_function("shiftright", last, F.lit(NODE_BITS * level))
    out = []
    for level in range(levels + 1):
        lo, hi = up(level), down(level)
        if level == levels:
            out.append((level, lo, hi))
            break
        one, end, begin = up(level + 1) > down(level + 1), up(level + 1) * (1 << NODE_BITS), down(level + 1) * (1 << NODE_BITS)
        out += [(level, lo, F.when(one, hi).otherwise(F.least(end, hi))), (level, F.when(one, hi).otherwise(F.greatest(begin, lo)), hi)]
    return F.array(*(F.struct(F.lit(level).alias("level"), lo.alias("lo"), hi.alias("hi")) for level, lo, hi in out))


def interval_totals(points: DataFrame, intervals: DataFrame, time: str, start: str, end: str, value: str) -> DataFrame:
    """points with n, least and greatest: how many intervals hold their time in their half-open scope [start, end), and
    the least and greatest of these intervals' values; points in none are left out. Open ends are null; a null time is in
    those that are open at both ends. Other columns must have different names.

    Takes time in proportion to points and intervals, not to their pairs. What reaches the driver is a row.
    """
    totals = lambda n: (F.sum(n).alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    if len({"long" if k.endswith("int") else k for k in (dict(points.dtypes)[time], *(dict(intervals.dtypes)[c] for c in (start, end)))}) > 1:
        raise ValueError(f"{time}, {start} and {end} must be of one kind")
    at, known = points.withColumn("_t", exact_ticks(points, time)), intervals.select(exact_ticks(intervals, start).alias("_a"), exact_ticks(intervals, end).alias("_b"), F.col(value).alias("least"), F.col(value).alias("greatest"))
    t = F.col("_t")
    lo, hi, none, *whole = at.agg(F.min(t), F.max(t), F.count_if(t.isNull()), *(F.bool_and(t % u == 0) for u in UNITS)).first()
    always = known.filter("_a is null and _b is null").agg(*totals(F.lit(1))).filter("n > 0")
    out = at.filter(t.isNull()).drop("_t").crossJoin(F.broadcast(always))
    if lo is None:
        return out
    timed = dict(points.dtypes)[time].startswith("timestamp")
    unit = next(u for u, w in zip(UNITS, whole, strict=True) if w) if timed else 1
    bits = ((hi - lo) // unit).bit_length()
    levels = -(-bits // NODE_BITS)
    if levels * NODE_BITS > MOST_BITS:
        raise ValueError(f"times from {lo} to {hi} are too far apart")
    units = lambda c: F.call_function("div", c - lo + (unit - 1), F.lit(unit))
    a, b = F.col("_a"), F.col("_b")
    # The first time at or after an end stands for it; what goes beyond the last time goes on to the tree's end.
    first = F.when(a.isNull() | (a <= lo), 0).when(a > hi, 1 << NODE_BITS * levels).otherwise(units(a))
    last = F.when(b.isNull() | (b > hi), 1 << NODE_BITS * levels).when(b <= lo, 0).otherwise(units(b))
    held = known.select(first.cast("long").alias("_a"), last.cast("long").alias("_b"), "least", "greatest")
    runs = held.groupBy("_a", "_b").agg(F.count("*").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    # Intervals without a time have no run. A filter on their ends would go down to the table, and work ends out again for each use.
    runs = runs.select("n", "least", "greatest", F.explode(_runs(a, b, levels)).alias("_r")).select("n", "least", "greatest", "_r.*").filter("lo < hi")
    runs = stored(runs.groupBy("level", "lo", "hi").agg(*totals("n")), "interval-runs")
    at = at.filter(t.isNotNull()).withColumn("_t", F.call_function("div", t - lo, F.lit(unit)))
    times = stored(at.select("_t").distinct(), "interval-times")
    parent = lambda c: F.call_function("shiftright", F.col(c), F.lit(NODE_BITS)).alias("_up")
    found = None
    for level in range(levels, -1, -1):
        nodes = times.select(F.call_function("shiftright", t, F.lit(NODE_BITS * level)).alias("_node"))
        nodes = (nodes.distinct() if level else nodes).select("_node", parent("_node"))
        mine = runs.filter(F.col("level") == level).select(parent("lo"), "lo", "hi", "n", "least", "greatest")
        if found is not None:
            mine = mine.union(found.select(F.col("_node").alias("_up"), (F.col("_node") * (1 << NODE_BITS)).alias("lo"), ((F.col("_node") + 1) * (1 << NODE_BITS)).alias("hi"), "n", "least", "greatest"))
        found = nodes.join(mine, "_up").filter("_node >= lo and _node < hi").groupBy("_up", "_node").agg(*totals("n")).drop("_up")
    found = at.join(found.withColumnRenamed("_node", "_t"), "_t").drop("_t")
    return found.unionByName(out) if none else found
