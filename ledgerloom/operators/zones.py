"""Which zones hold a point, by a cover of cells.

A zone's rings become edges on a grid of millionths of a degree. Starting from one cell that holds the world, a cell with
more than a few edges is split into sixteen, each with the edges that touch it and with whether its south-west corner is
inside. So the cover has large cells wholly inside a zone, which need no test at all, and small ones at its boundary with
a few edges each. A point meets the cover by equal cells. In a boundary cell it is inside if the way from the corner to
it (north, then east) crosses the zone's edges as often as the corner's state asks.

The more points there are, the smaller are the cells at boundaries, so that most points in a zone need no test. Zones with
the same edges share a cover, and a point is tested once for all of them.

All positions are whole numbers, so every test is exact: a point on a boundary belongs to the side east and north of it.
A zone may have several rings (parts and holes): what an odd number of them holds is inside. An edge of more than half
the world's width goes over the date line: such a ring is there twice, once around from each other, and cells end at the
line. Rings don't hold a pole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.shared import stored

UNIT = 1_000_000
#: The world's cell is 2 ** ROOT_BITS units wide; cells are split by 2 ** STEP_BITS in each direction.
ROOT_BITS, STEP_BITS = 30, 2
#: A boundary cell has no more edges than this, or is as small as 2 ** LEAST_BITS units.
MOST_EDGES, LEAST_BITS = 8, 14
#: A boundary cell of zones_at() has no more points than this, if they are spread evenly.
MOST_POINTS = 64
TURN, HALF = 360 * UNIT, 180 * UNIT


def grid_x(lon: Column) -> Column:
    return F.round(lon * UNIT).cast("long") + (HALF + 1)


def grid_y(lat: Column) -> Column:
    return F.round(lat * UNIT).cast("long") + (HALF // 2 + 1)


def _edges(rings: DataFrame) -> DataFrame:
    """rings (zone, ring) to (zone, e): edges of each, west end first; its western half goes once around if the ring
    crosses the date line. A ring that goes beyond the line is followed by its copy of once around to the west.

    What a lambda asks about the whole ring is a column, or would be found again for each corner.
    """
    after = lambda a: F.concat(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 1, 1))
    moved = lambda p, turn: F.struct((p["x"] + turn).alias("x"), p["y"].alias("y"))

    def edge(a: Column, b: Column) -> Column:
        west, east = F.when(a["x"] <= b["x"], a).otherwise(b), F.when(a["x"] <= b["x"], b).otherwise(a)
        return F.struct(west["x"].alias("ax"), west["y"].alias("ay"), east["x"].alias("bx"), east["y"].alias("by"))

    def around(e: Column) -> Column:
        return F.struct((e["ax"] - TURN).alias("ax"), e["ay"].alias("ay"), (e["bx"] - TURN).alias("bx"), e["by"].alias("by"))

    c, e = F.col("c"), F.col("e")
    made = rings.select("zone", F.transform("ring", lambda p: F.struct(grid_x(p["lon"]).alias("x"), grid_y(p["lat"]).alias("y"))).alias("c"))
    crosses = F.exists(F.zip_with(c, after(c), lambda a, b: F.abs(a["x"] - b["x"]) > HALF), lambda v: v)
    made = made.withColumn("c", F.when(crosses, F.transform(c, lambda p: moved(p, F.when(p["x"] <= HALF, TURN).otherwise(0)))).otherwise(c))
    made = made.select("zone", F.exists(c, lambda p: p["x"] > TURN).alias("beyond"), F.zip_with(c, after(c), edge).alias("e"))
    return made.select("zone", F.when(F.col("beyond"), F.concat(e, F.transform(e, around))).otherwise(e).alias("e"))


def _touches(e: Column, x0: Column, y0: Column, size: Column) -> Column:
    """Whether an edge has a point in the closed cell."""
    x1, y1 = x0 + size, y0 + size
    side = lambda x, y: (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])
    sides = [side(x, y) for x in (x0, x1) for y in (y0, y1)]
    near = (e["ax"] <= x1) & (e["bx"] >= x0) & (F.least(e["ay"], e["by"]) <= y1) & (F.greatest(e["ay"], e["by"]) >= y0)
    return near & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def _crossed(e: Column, x0: Column, y0: Column, x: Column, y: Column) -> Column:
    """Whether the way from (x0, y0) north to (x0, y) and east to (x, y) changes sides of the edge. All places are taken
    a little further east, and far less further north, so that none is on an edge or level with a corner."""
    rise, run = e["by"] - e["ay"], e["bx"] - e["ax"]
    at = (x0 - e["ax"]) * rise
    below = lambda v: (at < (v - e["ay"]) * run) | ((at == (v - e["ay"]) * run) & (rise <= 0))
    north = ((e["ax"] > x0) != (e["bx"] > x0)) & (below(y) != below(y0))
    reach = (y - e["ay"]) * run
    west_of = lambda v: F.when(rise > 0, reach <= (v - e["ax"]) * rise).otherwise(reach >= (v - e["ax"]) * rise)
    east = ((e["ay"] > y) != (e["by"] > y)) & (west_of(x) != west_of(x0))
    return north != east


def _inside(start: Column, edges: Column, x0: Column, y0: Column, x: Column, y: Column) -> Column:
    return F.aggregate(edges, start, lambda s, e: s != _crossed(e, x0, y0, x, y))


def _zone_edges(polygons: DataFrame) -> DataFrame:
    return _edges(polygons.filter("zone is not null and size(ring) > 2")).groupBy("zone").agg(F.flatten(F.collect_list("e")).alias("edges"))


def cover(polygons: DataFrame, most_edges: int = MOST_EDGES, least_bits: int = LEAST_BITS, widest_bits: int = ROOT_BITS) -> DataFrame:
    """polygons (zone, ring array<struct<lat,lon>>), a row for each ring, to cells (zone, level, cx, cy, inside, edges).

    A cell is 2 ** level units wide, at a boundary 2 ** widest_bits at most; inside tells of its south-west corner; cells
    without edges are wholly inside. A zone's edges are in one row only until its first split; rows are then split and
    dealt like any others.
    """
    return _cover(_zone_edges(polygons), most_edges, least_bits, widest_bits)


def _cover(zone_edges: DataFrame, most_edges: int, least_bits: int, widest_bits: int) -> DataFrame:
    zero = F.lit(0).cast("long")
    cells = zone_edges.select("zone", F.lit(ROOT_BITS).alias("level"), zero.alias("cx"), zero.alias("cy"), F.lit(False).alias("inside"), "edges")
    n = 1 << STEP_BITS
    for bits in range(ROOT_BITS, least_bits, -STEP_BITS):
        split = (F.size("edges") > (0 if bits > widest_bits else most_edges)) & (F.col("level") == bits)
        rows = cells.withColumn("k", F.explode(F.when(split, F.sequence(F.lit(0), F.lit(n * n - 1))).otherwise(F.array(F.lit(-1)))))
        if bits == ROOT_BITS - STEP_BITS:  # few zones are many rows by now
            rows = rows.repartition("zone", "cx", "cy", "k")
        size = F.lit(1 << (bits - STEP_BITS)).cast("long")
        same = F.col("k") < 0
        rows = rows.withColumns({"nx": F.col("cx") * n + F.col("k") % n, "ny": F.col("cy") * n + F.floor(F.col("k") / n)})
        rows = rows.filter(same | (F.col("nx") * size <= TURN + 1))
        x, y = F.col("nx") * size, F.col("ny") * size
        mine = F.filter("edges", lambda e: _touches(e, x, y, size))  # noqa: B023
        corner = _inside(F.col("inside"), F.col("edges"), F.col("cx") * (size * n), F.col("cy") * (size * n), x, y)
        either = lambda old, new: F.when(same, F.col(old)).otherwise(new).alias(f"_{old}")  # noqa: B023, E731
        made = rows.select("zone", either("level", F.lit(bits - STEP_BITS)), either("cx", F.col("nx")), either("cy", F.col("ny")), either("inside", corner), either("edges", mine))
        cells = made.toDF("zone", "level", "cx", "cy", "inside", "edges")
    return cells.filter("size(edges) > 0 or inside")


def _shapes(polygons: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """What to cover (zone, edges), and zones with the same edges (shape, deals, zone).

    If any are the same, what is covered is known by the struct of shape, the least of these zones, and deals, into how
    many parts its points are dealt: in proportion to its zones. Else there is no such table.
    """
    spark = polygons.sparkSession
    known = stored(_zone_edges(polygons).withColumn("_d", F.sha2(F.to_json(F.sort_array("edges")), 256)), "zone-edges")
    shapes = known.groupBy("_d").agg(F.min("zone").alias("shape"), F.count("*").alias("n"))
    zones = known.count()
    if not shapes.filter("n > 1").take(1):
        return known.drop("_d"), None
    deals = F.ceil(F.col("n") * int(spark.conf.get("spark.sql.shuffle.partitions")) / zones).cast("int").alias("deals")
    members = stored(known.join(shapes, "_d").select("shape", deals, "zone", F.when(F.col("shape") == F.col("zone"), F.col("edges")).alias("edges")), "zone-shapes")
    return members.filter("shape = zone").select(F.struct("shape", "deals").alias("zone"), "edges"), members.drop("edges")


def _widest_bits(points: int) -> int:
    """The largest cell that has MOST_POINTS of so many points at most, if they are spread evenly over the globe."""
    most = MOST_POINTS * TURN * HALF
    return next((b for b in range(ROOT_BITS, LEAST_BITS, -STEP_BITS) if points << 2 * b <= most), LEAST_BITS)


def zones_at(points: DataFrame, polygons: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """points (id, lat, lon) with the zones that hold them: (id, zone), a row for each zone, null for points in none.

    Takes polygons, or their cover, which may be a stored table. Points without a position, or off the globe, are in
    none; rows with one id must be one point.
    """
    members = None
    if cells is None:
        edges, members = _shapes(polygons)
        cells = stored(_cover(edges, MOST_EDGES, LEAST_BITS, _widest_bits(points.count())), "zone-cells")
    # A row for each size of cell: nine at most.
    levels = sorted(r["level"] for r in cells.select("level").distinct().collect())
    on_globe = points.filter("lat between -90 and 90 and lon between -180 and 180")
    placed = on_globe.select("id", grid_x(F.col("lon")).alias("x"), grid_y(F.col("lat")).alias("y"))
    keyed = placed.withColumn("level", F.explode(F.array(*(F.lit(v) for v in levels)) if levels else F.array().cast("array<int>")))
    keyed = keyed.withColumns({"cx": F.call_function("shiftright", "x", "level"), "cy": F.call_function("shiftright", "y", "level")})
    size = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))
    at = (F.col("cx") * size, F.col("cy") * size, F.col("x"), F.col("y"))
    # One or two edges, as nearly all boundary cells have, are tested by compiled code; functions of arrays aren't compiled.
    one = F.col("inside") != _crossed(F.get("edges", 0), *at)
    two = one != _crossed(F.get("edges", 1), *at)
    n = F.size("edges")
    held = F.when(n == 0, True).when(n == 1, one).when(n == 2, two).otherwise(_inside(F.col("inside"), F.col("edges"), *at))
    found = keyed.join(cells, ["level", "cx", "cy"]).filter(held)
    if members is None:
        return points.select("id").join(found.select("id", "zone"), "id", "left")
    found = found.select("id", "zone.shape", F.pmod(F.xxhash64("id"), F.col("zone.deals").cast("long")).alias("_deal"))
    # Points in none are dealt by their ids, not as one key.
    found = points.select("id").join(found, "id", "left").withColumn("_deal", F.coalesce("_deal", F.xxhash64("id")))
    dealt = members.select("shape", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - F.lit(1).cast("long"))).alias("_deal"), "zone")
    return found.join(dealt, ["shape", "_deal"], "left").select("id", "zone")
