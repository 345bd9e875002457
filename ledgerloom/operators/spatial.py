"""Ranges, bands and nearest places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rules_in_force(df: DataFrame, rules: DataFrame, time: str, start: str, end: str, on: list[str] | None = None) -> DataFrame:
    """Each row with the rules whose half-open scope [start, end) holds its time; open ends are null.

    With join columns this is an equi-join with a filter; without, rules must be few: they are a reference pack. For many,
    or long ones beside short ones, see intervals.interval_join().
    """
    inside = (F.col(start).isNull() | (F.col(time) >= F.col(start))) & (F.col(end).isNull() | (F.col(time) < F.col(end)))
    return df.join(rules, on).filter(inside) if on else df.join(rules, inside)


def bands(value: Column, limits: list[tuple[str, float]], last: str) -> Column:
    """The name of the first band whose limit is above the value."""
    out = F.when(value.isNull(), F.lit(None))
    for name, limit in limits:
        out = out.when(value < limit, name)
    return out.otherwise(last)


def _cells(lat: Column, lon: Column, size: float) -> tuple[Column, Column]:
    return F.floor(lat / size), F.floor(lon / size)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * 6371.0088) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def nearest_place(points: DataFrame, places: DataFrame, most_km: float, cell: float = 1.0) -> DataFrame:
    """points (id, lat, lon) with the nearest of places (place_id, lat, lon) within most_km, ties by the lesser id.

    Places are copied to all cells that they can serve, so the join has an equal cell on both sides. Points without a
    position, or with no place near, have none.
    """
    reach = most_km / 111.0 / cell
    rows = int(reach) + 1
    wide = F.ceil(F.lit(reach) / F.greatest(F.cos(F.radians(F.least(F.abs("lat") + most_km / 111.0, F.lit(89.9)))), F.lit(0.01))).cast("int")
    world = int(round(360 / cell))
    py, px = _cells(F.col("lat"), F.col("lon"), cell)
    p = points.filter("lat is not null and lon is not null").withColumns({"_y": py, "_x": F.pmod(px, F.lit(world))})
    spread = places.withColumns({"_y": F.explode(F.sequence(py - rows, py + rows)), "_w": F.least(wide, F.lit(world // 2))}).withColumn("_x", F.explode(F.array_distinct(F.transform(F.sequence(px - F.col("_w"), px + F.col("_w")), lambda v: F.pmod(v, F.lit(world))))))
    s = spread.select("_y", "_x", "place_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    far = haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))
    near = p.join(s, ["_y", "_x"]).withColumn("km", far).filter(F.col("km") <= most_km)
    best = near.groupBy("id").agg(F.min(F.struct("km", "place_id")).alias("_b")).select("id", F.col("_b.place_id").alias("place_id"), F.col("_b.km").alias("km"))
    return points.select("id").join(best, "id", "left")


#: References that each task may hold.
MOST_REFERENCES = 10_000


def nearest_vector(queries: DataFrame, references: DataFrame, most: int = MOST_REFERENCES) -> DataFrame:
    """queries and references (id, v array<double>): the reference with the least squared distance, rounded to four
    places, ties by id. References are a small stated set: more than `most` of them are an error, as each task has them all."""
    if references.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} references")
    r = F.broadcast(references.select(F.col("id").alias("ref_id"), F.col("v").alias("_v")))
    d = F.round(F.aggregate(F.zip_with("v", "_v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x), 4)
    return queries.join(r).withColumn("_d", d).groupBy("id").agg(F.min(F.struct("_d", "ref_id")).alias("_b")).select("id", F.col("_b.ref_id").alias("ref_id"), F.col("_b._d").alias("distance"))
