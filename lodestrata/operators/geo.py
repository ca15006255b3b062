"""Tiles, catchments and candidates on the map."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import haversine_km
from ..scratch import written


def tile_grid(spark: SparkSession, lat: float, lon: float, radius_km: float = 50.0, tile_km: float = 4.0) -> DataFrame:
    """Centres (i, j, lat, lon) of a grid that covers a circle: those within a tile of it."""
    steps = math.ceil(radius_km / tile_km)
    side = spark.range(-steps, steps + 1)
    # the grid is as large as the radius asks for, not as the data are
    rows = side.select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(-steps), F.lit(steps))).alias("j"))
    rows = rows.withColumns({"lat": lat + F.col("i") * tile_km / 110.574, "lon": lon + F.col("j") * tile_km / (111.320 * math.cos(math.radians(lat)))})
    return rows.filter(haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")) <= radius_km + tile_km)


def sweep_cost(tiles: DataFrame, types: int = 0, usd_per_1000: float = 35.0) -> DataFrame:
    groups = max(1, math.ceil(types / 10)) if types else 1
    n = F.count(F.lit(1))
    return tiles.agg(n.alias("tiles"), F.lit(groups).cast("long").alias("groups"), (n * groups).alias("calls"), F.round(n * groups / 1000 * usd_per_1000, 2).alias("usd"))


def subdivide(tiles: DataFrame, full: Column, radius_m: str = "radius_m", least: float = 800.0) -> DataFrame:
    """The four quarters of each tile whose answer was full, down to a least radius."""
    half = F.col(radius_m) / 2
    rows = tiles.filter(full & (F.col(radius_m) > least)).withColumn("q", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 1) for b in (-1, 1)])))
    return rows.withColumns({"lat": F.col("lat") + F.col("q.a") * half / 110_574.0, "lon": F.col("lon") + F.col("q.b") * half / 111_320.0 / F.cos(F.radians("lat")), radius_m: half}).drop("q")


def sweep(points: DataFrame, tiles: DataFrame, max_calls: int, cap: int = 20, least: float = 800.0) -> tuple[DataFrame, DataFrame]:
    """An adaptive sweep over ``points`` (id, lat, lon): the calls it makes, and what they find.

    ``tiles`` (lat, lon, radius_m, place) are asked in the order of ``place``; an answer has the ``cap`` nearest points of a circle
    at most. A tile whose answer is full, and larger than ``least``, is quartered; quarters are asked after all tiles of their
    level. After ``max_calls`` the rest stays unasked and is reported so.

    Calls: call (NULL if unasked), level, lat, lon, radius_m, found, full. Finds: id and the first call that has it. A level is one
    equi-join on grid cells as wide as its tiles, of which there are ``max_calls`` at most; levels are as many as
    halvings to ``least``.
    """
    spark = points.sparkSession
    level = tiles.select("lat", "lon", F.col("radius_m").cast("double").alias("radius_m"), F.row_number().over(Window.orderBy("place")).alias("at"))  # the tiles of a plan, not data
    calls, finds, done, depth = None, None, 0, 0
    while True:
        level = written(level, "tiles")
        total = level.count()
        if not total:
            break
        asked = level.where(F.col("at") <= max_calls - done)
        radius = level.agg(F.max("radius_m")).first()[0]
        dlat, dlon = radius / 110_000.0, radius / 60_000.0  # a cell is no narrower than a radius, up to 57 degrees
        cell = lambda d: d.withColumns({"cy": F.floor(F.col("lat") / dlat), "cx": F.floor(F.col("lon") / dlon)})
        offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
        t = cell(asked).withColumn("o", F.explode(offsets)).select("at", F.col("lat").alias("tlat"), F.col("lon").alias("tlon"), "radius_m", (F.col("cy") + F.col("o.a")).alias("cy"), (F.col("cx") + F.col("o.b")).alias("cx"))
        d = haversine_km(F.col("tlat"), F.col("tlon"), F.col("lat"), F.col("lon")) * 1000
        met = cell(points.select("id", "lat", "lon")).join(F.broadcast(t), ["cy", "cx"]).withColumn("d", d).where(F.col("d") <= F.col("radius_m"))
        near = Window.partitionBy("at").orderBy("d", "id")
        answers = written(met.select("at", "id", "d").withColumn("r", F.row_number().over(near)).where(F.col("r") <= cap).select("at", "id"), "answers")
        sizes = answers.groupBy("at").agg(F.count(F.lit(1)).alias("found"))
        found = F.when(F.col("at") <= max_calls - done, F.coalesce("found", F.lit(0)))
        report = level.join(sizes, "at", "left").withColumn("found", found).withColumn("full", F.col("found") >= cap)
        report = written(report.select("at", F.when(F.col("found").isNotNull(), F.col("at") + done).alias("call"), F.lit(depth).alias("level"), "lat", "lon", "radius_m", "found", "full"), "calls")
        calls = report.drop("at") if calls is None else calls.unionByName(report.drop("at"))
        first = answers.groupBy("id").agg((F.min("at") + done).alias("call"))
        finds = first if finds is None else finds.unionByName(first)
        done, depth = done + min(total, max_calls - done), depth + 1
        quarters = subdivide(report, F.coalesce("full", F.lit(False)), least=least)
        order = Window.orderBy("at", F.desc(F.col("lat") > F.col("plat")), F.desc(F.col("lon") > F.col("plon")))
        parent = report.select("at", F.col("lat").alias("plat"), F.col("lon").alias("plon"))
        level = quarters.select("at", "lat", "lon", "radius_m").join(parent, "at").select("lat", "lon", "radius_m", F.row_number().over(order).alias("at"))
    if calls is None:
        return spark.createDataFrame([], "call int, level int, lat double, lon double, radius_m double, found long, full boolean"), spark.createDataFrame([], "id long, call int")
    return calls, finds.groupBy("id").agg(F.min("call").alias("call"))


def catchment_label(junk: Column, lat: Column, distance_km: Column, radius_km: float = 50.0) -> Column:
    """What becomes of a candidate: junk first, then without place, then too far, else kept."""
    return F.when(junk, "junk").when(lat.isNull(), "needs_geocoding").when(distance_km > radius_km, "out_of_radius").otherwise("kept")


def geocoded(places: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Places with the coordinates of a cache; what it lacks, or knows not to exist, is not in the radius."""
    return places.join(cache, keys, "left").withColumn("in_radius", F.coalesce("in_radius", F.lit(False)))
