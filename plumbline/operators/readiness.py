"""Is a benchmark's evidence complete? Coverage checks, apart from accuracy, for any number of benchmarks at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
TIERS = ("photo", "video", "lidar")
BY = "benchmark_id"


def blank(column: str) -> Column:
    return F.coalesce(F.trim(column) == "", F.lit(True))


def room_set(rooms: DataFrame, connectors: DataFrame) -> DataFrame:
    """Three rooms or more that are no connectors, and a connector among the rooms."""
    marked = rooms.select(BY, "room_id").distinct().join(connectors.select(BY, "room_id").distinct().withColumn("_hall", F.lit(True)), [BY, "room_id"], "left")
    return marked.groupBy(BY).agg(F.count_if(c("_hall").isNull()).alias("n"), ((F.count_if(c("_hall").isNull()) >= 3) & (F.count("_hall") > 0)).alias("passed"))


def measured_truth(rooms: DataFrame, walls: DataFrame, openings: DataFrame, adjacency: DataFrame, properties: DataFrame) -> DataFrame:
    """Every room with area, ceiling height and wall lengths; the whole property's footprint; an edge and an opening."""
    lengths = walls.groupBy(BY, "room_id").agg(F.bool_and(c("length_m").isNotNull()).alias("_walls"))
    known = rooms.join(lengths, [BY, "room_id"], "left").withColumn("_known", c("ceiling_height_m").isNotNull() & c("floor_area_m2").isNotNull() & F.coalesce("_walls", F.lit(False)))
    counts = known.groupBy(BY).agg(F.count_if("_known").alias("n"), F.count_distinct("room_id").alias("_rooms"))
    there = lambda df, name: df.select(BY).distinct().withColumn(name, F.lit(True))
    parts = [there(adjacency, "_edge"), there(openings.join(rooms.select(BY, "room_id").distinct(), [BY, "room_id"], "left_semi"), "_opening"), there(properties.where("footprint_m2 IS NOT NULL"), "_footprint")]
    whole = reduce(lambda a, b: a.join(b, BY, "left"), parts, counts)
    every = (c("n") == c("_rooms")) & c("_edge").isNotNull() & c("_opening").isNotNull() & c("_footprint").isNotNull()
    return whole.select(BY, "n", every.alias("passed"))


def same_rooms(rooms: DataFrame, runs: DataFrame) -> DataFrame:
    """Every room in every tier."""
    seen = runs.where(c("tier").isin(*TIERS)).groupBy(BY, "room_id").agg(F.count_distinct("tier").alias("_t"))
    full = F.coalesce(c("_t") == len(TIERS), F.lit(False))
    return rooms.select(BY, "room_id").distinct().join(seen, [BY, "room_id"], "left").groupBy(BY).agg(F.count_if(full).alias("n"), F.bool_and(full).alias("passed"))


def repeats(runs: DataFrame) -> DataFrame:
    """A room repeated in one tier: two runs or more of one group, whatever their captures."""
    groups = runs.where(F.coalesce(c("repeat_group") != "", F.lit(False))).groupBy(BY, "room_id", "tier", "repeat_group").agg(F.count(F.lit(1)).alias("_n"))
    return groups.groupBy(BY).agg(F.count_if(c("_n") >= 2).alias("n"), (F.count_if(c("_n") >= 2) > 0).alias("passed"))


def staged_damage(examples: DataFrame, regions: DataFrame) -> DataFrame:
    """Two examples of two classes or more, each with a surface, a positive extent and regions that are polygons on images."""
    points = F.coalesce(F.forall("polygon_px", lambda p: (F.size(p) == 2) & F.forall(p, lambda v: v.isNotNull())), F.lit(False))
    sound = regions.withColumn("_ok", ~blank("image_path") & (F.size("polygon_px") >= 3) & points).groupBy(BY, "example_id").agg(F.bool_and("_ok").alias("_regions"))
    fine = ~blank("surface_id") & F.coalesce(c("extent_m2") > 0, F.lit(False)) & F.coalesce("_regions", F.lit(False))
    rows = examples.join(sound, [BY, "example_id"], "left").groupBy(BY)
    kinds = F.count_distinct(F.when(c("damage_class") != "", F.trim("damage_class")))
    return rows.agg(F.count(F.lit(1)).alias("n"), ((F.count(F.lit(1)) >= 2) & (kinds >= 2) & F.bool_and(fine)).alias("passed"))


def checks(benchmarks: DataFrame, rooms: DataFrame, connectors: DataFrame, walls: DataFrame, openings: DataFrame, adjacency: DataFrame, properties: DataFrame, runs: DataFrame, examples: DataFrame, regions: DataFrame) -> DataFrame:
    """(benchmark_id, check, n, passed) of five checks and of `ready`, which all of them make; n counts what a check counts.

    benchmarks (benchmark_id); rooms (room_id, ceiling_height_m, floor_area_m2), connectors (room_id), walls (room_id, length_m), openings (room_id),
    adjacency, properties (footprint_m2), runs (tier, room_id, repeat_group), examples (example_id, damage_class, surface_id, extent_m2),
    regions (example_id, image_path, polygon_px), each with its benchmark_id. What has no rows fails.
    """
    found = {
        "room_set": room_set(rooms, connectors), "measured_ground_truth": measured_truth(rooms, walls, openings, adjacency, properties), "same_rooms_all_tiers": same_rooms(rooms, runs),
        "repeat_capture": repeats(runs), "staged_damage": staged_damage(examples, regions),
    }
    every = benchmarks.select(BY).distinct()
    rows = reduce(DataFrame.unionByName, [every.join(df, BY, "left").select(BY, F.lit(name).alias("check"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("passed", F.lit(False)).alias("passed")) for name, df in found.items()])
    ready = rows.groupBy(BY).agg(F.count_if("passed").cast("long").alias("n"), F.bool_and("passed").alias("passed"))
    return rows.unionByName(ready.select(BY, F.lit("ready").alias("check"), "n", "passed"))
