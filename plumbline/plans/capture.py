"""From a capture's tables to its result document: project, find the floor and walls, stitch, wrap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import nested, pointcloud, polygon, walls
from plumbline.session import cut


def points(pixels: DataFrame, cameras: DataFrame, poses: DataFrame, stride: int = 4, flip: bool = True) -> DataFrame:
    """World points of the valid pixels of every `stride`-th row and column.

    pixels (frame_id, u, v, z, confidence, source, raster_width, raster_height), cameras (frame_id, fx, fy, cx, cy, width, height),
    poses (frame_id, rotation, tx, ty, tz).
    """
    kept = pointcloud.every(pixels, stride).where(pointcloud.valid_depth("z", "confidence", "source"))
    placed = pointcloud.to_world(pointcloud.back_project(kept, cameras), poses, flip=flip)
    return placed.withColumn("point_idx", F.xxhash64("frame_id", "v", "u")).select("frame_id", "point_idx", "x", "y", "z")


def segments(candidates: DataFrame) -> DataFrame:
    e = F.col("endpoints")
    return candidates.select(
        "capture_id", F.substring_index("candidate_id", "_", -1).cast("int").alias("ordinal"), "candidate_id",
        e[0][0].alias("x0"), e[0][1].alias("y0"), e[1][0].alias("x1"), e[1][1].alias("y1"),
    )


def result(cloud: DataFrame, poses: DataFrame, capture_id: str) -> DataFrame:
    """The result document of one capture's cloud (point_idx, x, y, z): floor, walls, closed boundaries, footprint."""
    axis, level, _ = pointcloud.floor_returns(cloud, poses.select(F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("tz").alias("z")))
    own = cloud.select(F.lit(capture_id).alias("capture_id"), "point_idx", "x", "y", "z")
    candidates = cut(walls.wall_planes(walls.prepare(own, axis, level), axis, level))
    cycles = walls.boundary_cycles(segments(candidates))
    rooms = cycles.select(F.col("capture_id").alias("property_id"), F.substring_index("hypothesis", "_", -1).cast("int").alias("ordinal"), F.col("hypothesis").alias("candidate_id"), "vertices")
    total = polygon.footprint(polygon.stitch(rooms))
    base = cloud.sparkSession.createDataFrame([(capture_id, level)], "capture_id string, floor double")
    both = base.join(total, F.col("property_id") == F.col("capture_id"), "left")
    names = candidates.groupBy("capture_id").agg(F.array_sort(F.collect_list("candidate_id")).alias("surfaces"))  # eight at most
    full = both.join(names, "capture_id", "left")
    return nested.envelope(full, capture_id=F.col("capture_id"), surfaces=F.coalesce("surfaces", F.array().cast("array<string>")), footprint=nested.measurement(F.col("value"), "m^2", "sum of stitched boundary candidates", status="partial"), floor_level=nested.measurement(F.col("floor"), "m", "fullest bin of the lowest returns", status="partial"))
