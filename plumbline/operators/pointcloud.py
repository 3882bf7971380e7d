"""Depth pixels to points, transforms, bands, voxels, grids and the floor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import graph
from plumbline.operators.stats import low_mode

#: Raster that intrinsics refer to where a camera row names none.
DEFAULT_RASTER = (1920, 1440)


def valid_depth(depth: str, confidence: str, source: str) -> Column:
    """Finite and positive; confidence filters every source but the plain bundle, which only counts it."""
    z = F.col(depth)
    return z.isNotNull() & ~F.isnan(z.cast("double")) & (z > 0) & ((F.col(source) == "bundle") | F.coalesce(F.col(confidence) > 0, F.lit(False)))


def depth_pairs(df: DataFrame, sensor: str, reference: str, confidence: str, low: float = 0.1, high: float = 10.0) -> DataFrame:
    return df.where((F.col(confidence) > 0) & F.col(sensor).between(low, high) & F.col(reference).between(low, high))


def every(df: DataFrame, step: int, u: str = "u", v: str = "v") -> DataFrame:
    """Every `step`-th row and column of a raster."""
    return df.where((F.col(u) % step == 0) & (F.col(v) % step == 0))


def back_project(pixels: DataFrame, cameras: DataFrame, key: str = "frame_id") -> DataFrame:
    """Pixels (frame_id, u, v, z, raster_width, raster_height) to camera coordinates, intrinsics scaled to the raster."""
    c = cameras.select(key, "fx", "fy", "cx", "cy", F.coalesce("width", F.lit(DEFAULT_RASTER[0])).alias("_w"), F.coalesce("height", F.lit(DEFAULT_RASTER[1])).alias("_h"))
    both = pixels.join(c, key)
    sx, sy = F.col("raster_width") / F.col("_w"), F.col("raster_height") / F.col("_h")
    x = (F.col("u") - F.col("cx") * sx) * F.col("z") / (F.col("fx") * sx)
    y = (F.col("v") - F.col("cy") * sy) * F.col("z") / (F.col("fy") * sy)
    return both.withColumn("x", x).withColumn("y", y).drop("fx", "fy", "cx", "cy", "_w", "_h")


def rotation_from_quaternion(x: Column, y: Column, z: Column, w: Column) -> Column:
    """Row-major 3x3 rotation of a unit quaternion; of any other, after normalisation."""
    n = F.sqrt(x * x + y * y + z * z + w * w)
    x, y, z, w = x / n, y / n, z / n, w / n
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    )


def rotation_from_axis_angle(ax: Column, ay: Column, az: Column) -> Column:
    """Row-major 3x3 rotation about the vector by its length."""
    angle = F.sqrt(ax * ax + ay * ay + az * az)
    safe = F.when(angle < 1e-12, F.lit(1.0)).otherwise(angle)
    half = angle / 2
    s = F.sin(half) / safe
    return rotation_from_quaternion(ax * s, ay * s, az * s, F.cos(half))


def rotate(rotation: Column, p: Sequence[Column], t: Sequence[Column]) -> list[Column]:
    return [rotation[3 * k] * p[0] + rotation[3 * k + 1] * p[1] + rotation[3 * k + 2] * p[2] + t[k] for k in range(3)]


def to_world(points: DataFrame, poses: DataFrame, key: str = "frame_id", flip: bool = True) -> DataFrame:
    """Camera points to the world: y and z negated where the camera looks along -z, then rotation and translation.

    poses (frame_id, rotation array<double>, tx, ty, tz).
    """
    both = points.join(poses.select(key, F.col("rotation").alias("_r"), F.col("tx").alias("_tx"), F.col("ty").alias("_ty"), F.col("tz").alias("_tz")), key)
    sign = -1 if flip else 1
    p = [F.col("x"), F.col("y") * sign, F.col("z") * sign]
    x, y, z = rotate(F.col("_r"), p, [F.col("_tx"), F.col("_ty"), F.col("_tz")])
    return both.select(*[c for c in points.columns if c not in ("x", "y", "z")], x.alias("x"), y.alias("y"), z.alias("z"))


def camera_centre(rotation: Column, t: Sequence[Column]) -> list[Column]:
    """-R^T t."""
    return [-(rotation[k] * t[0] + rotation[k + 3] * t[1] + rotation[k + 6] * t[2]) for k in range(3)]


def compose(outer: Column, outer_t: Sequence[Column], inner: Column, inner_t: Sequence[Column]) -> tuple[Column, list[Column]]:
    """The pose that applies `inner`, then `outer`."""
    r = F.array(*[outer[3 * i] * inner[j] + outer[3 * i + 1] * inner[3 + j] + outer[3 * i + 2] * inner[6 + j] for i in range(3) for j in range(3)])
    return r, rotate(outer, inner_t, outer_t)


def voxel_first(points: DataFrame, axes: Sequence[str], size: float, order: str, by: Sequence[str] = ()) -> DataFrame:
    """The first point of each voxel; keys are DOUBLE divisions."""
    keys = [F.floor(F.col(a).cast("double") / size).alias(f"_v{k}") for k, a in enumerate(axes)]
    first = F.min_by(F.struct(*points.columns), F.col(order)).alias("_first")
    return points.groupBy(*by, *keys).agg(first).select("_first.*")


def band(points: DataFrame, axis: str, low: float, high: float) -> DataFrame:
    return points.where(F.col(axis).between(low, high))


def occupancy(points: DataFrame, a: str, b: str, size: float, least: int = 3) -> DataFrame:
    """Grid cells (cx, cy, n) with at least so many points, from the smallest coordinates on."""
    origin = points.agg(F.min(a).alias("_a0"), F.min(b).alias("_b0"))
    placed = points.crossJoin(F.broadcast(origin))  # one row
    cells = placed.groupBy(F.floor((F.col(a) - F.col("_a0")) / size).cast("long").alias("cx"), F.floor((F.col(b) - F.col("_b0")) / size).cast("long").alias("cy"))
    return cells.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def vertical_axis(poses: DataFrame, axes: Sequence[str] = ("x", "y", "z")) -> str:
    """The axis along which the poses move least, the first of equals."""
    spans = poses.agg(*[(F.max(a) - F.min(a)).alias(a) for a in axes]).first()
    return min(axes, key=lambda a: (spans[a], axes.index(a)))


def floor_returns(points: DataFrame, poses: DataFrame, cell: float = 0.05, axis: str | None = None) -> tuple[str, float, DataFrame]:
    """Vertical axis, floor level, and the floor's components of occupied cells.

    Level: the fullest 1 cm bin of the lowest decile. Cells: at least 3 returns within 6 cm of it,
    closed with a 3x3 square, 8-connected, and at least max(20, 0.20 m2) in size.
    """
    axis = axis or vertical_axis(poses)
    row = low_mode(points, axis, 0.01).first()
    level = float(row["level"])
    a, b = [x for x in ("x", "y", "z") if x != axis]
    cells = graph.close_cells(occupancy(band(points, axis, level - 0.06, level + 0.06), a, b, cell))
    labelled = graph.cell_components(cells)
    large = graph.large_components(labelled, max(20, round(0.20 / cell**2)))
    return axis, level, labelled.join(large, "component")


def wall_band(points: DataFrame, axis: str, floor: float, low: float = 0.15, high: float = 3.5) -> DataFrame:
    return band(points, axis, floor + low, floor + high)


def pose_summary(rooms: DataFrame, poses: DataFrame, key: str, axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Count, centroid and span of poses for each room; rooms without poses stay, with nulls."""
    got = poses.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(f"mean_{a}") for a in axes], *[(F.max(a) - F.min(a)).alias(f"span_{a}") for a in axes])
    return rooms.select(key).join(got, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
