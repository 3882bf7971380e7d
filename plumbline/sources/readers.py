"""Scans of capture files: explicit schemas, one row per record, bad lines dropped or failing as said."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ODOMETRY = "timestamp double, frame string, x double, y double, z double, qx double, qy double, qz double, qw double, fx double, fy double, cx double, cy double"
CAMERA = (
    "width double, height double, fx double, fy double, cx double, cy double, "
    "t_00 double, t_01 double, t_02 double, t_03 double, t_10 double, t_11 double, t_12 double, t_13 double, t_20 double, t_21 double, t_22 double, t_23 double"
)
METRIC_ROW = (
    "tier string, capture_id string, room_id string, metric string, object_id string, ground_truth double, prediction double, absolute_error double, "
    "relative_error double, interval_contains_ground_truth boolean, gate_tolerance double, gate_tolerance_kind string, gate_pass boolean"
)
# File kinds by extension.
PHOTO = ("jpg", "jpeg", "png", "heic", "heif")
VIDEO = ("mp4", "mov", "m4v", "avi")
LIDAR = ("ply", "las", "e57")
#: Point clouds that count as evidence.
SCAN_FILES = ("ply", "e57", "las", "laz", "pcd", "xyz", "pts")
#: Images that damage detection reads.
DAMAGE_PHOTO = ("jpg", "jpeg", "png", "webp", "bmp")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]+)$", 1))


def must(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """`df`, failing at run time on a row for which `condition` isn't true."""
    fail = F.raise_error(F.lit(message)).cast("boolean")
    return df.where(F.when(F.coalesce(condition, F.lit(False)), True).otherwise(fail))


def not_empty(df: DataFrame, message: str) -> DataFrame:
    """`df`, failing at run time if it has no rows."""
    count = df.agg(F.count(F.lit(1)).alias("_n"))
    check = count.where(F.when(F.col("_n") > 0, False).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
    return df.unionByName(check.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]))


def odometry(spark: SparkSession, path: str) -> DataFrame:
    """Pose rows of a CSV with blanks after commas, cast where used; no rows is an error."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    names = {c: c.lstrip("﻿").strip() for c in raw.columns}
    for old, new in names.items():
        raw = raw.withColumnRenamed(old, new)
    wanted = [c.split() for c in ODOMETRY.split(", ")]
    optional = [c for c in ("width", "height") if c in raw.columns]
    return not_empty(raw.select(*[F.col(c).cast(t).alias(c) for c, t in wanted], *[F.col(c).cast("double").alias(c) for c in optional]), "no odometry rows")


def cameras(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file a key frame; its stem is the key."""
    return spark.read.json(path, schema=CAMERA, multiLine=True).withColumn("frame_id", stem(F.col("_metadata.file_name")))


def json_documents(spark: SparkSession, path: str, schema: str | None = None, object_only: bool = True) -> DataFrame:
    """One document a file: typed by `schema`, or as a text column `json`."""
    if schema:
        return spark.read.json(path, schema=schema, multiLine=True)
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))
    return must(rows, F.ltrim("json").startswith("{"), "a document must be a JSON object") if object_only else rows


def trajectory(spark: SparkSession, path: str) -> DataFrame:
    """ts, axis-angle and translation: seven finite numbers a line; blank and # lines are skipped, others fail."""
    line = F.trim("value")
    parts = F.transform(F.split(line, r"\s+"), lambda v: v.try_cast("double"))
    rows = spark.read.text(path).where((line != "") & ~line.startswith("#")).select(parts.alias("p"))
    finite = F.forall("p", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    names = ("ts", "ax", "ay", "az", "tx", "ty", "tz")
    checked = must(rows, (F.size("p") == 7) & finite, "a trajectory line must have 7 finite numbers")
    return not_empty(checked.select(*[F.col("p")[k].alias(n) for k, n in enumerate(names)]), "no trajectory rows").orderBy("ts")


def pincam(spark: SparkSession, path: str) -> DataFrame:
    """width height fx fy cx cy of a whole file: six finite numbers, sizes and focal lengths positive."""
    parts = F.transform(F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+"), lambda v: v.try_cast("double"))
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), parts.alias("p"))
    good = (F.size("p") == 6) & F.forall("p", lambda v: v.isNotNull() & ~F.isnan(v)) & F.forall(F.slice("p", 1, 4), lambda v: v > 0)
    names = ("width", "height", "fx", "fy", "cx", "cy")
    return must(rows, good, "intrinsics must be 6 finite numbers with positive size and focal length").select("path", *[F.col("p")[k].alias(n) for k, n in enumerate(names)])


def name_timestamp(path: Column, strict: bool = True) -> Column:
    """The number after the last underscore of a file's stem; without one an error, or null if not strict."""
    token = F.element_at(F.split(stem(path), "_"), -1)
    return token.cast("double") if strict else token.try_cast("double")


def colmap_images(spark: SparkSession, path: str) -> DataFrame:
    """image rows (ten fields: id, qw qx qy qz, tx ty tz, camera, name); point lines, comments and blanks drop out."""
    p = F.split(F.trim("value"), r"\s+", 10)
    rows = spark.read.text(path).where(~F.trim("value").startswith("#")).select(p.alias("p")).where(F.size("p") == 10)
    numbers = {n: F.col("p")[k + 1].try_cast("double").alias(n) for k, n in enumerate(("qw", "qx", "qy", "qz", "tx", "ty", "tz"))}
    named = rows.select(F.col("p")[0].try_cast("long").alias("image_id"), *numbers.values(), F.col("p")[9].alias("image_name"))
    return named.where(F.col("image_id").isNotNull() & F.col("image_name").contains("__")).dropna(subset=list(numbers))


def listing(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, length) of the files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", "length")


def photos(files: DataFrame, root: str, extensions: Sequence[str] = PHOTO) -> DataFrame:
    """Images directly in the folder, by name."""
    below = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    return files.where(extension(F.col("path")).isin(*extensions) & ~below.contains("/")).orderBy("path")


def capture_type(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(capture, capture_type, problem) by layout, then by extension, video before photo before lidar.

    files (capture, relative), where `relative` is the path below the capture, empty if the capture is itself
    a file. Layouts: a raw depth scan with its trajectory and three kinds of frame folders; key frames with
    depth, cameras and images (as taken or corrected); a bundle of depth and confidence frames with a video,
    poses and a camera matrix. What fits nothing has a problem in place of a type, and so have point clouds,
    which are recognised but not processed.
    """
    whole = F.col("relative") == ""
    path = F.when(whole, F.col("capture")).otherwise(F.col("relative"))
    parts = F.split("relative", "/")
    below = lambda n: F.when(F.size(parts) > n, F.array_join(F.slice(parts, 1, n), "/"))
    got = files.groupBy("capture").agg(
        F.collect_set(below(1)).alias("folders"), F.collect_set(below(2)).alias("inner"), F.collect_set(F.when(F.size(parts) == 1, F.col("relative"))).alias("tops"),
        F.collect_set(extension(path)).alias("ext"), F.bool_or(whole).alias("single"),
    )
    has = lambda column, *names: F.size(F.array_intersect(column, F.array(*map(F.lit, names)))) == len(names)
    any_of = lambda column, names: F.arrays_overlap(column, F.array(*map(F.lit, names)))
    scan = has("folders", "lowres_wide", "lowres_depth", "confidence", "lowres_wide_intrinsics") & has("tops", "lowres_wide.traj")
    keyframes = has("inner", "keyframes/depth") & any_of("inner", ("keyframes/cameras", "keyframes/corrected_cameras")) & any_of("inner", ("keyframes/images", "keyframes/corrected_images"))
    bundle = has("folders", "depth", "confidence") & has("tops", "rgb.mp4", "odometry.csv", "camera_matrix.csv")
    kind = F.when(scan | keyframes | bundle, "rgbd").when(any_of("ext", VIDEO), "video").when(any_of("ext", PHOTO), "photo").when(any_of("ext", LIDAR), "lidar")
    problem = F.when(F.col("capture_type") == "lidar", "point clouds aren't processed").when(F.col("capture_type").isNull(), F.when(F.col("single"), "unsupported capture file type").otherwise("could not determine capture type"))
    return roots.join(got, "capture", "left").withColumn("capture_type", kind).select("capture", "capture_type", problem.alias("problem"))


def first_row(rows: DataFrame, key: str, value: str, flag: str, order: str) -> DataFrame:
    """The first row with this key; none, or one whose flag isn't true, fails the run."""
    got = not_empty(rows.where(F.col(key) == value).orderBy(order).limit(1), f"no row with {key} {value}")
    return must(got, F.lower(F.trim(F.col(flag).cast("string"))) == "true", f"{flag} of {value} isn't true")


def key_frame_folders(files: DataFrame, mode: str = "auto") -> DataFrame:
    """(capture, images, cameras, mode, problem): which key-frame folders to read.

    files (capture, relative). raw and optimized ask for their own folders; auto takes the corrected ones
    where both are there, else the others. Without depth frames or a matching pair there is a problem.
    """
    if mode not in ("auto", "raw", "optimized"):
        raise ValueError("mode must be auto, raw or optimized")
    parts = F.split("relative", "/")
    inner = F.when((F.size(parts) > 2) & (parts[0] == "keyframes"), parts[1])
    seen = files.groupBy("capture").agg(F.collect_set(inner).alias("_f"))
    both = lambda *names: F.size(F.array_intersect("_f", F.array(*map(F.lit, names)))) == len(names)
    raw, optimized = both("images", "cameras"), both("corrected_images", "corrected_cameras")
    chosen = {"raw": F.when(raw, "raw"), "optimized": F.when(optimized, "optimized"), "auto": F.when(optimized, "optimized").when(raw, "raw")}[mode]
    picked = seen.withColumn("mode", F.when(F.array_contains("_f", "depth"), chosen))
    corrected = F.when(F.col("mode") == "optimized", "corrected_").when(F.col("mode") == "raw", "")
    folder = lambda name: F.concat(F.lit("keyframes/"), corrected, F.lit(name))
    return picked.select("capture", folder("images").alias("images"), folder("cameras").alias("cameras"), "mode", F.when(F.col("mode").isNull(), "needs depth frames and matching image and camera folders").alias("problem"))


def key_frame_images(frames: DataFrame, images: DataFrame) -> DataFrame:
    """(capture, frame_id, rule) of key frames without an image, of another size than the capture's first, or of another aspect than their depth raster.

    frames (capture, frame_id, depth_width, depth_height), images (capture, frame_id, width, height).
    """
    both = frames.join(images, ["capture", "frame_id"], "left")
    first = both.where("width IS NOT NULL").groupBy("capture").agg(F.min_by(F.struct("width", "height"), "frame_id").alias("_first"))
    joined = both.join(first, "capture", "left")
    lost = F.col("width").isNull()
    odd = (F.col("width") != F.col("_first.width")) | (F.col("height") != F.col("_first.height"))
    bent = F.col("width") * F.col("depth_height") != F.col("height") * F.col("depth_width")
    rule = F.when(lost, "image is missing").when(odd, "images differ in size").when(bent, "aspect differs from the depth raster")
    return joined.withColumn("rule", rule).where("rule IS NOT NULL").select("capture", "frame_id", "rule")


def source_coverage(files: DataFrame, rooms: DataFrame, named: DataFrame) -> DataFrame:
    """(source, available, n_files, n_groups) for floor plan, photos, video and lidar of one case.

    files (path), rooms (room_id, photo_folder), named (source, path): the floor plan and the video that the
    case names. A room's photos are those anywhere below its folder: each path meets the folders above it by an equi-join.
    """
    parts = F.split("path", "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("photo_folder")
    own = files.select("path", extension(F.col("path")).alias("_ext"))
    photos_of = own.where(F.col("_ext").isin(*PHOTO) & F.contains("path", F.lit("/"))).select("path", above).join(rooms.select("room_id", "photo_folder"), "photo_folder").agg(F.count(F.lit(1)).alias("n_files"), F.count_distinct("room_id").alias("n_groups"))
    scans = own.where(F.col("_ext").isin(*SCAN_FILES)).agg(F.count(F.lit(1)).alias("n_files"))
    found = named.join(own, "path", "left").groupBy("source").agg(F.count("_ext").alias("n_files"))
    none = F.lit(None).cast("long")
    rows = found.select("source", "n_files", none.alias("n_groups")).unionByName(photos_of.select(F.lit("photos").alias("source"), "n_files", "n_groups")).unionByName(scans.select(F.lit("lidar").alias("source"), "n_files", none.alias("n_groups")))
    return rows.select("source", (F.col("n_files") > 0).alias("available"), "n_files", "n_groups")


def device(images: DataFrame) -> DataFrame:
    """One device of the images' (make, model): the only one, "Mixed devices" or null."""
    name = F.trim(F.concat_ws(" ", "make", "model"))
    seen = images.agg(F.collect_set(F.when(name != "", name)).alias("_d"))
    return seen.select(F.when(F.size("_d") == 1, F.col("_d")[0]).when(F.size("_d") > 1, "Mixed devices").alias("device"))


def result_files(files: DataFrame, name: str = "result.json") -> DataFrame:
    """Distinct result documents, by path."""
    return files.where(file_name(F.col("path")) == name).select("path").distinct().orderBy("path")


def raster_pixels(frames: DataFrame, step: int = 1) -> DataFrame:
    """(frame_id, u, v, value) of rows (frame_id, width, height, data binary: little-endian uint16), every `step`-th row and column."""
    import numpy as np
    import pandas as pd

    from plumbline.session import importable

    importable(frames.sparkSession)

    def run(batches):  # noqa: ANN001, ANN202
        for f in batches:
            for frame, width, height, data in zip(f["frame_id"], f["width"], f["height"], f["data"], strict=True):
                grid = np.frombuffer(data, "<u2").reshape(int(height), int(width))[::step, ::step]
                v, u = np.mgrid[0:height:step, 0:width:step]
                yield pd.DataFrame({"frame_id": frame, "u": u.ravel().astype("int32"), "v": v.ravel().astype("int32"), "value": grid.ravel().astype("int32")})

    return frames.select("frame_id", "width", "height", "data").mapInPandas(run, "frame_id string, u int, v int, value int")
