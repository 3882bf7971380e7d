"""Readers, writers, projections and rule sets on rows and files derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import scalars
from plumbline.operators import audit, keyed, manifest, nested, pointcloud, polygon, schemas, validate, walls
from plumbline.plans.capture_queries import Q, cloud, shapes
from plumbline.plans.catalog import register
from plumbline.session import dealt, scratch, table
from plumbline.sources import readers, writers

c = F.col


def text(column: str) -> F.Column:
    return c(column).cast("string")


@register("odometry_scan", "SELECT event_id::VARCHAR AS frame, event_id / 10.0::DOUBLE AS timestamp, value AS x, value * 2 AS fx FROM events")
def odometry_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Events written as a pose file and read again."""
    one = F.lit(1.0)
    rows = table(spark, sf, "events").select((c("event_id") / 10.0).alias("timestamp"), text("event_id").alias("frame"), c("value").alias("x"), one.alias("y"), one.alias("z"), *[one.alias(q) for q in ("qx", "qy", "qz", "qw")], (c("value") * 2).alias("fx"), *[one.alias(q) for q in ("fy", "cx", "cy")])
    rows.write.csv(path := scratch(spark, "scan"), header=True)
    return readers.odometry(spark, path).select("frame", "timestamp", "x", "fx")


@register("trajectory_scan", "SELECT vec_id / 4.0::DOUBLE AS ts, embedding[1]::DOUBLE AS ax, embedding[6]::DOUBLE AS tz FROM embeddings")
def trajectory_scan(spark: SparkSession, sf: str) -> DataFrame:
    e = lambda k: c("embedding")[k].cast("double").cast("string")
    rows = table(spark, sf, "embeddings").select(F.concat_ws(" ", (c("vec_id") / 4.0).cast("string"), *[e(k) for k in range(6)]).alias("value"))
    rows.unionByName(spark.createDataFrame([("# comment",), ("  ",)], "value string")).write.text(path := scratch(spark, "scan"))
    return readers.trajectory(spark, path).select("ts", "ax", "tz")


@register("reconstruction_scan", "SELECT p_partkey AS image_id, p_size * 0.5::DOUBLE AS qw, 'room' || (p_partkey % 5) || '__' || p_partkey || '.jpg' AS image_name FROM part")
def reconstruction_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Image lines between point lines and comments."""
    line = F.concat_ws(" ", text("p_partkey"), (c("p_size") * 0.5).cast("string"), F.lit("0 0 0 1 2 3 1"), F.concat(F.lit("room"), (c("p_partkey") % 5).cast("string"), F.lit("__"), text("p_partkey"), F.lit(".jpg")))
    rows = table(spark, sf, "part").select(F.explode(F.array(line, F.lit("12.5 3.5 -1 8.0 2.0 7"), F.lit(""))).alias("value"))
    rows.unionByName(spark.createDataFrame([("# images",)], "value string")).write.text(path := scratch(spark, "scan"))
    return readers.colmap_images(spark, path).select("image_id", "qw", "image_name")


@register("json_round_trip", "SELECT count(*) AS n, sum(c_custkey)::BIGINT AS keys, round(sum(c_acctbal), 2) AS total FROM customer")
def json_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written after validation, read with their schema."""
    rows = table(spark, sf, "customer").select("c_custkey", c("c_acctbal").cast("double").alias("c_acctbal"))
    writers.results(rows, validate.unique(rows, ["c_custkey"], "key"), path := scratch(spark, "scan"))
    return spark.read.json(path, schema="c_custkey long, c_acctbal double").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@register("ply_lines", "SELECT vec_id AS point_idx, printf('%.6f %.6f %.6f %d %d %d', embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE, label, 2, 3) AS line FROM embeddings")
def ply_lines(spark: SparkSession, sf: str) -> DataFrame:
    points = cloud(spark, sf).select("point_idx", "x", "y", "z", c("label").alias("r"), F.lit(2).alias("g"), F.lit(3).alias("b"))
    return writers.ply_lines(points).where("point_idx >= 0")


@register("geojson_features", "SELECT 'P' || p_partkey AS candidate_id, 'room' AS feature_type, 'Polygon' AS shape FROM part")
def geojson_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = shapes(spark, sf).select(c("name").alias("candidate_id"), F.array("vertices").alias("rings"))
    got = writers.features(rows, "room", "Polygon", "rings", "candidate_id")
    at = lambda path: F.get_json_object("feature", path)
    return got.select(at("$.properties.candidate_id").alias("candidate_id"), at("$.properties.feature_type").alias("feature_type"), at("$.geometry.type").alias("shape"))


@register("capture_types", """SELECT p_partkey::VARCHAR AS capture, CASE p_partkey % 5 WHEN 0 THEN 'rgbd' WHEN 1 THEN 'video' WHEN 2 THEN 'photo' WHEN 3 THEN 'lidar' END AS capture_type,
  CASE p_partkey % 5 WHEN 3 THEN 'point clouds aren''t processed' WHEN 4 THEN 'could not determine capture type' END AS problem FROM part""")
def capture_types(spark: SparkSession, sf: str) -> DataFrame:
    k = c("p_partkey") % 5
    listed = lambda *names: F.array(*map(F.lit, names))
    files = F.when(k == 0, listed("keyframes/depth/1.png", "keyframes/corrected_cameras/1.json", "keyframes/images/1.jpg")).when(k == 1, listed("a/clip.MOV", "b.jpg")).when(k == 2, listed("x.heic", "y.ply")).when(k == 3, listed("s.las")).otherwise(listed("notes.txt", "i.webp"))
    rows = table(spark, sf, "part").select(text("p_partkey").alias("capture"), F.explode(files).alias("relative"))
    return readers.capture_type(rows, rows.select("capture").distinct())


@register("key_frame_folders", "SELECT p_partkey::VARCHAR AS capture, CASE p_partkey % 3 WHEN 0 THEN 'optimized' WHEN 1 THEN 'raw' END AS mode, CASE p_partkey % 3 WHEN 0 THEN 'keyframes/corrected_images' WHEN 1 THEN 'keyframes/images' END AS images FROM part")
def key_frame_folders(spark: SparkSession, sf: str) -> DataFrame:
    k = c("p_partkey") % 3
    listed = lambda *names: F.array(*[F.lit(f"keyframes/{n}/1.x") for n in names])
    files = F.when(k == 0, listed("depth", "corrected_images", "corrected_cameras", "images", "cameras")).when(k == 1, listed("depth", "images", "cameras", "corrected_images")).otherwise(listed("depth", "images", "corrected_cameras"))
    return readers.key_frame_folders(table(spark, sf, "part").select(text("p_partkey").alias("capture"), F.explode(files).alias("relative"))).select("capture", "mode", "images")


@register("key_frame_images", "SELECT (p_partkey // 10)::VARCHAR AS capture, p_partkey AS frame_id, CASE p_partkey % 10 WHEN 3 THEN 'image is missing' WHEN 4 THEN 'images differ in size' ELSE 'aspect differs from the depth raster' END AS rule FROM part WHERE p_partkey % 10 IN (3, 4, 5) AND p_partkey // 10 * 10 IN (SELECT p_partkey FROM part)")
def key_frame_images(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.floor(c("p_partkey") / 10).cast("string").alias("capture"), c("p_partkey").alias("frame_id"), (c("p_partkey") % 10).alias("k"))
    p = p.join(p.where("k = 0").select("capture"), "capture", "left_semi")
    frames = p.select("capture", "frame_id", F.lit(256).alias("depth_width"), F.when(c("k") == 5, 190).otherwise(192).alias("depth_height"))
    images = p.where("k <> 3").select("capture", "frame_id", F.when(c("k") == 4, 640).otherwise(1024).alias("width"), F.when(c("k") == 4, 480).otherwise(768).alias("height"))
    return readers.key_frame_images(frames, images)


@register("device_of_photos", "SELECT CASE WHEN count(DISTINCT p_brand) > 1 THEN 'Mixed devices' ELSE max('Maker ' || p_brand) END AS device FROM part")
def device_of_photos(spark: SparkSession, sf: str) -> DataFrame:
    return readers.device(table(spark, sf, "part").select(F.lit("Maker").alias("make"), c("p_brand").alias("model")))


@register("name_timestamps", "SELECT event_id, CASE WHEN event_id % 4 > 0 THEN event_id / 8.0::DOUBLE END AS ts FROM events")
def name_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    token = F.when(c("event_id") % 4 > 0, (c("event_id") / 8.0).cast("string")).otherwise("none")
    return table(spark, sf, "events").select("event_id", readers.name_timestamp(F.concat(F.lit("/x/frame_1_"), token, F.lit(".png")), strict=False).alias("ts"))


@register("photo_listing", "SELECT '/r/' || p_partkey || '.JPG' AS path FROM part WHERE p_partkey % 3 = 0")
def photo_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Images directly in the folder; deeper ones and other files go."""
    k = c("p_partkey") % 3
    path = F.concat(F.lit("/r/"), F.when(k == 1, "deep/").otherwise(""), text("p_partkey"), F.when(k == 2, ".txt").otherwise(".JPG"))
    return readers.photos(table(spark, sf, "part").select(path.alias("path")), "/r").select("path")


@register("result_files", "SELECT DISTINCT '/r/' || (p_partkey % 50) || '/result.json' AS path FROM part")
def result_files(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(c("p_size") > 0, "result.json").otherwise("other.json")
    return readers.result_files(table(spark, sf, "part").select(F.explode(F.array(F.concat(F.lit("/r/"), (c("p_partkey") % 50).cast("string"), F.lit("/"), name), F.lit("/r/notes.txt"))).alias("path")))


@register("source_coverage", """SELECT 'floor_plan' AS source, true AS available, 1::BIGINT AS n_files, NULL::BIGINT AS n_groups UNION ALL SELECT 'video', false, 0, NULL
UNION ALL SELECT 'photos', count(*) > 0, count(*), count(DISTINCT p_brand) FROM part WHERE p_size % 2 = 0 UNION ALL SELECT 'lidar', count(*) > 0, count(*), NULL FROM part WHERE p_size % 2 = 1""")
def source_coverage(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    path = F.concat(F.lit("photos/"), c("p_brand"), F.lit("/"), text("p_partkey"), F.when(c("p_size") % 2 == 0, ".heic").otherwise(".LAZ"))
    files = part.select(path.alias("path")).unionByName(spark.createDataFrame([("plan.svg",)], "path string"))
    rooms = part.select(c("p_brand").alias("room_id"), F.concat(F.lit("photos/"), c("p_brand")).alias("photo_folder")).distinct()
    return readers.source_coverage(files, rooms, spark.createDataFrame([("floor_plan", "plan.svg"), ("video", "walk.mov")], "source string, path string"))


@register("room_ids", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'k' || p_partkey WHEN 1 THEN 'hall' || (p_partkey % 7) END AS room FROM part")
def room_ids(spark: SparkSession, sf: str) -> DataFrame:
    k = c("p_partkey") % 3
    path = F.when(k == 0, F.concat(F.lit("/r/k"), text("p_partkey"), F.lit(".jpg"))).when(k == 1, F.concat(F.lit("/r/hall"), (c("p_partkey") % 7).cast("string"), F.lit("/1.jpg"))).otherwise("/r/a/b/1.jpg")
    return table(spark, sf, "part").select("p_partkey", nested.room_id(path, F.lit("/r")).alias("room"))


@register("whitelist_projection", "SELECT p_partkey, [{'model_id': p_partkey, 'points': p_size}, {'model_id': p_partkey + 1, 'points': 0}]::VARCHAR AS models FROM part")
def whitelist_projection(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda k, n: F.struct(k.cast("long").alias("model_id"), F.lit("secret").alias("path"), n.cast("long").alias("points"))
    rows = table(spark, sf, "part").select("p_partkey", F.array(one(c("p_partkey"), c("p_size")), one(c("p_partkey") + 1, F.lit(0))).alias("models"))
    kept = rows.select("p_partkey", nested.whitelist("models", ["model_id", "points"]).alias("m"))
    shown = F.transform("m", lambda x: F.format_string("{'model_id': %d, 'points': %d}", x["model_id"], x["points"]))
    return kept.select("p_partkey", F.concat(F.lit("["), F.array_join(shown, ", "), F.lit("]")).alias("models"))


@register("sides_with_support", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'a,b' ELSE 'x' END AS first, 'x' AS second FROM part")
def sides_with_support(spark: SparkSession, sf: str) -> DataFrame:
    own = F.array(F.when(c("p_size") % 2 == 0, F.array(F.lit("b"), F.lit("a"), F.lit("b"))))
    rows = table(spark, sf, "part").select("p_partkey", F.array(F.lit(2.0), F.lit(3.0)).alias("s"), own.alias("o"), F.array(F.lit("x")).alias("f"))
    got = rows.select("p_partkey", nested.sides_with_support("s", "o", "f").alias("g"))
    return got.select("p_partkey", *[F.array_join(c("g")[k]["supporting_ids"], ",").alias(n) for k, n in enumerate(("first", "second"))])


@register("consecutive_pairs", "SELECT user_id, event_id AS a, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events QUALIFY b IS NOT NULL")
def consecutive_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return keyed.consecutive(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_id")


@register("changes_only", "SELECT user_id, event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type")
def changes_only(spark: SparkSession, sf: str) -> DataFrame:
    return keyed.changes(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id")


@register("natural_order", "SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 3 = 0, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey END, 'n' || s_suppkey) AS place FROM supplier")
def natural_order(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", F.when(c("s_suppkey") % 3 > 0, text("s_suppkey")).otherwise(F.concat(F.lit("n"), text("s_suppkey"))).alias("k"))
    from pyspark.sql import Window

    return rows.select("s_suppkey", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(*keyed.natural("k"))).cast("long").alias("place"))


@register("linked_positions", "SELECT o_orderkey, c_custkey, CASE o_custkey % 2 WHEN 0 THEN c_acctbal ELSE 1.0 END AS entry FROM orders JOIN customer ON c_custkey = o_custkey")
def linked_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Each order must find its customer, and its position an entry of that customer's list."""
    orders = table(spark, sf, "orders").select("o_orderkey", c("o_custkey").alias("c_custkey"), (c("o_custkey") % 2).cast("int").alias("i"))
    both = keyed.linked(orders, table(spark, sf, "customer").select("c_custkey", F.array(c("c_acctbal").cast("double"), F.lit(1.0)).alias("a")), ["c_custkey"], "an order without its customer")
    return keyed.at_position(both, "a", "i", "entry").select("o_orderkey", "c_custkey", "entry")


@register("outline_alignment", "SELECT p_partkey::VARCHAR AS capture_id, 5::BIGINT AS n, p_partkey % 5 * 0.03::DOUBLE AS offset_m, CASE WHEN p_partkey % 5 < 6 THEN 'aligned_boundary_candidate' END AS status FROM part")
def outline_alignment(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(text("p_partkey").alias("capture_id"), (c("p_partkey") % 5 * 0.03).alias("d"))
    spans = part.select("capture_id", F.lit("w").alias("candidate_id"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(4.0).alias("x1"), F.lit(0.0).alias("y1"))
    outline = part.select("capture_id", F.explode(F.array(*[F.lit(float(k)) for k in range(5)])).alias("x"), c("d").alias("y"))
    return walls.align_to_outline(spans, outline).select("capture_id", "n", "offset_m", "status")


@register("raster_iou", f"""WITH {Q}, a AS (SELECT name, ox + i AS x, oy + j AS y FROM q, generate_series(0, 6) a(i), generate_series(0, 5) b(j) WHERE k = 0 AND i <= w AND j <= h), b AS (SELECT name, x + 1 AS x, y FROM a),
m AS (SELECT coalesce(a.name, b.name) AS name, count(a.name) FILTER (b.name IS NOT NULL) AS i, count(*) AS u FROM a FULL JOIN b ON a.name = b.name AND a.x = b.x AND a.y = b.y GROUP BY 1)
SELECT round(avg(i / u), 9) AS mean_iou, round(sum(i) / sum(u), 9) AS micro_iou FROM m""")
def raster_iou(spark: SparkSession, sf: str) -> DataFrame:
    """Rectangles against themselves moved by one pixel."""
    runs = polygon.disjoint_runs(polygon.raster(shapes(spark, sf).where("k = 0"), "name", "ring"), "name")
    got = audit.iou_scores(polygon.runs_iou(runs, runs.withColumns({"x0": c("x0") + 1, "x1": c("x1") + 1}), "name"))
    return got.select(F.round("mean_iou", 9).alias("mean_iou"), F.round("micro_iou", 9).alias("micro_iou"))


@register("video_quality", "SELECT s_nationkey, count(*) AS n_models, sum(s_suppkey % 50)::BIGINT AS n_memberships, max(s_suppkey % 50) AS largest, round(max(s_suppkey % 50) / 60.0::DOUBLE * 100, 1) AS coverage_percent FROM supplier GROUP BY 1")
def video_quality(spark: SparkSession, sf: str) -> DataFrame:
    return audit.quality_summary(table(spark, sf, "supplier").select("s_nationkey", (c("s_suppkey") % 50).alias("registered_images")), F.lit(60), ["s_nationkey"])


@register("footprint_sums", "SELECT 'c' || (p_partkey // 40) AS property_id, 'partial' AS status, sum(p_size)::DOUBLE AS value FROM part WHERE p_size % 2 = 0 GROUP BY 1")
def footprint_sums(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.concat(F.lit("c"), F.floor(c("p_partkey") / 40).cast("string")).alias("property_id"), F.when(c("p_size") % 2 == 0, "included_candidate").otherwise("excluded_overlap").alias("status"), c("p_size").cast("double").alias("area_m2"))
    return polygon.footprint(rows).where("value IS NOT NULL").select("property_id", "status", "value")


@register("floor_band", "SELECT vec_id AS point_idx FROM embeddings WHERE embedding[3]::DOUBLE BETWEEN -0.06 AND 0.06")
def floor_band(spark: SparkSession, sf: str) -> DataFrame:
    return pointcloud.band(cloud(spark, sf), "z", -0.06, 0.06).select("point_idx")


@register("composed_poses", "SELECT vec_id, round(-embedding[2]::DOUBLE + 1, 9) AS x, round(embedding[1]::DOUBLE + 2, 9) AS y, round(embedding[3]::DOUBLE + 3, 9) AS z FROM embeddings")
def composed_poses(spark: SparkSession, sf: str) -> DataFrame:
    """A quarter turn with a shift, after a shift by the vector."""
    a = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    inner = F.array(*[c("embedding")[k].cast("double") for k in range(3)])
    _, t = pointcloud.compose(a(0, -1, 0, 1, 0, 0, 0, 0, 1), a(1, 2, 3), a(1, 0, 0, 0, 1, 0, 0, 0, 1), inner)
    return table(spark, sf, "embeddings").select("vec_id", *[F.round(t[k], 9).alias(n) for k, n in enumerate("xyz")])


@register("schema_conformance", """SELECT c_custkey::VARCHAR AS key, '/tier' AS path, 'must be one of photo, video' AS message FROM customer WHERE c_custkey % 3 = 2
UNION ALL SELECT c_custkey::VARCHAR, '/area', 'must be above 0' FROM customer WHERE NOT c_acctbal > 0 UNION ALL SELECT c_custkey::VARCHAR, '/extra', 'is not allowed' FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT c_custkey::VARCHAR, '/id', 'is missing' FROM customer WHERE c_custkey % 5 = 0""")
def schema_conformance(spark: SparkSession, sf: str) -> DataFrame:
    schema = {"type": "object", "required": ["id"], "additionalProperties": False, "properties": {"id": {"type": "string", "minLength": 1}, "tier": {"enum": ["photo", "video"]}, "area": {"$ref": "#/$defs/area"}}, "$defs": {"area": {"type": ["number", "null"], "exclusiveMinimum": 0}}}
    k = c("c_custkey")
    fields = F.struct(F.when(k % 5 > 0, k.cast("string")).alias("id"), F.when(k % 3 == 0, "photo").when(k % 3 == 1, "video").otherwise("other").alias("tier"), c("c_acctbal").cast("double").alias("area"), F.when(k % 7 == 0, 1).alias("extra"))
    return schemas.conforms(table(spark, sf, "customer").select(k, F.to_json(fields).alias("json")), "c_custkey", "json", schema)


@register("photo_collections", "SELECT 'photo_count' AS rule, p_brand AS key, 'must have 2 to 8 rows' AS message FROM part GROUP BY p_brand HAVING count(*) NOT BETWEEN 2 AND 8 UNION ALL SELECT 'photo_rooms', 'collection', 'must have at least 2 rooms' WHERE (SELECT count(DISTINCT p_brand) FROM part) < 2")
def photo_collections(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.photo_collection(table(spark, sf, "part").select(c("p_brand").alias("folder"), text("p_partkey").alias("path")))


@register("ablation_rules", "SELECT 'ablation_modes' AS rule, c_custkey::VARCHAR AS key, 'must be raw, then corrected' AS message FROM customer WHERE c_custkey % 4 = 1 UNION ALL SELECT 'ablation_path', c_custkey::VARCHAR, 'must be one source' FROM customer WHERE c_custkey % 4 = 2")
def ablation_rules(spark: SparkSession, sf: str) -> DataFrame:
    k = c("c_custkey") % 4
    pairs = table(spark, sf, "customer").select(text("c_custkey").alias("capture_id"), F.lit("c").alias("capture_a"), F.lit("c").alias("capture_b"), F.lit("raw").alias("mode_a"), F.when(k == 1, "raw").otherwise("corrected").alias("mode_b"), F.lit("/A/b").alias("path_a"), F.when(k == 2, "/x").otherwise("/a/B").alias("path_b"))
    return manifest.ablation(pairs)


@register("sidecar_rules", "SELECT 'region_image' AS rule, p_brand || 'x' AS key, 'refers to nothing' AS message FROM part WHERE p_size % 10 = 0 GROUP BY p_brand UNION ALL SELECT 'region_polygon', p_brand, 'must be a polygon of at least 3 nonnegative points' FROM part WHERE p_size % 10 = 1")
def sidecar_rules(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    k, point = c("p_size") % 10, F.array(F.lit(1.0), F.lit(2.0))
    regions = part.select(F.when(k == 0, F.concat("p_brand", F.lit("x"))).otherwise(c("p_brand")).alias("image_path"), F.when(k == 1, F.array(point, point)).otherwise(F.array(point, point, point)).alias("polygon_px"))
    return manifest.sidecar(spark.createDataFrame([("damage",)], "field string"), ["damage", "openings"], regions, part.select(c("p_brand").alias("image_path")))


@register("run_stamps", "SELECT event_id, strftime(ts, '%Y%m%dT%H%M%S%fZ') AS stamp, '/a/c' || event_id || '.json' AS path, coalesce(CASE WHEN event_id % 2 = 0 THEN 'r' || event_id END, 'k') AS space FROM events")
def run_stamps(spark: SparkSession, sf: str) -> DataFrame:
    k = c("event_id") % 2
    path = F.concat(F.lit("../c"), text("event_id"), F.lit(".json"))
    return table(spark, sf, "events").select("event_id", scalars.run_stamp(c("ts").cast("timestamp_ntz")).alias("stamp"), scalars.below(F.lit("/a/./b"), path).alias("path"), scalars.space_id(F.when(k == 0, F.concat(F.lit("r"), text("event_id"))).otherwise(""), F.lit("k")).alias("space"))


@register("fix_declarations", """
WITH f AS (SELECT c_custkey AS k, c_custkey % 12 AS m, c_custkey::VARCHAR AS key FROM customer)
SELECT 'fix_proposed_fix' AS rule, key, 'must not be blank' AS message FROM f WHERE m = 1
UNION ALL SELECT 'fix_direction', key, 'must be one of higher_is_better, lower_is_better' FROM f WHERE m = 2
UNION ALL SELECT 'fix_numbers', key, 'needs a prediction and a threshold' FROM f WHERE m IN (3, 4)
UNION ALL SELECT 'fix_commands', key, 'needs the exact commands' FROM f WHERE m IN (5, 6)
UNION ALL SELECT 'fix_reports', key, 'don''t both exist' FROM f WHERE m = 7
UNION ALL SELECT 'fix_benchmark', key, 'must be one benchmark' FROM f WHERE m = 8
UNION ALL SELECT 'fix_runs', key, 'must be the same runs' FROM f WHERE m = 9
UNION ALL SELECT 'fix_evidence', 'proof ' || key, 'doesn''t exist' FROM f WHERE m = 10""")
def fix_declarations(spark: SparkSession, sf: str) -> DataFrame:
    """A declared fix for each customer, ten of twelve broken in a way of their own; each has two reports of three runs."""
    f = table(spark, sf, "customer").select(c("c_custkey").alias("k"), (c("c_custkey") % 12).alias("m"))
    named = lambda prefix: F.concat(F.lit(prefix), text("k"))
    fixes = f.select(
        text("k").alias("fix_id"), F.lit("gate").alias("target_gate"), F.lit("metric").alias("target_metric"), F.lit("why").alias("root_cause_hypothesis"), F.when(c("m") == 1, " ").otherwise("how").alias("proposed_fix"),
        F.when(c("m") == 2, "up").otherwise("lower_is_better").alias("direction"), F.when(c("m") == 3, float("nan")).otherwise(0.5).alias("acceptance_threshold"), F.when(c("m") != 4, 0.4).alias("predicted_after"), named("before ").alias("before_report"), named("after ").alias("after_report"),
        F.when(c("m") == 5, F.array().cast("array<string>")).when(c("m") == 6, F.array(F.lit("run"), F.lit(" "))).otherwise(F.array(F.lit("run"))).alias("commands"),
    )
    before, after = f.select(named("before ").alias("path"), "k", "m", F.lit(0).alias("side")), f.where("m <> 7").select(named("after ").alias("path"), "k", "m", F.lit(1).alias("side"))
    both = before.unionByName(after)
    reports = both.select("path", F.when((c("m") == 8) & (c("side") == 1), "other").otherwise("one").alias("benchmark_id"))
    # The later report lists its runs in another order; a broken one lists a run twice for another.
    order = F.when(c("side") == 0, F.array(*map(F.lit, (1, 2, 3)))).when(c("m") == 9, F.array(*map(F.lit, (3, 2, 2)))).otherwise(F.array(*map(F.lit, (3, 1, 2))))
    runs = both.select("path", F.explode(order).alias("n")).select("path", F.lit("photo").alias("tier"), F.concat(F.lit("r"), text("n")).alias("room_id"), F.lit("c").alias("capture_id"), F.lit(None).cast("string").alias("repeat_group"))
    artifacts = f.select(text("k").alias("fix_id"), named("proof ").alias("path"), (c("m") != 10).alias("found"))
    return manifest.fix_declaration(fixes, reports, runs, artifacts)


@register("depth_pairs", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber > 1 AND l_quantity / 4 BETWEEN 0.1 AND 10 AND l_tax * 100 BETWEEN 0.1 AND 10")
def depth_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (c("l_quantity") / 4).alias("sensor"), (c("l_tax") * 100).alias("reference"), (c("l_linenumber") - 1).alias("confidence"))
    return pointcloud.depth_pairs(rows, "sensor", "reference", "confidence").select("l_orderkey", "l_linenumber")


@register("pixel_stride", "SELECT vec_id, (k - 1) % 8 AS u, (k - 1) // 8 AS v FROM embeddings, range(1, 65) t(k) WHERE (k - 1) % 8 % 3 = 0 AND (k - 1) // 8 % 3 = 0")
def pixel_stride(spark: SparkSession, sf: str) -> DataFrame:
    pixels = table(spark, sf, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k")).select("vec_id", (c("k") % 8).alias("u"), F.floor(c("k") / 8).alias("v"))
    return pointcloud.every(pixels, 3)


def each_in_a_file(rows: DataFrame) -> str:
    """Rows (name, value) as text files of their own in one folder, which is read back.

    All tasks write, and each moves its own files when it is done, so that the driver lists one folder and moves nothing.
    """
    path = scratch(rows.sparkSession, "scan")
    dealt(rows, "name").select("value").write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(path)
    return path


@register("document_files", "SELECT s_suppkey AS id, s_name AS name FROM supplier")
def document_files(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON document a file, over several lines, as text and taken apart."""
    doc = F.concat(F.lit('  {\n "id": '), text("s_suppkey"), F.lit(',\n "name": "'), c("s_name"), F.lit('"}\n'))
    path = each_in_a_file(table(spark, sf, "supplier").select(text("s_suppkey").alias("name"), doc.alias("value")))
    at = lambda name: F.get_json_object("json", f"$.{name}")
    return readers.json_documents(spark, path).select(at("id").cast("long").alias("id"), at("name").alias("name"))


@register("intrinsics_files", "SELECT (s_suppkey + 1)::DOUBLE AS width, 200.0::DOUBLE AS height, s_suppkey + 0.5::DOUBLE AS fx, s_acctbal AS cx FROM supplier")
def intrinsics_files(spark: SparkSession, sf: str) -> DataFrame:
    """Six numbers a file, over two lines."""
    line = F.concat_ws(" ", (c("s_suppkey") + 1).cast("string"), F.lit("200"), (c("s_suppkey") + 0.5).cast("string"), F.lit("2e2\n"), F.format_string("%.2f", "s_acctbal"), F.lit("7\n"))
    path = each_in_a_file(table(spark, sf, "supplier").select(text("s_suppkey").alias("name"), line.alias("value")))
    return readers.pincam(spark, path).select("width", "height", "fx", "cx")
