"""The review document of a capture: what was seen and what is only supposed, as one GeoJSON text.

Four kinds of feature in a fixed order: observed floor, wall planes, faces between walls, open gaps. A
capture has tens of features, so a document is one row; captures are as many as there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.keyed import last_wins

c = F.col
# What a feature says of itself.
COVERAGE_NOTE = "Observed sensor coverage only; may stop at occlusion or furniture."
WALL_NOTE = "Projected planar support; not an accepted wall measurement."
FACE_NOTE = "Not a verified room; metric scale and geometry are unvalidated."
GAP_NOTE = "Review target only; this is not an opening detection."
GAP_REASON = "Not classified as an opening."
LABELS = ["doorway", "window", "other discontinuity", "unresolved"]
SYSTEM = {"coordinate_system": "capture-local XY; metres assumed", "measurement_status": "uncalibrated; no independent ground truth"}


def text(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def feature(rows: DataFrame, order: int, ordinal: str, shape: str, coordinates: Column, kind: str, **properties: Column) -> DataFrame:
    """(capture_id, k, ordinal, feature): `rows` as features of one kind."""
    own = F.struct(F.lit(kind).alias("feature_type"), *[v.alias(name) for name, v in properties.items()])
    geometry = F.struct(F.lit(shape).alias("type"), coordinates.alias("coordinates"))
    return rows.select("capture_id", F.lit(order).alias("k"), c(ordinal).cast("long").alias("ordinal"), text(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), own.alias("properties"))).alias("feature"))


def coverage(outlines: DataFrame) -> DataFrame:
    """Outlines (capture_id, vertices, area_m2) of four points or more."""
    rows = outlines.where(F.size("vertices") >= 4).withColumn("ordinal", F.lit(0))
    return feature(rows, 0, "ordinal", "Polygon", F.array("vertices"), "observed_floor_coverage", status=F.lit("diagnostic_only"), area_m2=c("area_m2"), is_room_footprint=F.lit(False), note=F.lit(COVERAGE_NOTE))


def wall_planes(walls: DataFrame, alignments: DataFrame) -> DataFrame:
    """Walls (capture_id, ordinal, candidate_id, endpoints, length_m, height_m) of two end points; alignments (capture_id, candidate_id, status)."""
    rows = walls.where(F.size("endpoints") == 2).join(alignments.select("capture_id", "candidate_id", c("status").alias("_status")), ["capture_id", "candidate_id"], "left")
    return feature(rows, 1, "ordinal", "LineString", c("endpoints"), "wall_plane_candidate", candidate_id=c("candidate_id"), status=F.lit("unverified_candidate"), floor_alignment=F.coalesce("_status", F.lit("unavailable")), observed_length_m=c("length_m"), observed_height_m=c("height_m"), note=F.lit(WALL_NOTE))


def faces(found: DataFrame) -> DataFrame:
    """Faces (capture_id, ordinal, hypothesis, vertices, area_m2, walls) of three points or more; open rings are closed."""
    ring = F.when(c("vertices")[0] == F.element_at("vertices", -1), c("vertices")).otherwise(F.concat("vertices", F.slice("vertices", 1, 1)))
    rows = found.where(F.size("vertices") >= 3)
    return feature(rows, 2, "ordinal", "Polygon", F.array(ring), "boundary_face_hypothesis", candidate_id=c("hypothesis"), status=F.lit("diagnostic_only"), area_m2=c("area_m2"), supporting_wall_candidate_ids=F.coalesce("walls", F.array().cast("array<string>")), confidence_interval_m2=F.lit(None).cast("double"), note=F.lit(FACE_NOTE))


def gaps(found: DataFrame, reviews: DataFrame) -> DataFrame:
    """Gaps (capture_id, gap, candidate_a, ax, ay, candidate_b, bx, by, gap_m) with what was stored about their pair of walls.

    reviews (capture_id, ordinal, candidate_a, candidate_b, candidate_id, direction_difference_degrees, lateral_offset_m, reason):
    of several for one pair the last counts; without one a gap is named by its number.
    """
    pair = ["capture_id", "candidate_a", "candidate_b"]
    stored = last_wins(reviews, pair, ["ordinal"]).withColumn("_known", F.lit(True)).drop("ordinal")
    whole = F.array("ax", "ay", "bx", "by")
    rows = found.where(F.forall(whole, lambda v: v.isNotNull())).join(stored, pair, "left")
    own = lambda name, other: F.when(c("_known"), c(name)).otherwise(other)
    return feature(
        rows, 3, "gap", "LineString", F.array(F.array("ax", "ay"), F.array("bx", "by")), "unclassified_boundary_gap",
        candidate_id=own("candidate_id", F.concat(F.lit("boundary_gap_"), c("gap").cast("string"))), status=F.lit("unclassified_boundary_discontinuity"), candidate_a=c("candidate_a"), candidate_b=c("candidate_b"), gap_extent_m=c("gap_m"),
        direction_difference_degrees=c("direction_difference_degrees"), lateral_offset_m=c("lateral_offset_m"), review_reason=own("reason", F.lit(GAP_REASON)), review_label=F.lit(None).cast("string"), allowed_review_labels=F.array(*map(F.lit, LABELS)), note=F.lit(GAP_NOTE),
    )


def documents(captures: DataFrame, parts: list[DataFrame], name: str = "geometry review (diagnostic only)", axes: tuple[str, str] = ("x", "y")) -> DataFrame:
    """(capture_id, document) of every capture, features by kind and order; one without features has an empty list."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    listed = rows.groupBy("capture_id").agg(F.array_sort(F.collect_list(F.struct("k", "ordinal", "feature"))).alias("_f"))
    head = text(F.struct(F.lit("FeatureCollection").alias("type"), F.lit(name).alias("name"), F.struct(F.lit(SYSTEM["coordinate_system"]).alias("coordinate_system"), F.array(*map(F.lit, axes)).alias("axis_order"), F.lit(SYSTEM["measurement_status"]).alias("measurement_status")).alias("properties")))
    joined = F.array_join(F.transform(F.coalesce("_f", F.array().cast(listed.schema["_f"].dataType)), lambda f: f["feature"]), ",")
    return captures.select("capture_id").distinct().join(listed, "capture_id", "left").select("capture_id", F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"features":['), joined, F.lit("]}")).alias("document"))
