"""Candidate and reference plans as JSON documents: their spaces, edges and rings as rows, their faults as violation rows, and the comparison.

Documents are rows (plan_id, reference, candidate), both JSON text. The reference holds rooms,
connectors and adjacency, the candidate is a feature collection. Text is parsed once into VARIANT
and taken apart by JVM expressions; a plan that breaks a rule has rows in `violations`, and what can be
read of it is still read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import polygon
from plumbline.session import shuffled

c = F.col
REFERENCE = {"rooms": "room_id", "connectors": "connector_id"}


def part(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{path}" if path else "$", kind)


def is_text(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def is_object(v: Column) -> Column:
    return part(v, "", "map<string,variant>").isNotNull()


def truthy(v: Column) -> Column:
    """Is a value neither missing nor null, empty, zero or false?"""
    kind, text = F.schema_of_variant(v), part(v, "", "string")
    by_kind = F.when(kind == "STRING", text != "").when(kind == "BOOLEAN", text == "true").when(text.isin("[]", "{}"), False).otherwise(F.coalesce(part(v, "", "double") != 0, F.lit(True)))
    return F.coalesce(by_kind & text.isNotNull(), F.lit(False))


def named(v: Column) -> Column:
    """A value as the text of an id; null if it is missing or null."""
    text = part(v, "", "string")
    return F.when(F.schema_of_variant(v) == "BOOLEAN", F.initcap(text)).otherwise(text)


def parsed(docs: DataFrame) -> DataFrame:
    return docs.select("plan_id", F.try_parse_json("reference").alias("ref"), F.try_parse_json("candidate").alias("cand"))


def features(plans: DataFrame) -> DataFrame:
    """(plan_id, pos, feature) of the candidates."""
    return plans.select("plan_id", F.posexplode(part(c("cand"), "features", "array<variant>")).alias("pos", "feature"))


def entries(plans: DataFrame) -> DataFrame:
    """(plan_id, collection, pos, entry, id) of the references' rooms and connectors, the id as it stands."""
    lists = F.array(*[F.struct(F.lit(name).alias("collection"), part(c("ref"), name, "array<variant>").alias("list")) for name in REFERENCE])
    each = plans.select("plan_id", F.explode(lists).alias("l")).select("plan_id", "l.collection", F.posexplode("l.list").alias("pos", "entry"))
    own = F.coalesce(*[F.when(c("collection") == name, part(c("entry"), key)) for name, key in REFERENCE.items()])
    return each.withColumn("id", own)


def reference_spaces(plans: DataFrame) -> DataFrame:
    """(plan_id, space_id, ring): a space for each id, the first of those that repeat it."""
    rows = entries(plans).where(is_text(c("id"))).withColumn("space_id", part(c("id"), "", "string")).where("space_id <> ''")
    order = F.struct((c("collection") == "connectors").alias("k"), "pos")
    return rows.withColumn("ring", part(c("entry"), "polygon_px", "array<array<double>>")).groupBy("plan_id", "space_id").agg(F.min_by(F.struct("ring"), order).alias("_r")).select("plan_id", "space_id", "_r.ring")


def candidate_features(plans: DataFrame) -> DataFrame:
    """(plan_id, pos, space_id, adjacency, shape, ring, edges, status) of each feature with properties."""
    p = part(c("feature"), "properties")
    room, connector = part(c("feature"), "properties.room_id"), part(c("feature"), "properties.connector_id")
    kind = F.coalesce(part(c("feature"), "properties.feature_type", "string") == "room_adjacency", F.lit(False))
    return features(plans).where(is_object(p)).select(
        "plan_id", "pos", F.when(~kind, F.when(truthy(room), named(room)).otherwise(named(connector))).alias("space_id"), kind.alias("adjacency"),
        part(c("feature"), "geometry.type", "string").alias("shape"), part(c("feature"), "geometry.coordinates[0]", "array<array<double>>").alias("ring"),
        part(c("feature"), "properties.edges", "array<variant>").alias("edges"), F.coalesce(part(c("feature"), "properties.geometry_status", "string"), F.lit("")).alias("status"),
    )


def candidate_spaces(plans: DataFrame) -> DataFrame:
    """(plan_id, space_id, shape, ring, status): a space for each id, the first of those that repeat it."""
    rows = candidate_features(plans).where("space_id IS NOT NULL")
    return rows.groupBy("plan_id", "space_id").agg(F.min_by(F.struct("shape", "ring", "status"), "pos").alias("_f")).select("plan_id", "space_id", "_f.*")


def edge_pairs(rows: DataFrame, edges: str) -> DataFrame:
    """(plan_id, a, b) with a <= b of entries {space_a, space_b} whose ends are text."""
    each = rows.select("plan_id", F.explode(edges).alias("e")).select("plan_id", part(c("e"), "space_a").alias("x"), part(c("e"), "space_b").alias("y")).where(is_text(c("x")) & is_text(c("y")))
    x, y = part(c("x"), "", "string"), part(c("y"), "", "string")
    return each.select("plan_id", F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def reference_edges(plans: DataFrame) -> DataFrame:
    return edge_pairs(plans.withColumn("_edges", part(c("ref"), "adjacency", "array<variant>")), "_edges")


def candidate_edges(plans: DataFrame) -> DataFrame:
    return edge_pairs(candidate_features(plans).where("adjacency"), "edges")


def image_size(plans: DataFrame) -> DataFrame:
    """(plan_id, width, height) where both are positive whole numbers."""
    whole = lambda name: F.when(F.schema_of_variant(part(c("ref"), f"source.{name}")) == "BIGINT", part(c("ref"), f"source.{name}", "long"))
    return plans.select("plan_id", whole("image_width_px").alias("width"), whole("image_height_px").alias("height")).where("width > 0 AND height > 0")


def ring_fault(ring: Column, width: Column, height: Column) -> Column:
    """What is wrong with a pixel ring: null if it has four points or more, all of two finite numbers inside the image."""
    odd = F.exists(ring, lambda p: p.isNull() | (F.size(p) != 2) | F.exists(p, lambda v: v.isNull()))
    wild = F.exists(ring, lambda p: F.exists(p, lambda v: F.isnan(v) | (F.abs(v) == float("inf"))))
    outside = F.exists(ring, lambda p: (p[0] < 0) | (p[0] >= width) | (p[1] < 0) | (p[1] >= height))
    return F.when(ring.isNull(), "has invalid polygon coordinates").when(F.size(ring) < 4, "needs a closed polygon ring with at least 3 vertices").when(odd, "has invalid polygon coordinates").when(wild, "has non-finite coordinates").when(outside, "has coordinates outside the image")


def rings(plans: DataFrame) -> DataFrame:
    """(plan_id, side, space_id, ring, fault) of all spaces of plans whose image size is known."""
    both = reference_spaces(plans).select("plan_id", F.lit("reference").alias("side"), "space_id", F.lit("Polygon").alias("shape"), "ring")
    rows = both.unionByName(candidate_spaces(plans).select("plan_id", F.lit("candidate").alias("side"), "space_id", "shape", "ring")).join(shuffled(image_size(plans)), "plan_id")
    fault = F.when(F.coalesce(c("shape") != "Polygon", F.lit(True)), "must have Polygon geometry").otherwise(ring_fault(c("ring"), c("width"), c("height")))
    return rows.select("plan_id", "side", "space_id", "ring", fault.alias("fault"))


def violations(docs: DataFrame) -> DataFrame:
    """(plan_id, side, rule, detail): everything that keeps a plan from being compared."""
    plans = parsed(docs)
    found: list[DataFrame] = []

    def say(rows: DataFrame, side: str, rule: str, detail: Column | None = None) -> None:
        found.append(rows.select("plan_id", F.lit(side).alias("side"), F.lit(rule).alias("rule"), (F.lit(None) if detail is None else detail).cast("string").alias("detail")))

    for side, column in (("reference", "ref"), ("candidate", "cand")):
        say(plans.where(~F.coalesce(is_object(c(column)), F.lit(False))), side, "must be a JSON object")
    known = plans.where(is_object(c("ref")))
    for name in REFERENCE:
        say(known.where(part(c("ref"), name).isNotNull() & part(c("ref"), name, "array<variant>").isNull()), "reference", f"{name} must be an array")
    rows = entries(known)
    at = F.concat_ws(" ", "collection", "pos")
    say(rows.where(~is_object(c("entry"))), "reference", "contains a non-object entry", at)
    say(rows.where(is_object(c("entry")) & ~(is_text(c("id")) & truthy(c("id")))), "reference", "contains an entry without an ID", at)
    ids = rows.where(is_text(c("id"))).select("plan_id", part(c("id"), "", "string").alias("space_id")).where("space_id <> ''")
    say(ids.groupBy("plan_id", "space_id").count().where("count > 1"), "reference", "duplicate space ID", c("space_id"))
    say(known.select("plan_id").join(shuffled(ids), "plan_id", "left_anti"), "reference", "has no spaces")
    say(known.select("plan_id").join(shuffled(image_size(known)), "plan_id", "left_anti"), "reference", "must declare a positive image size")
    drawn = plans.where(is_object(c("cand")))
    collection = F.coalesce((part(c("cand"), "type", "string") == "FeatureCollection") & part(c("cand"), "features", "array<variant>").isNotNull(), F.lit(False))
    say(drawn.where(~collection), "candidate", "must be a FeatureCollection")
    say(features(drawn).where(~is_object(part(c("feature"), "properties"))), "candidate", "feature must have a properties object", c("pos"))
    drawn_ids = candidate_features(drawn).where("space_id IS NOT NULL").select("plan_id", "space_id")
    say(drawn_ids.groupBy("plan_id", "space_id").count().where("count > 1"), "candidate", "duplicate space ID", c("space_id"))
    say(drawn.where(collection).select("plan_id").join(shuffled(drawn_ids), "plan_id", "left_anti"), "candidate", "contains no identified space features")
    frames = known.where(is_object(c("cand"))).select("plan_id", named(part(c("ref"), "source.coordinate_frame")).alias("want"), named(part(c("cand"), "coordinate_reference")).alias("got"))
    say(frames.where(~c("want").eqNullSafe(c("got"))), "candidate", "coordinate frames differ", F.concat_ws(", got ", F.coalesce("want", F.lit("none")), F.coalesce("got", F.lit("none"))))
    for side in ("reference", "candidate"):
        say(rings(plans).where((c("side") == side) & c("fault").isNotNull()), side, "ring", F.concat_ws(" ", "space_id", "fault"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def compared(docs: DataFrame) -> DataFrame:
    """One row a plan: spaces matched by id, edges as sets, and pixel overlap of the matched spaces whose rings are sound."""
    plans = parsed(docs)
    key = F.concat_ws("\0", c("plan_id").cast("string"), "space_id")
    truth, drawn = reference_spaces(plans).select("plan_id", "space_id", F.lit(1).alias("_t")), candidate_spaces(plans).select("plan_id", "space_id", "status", F.lit(1).alias("_d"))
    both = truth.join(shuffled(drawn), ["plan_id", "space_id"], "full").groupBy("plan_id").agg(
        F.count("_t").alias("reference_spaces"), F.count("_d").alias("candidate_spaces"), F.count_if(c("_t").isNotNull() & c("_d").isNotNull()).alias("matched"),
        F.array_sort(F.collect_list(F.when(c("_d").isNull(), c("space_id")))).alias("missing_ids"), F.array_sort(F.collect_list(F.when(c("_t").isNull(), c("space_id")))).alias("extra_ids"),
        F.bool_and(F.when(c("_d").isNotNull(), c("status") == "manual_reference_trace")).alias("_traced"),
    )
    near = reference_edges(plans).withColumn("_t", F.lit(1)).join(shuffled(candidate_edges(plans).withColumn("_d", F.lit(1))), ["plan_id", "a", "b"], "full").groupBy("plan_id")
    edges = near.agg(F.count("_t").alias("reference_edges"), F.count("_d").alias("candidate_edges"), F.count_if(c("_t").isNotNull() & c("_d").isNotNull()).alias("correct_edges"))
    sound = rings(plans).where("fault IS NULL").withColumn("_key", key).withColumn("_ring", F.transform("ring", lambda p: F.struct(F.rint(p[0]).alias("x"), F.rint(p[1]).alias("y"))))
    runs = lambda side: polygon.disjoint_runs(polygon.raster(sound.where(c("side") == side), "_key", "_ring"), "_key")
    shares = polygon.runs_iou(runs("candidate"), runs("reference"), "_key").join(shuffled(truth.withColumn("_key", key).select("_key", "plan_id")), "_key")
    areas = shares.groupBy("plan_id").agg(F.count(F.lit(1)).alias("compared_spaces"), F.avg("iou").alias("mean_iou"), (F.sum("intersection") / F.sum("union")).alias("micro_iou"))
    rows = plans.select("plan_id").join(shuffled(both), "plan_id", "left").join(shuffled(edges), "plan_id", "left").join(shuffled(areas), "plan_id", "left").na.fill(0, ["reference_spaces", "candidate_spaces", "matched", "reference_edges", "candidate_edges", "correct_edges", "compared_spaces"])
    none = lambda other: F.when(c(other) == 0, 1.0).otherwise(0.0)
    rows = rows.withColumn("precision", F.when(c("candidate_edges") > 0, c("correct_edges") / c("candidate_edges")).otherwise(none("reference_edges")))
    rows = rows.withColumn("recall", F.when(c("reference_edges") > 0, c("correct_edges") / c("reference_edges")).otherwise(none("candidate_edges")))
    rows = rows.withColumn("f1", F.when(c("precision") + c("recall") > 0, 2 * c("precision") * c("recall") / (c("precision") + c("recall"))))
    return rows.withColumn("status", F.when(c("_traced"), "self_consistency_only").otherwise("reference_comparison")).drop("_traced")
