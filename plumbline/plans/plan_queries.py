"""Candidate and reference plan documents made of the parts, eight a plan, and their comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import planes, spaces
from plumbline.plans.catalog import register
from plumbline.session import table

c = F.col
#: Of eight parts two are connectors; sizes decide what is missing, moved, extra and joined.
PARTS = """p AS (SELECT p_partkey // 8 AS plan_id, p_partkey % 8 AS k, CASE WHEN p_partkey % 8 < 6 THEN 'R' ELSE 'C' END || (p_partkey % 8) AS id, 5 + p_size % 10 AS w, 5 + p_size % 7 AS h, p_size % 3 AS s, p_size % 9 > 0 AS found, p_size % 11 = 0 AS extra, p_size % 4 > 0 AS joined FROM part)"""


def plan_documents(spark: SparkSession, sf: str) -> DataFrame:
    """(plan_id, reference, candidate): a plan's parts as rings in one row of a 200 by 60 image."""
    size, key = c("p_size"), c("p_partkey") % 8
    name = lambda k: F.concat(F.when(k < 6, "R").otherwise("C"), k.cast("string"))
    x, w, h = key * 20, 5 + size % 10, 5 + size % 7
    ring = lambda dx: F.array(*[F.array((x + dx + i * w).cast("double"), (10 + j * h).cast("double")) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    rows = table(spark, sf, "part").select(F.floor(c("p_partkey") / 8).alias("plan_id"), key.alias("k"), name(key).alias("id"), ring(F.lit(0)).alias("ring"), ring(size % 3).alias("moved"), (size % 9 > 0).alias("found"), (size % 11 == 0).alias("extra"), (size % 4 > 0).alias("joined"))

    def shape(own: Column) -> Column:
        kind = F.struct(F.lit("space").alias("feature_type"), F.when(c("k") < 6, own).alias("room_id"), F.when(c("k") >= 6, own).alias("connector_id"), F.lit("automatic").alias("geometry_status"), F.lit(None).cast("array<struct<space_a:string,space_b:string>>").alias("edges"))
        return F.struct(F.lit("Feature").alias("type"), kind.alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array("moved").alias("coordinates")).alias("geometry"))

    entry = lambda which, field: F.collect_list(F.when(which, F.struct(c("id").alias(field), c("ring").alias("polygon_px")))).alias(field)
    edge = F.struct(c("id").alias("space_a"), name(c("k") + 1).alias("space_b"))
    turned = F.struct(name(c("k") + 1).alias("space_a"), c("id").alias("space_b"))
    plans = rows.groupBy("plan_id").agg(
        entry(c("k") < 6, "room_id"), entry(c("k") >= 6, "connector_id"), F.collect_list(F.when(c("k") < 7, edge)).alias("edges"), F.collect_list(F.when((c("k") < 7) & c("joined"), turned)).alias("drawn"),
        F.array_sort(F.collect_list(F.when(c("found"), F.struct("k", shape(c("id")).alias("f"))))).alias("found"), F.array_sort(F.collect_list(F.when(c("extra"), F.struct("k", shape(F.concat(F.lit("X"), c("k").cast("string"))).alias("f"))))).alias("extra"),
    )
    source = F.struct(F.lit(200).alias("image_width_px"), F.lit(60).alias("image_height_px"), F.lit("image pixels").alias("coordinate_frame"))
    reference = F.to_json(F.struct(source.alias("source"), c("room_id").alias("rooms"), c("connector_id").alias("connectors"), c("edges").alias("adjacency")))
    # An adjacency feature like the others, with edges instead of an id.
    nothing = F.lit(None).cast("string")
    joins = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("room_adjacency").alias("feature_type"), nothing.alias("room_id"), nothing.alias("connector_id"), F.lit("automatic").alias("geometry_status"), c("drawn").alias("edges")).alias("properties"), F.lit(None).cast("struct<type:string,coordinates:array<array<array<double>>>>").alias("geometry"))
    shapes = F.concat(F.transform("found", lambda s: s["f"]), F.transform("extra", lambda s: s["f"]), F.array(joins))
    candidate = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.lit("image pixels").alias("coordinate_reference"), shapes.alias("features")))
    return plans.select("plan_id", reference.alias("reference"), candidate.alias("candidate"))


@register("plan_comparison", f"""WITH {PARTS},
s AS (SELECT plan_id, count(*) AS reference_spaces, count(*) FILTER (found) AS matched, count(*) FILTER (found) + count(*) FILTER (extra) AS candidate_spaces,
  coalesce(string_agg(id, ',' ORDER BY id) FILTER (NOT found), '') AS missing, coalesce(string_agg('X' || k, ',' ORDER BY k) FILTER (extra), '') AS extra,
  count(*) FILTER (k < 7) AS reference_edges, count(*) FILTER (k < 7 AND joined) AS candidate_edges,
  round(avg((w + 1 - s) / (w + 1 + s)::DOUBLE) FILTER (found), 9) AS mean_iou, round(sum((w + 1 - s) * (h + 1)) FILTER (found) / sum((w + 1 + s) * (h + 1)) FILTER (found), 9) AS micro_iou FROM p GROUP BY 1)
SELECT plan_id, reference_spaces, candidate_spaces, matched, missing, extra, candidate_edges AS correct_edges, mean_iou, micro_iou,
  round(CASE WHEN candidate_edges > 0 THEN 1.0 WHEN reference_edges = 0 THEN 1.0 ELSE 0.0 END, 9)::DOUBLE AS precision, round(CASE WHEN reference_edges > 0 THEN candidate_edges / reference_edges ELSE 1.0 END, 9)::DOUBLE AS recall FROM s""")
def plan_comparison(spark: SparkSession, sf: str) -> DataFrame:
    got = spaces.compared(plan_documents(spark, sf))
    listed = lambda name: F.array_join(f"{name}_ids", ",").alias(name)
    return got.select("plan_id", "reference_spaces", "candidate_spaces", "matched", listed("missing"), listed("extra"), "correct_edges", *[F.round(x, 9).alias(x) for x in ("mean_iou", "micro_iou", "precision", "recall")])


@register("plan_violations", f"""WITH {PARTS}, n AS (SELECT plan_id, plan_id % 8 AS f, count(*) FILTER (k < 6) AS rooms, count(*) FILTER (found AND k = 0) AS zero, count(*) AS n, count(*) FILTER (found OR extra) AS shown FROM p GROUP BY 1)
SELECT plan_id, 'candidate' AS side, 'coordinate frames differ' AS rule, 'image pixels, got metres' AS detail FROM n WHERE f = 1
UNION ALL SELECT plan_id, 'candidate', 'must be a FeatureCollection', NULL FROM n WHERE f = 2
UNION ALL SELECT plan_id, 'candidate', 'contains no identified space features', NULL FROM n WHERE f <> 2 AND shown = 0
UNION ALL SELECT plan_id, 'candidate', 'duplicate space ID', 'R0' FROM n JOIN p USING (plan_id) WHERE f = 3 AND p.k = 1 AND p.found AND zero > 0
UNION ALL SELECT plan_id, 'reference', 'must declare a positive image size', NULL FROM n WHERE f = 4
UNION ALL SELECT plan_id, 'reference', 'rooms must be an array', NULL FROM n WHERE f = 5
UNION ALL SELECT plan_id, 'reference', 'has no spaces', NULL FROM n WHERE f = 5 AND n = rooms
UNION ALL SELECT plan_id, 'reference', 'ring', id || ' has coordinates outside the image' FROM n JOIN p USING (plan_id) WHERE f = 6 AND 10 + h >= 18
UNION ALL SELECT plan_id, 'candidate', 'ring', id || ' has coordinates outside the image' FROM n JOIN p USING (plan_id) WHERE f = 6 AND 10 + h >= 18 AND found
UNION ALL SELECT plan_id, 'candidate', 'ring', 'X' || k || ' has coordinates outside the image' FROM n JOIN p USING (plan_id) WHERE f = 6 AND 10 + h >= 18 AND extra
UNION ALL SELECT plan_id, 'reference', 'duplicate space ID', 'R2' FROM n JOIN p USING (plan_id) WHERE f = 7 AND p.k = 6 AND rooms > 2""")
def plan_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Of eight plans one is sound and seven are broken in a way of their own."""
    fault = c("plan_id") % 8
    swap = lambda column, fixes: F.coalesce(*[F.when(fault == k, F.replace(column, F.lit(a), F.lit(b))) for k, (a, b) in fixes.items()], c(column)).alias(column)
    docs = plan_documents(spark, sf).select(
        "plan_id", swap("reference", {4: ('"image_width_px":200', '"image_width_px":0'), 5: ('"rooms":[', '"rooms":"none","was":['), 6: ('"image_height_px":60', '"image_height_px":18'), 7: ('"connector_id":"C6"', '"connector_id":"R2"')}),
        swap("candidate", {1: ('"coordinate_reference":"image pixels"', '"coordinate_reference":"metres"'), 2: ('"type":"FeatureCollection"', '"type":"Features"'), 3: ('"room_id":"R1"', '"room_id":"R0"')}),
    )
    return spaces.violations(docs)


#: Vectors as points of ten surfaces, three of four near one plane each.
SURFACES = "p AS (SELECT label, vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, CASE WHEN vec_id % 4 > 0 THEN 0.3 * embedding[1]::DOUBLE - 0.2 * embedding[2]::DOUBLE + 0.05 * embedding[3]::DOUBLE ELSE embedding[3]::DOUBLE END AS z FROM embeddings)"


def fitted(source: str) -> str:
    """DuckDB steps that fit the plane of each label's rows of `source`, ending in `fit` (label, n, normal, distance, rms)."""
    return f"""
m AS (SELECT label, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, y) AS yy, covar_pop(y, z) AS yz, covar_pop(z, z) AS zz FROM {source} GROUP BY 1),
q AS (SELECT *, (xx + yy + zz) / 3 AS q FROM m), p2 AS (SELECT *, sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * (xy * xy + yz * yz + xz * xz)) / 6) AS p FROM q),
l AS (SELECT *, q + 2 * p * cos(acos(least(1, greatest(-1, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p * p * p)))) / 3 + 2 * pi() / 3) AS v FROM p2),
x3 AS (SELECT *, unnest([[xy * yz - xz * (yy - v), xz * xy - (xx - v) * yz, (xx - v) * (yy - v) - xy * xy], [xy * (zz - v) - xz * yz, xz * xz - (xx - v) * (zz - v), (xx - v) * yz - xy * xz], [(yy - v) * (zz - v) - yz * yz, yz * xz - xy * (zz - v), xy * yz - (yy - v) * xz]]) AS u FROM l),
u AS (SELECT label, n, mx, my, mz, v, arg_max(u, u[1] ** 2 + u[2] ** 2 + u[3] ** 2) AS u FROM x3 GROUP BY ALL),
s AS (SELECT *, CASE WHEN abs(u[1]) >= abs(u[2]) AND abs(u[1]) >= abs(u[3]) THEN sign(u[1]) WHEN abs(u[2]) >= abs(u[3]) THEN sign(u[2]) ELSE sign(u[3]) END / sqrt(u[1] ** 2 + u[2] ** 2 + u[3] ** 2) AS t FROM u),
fit AS (SELECT label, n, u[1] * t AS a, u[2] * t AS b, u[3] * t AS c, (u[1] * mx + u[2] * my + u[3] * mz) * t AS distance, sqrt(greatest(0, v)) AS rms FROM s)"""


FIGURES = ", ".join(f"round({x}, 6) AS {x}" for x in ("a", "b", "c", "distance", "rms"))


def surfaces(spark: SparkSession, sf: str) -> DataFrame:
    e = lambda k: c("embedding")[k].cast("double")
    z = F.when(c("vec_id") % 4 > 0, 0.3 * e(0) - 0.2 * e(1) + 0.05 * e(2)).otherwise(e(2))
    return table(spark, sf, "embeddings").select("label", "vec_id", e(0).alias("x"), e(1).alias("y"), z.alias("z"))


def figures(planes: DataFrame, *more: str) -> DataFrame:
    at = [F.round(c("normal")[k], 6).alias(name) for k, name in enumerate("abc")]
    return planes.select("label", "n", *more, *at, F.round("distance", 6).alias("distance"), F.round("rms", 6).alias("rms"))


@register("plane_fit", f"WITH {SURFACES}, {fitted('p')} SELECT label, n, {FIGURES} FROM fit")
def plane_fit(spark: SparkSession, sf: str) -> DataFrame:
    return figures(planes.fit(surfaces(spark, sf), "label"))


@register("plane_consensus", f"""WITH {SURFACES}, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS at, count(*) OVER (PARTITION BY label) AS total FROM p),
h0 AS (SELECT label, total, h, (h * 3 + 1) * 48271 % 2147483647 * 69621 % 2147483647 % total AS i, (h * 3 + 2) * 48271 % 2147483647 * 69621 % 2147483647 % (total - 1) AS j, (h * 3 + 3) * 48271 % 2147483647 * 69621 % 2147483647 % (total - 2) AS k FROM (SELECT DISTINCT label, total FROM o WHERE total >= 3), range(0, 100) t(h)),
h1 AS (SELECT label, h, i, (i + 1 + j) % total AS j, k FROM h0), h2 AS (SELECT label, h, i, j, k + (k >= least(i, j))::INT AS k, greatest(i, j) AS hi FROM h1), h AS (SELECT label, h, i, j, k + (k >= hi)::INT AS k FROM h2),
e AS (SELECT h.label, h, a.x AS ox, a.y AS oy, a.z AS oz, b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz, d.x - a.x AS vx, d.y - a.y AS vy, d.z - a.z AS vz FROM h JOIN o a ON a.label = h.label AND a.at = i JOIN o b ON b.label = h.label AND b.at = j JOIN o d ON d.label = h.label AND d.at = k),
n0 AS (SELECT label, h, ox, oy, oz, uy * vz - uz * vy AS nx, uz * vx - ux * vz AS ny, ux * vy - uy * vx AS nz FROM e), n1 AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS size FROM n0), n2 AS (SELECT label, h, ox, oy, oz, nx / size AS nx, ny / size AS ny, nz / size AS nz FROM n1 WHERE size > 0),
g AS (SELECT o.label, vec_id, x, y, z, h FROM o JOIN n2 USING (label) WHERE abs((x - ox) * nx + (y - oy) * ny + (z - oz) * nz) < 0.05),
w AS (SELECT label, h, n_inliers FROM (SELECT label, h, count(*) AS n_inliers FROM g GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY label ORDER BY n_inliers DESC, h) = 1),
r AS (SELECT g.* FROM g JOIN w USING (label, h)), {fitted('r')} SELECT label, n, h::INT AS hypothesis, {FIGURES} FROM fit JOIN w USING (label) WHERE n_inliers >= 3""")
def plane_consensus(spark: SparkSession, sf: str) -> DataFrame:
    """The plane that most of a label's points lie on, of 100 seeded hypotheses."""
    return figures(planes.consensus(surfaces(spark, sf), "label", "vec_id")[0], "hypothesis")
