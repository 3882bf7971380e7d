"""Time, position, grid, polygon and graph operators on the driver's tables or small fixed shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import asof, audit, graph, keyed, neighbours, pointcloud, polygon, scoring, stats, validate, walls
from plumbline.plans.catalog import register
from plumbline.session import table
from plumbline.sources import geojson

TOLERANCE = 21_600.0


def seconds(column: str = "ts") -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})") / 1e6


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", seconds().alias("t"), "user_id", "event_type", "value")


def stream(e: DataFrame, kind: str) -> DataFrame:
    return e.where(F.col("event_type") == kind).select(F.col("event_id").alias("id"), F.col("t").alias("ts"), "user_id")


E = "e AS (SELECT event_id, epoch_us(ts) / 1e6 AS t, user_id, event_type, value FROM events)"


def nearest_sql(name: str, kind: str, by: bool = True) -> str:
    on = "b.user_id = a.user_id AND " if by else ""
    return f"""{name} AS (SELECT a.event_id, a.t, arg_min(b.event_id, (abs(b.t - a.t), b.t, b.event_id)) AS id, min(abs(b.t - a.t)) AS o
 FROM e a JOIN e b ON {on}b.event_type = '{kind}' AND abs(b.t - a.t) <= {TOLERANCE} WHERE a.event_type = 'purchase' GROUP BY 1, 2)"""


def purchases(e: DataFrame) -> DataFrame:
    return e.where("event_type = 'purchase'")


def nearest_view(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    return asof.nearest(purchases(e), stream(e, "view"), "event_id", "t", "id", "ts", TOLERANCE, ["user_id"])


@register("nearest_asof_tol", f"WITH {E}, {nearest_sql('n', 'view')} SELECT event_id, id, round(o, 6) AS \"offset\" FROM n")
def nearest_asof_tol(spark: SparkSession, sf: str) -> DataFrame:
    return nearest_view(spark, sf).select("event_id", "id", F.round("offset", 6).alias("offset"))


@register("nearest_asof_multi", f"""WITH {E}, {nearest_sql('v', 'view', False)}, {nearest_sql('c', 'click', False)}, {nearest_sql('s', 'signup', False)}
SELECT event_id, v.id AS view_id, c.id AS click_id, s.id AS signup_id FROM v JOIN c USING (event_id) JOIN s USING (event_id)""")
def nearest_asof_multi(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    got = asof.nearest_streams(purchases(e), {k: stream(e, k) for k in ("view", "click", "signup")}, "event_id", "t", TOLERANCE)
    return got.select("event_id", "view_id", "click_id", "signup_id")


FIRST = "u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t, event_id) AS r FROM n) WHERE r = 1)"


@register("asof_first_use", f"WITH {E}, {nearest_sql('n', 'view', False)}, {FIRST} SELECT event_id, id FROM u")
def asof_first_use(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    got = asof.nearest(purchases(e), stream(e, "view"), "event_id", "t", "id", "ts", TOLERANCE)
    return asof.first_use(got, "id", "t", "event_id").select("event_id", "id")


@register("asof_miss_counts", f"""WITH {E}, {nearest_sql('n', 'view')}, {FIRST}, p AS (SELECT event_id FROM e WHERE event_type = 'purchase')
SELECT count(*) AS n_total, count(u.event_id) AS n_used, count(*) FILTER (n.event_id IS NOT NULL AND u.event_id IS NULL) AS n_duplicate, count(*) FILTER (n.event_id IS NULL) AS n_rejected
FROM p LEFT JOIN n USING (event_id) LEFT JOIN u USING (event_id)""")
def asof_miss_counts(spark: SparkSession, sf: str) -> DataFrame:
    got = nearest_view(spark, sf)
    return asof.outcomes(purchases(events(spark, sf)), got, asof.first_use(got, "id", "t", "event_id"), "event_id")


@register("asof_must_match", f"WITH {E}, {nearest_sql('n', 'purchase')} SELECT event_id, id FROM n")
def asof_must_match(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    got = asof.nearest(purchases(e), stream(e, "purchase"), "event_id", "t", "id", "ts", TOLERANCE, ["user_id"])
    return asof.must_match(purchases(e), got, "event_id").select("event_id", "id")


@register("offset_percentiles", f"WITH {E}, {nearest_sql('n', 'view')} SELECT round(quantile_cont(o, 0.5), 4) AS median, round(quantile_cont(o, 0.95), 4) AS p95, round(max(o), 4) AS most FROM n")
def offset_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    got = stats.percentiles(nearest_view(spark, sf), "offset", {"median": 0.5, "p95": 0.95, "most": 1.0})
    return got.select(*[F.round(c, 4).alias(c) for c in got.columns])


@register("error_stats", """
WITH x AS (SELECT l_returnflag, abs(l_extendedprice / l_quantity - p_retailprice) AS e FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT l_returnflag, count(e) AS n, round(avg(e), 2) AS mean_error, round(quantile_cont(e, 0.5), 2) AS median_error, round(quantile_cont(e, 0.9), 2) AS p90_error,
  round(avg((e <= 100)::INT), 6) AS within_100, round(avg((e <= 500)::INT), 6) AS within_500 FROM x GROUP BY 1""")
def error_stats(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = both.select("l_returnflag", (F.col("l_extendedprice") / F.col("l_quantity") - F.col("p_retailprice")).alias("e"))
    got = stats.error_stats(rows, "e", {"within_100": 100, "within_500": 500}, ["l_returnflag"])
    return got.select("l_returnflag", "n", *[F.round(c, 2).alias(c) for c in ("mean_error", "median_error", "p90_error")], *[F.round(c, 6).alias(c) for c in ("within_100", "within_500")])


@register("bucketed_error", """
WITH b(bucket, low, high) AS (VALUES (0, -10.0::DOUBLE, 0.0::DOUBLE), (1, 0.0, 25.0), (2, 25.0, 50.0), (3, 50.0, 100.0), (4, 100.0, 1000000.0)),
x AS (SELECT value, abs(value - 50) AS e FROM events)
SELECT b.bucket, b.low, b.high, count(x.value) AS n, round(avg(e), 6) AS mean_error, round(quantile_cont(e, 0.5), 6) AS median_error
FROM b LEFT JOIN x ON x.value >= b.low AND (x.value < b.high OR b.bucket = 4 AND x.value = b.high) GROUP BY 1, 2, 3""")
def bucketed_error(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("value", (F.col("value") - 50).alias("e"))
    got = stats.bucketed(rows, "value", "e", [-10, 0, 25, 50, 100, 1e6])
    return got.withColumn("mean_error", F.round("mean_error", 6)).withColumn("median_error", F.round("median_error", 6))


@register("interval_cut", f"""WITH {E}, s(segment, a, b) AS (SELECT n_nationkey, (SELECT min(t) FROM e) + n_nationkey * 50000.0, (SELECT min(t) FROM e) + n_nationkey * 50000.0 + 70000.0 FROM nation)
SELECT event_id, segment FROM e JOIN s ON t >= a AND t < b""")
def interval_cut(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    start = e.agg(F.min("t").alias("t0"))
    s = table(spark, sf, "nation").crossJoin(F.broadcast(start)).select(F.col("n_nationkey").alias("segment"), (F.col("t0") + F.col("n_nationkey") * 50000.0).alias("a"), (F.col("t0") + F.col("n_nationkey") * 50000.0 + 70000.0).alias("b"))  # one row
    return keyed.interval_cut(e, s, "t", "a", "b", 60000.0).select("event_id", "segment")


@register("stride_sample", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS p FROM events) WHERE p % 10 = 0")
def stride_sample(spark: SparkSession, sf: str) -> DataFrame:
    return stats.stride(table(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"], 10).select("event_id")


@register("linspace_sample", """
WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS p, count(*) OVER () AS n FROM events)
SELECT event_id FROM r WHERE p IN (SELECT (i * (n - 1)) // 96 FROM generate_series(0, 96) g(i), (SELECT max(n) AS n FROM r))""")
def linspace_sample(spark: SparkSession, sf: str) -> DataFrame:
    return stats.spaced(table(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"], 97).select("event_id")


@register("capped_frame_sample", """
WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS p, count(*) OVER () AS total FROM events), n AS (SELECT max((total + 7) // 8) AS n FROM r)
SELECT event_id FROM r, n WHERE p % 8 = 0 AND (n <= 60 OR p // 8 IN (SELECT round_even(k * (n - 1) / 59.0, 0)::BIGINT FROM generate_series(0, 59) h(k), n))""")
def capped_frame_sample(spark: SparkSession, sf: str) -> DataFrame:
    return stats.sampled_frames(table(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"], 30.0, 4.0, 60).select("event_id")


@register("effective_rate", f"WITH {E} SELECT user_id, count(t) AS n, round(max(t) - min(t), 4) AS covered, round((count(t) - 1) / nullif(max(t) - min(t), 0), 10) AS rate FROM e GROUP BY 1")
def effective_rate(spark: SparkSession, sf: str) -> DataFrame:
    got = stats.effective_rate(events(spark, sf), "t", ["user_id"])
    return got.select("user_id", "n", F.round("covered", 4).alias("covered"), F.round("rate", 10).alias("rate"))


@register("value_counts", "SELECT user_id, count(*) FILTER (event_type = 'view') AS n_view, count(DISTINCT event_type) AS n_kinds FROM events GROUP BY 1")
def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    got = stats.value_counts(table(spark, sf, "events"), "event_type", ["user_id"])
    return got.select("user_id", F.coalesce(F.try_element_at("counts", F.lit("view")), F.lit(0)).alias("n_view"), F.size("counts").cast("long").alias("n_kinds"))


@register("histogram_mode", """
WITH b AS (SELECT min(value) AS m, quantile_cont(value, 0.1) AS q FROM events), x AS (SELECT floor((value - (m - 0.5)) / 1.0)::BIGINT AS bin, m FROM events, b WHERE value <= q)
SELECT bin, n, round(m + bin, 6) AS level FROM (SELECT bin, m, count(*) AS n FROM x GROUP BY 1, 2) ORDER BY n DESC, bin LIMIT 1""")
def histogram_mode(spark: SparkSession, sf: str) -> DataFrame:
    return stats.low_mode(table(spark, sf, "events"), "value", 1.0).withColumn("level", F.round("level", 6))


@register("trimmed_extent", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.02), 4) AS low, round(quantile_cont(l_extendedprice, 0.98), 4) AS high, round(quantile_cont(l_extendedprice, 0.98) - quantile_cont(l_extendedprice, 0.02), 4) AS extent FROM lineitem GROUP BY 1")
def trimmed_extent(spark: SparkSession, sf: str) -> DataFrame:
    got = stats.extent(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return got.select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("low", "high", "extent")])


def cloud(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("point_idx"), "label", *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")])


P = "p AS (SELECT vec_id AS point_idx, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"


@register("voxel_first", f"WITH {P} SELECT point_idx FROM (SELECT point_idx, row_number() OVER (PARTITION BY floor(x / 0.1), floor(y / 0.1), floor(z / 0.1) ORDER BY point_idx) AS r FROM p) WHERE r = 1")
def voxel_first(spark: SparkSession, sf: str) -> DataFrame:
    return pointcloud.voxel_first(cloud(spark, sf), ("x", "y", "z"), 0.1, "point_idx").select("point_idx")


GRID = "m AS (SELECT min(x) AS x0, min(y) AS y0 FROM p), c AS (SELECT floor((x - x0) / 0.03)::BIGINT AS cx, floor((y - y0) / 0.03)::BIGINT AS cy, count(*) AS n FROM p, m GROUP BY 1, 2 HAVING count(*) >= 3)"


@register("grid_occupancy", f"WITH {P}, {GRID} SELECT cx, cy, n FROM c")
def grid_occupancy(spark: SparkSession, sf: str) -> DataFrame:
    return pointcloud.occupancy(cloud(spark, sf), "x", "y", 0.03)


OFF = "o(i) AS (VALUES (-1), (0), (1))"


@register("grid_close", f"WITH {P}, {GRID}, {OFF}, d AS (SELECT DISTINCT cx + a.i AS cx, cy + b.i AS cy FROM c, o a, o b) SELECT cx + a.i AS cx, cy + b.i AS cy FROM d, o a, o b GROUP BY 1, 2 HAVING count(*) = 9")
def grid_close(spark: SparkSession, sf: str) -> DataFrame:
    return graph.close_cells(pointcloud.occupancy(cloud(spark, sf), "x", "y", 0.03))


@register("grid_components", f"""WITH RECURSIVE {P}, {GRID}, q AS (SELECT cx, cy, row_number() OVER (ORDER BY cx, cy) AS id FROM c),
r AS (SELECT id, id AS root FROM q UNION SELECT b.id, r.root FROM r JOIN q a ON a.id = r.id JOIN q b ON abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1)
SELECT cx, cy, root FROM (SELECT id, min(root) AS root FROM r GROUP BY 1) JOIN q USING (id)""")
def grid_components(spark: SparkSession, sf: str) -> DataFrame:
    cells = pointcloud.occupancy(cloud(spark, sf), "x", "y", 0.03)
    named = keyed.numbered(cells, ["cx", "cy"], name="id").select("cx", "cy", "id")
    got = graph.cell_components(cells)
    roots = named.select(F.struct("cx", "cy").alias("component"), F.col("id").alias("root"))
    return got.join(roots, "component").select("cx", "cy", "root")


@register("rigid_transform", f"""WITH {P} SELECT point_idx, round(0.36 * x + 0.48 * y + 0.8 * z + 1, 9) AS x, round(-0.8 * x + 0.6 * y + 2, 9) AS y, round(-0.48 * x - 0.64 * y + 0.6 * z + 3, 9) AS z
FROM (SELECT point_idx, x, -y AS y, -z AS z FROM p)""")
def rigid_transform(spark: SparkSession, sf: str) -> DataFrame:
    pose = spark.createDataFrame([("f", [0.36, 0.48, 0.8, -0.8, 0.6, 0.0, -0.48, -0.64, 0.6], 1.0, 2.0, 3.0)], "frame_id string, rotation array<double>, tx double, ty double, tz double")
    got = pointcloud.to_world(cloud(spark, sf).withColumn("frame_id", F.lit("f")), F.broadcast(pose))
    return got.select("point_idx", *[F.round(c, 9).alias(c) for c in "xyz"])


@register("back_project", f"""WITH {P} SELECT point_idx, round((point_idx % 192 - 96.0) * (1.5 + z) / 150.0, 9) AS x, round((point_idx % 144 - 72.0) * (1.5 + z) / 140.0, 9) AS y FROM p""")
def back_project(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    pixels = cloud(spark, sf).select("point_idx", F.lit("f").alias("frame_id"), (c("point_idx") % 192).alias("u"), (c("point_idx") % 144).alias("v"), (1.5 + c("z")).alias("z"), F.lit(192).alias("raster_width"), F.lit(144).alias("raster_height"))
    cameras = spark.createDataFrame([("f", 1500.0, 1400.0, 960.0, 720.0, None, None)], "frame_id string, fx double, fy double, cx double, cy double, width double, height double")
    return pointcloud.back_project(pixels, F.broadcast(cameras)).select("point_idx", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@register("quaternion_rotation", "SELECT vec_id, round(1 - 2 * (y * y + z * z) / n, 9) AS r00, round(2 * (x * y - z * w) / n, 9) AS r01, round(2 * (y * z + x * w) / n, 9) AS r21 FROM (SELECT vec_id, x, y, z, w, x * x + y * y + z * z + w * w AS n FROM (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS w FROM embeddings))")
def quaternion_rotation(spark: SparkSession, sf: str) -> DataFrame:
    q = [F.col("embedding")[k].cast("double") for k in range(4)]
    rows = table(spark, sf, "embeddings").select("vec_id", pointcloud.rotation_from_quaternion(*q).alias("r"))
    return rows.select("vec_id", F.round(F.col("r")[0], 9).alias("r00"), F.round(F.col("r")[1], 9).alias("r01"), F.round(F.col("r")[7], 9).alias("r21"))


@register("depth_validity", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND (l_returnflag = 'N' OR l_discount > 0.05)")
def depth_validity(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 10).alias("z"), F.when(F.col("l_discount") > 0.05, 1).otherwise(0).alias("c"), F.when(F.col("l_returnflag") == "N", "bundle").otherwise("scan").alias("s"))
    return rows.where(pointcloud.valid_depth("z", "c", "s")).select("l_orderkey", "l_linenumber")


@register("pose_summary", f"""WITH {P} SELECT l.label, count(p.x) AS n, round(avg(x), 9) AS mean_x, round(max(x) - min(x), 9) AS span_x, round(avg(z), 9) AS mean_z
FROM (SELECT i AS label FROM generate_series(0, 15) g(i)) l LEFT JOIN p ON p.label = l.label GROUP BY 1""")
def pose_summary(spark: SparkSession, sf: str) -> DataFrame:
    rooms = spark.range(16).select(F.col("id").alias("label"))
    got = pointcloud.pose_summary(rooms, cloud(spark, sf), "label")
    return got.select("label", "n", *[F.round(c, 9).alias(c) for c in ("mean_x", "span_x", "mean_z")])


@register("band_pairs", "SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND abs(a.p_retailprice - b.p_retailprice) <= 0.5")
def band_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return keyed.band_pairs(table(spark, sf, "part"), "p_partkey", "p_retailprice", 0.5)


@register("knn2_ratio", """
WITH d AS (SELECT a.vec_id AS q, b.vec_id AS r, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) AS s FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s, r) AS n FROM d)
SELECT a.q AS query, a.r AS match, sqrt(a.s) < 0.95 * sqrt(b.s) AS distinct_match FROM k a JOIN k b ON a.q = b.q AND a.n = 1 AND b.n = 2""")
def knn2_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """The two nearest of each query vector; a match counts if it is clearly nearer than the next. The queries are a stated set."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    got = neighbours.two_nearest(vectors, vectors.where("id % 50 = 0"))
    return got.where("next_distance IS NOT NULL").select("query", "match", (F.col("distance") < 0.95 * F.col("next_distance")).alias("distinct_match"))


# --- shapes on a lattice, one for each part ----------------------------------------------

#: Kinds by p_size % 3: rectangle, ell, crossed quadrilateral; their neighbours on the lattice overlap or touch.
Q = """q AS (SELECT 'P' || p_partkey AS name, 'c' || (p_partkey // 40) AS plan, (p_partkey % 40) * 5.0::DOUBLE AS ox, (p_partkey // 40) * 5.0::DOUBLE AS oy, p_size % 5 + 2.0::DOUBLE AS w, p_size % 4 + 2.0::DOUBLE AS h, p_size % 3 AS k FROM part),
u AS (SELECT name, plan, k, ox, oy, w, h, CASE k WHEN 0 THEN [[ox, oy], [ox + w, oy], [ox + w, oy + h], [ox, oy + h]]
  WHEN 1 THEN [[ox, oy], [ox + w, oy], [ox + w, oy + 1], [ox + 1, oy + 1], [ox + 1, oy + h], [ox, oy + h]] ELSE [[ox, oy], [ox + w, oy + h], [ox + w, oy], [ox, oy + h]] END AS vs FROM q),
v AS (SELECT name, plan, i, vs[i + 1][1] AS x, vs[i + 1][2] AS y FROM (SELECT name, plan, vs, unnest(range(len(vs))) AS i FROM u))"""
S = Q + """, n AS (SELECT name, count(*) AS n FROM v GROUP BY 1),
s AS (SELECT a.name, a.plan, a.i, n.n, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, c.x AS x2, c.y AS y2 FROM v a JOIN n USING (name) JOIN v b ON b.name = a.name AND b.i = (a.i + 1) % n JOIN v c ON c.name = a.name AND c.i = (a.i + 2) % n)"""
B = "b AS (SELECT name, min(x0) AS a, max(x0) AS c, min(y0) AS d, max(y0) AS e FROM s GROUP BY 1), bp AS (SELECT p.name AS a, q.name AS b FROM b p JOIN b q ON p.name < q.name AND p.c > q.a AND q.c > p.a AND p.e > q.d AND q.e > p.d)"


def shapes(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    rows = table(spark, sf, "part").select(
        F.concat(F.lit("P"), c("p_partkey").cast("string")).alias("name"), F.concat(F.lit("c"), F.floor(c("p_partkey") / 40).cast("string")).alias("plan"), (c("p_partkey") % 40 * 5.0).alias("x"), (F.floor(c("p_partkey") / 40) * 5.0).alias("y"),
        (c("p_size") % 5 + 2.0).alias("w"), (c("p_size") % 4 + 2.0).alias("h"), (c("p_size") % 3).alias("k"), "p_partkey",
    )
    at = lambda dx, dy: F.array(c("x") + dx, c("y") + dy)
    w, h, zero, one = c("w"), c("h"), F.lit(0.0), F.lit(1.0)
    box = F.array(at(zero, zero), at(w, zero), at(w, h), at(zero, h))
    ell = F.array(at(zero, zero), at(w, zero), at(w, one), at(one, one), at(one, h), at(zero, h))
    bow = F.array(at(zero, zero), at(w, h), at(w, zero), at(zero, h))
    return rows.select("name", "plan", "k", "p_partkey", F.when(c("k") == 0, box).when(c("k") == 1, ell).otherwise(bow).alias("vertices")).withColumn("ring", polygon.ring("vertices"))


@register("polygon_area", f"WITH {S} SELECT name, abs(sum(x0 * y1 - x1 * y0)) / 2 AS area, round(sum(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))), 9) AS perimeter FROM s GROUP BY 1")
def polygon_area(spark: SparkSession, sf: str) -> DataFrame:
    return shapes(spark, sf).select("name", polygon.area(F.col("ring")).alias("area"), F.round(polygon.perimeter(F.col("ring")), 9).alias("perimeter"))


@register("polygon_angles", f"""WITH {S} SELECT name, round(min(a), 6) AS least, round(max(a), 6) AS most FROM (SELECT name, degrees(acos(greatest(-1, least(1,
  ((x0 - x1) * (x2 - x1) + (y0 - y1) * (y2 - y1)) / (sqrt((x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1)) * sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))))))) AS a FROM s) GROUP BY 1""")
def polygon_angles(spark: SparkSession, sf: str) -> DataFrame:
    a = polygon.angles(F.col("ring"))
    return shapes(spark, sf).select("name", F.round(F.array_min(a), 6).alias("least"), F.round(F.array_max(a), 6).alias("most"))


@register("polygon_shape", f"""WITH {S}, t AS (SELECT name, bool_and(z >= 0) OR bool_and(z <= 0) AS convex FROM (SELECT name, (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) AS z FROM s) GROUP BY 1),
p AS (SELECT a.name, (a.x1 - a.x0) * (b.y0 - a.y0) - (a.y1 - a.y0) * (b.x0 - a.x0) AS o1, (a.x1 - a.x0) * (b.y1 - a.y0) - (a.y1 - a.y0) * (b.x1 - a.x0) AS o2,
  (b.x1 - b.x0) * (a.y0 - b.y0) - (b.y1 - b.y0) * (a.x0 - b.x0) AS o3, (b.x1 - b.x0) * (a.y1 - b.y0) - (b.y1 - b.y0) * (a.x1 - b.x0) AS o4 FROM s a JOIN s b ON a.name = b.name AND b.i > a.i + 1 AND NOT (a.i = 0 AND b.i = a.n - 1)),
x AS (SELECT DISTINCT name FROM p WHERE o1 * o2 < -1e-8 AND o3 * o4 < -1e-8)
SELECT t.name, x.name IS NULL AS simple, convex FROM t LEFT JOIN x ON x.name = t.name""")
def polygon_shape(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("ring")
    return shapes(spark, sf).select("name", polygon.is_simple(r).alias("simple"), polygon.is_convex(r).alias("convex"))


ELL = [[10.0, 0.0], [14.0, 0.0], [14.0, 2.0], [12.0, 2.0], [12.0, 4.0], [10.0, 4.0]]


@register("point_in_polygon", f"WITH {P} SELECT point_idx FROM p WHERE (10 * x + 12 BETWEEN 10 AND 14 AND 10 * y + 1 BETWEEN 0 AND 2) OR (10 * x + 12 BETWEEN 10 AND 12 AND 10 * y + 1 BETWEEN 2 AND 4)")
def point_in_polygon(spark: SparkSession, sf: str) -> DataFrame:
    ring = polygon.ring(F.array(*[F.array(*map(F.lit, p)) for p in ELL]))
    return cloud(spark, sf).where(polygon.holds(ring, 10 * F.col("x") + 12, 10 * F.col("y") + 1)).select("point_idx")


@register("aabb_overlap", f"WITH {S}, {B} SELECT a, b FROM bp")
def aabb_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return polygon.box_pairs(shapes(spark, sf), "name", "ring", 2.0)


@register("edge_overlap", f"""WITH {S}, {B}, e AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS l FROM s),
m AS (SELECT bp.a, bp.b, p.l, q.l AS m, (p.x1 - p.x0) / p.l AS ux, (p.y1 - p.y0) / p.l AS uy, q.x0 - p.x0 AS cx, q.y0 - p.y0 AS cy, q.x1 - p.x0 AS dx, q.y1 - p.y0 AS dy FROM bp JOIN e p ON p.name = bp.a JOIN e q ON q.name = bp.b WHERE p.l >= 0.25 AND q.l >= 0.25),
o AS (SELECT a, b, max(greatest(0, least(l, greatest(ux * cx + uy * cy, ux * dx + uy * dy)) - greatest(0, least(ux * cx + uy * cy, ux * dx + uy * dy)))) AS shared FROM m
  WHERE abs(ux * (dy - cy) - uy * (dx - cx)) / m <= 0.05 AND greatest(abs(ux * cy - uy * cx), abs(ux * dy - uy * dx)) <= 0.15 GROUP BY 1, 2)
SELECT bp.a, bp.b, round(coalesce(shared, 0), 9) AS shared FROM bp LEFT JOIN o USING (a, b)""")
def edge_overlap(spark: SparkSession, sf: str) -> DataFrame:
    rows = shapes(spark, sf)
    got = polygon.shared_edges(polygon.sides(rows, "name", "ring"), polygon.box_pairs(rows, "name", "ring", 2.0), "name")
    return got.select("a", "b", F.round("shared", 9).alias("shared"))


@register("segment_crossings", f"""WITH {S}, x AS (SELECT p.name || '/' || p.i AS i, q.name || '/' || q.i AS j, p.x0, p.y0, p.x1 - p.x0 AS rx, p.y1 - p.y0 AS ry, q.x1 - q.x0 AS sx, q.y1 - q.y0 AS sy, q.x0 - p.x0 AS dx, q.y0 - p.y0 AS dy FROM (SELECT *, unnest([-1, 0, 1]) AS d FROM s) p JOIN s q ON 'c' || (substr(p.plan, 2)::INT + p.d) = q.plan AND p.name || '/' || p.i < q.name || '/' || q.i),
m AS (SELECT *, (dx * sy - dy * sx) / (rx * sy - ry * sx) AS t, (dx * ry - dy * rx) / (rx * sy - ry * sx) AS u FROM x WHERE abs(rx * sy - ry * sx) >= 1e-7)
SELECT i, j, round(x0 + least(1, greatest(0, t)) * rx, 6) AS x, round(y0 + least(1, greatest(0, t)) * ry, 6) AS y FROM m WHERE t BETWEEN -1e-6 AND 1 + 1e-6 AND u BETWEEN -1e-6 AND 1 + 1e-6""")
def segment_crossings(spark: SparkSession, sf: str) -> DataFrame:
    """Sides of all shapes of the lattice as one capture."""
    sides = polygon.sides(shapes(spark, sf), "name", "ring")
    got = graph.crossings(sides.select(F.lit("c").alias("capture_id"), F.concat("name", F.lit("/"), F.col("side_index").cast("string")).alias("ordinal"), "x0", "y0", "x1", "y1"))
    return got.select("i", "j", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@register("raster_overlap", f"""WITH {Q}, px AS (SELECT DISTINCT name, ox + i AS x, oy + j AS y FROM q, generate_series(0, 6) a(i), generate_series(0, 5) b(j) WHERE k < 2 AND i <= w AND j <= h AND (k = 0 OR i <= 1 OR j <= 1))
SELECT p.name AS a, q.name AS b, count(*)::INT AS n FROM px p JOIN px q ON p.x = q.x AND p.y = q.y AND p.name < q.name GROUP BY 1, 2""")
def raster_overlap(spark: SparkSession, sf: str) -> DataFrame:
    runs = polygon.disjoint_runs(polygon.raster(shapes(spark, sf).where("k < 2"), "name", "ring"), "name")
    return polygon.run_pairs(runs, "name").select("a", "b", F.col("pixels").cast("int").alias("n"))


NEXT = "SELECT DISTINCT least(s_suppkey, s_suppkey % 10 + 1) AS a, greatest(s_suppkey, s_suppkey % 10 + 1) AS b FROM supplier WHERE s_suppkey <> s_suppkey % 10 + 1 UNION SELECT DISTINCT least(s_suppkey % 10 + 1, s_suppkey * 3 % 10 + 1), greatest(s_suppkey % 10 + 1, s_suppkey * 3 % 10 + 1) FROM supplier WHERE s_suppkey % 10 <> s_suppkey * 3 % 10"


@register("short_cycles", f"""WITH RECURSIVE e AS (SELECT a * 1000000 + b AS id, a, b FROM ({NEXT})), d AS (SELECT id, a, b FROM e UNION ALL SELECT id, b, a FROM e),
w AS (SELECT a AS s, b AS at, [a, b] AS nodes, [id] AS used FROM d WHERE b > a UNION ALL SELECT s, d.b, nodes || [d.b], used || [id] FROM w JOIN d ON d.a = w.at WHERE d.b > s AND NOT list_contains(nodes, d.b) AND NOT list_contains(used, id) AND len(used) < 4)
SELECT DISTINCT array_to_string(list_sort(used || [id]), ',') AS edges FROM w JOIN d ON d.a = w.at AND d.b = w.s WHERE len(used) >= 2 AND NOT list_contains(used, id)""")
def short_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers tied to ten hubs and the hubs to each other: cycles of five edges at most."""
    c = F.col
    s = table(spark, sf, "supplier").select(c("s_suppkey").alias("k"), (c("s_suppkey") % 10 + 1).alias("hub"), (c("s_suppkey") * 3 % 10 + 1).alias("other"))
    ties = s.select(c("k").alias("u"), c("hub").alias("v")).unionByName(s.select(c("hub").alias("u"), c("other").alias("v")))
    edges = keyed.undirected(ties, "u", "v").withColumn("edge_id", c("a") * 1_000_000 + c("b"))
    return graph.short_cycles(edges, 5).select(F.array_join(F.transform("edges", lambda e: e.cast("string")), ",").alias("edges"))


@register("graph_components", """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, l_suppkey * 7 % 100 + 1 AS b FROM lineitem), d AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e),
r AS (SELECT a AS node, a AS root FROM d UNION SELECT d.b, r.root FROM r JOIN d ON d.a = r.node) SELECT node, min(root) AS root FROM r WHERE node IN (SELECT a FROM e WHERE a <> b UNION SELECT b FROM e WHERE a <> b) GROUP BY 1""")
def graph_components(spark: SparkSession, sf: str) -> DataFrame:
    return graph.components(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_suppkey") * 7 % 100 + 1).alias("b")).distinct())


@register("opening_class", """SELECT p_partkey, CASE WHEN w BETWEEN 0.5 AND 1.8 AND h >= 1.6 AND b <= 0.25 THEN 'possible_doorway' WHEN w BETWEEN 0.3 AND 2.5 AND h BETWEEN 0.35 AND 2.2 AND b >= 0.45 THEN 'possible_window_or_wall_void' ELSE 'unclassified_wall_void' END AS class
FROM (SELECT p_partkey, p_size / 20.0 AS w, (p_partkey % 25) / 10.0 AS h, (p_partkey % 7) / 10.0 AS b FROM part)""")
def opening_class(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return table(spark, sf, "part").select("p_partkey", walls.opening_class(c("p_size") / 20.0, (c("p_partkey") % 25) / 10.0, (c("p_partkey") % 7) / 10.0).alias("class"))


@register("top_gaps", "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 10")
def top_gaps(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return scoring.best_first(rows, ["l_suppkey"], [F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 10).drop("l_extendedprice")


@register("plan_counts", "SELECT coalesce(CASE WHEN p_size % 4 > 0 THEN p_type END, 'room') AS space_kind, count(*) AS n FROM part GROUP BY 1")
def plan_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.when(F.col("p_size") % 4 > 0, F.col("p_type")).alias("space_kind"), F.array(F.col("p_size").cast("double"), F.lit(None)).alias("dimensions_m"))
    return audit.plan_counts(rows).select("space_kind", "n")


@register("segment_rules", "SELECT 'segment' AS rule, n_name AS key, 'must have a positive length' AS message FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 'segment', n_name, 'must end inside the recording' FROM nation WHERE n_nationkey > 20 UNION ALL SELECT 'segment_id', n_name, 'must be a simple name' FROM nation WHERE NOT regexp_matches(n_name, '^[A-Za-z0-9_-]+$')")
def segment_rules(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    rows = table(spark, sf, "nation").select("n_name", c("n_nationkey").cast("double").alias("a"), (c("n_nationkey") + c("n_regionkey")).cast("double").alias("b"), c("n_nationkey"))
    rows = rows.withColumn("b", F.when(c("n_nationkey") > 20, 1000.0).when(c("b") == c("a"), c("a")).otherwise(F.least(c("b"), F.lit(30.0))))
    return validate.segments(rows, "n_name", "a", "b", F.lit(100.0))


# --- order-dependent operators: no SQL form, held to unit tests ---------------------------


@register("snap_greedy")
def snap_greedy(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors as one capture, on a lattice that grows with the table; tests hold it against one scan."""
    c = F.col
    at = cloud(spark, sf).select(F.lit("c").alias("capture_id"), c("point_idx").alias("ordinal"), (c("point_idx") % 500 * 0.5 + c("x")).alias("x"), (F.floor(c("point_idx") / 500) * 0.5 + c("y")).alias("y"))
    return graph.snap(at, 0.2)


@register("clip_greedy")
def clip_greedy(spark: SparkSession, sf: str) -> DataFrame:
    """All parts as rooms of one property; tests hold it against one scan."""
    rows = shapes(spark, sf).select(F.lit("p").alias("property_id"), F.col("p_partkey").alias("ordinal"), F.col("name").alias("candidate_id"), "vertices")
    return polygon.stitch(rows)


def box_points(spark: SparkSession) -> DataFrame:
    """Returns of a 4 by 3 by 2.5 m room: floor and four walls on a regular grid."""
    g = spark.range(0, 40_000)
    u, v, face = (F.col("id") % 100) / 99.0, (F.floor(F.col("id") / 100) % 80) / 79.0, F.floor(F.col("id") / 8000)
    x = F.when(face == 0, u * 4).when(face == 1, 0.0).when(face == 2, 4.0).otherwise(u * 4)
    y = F.when(face == 0, v * 3).when((face == 1) | (face == 2), u * 3).when(face == 3, 0.0).otherwise(3.0)
    z = F.when(face == 0, 0.0).otherwise(v * 2.5)
    return g.select(F.lit("c").alias("capture_id"), F.col("id").alias("point_idx"), x.alias("x"), y.alias("y"), z.alias("z"))


@register("ransac_planes")
def ransac_planes(spark: SparkSession, sf: str) -> DataFrame:
    """A box for each region, as wide as its key says."""
    regions = table(spark, sf, "region").select(F.col("r_name").alias("capture_id"), (1 + F.col("r_regionkey") / 10.0).alias("_s"))
    points = box_points(spark).drop("capture_id").crossJoin(F.broadcast(regions)).withColumn("x", F.col("x") * F.col("_s")).drop("_s")  # five rows
    got = walls.wall_planes(walls.prepare(points, "z", 0.0), "z", 0.0)
    return got.select("capture_id", "candidate_id", "point_count", "length_m", "height_m")


#: Walls of one room a part, by p_partkey % 4: a wall that ends a metre early, a wall with a doorway, whole, divided.
R = "r AS (SELECT 'c' || p_partkey AS capture_id, p_partkey % 4 AS k, p_size % 5 + 3.0 AS w, p_size % 4 + 2.0 AS h, (p_partkey % 3) * 0.05 AS e FROM part)"


def room_walls(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    rows = table(spark, sf, "part").select(F.concat(F.lit("c"), c("p_partkey").cast("string")).alias("capture_id"), (c("p_partkey") % 4).alias("k"), (c("p_size") % 5 + 3.0).alias("w"), (c("p_size") % 4 + 2.0).alias("h"), (c("p_partkey") % 3 * 0.05).alias("e"))
    none, half = F.lit(0.0), c("w") / 2
    span = lambda n, x0, y0, x1, y1: F.struct(F.lit(n).alias("ordinal"), F.lit(f"w{n}").alias("candidate_id"), *[v.cast("double").alias(name) for v, name in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))])
    first = F.when(c("k") == 1, F.array(span(1, none, none, F.lit(0.7), none), span(5, F.lit(1.6), none, c("w"), none))).otherwise(F.array(span(1, none, none, c("w"), c("e"))))
    rest = F.array(span(2, c("w"), none, c("w"), c("h")), span(3, c("w"), c("h"), none, c("h")), span(4, none, c("h"), none, F.when(c("k") == 0, 1.0).otherwise(0.0)))
    divider = F.when(c("k") == 3, F.array(span(6, half, none, half, c("h")))).otherwise(F.array().cast("array<struct<ordinal:int,candidate_id:string,x0:double,y0:double,x1:double,y1:double>>"))
    return rows.select("capture_id", F.explode(F.concat(first, rest, divider)).alias("s")).select("capture_id", "s.*")


@register("faces", f"""WITH {R}, f AS (SELECT capture_id, w * h - w * e / 2 AS area FROM r WHERE k IN (2, 3) UNION ALL SELECT capture_id, w * h / 2 - w * e / 8 FROM r WHERE k = 3 UNION ALL SELECT capture_id, w * h / 2 - 3 * w * e / 8 FROM r WHERE k = 3)
SELECT capture_id, round(area, 6) AS area_m2 FROM f WHERE area BETWEEN 0.5 AND 60""")
def faces(spark: SparkSession, sf: str) -> DataFrame:
    spans = room_walls(spark, sf)
    outline = spans.groupBy("capture_id").agg(F.max("x0").alias("w"), F.max("y0").alias("h")).select("capture_id", F.array(*[F.array(x, y) for x, y in ((F.lit(-0.5), F.lit(-0.5)), (F.col("w") + 0.5, F.lit(-0.5)), (F.col("w") + 0.5, F.col("h") + 0.5), (F.lit(-0.5), F.col("h") + 0.5))]).alias("ring"))
    return walls.boundary_faces(spans, outline).select("capture_id", F.round("area_m2", 6).alias("area_m2"))


@register("boundary_cycles", f"WITH {R} SELECT capture_id, round(w * h - w * e / 2, 6) AS area_m2 FROM r WHERE k IN (2, 3) AND w * h - w * e / 2 >= 1")
def boundary_cycles(spark: SparkSession, sf: str) -> DataFrame:
    return walls.boundary_cycles(room_walls(spark, sf)).select("capture_id", F.round("area_m2", 6).alias("area_m2"))


@register("gap_reviews", f"""WITH {R} SELECT capture_id, 'boundary_gap_1' AS candidate_id, CASE k WHEN 0 THEN 'unclassified_open_boundary_gap' ELSE 'possible_doorway_or_wall_gap' END AS candidate_class,
  CASE k WHEN 0 THEN 1.0 ELSE 0.9 END::DOUBLE AS gap_m, CASE k WHEN 0 THEN round(degrees(acos(e / sqrt(w * w + e * e))), 2) ELSE 0.0 END::DOUBLE AS direction_difference_degrees FROM r WHERE k IN (0, 1)""")
def gap_reviews(spark: SparkSession, sf: str) -> DataFrame:
    spans = room_walls(spark, sf).where("candidate_id <> 'w6'")  # outer walls
    got = walls.gap_reviews(walls.endpoint_gaps(spans), spans)
    return got.select("capture_id", "candidate_id", "candidate_class", F.round("gap_m", 6).alias("gap_m"), "direction_difference_degrees")


@register("geometry_review", f"""WITH {R}, w AS (SELECT capture_id, k, unnest(CASE k WHEN 1 THEN [1, 5, 2, 3, 4] WHEN 3 THEN [1, 2, 3, 4, 6] ELSE [1, 2, 3, 4] END) AS n FROM r),
f AS (SELECT capture_id, 0 AS kind, 0 AS o, 'observed_floor_coverage' AS feature_type, NULL AS candidate_id, 'Polygon' AS shape, NULL AS said FROM r WHERE k <> 2
  UNION ALL SELECT capture_id, 1, n, 'wall_plane_candidate', 'w' || n, 'LineString', CASE WHEN n % 2 = 0 THEN 'near' ELSE 'unavailable' END FROM w
  UNION ALL SELECT capture_id, 2, 1, 'boundary_face_hypothesis', 'face_1', 'Polygon', NULL FROM r
  UNION ALL SELECT capture_id, 3, 1, 'unclassified_boundary_gap', CASE k WHEN 1 THEN 'second' ELSE 'boundary_gap_1' END, 'LineString', CASE k WHEN 1 THEN 'seen' ELSE 'Not classified as an opening.' END FROM r WHERE k IN (0, 1))
SELECT capture_id, row_number() OVER (PARTITION BY capture_id ORDER BY kind, o) - 1 AS pos, feature_type, candidate_id, shape, said FROM f""")
def geometry_review(spark: SparkSession, sf: str) -> DataFrame:
    """The review document of each room, taken apart again: four kinds in their order, reviews found by their pair of walls."""
    c = F.col
    spans = room_walls(spark, sf)
    captures = table(spark, sf, "part").select(F.concat(F.lit("c"), c("p_partkey").cast("string")).alias("capture_id"), (c("p_partkey") % 4).alias("k"), (c("p_size") % 5 + 3.0).alias("w"), (c("p_size") % 4 + 2.0).alias("h"))
    zero = F.lit(0.0)
    ring = F.array(F.array(zero, zero), F.array(c("w"), zero), F.array(c("w"), c("h")), F.array(zero, c("h")))
    outlines = captures.select("capture_id", F.when(c("k") != 2, ring).otherwise(F.slice(ring, 1, 3)).alias("vertices"), (c("w") * c("h")).alias("area_m2"))
    walled = spans.select("capture_id", "ordinal", "candidate_id", F.array(F.array("x0", "y0"), F.array("x1", "y1")).alias("endpoints"), F.lit(1.0).alias("length_m"), F.lit(2.0).alias("height_m"))
    aligned = spans.where("ordinal % 2 = 0").select("capture_id", "candidate_id", F.lit("near").alias("status"))
    found = captures.select("capture_id", F.lit(1).alias("ordinal"), F.lit("face_1").alias("hypothesis"), ring.alias("vertices"), (c("w") * c("h")).alias("area_m2"), F.array(F.lit("w1")).alias("walls"))
    open_ = walls.endpoint_gaps(spans.where("candidate_id <> 'w6'"))
    stored = captures.where("k = 1").select("capture_id", F.explode(F.array(*[F.struct(F.lit(n).alias("ordinal"), F.lit(name).alias("candidate_id")) for n, name in enumerate(("first", "second"))])).alias("s")).select("capture_id", "s.*", F.lit("w1").alias("candidate_a"), F.lit("w5").alias("candidate_b"), F.lit(1.5).alias("direction_difference_degrees"), zero.alias("lateral_offset_m"), F.lit("seen").alias("reason"))
    made = geojson.documents(captures, [geojson.gaps(open_, stored), geojson.faces(found), geojson.wall_planes(walled, aligned), geojson.coverage(outlines)])
    each = made.select("capture_id", F.posexplode(F.try_variant_get(F.parse_json("document"), "$.features", "array<variant>")).alias("pos", "f"))
    at = lambda path: F.try_variant_get("f", path, "string")
    return each.select("capture_id", c("pos").cast("long").alias("pos"), at("$.properties.feature_type").alias("feature_type"), at("$.properties.candidate_id").alias("candidate_id"), at("$.geometry.type").alias("shape"), F.coalesce(at("$.properties.floor_alignment"), at("$.properties.review_reason")).alias("said"))
