"""The whole benchmark report and the manifest rules, on tables derived from the driver's."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import manifest, readiness
from plumbline.plans import benchmark_report
from plumbline.plans.catalog import register
from plumbline.session import table

c = F.col


def named(prefix: str, column: str | Column) -> Column:
    return F.concat(F.lit(prefix), (c(column) if isinstance(column, str) else column).cast("string"))


def benchmark(spark: SparkSession, sf: str) -> benchmark_report.Tables:
    """Each nation has a room in every house of 250 suppliers; suppliers are its walls and openings, customers its runs."""
    house = F.floor(c("s_suppkey") / 250)
    houses = F.broadcast(table(spark, sf, "supplier").agg(F.count_distinct(house).alias("_houses")))  # one row
    nation = table(spark, sf, "nation").crossJoin(houses).withColumn("house", F.explode(F.sequence(F.lit(0).cast("long"), c("_houses") - 1))).select("n_nationkey", "house", F.concat("n_name", F.lit("/"), c("house").cast("string")).alias("room_id"), "n_regionkey")
    rooms = nation.select("room_id", "house", F.when(c("n_regionkey") < 4, 2.4 + c("n_nationkey") * 0.01).alias("ceiling_height_m"), (10.0 + c("n_nationkey")).alias("floor_area_m2"), "n_nationkey")
    s = table(spark, sf, "supplier").select(c("s_suppkey").alias("s"), c("s_nationkey").alias("n_nationkey"), house.alias("house")).join(nation, ["n_nationkey", "house"]).select("s", "room_id", (3.0 + (c("s") % 40) / F.lit(10.0)).alias("length_m"), (0.8 + (c("s") % 5) / F.lit(10.0)).alias("width_m"))
    holes = s.where("s % 3 = 0")
    runs_of = table(spark, sf, "customer").crossJoin(houses)
    customer = runs_of.select(c("c_custkey").alias("run_idx"), c("c_nationkey").alias("n_nationkey"), F.abs(c("c_acctbal")).alias("_b"), (c("c_custkey") % c("_houses")).alias("house")).join(rooms, ["n_nationkey", "house"])
    k = c("run_idx") % 3
    runs = customer.select(
        "run_idx", F.when(k == 0, "photo").when(k == 1, "video").otherwise("lidar").alias("tier"), named("c", c("run_idx") % 7).alias("capture_id"), "room_id",
        F.when(c("run_idx") % 4 == 0, named("g", c("run_idx") % 40)).alias("repeat_group"), F.when(c("run_idx") % 11 > 0, c("_b") / 5).alias("runtime_s"), "ceiling_height_m",
    )
    both, open_ = runs.select("run_idx", "room_id").join(s, "room_id"), runs.select("run_idx", "room_id").join(holes, "room_id")
    m = c("run_idx") + c("s")
    walls_seen, holes_seen = both.where(m % 5 > 0), open_.where(m % 4 > 0)
    value = c("length_m") * (1 + ((c("run_idx") * 7 + c("s")) % 21 - 10 + 0.3) / 100)
    wide = c("width_m") + (m % 7 - 3 + 0.3) / 100
    status = F.when(m % 9 == 0, "failed").otherwise("complete").alias("status")
    half = lambda v, by: F.when(m % 2 == 0, v + by)
    none = F.lit(None).cast("double")
    predictions = walls_seen.select("run_idx", named("p", "s").alias("object_id"), status, value.alias("value"), half(value, -0.1).alias("lower"), half(value, 0.1).alias("upper"))
    predictions = predictions.unionByName(holes_seen.select("run_idx", named("q", "s").alias("object_id"), status, wide.alias("value"), none.alias("lower"), none.alias("upper")))
    predictions = predictions.unionByName(runs.select("run_idx", F.lit("ceiling").alias("object_id"), F.lit("partial").alias("status"), (F.coalesce("ceiling_height_m", F.lit(2.5)) + (c("run_idx") % 5 - 2 + 0.3) / 100).alias("value"), none.alias("lower"), none.alias("upper")))
    plan = 500.0 * (1 + (c("run_idx") % 21 - 10 + 0.3) / 100)
    stitched = runs.where("tier <> 'lidar'").select("run_idx", F.when(c("run_idx") % 8 == 0, "partial").otherwise("complete").alias("plan_status"), F.lit("complete").alias("status"), plan.alias("value"), (plan * 0.95).alias("lower"), (plan * 1.05).alias("upper"), F.when(c("run_idx") % 13 == 0, 1).otherwise(0).alias("n_overlaps"))
    photo = runs.where("tier = 'photo'")
    edge = lambda a, b: F.struct(F.lit(a).alias("room_a"), F.lit(b).alias("room_b"))
    drawn = photo.select("run_idx", F.explode(F.when(c("run_idx") % 10 > 0, F.array(edge("pA", "B"), edge("C", "B"), edge("B", "pA"))).otherwise(F.array(edge("pA", "B")))).alias("e")).select("run_idx", "e.*")
    return benchmark_report.Tables(
        rooms=rooms.drop("n_nationkey", "house"), walls=s.select("room_id", named("w", "s").alias("wall_id"), "length_m"), openings=holes.select("room_id", named("o", "s").alias("opening_id"), "width_m"), runs=runs.drop("ceiling_height_m"),
        wall_matches=walls_seen.select("run_idx", named("w", "s").alias("truth_id"), named("p", "s").alias("prediction_id"), F.lit(0).alias("ordinal")), opening_matches=holes_seen.select("run_idx", named("o", "s").alias("truth_id"), named("q", "s").alias("prediction_id"), F.lit(0).alias("ordinal")),
        predictions=predictions, phantoms=runs.where("run_idx % 6 = 0").select("run_idx", F.lit("x").alias("prediction_id")), footprint=spark.createDataFrame([(500.0,)], "footprint_m2 double"),
        adjacency=spark.createDataFrame([("A", "B"), ("B", "C")], "room_a string, room_b string"), stitched=stitched, stitched_adjacency=drawn, room_matches=photo.select("run_idx", F.lit("A").alias("truth_id"), F.lit("pA").alias("prediction_id")),
        incumbent=s.select("room_id", named("c", c("s") % 7).alias("capture_id"), F.lit("wall_length_m").alias("metric"), named("w", "s").alias("object_id"), (c("length_m") * 1.05).alias("value")),
        registration=photo.select("run_idx", F.lit(23).alias("input_photos"), (c("run_idx") % 24).alias("registered_photos")),
    )


ROWS = """
k AS (SELECT DISTINCT s_suppkey // 250 AS house FROM supplier),
r AS (SELECT n_nationkey, house, n_name || '/' || house AS room_id, CASE WHEN n_regionkey < 4 THEN 2.4::DOUBLE + n_nationkey * 0.01::DOUBLE END AS ceil FROM nation, k),
s AS (SELECT s_suppkey AS s, room_id, 3.0::DOUBLE + (s_suppkey % 40) / 10.0::DOUBLE AS len, 0.8::DOUBLE + (s_suppkey % 5) / 10.0::DOUBLE AS wid FROM supplier JOIN r ON n_nationkey = s_nationkey AND house = s_suppkey // 250),
u AS (SELECT c_custkey AS run, CASE c_custkey % 3 WHEN 0 THEN 'photo' WHEN 1 THEN 'video' ELSE 'lidar' END AS tier, 'c' || (c_custkey % 7) AS cap, room_id, ceil, CASE WHEN c_custkey % 4 = 0 THEN 'g' || (c_custkey % 40) END AS grp,
  CASE WHEN c_custkey % 11 > 0 THEN abs(c_acctbal)::DOUBLE / 5 END AS t FROM customer JOIN r ON n_nationkey = c_nationkey AND house = c_custkey % (SELECT count(*) FROM k)),
w AS (SELECT u.*, s.s, len AS truth, CASE WHEN (run + s.s) % 5 > 0 AND (run + s.s) % 9 > 0 THEN len * (1 + ((run * 7 + s.s) % 21 - 10 + 0.3::DOUBLE) / 100) END AS p, CASE WHEN (run + s.s) % 5 > 0 AND (run + s.s) % 2 = 0 THEN len * (1 + ((run * 7 + s.s) % 21 - 10 + 0.3::DOUBLE) / 100) END AS mid FROM u JOIN s USING (room_id)),
w2 AS (SELECT *, abs(p - truth) / abs(truth) AS rel, truth >= mid + (-0.1::DOUBLE) AND truth <= mid + 0.1::DOUBLE AS inside FROM w),
o AS (SELECT tier, run, abs(CASE WHEN (run + s.s) % 4 > 0 AND (run + s.s) % 9 > 0 THEN wid + ((run + s.s) % 7 - 3 + 0.3::DOUBLE) / 100 END - wid) <= 0.02 AS ok FROM u JOIN s USING (room_id) WHERE s.s % 3 = 0),
h AS (SELECT tier, grp, ceil + (run % 5 - 2 + 0.3::DOUBLE) / 100 AS p, abs(ceil + (run % 5 - 2 + 0.3::DOUBLE) / 100 - ceil) <= 0.015 AS ok FROM u WHERE ceil IS NOT NULL),
f AS (SELECT *, abs(p - 500) / 500 AS rel, 500 >= p * 0.95::DOUBLE AND 500 <= p * 1.05::DOUBLE AS inside FROM (SELECT *, 500.0::DOUBLE * (1 + (run % 21 - 10 + 0.3::DOUBLE) / 100) AS p FROM u WHERE tier <> 'lidar'))"""


@register("benchmark_gates", f"""WITH {ROWS},
ph AS (SELECT tier, count(*) AS n FROM u WHERE run % 6 = 0 GROUP BY 1),
g1 AS (SELECT tier || '_opening_detection_and_width' AS gate, coalesce(n, 0) + coalesce(x, 0) AS n, coalesce(k, 0) AS n_pass, coalesce(k, 0) / nullif(coalesce(n, 0) + coalesce(x, 0), 0) AS value, coalesce(k, 0) / nullif(coalesce(n, 0) + coalesce(x, 0), 0) >= 0.85 AS passed
  FROM (SELECT DISTINCT tier FROM u) LEFT JOIN (SELECT tier, count(*) AS n, count(*) FILTER (ok) AS k FROM o GROUP BY 1) USING (tier) LEFT JOIN (SELECT tier, n AS x FROM ph) USING (tier)),
g2 AS (SELECT tier || '_ceiling_height', count(*), count(*) FILTER (ok), NULL::DOUBLE, bool_and(coalesce(ok, false)) FROM h GROUP BY tier),
g3 AS (SELECT d.tier || '_wall_lengths', count(w2.run), count(*) FILTER (rel <= lim), NULL::DOUBLE, bool_and(coalesce(rel <= lim, false)) FILTER (w2.run IS NOT NULL) FROM (VALUES ('photo', 0.08::DOUBLE), ('video', 0.03)) d(tier, lim) LEFT JOIN w2 ON w2.tier = d.tier GROUP BY d.tier),
rc AS (SELECT tier, coalesce(max(p) - min(p) <= 0.01, false) AS ok FROM h WHERE grp IS NOT NULL GROUP BY tier, grp HAVING count(*) >= 2),
wa AS (SELECT tier, grp, count(DISTINCT run) AS runs FROM w WHERE grp IS NOT NULL GROUP BY 1, 2),
rw AS (SELECT tier, coalesce(CASE WHEN count(p) >= 2 THEN max(p) - min(p) END <= greatest(0.01, max(truth) * 0.005), false) AS ok FROM w JOIN wa USING (tier, grp) GROUP BY tier, grp, s HAVING count(*) >= 2 AND count(DISTINCT run) = max(runs)),
g4 AS (SELECT tier || '_repeatability', count(*), count(*) FILTER (ok), NULL::DOUBLE, bool_and(ok) FROM (SELECT * FROM rc UNION ALL SELECT * FROM rw) GROUP BY tier),
g5 AS (SELECT 'photo_whole_property_stitch', count(*), count(*) FILTER (ok), (SELECT round(avg(round((run % 24) / 23.0::DOUBLE * 100, 3)), 3) FROM u WHERE tier = 'photo'), bool_and(ok) FROM (SELECT rel <= 0.08 AND inside AND run % 10 > 0 AND run % 13 > 0 AND run % 8 > 0 AS ok FROM f WHERE tier = 'photo')),
g6 AS (SELECT 'video_whole_property_footprint', count(*), count(*) FILTER (rel <= 0.03), NULL::DOUBLE, bool_and(rel <= 0.03) FROM f WHERE tier = 'video' HAVING count(*) > 0),
li AS (SELECT room_id, cap, s, arg_max(p, run) AS p, arg_max(truth, run) AS truth, max(run) AS run FROM (SELECT *, p IS NULL AS np FROM w2 WHERE tier = 'lidar') GROUP BY 1, 2, 3),
lp AS (SELECT li.room_id, w2.truth, abs(w2.p - w2.truth) AS a, abs(w2.truth * 1.05::DOUBLE - w2.truth) AS b FROM s JOIN li ON li.room_id = s.room_id AND li.s = s.s AND li.cap = 'c' || (s.s % 7) JOIN w2 ON w2.run = li.run AND w2.s = li.s),
g7 AS (SELECT 'lidar_incumbent_comparison', count(a), count(*) FILTER (abs(a - b) <= greatest(1e-6, truth * 1e-6) OR a < b), count(*) FILTER (abs(a - b) <= greatest(1e-6, truth * 1e-6) OR a < b) / nullif(count(a), 0),
  CASE WHEN count(a) > 0 THEN count(*) FILTER (abs(a - b) <= greatest(1e-6, truth * 1e-6) OR a < b) / count(a) >= 0.7 AND count(DISTINCT room_id) FILTER (a IS NOT NULL) >= 2 END FROM lp),
g8 AS (SELECT 'single_command_runtime_under_15_minutes', count(*), count(*) FILTER (t <= 900), count(t)::DOUBLE, CASE WHEN count(*) = count(t) THEN bool_and(t <= 900) END FROM u)
SELECT gate, n, n_pass, round(value, 6) AS value, passed FROM (SELECT * FROM g1 UNION ALL SELECT * FROM g2 UNION ALL SELECT * FROM g3 UNION ALL SELECT * FROM g4 UNION ALL SELECT * FROM g5 UNION ALL SELECT * FROM g6 UNION ALL SELECT * FROM g7 UNION ALL SELECT * FROM g8)""")
def benchmark_gates(spark: SparkSession, sf: str) -> DataFrame:
    return benchmark_report.gates(benchmark(spark, sf)).withColumn("value", F.round("value", 6))


@register("benchmark_calibration", f"""WITH {ROWS}, m AS (SELECT tier, 'wall_length_m' AS metric, inside FROM w2 UNION ALL SELECT tier, 'opening_width_m', NULL FROM o UNION ALL SELECT tier, 'ceiling_height_m', NULL FROM h UNION ALL SELECT tier, 'floor_area_m2', NULL FROM u
  UNION ALL SELECT tier, 'whole_property_footprint_m2', inside FROM f UNION ALL SELECT tier, 'stitched_footprint_m2', inside FROM f WHERE tier = 'photo')
SELECT tier, metric, count(*) AS n_samples, count(inside) AS n_interval, count(*) - count(inside) AS n_missing, round(avg(inside::INT), 6) AS coverage FROM m GROUP BY 1, 2""")
def benchmark_calibration(spark: SparkSession, sf: str) -> DataFrame:
    return benchmark_report.calibration(benchmark(spark, sf)).withColumn("coverage", F.round("coverage", 6))


@register("manifest_violations", """
WITH x AS (SELECT 'wall_size' AS rule, n_name || '/w' || s_suppkey AS key, 'must be a positive number' AS message FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 10 = 0
UNION ALL SELECT 'run_tier', c_custkey::VARCHAR, 'must be one of photo, video, lidar' FROM customer WHERE c_custkey % 5 > 2
UNION ALL SELECT DISTINCT 'run_room', 'R' || (c_custkey % 100), 'refers to nothing' FROM customer WHERE c_custkey % 100 = 7
UNION ALL SELECT 'run_result', c_custkey::VARCHAR, 'was not found' FROM customer WHERE c_custkey % 50 = 1
UNION ALL SELECT 'side_match_index', o_custkey::VARCHAR, 'must be a nonnegative integer' FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 20 = 0 AND c_nationkey IN (SELECT s_nationkey FROM supplier)
UNION ALL SELECT DISTINCT 'side_match_wall', n_name || '/none', 'must be a wall of its room' FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderkey % 20 = 1 AND c_nationkey IN (SELECT s_nationkey FROM supplier)
UNION ALL SELECT DISTINCT 'incumbent_capture', n_name || '/none', 'must be a lidar run of the room' FROM nation
UNION ALL SELECT 'damage_id', (p_partkey % 900)::VARCHAR, 'must be unique' FROM part GROUP BY p_partkey % 900 HAVING count(*) > 1
UNION ALL SELECT 'damage_extent', (p_partkey % 900)::VARCHAR, 'must be a positive number' FROM part WHERE p_size % 25 = 0)
SELECT rule, key, message FROM x""")
def manifest_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as rooms, suppliers as walls, customers as runs, orders as matched sides of rooms that have walls, parts as damage."""
    nation = table(spark, sf, "nation").select("n_nationkey", c("n_name").alias("room_id"))
    none = F.lit(None).cast("double")
    rooms = nation.select("room_id", F.lit(2.5).alias("ceiling_height_m"), none.alias("floor_area_m2"))
    walls = table(spark, sf, "supplier").join(nation, c("s_nationkey") == c("n_nationkey")).select("room_id", named("w", "s_suppkey").alias("wall_id"), (c("s_suppkey") % 10).cast("double").alias("length_m"))
    customer = table(spark, sf, "customer").join(nation, c("c_nationkey") == c("n_nationkey"))
    k = c("c_custkey") % 5
    runs = customer.select(
        c("c_custkey").alias("run_idx"), F.when(k == 0, "photo").when(k == 1, "video").when(k == 2, "lidar").otherwise("other").alias("tier"), F.when(c("c_custkey") % 100 == 7, named("R", c("c_custkey") % 100)).otherwise(c("room_id")).alias("room_id"),
        F.lit("some").alias("capture_id"), F.lit("r.json").alias("result_json"), (c("c_custkey") % 50 != 1).alias("result_found"),
    )
    orders = table(spark, sf, "orders").join(customer.select(c("c_custkey").alias("o_custkey"), "room_id"), "o_custkey").join(walls.groupBy("room_id").agg(F.min("wall_id").alias("wall")), "room_id")
    sides = orders.select(c("o_custkey").alias("run_idx"), c("room_id").alias("ground_truth_room_id"), F.when(c("o_orderkey") % 20 == 1, "none").otherwise(c("wall")).alias("ground_truth_wall_id"), F.lit("h").alias("prediction_candidate_id"), F.when(c("o_orderkey") % 20 == 0, -1).otherwise(1).alias("candidate_side_index"))
    damage = table(spark, sf, "part").select((c("p_partkey") % 900).cast("string").alias("example_id"), F.lit("NATION_0").alias("room_id"), F.lit("crack").alias("damage_class"), F.lit("s").alias("surface_id"), (c("p_size") % 25).cast("double").alias("extent_m2"))
    return manifest.benchmark(manifest.Manifest(
        rooms=rooms, walls=walls, openings=walls.select("room_id", c("wall_id").alias("opening_id"), F.lit(1.0).alias("width_m")), runs=runs, wall_matches=runs.select("run_idx", F.lit("w").alias("ground_truth_wall_id"), F.lit("p").alias("prediction_surface_id")),
        opening_matches=runs.select("run_idx", F.lit("o").alias("ground_truth_opening_id")), document=spark.createDataFrame([("b", 10.0)], "benchmark_id string, footprint_m2 double"), side_matches=sides,
        incumbent_rooms=rooms.withColumn("capture_id", F.lit("none")), damage=damage,
    ))


@register("benchmark_readiness", """
WITH s AS (SELECT s_suppkey % 20 AS room, s_suppkey // 20 AS b, s_suppkey AS k FROM supplier), r AS (SELECT b, room, k FROM s WHERE room < 5),
g AS (SELECT b, count(*) FILTER (room < 4) >= 3 AND count(*) FILTER (room = 4) > 0 AS p, count(*) FILTER (room < 4) AS n FROM r GROUP BY 1),
m AS (SELECT b, count(*) FILTER (k % 7 > 0 AND k % 11 > 0) AS n, count(*) FILTER (k % 7 > 0 AND k % 11 > 0) = count(*) AND b % 3 > 0 AND count(*) FILTER (k % 2 = 0) > 0 AS p FROM r GROUP BY 1),
t AS (SELECT b, count(*) FILTER (k % 13 > 0) AS n, bool_and(k % 13 > 0) AS p FROM r GROUP BY 1),
x AS (SELECT b, count(*) FILTER (k % 3 = 0) AS n, count(*) FILTER (k % 3 = 0) > 0 AS p FROM r GROUP BY 1),
d AS (SELECT b, count(*) AS n, count(*) >= 2 AND count(DISTINCT k % 3) >= 2 AND bool_and(k % 17 > 0) AS p FROM s WHERE room >= 5 AND room < 8 GROUP BY 1),
c AS (SELECT b, 'room_set' AS "check", n, p FROM g UNION ALL SELECT b, 'measured_ground_truth', n, p FROM m UNION ALL SELECT b, 'same_rooms_all_tiers', n, p FROM t UNION ALL SELECT b, 'repeat_capture', n, p FROM x UNION ALL SELECT b, 'staged_damage', n, p FROM d),
a AS (SELECT q.b, n.c AS "check", coalesce(c.n, 0) AS n, coalesce(c.p, false) AS p FROM (SELECT DISTINCT b FROM s) q CROSS JOIN (SELECT unnest(['room_set', 'measured_ground_truth', 'same_rooms_all_tiers', 'repeat_capture', 'staged_damage']) AS c) n LEFT JOIN c ON c.b = q.b AND c."check" = n.c)
SELECT b AS benchmark_id, "check", n, p AS passed FROM a UNION ALL SELECT b, 'ready', count(*) FILTER (p), bool_and(p) FROM a GROUP BY 1""")
def benchmark_readiness(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty suppliers a benchmark: five rooms, one of them a hall, and three staged damages."""
    k = c("s_suppkey")
    s = table(spark, sf, "supplier").select(F.floor(k / 20).alias("benchmark_id"), (k % 20).alias("room_id"), k.alias("k"))
    rooms = s.where("room_id < 5").select("benchmark_id", "room_id", "k", F.when(c("k") % 7 > 0, 2.5).alias("ceiling_height_m"), F.lit(10.0).alias("floor_area_m2"))
    walls = rooms.select("benchmark_id", "room_id", F.explode(F.array(F.lit(3.0), F.when(c("k") % 11 > 0, 2.0))).alias("length_m"))
    tiers = F.when(c("k") % 13 > 0, F.array(*map(F.lit, readiness.TIERS))).otherwise(F.array(F.lit("photo"), F.lit("lidar"), F.lit("other")))
    runs = rooms.select("benchmark_id", "room_id", "k", F.explode(tiers).alias("tier")).select("benchmark_id", "room_id", "tier", F.when(c("tier") == "photo", F.when(c("k") % 3 == 0, "again").otherwise("")).alias("repeat_group"), F.explode(F.sequence(F.lit(1), F.when((c("tier") == "photo"), 2).otherwise(1))).alias("take")).drop("take")
    damage = s.where("room_id BETWEEN 5 AND 7").select("benchmark_id", c("k").alias("example_id"), named("class ", c("k") % 3).alias("damage_class"), F.when(c("k") % 17 > 0, "wall").otherwise(" ").alias("surface_id"), F.lit(0.2).alias("extent_m2"))
    corner = lambda x, y: F.array(F.lit(float(x)), F.lit(float(y)))
    regions = damage.select("benchmark_id", "example_id", F.lit("a.jpg").alias("image_path"), F.array(corner(0, 0), corner(4, 0), corner(4, 4)).alias("polygon_px"))
    whole = s.select("benchmark_id").distinct().where("benchmark_id % 3 > 0")
    return readiness.checks(s, rooms, rooms.where("room_id = 4"), walls, rooms.where("k % 2 = 0"), whole.withColumn("room_a", F.lit(1)), whole.withColumn("footprint_m2", F.lit(50.0)), runs, damage, regions)


@register("candidate_areas", f"WITH {ROWS} SELECT run, abs(10.0::DOUBLE + run % 7 - (10.0::DOUBLE + n_nationkey)) AS absolute_error FROM u JOIN r USING (room_id) WHERE tier = 'photo'")
def candidate_areas(spark: SparkSession, sf: str) -> DataFrame:
    """A hypothesis for the room of each photo run, of an area that its number decides."""
    t = benchmark(spark, sf)
    photo = t.runs.where("tier = 'photo'")
    found = photo.select("run_idx", F.lit("h").alias("candidate_id"), (10.0 + c("run_idx") % 7).alias("area_m2"))
    got = benchmark_report.candidate_areas(replace(t, hypotheses=found, hypothesis_matches=photo.select("run_idx", "room_id", F.lit("h").alias("candidate_id"))))
    return got.select(c("run_idx").alias("run"), "absolute_error")


@register("candidate_walls", f"WITH {ROWS} SELECT run, 'w' || s AS wall_id, round(abs([3.0::DOUBLE, 4.5::DOUBLE, 5.0::DOUBLE][s % 3 + 1] - len), 9) AS absolute_error FROM u JOIN s USING (room_id) WHERE tier = 'photo'")
def candidate_walls(spark: SparkSession, sf: str) -> DataFrame:
    """The sides of each photo run's hypothesis against the walls of its room."""
    t = benchmark(spark, sf)
    photo = t.runs.where("tier = 'photo'")
    found = photo.select("run_idx", F.lit("h").alias("candidate_id"), F.lit(0.0).alias("area_m2"), F.array(*map(F.lit, (3.0, 4.5, 5.0))).alias("side_lengths_m"))
    sides = photo.join(t.walls, "room_id").select("run_idx", "room_id", "wall_id", F.lit("h").alias("candidate_id"), (F.substring("wall_id", 2, 9).cast("int") % 3).alias("side_index"))
    got = benchmark_report.candidate_walls(replace(t, hypotheses=found, side_matches=sides))
    return got.select(c("run_idx").alias("run"), "wall_id", F.round("absolute_error", 9).alias("absolute_error"))
