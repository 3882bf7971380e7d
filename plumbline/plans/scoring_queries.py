"""Scoring, keyed and audit operators on the driver's tables: stand-ins that run the same operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import audit, keyed, nested, scoring, stats, validate
from plumbline.plans.catalog import register
from plumbline.session import table

TIERS = (("A", 0.08), ("N", 0.03), ("R", 0.05))


def tiers(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(TIERS), "tier string, tolerance double"))  # three rows


def unit_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Part prices as truth, the mean unit price of each tier's line items as prediction."""
    part = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    items = table(spark, sf, "lineitem").groupBy(F.col("l_partkey"), F.col("l_returnflag").alias("tier")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("prediction"), F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("low"), F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("high"))
    rows = part.crossJoin(tiers(spark))
    return rows.join(items.withColumnRenamed("l_partkey", "p_partkey"), ["p_partkey", "tier"], "left")


UNIT = """
WITH tiers(tier, tolerance) AS (VALUES ('A', 0.08), ('N', 0.03), ('R', 0.05)),
items AS (SELECT l_partkey, l_returnflag AS tier, avg(l_extendedprice / l_quantity) AS prediction,
                 min(l_extendedprice / l_quantity) AS low, max(l_extendedprice / l_quantity) AS high FROM lineitem GROUP BY 1, 2),
rows AS (SELECT p.p_partkey, p.p_retailprice, t.tier, t.tolerance, i.prediction, i.low, i.high,
                abs(i.prediction - p.p_retailprice) / nullif(abs(p.p_retailprice), 0) AS relative_error
         FROM part p CROSS JOIN tiers t LEFT JOIN items i ON i.l_partkey = p.p_partkey AND i.tier = t.tier)
"""


@register("gate_by_tier", UNIT + """
SELECT tier, count(prediction) AS n_scored, count(*) FILTER (relative_error <= tolerance) AS n_within,
       round(count(*) FILTER (relative_error <= tolerance) / nullif(count(prediction), 0), 6) AS rate,
       bool_and(coalesce(relative_error <= tolerance, false)) AS gate_pass FROM rows GROUP BY tier""")
def gate_by_tier(spark: SparkSession, sf: str) -> DataFrame:
    rows = scoring.metric_rows(unit_prices(spark, sf), "p_retailprice", "prediction", F.col("tolerance").cast("double"))
    got = rows.groupBy("tier").agg(F.count("prediction").alias("n_scored"), F.count_if("gate_pass").alias("n_within"), scoring.strict(F.col("gate_pass")).alias("gate_pass"))
    return got.withColumn("rate", F.round(stats.ratio(F.col("n_within"), F.col("n_scored")), 6))


@register("metric_rows", UNIT + """
SELECT p_partkey, tier, round(abs(prediction - p_retailprice), 4) AS absolute_error, round(relative_error, 6) AS relative_error,
       CASE WHEN low IS NOT NULL AND high IS NOT NULL THEN p_retailprice >= low AND p_retailprice <= high END AS interval_contains_truth,
       relative_error <= tolerance AS gate_pass FROM rows""")
def metric_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = scoring.metric_rows(unit_prices(spark, sf), "p_retailprice", "prediction", F.col("tolerance"), low="low", high="high")
    return rows.select("p_partkey", "tier", F.round("absolute_error", 4).alias("absolute_error"), F.round("relative_error", 6).alias("relative_error"), "interval_contains_truth", "gate_pass")


EMPTY_TIER = UNIT + """
SELECT d.tier, count(r.tier) AS n, count(*) FILTER (r.ok) AS n_pass, bool_and(coalesce(r.ok, false)) FILTER (r.tier IS NOT NULL) AS gate_pass
FROM (VALUES ('A'), ('N'), ('none')) d(tier) LEFT JOIN (SELECT tier, relative_error <= tolerance AS ok FROM rows) r ON r.tier = d.tier GROUP BY 1"""


@register("empty_tier_gate", EMPTY_TIER)
def empty_tier_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = scoring.metric_rows(unit_prices(spark, sf), "p_retailprice", "prediction", F.col("tolerance"))
    return scoring.all_gate(rows, spark.createDataFrame([("A",), ("N",), ("none",)], "tier string"), "tier")


@register("detection_gate", """
WITH found AS (SELECT l_orderkey, sum(l_extendedprice) AS value FROM lineitem WHERE l_discount <= 0.05 GROUP BY 1),
truth AS (SELECT o_orderpriority AS tier, abs(f.value - o_totalprice) / nullif(abs(o_totalprice), 0) <= 0.5 AS ok FROM orders o LEFT JOIN found f ON f.l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'),
phantom AS (SELECT o_orderpriority AS tier FROM found f JOIN orders o ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P'),
t AS (SELECT tier, count(*) AS n_truth, count(*) FILTER (ok) AS n_within FROM truth GROUP BY 1), p AS (SELECT tier, count(*) AS n_phantom FROM phantom GROUP BY 1)
SELECT tier, coalesce(n_truth, 0) AS n_truth, coalesce(n_within, 0) AS n_within, coalesce(n_phantom, 0) AS n_phantom,
  round(coalesce(n_within, 0) / nullif(coalesce(n_truth, 0) + coalesce(n_phantom, 0), 0), 6) AS rate,
  coalesce(n_within, 0) / nullif(coalesce(n_truth, 0) + coalesce(n_phantom, 0), 0) >= 0.85 AS gate_pass FROM t FULL JOIN p USING (tier)""")
def detection_gate(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("tier"), "o_orderstatus", "o_totalprice")
    found = table(spark, sf, "lineitem").where("l_discount <= 0.05").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("value"))
    truth = scoring.metric_rows(orders.where("o_orderstatus <> 'P'").join(found, "o_orderkey", "left"), "o_totalprice", "value", F.lit(0.5))
    phantoms = orders.where("o_orderstatus = 'P'").join(found, "o_orderkey")
    return scoring.detection_gate(truth, phantoms, "tier").withColumn("rate", F.round("rate", 6))


@register("repeat_spread", """
WITH x AS (SELECT l_partkey, CASE WHEN l_discount < 0.1 THEN l_extendedprice / l_quantity END AS p, p_retailprice FROM lineitem JOIN part ON p_partkey = l_partkey),
g AS (SELECT l_partkey, count(*) AS n_samples, count(p) AS n_measured, CASE WHEN count(p) >= 2 THEN max(p) - min(p) END AS spread, greatest(0.01, abs(max(p_retailprice)) * 0.005) AS tolerance FROM x GROUP BY 1)
SELECT *, coalesce(spread <= tolerance, false) AS gate_pass FROM g WHERE n_samples >= 2""")
def repeat_spread(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_partkey", F.when(F.col("l_discount") < 0.1, F.col("l_extendedprice") / F.col("l_quantity")).alias("p"))
    rows = rows.join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey")
    return scoring.repeatability(rows, ["l_partkey"], "p", "p_retailprice")


@register("calibration", UNIT + """
SELECT tier, count(*) AS n_samples, count(c) AS n_interval, count(*) - count(c) AS n_missing, round(avg(c::INT), 6) AS coverage
FROM (SELECT tier, CASE WHEN low IS NOT NULL THEN p_retailprice >= low AND p_retailprice <= high END AS c FROM rows) GROUP BY tier""")
def calibration(spark: SparkSession, sf: str) -> DataFrame:
    rows = scoring.metric_rows(unit_prices(spark, sf), "p_retailprice", "prediction", low="low", high="high")
    return scoring.calibration(rows, ["tier"]).withColumn("coverage", F.round("coverage", 6))


@register("winloss", UNIT + """
, pairs AS (SELECT p_partkey, max(p_retailprice) AS truth, max(prediction) FILTER (tier = 'A') AS ours, max(prediction) FILTER (tier = 'R') AS theirs FROM rows GROUP BY 1),
scored AS (SELECT p.*, p_brand, CASE WHEN ours IS NULL OR theirs IS NULL THEN NULL
   WHEN abs(abs(ours - truth) - abs(theirs - truth)) <= greatest(1e-6, abs(truth) * 1e-6) THEN 'tie' WHEN abs(ours - truth) < abs(theirs - truth) THEN 'win' ELSE 'loss' END AS outcome
   FROM pairs p JOIN part USING (p_partkey))
SELECT count(outcome) AS n_scored, count(*) FILTER (outcome = 'win') AS n_win, count(*) FILTER (outcome = 'tie') AS n_tie, count(*) FILTER (outcome = 'loss') AS n_loss,
  count(*) - count(outcome) AS n_not_comparable, count(DISTINCT p_brand) FILTER (outcome IS NOT NULL) AS n_rooms, round(count(*) FILTER (outcome IN ('win', 'tie')) / nullif(count(outcome), 0), 6) AS win_or_tie_rate,
  CASE WHEN count(outcome) = 0 THEN 'not_scored' WHEN count(DISTINCT p_brand) FILTER (outcome IS NOT NULL) >= 2 THEN 'scored' ELSE 'incomplete' END AS status,
  CASE WHEN count(outcome) > 0 THEN count(*) FILTER (outcome IN ('win', 'tie')) / count(outcome) >= 0.7 AND count(DISTINCT p_brand) FILTER (outcome IS NOT NULL) >= 2 END AS gate_pass FROM scored""")
def winloss(spark: SparkSession, sf: str) -> DataFrame:
    rows = unit_prices(spark, sf).groupBy("p_partkey").agg(F.max("p_retailprice").alias("truth"), F.max(F.when(F.col("tier") == "A", F.col("prediction"))).alias("ours"), F.max(F.when(F.col("tier") == "R", F.col("prediction"))).alias("theirs"))
    rows = rows.join(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_partkey")
    return scoring.comparison_gate(scoring.compare(rows, "truth", "ours", "theirs"), "p_brand").withColumn("win_or_tie_rate", F.round("win_or_tie_rate", 6))


@register("runtime_gate", """
SELECT o_orderpriority AS tier, count(*) AS n_runs, count(r) AS n_measured, CASE WHEN count(*) = count(r) THEN bool_and(r <= 900) END AS gate_pass
FROM (SELECT o_orderpriority, CASE WHEN NOT (o_orderpriority LIKE '1%' AND o_orderstatus = 'P') THEN o_totalprice / 1000 END AS r FROM orders) GROUP BY 1""")
def runtime_gate(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("tier"), F.when(~(F.col("o_orderpriority").startswith("1") & (F.col("o_orderstatus") == "P")), F.col("o_totalprice") / 1000).alias("r"))
    return scoring.runtime_gate(runs, "r", ["tier"])


@register("readiness_division", "SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)")
def readiness_division(spark: SparkSession, sf: str) -> DataFrame:
    return keyed.in_all(table(spark, sf, "orders"), "o_custkey", "o_orderpriority")


@register("common_objects", """
WITH t AS (SELECT l_returnflag AS g, count(DISTINCT l_linestatus) AS a FROM lineitem GROUP BY 1), s AS (SELECT l_returnflag AS g, l_partkey AS o, count(DISTINCT l_linestatus) AS n FROM lineitem GROUP BY 1, 2)
SELECT g AS l_returnflag, o AS l_partkey FROM s JOIN t USING (g) WHERE n = a""")
def common_objects(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.common_objects(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", "l_partkey")


@register("readiness_checks", """
WITH rooms AS (SELECT n_name AS room_id, CASE WHEN n_regionkey = 0 THEN 'connector' ELSE 'room' END AS kind FROM nation),
runs AS (SELECT n_name AS room_id, c_mktsegment AS tier, 'g' AS repeat_group, c_custkey AS capture_id FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT 'rooms' AS "check", count(DISTINCT room_id) FILTER (kind = 'room') >= 3 AS passed FROM rooms
UNION ALL SELECT 'connector', count(*) FILTER (kind = 'connector') > 0 FROM rooms
UNION ALL SELECT 'same_rooms', (SELECT bool_and(coalesce(t = 2, false)) FROM (SELECT room_id FROM rooms WHERE kind = 'room') r LEFT JOIN (SELECT room_id, count(DISTINCT tier) AS t FROM runs WHERE tier IN ('BUILDING', 'MACHINERY') GROUP BY 1) x USING (room_id))
UNION ALL SELECT 'repeats', (SELECT count(*) FILTER (c >= 2) > 0 FROM (SELECT count(DISTINCT capture_id) AS c FROM runs GROUP BY room_id, tier, repeat_group))
UNION ALL SELECT 'damage_classes', count(DISTINCT p_brand) >= 2 FROM part""")
def readiness_checks(spark: SparkSession, sf: str) -> DataFrame:
    rooms = table(spark, sf, "nation").select(F.col("n_name").alias("room_id"), F.when(F.col("n_regionkey") == 0, "connector").otherwise("room").alias("kind"), "n_nationkey")
    runs = table(spark, sf, "customer").join(rooms, F.col("c_nationkey") == F.col("n_nationkey")).select("room_id", F.col("c_mktsegment").alias("tier"), F.lit("g").alias("repeat_group"), F.col("c_custkey").alias("capture_id"))
    return scoring.readiness(rooms, runs, table(spark, sf, "part").select(F.col("p_brand").alias("damage_class")), ["BUILDING", "MACHINERY"])


@register("stitch_gate", UNIT + """
SELECT p_partkey, tier, coalesce(relative_error <= 0.08 AND p_retailprice >= low AND p_retailprice <= high AND p_partkey % 2 = 0 AND p_partkey % 3 = 0 AND tier <> 'R', false) AS gate_pass FROM rows""")
def stitch_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = scoring.metric_rows(unit_prices(spark, sf), "p_retailprice", "prediction", low="low", high="high")
    rows = rows.withColumn("same", F.col("p_partkey") % 2 == 0).withColumn("overlaps", F.col("p_partkey") % 3).withColumn("status", F.when(F.col("tier") == "R", "partial").otherwise("complete"))
    return scoring.stitch_gate(rows, "same", "overlaps", "status", 0.08).select("p_partkey", "tier", "gate_pass")


@register("last_wins", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def last_wins(spark: SparkSession, sf: str) -> DataFrame:
    return keyed.last_wins(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@register("first_wins", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def first_wins(spark: SparkSession, sf: str) -> DataFrame:
    return keyed.first_wins(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@register("two_hop_left", "SELECT o_orderkey, c_custkey, n_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') c ON o_custkey = c_custkey LEFT JOIN (SELECT * FROM nation WHERE n_regionkey > 0) n ON c_nationkey = n_nationkey")
def two_hop_left(spark: SparkSession, sf: str) -> DataFrame:
    c, n = table(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'"), table(spark, sf, "nation").where("n_regionkey > 0")
    return keyed.two_hop(table(spark, sf, "orders"), c, n, "o_custkey", "c_custkey", "c_nationkey", "n_nationkey").select("o_orderkey", "c_custkey", "n_name")


@register("missing_extra", """
WITH a AS (SELECT DISTINCT p_partkey AS id FROM part WHERE p_size > 10), b AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity > 45)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 'matched' WHEN a.id IS NOT NULL THEN 'missing' ELSE 'extra' END AS side FROM a FULL JOIN b ON a.id = b.id""")
def missing_extra(spark: SparkSession, sf: str) -> DataFrame:
    left, right = table(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").alias("k")), table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("k"))
    return keyed.id_differences(left, right, "k")


@register("key_intersection", "SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def key_intersection(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return keyed.intersect_keys([o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))], "k")


@register("rename_default", "SELECT s_suppkey, coalesce(CASE WHEN n_regionkey < 2 THEN n_name END, s_name) AS room FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 2) n ON s_nationkey = n_nationkey")
def rename_default(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").cast("string").alias("nk"))
    names = table(spark, sf, "nation").where("n_regionkey < 2").select(F.col("n_nationkey").cast("string").alias("old"), F.col("n_name").alias("new"))
    return keyed.renamed(s, names, "nk", "old", "new", "_room").select("s_suppkey", F.when(F.col("_room") == F.col("nk"), F.col("s_name")).otherwise(F.col("_room")).alias("room"))


@register("prefix_join", "SELECT o_orderkey, p.name FROM orders JOIN (VALUES ('1', 'urgent'), ('2', 'high'), ('5', 'low')) p(k, name) ON split_part(o_orderpriority, '-', 1) = p.k")
def prefix_join(spark: SparkSession, sf: str) -> DataFrame:
    names = spark.createDataFrame([("1", "urgent"), ("2", "high"), ("5", "low")], "k string, name string")
    return keyed.prefix_of(table(spark, sf, "orders"), names, "o_orderpriority", "k", "-").select("o_orderkey", "name")


EDGES = "SELECT DISTINCT least(a.l_partkey, b.l_partkey) AS a, greatest(a.l_partkey, b.l_partkey) AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey WHERE {}"


@register("edge_set_f1", f"""
WITH p AS ({EDGES.format("a.l_linenumber <= 4 AND b.l_linenumber <= 4")}), t AS ({EDGES.format("a.l_linenumber >= 3 AND b.l_linenumber >= 3")}),
c AS (SELECT (SELECT count(*) FROM p JOIN t USING (a, b)) AS m, (SELECT count(*) FROM p) AS n_p, (SELECT count(*) FROM t) AS n_t)
SELECT m AS n_matched, n_p AS n_predicted, n_t AS n_truth, round(m / n_p, 6) AS precision, round(m / n_t, 6) AS recall, round(2 * (m / n_p) * (m / n_t) / nullif(m / n_p + m / n_t, 0), 6) AS f1 FROM c""")
def edge_set_f1(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem")
    pairs = lambda rows: keyed.cooccurrence(rows, "l_orderkey", "l_partkey")
    got = audit.set_scores(pairs(items.where("l_linenumber <= 4")), pairs(items.where("l_linenumber >= 3")))
    return got.select("n_matched", "n_predicted", "n_truth", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@register("cooccurrence_pairs", EDGES.format("true"))
def cooccurrence_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return keyed.cooccurrence(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey")


@register("undirected_edges", "SELECT DISTINCT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b FROM (SELECT DISTINCT c_nationkey, l_suppkey FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey) JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey")
def undirected_edges(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    pairs = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").join(o, "o_orderkey").select("c_nationkey", "l_suppkey").distinct()
    both = pairs.join(table(spark, sf, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return keyed.undirected(both, "c_nationkey", "s_nationkey")


@register("symmetric_diff", """
WITH a AS (SELECT n_regionkey FROM nation WHERE n_nationkey < 12), b AS (SELECT n_regionkey FROM nation WHERE n_nationkey >= 10)
SELECT n_regionkey, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT n_regionkey, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def symmetric_diff(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    return keyed.symmetric_difference(n.where("n_nationkey < 12").select("n_regionkey"), n.where("n_nationkey >= 10").select("n_regionkey"))


@register("multiset_equal", """
WITH a AS (SELECT n_regionkey AS k FROM nation), b AS (SELECT r_regionkey AS k FROM region)
SELECT NOT EXISTS (SELECT * FROM ((SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT ALL SELECT * FROM a))) AS equal,
  (SELECT max(c) <= 1 FROM (SELECT count(*) AS c FROM a GROUP BY k UNION ALL SELECT count(*) FROM b GROUP BY k)) AS "unique" """)
def multiset_equal(spark: SparkSession, sf: str) -> DataFrame:
    return audit.same_runs(table(spark, sf, "nation").select(F.col("n_regionkey").alias("k")), table(spark, sf, "region").select(F.col("r_regionkey").alias("k")))


@register("set_equal", "SELECT NOT EXISTS (SELECT * FROM ((SELECT n_regionkey FROM nation EXCEPT SELECT r_regionkey FROM region) UNION ALL (SELECT r_regionkey FROM region EXCEPT SELECT n_regionkey FROM nation))) AS equal")
def set_equal(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.same_set(table(spark, sf, "nation").select(F.col("n_regionkey").alias("k")), table(spark, sf, "region").select(F.col("r_regionkey").alias("k")))


@register("argmax_composite", "SELECT o_custkey, o_orderkey AS best_order FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def argmax_composite(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_custkey").agg(stats.arg_first_max("o_orderkey", F.col("o_totalprice"), -F.col("o_orderkey")).alias("best_order"))


@register("evidence_rollup", """
WITH s AS (SELECT s_nationkey, s_suppkey, count(*) AS r, count(DISTINCT l_orderkey) AS p FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE s_nationkey < 20 GROUP BY 1, 2),
m AS (SELECT s_nationkey, count(*) AS n_models, sum(r) AS n_memberships, sum(p) AS sparse_points, arg_max(s_suppkey, (r, p, -s_suppkey)) AS primary_model, max(r) AS largest FROM s GROUP BY 1),
i AS (SELECT s_nationkey, count(DISTINCT l_partkey) AS n_registered FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE s_nationkey < 20 GROUP BY 1)
SELECT n_nationkey AS room, n_nationkey * 100 AS sampled, coalesce(n_models, 0) AS n_models, coalesce(n_memberships, 0)::BIGINT AS n_memberships, coalesce(sparse_points, 0)::BIGINT AS sparse_points, primary_model,
  coalesce(largest, 0) AS largest, coalesce(n_registered, 0) AS n_registered, round(coalesce(largest, 0) / nullif(n_nationkey * 100, 0) * 100, 1) AS coverage_percent, coalesce(largest, 0) >= 3 AS three_or_more
FROM nation LEFT JOIN m ON m.s_nationkey = n_nationkey LEFT JOIN i ON i.s_nationkey = n_nationkey""")
def evidence_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as models of their nation's room; the nations from 20 on have none on purpose."""
    s = table(spark, sf, "supplier").where("s_nationkey < 20").select(F.col("s_nationkey").alias("room"), F.col("s_suppkey").alias("l_suppkey"))
    items = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey").join(s, "l_suppkey")
    models = items.groupBy("room", F.col("l_suppkey").alias("model_id")).agg(F.count(F.lit(1)).alias("registered_images"), F.count_distinct("l_orderkey").alias("sparse_points"))
    rooms = table(spark, sf, "nation").select(F.col("n_nationkey").alias("room"), (F.col("n_nationkey") * 100).alias("sampled"))
    return audit.evidence_rollup(rooms, models, items.select("room", F.col("l_partkey").alias("image")), "room")


@register("coverage_percent", "SELECT c_nationkey, count(*) FILTER (c_acctbal > 0) AS largest, count(*) AS sampled, round(count(*) FILTER (c_acctbal > 0) / count(*) * 100, 1) AS coverage FROM customer GROUP BY 1")
def coverage_percent(spark: SparkSession, sf: str) -> DataFrame:
    got = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") > 0).alias("largest"), F.count(F.lit(1)).alias("sampled"))
    return got.withColumn("coverage", stats.coverage(F.col("largest"), F.col("sampled")))


YEAR = "SELECT o_orderpriority AS k, round(sum(o_totalprice), 2) AS v FROM orders WHERE year(o_orderdate) = {} AND o_orderpriority {} GROUP BY 1"


@register("delta_report", f"""
WITH a AS ({YEAR.format(1995, "<> '1-URGENT'")}), b AS ({YEAR.format(1996, "<> '5-LOW'")})
SELECT k, a.v AS before, b.v AS after, round(b.v - a.v, 2) AS delta, round((b.v - a.v) / nullif(abs(a.v), 0) * 100, 4) AS percent_change FROM a FULL JOIN b USING (k)""")
def delta_report(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    year = lambda y, gone: o.where((F.year("o_orderdate") == y) & (F.col("o_orderpriority") != gone)).groupBy(F.col("o_orderpriority").alias("k")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    got = audit.delta_report(year(1995, "1-URGENT"), year(1996, "5-LOW"), "k", "v")
    return got.select("k", "before", "after", F.round("delta", 2).alias("delta"), F.round("percent_change", 4).alias("percent_change"))


@register("fix_loop_eval", """
WITH f AS (SELECT c_custkey, c_custkey % 2 = 0 AS up, c_custkey % 3 > 0 AS gate, c_acctbal AS before, c_acctbal + (c_custkey % 7) - 3 AS after, c_acctbal + 1 AS predicted_after, 4000.0 AS t FROM customer)
SELECT c_custkey, round(after - before, 4) AS actual_delta, round(predicted_after - before, 4) AS predicted_delta, CASE WHEN up THEN after > before ELSE after < before END AS improved,
  round(abs(after - predicted_after), 4) AS prediction_error, round(abs(before - t), 4) AS distance_before, round(abs(after - t), 4) AS distance_after, abs(after - t) < abs(before - t) AS moved_toward_threshold,
  CASE WHEN up THEN after >= t ELSE after <= t END AS threshold_satisfied, gate AND CASE WHEN up THEN after >= t ELSE after <= t END AS fix_pass FROM f""")
def fix_loop_eval(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    fixes = table(spark, sf, "customer").select(
        "c_custkey", F.when(c("c_custkey") % 2 == 0, "higher_is_better").otherwise("lower_is_better").alias("direction"), (c("c_custkey") % 3 > 0).alias("after_gate_pass"), c("c_acctbal").alias("before"),
        (c("c_acctbal") + c("c_custkey") % 7 - 3).alias("after"), (c("c_acctbal") + 1).alias("predicted_after"), F.lit(4000.0).alias("acceptance_threshold"),
    )
    got = audit.fix_evaluation(fixes)
    return got.select("c_custkey", *[F.round(x, 4).alias(x) for x in ("actual_delta", "predicted_delta", "prediction_error", "distance_before", "distance_after")], "improved", "moved_toward_threshold", "threshold_satisfied", "fix_pass")


@register("orientation_search", """
WITH r AS (SELECT r_regionkey AS o, count(*) + 1.0 AS a, max(n_nationkey) / 7.0 + 1 AS b, sum(length(n_name)) / 4.0 AS w, (min(n_nationkey) + 3) * 4.0 AS h FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1),
m AS (SELECT unnest(generate_series(0, 31)) AS mask),
x AS (SELECT mask, o, w, h, CASE WHEN (mask >> (4 - o)) & 1 = 1 THEN b ELSE a END AS x, CASE WHEN (mask >> (4 - o)) & 1 = 1 THEN a ELSE b END AS y FROM m CROSS JOIN r),
s AS (SELECT mask, (sum(w * x) + sum(h * y)) / (sum(x * x) + sum(y * y)) AS u, sum(w * x) / sum(x * x) AS ix, sum(h * y) / sum(y * y) AS iy FROM x GROUP BY 1),
f AS (SELECT 'uniform' AS fit, mask, u AS scale_x, u AS scale_y FROM s UNION ALL SELECT 'independent', mask, ix, iy FROM s),
e AS (SELECT fit, mask, scale_x, scale_y, unnest([(w / scale_x - x) / x, (h / scale_y - y) / y]) * 100 AS e FROM f JOIN x USING (mask)),
g AS (SELECT fit, mask, max(scale_x) AS scale_x, max(scale_y) AS scale_y, sqrt(avg(e * e)) AS rms, avg(abs(e)) AS mean, max(abs(e)) AS most FROM e GROUP BY 1, 2)
SELECT fit, mask, round(scale_x, 8) AS scale_x, round(scale_y, 8) AS scale_y, round(rms, 6) AS rms, round(mean, 6) AS mean, round(most, 6) AS most
FROM (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY round(rms, 9), mask) AS k FROM g) WHERE k = 1""")
def orientation_search(spark: SparkSession, sf: str) -> DataFrame:
    """The five regions as rooms: a table that doesn't grow, since the search is over all their orientations."""
    c = F.col
    both = table(spark, sf, "region").join(table(spark, sf, "nation"), c("n_regionkey") == c("r_regionkey"))
    rooms = both.groupBy(c("r_regionkey").alias("ordinal")).agg(
        (F.count(F.lit(1)) + 1.0).alias("a"), (F.max("n_nationkey") / 7.0 + 1).alias("b"), (F.sum(F.length("n_name")) / 4.0).alias("w"), ((F.min("n_nationkey") + 3) * 4.0).alias("h"),
    )
    got = audit.orientation_search(rooms, 5)
    return got.select("fit", "mask", *[F.round(x, 8).alias(x) for x in ("scale_x", "scale_y")], *[F.round(x, 6).alias(x) for x in ("rms", "mean", "most")])


@register("dimension_report", """
WITH d AS (SELECT p_partkey, p_size % 6 AS k, p_size + 0.0 AS t, p_partkey % 50 + 0.0 AS l FROM part)
SELECT p_partkey, CASE WHEN k IN (0, 1) THEN 'missing_or_incompatible' WHEN k = 2 THEN 'different_or_unscorable' WHEN k = 3 THEN 'unavailable' WHEN l = t THEN 'consistent' ELSE 'unavailable' END AS status,
  CASE WHEN k = 2 THEN 0 WHEN k = 3 THEN 2 WHEN k = 4 THEN 1 WHEN k = 5 THEN 0 END AS unavailable_axes, CASE WHEN k IN (2, 4) THEN abs(l - t) WHEN k = 5 THEN abs(l - t) + abs(l - t) END AS total FROM d""")
def dimension_report(spark: SparkSession, sf: str) -> DataFrame:
    """By p_size % 6: no candidate, one axis too few, an axis on one side, no axis, one axis, both axes."""
    c = F.col
    k, t, label, none = c("p_size") % 6, c("p_size").cast("double"), (c("p_partkey") % 50).cast("double"), F.lit(None).cast("double")
    truth = F.when(k == 2, F.array(t, t)).when(k == 3, F.array(none, none)).when(k == 4, F.array(t, none)).otherwise(F.array(t, t))
    got = F.when(k == 1, F.array(label)).when(k == 2, F.array(label, none)).when(k == 3, F.array(none, none)).when(k == 4, F.array(label, none)).when(k == 5, F.array(label, label))
    report = audit.dimension_report(table(spark, sf, "part").select("p_partkey", truth.alias("t"), got.alias("l")), "t", "l")
    return report.select("p_partkey", "status", "unavailable_axes", F.aggregate("differences", F.lit(0.0), lambda s, e: s + e).alias("total"))


@register("violations", """
SELECT 'unique_part' AS rule, p_brand || '/' || p_size AS key, 'must be unique' AS message FROM part GROUP BY p_brand, p_size HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'order_customer', o_custkey::VARCHAR, 'refers to nothing' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT 'balance', c_custkey::VARCHAR, 'must be a positive number' FROM customer WHERE NOT c_acctbal > 0
UNION ALL SELECT 'segment', c_custkey::VARCHAR, 'must be one of BUILDING, MACHINERY' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
UNION ALL SELECT 'name', n_nationkey::VARCHAR, 'must not be blank' FROM nation WHERE NOT trim(n_name) <> ''
UNION ALL SELECT 'images', l_orderkey::VARCHAR, 'must have 2 to 6 rows' FROM lineitem GROUP BY l_orderkey HAVING count(*) NOT BETWEEN 2 AND 6""")
def violations(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer")
    return validate.report([
        validate.unique(table(spark, sf, "part"), ["p_brand", "p_size"], "unique_part"), validate.refers(table(spark, sf, "orders"), "o_custkey", customer.where("c_acctbal > 0"), "c_custkey", "order_customer"),
        validate.positive(customer, "c_custkey", "c_acctbal", "balance"), validate.one_of(customer, "c_custkey", "c_mktsegment", ["BUILDING", "MACHINERY"], "segment"),
        validate.not_blank(table(spark, sf, "nation"), "n_nationkey", "n_name", "name"), validate.group_size(table(spark, sf, "lineitem"), "l_orderkey", 2, 6, "images"),
    ])


@register("json_safe_path", "SELECT event_id, (props->>'$.k')::BIGINT AS k, props->>'$.missing.deep' AS deep FROM events")
def json_safe_path(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", nested.at_path("props", "$.k", "bigint").alias("k"), nested.at_path("props", "$.missing.deep").alias("deep"))


@register("label_map_default", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'buy' WHEN 'view' THEN 'look' ELSE 'other' END AS label FROM events")
def label_map_default(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", nested.label(F.col("event_type"), {"purchase": "buy", "view": "look"}, "other").alias("label"))


@register("sha_signature", "SELECT doc_id, substr(sha256(lang || '|' || source || '|' || text), 1, 8) AS signature FROM documents WHERE text IS NOT NULL")
def sha_signature(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", nested.signature(["lang", "source", "text"]).alias("signature"))


@register("measurement_gate", """
SELECT c_custkey, CASE WHEN c_acctbal IS NULL THEN NULL WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_acctbal END AS value,
  CASE WHEN c_acctbal >= c_acctbal - 5 THEN 1000 BETWEEN c_acctbal - 500 AND c_acctbal + 500 END AS contained FROM customer""")
def measurement_gate(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    good = c("c_mktsegment").isin("BUILDING", "MACHINERY")
    struct = F.when(good, nested.measurement(c("c_acctbal"), "m", "count", c("c_acctbal") - 500, c("c_acctbal") + 500, 0.95)).otherwise(nested.measurement(c("c_acctbal"), "m", "count", c("c_acctbal") - 500, c("c_acctbal") + 500, 0.95, "failed"))
    rows = table(spark, sf, "customer").select("c_custkey", struct.alias("m"))
    return rows.select("c_custkey", scoring.number("m").alias("value"), scoring.contains(F.lit(1000), c("m.interval.lower"), c("m.interval.upper")).alias("contained"))


@register("overlay_sidecar", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'assessed' END, c_mktsegment) AS c_mktsegment FROM customer")
def overlay_sidecar(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return nested.overlay(customer, customer.where("c_custkey % 3 = 0").select("c_custkey", F.lit("assessed").alias("c_mktsegment")), "c_custkey", ["c_mktsegment"])


@register("damage_regions", """
WITH d AS (SELECT p_brand AS image_path, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS position, CASE p_size % 4 WHEN 0 THEN 'crack' WHEN 1 THEN 'water_damage' WHEN 2 THEN 'mold' ELSE 'unknown' END AS damage_class, p_size / 50.0 AS confidence,
  p_partkey % 120 - 10.0 AS x, p_partkey % 90 + 0.0 AS y, p_size % 17 + 0.0 AS w, p_size % 23 + 0.0 AS h, CASE WHEN p_brand < 'Brand#3' THEN 0.5 END AS s FROM part),
b AS (SELECT *, greatest(0.0, least(x - w / 2, 100)) AS x1, greatest(0.0, least(y - h / 2, 80)) AS y1, greatest(0.0, least(x + w / 2, 100)) AS x2, greatest(0.0, least(y + h / 2, 80)) AS y2 FROM d WHERE confidence >= 0.25),
t AS (SELECT *, regexp_replace(image_path, '[^A-Za-z0-9_-]+', '_', 'g') || '_' || substr(sha256(image_path), 1, 8) || '_' || CASE WHEN position < 1000 THEN lpad(position::VARCHAR, 3, '0') ELSE position::VARCHAR END AS name FROM b WHERE x2 > x1 AND y2 > y1)
SELECT 'damage_' || name AS region_id, damage_class, round(CASE WHEN damage_class = 'crack' THEN greatest(x2 - x1, y2 - y1) * coalesce(s, 1) ELSE (x2 - x1) * (y2 - y1) * coalesce(s * s, 1) END, 4) AS extent,
  CASE WHEN damage_class = 'crack' THEN CASE WHEN s IS NULL THEN 'px' ELSE 'm' END ELSE CASE WHEN s IS NULL THEN 'px^2' ELSE 'm^2' END END AS unit,
  CASE damage_class WHEN 'crack' THEN 'Review,' WHEN 'water_damage' THEN 'Investigate' ELSE 'Review and repair visible ' || damage_class || ' damage; confirm scope on site.' END AS work FROM t""")
def damage_regions(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    k = c("p_size") % 4
    rows = keyed.numbered(table(spark, sf, "part"), ["p_partkey"], ["p_brand"], "position").select(
        c("p_brand").alias("image_path"), "position", F.lit(100).alias("image_width"), F.lit(80).alias("image_height"), F.when(k == 0, "Crack_damage").when(k == 1, "water_damage").when(k == 2, "mold_damage").alias("class"),
        (c("p_size") / 50.0).alias("confidence"), (c("p_partkey") % 120 - 10.0).alias("x"), (c("p_partkey") % 90 + 0.0).alias("y"), (c("p_size") % 17 + 0.0).alias("width"), (c("p_size") % 23 + 0.0).alias("height"),
    )
    scales = rows.where("image_path < 'Brand#3'").select("image_path", F.lit(0.5).alias("m_per_px")).distinct()
    regions = nested.damage_regions(rows, scales)
    lines = nested.scope_lines(regions).select(F.replace("item_id", F.lit("scope_"), F.lit("damage_")).alias("region_id"), "description")
    work = F.when(c("damage_class").isin("crack", "water_damage"), F.substring_index("description", " ", 1)).otherwise(c("description"))
    return regions.join(lines, "region_id").select("region_id", "damage_class", "extent", "unit", work.alias("work"))
