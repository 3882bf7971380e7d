"""The scored benchmark: truth, runs and correspondences to fact rows, then gates as one long table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import keyed, scoring, stats
from plumbline.session import cut

# Tolerances and required rates of the gates.
WALL_TOLERANCE = {"photo": 0.08, "video": 0.03}
FOOTPRINT_TOLERANCE = {"photo": 0.08, "video": 0.03}
OPENING_TOLERANCE_M, CEILING_TOLERANCE_M = 0.02, 0.015
OPENING_RATE, COMPARISON_RATE, COMPARISON_ROOMS = 0.85, 0.70, 2
CEILING_REPEAT_M, WALL_REPEAT_M, WALL_REPEAT_SHARE = 0.01, 0.01, 0.005
RUNTIME_S = 900.0


@dataclass
class Tables:
    """The benchmark's documents as tables; those with a default may be absent.

    rooms (room_id, ceiling_height_m, floor_area_m2), walls (room_id, wall_id, length_m), openings (room_id,
    opening_id, width_m), runs (run_idx, tier, capture_id, room_id, repeat_group, runtime_s), wall_matches and
    opening_matches (run_idx, truth_id, prediction_id), predictions (run_idx, object_id, status, value, lower,
    upper; the room's own are called ceiling and floor_area), phantoms (run_idx, prediction_id),
    footprint (footprint_m2, one row), adjacency (room_a, room_b), stitched (run_idx, plan_status, status, value, lower,
    upper, n_overlaps), stitched_adjacency (run_idx, room_a, room_b), room_matches (run_idx, truth_id,
    prediction_id), incumbent (room_id, capture_id, metric, object_id, value), registration (run_idx,
    input_photos, registered_photos), hypotheses (run_idx, candidate_id, area_m2, side_lengths_m),
    hypothesis_matches (run_idx, room_id, candidate_id), side_matches (run_idx, room_id, wall_id, candidate_id,
    side_index).
    """

    rooms: DataFrame
    walls: DataFrame
    openings: DataFrame
    runs: DataFrame
    wall_matches: DataFrame
    opening_matches: DataFrame
    predictions: DataFrame
    phantoms: DataFrame
    footprint: DataFrame | None = None
    adjacency: DataFrame | None = None
    stitched: DataFrame | None = None
    stitched_adjacency: DataFrame | None = None
    room_matches: DataFrame | None = None
    incumbent: DataFrame | None = None
    registration: DataFrame | None = None
    hypotheses: DataFrame | None = None
    hypothesis_matches: DataFrame | None = None
    side_matches: DataFrame | None = None

    @property
    def whole(self) -> bool:
        return self.footprint is not None and self.stitched is not None


def scorable(df: DataFrame) -> DataFrame:
    """Measurements whose status lets them be scored keep their value; bounds count in any case."""
    return df.withColumn("prediction", F.when(F.col("status").isin(*scoring.SCORED), F.col("value"))).drop("status", "value")


def metric_rows(t: Tables) -> DataFrame:
    """One row for each truth object of each run's room, and for each photo or video run's whole plan; what has no match or value stays, unscored."""
    runs = t.runs.select("run_idx", "tier", "capture_id", "room_id", "repeat_group")
    values = scorable(t.predictions).select("run_idx", F.col("object_id").alias("prediction_id"), "prediction", "lower", "upper")
    parts = []
    for metric, truth, key, size, matches in (("wall_length_m", t.walls, "wall_id", "length_m", t.wall_matches), ("opening_width_m", t.openings, "opening_id", "width_m", t.opening_matches)):
        objects = runs.join(truth.select("room_id", F.col(key).alias("object_id"), F.col(size).alias("ground_truth")), "room_id")
        order = F.col("ordinal" if "ordinal" in matches.columns else "prediction_id")  # without an order of their own the greatest prediction id wins
        links = keyed.last_wins(matches.withColumn("_o", order), ["run_idx", "truth_id"], ["_o"])
        linked = objects.join(links.select("run_idx", F.col("truth_id").alias("object_id"), "prediction_id"), ["run_idx", "object_id"], "left").join(values, ["run_idx", "prediction_id"], "left")
        parts.append(linked.withColumn("metric", F.lit(metric)).drop("prediction_id"))
    for metric, own in (("ceiling_height_m", "ceiling"), ("floor_area_m2", "floor_area")):
        if metric in t.rooms.columns:
            rooms = runs.join(t.rooms.select("room_id", F.col(metric).alias("ground_truth")).where("ground_truth IS NOT NULL"), "room_id")
            got = values.where(F.col("prediction_id") == own).drop("prediction_id")
            parts.append(rooms.join(got, "run_idx", "left").withColumn("metric", F.lit(metric)).withColumn("object_id", F.col("room_id")))
    if t.whole:
        plans = scorable(t.stitched).select("run_idx", "prediction", "lower", "upper")
        truth = F.broadcast(t.footprint.where("footprint_m2 <> 0").select(F.col("footprint_m2").alias("ground_truth")).limit(1))  # one property
        whole = runs.where(F.col("tier").isin("photo", "video")).crossJoin(truth).join(plans, "run_idx", "left")
        parts.append(whole.withColumn("metric", F.lit("whole_property_footprint_m2")).withColumn("object_id", F.lit("property")).withColumn("room_id", F.lit("property")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    by_tier = lambda limits: F.when(F.col("tier") == "photo", limits["photo"]).when(F.col("tier") == "video", limits["video"])
    m = F.col("metric")
    tolerance = F.when(m == "wall_length_m", by_tier(WALL_TOLERANCE)).when(m == "opening_width_m", OPENING_TOLERANCE_M).when(m == "ceiling_height_m", CEILING_TOLERANCE_M).when(m == "whole_property_footprint_m2", by_tier(FOOTPRINT_TOLERANCE))
    relative = m.isin("wall_length_m", "whole_property_footprint_m2")
    scored = scoring.metric_rows(rows, "ground_truth", "prediction", low="lower", high="upper")
    of = F.when(relative, F.col("relative_error")).otherwise(F.col("absolute_error"))
    return scored.withColumn("gate_tolerance", tolerance).withColumn("gate_tolerance_kind", F.when(relative, "relative").otherwise("absolute")).withColumn("gate_pass", of <= tolerance)


def repeats(rows: DataFrame) -> DataFrame:
    """Ceilings and walls of runs in repeat groups: (repeat_group, tier, metric, object_id, n_samples, n_measured, spread, tolerance, gate_pass)."""
    grouped = rows.where("repeat_group IS NOT NULL")
    ceilings = grouped.where("metric = 'ceiling_height_m'").withColumn("object_id", F.lit(None).cast("string"))
    ceilings = scoring.repeatability(ceilings, ["repeat_group", "tier", "metric", "object_id"], "prediction", "ground_truth", CEILING_REPEAT_M, 0.0)
    walls = grouped.where("metric = 'wall_length_m'").withColumn("_group", F.struct("repeat_group", "tier"))
    common = scoring.common_objects(walls, "_group", "run_idx", "object_id")
    walls = scoring.repeatability(walls.join(common, ["_group", "object_id"]), ["repeat_group", "tier", "metric", "object_id"], "prediction", "ground_truth", WALL_REPEAT_M, WALL_REPEAT_SHARE)
    return ceilings.unionByName(walls)


def stitches(t: Tables, rows: DataFrame) -> DataFrame:
    """Photo plans against the whole property: footprint, interval, exact adjacency under the rooms' true names, no overlaps, complete."""
    plans = rows.where("metric = 'whole_property_footprint_m2' AND tier = 'photo'").select("run_idx", "capture_id", "relative_error", "interval_contains_truth")
    runs = plans.select("run_idx")
    if t.stitched_adjacency is None:
        actual = runs.withColumn("a", F.lit(None).cast("string")).withColumn("b", F.lit(None).cast("string")).where("false")
    else:
        names = t.room_matches.select("run_idx", F.col("prediction_id").alias("old"), F.col("truth_id").alias("new")) if t.room_matches is not None else None
        edges = t.stitched_adjacency.select("run_idx", "room_a", "room_b")
        for c in ("room_a", "room_b"):
            if names is not None:
                edges = edges.join(names.withColumnRenamed("old", c), ["run_idx", c], "left").withColumn(c, F.coalesce("new", c)).drop("new")
        actual = edges.join(runs, "run_idx", "left_semi").select("run_idx", F.least("room_a", "room_b").alias("a"), F.greatest("room_a", "room_b").alias("b")).distinct()
    wanted = t.adjacency.select(F.least("room_a", "room_b").alias("a"), F.greatest("room_a", "room_b").alias("b")).distinct() if t.adjacency is not None else actual.select("a", "b").where("false")
    # Equal sets: as many edges as wanted, all of them wanted ones.
    found = actual.join(wanted.withColumn("_w", F.lit(1)), ["a", "b"], "left").groupBy("run_idx").agg(F.count(F.lit(1)).alias("n"), F.count("_w").alias("n_right"))
    number = wanted.agg(F.count(F.lit(1)).alias("n_wanted"))
    both = plans.join(found, "run_idx", "left").crossJoin(F.broadcast(number)).na.fill(0, ["n", "n_right"])  # one row
    equal = (F.col("n") == F.col("n_right")) & (F.col("n_right") == F.col("n_wanted"))
    state = t.stitched.select("run_idx", "plan_status", "n_overlaps")
    return scoring.stitch_gate(both.withColumn("adjacency_equal", equal).join(state, "run_idx", "left").na.fill({"n_overlaps": 0, "plan_status": "unavailable"}), "adjacency_equal", "n_overlaps", "plan_status", FOOTPRINT_TOLERANCE["photo"]).drop("n", "n_right", "n_wanted")


def incumbent_rows(t: Tables, rows: DataFrame) -> DataFrame:
    """Each dimension of the other product beside the lidar run's error on it; one without such a run can't be compared."""
    lidar = keyed.last_wins(rows.where("tier = 'lidar'"), ["room_id", "capture_id", "metric", "object_id"], ["run_idx"]).select("room_id", "capture_id", "metric", "object_id", "ground_truth", "prediction")
    both = t.incumbent.select("room_id", "capture_id", "metric", "object_id", F.col("value").alias("incumbent")).join(lidar, ["room_id", "capture_id", "metric", "object_id"], "left")
    return scoring.compare(both, "ground_truth", "prediction", "incumbent")


def registration(t: Tables) -> DataFrame:
    """Share of each photo run's images in its largest joint model, in percent."""
    photo = t.runs.where("tier = 'photo'").select("run_idx", "capture_id")
    known = t.registration.where("input_photos > 0 AND registered_photos IS NOT NULL")
    return photo.join(known, "run_idx").select("run_idx", "capture_id", "input_photos", "registered_photos", F.round(F.col("registered_photos") / F.col("input_photos") * 100, 3).alias("coverage_percent"))


def candidate_areas(t: Tables) -> DataFrame:
    """Areas of matched boundary hypotheses against the rooms'; a match without its hypothesis fails the run. For diagnosis, not for a gate."""
    both = keyed.linked(t.hypothesis_matches, t.hypotheses.select("run_idx", "candidate_id", "area_m2"), ["run_idx", "candidate_id"], "a matched boundary hypothesis doesn't exist")
    rows = both.join(t.rooms.select("room_id", F.col("floor_area_m2").alias("ground_truth")), "room_id").where("ground_truth IS NOT NULL AND area_m2 IS NOT NULL")
    return scoring.metric_rows(rows, "ground_truth", "area_m2")


def candidate_walls(t: Tables) -> DataFrame:
    """Side lengths of matched hypotheses against the walls'; a side out of range fails the run."""
    both = keyed.linked(t.side_matches, t.hypotheses.select("run_idx", "candidate_id", "side_lengths_m"), ["run_idx", "candidate_id"], "a matched boundary hypothesis doesn't exist")
    sides = keyed.at_position(both, "side_lengths_m", "side_index", "length").drop("side_lengths_m")
    rows = sides.join(t.walls.select("room_id", "wall_id", F.col("length_m").alias("ground_truth")), ["room_id", "wall_id"]).where("length IS NOT NULL")
    return scoring.metric_rows(rows, "ground_truth", "length")


def calibration(t: Tables, rows: DataFrame | None = None) -> DataFrame:
    """(tier, metric, n_samples, n_interval, n_missing, coverage); the photo footprint is there under both of its names."""
    rows = metric_rows(t) if rows is None else rows
    twice = rows.where("tier = 'photo' AND metric = 'whole_property_footprint_m2'").withColumn("metric", F.lit("stitched_footprint_m2"))
    return scoring.calibration(rows.unionByName(twice), ["tier", "metric"])


def gates(t: Tables) -> DataFrame:
    """(gate, n, n_pass, value, passed) of every gate; passed is null where nothing could be scored."""
    rows = cut(metric_rows(t))
    spark, c = rows.sparkSession, F.col
    none = F.lit(None).cast("double")
    out = lambda df, name, n="n", n_pass="n_pass", value=none, passed="gate_pass": df.select(name.alias("gate"), c(n).cast("long").alias("n"), c(n_pass).cast("long").alias("n_pass"), value.cast("double").alias("value"), c(passed).alias("passed"))
    tiers = spark.createDataFrame([(x,) for x in ("photo", "video")], "tier string")
    named = lambda text: F.concat("tier", F.lit(text))
    strict = [F.count(F.lit(1)).alias("n"), F.count_if("gate_pass").alias("n_pass"), scoring.strict(c("gate_pass")).alias("gate_pass")]

    openings, phantoms = rows.where("metric = 'opening_width_m'"), t.phantoms.join(t.runs.select("run_idx", "tier"), "run_idx")
    seen = t.runs.select("tier").distinct().join(scoring.detection_gate(openings, phantoms, "tier", least=OPENING_RATE), "tier", "left").na.fill(0, ["n_truth", "n_within", "n_phantom"])
    parts = [
        out(seen.withColumn("n", c("n_truth") + c("n_phantom")), named("_opening_detection_and_width"), n_pass="n_within", value=c("rate")),
        out(rows.where("metric = 'ceiling_height_m'").groupBy("tier").agg(*strict), named("_ceiling_height")),
        out(scoring.all_gate(rows.where("metric = 'wall_length_m'"), tiers, "tier"), named("_wall_lengths")),
        out(repeats(rows).groupBy("tier").agg(*strict), named("_repeatability")),
    ]
    photo = stitches(t, rows).agg(*strict) if t.whole else spark.createDataFrame([(0, 0, None)], "n long, n_pass long, gate_pass boolean")
    mean = registration(t).agg(F.count(F.lit(1)).alias("_r"), F.round(F.avg("coverage_percent"), 3).alias("_mean")) if t.registration is not None else spark.createDataFrame([(0, None)], "_r long, _mean double")
    stitch = photo.crossJoin(mean).where("n > 0 OR _r > 0")  # one row each
    parts.append(out(stitch, F.lit("photo_whole_property_stitch"), value=c("_mean")))
    video = rows.where("tier = 'video' AND metric = 'whole_property_footprint_m2'").agg(*strict).where("n > 0")
    parts.append(out(video, F.lit("video_whole_property_footprint")))
    if t.incumbent is not None:
        compared = scoring.comparison_gate(incumbent_rows(t, rows), "room_id", least=COMPARISON_RATE, rooms=COMPARISON_ROOMS).withColumn("n_pass", c("n_win") + c("n_tie"))
        parts.append(out(compared, F.lit("lidar_incumbent_comparison"), n="n_scored", value=c("win_or_tie_rate")))
    else:
        parts.append(out(spark.createDataFrame([(0, 0, None)], "n long, n_pass long, gate_pass boolean"), F.lit("lidar_incumbent_comparison")))
    timed = scoring.runtime_gate(t.runs, "runtime_s", most=RUNTIME_S)
    under = t.runs.agg(F.count_if(c("runtime_s") <= RUNTIME_S).alias("n_pass"))
    parts.append(out(timed.crossJoin(under), F.lit("single_command_runtime_under_15_minutes"), n="n_runs", value=c("n_measured")))  # one row each
    report = parts[0]
    for p in parts[1:]:
        report = report.unionByName(p)
    return report
