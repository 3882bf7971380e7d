"""The composed plans on hand-made inputs."""

import collections
import itertools

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators import keyed, manifest
from plumbline.plans import benchmark_report, capture, capture_queries, catalog


def tables(spark, **more):
    df = spark.createDataFrame
    return benchmark_report.Tables(
        rooms=df([("R1", 2.5, 12.0), ("R2", None, None)], "room_id string, ceiling_height_m double, floor_area_m2 double"),
        walls=df([("R1", "w1", 4.0), ("R1", "w2", 3.0)], "room_id string, wall_id string, length_m double"),
        openings=df([("R1", "o1", 0.9)], "room_id string, opening_id string, width_m double"),
        runs=df([(1, "photo", "c1", "R1", "g", 10.0), (2, "photo", "c2", "R1", "g", 900.0), (3, "video", "c1", "R1", None, None), (4, "lidar", "c1", "R1", None, 5.0)], "run_idx int, tier string, capture_id string, room_id string, repeat_group string, runtime_s double"),
        wall_matches=df([(1, "w1", "s9", 0), (1, "w1", "s1", 1), (1, "w2", "s2", 2), (2, "w1", "s1", 3), (2, "w2", "s2", 4), (4, "w1", "s1", 5)], "run_idx int, truth_id string, prediction_id string, ordinal int"),
        opening_matches=df([(1, "o1", "p1", 0)], "run_idx int, truth_id string, prediction_id string, ordinal int"),
        predictions=df([(1, "s9", "complete", 1.0, None, None), (1, "s1", "complete", 4.2, 4.0, 4.4), (1, "s2", "partial", 3.1, None, None), (2, "s1", "complete", 4.205, 4.1, 4.3), (2, "s2", "failed", 3.0, None, None), (1, "p1", "complete", 0.915, None, None), (1, "ceiling", "complete", 2.52, None, None), (2, "ceiling", "complete", 2.525, None, None), (4, "s1", "complete", 4.01, None, None), (4, "ceiling", "complete", 2.51, None, None)], "run_idx int, object_id string, status string, value double, lower double, upper double"),
        phantoms=df([(3, "px")], "run_idx int, prediction_id string"),
        **more,
    )


def whole(spark, overlaps=0, edge=("P1", "R2"), value=105.0, incumbent=4.02):
    df = spark.createDataFrame
    return tables(
        spark,
        footprint=df([(100.0,)], "footprint_m2 double"),
        adjacency=df([("R2", "R1")], "room_a string, room_b string"),
        stitched=df([(1, "complete", "complete", value, 90.0, 110.0, overlaps), (2, "complete", "complete", value, 90.0, 110.0, overlaps), (3, "complete", "complete", 102.0, None, None, 0)], "run_idx int, plan_status string, status string, value double, lower double, upper double, n_overlaps int"),
        stitched_adjacency=df([(1, *edge), (2, *edge), (2, edge[1], edge[0])], "run_idx int, room_a string, room_b string"),
        room_matches=df([(1, "R1", "P1"), (2, "R1", "P1")], "run_idx int, truth_id string, prediction_id string"),
        incumbent=df([("R1", "c1", "wall_length_m", "w1", incumbent), ("R1", "c1", "ceiling_height_m", "R1", 2.51), ("R2", "c1", "ceiling_height_m", "R2", 2.5)], "room_id string, capture_id string, metric string, object_id string, value double"),
        registration=df([(1, 23, 20), (2, 23, 8), (3, 10, 10)], "run_idx int, input_photos int, registered_photos int"),
        hypotheses=df([(1, "H1", 11.0, [4.1, 3.0])], "run_idx int, candidate_id string, area_m2 double, side_lengths_m array<double>"),
        hypothesis_matches=df([(1, "R1", "H1")], "run_idx int, room_id string, candidate_id string"),
        side_matches=df([(1, "R1", "w1", "H1", 0)], "run_idx int, room_id string, wall_id string, candidate_id string, side_index int"),
    )


def by_gate(t):
    return {r.gate: (r.n, r.n_pass, r.value, r.passed) for r in benchmark_report.gates(t).collect()}


def test_benchmark_report(spark):
    got = by_gate(tables(spark))
    assert got["photo_wall_lengths"] == (4, 3, None, False)  # a failed measurement is unscored, so the gate fails
    assert got["video_wall_lengths"] == (2, 0, None, False)
    assert got["photo_opening_detection_and_width"] == (2, 1, 0.5, False) and got["video_opening_detection_and_width"] == (2, 0, 0.0, False)  # 1.5 cm is within 2 cm
    assert got["photo_ceiling_height"] == (2, 0, None, False) and got["lidar_ceiling_height"] == (1, 1, None, True)  # 2 cm isn't within 1.5 cm
    assert got["single_command_runtime_under_15_minutes"] == (4, 3, 3.0, None)
    assert got["photo_repeatability"] == (3, 2, None, False)  # the ceiling, one wall, and one wall that was measured once
    assert got["lidar_incumbent_comparison"] == (0, 0, None, None) and "photo_whole_property_stitch" not in got
    rows = {(r.tier, r.metric): (r.n_samples, r.n_interval, r.coverage) for r in benchmark_report.calibration(tables(spark)).collect()}
    assert rows["photo", "wall_length_m"] == (4, 2, 0.5) and rows["photo", "floor_area_m2"] == (2, 0, None)


def test_whole_property_gates(spark):
    got = by_gate(whole(spark))
    assert got["photo_whole_property_stitch"] == (2, 2, 60.87, True)
    assert got["video_whole_property_footprint"] == (1, 1, None, True)
    assert got["lidar_incumbent_comparison"] == (2, 2, 1.0, False)  # a win and a tie, but in one room
    assert by_gate(whole(spark, incumbent=4.0))["lidar_incumbent_comparison"][:3] == (2, 1, 0.5)
    for bad in ({"overlaps": 1}, {"edge": ("P1", "R3")}, {"value": 109.0}):
        assert by_gate(whole(spark, **bad))["photo_whole_property_stitch"][3] is False
    rows = {(r.tier, r.metric): (r.n_samples, r.coverage) for r in benchmark_report.calibration(whole(spark)).collect()}
    assert rows["photo", "stitched_footprint_m2"] == rows["photo", "whole_property_footprint_m2"] == (2, 1.0) and rows["video", "whole_property_footprint_m2"] == (1, None)
    area, wall = benchmark_report.candidate_areas(whole(spark)).first(), benchmark_report.candidate_walls(whole(spark)).first()
    assert area.absolute_error == 1.0 and abs(wall.absolute_error - 0.1) < 1e-9


def test_last_correspondence_wins(spark):
    rows = benchmark_report.metric_rows(tables(spark)).where("run_idx = 1 AND object_id = 'w1'").collect()
    assert [r.prediction for r in rows] == [4.2]


def test_manifest_rules(spark):
    df, t = spark.createDataFrame, tables(spark)
    runs = t.runs.selectExpr("*", "'r.json' AS result_json", "run_idx <> 2 AS result_found")
    base = {
        "rooms": t.rooms, "walls": t.walls, "openings": t.openings, "runs": runs,
        "wall_matches": t.wall_matches.selectExpr("run_idx", "truth_id AS ground_truth_wall_id", "prediction_id AS prediction_surface_id"), "opening_matches": df([(9, "o1"), (1, None)], "run_idx int, ground_truth_opening_id string"),
    }
    got = {(r.rule, r.key) for r in manifest.benchmark(manifest.Manifest(**base)).collect()}
    assert got == {("opening_match_run", "9"), ("opening_match", "1"), ("run_result", "2")}
    full = manifest.Manifest(
        **base | {"opening_matches": base["opening_matches"].where("false"), "runs": runs.withColumn("result_found", F.lit(True))},
        document=df([(" ", -1.0)], "benchmark_id string, footprint_m2 double"), adjacency=df([("R1", None)], "room_a string, room_b string"), connectors=df([(None,)], "room_id string"),
        hypothesis_matches=df([(1, "R9", "H")], "run_idx int, ground_truth_room_id string, prediction_candidate_id string"),
        side_matches=df([(1, "R1", "w9", "H", -1)], "run_idx int, ground_truth_room_id string, ground_truth_wall_id string, prediction_candidate_id string, candidate_side_index int"),
        incumbent=df([("a", "")], "app string, version string"), artifacts=df([("x", False)], "path string, found boolean"),
        incumbent_rooms=df([("R1", "c1", -2.0, None), ("R1", "c2", None, None), ("R9", "c1", None, None)], "room_id string, capture_id string, ceiling_height_m double, floor_area_m2 double"),
        incumbent_walls=df([("R1", "w1", 1.0), ("R1", "w7", 0.0)], "room_id string, wall_id string, length_m double"),
        damage=df([("d", "R1", "crack", "s", 1.0), ("d", "R9", " ", None, 0.0)], "example_id string, room_id string, damage_class string, surface_id string, extent_m2 double"),
        damage_regions=df([("d", "i.png", False, [[0.0, 1.0], [1.0, 1.0]])], "example_id string, image_path string, image_found boolean, polygon_px array<array<double>>"),
    )
    assert {(r.rule, r.key) for r in manifest.benchmark(full).collect()} == {
        ("benchmark_id", "document"), ("footprint", "document"), ("adjacency", "R1"), ("connector", "connectors"), ("hypothesis_match_room", "R9"), ("side_match_index", "1"), ("side_match_wall", "R1/w9"),
        ("incumbent_version", "incumbent"), ("incumbent_artifact", "x"), ("incumbent_room", "R9"), ("incumbent_room", "R1"), ("incumbent_ceiling_height_m", "R1"), ("incumbent_capture", "R1/c2"), ("incumbent_capture", "R9/c1"),
        ("incumbent_wall_size", "R1/w7"), ("incumbent_wall_truth", "R1/w7"), ("damage_id", "d"), ("damage_room", "R9"), ("damage_class", "d"), ("damage_surface", "d"), ("damage_extent", "d"), ("damage_image", "i.png"), ("damage_polygon", "d"),
    }
    photos = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), (None, "4")], "folder string, path string")
    assert {r.rule for r in manifest.photo_collection(photos).collect()} == {"photo_mixing", "photo_count"}
    pairs = spark.createDataFrame([("c", "x", "x", "raw", "raw", "/A", "/a")], "capture_id string, capture_a string, capture_b string, mode_a string, mode_b string, path_a string, path_b string")
    assert [r.rule for r in manifest.ablation(pairs).collect()] == ["ablation_modes"]
    spaces = spark.createDataFrame([("s", [[0.0, 0.0], [10.0, 0.0], [10.0, 11.0]]), ("t", [[0.0, 0.0], [1.0, 1.0]])], "space_id string, vertices array<array<double>>")
    assert {(r.rule, r.key) for r in manifest.plan(spaces, 10, 10).collect()} == {("space_bounds", "s"), ("space_polygon", "t")}


def test_projection_and_result(spark):
    cameras = spark.createDataFrame([("f", 100.0, 100.0, 2.0, 2.0, 4.0, 4.0)], "frame_id string, fx double, fy double, cx double, cy double, width double, height double")
    poses = spark.createDataFrame([("f", [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], 1.0, 2.0, 3.0)], "frame_id string, rotation array<double>, tx double, ty double, tz double")
    rows = [("f", u, v, 2.0 if (u, v) != (2, 2) else 0.0, 1, "scan", 4, 4) for u in range(4) for v in range(4)]
    pixels = spark.createDataFrame(rows, "frame_id string, u int, v int, z double, confidence int, source string, raster_width int, raster_height int")
    got = {(round(r.x, 3), round(r.y, 3), round(r.z, 3)) for r in capture.points(pixels, cameras, poses, 2).collect()}
    assert got == {(0.96, 2.04, 1.0), (1.0, 2.04, 1.0), (0.96, 2.0, 1.0)}
    moved = spark.createDataFrame([("a", 0.0, 0.0, 1.5), ("b", 2.0, 1.0, 1.6)], "frame_id string, tx double, ty double, tz double")
    r = capture.result(capture_queries.box_points(spark), moved, "c").first().result
    assert r.footprint.status == "partial" and abs(r.footprint.value - 12) < 1.0 and len(r.surfaces) == 4 and abs(r.floor_level.value) < 0.02


def test_positions_and_runs(spark):
    df = spark.createDataFrame([("g", 1, "a"), ("g", 2, "a"), ("g", 3, "b")], "g string, o int, v string")
    assert [r.o for r in keyed.changes(df, ["g"], ["o"], "v").orderBy("o").collect()] == [1, 3]
    assert [(r.a, r.b) for r in keyed.consecutive(df, ["g"], ["o"], "v").collect()] == [("a", "a"), ("a", "b")]
    names = spark.createDataFrame([("10",), ("b",), ("9",), ("a",)], "k string")
    assert [r.k for r in names.orderBy(*keyed.natural("k")).collect()] == ["9", "10", "a", "b"]
    arrays = spark.createDataFrame([(1, [5.0, 6.0], 1)], "k int, a array<double>, i int")
    assert keyed.at_position(arrays, "a", "i", "x").first().x == 6.0
    assert np.isclose(keyed.linked(arrays, arrays.select("k", "i"), ["k", "i"], "no link").count(), 1)


def test_empty_tier_gate_sees_all_parts(spark, small):
    price = {r.p_partkey: float(r.p_retailprice) for r in spark.read.parquet(f"{small}/part.parquet").collect()}
    units = collections.defaultdict(list)
    for r in spark.read.parquet(f"{small}/lineitem.parquet").select("l_partkey", "l_returnflag", "l_extendedprice", "l_quantity").collect():
        units[r.l_partkey, r.l_returnflag].append(float(r.l_extendedprice) / float(r.l_quantity))
    want = {("none", 0, 0, None)}
    for tier, tolerance in (("A", 0.08), ("N", 0.03)):
        passed = [bool(u := units.get((k, tier))) and abs(sum(u) / len(u) - v) / v <= tolerance for k, v in price.items()]
        want.add((tier, len(price), sum(passed), all(passed)))
    got = catalog.queries()["empty_tier_gate"](spark, small).collect()
    assert {(r.tier, r.n, r.n_pass, r.gate_pass) for r in got} == want


def test_cooccurrence_pairs_of_all_line_items(spark, small):
    orders = collections.defaultdict(set)
    for r in spark.read.parquet(f"{small}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        orders[r.l_orderkey].add(r.l_partkey)
    want = {pair for parts in orders.values() for pair in itertools.combinations(sorted(parts), 2)}
    got = [(r.a, r.b) for r in catalog.queries()["cooccurrence_pairs"](spark, small).collect()]
    assert len(got) == len(want) and set(got) == want
