"""Readiness of one complete benchmark, and of it with one piece taken away."""

from plumbline.operators import readiness

SCHEMAS = {
    "rooms": "benchmark_id string, room_id string, ceiling_height_m double, floor_area_m2 double", "connectors": "benchmark_id string, room_id string", "walls": "benchmark_id string, room_id string, length_m double",
    "openings": "benchmark_id string, room_id string", "adjacency": "benchmark_id string, room_a string, room_b string", "properties": "benchmark_id string, footprint_m2 double",
    "runs": "benchmark_id string, tier string, room_id string, repeat_group string", "examples": "benchmark_id string, example_id int, damage_class string, surface_id string, extent_m2 double",
    "regions": "benchmark_id string, example_id int, image_path string, polygon_px array<array<double>>",
}
POLYGON = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]


def complete():
    rooms = ["a", "b", "d", "hall"]
    return {
        "rooms": [(r, 2.5, 9.0) for r in rooms], "connectors": [("hall",)], "walls": [(r, 3.0) for r in rooms for _ in range(2)], "openings": [("a",)], "adjacency": [("a", "hall")], "properties": [(50.0,)],
        "runs": [(t, r, None) for t in readiness.TIERS for r in rooms] + [("photo", "a", "g"), ("photo", "a", "g")], "examples": [(1, "crack", "w", 0.1), (2, "stain", "w", 0.2)], "regions": [(1, "i.jpg", POLYGON), (2, "i.jpg", POLYGON)],
    }


def test_one_piece_taken_away(spark):
    short, empty = [[0.0, 0.0], [1.0, 0.0]], [[0.0, None], [1.0, 0.0], [2.0, 2.0]]
    cases = {
        "whole": ({}, None), "two rooms": ({"connectors": [("hall",), ("d",)]}, "room_set"), "no hall": ({"connectors": [("elsewhere",)]}, "room_set"),
        "no height": ({"rooms": [*complete()["rooms"][:3], ("hall", None, 9.0)]}, "measured_ground_truth"), "no length": ({"walls": [*complete()["walls"], ("a", None)]}, "measured_ground_truth"), "no walls": ({"walls": complete()["walls"][2:]}, "measured_ground_truth"),
        "no opening": ({"openings": []}, "measured_ground_truth"), "no edge": ({"adjacency": []}, "measured_ground_truth"), "no footprint": ({"properties": [(None,)]}, "measured_ground_truth"),
        "one tier": ({"runs": complete()["runs"][1:]}, None), "a tier less": ({"runs": [r for r in complete()["runs"] if r[:2] != ("video", "d")]}, "same_rooms_all_tiers"),
        "no repeat": ({"runs": [(t, r, {"photo": "g", "video": ""}.get(t)) for t in readiness.TIERS for r in ("a", "b", "d", "hall")]}, "repeat_capture"),
        "one class": ({"examples": [(1, "crack", "w", 0.1), (2, " crack ", "w", 0.2)]}, "staged_damage"), "no extent": ({"examples": [(1, "crack", "w", 0.0), (2, "stain", "w", 0.2)]}, "staged_damage"), "no surface": ({"examples": [(1, "crack", " ", 0.1), (2, "stain", "w", 0.2)]}, "staged_damage"),
        "no region": ({"regions": [(1, "i.jpg", POLYGON)]}, "staged_damage"), "no polygon": ({"regions": [(1, "i.jpg", POLYGON), (2, "i.jpg", short)]}, "staged_damage"), "no number": ({"regions": [(1, "i.jpg", POLYGON), (2, "i.jpg", empty)]}, "staged_damage"), "no image": ({"regions": [(1, "", POLYGON), (2, "i.jpg", POLYGON)]}, "staged_damage"),
    }
    frames = {}
    for name, schema in SCHEMAS.items():
        frames[name] = spark.createDataFrame([(case, *row) for case, (change, _) in cases.items() for row in (complete() | change)[name]], schema)
    benchmarks = spark.createDataFrame([(case,) for case in [*cases, "nothing"]], "benchmark_id string")
    got = {(r.benchmark_id, r.check): r.passed for r in readiness.checks(benchmarks, **frames).collect()}
    for case, (_, failed) in cases.items():
        assert {k for (b, k), ok in got.items() if b == case and not ok} == ({failed, "ready"} if failed else set()), case
    assert not any(ok for (b, _), ok in got.items() if b == "nothing") and len(got) == 6 * (len(cases) + 1)
