"""Golden cases and properties of the operators that the oracles don't cover."""

import hashlib
import itertools
import json
import collections
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.operators import asof, audit, graph, keyed, nested, pointcloud, polygon, scoring, stats, validate, walls
from plumbline.sources import readers, writers

# --- as-of -----------------------------------------------------------------------------


def test_nearest_ties_tolerance_and_first_use(spark):
    left = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.05), (4, 40.0)], "id long, t double")
    right = spark.createDataFrame([(11, 9.95), (12, 10.05), (13, 30.0), (14, 40.06)], "rid long, rt double")
    got = {r.id: r.rid for r in asof.nearest(left, right, "id", "t", "rid", "rt", 0.0501).collect()}
    assert got == {1: 11, 3: 13}  # the earlier of equals; at the limit kept; beyond it and without partner dropped
    both = asof.nearest(spark.createDataFrame([(1, 9.98), (2, 9.96)], "id long, t double"), right, "id", "t", "rid", "rt", 0.0501)
    assert [r.id for r in asof.first_use(both, "rid", "t", "id").collect()] == [2]
    with pytest.raises(Exception, match="without a match"):
        asof.must_match(left, asof.nearest(left, right, "id", "t", "rid", "rt", 0.0501), "id").collect()


def test_nearest_equals_brute_force(spark):
    rng = random.Random(1)
    a = [(k, round(rng.uniform(-50, 50), 2)) for k in range(150)]
    b = [(k, round(rng.uniform(-50, 50), 2)) for k in range(150)]
    got = {r.id: (r.rid, r.offset) for r in asof.nearest(spark.createDataFrame(a, "id long, t double"), spark.createDataFrame(b, "rid long, rt double"), "id", "t", "rid", "rt", 0.5).collect()}
    want = {}
    for k, t in a:
        best = min(((abs(rt - t), rt, rk) for rk, rt in b if abs(rt - t) <= 0.5), default=None)
        if best:
            want[k] = (best[2], best[0])
    assert got == want


# --- scoring ---------------------------------------------------------------------------


def test_gates_with_nulls(spark):
    rows = spark.createDataFrame([("a", True), ("a", None), ("b", True)], "tier string, gate_pass boolean")
    dims = spark.createDataFrame([("a",), ("b",), ("c",)], "tier string")
    got = {r.tier: (r.n, r.gate_pass) for r in scoring.all_gate(rows, dims, "tier").collect()}
    assert got == {"a": (2, False), "b": (1, True), "c": (0, None)}
    phantoms = spark.createDataFrame([("b",), ("d",)], "tier string")
    rates = {r.tier: r.rate for r in scoring.detection_gate(rows, phantoms, "tier").collect()}
    assert rates == {"a": 0.5, "b": 0.5, "d": 0.0}


def test_repeats_need_two_measured_samples(spark):
    rows = spark.createDataFrame([("g", 1.0, 1.0), ("g", None, 1.0), ("h", 1.0, 1.0), ("h", 1.009, 1.0), ("h", None, 1.0), ("i", 1.0, 1.0)], "g string, v double, t double")
    got = {r.g: (r.n_measured, r.spread, r.gate_pass) for r in scoring.repeatability(rows, ["g"], "v", "t").collect()}
    assert got["g"] == (1, None, False) and got["h"][0] == 2 and got["h"][2] is True and "i" not in got


def test_empty_set_scores(spark):
    some, none = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([], "k int")
    score = lambda a, b: tuple(audit.set_scores(a, b).first()[c] for c in ("precision", "recall", "f1"))
    assert score(none, none) == (1.0, 1.0, 1.0) and score(some, none) == (0.0, 0.0, None) and score(some, some) == (1.0, 1.0, 1.0)


def test_registration_coverage_and_fix(spark):
    models = spark.createDataFrame([(0, 20, 23), (1, 3, 23)], "m int, registered_images int, sampled int")
    got = audit.quality_summary(models, F.lit(23)).first()
    assert (got.largest, got.coverage_percent) == (20, 87.0)
    fix = spark.createDataFrame([("higher_is_better", 34.783, 86.957, True, 80.0, 90.0), ("lower_is_better", 34.783, 30.0, None, 25.0, 32.0), ("lower_is_better", 34.783, 30.0, True, 25.0, 32.0)], "direction string, before double, after double, after_gate_pass boolean, predicted_after double, acceptance_threshold double")
    up, unscored, down = audit.fix_evaluation(fix).collect()
    assert math.isclose(up.prediction_error, 6.957, abs_tol=1e-9) and math.isclose(up.actual_delta, 52.174, abs_tol=1e-9) and up.improved and up.moved_toward_threshold
    assert math.isclose(up.distance_after, 3.043, abs_tol=1e-9) and not up.threshold_satisfied and not up.fix_pass
    assert unscored.threshold_satisfied and not unscored.fix_pass and down.fix_pass and down.improved


# Printed dimensions in metres and spans of the traced outlines in pixels of one apartment's rooms.
APARTMENT = [
    (4.65, 4.04, 321, 174), (3.85, 5.8, 121, 184), (3.6, 3.5, 153, 178), (4.62, 4.05, 235, 234), (7.27, 4.1, 218, 106), (10.42, 8.5, 404, 334),
    (4.78, 4.6, 190, 158), (3.17, 3.46, 92, 109), (2.0, 4.3, 65, 136), (3.94, 2.0, 198, 85), (2.0, 2.9, 79, 170),
]


def brute_fit(rows, independent):
    best = None
    for mask, flips in enumerate(itertools.product((0, 1), repeat=len(rows))):
        x = np.array([r[f] for r, f in zip(rows, flips, strict=True)])
        y = np.array([r[1 - f] for r, f in zip(rows, flips, strict=True)])
        w, h = np.array([r[2] for r in rows], float), np.array([r[3] for r in rows], float)
        sx, sy = ((w @ x) / (x @ x), (h @ y) / (y @ y)) if independent else [(w @ x + h @ y) / (x @ x + y @ y)] * 2
        e = np.concatenate([(w / sx - x) / x, (h / sy - y) / y]) * 100
        if best is None or np.sqrt(np.mean(e**2)) < best[0] - 1e-9:
            best = np.sqrt(np.mean(e**2)), mask, sx, sy, np.mean(np.abs(e)), np.max(np.abs(e))
    return best


def test_scale_of_a_traced_plan(spark):
    rooms = spark.createDataFrame([(k, float(a), float(b), float(w), float(h)) for k, (a, b, w, h) in enumerate(APARTMENT)], "ordinal int, a double, b double, w double, h double")
    got = {r.fit: r for r in audit.orientation_search(rooms, len(APARTMENT)).collect()}
    for fit, independent in (("uniform", False), ("independent", True)):
        want = brute_fit(APARTMENT, independent)
        assert np.allclose([got[fit][c] for c in ("rms", "mask", "scale_x", "scale_y", "mean", "most")], want, rtol=1e-9)
    assert round(got["independent"].rms, 3) == 27.594
    chosen = audit.orientation_rooms(rooms, audit.orientation_search(rooms, 11), 11).where("fit = 'uniform' AND ordinal = 0").first()
    assert math.isclose(chosen.size_x * chosen.scale_x, 321.0)
    spaces = spark.createDataFrame([("a", [3.0, 4.0], [[0.0, 0.0], [9.0, 1.0], [2.0, 5.0]]), ("b", [3.0, None], [[0.0, 0.0], [9.0, 1.0], [2.0, 5.0]]), ("c", [3.0, 4.0], [[0.0, 0.0]]), ("d", None, None)], "room_id string, dimensions_m array<double>, vertices array<array<double>>")
    assert [tuple(r) for r in audit.dimensioned_spans(spaces).collect()] == [("a", 3.0, 4.0, 9.0, 5.0)]


def test_dimension_labels(spark):
    rows = [("a", [1.0, 2.0], [1.0, 2.0]), ("b", [1.0, 2.0], [1.0, 2.5]), ("c", [1.0, None], [1.0, 2.0]), ("d", [None, None], [None, None]), ("e", [1.0, 2.0], [1.0]), ("f", [1.0], None), ("g", None, [1.0]), ("h", [1.0, None], [1.0, None])]
    report = audit.dimension_report(spark.createDataFrame(rows, "k string, t array<double>, l array<double>"), "t", "l")
    assert {r.k: (r.status, r.unavailable_axes, r.differences) for r in report.collect()} == {
        "a": ("consistent", 0, [0.0, 0.0]), "b": ("unavailable", 0, [0.0, 0.5]), "c": ("different_or_unscorable", 0, [0.0]), "d": ("unavailable", 2, None),
        "e": ("missing_or_incompatible", None, None), "f": ("missing_or_incompatible", None, None), "h": ("consistent", 1, [0.0]),
    }
    total = audit.dimension_summary(report).first()
    assert (total.n_spaces, total.n_consistent) == (7, 2) and math.isclose(total.mean_difference, 0.5 / 6)


def test_damage_regions_and_work(spark):
    rows = [("/p/a b.png", 1, 100, 80, "Crack_Damage", 0.25, 50.0, 40.0, 20.0, 10.0), ("/p/a b.png", 2, 100, 80, "water_damage", 0.2, 50.0, 40.0, 20.0, 10.0), ("/p/a b.png", 3, 100, 80, "rust_damage", 0.9, 0.0, 0.0, 20.0, 10.0), ("/p/a b.png", 4, 100, 80, None, 1.2, 500.0, 0.0, 20.0, 10.0)]
    boxes = spark.createDataFrame(rows, "image_path string, position int, image_width int, image_height int, class string, confidence double, x double, y double, width double, height double")
    token = "a_b_" + hashlib.sha256(b"/p/a b.png").hexdigest()[:8]
    got = {r.position: (r.region_id, r.damage_class, r.extent, r.unit) for r in nested.damage_regions(boxes).collect()}
    assert got == {1: (f"damage_{token}_001", "crack", 20.0, "px"), 3: (f"damage_{token}_003", "rust", 50.0, "px^2")}
    scaled = nested.damage_regions(boxes, spark.createDataFrame([("/p/a b.png", 0.1)], "image_path string, m_per_px double"))
    assert {r.position: (r.extent, r.unit) for r in scaled.collect()} == {1: (2.0, "m"), 3: (0.5, "m^2")}
    lines = {r.item_id: r.description for r in nested.scope_lines(scaled).collect()}
    assert lines[f"scope_{token}_001"].startswith("Review, prepare, and seal") and lines[f"scope_{token}_003"] == "Review and repair visible rust damage; confirm scope on site."


# --- keyed, stats ----------------------------------------------------------------------


def test_last_and_first(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b")], "k string, o int, v string")
    assert keyed.last_wins(rows, ["k"], ["o"]).first().v == "b" and keyed.first_wins(rows, ["k"], ["o"]).first().v == "a"


def test_sampled_frames(spark):
    for total, fps, wanted, cap in ((3000, 30.0, 4.0, 60), (100, 30.0, 4.0, 60), (1000, 25.0, 30.0, 7), (97, 10.0, 5.0, 1), (50, 2.0, 1.0, 25), (3, 30.0, 4.0, 60)):
        chosen = list(range(0, total, max(1, round(fps / wanted))))
        want = chosen if len(chosen) <= cap else [0] if cap == 1 else sorted({chosen[round(k * (len(chosen) - 1) / (cap - 1))] for k in range(cap)})
        frames = spark.range(total).withColumnRenamed("id", "k")
        assert sorted(r.k for r in stats.sampled_frames(frames, ["k"], fps, wanted, cap).collect()) == want


def test_spaced_equals_truncated_linspace(spark):
    for total, count in ((10, 4), (97, 13), (5, 9), (50, 1), (1, 3)):
        rows = spark.range(total).withColumnRenamed("id", "k")
        got = sorted(r.k for r in stats.spaced(rows, ["k"], count).collect())
        assert got == (list(range(total)) if total <= count else sorted({int(k * (total - 1) / max(1, count - 1)) for k in range(count)}))


# --- polygons --------------------------------------------------------------------------

ring_points = st.lists(st.tuples(st.floats(-50, 50), st.floats(-50, 50)), min_size=3, max_size=9)


@settings(max_examples=100, deadline=None)
@given(ring_points, st.floats(0, 6.28))
def test_area_is_invariant_under_rotation(points, angle):
    p = np.array(points)
    r = np.array([[math.cos(angle), -math.sin(angle)], [math.sin(angle), math.cos(angle)]])
    assert math.isclose(abs(polygon.shoelace(p)), abs(polygon.shoelace(p @ r.T)), abs_tol=1e-6)


def test_clip_and_stitch(spark):
    square = lambda x, y, s: np.array([[x, y], [x + s, y], [x + s, y + s], [x, y + s]], float)
    assert math.isclose(polygon.clip_convex(square(0, 0, 4), square(3, 3, 4)), 1.0) and polygon.clip_convex(square(0, 0, 1), square(5, 5, 1)) == 0
    rows = [("p", k, n, v.tolist()) for k, (n, v) in enumerate({"a": square(0, 0, 3), "b": square(3, 0, 3), "c": square(2, 2, 3), "d": square(0, 0, 0.1)}.items())]
    got = {r.candidate_id: r for r in polygon.stitch(spark.createDataFrame(rows, "property_id string, ordinal int, candidate_id string, vertices array<array<double>>")).collect()}
    assert got["b"].adjacent == ["a"] and got["b"].status == "included_candidate"
    assert got["c"].status == "excluded_overlap" and set(got["c"].conflicts) == {"a", "b"} and got["d"].status == "invalid"
    total = polygon.footprint(polygon.stitch(spark.createDataFrame(rows, "property_id string, ordinal int, candidate_id string, vertices array<array<double>>"))).first()
    assert math.isclose(total.value, 18.0) and total.status == "partial"


def test_greedy_queries_equal_one_scan(spark, small):
    from plumbline.plans import capture_queries as queries

    rows = queries.shapes(spark, small).orderBy("p_partkey").collect()
    want = {r[1]: r[2:] for r in polygon.stitch_scan([("p", r.name, r.vertices) for r in rows], 0.05, 0.5)}
    got = {r.candidate_id: (r.status, r.area_m2, sorted(r.conflicts), sorted(r.adjacent)) for r in queries.clip_greedy(spark, small).collect()}
    assert got == {k: (s, a, sorted(x), sorted(y)) for k, (s, a, x, y) in want.items()} and len({s for s, *_ in got.values()}) > 1
    points = queries.cloud(spark, small).orderBy("point_idx").collect()
    nodes, _ = graph.snap_points(np.array([(p.point_idx % 500 * 0.5 + p.x, p.point_idx // 500 * 0.5 + p.y) for p in points]), 0.2)
    at = {r.ordinal: r.node for r in queries.snap_greedy(spark, small).collect()}
    assert [at[p.point_idx] for p in points] == [points[nodes.index(n)].point_idx for n in nodes] and len(set(nodes)) < len(nodes)


def test_stitching_of_odd_rooms(spark):
    schema = "property_id string, ordinal int, candidate_id string, vertices array<array<double>>"
    rows = [("p", 1, "none", None), ("p", 2, "few", [[0.0, 0.0], [1.0, 1.0]]), ("p", 3, "nan", [[0.0, float("nan")], [1.0, 1.0], [0.0, 1.0]]), ("p", 4, "far", [[9e3, 0.0], [9e3 + 4, 0.0], [9e3 + 4, 4.0]]), ("q", 4, "far", [[9e3, 0.0], [9e3 + 4, 0.0], [9e3 + 4, 4.0]])]
    got = {(r.property_id, r.candidate_id): r.status for r in polygon.stitch(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("p", "none"): "invalid", ("p", "few"): "invalid", ("p", "nan"): "invalid", ("p", "far"): "included_candidate", ("q", "far"): "included_candidate"}
    assert polygon.stitch(spark.createDataFrame([], schema)).count() == 0


def test_raster_iou(spark):
    box = lambda n, x: (n, [[x, 0.0], [x + 3.0, 0.0], [x + 3.0, 2.0], [x, 2.0]])
    table = lambda x: spark.createDataFrame([box("r", x)], "name string, v array<array<double>>").withColumn("ring", polygon.ring("v"))
    px = lambda x: polygon.pixels(polygon.raster(table(x), "name", "ring"), "name")
    assert px(0.0).count() == 12  # border pixels count: (w + 1) * (h + 1)
    r = polygon.raster_iou(px(0.0), px(2.0), "name").first()
    assert (r.intersection, r.union) == (6, 18)


# --- graph and walls ---------------------------------------------------------------------


def test_cycles_of_a_small_graph(spark):
    edges = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 3, 1), (4, 3, 4), (5, 4, 1)], "edge_id int, a int, b int")
    want = {(1, 2, 3), (3, 4, 5), (1, 2, 4, 5)}
    assert {tuple(r.edges) for r in graph.short_cycles(edges, 8).collect()} == want
    assert {tuple(sorted(e)) for _, e in walls.simple_cycles([(1, 1, 2), (2, 2, 3), (3, 3, 1), (4, 3, 4), (5, 4, 1)], 8)} == want


def test_components_partition_the_cells(spark):
    rng = random.Random(2)
    cells = {(rng.randrange(25), rng.randrange(25)) for _ in range(220)}
    got = graph.cell_components(spark.createDataFrame(sorted(cells), "cx long, cy long")).collect()
    assert {(r.cx, r.cy) for r in got} == cells
    named = {(r.cx, r.cy): tuple(r.component) for r in got}
    for (x, y), c in named.items():
        near = [named[n] for n in ((x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)) if n in named]
        assert set(near) == {c} and c <= (x, y)


def test_faces_of_a_divided_room(spark):
    nodes = np.array([[0, 0], [2, 0], [4, 0], [4, 3], [2, 3], [0, 3]], float)
    faces = graph.planar_faces(nodes, {(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (0, 5), (1, 4)})
    areas = sorted(abs(polygon.shoelace(nodes[f])) for f in faces)
    assert areas == [6.0, 6.0, 12.0]


def test_planes_of_a_box(spark):
    from plumbline.plans import capture_queries

    points = walls.prepare(capture_queries.box_points(spark), "z", 0.0)
    rows = walls.wall_planes(points, "z", 0.0).collect()
    assert len(rows) == 4 and all(abs(n) > 0.99 or abs(n) < 0.1 for r in rows for n in r.horizontal_normal)
    assert sorted(round(r.length_m) for r in rows) == [3, 3, 4, 4]
    assert [r.candidate_id for r in rows] == [r.candidate_id for r in walls.wall_planes(points, "z", 0.0).collect()]


def test_gaps_lie_along_the_wall():
    rng = np.random.default_rng(0)
    a, h = rng.uniform(0, 6, 60_000), rng.uniform(0, 2.6, 60_000)
    out = ~((a > 2) & (a < 3) & (h > 0.8) & (h < 2.2))
    got = walls.gaps(a[out], h[out], 0.0)
    assert len(got) == 1 and abs(got[0]["width_m"] - 1.0) < 0.2 and abs(got[0]["height_m"] - 1.4) < 0.2 and abs(got[0]["along_m"] - 2.5) < 0.15


def test_open_ends_and_face_outline(spark):
    spans = [("c", 1, "w1", 0.0, 0.0, 0.7, 0.0), ("c", 2, "w2", 1.6, 0.0, 4.0, 0.0), ("c", 3, "w3", 4.0, 0.0, 4.0, 3.0), ("c", 4, "w4", 4.0, 3.0, 0.0, 3.0), ("c", 5, "w5", 0.0, 3.0, 0.0, 0.1)]
    schema = "capture_id string, ordinal int, candidate_id string, x0 double, y0 double, x1 double, y1 double"
    df = spark.createDataFrame(spans, schema)
    (gap,) = walls.gap_reviews(walls.endpoint_gaps(df), df).collect()
    assert (gap.candidate_a, gap.candidate_b, gap.candidate_class) == ("w1", "w2", "possible_doorway_or_wall_gap") and math.isclose(gap.gap_m, 0.9)
    whole = spark.createDataFrame([("c", 1, "w1", 0.0, 0.0, 4.0, 0.0), *spans[2:]], schema)
    ring = lambda x: spark.createDataFrame([("c", [[x, -1.0], [x + 6.0, -1.0], [x + 6.0, 4.0], [x, 4.0]])], "capture_id string, ring array<array<double>>")
    assert walls.boundary_faces(whole).count() == walls.boundary_faces(whole, ring(-1.0)).count() == 1
    assert walls.boundary_faces(whole, ring(9.0)).count() == 0 and walls.boundary_faces(whole.where("ordinal < 3")).count() == 0
    planes = spark.createDataFrame([("c", "w", [(0.9, 2.0, 1.0, 1.05, 30), (1.0, 1.0, 3.0, 1.2, 30), (0.1, 0.1, 1.0, 1.0, 9)])], "capture_id string, candidate_id string, gaps array<struct<width_m:double,height_m:double,along_m:double,above_floor_m:double,cells:int>>")
    voids = walls.surface_voids(planes)
    assert [r.candidate_class for r in voids.orderBy("candidate_id").collect()] == ["possible_doorway", "possible_window_or_wall_void", "unclassified_wall_void"]
    assert walls.opening_candidates(voids, walls.gap_reviews(walls.endpoint_gaps(df), df)).count() == 3


def test_snapping_by_grid_equals_all_centres(spark):
    rng = np.random.default_rng(2)
    points = rng.uniform(0, 3, (400, 2))
    nodes, centres = graph.snap_points(points, 0.2)
    kept, want = [], []
    for p in points:
        d = [math.hypot(*(c - p)) for c in kept]
        if d and min(d) <= 0.2:
            want.append(int(np.argmin(d)))
        else:
            want.append(len(kept))
            kept.append(p)
    assert nodes == want and np.allclose(centres, kept)


@pytest.mark.parametrize("cell", [None, 0.3, 50.0])
def test_crossings_by_cells_equal_all_pairs(spark, cell):
    rng = np.random.default_rng(11)
    ends = np.vstack([rng.uniform(-5, 5, (40, 4)), rng.integers(-3, 4, (40, 4)), np.c_[rng.integers(-3, 4, (10, 2)), np.zeros((10, 2))][:, [0, 1, 0, 2]], np.zeros((2, 4))]).tolist()
    rows = [(g, k, *map(float, e)) for g in "ab" for k, e in enumerate(ends)]
    df = spark.createDataFrame(rows, "capture_id string, ordinal int, x0 double, y0 double, x1 double, y1 double")
    want = set()
    for i, (ax, ay, bx, by) in enumerate(ends):
        for j in range(i + 1, len(ends)):
            cx, cy, dx, dy = ends[j]
            det = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if abs(det) >= 1e-7:
                t, u = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / det, ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / det
                if -1e-6 <= min(t, u) and max(t, u) <= 1 + 1e-6:
                    want.add((i, j))
    got = [(r.capture_id, r.i, r.j) for r in graph.crossings(df, cell=cell).collect()]
    assert len(got) == len(set(got)) and set(got) == {(g, i, j) for g in "ab" for i, j in want}
    assert graph.crossings(df.where("false")).count() == 0


def test_streams_in_one_pass_equal_each_alone(spark):
    rng = np.random.default_rng(12)
    left = spark.createDataFrame([(k, float(t)) for k, t in enumerate(rng.uniform(0, 50, 60))] + [(99, None)], "event long, t double")
    streams = {n: spark.createDataFrame([(k, float(t)) for k, t in enumerate(np.round(rng.uniform(0, 50, size), 1))], "id long, ts double") for n, size in (("a", 50), ("b", 90), ("c", 40), ("d", 200))}
    want = None
    for n, s in streams.items():
        one = asof.nearest(left, s, "event", "t", "id", "ts", 1.5).selectExpr("event", "t", f"id AS {n}_id", f"offset AS {n}_offset")
        want = one if want is None else want.join(one, ["event", "t"])
    got = asof.nearest_streams(left, streams, "event", "t", 1.5)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect())) and got.count() > 5


def test_snapping_by_cell_groups_equals_one_scan(spark):
    rng = np.random.default_rng(3)
    rows = [(g, k, float(x), float(y)) for g in ("a", "b") for k, (x, y) in enumerate(np.vstack([rng.uniform(0, 6, (150, 2)), rng.normal(3, 0.2, (60, 2)), [[0.3, 0.3], [0.3, 0.3]]]))]
    got = {(r.capture_id, r.ordinal): (r.node, r.x, r.y) for r in graph.snap(spark.createDataFrame(rows, "capture_id string, ordinal int, x double, y double").repartition(3), 0.2).collect()}
    for g in ("a", "b"):
        own = [r for r in rows if r[0] == g]
        nodes, centres = graph.snap_points(np.array([r[2:] for r in own]), 0.2)
        first = [nodes.index(n) for n in nodes]
        assert [got[g, k] for k in range(len(own))] == [(f, *centres[n].tolist()) for f, n in zip(first, nodes, strict=True)]
    assert graph.snap(spark.createDataFrame([], "capture_id string, ordinal int, x double, y double"), 0.2).count() == 0


def plain_gaps(spans, tolerance, farthest, most):
    """Open ends against all ends, by plain loops over one capture's spans (ordinal, name, x0, y0, x1, y1)."""
    nodes, at = graph.snap_points(np.array([p for s in spans for p in (s[2:4], s[4:6])], float), tolerance)
    arcs = [(nodes[2 * k + i], nodes[2 * k + 1 - i], k) for k in range(len(spans)) for i in (0, 1) if nodes[2 * k] != nodes[2 * k + 1]]
    degree = collections.Counter(a for a, _, _ in arcs)
    gap = lambda a, b: math.hypot(*(at[a] - at[b]))
    pairs = {tuple(sorted((a, b))) for a in degree for b in degree if a != b and 1 in (degree[a], degree[b]) and tolerance < gap(a, b) <= farthest and not any({a, b} == {x, y} for x, y, _ in arcs)}
    out = []
    for p, q in sorted(pairs):
        a, b = (p, q) if degree[p] == 1 else (q, p)
        one = next(k for x, _, k in arcs if x == a)
        other = min((gap(y, a), k) for x, y, k in arcs if x == b)[1]
        out.append((round(gap(a, b), 3), a, b, spans[one][1], spans[other][1]))
    return [(n + 1, r[3], r[4], r[0]) for n, r in enumerate(sorted(out)[:most])]


def test_endpoint_gaps_match_plain_loops(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g in range(6):
        ends = rng.integers(0, 12, (14, 4)) * 0.4 + rng.normal(0, 0.03, (14, 4))
        rows += [(f"g{g}", k, f"w{k}", *map(float, e)) for k, e in enumerate(ends)]
    df = spark.createDataFrame(rows, "capture_id string, ordinal int, candidate_id string, x0 double, y0 double, x1 double, y1 double")
    got = collections.defaultdict(list)
    for r in walls.endpoint_gaps(df, most=7).orderBy("capture_id", "gap").collect():
        got[r.capture_id].append((r.gap, r.candidate_a, r.candidate_b, round(r.gap_m, 3)))
    for g in range(6):
        assert got[f"g{g}"] == plain_gaps([r[1:] for r in rows if r[0] == f"g{g}"], 0.30, 1.5, 7)


def test_percentiles_of_groups(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(v)) for g in ("a", "b", None) for v in rng.integers(0, 40, 57)] + [("c", None), ("d", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {r.g: (r.q, r.m, r.p) for r in stats.percentiles(df, "v", {"q": 0.1, "m": 0.5, "p": 0.95}, ["g"]).collect()}
    for g in ("a", "b", None, "d"):
        assert np.allclose(got[g], np.quantile([v for k, v in rows if k == g], [0.1, 0.5, 0.95]))
    assert got["c"] == (None, None, None) and len(got) == 5
    every = stats.percentiles(df, "v", {"m": 0.5}).first().m
    assert math.isclose(every, float(np.quantile([v for _, v in rows if v is not None], 0.5)))
    assert stats.percentiles(df.where("false"), "v", {"m": 0.5}).first().m is None


def test_mirrored_fits_of_a_wall_merge():
    base = dict(height_m=2.0, point_count=10, merged_count=1, merged_points=10, length_m=2.0, area_m2=4.0)
    one = base | dict(horizontal_normal=[1.0, 0.0], horizontal_offset_m=-1.0, along=[1.0, 3.0])
    two = base | dict(horizontal_normal=[-1.0, 0.0], horizontal_offset_m=1.0, along=[-3.5, -1.5])
    (kept,) = walls.merge_duplicates([one, two])
    assert kept["along"] == [1.0, 3.5] and kept["merged_points"] == 20 and kept["endpoints"] == [[1.0, 1.0], [1.0, 3.5]]


def test_alignment_to_outline(spark):
    w = spark.createDataFrame([("c", "w1", 0.0, 0.0, 4.0, 0.0), ("c", "w2", 0.0, 9.0, 4.0, 9.0)], "capture_id string, candidate_id string, x0 double, y0 double, x1 double, y1 double")
    outline = spark.createDataFrame([("c", float(k) / 2, 0.05) for k in range(9)], "capture_id string, x double, y double")
    got = {r.candidate_id: r for r in walls.align_to_outline(w, outline).collect()}
    assert got["w1"].status == "aligned_boundary_candidate" and math.isclose(got["w1"].coverage, 1.0) and got["w2"].n == 0


def test_floor_returns(spark):
    from plumbline.plans import capture_queries

    poses = spark.createDataFrame([(0.0, 0.0, 1.5), (2.0, 1.0, 1.6)], "x double, y double, z double")
    axis, level, cells = pointcloud.floor_returns(capture_queries.box_points(spark), poses, 0.25)
    assert axis == "z" and abs(level) < 0.02 and cells.select("component").distinct().count() == 1


def test_axis_angle_is_a_rotation(spark):
    r = spark.range(1).select(pointcloud.rotation_from_axis_angle(F.lit(0.3), F.lit(-0.2), F.lit(0.5)).alias("r")).first().r
    m = np.array(r).reshape(3, 3)
    assert np.allclose(m @ m.T, np.eye(3)) and math.isclose(np.trace(m), 1 + 2 * math.cos(math.sqrt(0.38)))


# --- nested, validation ------------------------------------------------------------------


def test_measurements_and_envelope(spark):
    df = spark.range(1).select(nested.measurement(F.lit(2.0), "m", "tape", F.lit(1.9), F.lit(2.1), 0.95).alias("a"), nested.unavailable("m", "none").alias("b"))
    r = df.first()
    assert r.a.status == "complete" and r.a.interval.upper == 2.1 and r.b.status == "unavailable" and r.b.value is None and r.b.interval is None
    doc = json.loads(nested.envelope(df, status=F.lit("complete")).select(F.to_json("result")).first()[0])
    assert doc["status"] == "complete" and doc["rooms"] == []


def test_clean_before_write(spark, tmp_path):
    good = spark.createDataFrame([(1, 2.0)], "k int, v double")
    writers.results(good, validate.positive(good, "k", "v", "v"), str(tmp_path / "ok"))
    assert spark.read.json(str(tmp_path / "ok")).count() == 1
    bad = spark.createDataFrame([(1, -2.0), (2, None)], "k int, v double")
    assert validate.positive(bad, "k", "v", "v").count() == 2
    with pytest.raises(Exception, match="2 violations"):
        writers.results(bad, validate.positive(bad, "k", "v", "v"), str(tmp_path / "no"))


def test_schema_violations(spark):
    docs = spark.createDataFrame([("a", '{"x":{"y":1},"s":"t"}'), ("b", '{"x":[],"s":5}')], "k string, json string")
    got = [(r.k, r.path) for r in validate.schema_violations(docs, "k", "json", {"$.x.y": "number", "$.s": "string"}).collect()]
    assert got == [("b", "$.s"), ("b", "$.x.y")]


# --- sources and sinks -------------------------------------------------------------------


def test_readers(spark, tmp_path):
    (tmp_path / "o.csv").write_text("﻿timestamp, frame, x, y, z, qx, qy, qz, qw, fx, fy, cx, cy\n0.5, 1, 1, 2, 3, 0, 0, 0, 1, 9, 9, 4, 3\n")
    r = readers.odometry(spark, str(tmp_path / "o.csv")).first()
    assert (r.timestamp, r.frame, r.z, r.fx) == (0.5, "1", 3.0, 9.0)
    (tmp_path / "t.traj").write_text("# c\n\n2 0 0 0 1 1 1\n1 0 0 0 2 2 2\n")
    assert [r.ts for r in readers.trajectory(spark, str(tmp_path / "t.traj")).collect()] == [1.0, 2.0]
    (tmp_path / "bad.traj").write_text("1 2 3\n")
    with pytest.raises(Exception, match="7 finite"):
        readers.trajectory(spark, str(tmp_path / "bad.traj")).collect()
    (tmp_path / "p.pincam").write_text("256 192 200 200 128 96\n")
    assert readers.pincam(spark, str(tmp_path / "p.pincam")).first().fy == 200
    (tmp_path / "images.txt").write_text("# x\n1 1 0 0 0 1 2 3 1 kitchen__a.jpg\n10.0 20.0 -1 30.0 40.0 5\n")
    r = readers.colmap_images(spark, str(tmp_path / "images.txt")).collect()
    assert [(x.image_id, x.image_name, x.tz) for x in r] == [(1, "kitchen__a.jpg", 3.0)]
    (tmp_path / "cam").mkdir()
    (tmp_path / "cam" / "7.json").write_text('{"fx": 5.0,\n "t_03": 1.5}')
    r = readers.cameras(spark, str(tmp_path / "cam")).first()
    assert (r.frame_id, r.fx, r.t_03, r.width) == ("7", 5.0, 1.5, None)
    (tmp_path / "d.json").write_text('{"a": 1}')
    assert json.loads(readers.json_documents(spark, str(tmp_path / "d.json")).first().json) == {"a": 1}
    (tmp_path / "l.json").write_text("[1]")
    with pytest.raises(Exception, match="JSON object"):
        readers.json_documents(spark, str(tmp_path / "l.json")).collect()


def test_empty_odometry_is_an_error(spark, tmp_path):
    (tmp_path / "o.csv").write_text("timestamp,frame,x,y,z,qx,qy,qz,qw,fx,fy,cx,cy\n")
    with pytest.raises(Exception, match="no odometry rows"):
        readers.odometry(spark, str(tmp_path / "o.csv")).collect()


def test_names_and_types(spark):
    df = spark.createDataFrame([("x/a_12.50.png",), ("x/a_b.png",)], "p string")
    assert [r[0] for r in df.select(readers.name_timestamp(F.col("p"), strict=False)).collect()] == [12.5, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(readers.name_timestamp(F.col("p"))).collect()
    bundle = ["rgb.mp4", "odometry.csv", "camera_matrix.csv", "depth/1.png", "confidence/1.png"]
    keys = ["keyframes/depth/1.png", "keyframes/corrected_cameras/1.json", "keyframes/images/1.jpg"]
    scan = ["lowres_wide.traj", "lowres_wide/1.png", "lowres_depth/1.png", "confidence/1.png", "lowres_wide_intrinsics/1.pincam"]
    layouts = {"bundle": bundle, "keys": keys, "scan": scan, "no_video": bundle[1:], "no_cameras": [keys[0], keys[2]], "b": ["x/v.MOV", "i.jpg"], "c": ["i.heic"], "d": ["n.txt"], "e": ["s.ply"], "w": ["i.webp"], "f.mov": [""], "g.txt": [""]}
    files = spark.createDataFrame([(k, f) for k, fs in layouts.items() for f in fs], "capture string, relative string")
    got = {r.capture: (r.capture_type, r.problem) for r in readers.capture_type(files, files.select("capture").distinct()).collect()}
    assert {k: v[0] for k, v in got.items()} == {"bundle": "rgbd", "keys": "rgbd", "scan": "rgbd", "no_video": "photo", "no_cameras": "photo", "b": "video", "c": "photo", "d": None, "e": "lidar", "w": None, "f.mov": "video", "g.txt": None}
    assert got["d"][1] == "could not determine capture type" and got["e"][1] and got["g.txt"][1] == "unsupported capture file type" and got["c"][1] is None
    rooms = spark.createDataFrame([("/r/k.jpg",), ("/r/hall/1.jpg",), ("/r/a/b/1.jpg",)], "p string")
    assert [r[0] for r in rooms.select(nested.room_id(F.col("p"), F.lit("/r"))).collect()] == ["k", "hall", None]


def test_raster_and_ply(spark, tmp_path):
    data = np.arange(12, dtype="<u2").tobytes()
    px = readers.raster_pixels(spark.createDataFrame([("f", 4, 3, bytearray(data))], "frame_id string, width int, height int, data binary"), 2).collect()
    assert {(r.u, r.v, r.value) for r in px} == {(0, 0, 0), (2, 0, 2), (0, 2, 8), (2, 2, 10)}
    points = spark.createDataFrame([(0, 1.0, 2.0, 3.0, 1, 2, 3), (1, 0.5, 0.0, -1.0, 9, 8, 7)], "point_idx long, x double, y double, z double, r int, g int, b int")
    writers.ply(points, str(tmp_path / "ply"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "ply").glob("part-*"))).splitlines()
    assert lines[0] == "ply" and lines[2] == "element vertex 2" and lines[-2:] == ["1.000000 2.000000 3.000000 1 2 3", "0.500000 0.000000 -1.000000 9 8 7"]


def test_geojson(spark):
    df = spark.createDataFrame([("r1", [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]])], "room_id string, c array<array<array<double>>>")
    doc = json.loads(writers.feature_collection([writers.features(df, "room", "Polygon", "c", "room_id")]).first().document)
    assert doc["features"][0]["properties"] == {"feature_type": "room", "room_id": "r1"}
    rings = spark.createDataFrame([("r1", [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]])], "k string, v array<array<double>>").withColumn("ring", polygon.ring("v"))
    assert writers.svg(rings, "k", "ring").first().document.count("<polygon") == 1


# --- streaming ---------------------------------------------------------------------------


def test_streaming_first_use_and_spread(spark, tmp_path):
    from plumbline.streaming import matching

    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 00:00:10", 3.0), ("b", "2024-01-01 00:00:20", 2.0)], "k string, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = matching.first_use(source(), "k", "ts", "1 hour").writeStream.format("memory").queryName("first_use").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.k for r in spark.table("first_use").collect()) == ["a", "b"]
    q = matching.windowed_spread(source(), "ts", "k", "v", "1 minute", "1 hour").writeStream.format("memory").queryName("spread").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.k: r.spread for r in spark.table("spread").collect()} == {"a": 2.0, "b": 0.0}


def test_streaming_nearest(spark, tmp_path):
    from plumbline.streaming import matching

    def put(name, columns, *rows):
        spark.createDataFrame(list(rows), columns).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    left, right = "u string, ts string, k long", "u string, ts string, rk long"
    put("l", left, ("a", "2024-01-01 00:00:10", 1), ("a", "2024-01-01 00:00:20", 2))
    put("r", right, ("a", "2024-01-01 00:00:09.96", 11), ("a", "2024-01-01 00:00:10.045", 12), ("a", "2024-01-01 00:00:20.03", 13))
    for hour in (1, 2):  # later rows move the watermark
        put("l", left, ("z", f"2024-01-01 0{hour}:00:00", 9 + hour))
        put("r", right, ("z", f"2024-01-01 0{hour}:00:00", 99 + hour))
    read = lambda name, schema: spark.readStream.schema(schema.replace("ts string", "ts timestamp")).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    got = matching.nearest(read("l", left), read("r", right).withColumnRenamed("ts", "rts"), "u", "k", "ts", "rk", "rts", 0.05, "1 minute")
    q = got.writeStream.format("memory").queryName("nearest").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert {(r.k, r.rk) for r in spark.table("nearest").collect()} >= {(1, 11), (2, 13)}
