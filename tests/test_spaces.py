"""Plan documents with faults of every kind, and overlap on runs against pixels."""

import collections
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import polygon, spaces

SQUARE = [[1, 1], [5, 1], [5, 5], [1, 5], [1, 1]]


def reference(**changes):
    return {"source": {"image_width_px": 20, "image_height_px": 10, "coordinate_frame": "px"}, "rooms": [{"room_id": "a", "polygon_px": SQUARE}], "connectors": [{"connector_id": "h", "polygon_px": SQUARE}], "adjacency": [{"space_a": "h", "space_b": "a"}]} | changes


def feature(ring=SQUARE, kind="Polygon", **properties):
    return {"type": "Feature", "properties": properties, "geometry": {"type": kind, "coordinates": [ring]}}


def candidate(*features, **changes):
    edges = {"properties": {"feature_type": "room_adjacency", "room_id": "never", "edges": [{"space_a": "a", "space_b": "h"}, {"space_a": 1, "space_b": "h"}, "no", {"space_a": "a"}]}}
    return {"type": "FeatureCollection", "coordinate_reference": "px", "features": [feature(room_id="a", geometry_status="manual_reference_trace"), feature(connector_id="h", geometry_status="manual_reference_trace"), edges, *features]} | changes


def documents(spark, *pairs):
    text = lambda x: x if x is None or isinstance(x, str) else json.dumps(x)
    return spark.createDataFrame([(k, text(a), text(b)) for k, (a, b) in enumerate(pairs)], "plan_id int, reference string, candidate string")


def test_sound_plan(spark):
    docs = documents(spark, (reference(), candidate()), (reference(), candidate(feature([[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], room_id="b"))))
    assert spaces.violations(docs).count() == 0
    one, two = spaces.compared(docs).orderBy("plan_id").collect()
    assert (one.matched, one.missing_ids, one.extra_ids, one.precision, one.recall, one.f1, one.mean_iou, one.status) == (2, [], [], 1.0, 1.0, 1.0, 1.0, "self_consistency_only")
    assert (two.candidate_spaces, two.extra_ids, two.compared_spaces, two.status) == (3, ["b"], 2, "reference_comparison")


def test_every_fault(spark):
    far, short, wild = [[1, 1], [20, 1], [5, 5], [1, 1]], SQUARE[:3], [[1, 1], ["x", 1], [5, 5], [1, 1]]
    cases = [
        (("{", None), {("reference", "must be a JSON object"), ("candidate", "must be a JSON object")}),
        (("[1]", candidate()), {("reference", "must be a JSON object")}),
        ((reference(rooms={}), candidate()), {("reference", "rooms must be an array")}),
        ((reference(rooms=None), candidate()), {("reference", "rooms must be an array")}),
        ((reference(rooms=[3, {}, {"room_id": ""}, {"room_id": 4}, {"connector_id": "x"}]), candidate()), {("reference", "contains a non-object entry"), ("reference", "contains an entry without an ID")}),
        ((reference(connectors=[{"connector_id": "a", "polygon_px": SQUARE}]), candidate()), {("reference", "duplicate space ID")}),
        ((reference(rooms=[], connectors=[]), candidate()), {("reference", "has no spaces")}),
        ((reference(source={"image_width_px": 20.5, "image_height_px": 10, "coordinate_frame": "px"}), candidate()), {("reference", "must declare a positive image size")}),
        ((reference(source={"image_width_px": 20, "image_height_px": -1}), candidate(coordinate_reference=None)), {("reference", "must declare a positive image size")}),
        ((reference(), candidate(type="Feature")), {("candidate", "must be a FeatureCollection")}),
        ((reference(), {"type": "FeatureCollection", "coordinate_reference": "px"}), {("candidate", "must be a FeatureCollection")}),
        ((reference(), candidate(features=[])), {("candidate", "contains no identified space features")}),
        ((reference(), candidate({"properties": []}, 7)), {("candidate", "feature must have a properties object")}),
        ((reference(), candidate(feature(room_id="", connector_id="h"))), {("candidate", "duplicate space ID")}),
        ((reference(), candidate(feature(room_id=False), feature(room_id=0), feature(other="x"))), set()),
        ((reference(), candidate(feature(room_id=7), feature(room_id=True, connector_id="t"))), set()),
        ((reference(), candidate(coordinate_reference="m")), {("candidate", "coordinate frames differ")}),
        ((reference(rooms=[{"room_id": "a", "polygon_px": short}]), candidate(feature(far, room_id="b"), feature(wild, room_id="c"), feature(SQUARE, "Point", room_id="d"))), {("reference", "ring"), ("candidate", "ring")}),
        ((reference(rooms=[{"room_id": "a"}]), candidate()), {("reference", "ring")}),
    ]
    found = collections.defaultdict(set)
    details = collections.defaultdict(list)
    for r in spaces.violations(documents(spark, *[pair for pair, _ in cases])).collect():
        found[r.plan_id].add((r.side, r.rule))
        details[r.plan_id, r.rule].append(r.detail)
    for k, (_, want) in enumerate(cases):
        assert found[k] == want, (k, found[k])
    assert len(details[4, "contains an entry without an ID"]) == 4 and details[4, "contains a non-object entry"] == ["rooms 0"]
    assert sorted(details[17, "ring"]) == ["a needs a closed polygon ring with at least 3 vertices", "b has coordinates outside the image", "c has invalid polygon coordinates", "d must have Polygon geometry"]
    ids = {r.space_id for r in spaces.candidate_spaces(spaces.parsed(documents(spark, *[cases[15][0]]))).collect()}
    assert ids == {"a", "h", "7", "True"}
    assert spaces.violations(documents(spark, (None, None)).where("false")).count() == 0


@pytest.mark.parametrize("width", [4, 64])
def test_runs_share_what_pixels_share(spark, width):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(14):
        x, y, w, h = rng.uniform(0, 12, 2).tolist() + rng.uniform(0.3, 9, 2).tolist()
        ring = [[x, y], [x + w, y], [x + w, y + h], [x, y + h]] if k % 3 else [[x, y], [x + w, y + h / 3], [x + w / 2, y + h]]
        rows.append((f"s{k}", ring))
    shapes = spark.createDataFrame(rows, "name string, v array<array<double>>").withColumn("ring", polygon.ring("v"))
    runs = polygon.raster(shapes, "name", "ring")
    whole = polygon.disjoint_runs(runs, "name")
    px = collections.defaultdict(set)
    for r in polygon.pixels(runs, "name").collect():
        px[r["name"]].add((r.y, r.x))
    assert {r["name"]: r.n for r in whole.groupBy("name").agg(F.sum(polygon.run_pixels()).alias("n")).collect()} == {k: len(v) for k, v in px.items()}
    got = {(r.a, r.b): r.pixels for r in polygon.run_pairs(whole, "name", width).collect()}
    assert got == {(a, b): len(px[a] & px[b]) for a in px for b in px if a < b and px[a] & px[b]}
    moved = whole.withColumns({"x0": F.col("x0") + 2, "x1": F.col("x1") + 2, "y": F.col("y") + 1})
    iou = {r["name"]: (r.intersection, r.union) for r in polygon.runs_iou(whole, moved, "name").collect()}
    other = {k: {(y + 1, x + 2) for y, x in v} for k, v in px.items()}
    assert iou == {k: (len(px[k] & other[k]), len(px[k] | other[k])) for k in px}
