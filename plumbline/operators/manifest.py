"""Rule sets for the documents of a benchmark: each returns violation rows (rule, key, message)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import validate as v

TIERS = ("photo", "video", "lidar")


@dataclass
class Manifest:
    """A benchmark's declaration as tables; those with a default may be absent.

    rooms (room_id, ceiling_height_m, floor_area_m2), walls (room_id, wall_id, length_m), openings (room_id,
    opening_id, width_m), runs (run_idx, tier, room_id, capture_id, result_json, result_found), wall_matches
    (run_idx, ground_truth_wall_id, prediction_surface_id), opening_matches (run_idx, ground_truth_opening_id),
    document (benchmark_id, footprint_m2), adjacency (room_a, room_b), connectors (room_id), hypothesis_matches
    (run_idx, ground_truth_room_id, prediction_candidate_id), side_matches (run_idx, ground_truth_room_id,
    ground_truth_wall_id, prediction_candidate_id, candidate_side_index), incumbent (app, version), artifacts
    (path, found), incumbent_rooms (room_id, capture_id, ceiling_height_m, floor_area_m2), incumbent_walls
    (room_id, wall_id, length_m), incumbent_openings (room_id, opening_id, width_m), damage (example_id, room_id,
    damage_class, surface_id, extent_m2), damage_regions (example_id, image_path, image_found, polygon_px).
    """

    rooms: DataFrame
    walls: DataFrame
    openings: DataFrame
    runs: DataFrame
    wall_matches: DataFrame
    opening_matches: DataFrame
    document: DataFrame | None = None
    adjacency: DataFrame | None = None
    connectors: DataFrame | None = None
    hypothesis_matches: DataFrame | None = None
    side_matches: DataFrame | None = None
    incumbent: DataFrame | None = None
    artifacts: DataFrame | None = None
    incumbent_rooms: DataFrame | None = None
    incumbent_walls: DataFrame | None = None
    incumbent_openings: DataFrame | None = None
    damage: DataFrame | None = None
    damage_regions: DataFrame | None = None


def positive_or_null(df: DataFrame, key: str | Column, column: str, rule: str) -> DataFrame:
    return v.positive(df.where(F.col(column).isNotNull()), key, column, rule)


def matched(df: DataFrame, keys: Sequence[str], to: DataFrame, rule: str, message: str) -> DataFrame:
    """Rows whose composite key is not in `to`; a null in it finds nothing."""
    lost = df.join(to.select(*keys).distinct(), list(keys), "left_anti")
    return v.holds(lost, F.concat_ws("/", *keys), F.lit(False), rule, message).distinct()


def objects(df: DataFrame, id_column: str, size: str, name: str) -> list[DataFrame]:
    """Ids not blank and unique in their room, sizes positive."""
    key: Column = F.concat_ws("/", "room_id", id_column)
    return [
        v.not_blank(df, key, id_column, f"{name}_id"), v.unique(df.where(F.col(id_column).isNotNull()), ["room_id", id_column], f"{name}_id"),
        v.positive(df, key, size, f"{name}_size"),
    ]


def room_sizes(df: DataFrame, name: str) -> list[DataFrame]:
    return [positive_or_null(df, "room_id", c, f"{name}_{c}") for c in ("ceiling_height_m", "floor_area_m2")]


def benchmark(m: Manifest) -> DataFrame:
    """All violations at once: ids present and unique, numbers positive, every reference resolved."""
    rooms, runs, checks = m.rooms, m.runs, []
    none = rooms.agg(F.count(F.lit(1)).alias("n"))
    checks += [v.holds(none, F.lit("rooms"), F.col("n") > 0, "rooms", "must not be empty"), v.not_blank(rooms, "room_id", "room_id", "room_id"), v.unique(rooms, ["room_id"], "room_id"), *room_sizes(rooms, "room")]
    checks += [*objects(m.walls, "wall_id", "length_m", "wall"), v.refers(m.walls, "room_id", rooms, "room_id", "wall_room")]
    checks += [*objects(m.openings, "opening_id", "width_m", "opening"), v.refers(m.openings, "room_id", rooms, "room_id", "opening_room")]
    checks += [v.one_of(runs, "run_idx", "tier", TIERS, "run_tier"), matched(runs.withColumn("room_id", F.coalesce("room_id", F.lit(""))), ["room_id"], rooms, "run_room", "refers to nothing"), v.not_blank(runs, "run_idx", "result_json", "run_result")]
    if "result_found" in runs.columns:
        checks.append(v.holds(runs.where(F.trim("result_json") != ""), "run_idx", F.col("result_found"), "run_result", "was not found"))
    for df, name, columns in (
        (m.wall_matches, "wall_match", ("ground_truth_wall_id", "prediction_surface_id")), (m.opening_matches, "opening_match", ("ground_truth_opening_id",)),
        (m.hypothesis_matches, "hypothesis_match", ("ground_truth_room_id", "prediction_candidate_id")), (m.side_matches, "side_match", ("ground_truth_room_id", "ground_truth_wall_id", "prediction_candidate_id", "candidate_side_index")),
    ):
        if df is None:
            continue
        whole = F.lit(True)
        for c in columns:
            whole = whole & F.col(c).isNotNull()
        checks += [v.refers(df, "run_idx", runs, "run_idx", f"{name}_run"), v.holds(df, "run_idx", whole, name, "must include " + ", ".join(columns))]
        if "ground_truth_room_id" in columns:
            checks.append(v.refers(df, "ground_truth_room_id", rooms, "room_id", f"{name}_room"))
    if m.side_matches is not None:
        sides = m.side_matches.where("candidate_side_index IS NOT NULL")
        checks.append(v.holds(sides, "run_idx", F.col("candidate_side_index") >= 0, "side_match_index", "must be a nonnegative integer"))
        named = m.side_matches.where("ground_truth_wall_id IS NOT NULL").select(F.col("ground_truth_room_id").alias("room_id"), F.col("ground_truth_wall_id").alias("wall_id"))
        checks.append(matched(named, ["room_id", "wall_id"], m.walls, "side_match_wall", "must be a wall of its room"))
    if m.document is not None:
        checks += [v.not_blank(m.document, F.lit("document"), "benchmark_id", "benchmark_id"), positive_or_null(m.document, F.lit("document"), "footprint_m2", "footprint")]
    if m.adjacency is not None:
        checks.append(v.holds(m.adjacency, F.concat_ws("/", "room_a", "room_b"), F.col("room_a").isNotNull() & F.col("room_b").isNotNull(), "adjacency", "must name two rooms"))
    if m.connectors is not None:
        checks.append(v.holds(m.connectors, F.lit("connectors"), F.col("room_id").isNotNull(), "connector", "must be room ids"))
    return v.report(checks + incumbent(m) + damage(m))


def incumbent(m: Manifest) -> list[DataFrame]:
    """The other product's export: named, with its files, each room once and tied to a lidar run, its objects among the room's own."""
    checks = []
    if m.incumbent is not None:
        checks += [v.not_blank(m.incumbent, F.lit("incumbent"), c, f"incumbent_{c}") for c in ("app", "version")]
        files = (m.artifacts if m.artifacts is not None else m.incumbent.select(F.col("app").alias("path")).where("false")).agg(F.count(F.lit(1)).alias("n"))
        checks.append(v.holds(m.incumbent.crossJoin(files), F.lit("incumbent"), F.col("n") > 0, "incumbent_artifact", "must list the saved exports"))  # one row each
    if m.artifacts is not None:
        checks += [v.not_blank(m.artifacts, "path", "path", "incumbent_artifact"), v.holds(m.artifacts.where(F.trim("path") != ""), "path", F.col("found"), "incumbent_artifact", "was not found")]
    if m.incumbent_rooms is not None:
        rooms = m.incumbent_rooms
        checks += [matched(rooms, ["room_id"], m.rooms, "incumbent_room", "refers to nothing"), v.unique(rooms.where("room_id IS NOT NULL"), ["room_id"], "incumbent_room"), v.not_blank(rooms, "room_id", "capture_id", "incumbent_capture"), *room_sizes(rooms, "incumbent")]
        lidar = m.runs.where("tier = 'lidar' AND capture_id IS NOT NULL")
        checks.append(matched(rooms.where(F.trim("capture_id") != ""), ["room_id", "capture_id"], lidar, "incumbent_capture", "must be a lidar run of the room"))
    for df, truth, key, size, name in ((m.incumbent_walls, m.walls, "wall_id", "length_m", "incumbent_wall"), (m.incumbent_openings, m.openings, "opening_id", "width_m", "incumbent_opening")):
        if df is not None:
            checks += [*objects(df, key, size, name), matched(df.where(F.col(key).isNotNull()), ["room_id", key], truth, f"{name}_truth", "must be an object of its room")]
    return checks


def damage(m: Manifest) -> list[DataFrame]:
    """Staged examples: unique ids, known rooms, a class, a surface, positive extents, regions on saved images."""
    checks = []
    if m.damage is not None:
        d, key = m.damage, F.coalesce("example_id", F.lit(""))
        checks += [
            v.not_blank(d, key, "example_id", "damage_id"), v.unique(d.where(F.trim("example_id") != ""), ["example_id"], "damage_id"), v.not_blank(d, key, "damage_class", "damage_class"),
            v.not_blank(d, key, "surface_id", "damage_surface"), matched(d, ["room_id"], m.rooms, "damage_room", "refers to nothing"), positive_or_null(d, "example_id", "extent_m2", "damage_extent"),
        ]
    if m.damage_regions is not None:
        r = m.damage_regions
        named = r.where(F.trim("image_path") != "")
        checks += [v.not_blank(r, "example_id", "image_path", "damage_image"), v.holds(named, "image_path", F.col("image_found"), "damage_image", "was not found"), v.ring(named, "example_id", "polygon_px", "damage_polygon")]
    return checks


def sidecar(fields: DataFrame, allowed: Sequence[str], regions: DataFrame, images: DataFrame) -> DataFrame:
    """Only known fields; regions on known images with valid polygons."""
    return v.report([
        v.one_of(fields, "field", "field", allowed, "sidecar_field"), v.refers(regions, "image_path", images, "image_path", "region_image"), v.ring(regions, "image_path", "polygon_px", "region_polygon"),
    ])


#: What a declared fix must say in words.
FIX_TEXTS = ("fix_id", "target_gate", "target_metric", "root_cause_hypothesis", "proposed_fix", "direction", "before_report", "after_report")


def fix_declaration(fixes: DataFrame, reports: DataFrame, runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Declared fixes that can't be evaluated.

    fixes (fix_id, target_gate, target_metric, root_cause_hypothesis, proposed_fix, direction, acceptance_threshold, predicted_after,
    before_report, after_report, commands array<string>), reports (path, benchmark_id), runs (path, tier, room_id, capture_id, repeat_group)
    of the reports, artifacts (fix_id, path, found). Both reports must exist, be of one benchmark and hold the same runs as a multiset.
    """
    c = F.col
    number = lambda name: F.coalesce(~F.isnan(name) & (F.abs(name) < float("inf")), F.lit(False))
    commands = F.coalesce((F.size("commands") > 0) & F.forall("commands", lambda x: F.coalesce(F.trim(x) != "", F.lit(False))), F.lit(False))
    known = reports.select(c("path").alias("_path"), c("benchmark_id").alias("_id"))
    side = lambda k: known.select(c("_path").alias(f"{k}_report"), c("_id").alias(f"_{k}"), F.lit(True).alias(f"_{k}_there"))
    both = fixes.join(side("before"), "before_report", "left").join(side("after"), "after_report", "left")
    there = c("_before_there").isNotNull() & c("_after_there").isNotNull()
    # The runs of a report, counted and hashed: equal reports have equal sums.
    run = F.xxhash64(*[F.coalesce(c(x).cast("string"), F.lit("\0")) for x in ("tier", "room_id", "capture_id", "repeat_group")])
    signed = runs.groupBy("path").agg(F.count(F.lit(1)).alias("_n"), F.sum(run.cast("decimal(38,0)")).alias("_sum"))
    signature = lambda k: signed.select(c("path").alias(f"{k}_report"), F.struct("_n", "_sum").alias(f"_{k}_runs"))
    pairs = both.where(there).join(signature("before"), "before_report", "left").join(signature("after"), "after_report", "left")
    return v.report([
        *[v.not_blank(fixes, "fix_id", name, f"fix_{name}" if name != "fix_id" else name) for name in FIX_TEXTS], v.unique(fixes, ["fix_id"], "fix_id"), v.one_of(fixes, "fix_id", "direction", ("higher_is_better", "lower_is_better"), "fix_direction"),
        v.holds(fixes, "fix_id", number("predicted_after") & number("acceptance_threshold"), "fix_numbers", "needs a prediction and a threshold"), v.holds(fixes, "fix_id", commands, "fix_commands", "needs the exact commands"),
        v.holds(both, "fix_id", there, "fix_reports", "don't both exist"), v.holds(both.where(there), "fix_id", c("_before").eqNullSafe(c("_after")), "fix_benchmark", "must be one benchmark"),
        v.holds(pairs, "fix_id", c("_before_runs").eqNullSafe(c("_after_runs")), "fix_runs", "must be the same runs"), v.holds(artifacts, "path", F.col("found"), "fix_evidence", "doesn't exist"),
    ])


def ablation(pairs: DataFrame) -> DataFrame:
    """Two runs are comparable: same capture, the expected modes, the same raw path whatever its case."""
    return v.report([
        v.holds(pairs, "capture_id", F.col("capture_a") == F.col("capture_b"), "ablation_capture", "must be one capture"),
        v.holds(pairs, "capture_id", (F.col("mode_a") == "raw") & (F.col("mode_b") == "corrected"), "ablation_modes", "must be raw, then corrected"),
        v.holds(pairs, "capture_id", F.lower("path_a") == F.lower("path_b"), "ablation_path", "must be one source"),
    ])


def photo_collection(images: DataFrame) -> DataFrame:
    """images (folder, path), folder null at the top: no mixing, at least 2 rooms, 2 to 8 images in each."""
    mixed = images.agg(F.count_if(F.col("folder").isNull()).alias("top"), F.count("folder").alias("below"), F.count_distinct("folder").alias("rooms"))
    return v.report([
        v.holds(mixed, F.lit("collection"), (F.col("top") == 0) | (F.col("below") == 0), "photo_mixing", "mustn't mix images with room folders"),
        v.holds(mixed, F.lit("collection"), (F.col("below") == 0) | (F.col("rooms") >= 2), "photo_rooms", "must have at least 2 rooms"),
        v.group_size(images.where("folder IS NOT NULL"), "folder", 2, 8, "photo_count"),
    ])


def plan(spaces: DataFrame, width: float, height: float) -> DataFrame:
    """spaces (space_id, kind, vertices): unique ids and polygons inside the image, border included."""
    inside = F.forall("vertices", lambda p: (p[0] <= width) & (p[1] <= height))
    return v.report([v.not_blank(spaces, "space_id", "space_id", "space_id"), v.unique(spaces, ["space_id"], "space_id"), v.ring(spaces, "space_id", "vertices", "space_polygon"), v.holds(spaces, "space_id", inside, "space_bounds", "must lie inside the image")])
