"""Sinks: results after validation, point clouds, GeoJSON and SVG as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import validate


def results(df: DataFrame, violations: DataFrame, path: str) -> None:
    """JSON documents, written only if there are no violations."""
    validate.assert_clean(df, violations).write.json(path)


def ply_lines(points: DataFrame) -> DataFrame:
    """(part, line) of an ASCII point cloud: a header as part 0, then a line a point in order of point_idx."""
    count = points.agg(F.count(F.lit(1)).alias("n"))
    names = ["float x", "float y", "float z", "uchar red", "uchar green", "uchar blue"]
    head = F.concat(F.lit("ply\nformat ascii 1.0\nelement vertex "), F.col("n").cast("string"), F.lit("\n" + "".join(f"property {p}\n" for p in names) + "end_header"))
    header = count.select(F.lit(-1).cast("long").alias("point_idx"), head.alias("line"))
    body = points.select("point_idx", F.format_string("%.6f %.6f %.6f %d %d %d", *[F.col(c).cast("double") for c in "xyz"], *[F.col(c).cast("int") for c in "rgb"]).alias("line"))
    return header.unionByName(body)


def ply(points: DataFrame, path: str) -> None:
    """Sorted parts whose names sort as their lines do: concatenated, they are the file."""
    ply_lines(points).repartitionByRange("point_idx").sortWithinPartitions("point_idx").select("line").write.text(path)


def features(df: DataFrame, kind: str, geometry: str, coordinates: str, *properties: str) -> DataFrame:
    """GeoJSON features of one kind as text."""
    props = F.struct(F.lit(kind).alias("feature_type"), *properties)
    shape = F.struct(F.lit(geometry).alias("type"), F.col(coordinates).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), shape.alias("geometry"))).alias("feature"))


def feature_collection(parts: list[DataFrame]) -> DataFrame:
    """One document of a plan's features, kinds in the order given. A plan has tens of features."""
    rows = None
    for k, p in enumerate(parts):
        own = p.select(F.lit(k).alias("k"), "feature")
        rows = own if rows is None else rows.unionByName(own)
    listed = rows.agg(F.array_sort(F.collect_list(F.struct("k", "feature"))).alias("f"))
    return listed.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.concat_ws(",", F.transform("f", lambda x: x["feature"])), F.lit("]}")).alias("document"))


def svg(plan: DataFrame, key: str, ring: str, scale: float = 40.0) -> DataFrame:
    """A drawing of the rings of one plan, one polygon a room."""
    points = F.concat_ws(" ", F.transform(ring, lambda p: F.format_string("%.1f,%.1f", p["x"] * scale, p["y"] * scale)))
    shape = F.concat(F.lit('<polygon points="'), points, F.lit('" fill="none" stroke="black"><title>'), F.col(key), F.lit("</title></polygon>"))
    drawn = plan.select(F.struct(F.col(key).alias("k"), shape.alias("s")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("a"))
    return drawn.select(F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg">'), F.concat_ws("", F.transform("a", lambda x: x["s"])), F.lit("</svg>")).alias("document"))


def report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
