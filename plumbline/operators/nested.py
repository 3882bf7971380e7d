"""Nested documents: measurements, safe paths, projections, overlays, envelopes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASUREMENT = "struct<status:string,value:double,unit:string,interval:struct<lower:double,upper:double,confidence_level:double>,method:string>"


def measurement(value: Column, unit: str, method: str, lower: Column | None = None, upper: Column | None = None, level: float | None = None, status: str = "complete") -> Column:
    """A measurement struct; without a value it is unavailable, with one its status is as given."""
    interval = F.when(value.isNotNull() & lower.isNotNull() & upper.isNotNull(), F.struct(lower.alias("lower"), upper.alias("upper"), F.lit(level).cast("double").alias("confidence_level"))) if lower is not None and upper is not None else F.lit(None)
    got = F.struct(F.when(value.isNull(), "unavailable").otherwise(status).alias("status"), value.cast("double").alias("value"), F.lit(unit).alias("unit"), interval.alias("interval"), F.lit(method).alias("method"))
    return got.cast(MEASUREMENT)


def unavailable(unit: str, method: str) -> Column:
    return measurement(F.lit(None).cast("double"), unit, method)


def at_path(json: str | Column, path: str, kind: str = "string") -> Column:
    """The value at a path through objects and lists, null if any step is missing or the type doesn't fit."""
    return F.get_json_object(json, path) if kind == "string" else F.try_variant_get(F.try_parse_json(json), path, kind)


def whitelist(array: str, fields: Sequence[str]) -> Column:
    """Only the listed fields of each struct in an array."""
    return F.transform(array, lambda x: F.struct(*[x[f].alias(f) for f in fields]))


def sides_with_support(sides: str, per_side: str, fallback: str) -> Column:
    """Each side with its own supporting ids, all ids where it has none."""
    return F.transform(sides, lambda s, i: F.struct(s.alias("length_m"), F.array_sort(F.array_distinct(F.coalesce(F.get(F.col(per_side), i), F.col(fallback)))).alias("supporting_ids")))


def overlay(results: DataFrame, sidecar: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Fields of a sidecar laid over the results where it has them."""
    extra = sidecar.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    both = results.join(extra, key, "left")
    return both.withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).drop(*[f"_{f}" for f in fields])


def envelope(df: DataFrame, **sections: Column) -> DataFrame:
    """One result document a row: the given sections, and empty defaults for the others."""
    defaults = {
        "status": F.lit("partial"), "rooms": F.array().cast("array<string>"), "surfaces": F.array().cast("array<string>"), "openings": F.array().cast("array<string>"),
        "damage": F.array().cast("array<string>"), "scope_lines": F.array().cast("array<string>"), "warnings": F.array().cast("array<string>"), "footprint": unavailable("m^2", "not measured"),
    }
    return df.select(F.struct(*[v.alias(k) for k, v in (defaults | sections).items()]).alias("result"))


def room_id(path: Column, root: Column) -> Column:
    """File stem at depth one, folder at depth two, null (a violation) deeper."""
    parts = F.split(F.regexp_replace(path, F.concat(F.lit("^\\Q"), root, F.lit("\\E/?")), F.lit("")), "/")
    return F.when(F.size(parts) == 1, F.regexp_replace(parts[0], r"\.[^.]*$", "")).when(F.size(parts) == 2, parts[0])


def signature(columns: Sequence[str], length: int = 8) -> Column:
    """Prefix of the SHA-256 of the joined values."""
    return F.substring(F.sha2(F.concat_ws("|", *columns), 256), 1, length)


def label(value: Column, names: dict[str, str], default: str) -> Column:
    """Mapped class name, a default for others."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(value))), F.lit(default))


# --- damage ----------------------------------------------------------------------------

# Detector labels with their classes, and the work that follows from a class.
CLASSES = {
    "crack_damage": "crack",
    "flaking_paint_damage": "flaking_paint",
    "missing_piece_damage": "missing_material",
    "water_damage": "water_damage",
}
WORK = {
    "crack": "Review, prepare, and seal detected crack; confirm crack cause and repair specification on site.",
    "flaking_paint": "Prepare the detected flaking finish and repaint after substrate review.",
    "missing_material": "Patch the detected missing wall-finish area after substrate review.",
    "water_damage": "Investigate the moisture source, dry the substrate, and repair the affected finish.",
}


def image_token(path: Column) -> Column:
    """File stem with other characters than letters, digits, _ and - as _, then eight digits of the path's SHA-256."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    safe = F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9_-]+", "_"), "^_+|_+$", "")
    return F.concat(F.when(safe == "", "image").otherwise(safe), F.lit("_"), F.substring(F.sha2(path.cast("binary"), 256), 1, 8))


def damage_class(label: Column) -> Column:
    """Class of a detector's label; one that isn't known keeps its name without "_damage"."""
    low = F.lower(F.coalesce(label, F.lit("unknown")))
    known = F.create_map(*[F.lit(x) for pair in CLASSES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, low), F.replace(low, F.lit("_damage"), F.lit("")))


def damage_regions(detections: DataFrame, scales: DataFrame | None = None, least: float = 0.25) -> DataFrame:
    """Boxes clamped to their image, with class and extent; unsure and empty ones go.

    detections (image_path, position from 1, image_width, image_height, class, confidence, x, y, width, height),
    centre-based. A crack's extent is its long side, others' their area: in metres with a scale (image_path,
    m_per_px), else in pixels. A region keeps its detection's position as number.
    """
    c = F.col
    zero = lambda name: F.coalesce(c(name), F.lit(0)).cast("double")
    clamp = lambda v, most: F.greatest(F.lit(0.0), F.least(v, c(most).cast("double")))
    wide, high = F.greatest(F.lit(0.0), zero("width")), F.greatest(F.lit(0.0), zero("height"))
    boxed = detections.where(zero("confidence") >= least).select(
        "image_path", "position", damage_class(c("class")).alias("damage_class"), zero("confidence").alias("_sure"),
        clamp(zero("x") - wide / 2, "image_width").alias("x1"), clamp(zero("y") - high / 2, "image_height").alias("y1"),
        clamp(zero("x") + wide / 2, "image_width").alias("x2"), clamp(zero("y") + high / 2, "image_height").alias("y2"),
    ).where("x2 > x1 AND y2 > y1")
    scaled = boxed.join(scales.select("image_path", "m_per_px"), "image_path", "left") if scales is not None else boxed.withColumn("m_per_px", F.lit(None).cast("double"))
    w, h, line, scale = c("x2") - c("x1"), c("y2") - c("y1"), c("damage_class") == "crack", F.coalesce("m_per_px", F.lit(1.0))
    extent = F.when(line, F.greatest(w, h) * scale).otherwise(w * h * scale * scale)
    unit = F.when(c("m_per_px").isNull(), F.when(line, "px").otherwise("px^2")).otherwise(F.when(line, "m").otherwise("m^2"))
    token, number = image_token(c("image_path")), F.lpad(c("position").cast("string"), 3, "0")
    number = F.when(c("position") < 1000, number).otherwise(c("position").cast("string"))
    corner = lambda x, y: F.array(F.round(x, 2), F.round(y, 2))
    return scaled.select(
        "image_path", "position", "damage_class", F.least(F.lit(1.0), F.greatest(F.lit(0.0), c("_sure"))).alias("confidence"), "x1", "y1", "x2", "y2",
        F.round(extent, 4).alias("extent"), unit.alias("unit"), F.concat(F.lit("damage_"), token, F.lit("_"), number).alias("region_id"),
        F.concat(F.lit("surface_"), token).alias("surface_id"), F.concat(F.lit("scope_"), token, F.lit("_"), number).alias("item_id"),
        F.array(corner(c("x1"), c("y1")), corner(c("x2"), c("y1")), corner(c("x2"), c("y2")), corner(c("x1"), c("y2"))).alias("polygon_px"),
    )


def scope_lines(regions: DataFrame) -> DataFrame:
    """One work line a region, under the same number and with its extent as quantity."""
    known = F.create_map(*[F.lit(x) for pair in WORK.items() for x in pair])
    other = F.concat(F.lit("Review and repair visible "), F.col("damage_class"), F.lit(" damage; confirm scope on site."))
    return regions.select("image_path", "item_id", "surface_id", F.coalesce(F.try_element_at(known, "damage_class"), other).alias("description"), "extent", "unit")
