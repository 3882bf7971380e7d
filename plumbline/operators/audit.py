"""Before and after, declared fixes, plan comparison and the scale search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.stats import ratio


def delta(before: Column, after: Column) -> tuple[Column, Column]:
    """Change and change relative to the size of the first value; null where either is missing or the first is 0."""
    return after - before, ratio(after - before, F.abs(before))


def delta_report(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    both = before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key, "full")
    change, relative = delta(F.col("before"), F.col("after"))
    return both.select(key, "before", "after", change.alias("delta"), (relative * 100).alias("percent_change"))


def fix_evaluation(fixes: DataFrame) -> DataFrame:
    """Declared fixes: what changed, whether it went the declared way, and whether it is accepted.

    fixes (direction: higher_is_better or lower_is_better, before, after, after_gate_pass, predicted_after,
    acceptance_threshold). Distances from the threshold are absolute. A fix passes if the gate passed after
    it and its value meets the threshold.
    """
    c = F.col
    up = c("direction") == "higher_is_better"
    change = c("after") - c("before")
    met = F.when(up, c("after") >= c("acceptance_threshold")).otherwise(c("after") <= c("acceptance_threshold"))
    return (
        fixes.withColumn("actual_delta", change)
        .withColumn("predicted_delta", c("predicted_after") - c("before"))
        .withColumn("improved", F.when(up, change).otherwise(-change) > 0)
        .withColumn("prediction_error", F.abs(c("after") - c("predicted_after")))
        .withColumn("distance_before", F.abs(c("before") - c("acceptance_threshold")))
        .withColumn("distance_after", F.abs(c("after") - c("acceptance_threshold")))
        .withColumn("moved_toward_threshold", c("distance_after") < c("distance_before"))
        .withColumn("threshold_satisfied", met)
        .withColumn("fix_pass", F.coalesce(c("after_gate_pass"), F.lit(False)) & met)
    )


def same_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(equal, unique): are two run lists equal as multisets, and free of repeats?"""
    rest = a.exceptAll(b).unionByName(b.exceptAll(a)).agg((F.count(F.lit(1)) == 0).alias("equal"))
    repeats = a.groupBy(*a.columns).count().unionByName(b.groupBy(*b.columns).count()).agg(F.coalesce(F.max("count") <= 1, F.lit(True)).alias("unique"))
    return rest.crossJoin(repeats)  # one row each


def set_scores(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall and F1 of two sets of rows; two empty sets agree fully, F1 is null where both rates are 0."""
    keys = predicted.columns
    a, b = predicted.distinct().withColumn("_p", F.lit(1)), truth.distinct().withColumn("_t", F.lit(1))
    counts = a.join(b, keys, "full").agg(
        F.count_if(F.col("_p").isNotNull() & F.col("_t").isNotNull()).alias("n_matched"), F.count("_p").alias("n_predicted"), F.count("_t").alias("n_truth")
    )
    c = F.col

    def rate(whole: str) -> Column:
        return F.when((c("n_predicted") == 0) & (c("n_truth") == 0), 1.0).when(c(whole) == 0, 0.0).otherwise(c("n_matched") / c(whole))

    got = counts.withColumn("precision", rate("n_predicted")).withColumn("recall", rate("n_truth"))
    return got.withColumn("f1", ratio(2 * c("precision") * c("recall"), c("precision") + c("recall")))


def iou_scores(ious: DataFrame, intersection: str = "intersection", union: str = "union") -> DataFrame:
    """Mean of the rows' IoU and the IoU of the sums."""
    return ious.agg(F.avg("iou").alias("mean_iou"), ratio(F.sum(intersection), F.sum(union)).alias("micro_iou"))


def dimension_report(rows: DataFrame, truth: str, label: str) -> DataFrame:
    """Compare printed dimensions with those of a candidate, axis by axis (arrays, entries may be null).

    missing_or_incompatible without a candidate list of equal length; different_or_unscorable if an axis
    is known on one side only; consistent if no known axis differs at all; else unavailable. Rows without
    printed dimensions go.
    """
    same_length = F.coalesce(F.size(label) == F.size(truth), F.lit(False))
    pairs = F.when(same_length, F.arrays_zip(F.col(truth).alias("t"), F.col(label).alias("l")))
    errors = F.transform(F.filter(pairs, lambda p: p["t"].isNotNull() & p["l"].isNotNull()), lambda p: F.abs(p["l"] - p["t"]))
    neither = F.size(F.filter(pairs, lambda p: p["t"].isNull() & p["l"].isNull()))
    one_sided = F.exists(pairs, lambda p: p["t"].isNull() != p["l"].isNull())
    status = (
        F.when(~same_length, "missing_or_incompatible").when(one_sided, "different_or_unscorable")
        .when((F.size(errors) > 0) & F.forall(errors, lambda e: e == 0), "consistent").otherwise("unavailable")
    )
    scored = rows.where(F.col(truth).isNotNull())
    return scored.withColumn("differences", F.when(F.size(errors) > 0, errors)).withColumn("unavailable_axes", F.when(same_length, neither)).withColumn("status", status)


def dimension_summary(report: DataFrame) -> DataFrame:
    """Spaces with printed dimensions, consistent ones, and the mean difference over all scored axes."""
    total = F.sum(F.aggregate("differences", F.lit(0.0), lambda s, e: s + e))
    axes = F.sum(F.when(F.col("differences").isNotNull(), F.size("differences")))
    return report.agg(F.count(F.lit(1)).alias("n_spaces"), F.count_if(F.col("status") == "consistent").alias("n_consistent"), ratio(total, axes).alias("mean_difference"))


def plan_counts(spaces: DataFrame) -> DataFrame:
    """How many spaces of each kind ("room" by default) and how many dimensions."""
    kind = F.coalesce(F.col("space_kind"), F.lit("room"))
    return spaces.groupBy(kind.alias("space_kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.aggregate("dimensions_m", F.lit(0), lambda s, v: s + v.isNotNull().cast("int")), F.lit(0))).alias("n_dimensions"))


def dimensioned_spans(spaces: DataFrame) -> DataFrame:
    """(room_id, a, b, w, h) of spaces (room_id, dimensions_m, vertices) with two positive dimensions and three vertices or more: dimensions and spans of the bounding box."""
    good = (F.size("dimensions_m") == 2) & F.forall("dimensions_m", lambda d: F.coalesce(d > 0, F.lit(False))) & (F.size("vertices") >= 3)
    span = lambda k: F.array_max(F.transform("vertices", lambda p: p[k])) - F.array_min(F.transform("vertices", lambda p: p[k]))
    return spaces.where(good).select("room_id", F.col("dimensions_m")[0].alias("a"), F.col("dimensions_m")[1].alias("b"), span(0).alias("w"), span(1).alias("h"))


def _oriented(rows: DataFrame, count: int) -> DataFrame:
    """Adds x and y, the stated dimensions along the drawn axes under `mask`: its highest bit is the first room's swap."""
    swap = F.expr(f"shiftright(mask, cast({count - 1} - ordinal as int))").bitwiseAND(F.lit(1)) == 1
    return rows.withColumn("swapped", swap).withColumn("x", F.when(F.col("swapped"), F.col("b")).otherwise(F.col("a"))).withColumn("y", F.when(F.col("swapped"), F.col("a")).otherwise(F.col("b")))


def orientation_search(rooms: DataFrame, count: int) -> DataFrame:
    """Best assignment of stated dimensions to drawn axes of all 2**count: (fit, mask, scale_x, scale_y, rms, mean, most).

    rooms (ordinal 0.., stated a and b, drawn w and h). For each mask of swapped rooms the drawn units a metre
    are fitted by least squares, one scale for both axes (uniform) or one for each (independent); the relative
    errors of the drawn sizes at that scale decide by root mean square, the first of equals wins. Errors in percent.
    """
    c, spark = F.col, rooms.sparkSession
    masks = spark.range(1 << count).withColumnRenamed("id", "mask")
    both = _oriented(masks.crossJoin(F.broadcast(rooms.select("ordinal", "a", "b", "w", "h"))), count)  # `count` rooms, 20 at most
    p, q = c("w") / c("x"), c("h") / c("y")
    total = lambda v, name: F.sum(v).alias(name)
    sums = both.groupBy("mask").agg(
        F.count(F.lit(1)).alias("n"), total(c("w") * c("x"), "wx"), total(c("h") * c("y"), "hy"), total(c("x") * c("x"), "xx"), total(c("y") * c("y"), "yy"),
        total(p, "p1"), total(p * p, "p2"), total(q, "q1"), total(q * q, "q2"),
    )
    uniform = (c("wx") + c("hy")) / (c("xx") + c("yy"))
    fits = F.array(F.struct(F.lit("uniform").alias("fit"), uniform.alias("sx"), uniform.alias("sy")), F.struct(F.lit("independent").alias("fit"), (c("wx") / c("xx")).alias("sx"), (c("hy") / c("yy")).alias("sy")))
    each = sums.withColumn("_f", F.explode(fits)).select("*", "_f.*").drop("_f")
    squares = (c("n") - 2 * c("p1") / c("sx") + c("p2") / (c("sx") * c("sx"))) + (c("n") - 2 * c("q1") / c("sy") + c("q2") / (c("sy") * c("sy")))
    rms = F.sqrt(F.greatest(F.lit(0.0), squares) / (2 * c("n"))) * 100
    best = each.groupBy("fit").agg(F.min(F.struct(rms.alias("rms"), "mask", "sx", "sy")).alias("_b"))
    chosen = best.select("fit", "_b.mask", c("_b.sx").alias("scale_x"), c("_b.sy").alias("scale_y"), "_b.rms")
    errors = orientation_rooms(rooms, chosen, count).select("fit", F.explode(F.array("error_x", "error_y")).alias("_e"))
    sizes = errors.groupBy("fit").agg(F.avg(F.abs("_e")).alias("mean"), F.max(F.abs("_e")).alias("most"))
    return chosen.join(sizes, "fit")


def orientation_rooms(rooms: DataFrame, chosen: DataFrame, count: int) -> DataFrame:
    """The rooms at each chosen fit: assigned dimensions, drawn sizes at the fitted scale and relative errors in percent."""
    c = F.col
    placed = _oriented(rooms.crossJoin(F.broadcast(chosen.select("fit", "mask", "scale_x", "scale_y"))), count)  # two fits
    sized = placed.withColumn("size_x", c("w") / c("scale_x")).withColumn("size_y", c("h") / c("scale_y"))
    return sized.withColumn("error_x", (c("size_x") - c("x")) / c("x") * 100).withColumn("error_y", (c("size_y") - c("y")) / c("y") * 100)


def evidence_rollup(rooms: DataFrame, models: DataFrame, images: DataFrame, key: str) -> DataFrame:
    """What each room's models register: models, distinct images and memberships, the largest model and its coverage, sparse points; rooms without models stay.

    rooms (key, sampled), models (key, model_id, registered_images, sparse_points), images (key, image).
    """
    c = F.col
    distinct = images.groupBy(key, "image").agg(F.lit(1).alias("_one")).groupBy(key).agg(F.count(F.lit(1)).alias("n_registered"))
    best = models.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_models"), F.sum("registered_images").alias("n_memberships"), F.sum("sparse_points").alias("sparse_points"),
        F.max_by("model_id", F.struct("registered_images", "sparse_points", -c("model_id"))).alias("primary_model"), F.max("registered_images").alias("largest"),
    )
    got = rooms.select(key, "sampled").join(best, key, "left").join(distinct, key, "left").na.fill(0, ["n_models", "n_memberships", "n_registered", "largest", "sparse_points"])
    return got.withColumn("coverage_percent", F.round(ratio(c("largest"), c("sampled")) * 100, 1)).withColumn("three_or_more", c("largest") >= 3)


def quality_summary(models: DataFrame, sampled: Column, keys: Sequence[str] = ()) -> DataFrame:
    return models.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_models"), F.sum("registered_images").alias("n_memberships"), F.max("registered_images").alias("largest")).withColumn("coverage_percent", F.round(ratio(F.col("largest"), sampled) * 100, 1))
