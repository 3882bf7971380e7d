"""Measured truth against predictions: rows, gates, repeats, interval calibration, comparisons.

A null verdict means "not scored", which is not a failure on the row; a gate that asks
for every row to pass counts it as one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.stats import ratio

SCORED = ("complete", "partial")


def number(measurement: str) -> Column:
    """A measurement's value where its status lets it be scored."""
    return F.when(F.col(f"{measurement}.status").isin(*SCORED), F.col(f"{measurement}.value"))


def contains(truth: Column, low: Column, high: Column) -> Column:
    """Does the interval hold the truth? Null without both bounds."""
    return F.when(low.isNotNull() & high.isNotNull(), (truth >= low) & (truth <= high))


def metric_rows(rows: DataFrame, truth: str, prediction: str, tolerance: Column | None = None, kind: str = "relative", low: str | None = None, high: str | None = None) -> DataFrame:
    """Absolute and relative error, interval containment and the tolerance verdict of each row."""
    error = F.abs(F.col(prediction) - F.col(truth))
    out = rows.withColumn("absolute_error", error).withColumn("relative_error", ratio(error, F.abs(F.col(truth))))
    if low and high:
        out = out.withColumn("interval_contains_truth", contains(F.col(truth), F.col(low), F.col(high)))
    if tolerance is not None:
        of = "relative_error" if kind == "relative" else "absolute_error"
        out = out.withColumn("gate_tolerance", tolerance).withColumn("gate_tolerance_kind", F.lit(kind)).withColumn("gate_pass", F.col(of) <= F.col("gate_tolerance"))
    return out


def strict(verdict: Column) -> Column:
    """True only if every row is True; null without rows."""
    return F.bool_and(F.coalesce(verdict, F.lit(False)))


def all_gate(rows: DataFrame, groups: DataFrame, key: str, verdict: str = "gate_pass") -> DataFrame:
    """The strict gate for each group of a dimension, null for a group without rows."""
    got = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(verdict)).alias("n_pass"), strict(F.col(verdict)).alias("gate_pass"))
    return groups.select(key).join(got, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_pass", F.lit(0)).alias("n_pass"), "gate_pass")


def detection_gate(rows: DataFrame, phantoms: DataFrame, key: str, verdict: str = "gate_pass", least: float = 0.85) -> DataFrame:
    """Share within tolerance over truths and phantoms; misses stay in the denominator, an empty one gives null."""
    truth = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_truth"), F.count_if(F.col(verdict)).alias("n_within"))
    extra = phantoms.groupBy(key).agg(F.count(F.lit(1)).alias("n_phantom"))
    both = truth.join(extra, key, "full").na.fill(0, ["n_truth", "n_within", "n_phantom"])
    rate = ratio(F.col("n_within"), F.col("n_truth") + F.col("n_phantom"))
    return both.withColumn("rate", rate).withColumn("gate_pass", F.col("rate") >= least)


def repeatability(rows: DataFrame, keys: Sequence[str], value: str, truth: str, absolute: float = 0.01, relative: float = 0.005) -> DataFrame:
    """Spread over the measured ones of repeated captures against max(absolute, relative * truth); with fewer than two measured it fails.

    Groups of one capture aren't repeats and go.
    """
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_samples"), F.count(value).alias("n_measured"), (F.max(value) - F.min(value)).alias("_spread"), F.max(truth).alias("_truth")).where("n_samples >= 2")
    limit = F.greatest(F.lit(absolute), F.abs(F.col("_truth")) * relative)
    spread = F.when(F.col("n_measured") >= 2, F.col("_spread"))
    return out.select(*keys, "n_samples", "n_measured", spread.alias("spread"), limit.alias("tolerance"), F.coalesce(spread <= limit, F.lit(False)).alias("gate_pass"))


def common_objects(rows: DataFrame, group: str, sample: str, obj: str) -> DataFrame:
    """Objects seen in every sample of their group."""
    total = rows.groupBy(group).agg(F.count_distinct(sample).alias("_all"))
    seen = rows.groupBy(group, obj).agg(F.count_distinct(sample).alias("_seen"))
    return seen.join(total, group).where("_seen = _all").select(group, obj)


def calibration(rows: DataFrame, keys: Sequence[str], contained: str = "interval_contains_truth") -> DataFrame:
    """Samples, how many have an interval, and the empirical coverage."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"), F.count(contained).alias("n_interval"),
        (F.count(F.lit(1)) - F.count(contained)).alias("n_missing"), F.avg(F.col(contained).cast("double")).alias("coverage"),
    )


def compare(rows: DataFrame, truth: str, ours: str, theirs: str) -> DataFrame:
    """win, tie or loss by absolute error, with a tie tolerance relative to the truth; null if either is missing."""
    a, b = F.abs(F.col(ours) - F.col(truth)), F.abs(F.col(theirs) - F.col(truth))
    slack = F.greatest(F.lit(1e-6), F.abs(F.col(truth)) * 1e-6)
    return rows.withColumn("outcome", F.when(a.isNull() | b.isNull(), None).when(F.abs(a - b) <= slack, "tie").when(a < b, "win").otherwise("loss"))


def comparison_gate(rows: DataFrame, room: str, keys: Sequence[str] = (), least: float = 0.70, rooms: int = 2) -> DataFrame:
    """Share of wins and ties among the compared rows, over at least so many rooms; null where nothing can be compared."""
    out = rows.groupBy(*keys).agg(
        F.count("outcome").alias("n_scored"), *[F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in ("win", "tie", "loss")],
        F.count_if(F.col("outcome").isNull()).alias("n_not_comparable"), F.count_distinct(F.when(F.col("outcome").isNotNull(), F.col(room))).alias("n_rooms"),
    )
    rate, enough = ratio(F.col("n_win") + F.col("n_tie"), F.col("n_scored")), F.col("n_rooms") >= rooms
    status = F.when(F.col("n_scored") == 0, "not_scored").when(enough, "scored").otherwise("incomplete")
    return out.withColumn("win_or_tie_rate", rate).withColumn("status", status).withColumn("gate_pass", F.when(F.col("n_scored") > 0, (F.col("win_or_tie_rate") >= least) & enough))


def runtime_gate(rows: DataFrame, runtime: str, keys: Sequence[str] = (), most: float = 900.0) -> DataFrame:
    """Every run within the limit; null unless every run is measured."""
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_runs"), F.count(runtime).alias("n_measured"), F.bool_and(F.col(runtime) <= most).alias("_all"))
    return out.withColumn("gate_pass", F.when((F.col("n_runs") == F.col("n_measured")) & (F.col("n_runs") > 0), F.col("_all"))).drop("_all")


def readiness(rooms: DataFrame, runs: DataFrame, examples: DataFrame, tiers: Sequence[str]) -> DataFrame:
    """(check, passed) for a benchmark's coverage: rooms, a connector, the same rooms in each tier, repeats, damage classes.

    rooms (room_id, kind), runs (tier, room_id, repeat_group, capture_id), examples (damage_class).
    """
    spark = rooms.sparkSession
    in_tiers = runs.where(F.col("tier").isin(*tiers)).groupBy("room_id").agg(F.count_distinct("tier").alias("t"))
    everywhere = rooms.where("kind = 'room'").select("room_id").join(in_tiers, "room_id", "left").agg(F.bool_and(F.coalesce(F.col("t") == len(tiers), F.lit(False))).alias("p"))
    repeats = runs.where("repeat_group IS NOT NULL").groupBy("room_id", "tier", "repeat_group").agg(F.count_distinct("capture_id").alias("c")).agg((F.count_if(F.col("c") >= 2) > 0).alias("p"))
    checks = {
        "rooms": rooms.agg((F.count_distinct(F.when(F.col("kind") == "room", F.col("room_id"))) >= 3).alias("p")),
        "connector": rooms.agg((F.count_if(F.col("kind") == "connector") > 0).alias("p")),
        "same_rooms": everywhere,
        "repeats": repeats,
        "damage_classes": examples.agg((F.count_distinct("damage_class") >= 2).alias("p")),
    }
    out = spark.createDataFrame([], "check string, passed boolean")
    for name, df in checks.items():
        out = out.unionByName(df.select(F.lit(name).alias("check"), F.coalesce("p", F.lit(False)).alias("passed")))
    return out


def same_set(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (equal) for two frames of the same columns taken as sets."""
    left, right = a.distinct().withColumn("_s", F.lit(1)), b.distinct().withColumn("_s", F.lit(2))
    both = left.unionByName(right).groupBy(*a.columns).agg(F.count(F.lit(1)).alias("_n"))
    return both.agg(F.coalesce(F.bool_and(F.col("_n") == 2), F.lit(True)).alias("equal"))


def stitch_gate(rows: DataFrame, adjacency_equal: str, overlaps: str, status: str, tolerance: float) -> DataFrame:
    """The whole-plan gate: footprint within tolerance and interval, adjacency equal, no overlap, complete."""
    verdict = (F.col("relative_error") <= tolerance) & F.col("interval_contains_truth") & F.col(adjacency_equal) & (F.col(overlaps) == 0) & (F.col(status) == "complete")
    return rows.withColumn("gate_pass", F.coalesce(verdict, F.lit(False)))


def best_first(rows: DataFrame, by: Sequence[str], order: Sequence[Column], count: int) -> DataFrame:
    """The first `count` rows of each group."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= count).drop("_rank")
