"""Guarded ratios, exact percentiles, histograms, samples by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def coverage(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(ratio(part, whole) * 100, digits)


def arg_first_max(value: str, *order: Column) -> Column:
    """`value` of the row with the greatest `order`; put negated ordinals last so that ties go to the first row."""
    return F.max_by(value, F.struct(*order))


def percentiles(df: DataFrame, value: str, shares: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact, linearly interpolated percentiles; nulls don't count, and a group without values has null ones.

    Distinct values are counted, dealt out by group and value range, and ranked by running counts within a
    range and the totals of the ranges before it; the two values beside each wanted rank are picked. So a
    group's values are spread over tasks however many there are.
    """
    from plumbline.session import cut

    c, keys = F.col, [F.col(k).alias(f"_k{i}") for i, k in enumerate(by)]
    names = [f"_k{i}" for i in range(len(by))]
    counts = df.where(c(value).isNotNull()).groupBy(*keys, c(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranged = cut(counts.repartitionByRange(*names, "_v").withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy(*names, "_part").agg(F.sum("_n").alias("_size"))
    whole = Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))  # a row for each part of a group
    before = F.coalesce(F.sum("_size").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = parts.select(*[c(n).alias(f"_p{n}") for n in names], c("_part").alias("_q"), before.alias("_before"), F.sum("_size").over(whole).alias("_total"))
    last = F.sum("_n").over(Window.partitionBy(*names, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)) - 1
    same = [c(n).eqNullSafe(c(f"_p{n}")) for n in names] + [c("_part") == c("_q")]
    ranked = ranged.withColumn("_last", last).join(shifts, same).withColumn("_hi", c("_last") + c("_before")).withColumn("_lo", c("_hi") - c("_n") + 1)
    spots = {name: F.lit(float(q)) * (c("_total") - 1) for name, q in shares.items()}
    holds = lambda at: (c("_lo") <= at) & (at <= c("_hi"))
    wanted = None
    for at in spots.values():
        hit = holds(F.floor(at)) | holds(F.ceil(at))
        wanted = hit if wanted is None else wanted | hit
    picked = ranked.where(wanted)
    ends = [(F.max(F.when(holds(F.floor(at)), c("_v"))).alias(f"_a{k}"), F.max(F.when(holds(F.ceil(at)), c("_v"))).alias(f"_b{k}"), F.max(at - F.floor(at)).alias(f"_w{k}")) for k, at in enumerate(spots.values())]
    got = picked.groupBy(*names).agg(*[e for three in ends for e in three])
    found = got.select(*names, *[(c(f"_a{k}") + (c(f"_b{k}") - c(f"_a{k}")) * c(f"_w{k}")).alias(name) for k, name in enumerate(spots)])
    groups = df.groupBy(*keys).agg(F.lit(1).alias("_one")) if names else df.agg(F.lit(1).alias("_one"))
    if not names:
        return groups.join(found, F.lit(True), "left").drop("_one")  # one row each
    renamed = found.select(*[c(n).alias(f"_f{n}") for n in names], *shares)
    return groups.join(renamed, [c(n).eqNullSafe(c(f"_f{n}")) for n in names], "left").select(*[c(n).alias(k) for n, k in zip(names, by, strict=True)], *shares)


def beside(figures: DataFrame, more: DataFrame, by: Sequence[str]) -> DataFrame:
    """Two sets of figures of the same groups as one."""
    if not by:
        return figures.join(more, F.lit(True))  # one row each
    named = more.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(by)], *[x for x in more.columns if x not in by])
    return figures.join(named, [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(by)]).drop(*[f"_g{i}" for i in range(len(by))])


def error_stats(df: DataFrame, error: str, within: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, median, 90th percentile and shares within limits of absolute errors."""
    sized = df.withColumn("_e", F.abs(F.col(error)))
    figures = sized.groupBy(*by).agg(F.count(error).alias("n"), F.avg("_e").alias("mean_error"), *[F.avg((F.col("_e") <= limit).cast("double")).alias(name) for name, limit in within.items()])
    both = beside(figures, percentiles(sized, "_e", {"median_error": 0.5, "p90_error": 0.9}, by), by)
    return both.select(*by, "n", "mean_error", "median_error", "p90_error", *within)


def bucketed(df: DataFrame, value: str, error: str, edges: Sequence[float]) -> DataFrame:
    """Errors by half-open ranges of `value`, the last closed; a range without rows has count 0 and null figures."""
    spark = df.sparkSession
    ranges = list(zip(edges, edges[1:], strict=False))
    names = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(ranges)], "bucket int, low double, high double")
    case = None
    for k, (a, b) in enumerate(ranges):
        inside = (F.col(value) >= a) & ((F.col(value) <= b) if k == len(ranges) - 1 else (F.col(value) < b))
        case = F.when(inside, k) if case is None else case.when(inside, k)
    placed = df.withColumn("bucket", case).where("bucket IS NOT NULL").withColumn("_e", F.abs(F.col(error)))
    figures = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("_e").alias("mean_error"))
    got = beside(figures, percentiles(placed, "_e", {"median_error": 0.5}, ["bucket"]), ["bucket"])
    return names.join(got, "bucket", "left").select("bucket", "low", "high", F.coalesce("n", F.lit(0)).alias("n"), "mean_error", "median_error")


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Map of value to count; two aggregates, so that no group's rows are collected."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(value).cast("string"), "_n")))).alias("counts"))


def low_mode(df: DataFrame, value: str, width: float, share: float = 0.1) -> DataFrame:
    """Centre of the fullest bin of the values up to the `share` quantile.

    Bins of `width` start half a width below the minimum; the first of equally full bins wins.
    """
    bounds = beside(df.agg(F.min(value).alias("_min")), percentiles(df, value, {"_cut": share}), [])
    low = df.crossJoin(F.broadcast(bounds)).where(F.col(value) <= F.col("_cut"))  # one row of bounds
    bins = low.groupBy(F.floor((F.col(value) - (F.col("_min") - width / 2)) / width).cast("long").alias("bin"), "_min").agg(F.count(F.lit(1)).alias("n"))
    best = bins.agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("bin"), F.col("_min"))).alias("b"))
    return best.select(F.col("b.bin").alias("bin"), (-F.col("b.n")).alias("n"), (F.col("b._min") + F.col("b.bin") * width).alias("level"))


def extent(df: DataFrame, value: str, by: Sequence[str] = (), low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Trimmed extent between two percentiles."""
    return percentiles(df, value, {"low": low, "high": high}, by).withColumn("extent", F.col("high") - F.col("low"))


def positions(df: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """0-based position of each row, and the number of rows.

    Without `by`, rows are numbered within range partitions and shifted by the sizes of
    the ones before, so no task sees them all.
    """
    if by:
        w = Window.partitionBy(*by)
        return df.withColumn("position", (F.row_number().over(w.orderBy(*order)) - 1).cast("long")).withColumn("total", F.count(F.lit(1)).over(w))
    from plumbline.session import cut

    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    shifts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"), F.sum("_size").over(Window.partitionBy(F.lit(0))).alias("total"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_local", local).join(F.broadcast(shifts), "_part").withColumn("position", F.col("_local") + F.col("_shift")).drop("_part", "_local", "_shift")


def stride(df: DataFrame, order: Sequence[str], step: int, by: Sequence[str] = ()) -> DataFrame:
    return positions(df, order, by).where(F.col("position") % step == 0).drop("position", "total")


def spaced(df: DataFrame, order: Sequence[str], count: int) -> DataFrame:
    """`count` rows evenly over the order, first and last included (indices truncate); all rows if there are fewer."""
    rows = positions(df, order)
    # Position p is hit iff some i in [0, count) has floor(i * (total - 1) / (count - 1)) = p: the least i that reaches p decides.
    span, steps = F.col("total") - 1, max(1, count - 1)
    least = F.ceil(F.col("position") * steps / F.nullif(span.cast("double"), F.lit(0.0)))
    hit = F.floor(least * span / steps) == F.col("position")
    return rows.where((F.col("total") <= count) | (F.col("position") == 0) | (hit & F.lit(count > 1))).drop("position", "total")


def sampled_frames(frames: DataFrame, order: Sequence[str], fps: float, wanted_fps: float, cap: int) -> DataFrame:
    """Every round(fps / wanted)-th frame in order, thinned evenly beyond `cap`: the frames with `position` and `total`.

    Of n chosen frames those at round(k * (n - 1) / (cap - 1)), halves to even, stay; with a cap of 1 the first does.
    """
    step = max(1, round(fps / wanted_fps))
    c = F.col
    chosen = positions(frames, order).where(c("position") % step == 0)
    place, n = c("position") / step, F.ceil(c("total") / step)
    if cap == 1:
        return chosen.where("position = 0")
    # A frame stays if one of the k around place * (cap - 1) / (n - 1) rounds to it.
    near = F.floor(place * (cap - 1) / F.greatest(n - 1, F.lit(1)))
    hit = None
    for d in (-1, 0, 1):
        k = near + d
        own = (k >= 0) & (k < cap) & (F.rint(k * (n - 1) / F.lit(float(cap - 1))) == place)
        hit = own if hit is None else hit | own
    return chosen.where((n <= cap) | hit)


def centered_sample(start: float, end: float, count: int) -> list[int]:
    """`count` rounded positions evenly over [start, end]."""
    if count == 1:
        return [round((start + end) / 2)]
    return [round(start + k * (end - start) / (count - 1)) for k in range(count)]


def effective_rate(df: DataFrame, at: str, by: Sequence[str]) -> DataFrame:
    """(n - 1) over the covered duration."""
    span = F.max(at) - F.min(at)
    return df.groupBy(*by).agg(F.count(at).alias("n"), span.alias("covered"), ratio(F.count(at) - 1, span).alias("rate"))
